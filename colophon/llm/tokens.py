"""Token counts: pieces counted once per distinct pre-token, joined to each document's pre-tokens and summed.

Texts are cut at the vocabulary's special strings and then into pre-tokens by the vocabulary's own pattern. Byte-pair
merges never cross the borders of pre-tokens, so a document has as many tokens as its pre-tokens have pieces. For
each document the frequencies of its distinct pre-tokens are counted; a distinct pre-token's pieces are counted once, kept from
document to document up to KEPT_BYTES, joined to the frequencies and summed. Ids of documents never exist.

The join stays with the worker: over the cluster, frequencies of pre-tokens per document
hold nearly as many rows as the text has words, so a shuffle of them would be larger than the text.

Cases: a null text counts as empty and has no tokens; the vocabulary's special strings are one
token each wherever they stand; a text of any length, blanks in any number included, is cut pre-token by pre-token; repeated rows, ties and other columns change nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter as Frequencies
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from colophon.llm.common import arrow_map

#: Bytes of pre-tokens and their counts that a worker keeps (of its own estimate, ENTRY bytes each beside the text).
KEPT_BYTES, ENTRY = 64 << 20, 150
#: Pre-tokens of a document whose frequencies are counted at once.
STEP = 1 << 18

#: Splits texts into pre-tokens; it is the byte-level pre-tokenizer's own.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The white space of the pattern, which is Unicode's and not the regular expression library's.
_WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Blanks in a row from which a run is cut out of a text before the pattern engine, which steps back through runs, sees it.
LONG_RUN = 10_000
_RUN = regex.compile(f"[{_WHITE}]{{{LONG_RUN},}}")
_CUT = regex.compile(PRE_TOKEN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s+", f"[{_WHITE}]+").replace(r"(?!\S)", f"(?=[{_WHITE}]|\\Z)"))


def _byte_of() -> dict[str, int]:
    """What character of a byte-level vocabulary stands for what byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary file of the tokenizers library, with its defaults."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        core = tiktoken.Encoding("from-file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._plain, self._piece = core.encode_ordinary, core.encode_single_piece

    def pieces(self, pre_token: str) -> int:
        """How many pieces a pre-token has."""
        return len(self._piece(pre_token.encode("utf-8", "surrogatepass")))

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The text's pre-tokens and special strings, in parts of at most STEP."""
        parts = re.split(f"({self.pattern.pattern})", text) if self.pattern and self.pattern.search(text) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield [part]
            elif len(part) <= STEP:
                yield _CUT.findall(part)
            else:
                found = (m[0] for m in _CUT.finditer(part))
                while some := list(islice(found, STEP)):
                    yield some

    def ids(self, text: str) -> list[int]:
        if self.pattern and self.pattern.search(text):
            out: list[int] = []
            for i, part in enumerate(re.split(f"({self.pattern.pattern})", text)):
                out += [self.special[part]] if i % 2 else self._plain_ids(part)
            return out
        return self._plain_ids(text)

    def _plain_ids(self, text: str) -> list[int]:
        """Ids of a text without special strings. A long run of blanks is a pre-token of its own, but for its last blank if something follows."""
        if len(text) < LONG_RUN or not (runs := list(_RUN.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in runs:
            end = m.end() - (m.end() < len(text))
            # the blank that the run before left stands before the next text
            out += self._plain(text[at : m.start()]) if at < m.start() else []
            out += self._piece(text[max(at, m.start()) : end].encode("utf-8", "surrogatepass"))
            at = end
        return out + (self._plain(text[at:]) if at < len(text) else [])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Counter:
    """Counts tokens of texts."""

    def __init__(self, path: str) -> None:
        self.encoder, self.room = encoder(path), KEPT_BYTES
        self.known = dict.fromkeys(self.encoder.special, 1)

    def count(self, text: str) -> int:
        """Tokens of a text: over its distinct pre-tokens, frequency times pieces."""
        total, known = 0, self.known
        for part in self.encoder.pre_tokens(text):
            for pre_token, n in Frequencies(part).items():
                pieces = known.get(pre_token)
                if pieces is None:
                    pieces = self.encoder.pieces(pre_token)
                    size = ENTRY + 4 * len(pre_token)
                    if size <= self.room:
                        known[pre_token] = pieces
                        self.room -= size
                total += n * pieces
        return total


COUNT_COLUMNS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document under the vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = np.array([counter.count(t) for t in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], names=[x.split()[0] for x in COUNT_COLUMNS.split(", ")])

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, COUNT_COLUMNS)
