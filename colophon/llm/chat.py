"""Chat formatting by columnar byte assembly.

A turn is written as ``<turn role>\\n`` content ``\\n</turn>\\n``. Inside roles and contents a backslash goes before
every ``<`` and every backslash, so that nothing in a text reads as a mark, and reading
drops it again. A batch of turns is assembled in numpy: lengths of all segments give cumulative
offsets, offsets give scatter indices, and headers and contents are copied into one preallocated
buffer that becomes an Arrow string column. The loss mask covers the content of assistant turns.

Conversations are dealt by id and sorted by turn; batches pass one after the other, so a conversation
of any length is formatted and read back in bounded memory.

Cases: null texts and roles are empty; turns with equal numbers stand in the order of role and text; a null turn stands first; a null
conv_id is one conversation; repeated rows are turns of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import slices

OPEN, HEAD_END, CLOSE = b"<turn ", b">\n", b"\n</turn>\n"
_TURN = re.compile(rb"<turn ((?:[^<\\]|\\.)*?)>\n((?:[^<\\]|\\.)*)\n</turn>\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)
LEARNED = "assistant"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "\\", "\\\\"), "<", "\\<")


def _escape_role(roles: pa.Array) -> pa.Array:
    """A role also hides the sign that ends the header."""
    return pc.replace_substring(escape(roles), ">", "\\>")


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its values, from 0."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and where in each its content begins and ends (bytes)."""
    n = len(texts)
    marks = [np.frombuffer(m, np.uint8) for m in (OPEN, HEAD_END, CLOSE)]
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for mark, column in zip(marks, (_escape_role(roles), escape(texts), None), strict=True):
        parts.append((np.tile(mark, n), np.arange(n + 1, dtype=np.int64) * len(mark)))
        if column is not None:
            parts.append(_bytes(column))
    lengths = np.stack([np.diff(offsets) for _, offsets in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (data, offsets) in enumerate(parts):
        # byte j of a segment column goes to its segment's start plus its place in the segment
        out[np.repeat(starts[:, k] - offsets[:-1], lengths[:, k]) + np.arange(len(data))] = data
    bounds = np.concatenate([[0], ends[:, -1]]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    return column, starts[:, 3] - bounds[:-1], ends[:, 3] - bounds[:-1]


def _ordered(conversations: DataFrame) -> DataFrame:
    df = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end): turns in order, one after the other within a conversation.

    Offsets are in bytes of ``formatted``; they are null where no loss is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made, a, b = assemble(batch.column(2), batch.column(3))
            off = pc.invert(pc.equal(batch.column(2), LEARNED))
            none = np.asarray(off.to_numpy(zero_copy_only=False), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made.cast(pa.string()), pa.array(a, mask=none), pa.array(b, mask=none)], names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    return _ordered(conversations).mapInArrow(run, "conv_id bigint, turn bigint, role string, formatted string, loss_start bigint, loss_end bigint")


def parse(data: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted bytes; ValueError if anything else stands there."""
    out, at = [], 0
    while at < len(data):
        m = _TURN.match(data, at)
        if m is None:
            raise ValueError(f"no turn at byte {at}")
        out.append((unescape(m[1]).decode(), unescape(m[2]).decode()))
        at = m.end()
    return out


class Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        data = formatted.encode()
        for role, text in parse(data):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(formatted)
        if start is not None:
            learned = unescape(data[start:end])
            self.loss_chars += len(learned.decode())
            self.loss.update(learned)


DIGEST_COLUMNS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation of what ``format_turns`` gave, in whose order and partitions its rows must be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, now = None, None
        done: list[tuple] = []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in DIGEST_COLUMNS.split(", ")]

        def row() -> tuple:
            return now, digest.turns, digest.all.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.chars

        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append(row())
                    digest, now = Digest(), conv
                digest.add(text, a, b)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names=names)
                done = []
        if digest is not None:
            done.append(row())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, DIGEST_COLUMNS)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of every conversation, read back from its formatted bytes."""
    return read_back(format_turns(conversations))
