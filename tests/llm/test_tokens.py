import random

import pytest
from tokenizers import Tokenizer

from colophon.llm.queries import vocabulary
from colophon.llm.tokens import Counter, count_tokens, encoder


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def odd_texts():
    rng = random.Random(7)
    marks = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\x1c", "\x1f", "\x85", "᠎", "​", " ", "　", "'s", "'LL", "a", "Ω", "é", "12", "²", "!", "&&&", "<|endoftext|>", "<|end", "😀", "é", "word", "\x00"]
    return ["", " ", "  ", "   ", " a", "a ", "a  b", "a   b", "a \n b", "\n\n x", "x" * 5000] + ["".join(rng.choices(marks, k=rng.randint(1, 14))) for _ in range(1500)] + [a + c + b for c in map(chr, [*range(0x20), *range(0x7F, 0xB0), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]) for a in ("", "x", " ", "! ") for b in ("", "y", " ", " ?", c)]


def test_ids_equal_the_library(library):
    ours = encoder(vocabulary())
    for text in odd_texts():
        assert ours.ids(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_runs_of_blanks(library, monkeypatch):
    from colophon.llm import tokens

    ours = encoder(vocabulary())
    for run in (" " * 1_200_000, "\t" * 1_200_000, " \n" * 600_000):
        for text in (run, run + "a", "a" + run, "a" + run + "b" + run + "<|endoftext|>" + run + "c"):
            assert ours.ids(text) == library.encode(text, add_special_tokens=False).ids
            assert Counter(vocabulary()).count(text) == len(ours.ids(text))
    monkeypatch.setattr(tokens, "LONG_RUN", 3)
    monkeypatch.setattr(tokens, "_RUN", tokens.regex.compile(f"[{tokens._WHITE}]{{3,}}"))
    for text in odd_texts():
        assert ours.ids(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_equal_the_library(library):
    texts = odd_texts()
    counter = Counter(vocabulary())
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [counter.count(t) for t in texts] == expected
    assert [counter.count(t) for t in texts] == expected


def test_pre_tokens_are_the_texts_pieces(monkeypatch):
    from colophon.llm import tokens

    ours, texts = encoder(vocabulary()), [*odd_texts(), "  indented\n    code()\n" * 40]
    assert all("".join(x for part in ours.pre_tokens(t) for x in part) == t for t in texts)
    whole = [[x for part in ours.pre_tokens(t) for x in part] for t in texts]
    monkeypatch.setattr(tokens, "STEP", 7)
    assert [[x for part in ours.pre_tokens(t) for x in part] for t in texts] == whole


def test_kept_counts_are_bounded_in_bytes(library, monkeypatch):
    from colophon.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_BYTES", 2_000)
    counter = Counter(vocabulary())
    texts = ["x" * 1_000 + f" word{i}  y" for i in range(100)]
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.room >= 0 and len(counter.known) < 20


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "two words", "x"), (1, "two words", "x"), (2, None, None), (None, "", "y")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), vocabulary(), 1).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 9, 2, True), (1, 9, 2, True), (2, 0, 0, False), (None, 0, 0, False)], key=str)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0
