import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from colophon.llm import packing
from colophon.llm.queries import vocabulary
from tests.llm.cases import docs, empty, rows


def test_groupings_are_whole_and_near_the_bound():
    rng = random.Random(1)
    for low, high in ((1, 1023), (1, 300), (300, 700)):
        sizes = [rng.randint(low, high) for _ in range(600)]
        bins = packing.evolve(sizes, packing.first_population(sizes, 1024, rng), 1024, 30, rng)
        assert sorted(i for b in bins for i in b) == list(range(600))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
        assert len(bins) <= 1.02 * packing.lower_bound(np.array(sizes), 1024) + 1


def test_crossover_keeps_every_item_once():
    rng = random.Random(2)
    sizes = [rng.randint(1, 600) for _ in range(200)]
    a, b = packing.first_population(sizes, 1024, rng)[:1][0], [[i] for i in range(200)]
    child = packing.mutate(sizes, packing.crossover(sizes, a, b, 1024, rng), 1024, rng)
    assert sorted(i for x in child for i in x) == list(range(200))


def test_lower_bound_is_a_bound():
    assert packing.lower_bound(np.array([600] * 7 + [100]), 1024) == 7
    assert packing.lower_bound(np.array([512, 512, 1]), 1024) == 2


def check(got, table):
    encode = Tokenizer.from_file(vocabulary()).encode
    expected = sorted(((d, [*encode(t or "", add_special_tokens=False).ids, 2]) for d, t in table), key=str)
    pieces = defaultdict(list)
    for d, ids in expected:
        r = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(r, len(ids), 1024)]):
            part = ids[a : r if k == 0 else a + 1024]
            pieces[d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())].append(1)
    have = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(1)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == pieces
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_documents_are_packed_whole(spark):
    table = [(r[0], r[1]) for r in rows()]
    n = check(packing.pack_documents(docs(spark), vocabulary()).collect(), table)
    tokens = sum(len(Tokenizer.from_file(vocabulary()).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in table)
    assert n <= -(-tokens // 1024) + 1
    assert packing.pack_documents(empty(spark), vocabulary()).count() == 0


def test_a_long_run_of_blanks(spark):
    table = [(1, " " * 1_200_000), (2, "a" + " " * 1_200_000 + "b")]
    check(packing.pack_documents(docs(spark, [(i, t, "s") for i, t in table]), vocabulary()).collect(), table)


def test_several_cells_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 40)
    rng = random.Random(4)
    table = [(i, "word " * rng.randint(1, 900)) for i in range(200)]
    n = check(packing.pack_documents(docs(spark, [(i, t, "s") for i, t in table]), vocabulary()).collect(), table)
    total = sum(len(t) // 5 + 2 for _, t in table)
    assert n <= 1.05 * total / 1024 + 2
