import math
from collections import Counter

import pytest

from colophon.llm import mixing
from tests.llm.cases import docs, empty


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2, "c": 0.05, "d": 0.05}, {i: 1 + i % 7 for i in range(50)}])
def test_deviation_is_below_one_block(weights):
    slots = mixing.quantized(weights)
    assert sum(slots.values()) == mixing.FRAME and all(abs(slots[k] - w / sum(weights.values()) * mixing.FRAME) <= len(weights) for k, w in weights.items())
    given = Counter()
    for t, k in enumerate(mixing.pfair(slots), 1):
        given[k] += 1
        assert all(abs(given[x] - t * n / mixing.FRAME) < 1 for x, n in slots.items())


def test_blocks_meet_releases_and_deadlines():
    slots = mixing.quantized({"a": 5, "b": 3, "c": 1})
    seen = Counter()
    for t, k in enumerate(mixing.pfair(slots)):
        seen[k] += 1
        i, w = seen[k], slots[k] / mixing.FRAME
        assert math.floor((i - 1) / w + 1e-9) <= t < math.ceil(i / w - 1e-9)


def test_schedule_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 7)
    table = [(i, "x", "abc"[min(i % 5, 2)]) for i in range(400)]
    weights = {"a": 2, "b": 1, "c": 3}
    got = mixing.schedule(docs(spark, table), weights, block=4).collect()
    assert len(got) == 400
    slots = mixing.quantized(weights)
    frame = mixing.pfair(slots)
    seen, slot_of = Counter(), {}
    for t in range(10 * mixing.FRAME):
        k = frame[t % mixing.FRAME]
        slot_of[k, seen[k]] = t
        seen[k] += 1
    sizes = Counter(s for _, _, s in table)
    end = min(slot_of[k, sizes[k] // 4] for k in weights)
    for r in got:
        assert r.slot == slot_of[r.source, r.block] and r.scheduled == (r.slot < end)
    blocks = Counter((r.source, r.block) for r in got)
    assert all(n <= 4 for n in blocks.values())
    served = Counter(r.source for r in got if r.scheduled)
    assert all(abs(served[k] / 4 - end * n / mixing.FRAME) < 1 for k, n in slots.items())


def test_edge_cases(spark):
    got = mixing.schedule(docs(spark), block=1).collect()
    assert len(got) == 12 and {r.source for r in got} == {"s", None}
    mixed = mixing.mix(docs(spark), block=1)
    assert mixed.columns == docs(spark).columns
    assert all(not r.scheduled for r in mixing.schedule(docs(spark), {"s": 0}).collect())
    assert mixing.schedule(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_no_document_is_lost(spark):
    sizes = {"hot": 3000, "tiny": 1, "small": 13, None: 3}
    table = [(i, "x", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.schedule(docs(spark, table)).collect()
    assert len(got) == len(table) and all(r.scheduled and r.slot is not None for r in got)
    blocks = Counter(r.slot for r in got)
    assert max(blocks.values()) <= mixing.BLOCK and len(blocks) == sum(-(-n // mixing.BLOCK) for n in sizes.values())
    slot = {r.doc_id: r.slot for r in got}
    mixed = [r.doc_id for r in mixing.mix(docs(spark, table)).collect()]
    assert mixed == sorted(slot, key=lambda i: (slot[i], i)) and len(mixed) == len(table)
    given = mixing.mix(docs(spark, table), {"hot": 1, "tiny": 5, None: 2})
    assert sorted(r.doc_id for r in given.collect()) == [i for i, _, s in table if s != "small"]


def test_more_sources_than_slots_in_a_frame(spark):
    table = [(i, "x", f"s{i % 1500}") for i in range(3000)]
    got = mixing.schedule(docs(spark, table)).collect()
    assert len(got) == 3000 and all(r.scheduled for r in got)
    assert len({r.slot for r in got}) == 1500


def test_clashing_columns(spark):
    df = spark.createDataFrame([(2, "x", "s", "a", "b", "c", "d"), (1, "y", "t", "e", "f", "g", "h")], "doc_id bigint, text string, source string, slot string, _id string, id string, row string")
    out = mixing.mix(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in df.collect())


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 40)
    table = [(i, "x", "a") for i in range(500)] + [(None, "y", "b")] * 250 + [(7, "y", "b")] * 250
    mixed = [r.source for r in mixing.mix(docs(spark, table)).collect()]
    assert len(mixed) == 1000
    for n in range(1, 1001):
        assert abs(mixed[:n].count("b") - n / 2) <= 2 * mixing.BLOCK
    keyed = mixing._keyed(docs(spark, table).coalesce(1))
    sizes = mixing.places(keyed).groupBy("source").agg({"place": "max"}).collect()
    assert {r[0]: r[1] for r in sizes} == {"a": 499, "b": 499}


def test_clashing_names_with_dots(spark):
    df = spark.createDataFrame([(2, "x", "s", 1, 2), (None, None, None, 3, 4)], "doc_id bigint, text string, source string, `a.b` int, `key` int")
    out = mixing.mix(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
