import random

import numpy as np
import pytest

from colophon.llm import simhash
from colophon.operators.components import components
from tests.llm.cases import docs, empty, rows


def groups_by_hand(prints, bits=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("shared", [5, 6, 7, 8])
@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_any_shared_positions_hold_a_group(shared, size):
    from itertools import combinations

    if size > shared:
        return
    groups = [set(g) for g in simhash.position_groups(shared, size)]
    assert all(any(g <= set(s) for g in groups) for s in combinations(range(8), shared))


@pytest.mark.parametrize("size", [2, 3, 4])
def test_links_equal_all_pairs(spark, size):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for k in range(1, 6):
            q = p
            for bit in rng.sample(range(64), k):
                q ^= 1 << bit
            prints.add(q)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), size=size).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_classes_and_edge_cases(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    assert len(got) == len(rows())
    zero = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert {r.doc_id for r in got if r.fingerprint == "0" * 16} == {2, 3, 4} and zero == {2}
    prints = {int(r.fingerprint, 16) for r in got}
    by_hand = groups_by_hand(prints)
    lowest = {}
    for r in got:
        if r.doc_id is not None:
            g = by_hand[int(r.fingerprint, 16)]
            lowest[g] = min(lowest.get(g, r.doc_id), r.doc_id)
    assert all(r.component_id == lowest[by_hand[int(r.fingerprint, 16)]] for r in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_keep_one_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three", "x", "y", "z"), (2, "one two three", "u", "v", "w")], "doc_id bigint, text string, `a.b` string, row string, own string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "one two three", "x", "y", "z")]


def test_keep_one(spark):
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert 3 not in ids and 4 not in ids and 2 in ids and ids.count(1) == 2 and None in ids


def test_fingerprint_by_hand():
    import xxhash

    text = "A b C d"
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d")]
    bits = [sum(h >> i & 1 for h in hashes) for i in range(64)]
    assert simhash.fingerprint(text) == sum(1 << i for i, n in enumerate(bits) if 2 * n > 2)
    assert simhash.fingerprint("É x") == xxhash.xxh64_intdigest("É x".encode(), 42)


def test_stays_and_goes_by_an_exchange_of_the_documents(spark, monkeypatch):
    from colophon.operators import tables

    monkeypatch.setattr(tables, "EXCHANGED_BYTES", 0)
    # the pipeline keeps one of each group by this join
    found = simhash.near_duplicates(docs(spark))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_postings_are_exchanged_however_small_the_fingerprints_look(spark):
    found = simhash.links(spark.range(50).selectExpr("id * 7919 fp"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
