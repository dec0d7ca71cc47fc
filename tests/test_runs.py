"""Runs in parts and the streaming index, against the plan made at once."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.plans import ladder, resume
from colophon.queries.shelves import ONE, blocks, records
from colophon.streaming.index import CHANGES, decisions, index, keep_index

ROW = "id bigint, title string, author string, year int, publisher string, fmt string, digest string"


def library(spark, n=60, seed=1, digests=True):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["tides", "canvas", "quarry"]), rng.choice(["Eva Holm", "Tove Lind"]), rng.choice([1990, 1991, None]), rng.choice(["Osprey", "Kestrel", None]), rng.choice(["EPUB", "PDF"]), f"d{i // 2}" if digests else None) for i in range(n)]
    df = spark.createDataFrame(rows, ROW)
    return records(df, lib=F.lit("p"), side=F.lit("source"), id=F.col("id"), title=F.col("title"), authors=F.array("author"), year=F.col("year"), publisher=F.col("publisher"), formats=F.array("fmt"), digest=F.col("digest"))


def rows(plan):
    return sorted(map(str, plan.select("id", "action", "match", "why", "notes", "selected").collect()))


@pytest.fixture(scope="module")
def whole(spark):
    return rows(ladder.plan(library(spark), ONE))


def test_a_stopped_run_is_a_prefix_and_goes_on_to_the_whole(spark, tmp_path, whole):
    folder = f"file://{tmp_path}/run"
    resume.start(library(spark), folder, ONE, 4)
    assert resume.go_on(spark, folder, at_most=0) == 4 and rows(resume.result(spark, folder)[0]) == []
    sizes = []
    for left in (3, 2):
        assert resume.go_on(spark, folder, at_most=1) == left
        plan, complete = resume.result(spark, folder)
        part = rows(plan)
        assert not complete and set(part) < set(whole)
        sizes.append(len(part))
    assert sizes == sorted(set(sizes)) and all(8 <= b - a <= 22 for a, b in zip([0, *sizes], sizes, strict=False))
    assert resume.go_on(spark, folder) == 0
    plan, complete = resume.result(spark, folder)
    assert complete and rows(plan) == whole
    entries = resume.manifest(spark, folder).orderBy("range").collect()
    assert [r.range for r in entries] == [0, 1, 2, 3] and all(r.pairs >= r.decided for r in entries)
    assert resume.go_on(spark, folder) == 0


def test_a_range_that_broke_off_is_decided_again(spark, tmp_path, whole):
    folder = f"file://{tmp_path}/run"
    resume.start(library(spark), folder, ONE, 3)
    resume.go_on(spark, folder, at_most=1)
    # the next range left files, but no entry in the manifest
    spark.createDataFrame([("p", 1, "trash", 3, "junk", [], "", False)], resume._MADE).write.parquet(f"{folder}/decided/range=1")
    first = rows(resume.result(spark, folder)[0])
    assert set(first) < set(whole)
    resume.go_on(spark, folder)
    assert rows(resume.result(spark, folder)[0]) == whole


def test_a_run_of_many_copies_pairs_classes(spark, tmp_path, monkeypatch):
    """Ranges see earlier decisions by the classes of records; only files pair records."""
    books = library(spark, 40)
    want = rows(ladder.plan(books, ONE))
    monkeypatch.setattr(ladder, "COPIES", 0)
    folder = f"file://{tmp_path}/run"
    resume.start(books, folder, ONE, 3)
    assert spark.read.parquet(f"{folder}/pairs").filter("rung > 0").count() == 0
    assert resume.go_on(spark, folder, at_most=2) == 1
    part, complete = resume.result(spark, folder)
    assert not complete and 20 < len(rows(part)) < 34 and set(rows(part)) < set(want)
    resume.go_on(spark, folder)
    assert rows(resume.result(spark, folder)[0]) == want


def test_cuts(spark, tmp_path):
    feats, _ = ladder.prepared(library(spark, 200), ONE)
    cuts = resume.even_cuts(feats, 5)
    assert len(cuts) == 4 and cuts == sorted(cuts)
    n = feats.groupBy(resume._range(F.col("ord"), cuts).alias("r")).count().collect()
    assert all(25 <= r["count"] <= 60 for r in n) and len(n) == 5
    assert resume.even_cuts(feats, 1) == [] and resume.even_cuts(feats.limit(0), 3) == []
    empty = f"file://{tmp_path}/none"
    resume.start(library(spark).limit(0), empty, ONE, 3)
    assert resume.go_on(spark, empty) == 0 and resume.result(spark, empty)[0].count() == 0


def test_the_index_decides_as_the_plan_does(spark, tmp_path):
    """Batches of records that come, change and go, in any order; after each the decisions are those of a plan of what is there."""
    rng = random.Random(7)
    books = {s: library(spark, 40, seed=s, digests=False) for s in (3, 4)}
    forms = {s: [tuple(r) for r in blocks(df).collect()] for s, df in books.items()}
    log, folder, checkpoint = [], f"{tmp_path}/log", f"{tmp_path}/checkpoint"
    for n in range(4):
        batch = []
        for i in rng.sample(range(40), 18):
            lib, block, _, rank, poor, year, publisher = next(f for f in forms[rng.choice([3, 4])] if f[2] == i)
            batch.append((lib, "b" + str(i % 3), i, rank, poor, year, publisher, 10 * n + rng.randint(0, 3), rng.random() < 0.25))
        batch.append((*batch[0][:7], batch[0][7] - 100, not batch[0][8]))  # an older form that comes late
        batch.append(("p", "b0", None, 0, 0, None, None, 1, False))
        log += batch
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keep_index(spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in"), folder, checkpoint).awaitTermination()
        last = {}
        for r in log:
            if r[2] is not None and (r[2] not in last or r[7] >= last[r[2]][7]):
                last[r[2]] = r
        there = [r for r in last.values() if not r[8]]
        want = []
        for r in sorted(there, key=lambda r: (r[3], r[4], r[2])):
            place = (r[3], r[4], r[2])
            better = sorted((x for x in there if x[1] == r[1] and (x[3], x[4], x[2]) < place), key=lambda x: (x[3], x[4], x[2]))
            live = [x for x in better if not any(w[0] == x[2] and w[1] == "trash" for w in want)]
            copies = [x for x in live if None not in r[5:7] and x[5:7] == r[5:7]]
            unlike = lambda x, r=r: any(None not in (a, b) and a != b for a, b in zip(x[5:7], r[5:7], strict=True))
            if copies:
                want.append((r[2], "trash", copies[0][2], "year+publisher"))
            else:
                want.append((r[2], "leave", live[0][2] if live else None, "to check" if any(not unlike(x) for x in live) else "different" if live else "nothing like it"))
        records_now = spark.createDataFrame([r[:7] for r in there], "lib string, block string, id bigint, rank int, poor int, year int, publisher string")
        got = decisions(records_now, index(spark, folder)).select("id", "action", "match", "why").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_many_copies_change_one_class(spark, tmp_path):
    """A better copy of a thousand gives one row, not a thousand."""
    first = [("p", "b", i, 3, -2, 1990, "Osprey", 1, False) for i in range(1000)]
    for n, batch in enumerate([first, [("p", "b", 5000, 0, -2, 1990, "Osprey", 1, False)]]):
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keep_index(spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/log/batch={n}").count() == 1
    assert index(spark, f"{tmp_path}/log").first().id == 5000
