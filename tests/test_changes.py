"""What differs between states, and plans decided anew, against doing all of it."""

import random

from pyspark.sql import functions as F

from colophon.plans import ladder, redecide, trees
from colophon.queries.shelves import ONE
from tests.test_runs import library, rows

STATE = "lib string, id bigint, version bigint"


def differences(old, new):
    a, b = {}, {}
    for of, into in ((old, a), (new, b)):
        for lib, i, v in of:
            if lib is not None and i is not None:
                into.setdefault((lib, i), []).append(v)
    order = lambda vs: sorted(vs, key=lambda v: (v is not None, v or 0))
    out = set()
    for k in a.keys() | b.keys():
        if order(a.get(k, [])) != order(b.get(k, [])):
            out.add((*k, "added" if k not in a else "removed" if k not in b else "changed"))
    return out


def compared(spark, tmp_path, old, new):
    for name, of in (("old", old), ("new", new)):
        trees.save(spark.createDataFrame(of, STATE), f"{tmp_path}/{name}")
    got = {tuple(r) for r in trees.changed(spark, f"{tmp_path}/old", f"{tmp_path}/new").collect()}
    return got, trees.to_read(spark, f"{tmp_path}/old", f"{tmp_path}/new")


def test_changed_records_are_those_of_a_full_join(spark, tmp_path):
    rng = random.Random(1)
    old = [(rng.choice("pq"), rng.randint(-3000, 9000), rng.choice([None, 1, 2])) for _ in range(3000)] + [(None, 1, 1), ("p", None, 1), ("r", 7, 7), ("p", 5, 1), ("p", 5, 1)]
    new = [r for r in old if rng.random() > 0.01] + [("p", 100_000, 1), ("s", 1, None)]
    new = [(lib, i, 9) if rng.random() < 0.01 else (lib, i, v) for lib, i, v in new]
    got, _ = compared(spark, tmp_path, old, new)
    assert got == differences(old, new) and {c for _, _, c in got} == {"added", "removed", "changed"}


def test_equal_states_read_no_record_and_one_change_reads_one_leaf(spark, tmp_path):
    old = [("p", i, i % 5) for i in range(20_000)]
    assert compared(spark, tmp_path / "a", old, old[::-1]) == (set(), 0)
    got, read = compared(spark, tmp_path / "b", old, [*old[:777], ("p", 777, 99), *old[778:]])
    assert got == {("p", 777, "changed")} and 0 < read <= 2 * trees.LEAF
    a, b = (trees.roots(spark, f"{tmp_path}/a/{n}").collect() for n in ("old", "new"))
    assert a == b and a[0].n == 20_000
    assert trees.roots(spark, f"{tmp_path}/b/new").collect() != a


def test_empty_states(spark, tmp_path):
    assert compared(spark, tmp_path, [], [("p", 1, 1)])[0] == {("p", 1, "added")}


def test_a_plan_decided_anew_is_the_plan_of_the_changed_input(spark):
    books = library(spark, 60)
    kept = redecide.keep(books, ONE)
    assert rows(kept.plan()) == rows(ladder.plan(books, ONE))
    changed = books.withColumn("broken", F.when(F.col("id") == 7, F.col("formats")).otherwise(F.col("broken"))).withColumn("year", F.when(F.col("id") == 12, 1975).otherwise(F.col("year"))).filter("id <> 20")
    once = redecide.again(kept, changed)
    assert rows(once.plan()) == rows(ladder.plan(changed, ONE))
    assert 0 < once.redone < kept.redone
    back = redecide.again(once, books)
    assert rows(back.plan()) == rows(kept.plan())
    same = redecide.again(kept, books)
    assert same.redone == 0 and rows(same.plan()) == rows(kept.plan())


def test_a_plan_of_classes_decided_anew_is_the_plan_of_the_changed_input(spark, monkeypatch):
    """Records fail, change and go; only files pair records, and what ranks before all changes isn't decided again."""
    books = library(spark, 40)
    changed = books.withColumn("broken", F.when(F.col("id") == 7, F.col("formats")).otherwise(F.col("broken"))).withColumn("year", F.when(F.col("id") == 12, 1975).otherwise(F.col("year"))).filter("id <> 20")
    want = rows(ladder.plan(changed, ONE))
    monkeypatch.setattr(ladder, "COPIES", 0)
    kept = redecide.keep(books, ONE)
    assert kept.pairs.filter("rung > 0").count() == 0
    once = redecide.again(kept, changed)
    assert rows(once.plan()) == want and 0 < once.redone < kept.redone
