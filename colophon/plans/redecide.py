"""Deciding anew after facts have changed (PF27, AI10, JN11, DL17): only what the change reaches.

A plan is kept with its features, pairs and decisions. When files turn out not to open, or answers are asked again, the features tell which
records have changed; pairs are found anew for these alone. What has lost, gained or changed a pair is decided again, with all others'
decisions as they stand; records that now go, or now stay, pass the change on to those that are compared with them, and so on down
the ranks until nothing turns. That gives the plan of the changed input, and as much work as the change is wide.

Where a library has many records to a work, its plan is kept by classes (``ladder.alike``), and all that a change may reach is decided again at once: the records that
rank behind a changed one in the classes that meet its own, or have its file, and those behind these. All others' decisions stand.

Features are compared by a hash, as library-wide facts (placeholder ISBNs, swapped names) may change those of other records too; placeholder files
and covers are compared as sets. One number a step reaches the driver.

Cases: records may be added or taken away; a change that turns nothing costs one step; an unchanged input costs none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators.groups import placeholders
from colophon.operators.tables import exchanged, forget, written
from colophon.plans import ladder
from colophon.plans.rounds import DECIDED, decided, decided_alike


@dataclass
class Kept:
    """A plan with what it rests on; ``redone`` counts the decisions that it took."""

    options: ladder.Options
    feats: DataFrame
    pairs: DataFrame
    made: DataFrame
    redone: int = 0
    classes: DataFrame | None = None
    members: DataFrame | None = None

    def plan(self) -> DataFrame:
        return ladder.finished(self.feats, self.made, self.options)


def keep(books: DataFrame, options: ladder.Options, **facts: DataFrame) -> Kept:
    """A plan of ``books``, decided as a whole."""
    feats, pairs, classes, members = ladder.compared(books, options, **facts)
    unmatched = ladder.unmatched(options)
    made = written(decided(pairs, unmatched) if classes is None else decided_alike(pairs, classes, members, unmatched), "made")
    return Kept(options, feats, pairs, made, made.count(), classes, members)


def _junk(feats: DataFrame) -> DataFrame:
    """(lib, id) and the placeholders that a record has: files (of any library) and covers."""
    usable = feats.filter(ladder.USABLE)
    files = placeholders(ladder._files(usable), "fmt", "digest").select("digest", F.lit(True).alias("junk_file"))
    covers = placeholders(usable.filter("cover is not null").withColumn("akey", F.array_join("authors_key", "|")), "lib", "cover", author="akey").select("lib", "cover", F.lit(True).alias("junk_cover"))
    return usable.select("lib", "id", "digest", "cover").join(files, "digest", "left").join(covers, ["lib", "cover"], "left").filter("junk_file or junk_cover").select("lib", "id", F.struct("junk_file", "junk_cover").alias("junk"))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(lib, id) of the records whose features, or placeholders, aren't the same; added and missing ones too."""
    columns = sorted(set(new.columns) - {"lib", "id"})

    def marked(feats: DataFrame, name: str) -> DataFrame:
        return feats.select("lib", "id", F.xxhash64(F.to_json(F.struct(*columns))).alias("h")).join(_junk(feats), ["lib", "id"], "left").select("lib", "id", F.struct("h", "junk").alias(name))

    both = marked(old, "x").join(marked(new, "y"), ["lib", "id"], "full")
    return both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("lib", "id")


def again(kept: Kept, books: DataFrame, texts: DataFrame | None = None, covers: DataFrame | None = None, answers: DataFrame | None = None, authors: DataFrame | None = None) -> Kept:
    """The plan of changed ``books`` or answers, from the one that is kept."""
    options = kept.options
    feats = ladder.described(books, options, answers)
    changed = written(differing(kept.feats, feats), "changed")
    if not changed.limit(1).count():
        return Kept(options, kept.feats, kept.pairs, kept.made, 0, kept.classes, kept.members)
    if kept.classes is not None:
        return _again_alike(kept, feats, changed, ladder.alike(feats.filter(ladder.USABLE), options, texts, covers, authors))
    key = ["lib", "id"]
    other = changed.withColumnRenamed("id", "cand")
    touching = kept.pairs.join(changed, key, "left_semi").union(kept.pairs.join(changed, key, "left_anti").join(other, ["lib", "cand"], "left_semi").select(*kept.pairs.columns))
    fresh = written(ladder.edges(feats.filter(ladder.USABLE), options, texts, covers, changed, authors), "fresh")
    stay = kept.pairs.join(changed, key, "left_anti").join(other, ["lib", "cand"], "left_anti")
    pairs = written(stay.select(*kept.pairs.columns).unionByName(fresh), "edges")
    # what a pair of a changed record stood or stands with
    dirty = written(changed.union(touching.select(*key)).union(fresh.select(*key)).distinct(), "dirty")
    made, redone = kept.made, 0
    while dirty.limit(1).count():
        before = made.join(dirty, key, "left_anti")
        todo = pairs.join(dirty, key, "left_semi")
        new = written(decided(todo, ladder.unmatched(options), before), "again") if todo.limit(1).count() else made.limit(0)
        redone += new.count()
        stays = lambda df, name: df.select(*key, (F.col("action") == "trash").alias(name))
        turned = dirty.join(stays(made, "was"), key, "left").join(stays(new, "now"), key, "left").filter(F.coalesce("was", F.lit(False)) != F.coalesce("now", F.lit(False)))
        turned = written(turned.select("lib", F.col("id").alias("cand")), "turned")
        made = written(before.select(*DECIDED).union(new.select(*DECIDED)), "made")
        dirty = written(pairs.join(turned, ["lib", "cand"], "left_semi").select(*key).distinct().join(dirty, key, "left_anti"), "dirty")
    return Kept(options, feats, pairs, made, redone)


def _behind(first: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(lib, id) of the records that rank behind one of ``first(lib, class, ord)`` in the classes that meet its class; behind those that have no rank all do."""
    least = first.groupBy("lib", F.col("class").alias("cand")).agg(F.min("ord").alias("ord"))
    ord_ = F.when(F.col("ranked"), F.col("ord")).otherwise(F.array(F.lit(-1).cast("bigint")))
    each = exchanged(classes.select("lib", "id", "cand", "ranked")).join(least, ["lib", "cand"]).groupBy("lib", F.col("id").alias("class")).agg(F.min(ord_).alias("from"))
    return exchanged(members.filter("own")).join(each, ["lib", "class"]).filter("ord > from").select("lib", "id")


def _reached(kept: Kept, changed: DataFrame, pairs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(lib, id) of the records whose decisions ``changed`` records may turn, and these."""
    key = ["lib", "id"]
    having = lambda df, of: exchanged(df.select("lib", "id", "cand")).join(of.withColumnRenamed("id", "cand"), ["lib", "cand"], "left_semi").select(*key)
    old = exchanged(kept.members).join(changed, key, "left_semi")
    found = changed.union(_behind(old, kept.classes, kept.members)).union(having(kept.pairs, changed))
    found, n = written(found.distinct(), "reached"), 0
    while (more := found.count()) > n:
        n, last = more, found
        now = exchanged(members).join(last, key, "left_semi")
        found = written(last.union(_behind(now, classes, members)).union(having(pairs, last)).distinct(), "reached")
        forget(last)
    return found


def _again_alike(kept: Kept, feats: DataFrame, changed: DataFrame, alike: tuple[DataFrame, DataFrame, DataFrame]) -> Kept:
    pairs, classes, members = alike
    key, unmatched = ["lib", "id"], ladder.unmatched(kept.options)
    reached = _reached(kept, changed, pairs, classes, members)
    before = written(exchanged(kept.made).join(reached, key, "left_anti").select(*DECIDED), "before")
    gone = before.filter("action = 'trash'").select(*key)
    there = exchanged(members).join(gone, key, "left_anti").join(reached.withColumn("_again", F.lit(True)), key, "left")
    there = there.withColumn("own", F.col("own") & F.coalesce("_again", F.lit(False))).drop("_again")
    todo = exchanged(pairs).join(reached, key, "left_semi").join(gone.withColumnRenamed("id", "cand"), ["lib", "cand"], "left_anti").select(*pairs.columns)
    new = written(decided_alike(todo, classes, there, unmatched), "again")
    made = written(before.union(new), "made")
    return Kept(kept.options, feats, pairs, made, new.count(), classes, members)
