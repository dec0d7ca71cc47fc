"""Working with a plan: facets, search, overrides, dependencies, saved choices, staleness.

A plan row has lib, id, action, match, match_side, add (formats to merge, comma separated or empty),
selected, status, review (reasons to look) and flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions import text
from colophon.operators.tables import forget, written


def action_key() -> Column:
    """PF19: merge, trash, move, leave, or leave_unique where nothing like it was found."""
    merges = (F.col("action") == "trash") & (F.coalesce("add", F.lit("")) != "")
    return F.when(merges, "merge").when((F.col("action") == "leave") & F.col("match").isNull(), "leave_unique").otherwise(F.col("action"))


def kinds(flags: list[str]) -> Column:
    """PF20: names of the boolean columns that hold; ``other`` when none does."""
    held = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags)))
    return F.when(F.size(held) > 0, held).otherwise(F.array(F.lit("other")))


def status_keys() -> Column:
    """PF21."""
    return F.array_compact(F.array(F.when(F.col("selected"), "checked").otherwise("unchecked"), F.when(F.coalesce("status", F.lit("")) != "", F.col("status")), F.when(F.coalesce("review", F.lit("")) != "", F.lit("review"))))


def accept(df: DataFrame, facets: dict[str, list[str]], search: str, shown: list[str]) -> DataFrame:
    """PF22: any value within a facet, all facets, every search word in the folded text of the shown columns."""
    for column, wanted in facets.items():
        if wanted:
            have = F.col(column) if dict(df.dtypes)[column].startswith("array") else F.array(column)
            df = df.filter(F.arrays_overlap(have, text.strings(wanted)))
    hay = text.casefold(text.strip_accents(F.concat_ws(" ", *(F.col(c).cast("string") for c in shown))))
    for word in search.split():
        df = df.filter(F.contains(hay, text.casefold(text.strip_accents(F.lit(word)))))
    return df


def facet_counts(df: DataFrame, column: str) -> DataFrame:
    """PF23."""
    return df.select(F.explode(column).alias("key")).groupBy("key").count()


def blocked(plan: DataFrame) -> DataFrame:
    """SL4, JN16: rows that rest on a kept copy which is itself going, or on a move that isn't made."""
    it = plan.filter("action = 'trash' and match_side = 'source'").alias("i")
    on = plan.alias("m")
    joined = it.join(on, (F.col("i.lib") == F.col("m.lib")) & (F.col("i.match") == F.col("m.id")))
    going = (F.col("m.action") == "trash") & F.col("m.selected")
    unmoved = (F.col("m.planned") == "move") & ((F.col("m.action") != "move") | ~F.col("m.selected"))
    return joined.filter(going | unmoved).select(F.col("i.lib").alias("lib"), F.col("i.id").alias("id"), F.when(going, "kept copy goes").otherwise("copy isn't moved").alias("why"))


def redecide(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """DL17: the chosen ids and, transitively, all rows resting on them.

    Each round follows one link from what the last one found, and ends with the first that finds nothing new, so rows that rest on
    each other end it too.
    """
    rests = written(plan.filter("match_side = 'source' and match is not null").select("lib", "id", "match").distinct(), "rests")
    reached = fresh = written(chosen.select("lib", "id").distinct(), "reached")
    while fresh.limit(1).count():
        found = rests.join(fresh.withColumnRenamed("id", "match"), ["lib", "match"]).select("lib", "id").distinct()
        step = written(found.join(reached, ["lib", "id"], "left_anti"), "fresh")
        both = written(reached.union(step), "reached")
        forget(reached)
        if fresh is not reached:
            forget(fresh)
        reached, fresh = both, step
    forget(rests)
    return reached


def apply_choices(plan: DataFrame, saved: DataFrame) -> DataFrame:
    """JN18, SL1: saved actions and ticks put over the planned ones; moves within one library are ignored."""
    s = saved.select("lib", F.col("id").alias("_id"), F.col("action").alias("_action"), F.col("selected").alias("_selected"))
    joined = plan.join(s, (plan.lib == s.lib) & (plan.id == s._id), "left").select(plan["*"], "_action", "_selected")
    manual = F.col("_action").isNotNull() & (F.col("_action") != F.col("action"))
    return joined.withColumn("manual", manual).withColumn("selected", F.coalesce("_selected", F.when(manual, F.col("_action") != "leave"), F.col("selected"))).withColumn("action", F.coalesce("_action", "action")).drop("_action", "_selected")


def changed_choices(plan: DataFrame, planned: DataFrame) -> DataFrame:
    """SL3, SL7: rows whose action or tick differs from what was planned."""
    p = planned.select("lib", "id", F.col("action").alias("_a"), F.col("selected").alias("_s"))
    return plan.join(p, ["lib", "id"]).filter("action <> _a or selected <> _s").select("lib", "id", "action", "selected")


def library_state(books: DataFrame) -> DataFrame:
    """AG13: rows and an order-free hash of (id, version), one row for each library."""
    return books.groupBy("lib").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", "version")).alias("state"))


def stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """SL9: libraries whose state changed since, and how."""
    b, n = before.select("lib", F.col("n").alias("n0"), F.col("state").alias("s0")), now.select("lib", F.col("n").alias("n1"), F.col("state").alias("s1"))
    joined = b.join(n, "lib", "full_outer")
    why = F.when(F.col("n0").isNull(), "new").when(F.col("n1").isNull(), "gone").when(F.col("n0") != F.col("n1"), "rows added or removed").when(F.col("s0") != F.col("s1"), "rows changed")
    return joined.select("lib", why.alias("why")).filter("why is not null")


def fact_delta(books: DataFrame, facts: DataFrame) -> DataFrame:
    """JN17: records without a fact of their present version."""
    return books.join(facts.select("lib", "id", "version"), ["lib", "id", "version"], "left_anti")


def reverted(plan: DataFrame) -> DataFrame:
    """SL2: every row as it was planned."""
    return plan.withColumn("action", F.col("planned")).withColumn("selected", F.col("planned_selected")).withColumn("manual", F.lit(False)).withColumn("reviewed", F.lit(False))


def is_changed() -> Column:
    """SL3: does the row differ from what was planned, or was it looked at?"""
    return F.coalesce("manual", F.lit(False)) | ~F.col("selected").eqNullSafe(F.col("planned_selected")) | F.coalesce("reviewed", F.lit(False))


def needs_review() -> Column:
    """SL3: the plan asks for a look, and nobody has decided."""
    return (F.coalesce("review", F.lit("")) != "") & ~is_changed()


def mark_reviewed(plan: DataFrame) -> DataFrame:
    """SL3: rows that need review are looked at and kept as planned."""
    return plan.withColumn("reviewed", F.coalesce("reviewed", F.lit(False)) | needs_review())


def actionable(plan: DataFrame) -> DataFrame:
    """SL5: the ticked rows that aren't done and do something: their action, unless they are blocked, or their cleanup."""
    stuck = blocked(plan).select("lib", "id").distinct().withColumn("_stuck", F.lit(True))
    runs = (F.col("action") != "leave") & F.col("_stuck").isNull()
    todo = F.col("selected") & (F.coalesce("status", F.lit("")) != "done") & (runs | F.coalesce("cleanup", F.lit(False)))
    return plan.join(stuck, ["lib", "id"], "left").filter(todo).withColumn("runs", runs).drop("_stuck")


def checkable() -> Column:
    """SL5: may the row be ticked?"""
    return (F.col("action") != "leave") | F.coalesce("cleanup", F.lit(False))


def pair_key(source: Column, target: Column, tags: Column, exclude: Column) -> Column:
    """SL6: what remembered choices are kept under: the folded paths, and the sorted tags of the filter."""
    listed = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(tags, F.lit(""))), ","), lambda t: F.btrim(t)), lambda t: t != ""))
    suffix = F.when(F.size(listed) > 0, F.concat(F.when(exclude, " #not-tag:").otherwise(" #tag:"), F.array_join(F.sort_array(listed), ","))).otherwise("")
    return F.concat(F.lower(source), F.lit(" -> "), F.lower(target), suffix)


def saved_choices(old: DataFrame, plan: DataFrame) -> DataFrame:
    """SL7: what is remembered: rows that differ from what was planned, and older choices of records that this plan doesn't hold."""
    fresh = plan.filter(is_changed()).select("lib", "id", "action", "selected")
    return old.select("lib", "id", "action", "selected").join(plan.select("lib", "id"), ["lib", "id"], "left_anti").union(fresh)


def settings_changed(then: dict, now: dict) -> list[str]:
    """SL10: names of the settings whose values differ, sorted; a setting that only one side has differs."""
    missing = object()
    return sorted(k for k in {*then, *now} if then.get(k, missing) != now.get(k, missing))


def remaining(plan: DataFrame) -> DataFrame:
    """SL12: the rows that aren't done."""
    return plan.filter("coalesce(status, '') <> 'done'")


def after_run(plan: DataFrame, results: DataFrame) -> DataFrame:
    """SL11: the plan after a run; ``results(lib, id, ok, moved_to)``: done rows are marked, and matches of moved records follow them to the target."""
    own = results.filter("ok").select("lib", "id", F.lit(True).alias("_ok"))
    moved = results.filter("ok and moved_to is not null").select("lib", F.col("id").alias("match"), F.lit("source").alias("match_side"), "moved_to")
    df = plan.join(own, ["lib", "id"], "left").withColumn("status", F.when(F.col("_ok"), "done").otherwise(F.col("status"))).drop("_ok")
    df = df.join(moved, ["lib", "match", "match_side"], "left")
    follows = F.col("moved_to").isNotNull()
    return df.withColumn("match", F.when(follows, F.col("moved_to")).otherwise(F.col("match"))).withColumn("match_side", F.when(follows, "target").otherwise(F.col("match_side"))).drop("moved_to").select(*plan.columns)


def judged(plan: DataFrame, judgements: DataFrame) -> DataFrame:
    """SL8: rows with a judgement (lib, id, verdict, confidence): a duplicate goes, a different book moves (or stays in one library), an unsure one stays; all to be looked at."""
    j = judgements.select("lib", "id", "verdict", "confidence")
    action = F.when(F.col("verdict") == "duplicate", "trash").when(F.col("verdict") == "different", F.when(F.col("match_side") == "source", "leave").otherwise("move")).when(F.col("verdict") == "unsure", "leave").otherwise(F.col("action"))
    review = F.when(F.col("verdict").isNotNull(), F.concat(F.lit("judged "), "verdict", F.lit(" ("), F.floor("confidence").cast("string"), F.lit("%)"))).otherwise(F.col("review"))
    out = plan.join(j, ["lib", "id"], "left").withColumn("review", review).withColumn("selected", F.col("selected") & F.col("verdict").isNull()).withColumn("action", action)
    return out.select(*plan.columns)
