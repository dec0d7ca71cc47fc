"""Applying a plan as a change-set: preconditions, new catalogue versions, a journal.

``books(lib, side, id, version, formats)``; ``actions(lib, id, action, match, match_side, add, stamp)``
where stamp is the version that the plan saw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions(plan: DataFrame, books: DataFrame) -> DataFrame:
    """EX1: the ticked rows that do something, with the version of the record and of its match."""
    own = books.filter("side = 'source'").select("lib", "id", F.col("version").alias("stamp"))
    theirs = books.select("lib", F.col("id").alias("match"), F.col("side").alias("match_side"), F.col("version").alias("match_stamp"))
    return plan.filter("selected and action <> 'leave'").join(own, ["lib", "id"]).join(theirs, ["lib", "match", "match_side"], "left")


def checked(todo: DataFrame, books: DataFrame) -> DataFrame:
    """EX3: ``ok`` and ``why``: the record is there in the version (to the second) that was planned, and so is its match."""
    own = books.filter("side = 'source'").select("lib", "id", F.col("version").alias("_now"))
    theirs = books.select("lib", F.col("id").alias("match"), F.col("side").alias("match_side"), F.col("version").alias("_match_now"))
    joined = todo.join(own, ["lib", "id"], "left").join(theirs, ["lib", "match", "match_side"], "left")
    second = lambda c: F.substring(c, 1, 19)
    gone, changed = F.col("_now").isNull(), second("_now") != second("stamp")
    no_match = F.col("match").isNotNull() & F.col("_match_now").isNull()
    match_changed = F.coalesce(second("_match_now") != second("match_stamp"), F.lit(False))
    why = F.when(gone, "record is gone").when(changed, "record changed").when(no_match, "match is gone").when(match_changed, "match changed")
    return joined.withColumn("why", why).withColumn("ok", F.col("why").isNull()).drop("_now", "_match_now")


def applied(books: DataFrame, done: DataFrame) -> DataFrame:
    """EX4-EX6: the catalogue after the checked actions that are ok: moves change side, trash goes to its own side, matches gain formats.

    A match that the same run moves gains its formats where it now is (EX5). With a column ``take_out`` of formats, the record loses
    them and its former self is kept as a copy on the trash side (EX6). With ``put_in`` too, archives are unpacked: the record gains what they held, unless
    it has it, and loses them in the same step.
    """
    good = done.filter("ok")
    if "take_out" in done.columns:
        none = F.array().cast("array<string>")
        gained = F.coalesce("put_in", none) if "put_in" in done.columns else none
        taken = good.filter("size(take_out) > 0").select("lib", "id", F.lit("source").alias("side"), F.col("take_out").alias("_out"), gained.alias("_in"))
        copies = books.join(taken, ["lib", "id", "side"], "left_semi").withColumn("side", F.lit("trash")).select(*books.columns)
        left = F.array_union(F.array_except("formats", F.coalesce("_out", none)), F.coalesce("_in", none))
        books = books.join(taken, ["lib", "id", "side"], "left").withColumn("formats", left).drop("_out", "_in").select(*books.columns).union(copies)
        good = good.filter("action <> 'leave'")
    gains = good.filter("action = 'trash' and add <> ''").groupBy("lib", F.col("match").alias("id"), F.col("match_side").alias("side")).agg(F.flatten(F.collect_list(F.split("add", ","))).alias("_gain"))
    now = books.join(gains, ["lib", "id", "side"], "left").withColumn("formats", F.sort_array(F.array_distinct(F.concat("formats", F.coalesce("_gain", F.array().cast("array<string>")))))).drop("_gain")
    moves = good.select("lib", "id", F.lit("source").alias("side"), F.when(F.col("action") == "move", "target").otherwise("trash").alias("_to"))
    return now.join(moves, ["lib", "id", "side"], "left").withColumn("side", F.coalesce("_to", "side")).drop("_to")


def journal(done: DataFrame) -> DataFrame:
    """SK3: a row for every applied action."""
    return done.filter("ok").select("lib", "id", F.when((F.col("action") == "trash") & (F.col("add") != ""), F.concat(F.lit("merge "), F.col("add"))).otherwise(F.col("action")).alias("done"), "match")
