"""Greedy decisions in rank order by parallel rounds (SQ1).

A record is compared with targets and with better-ranked records that stay. Taken one by one in rank order that is
sequential; here every round decides all records whose outcome is settled. A pair is open while its candidate is undecided, and
dead once the candidate goes. A record is settled if none of its pairs is open, and also if the open ones can't change its outcome:

- the first pair that isn't dead is of the same file, and its candidate stays;
- no pair of a file or series is left, and the first duplicate among the same key in the same language stays;
- no pair of a file or series is left, no pair of the same key could make a duplicate, the first candidate stays, and what stays leaves a
  doubt (or nothing could).

So copies of one text, or of one edition, take two rounds however many they are, and the number of rounds follows the longest chain of
decisions that really rest on each other. The best-ranked undecided record is always settled, so the rounds end.

Each round aggregates the pairs of undecided records by record and joins its decisions to the pairs they are candidates of; pairs and decisions are
tables in the shared folder. One number a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.operators.tables import exchanged, forget, written

#: Rungs in the order in which they decide.
FILE, SERIES, KEY, VARIANT, TITLE = range(5)

DECIDED = ["lib", "id", "action", "match", "why", "notes", "review", "override"]
_BY_COVER = "by the covers: compare them"


def outcomes(pairs: DataFrame, unmatched: str) -> DataFrame:
    """DECIDED and ``settled`` for each record of ``pairs``, which have ``dead`` and ``open``; DL2-DL12 over a record's pairs.

    Where ``settled`` is false the other columns mean nothing yet.
    """
    alive, none = ~F.col("dead"), F.lit(None)
    duplicate = F.col("verdict") == "duplicate"
    known_kind = F.col("kind").isNotNull()
    same_cover = known_kind & (F.col("cover") == "same")
    unclear = (F.col("kind") == "open") & (F.col("cover") == "unclear") & ~F.col("longer")
    # what could make a duplicate of the same key, in the order in which it is asked
    stage = F.when(duplicate, 0).when(F.col("same_text"), 1).when(same_cover, 2).when(unclear, 3)
    doubt = F.coalesce(F.col("kind").isin("open", "incomparable"), F.lit(False)) | F.coalesce((F.col("kind") == "weak") & (F.col("cover") != "different"), F.lit(False)) | (F.col("verdict") == "unknown")
    pair = F.struct("ord", "cand", "why", "open", "foreign", "weak", "proof", F.col("verdict").alias("verdict"))
    keyed = F.col("rung").isin(KEY, VARIANT)
    df = pairs.withColumn("stage", stage).withColumn("p", pair).withColumn("doubt", doubt)

    def first(when: Column) -> Column:
        return F.min(F.when(alive & when, F.col("p")))

    def any_(when: Column) -> Column:
        return F.coalesce(F.bool_or(alive & when), F.lit(False))

    # the same title key by its own authors; by variants of them only where no such pair is left
    own = df.groupBy("lib", "id").agg(*(F.min(F.when(alive & (F.col("rung") == r) & ~F.col("open"), F.lit(r))).alias(f"has{r}") for r in (KEY, VARIANT)), *(any_(F.col("rung") == r).alias(f"may{r}") for r in (KEY, VARIANT)))
    rung = own.select("lib", "id", F.when(F.col(f"may{KEY}"), F.lit(KEY)).when(F.col(f"may{VARIANT}"), F.lit(VARIANT)).alias("of"), F.when(F.col(f"may{KEY}"), F.col(f"has{KEY}").isNotNull()).when(F.col(f"may{VARIANT}"), F.col(f"has{VARIANT}").isNotNull()).alias("surely"))
    df = exchanged(df).join(rung, ["lib", "id"])
    at = keyed & F.coalesce(F.col("rung") == F.col("of"), F.lit(False))
    title = F.col("rung") == TITLE
    local = ~F.col("foreign")
    left = at & ~F.coalesce(F.col("foreign") & F.col("stage").isin(0, 2, 3), F.lit(False))
    abroad = F.struct(F.col("stage").alias("stage"), "ord", "cand", "open")
    agg = df.groupBy("lib", "id").agg(
        F.first("of").alias("of"), F.first("surely").alias("surely"),
        any_(F.col("open")).alias("waits"), any_(F.col("open") & F.col("rung").isin(FILE, SERIES)).alias("waits_early"),
        first(F.col("rung") == FILE).alias("file"),
        first((F.col("rung") == SERIES) & local).alias("series"), F.sort_array(F.collect_list(F.when(alive & (F.col("rung") == SERIES) & F.col("foreign"), F.struct(F.lit(-1).alias("stage"), "ord", "cand", "open")))).alias("abroad_series"),
        first(at).alias("first"),
        *(first(at & (F.col("stage") == k) & (local if k != 1 else F.lit(True))).alias(f"s{k}") for k in range(4)),
        F.sort_array(F.collect_list(F.when(alive & at & F.col("foreign") & F.col("stage").isin(0, 2, 3), abroad))).alias("abroad"),
        first(left).alias("rest"), any_(left & F.col("doubt")).alias("doubted"), any_(left & F.col("doubt") & ~F.col("open")).alias("surely_doubted"),
        any_(at & F.col("stage").isNotNull()).alias("promising"),
        first(title).alias("t_first"), first(title & (F.col("same_text") | (F.col("proof") & local))).alias("t_proof"),
        first(title & (F.col("cover") == "same") & (F.col("verdict") != "distinct") & local).alias("t_cover"),
        first(title & (F.col("verdict") != "distinct") & (F.col("cover") != "different") & local).alias("t_left"),
    )

    def out(action: str | Column, p: Column, why: str | Column, notes: Column, review: str | Column = "", override: Column | bool = False) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
        return F.struct(lit(action).alias("action"), p.alias("match"), lit(why).alias("why"), notes.alias("notes"), lit(review).alias("review"), lit(override).alias("override"))

    def noted(found: Column) -> Column:
        return F.transform(found, lambda x: F.concat(F.floor(x["cand"] / 2).cast("string"), F.lit(" is in another language")))

    none_noted = F.array().cast("array<string>")
    series_notes = noted(F.col("abroad_series"))

    def notes_to(k: int) -> Column:
        """Notes of the duplicates in another language that come before the ``k``-th stage's pair."""
        star = F.col(f"s{k}")
        return F.concat(series_notes, noted(F.filter("abroad", lambda x: (x["stage"] < k) | ((x["stage"] == k) & (x["ord"] < star["ord"])))))

    def person(k: int, review: str = "") -> Column:
        p = F.col(f"s{k}")
        weak = F.when(p["weak"] & ~p["proof"], F.lit("authors matched by the surname only"))
        return F.concat_ws("; ", F.nullif(F.lit(review), F.lit("")), weak)

    overruled = lambda p: F.col(p)["verdict"] == "distinct"
    all_notes = F.concat(series_notes, noted(F.col("abroad")))
    by_key = (
        F.when(F.col("s0").isNotNull(), out("trash", F.col("s0.cand"), F.col("s0.why"), notes_to(0), person(0)))
        .when(F.col("s1").isNotNull(), out("trash", F.col("s1.cand"), "same text", F.concat(series_notes, noted(F.filter("abroad", lambda x: x["stage"] < 1))), override=overruled("s1")))
        .when(F.col("s2").isNotNull(), out("trash", F.col("s2.cand"), "same cover", notes_to(2), person(2, _BY_COVER), overruled("s2")))
        .when(F.col("s3").isNotNull(), out("trash", F.col("s3.cand"), "nothing tells them apart", notes_to(3), person(3, "no edition: compare them")))
        .when(F.col("doubted"), out("leave", F.col("rest.cand"), "to check", all_notes))
        .otherwise(out(unmatched, F.coalesce("rest.cand", "first.cand"), "different", all_notes))
    )
    by_title = (
        F.when(F.col("t_first").isNull(), out(unmatched, none.cast("bigint"), "nothing like it", series_notes))
        .when(F.col("t_proof").isNotNull(), out("trash", F.col("t_proof.cand"), "similar title, proved", series_notes))
        .when(F.col("t_cover").isNotNull(), out("trash", F.col("t_cover.cand"), "similar title, same cover", series_notes, _BY_COVER))
        .when(F.col("t_left").isNotNull(), out("leave", F.col("t_left.cand"), "similar title", series_notes))
        .otherwise(out(unmatched, F.col("t_first.cand"), "different", series_notes))
    )
    made = (
        F.when(F.col("file").isNotNull(), out("trash", F.col("file.cand"), "same file", none_noted))
        .when(F.col("series").isNotNull(), out("trash", F.col("series.cand"), "same series and number", series_notes))
        .when(F.col("of").isNotNull(), by_key)
        .otherwise(by_title)
    )
    # what open pairs can't change
    in_key = F.col("file").isNull() & F.col("series").isNull() & F.coalesce("surely", F.lit(False))
    seen_abroad = F.exists("abroad", lambda x: x["open"] & (x["stage"] == 0) & (x["ord"] < F.col("s0.ord")))
    by_duplicate = in_key & F.coalesce(~F.col("s0.open") & ~seen_abroad, F.lit(False))
    by_doubt = in_key & ~F.col("promising") & F.coalesce(~F.col("first.open"), F.lit(False)) & (F.col("surely_doubted") | ~F.col("doubted"))
    settled = ~F.col("waits") | F.coalesce(~F.col("file.open"), F.lit(False)) | (~F.col("waits_early") & (F.col("series").isNotNull() | by_duplicate | by_doubt))
    return agg.select("lib", "id", settled.alias("settled"), made.alias("made")).select("lib", "id", "settled", "made.action", "made.match", "made.why", F.array_distinct("made.notes").alias("notes"), "made.review", "made.override")


def decided(found: DataFrame, unmatched: str, before: DataFrame | None = None) -> DataFrame:
    """DECIDED for every record that has pairs in ``found(lib, id, cand, ord, rung, ...)``.

    A candidate that has pairs itself is undecided at first. The others stay, but for those that go by the decisions ``before``.
    """
    ids = found.select("lib", F.col("id").alias("cand")).distinct().withColumn("open", F.lit(True))
    pairs = exchanged(found).join(ids, ["lib", "cand"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    pairs = pairs.withColumn("dead", F.lit(False)) if before is None else _dead(pairs.withColumn("dead", F.lit(False)), before)
    pairs = written(pairs, "pairs")
    done = []
    while True:
        now = written(outcomes(pairs, unmatched).filter("settled").drop("settled").select(*DECIDED), "decided")
        done.append(now)
        after = written(_dead(exchanged(pairs).join(now.select("lib", "id"), ["lib", "id"], "left_anti"), now), "pairs")
        forget(pairs)
        pairs = after
        if not pairs.limit(1).count():
            forget(pairs)
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _told(waiting: DataFrame, heads: DataFrame, pairs: DataFrame, by: DataFrame, unmatched: str) -> DataFrame:
    """``waiting(lib, id, ord, class, ...)`` with ``settled`` and DECIDED; both are null where a record meets nothing. Written.

    ``heads(lib, of, ord, cand, open)`` are the first of the classes, ``by`` has pairs of classes and ``pairs`` those of records, none of them dead. Records of a
    class that rank behind the same heads are told alike, once; those with pairs of their own each for itself. A pair of a file decides whatever classes say.
    """
    meets = written(exchanged(by).join(heads, ["lib", "of"]), "meets")
    ords = meets.groupBy("lib", "class").agg(F.collect_set(F.when(F.col("ranked"), F.col("ord"))).alias("ords"))
    own = pairs.groupBy("lib", "id").agg(F.bool_or(F.col("rung") == FILE).alias("by_file"))
    none = F.array(F.lit(-1).cast("bigint"))
    upto = F.coalesce(F.array_max(F.filter("ords", lambda o: o < F.col("ord"))), none)
    alone = F.col("by_file").isNotNull()
    key = F.struct(alone.alias("alone"), F.when(alone, F.col("id")).otherwise(F.col("class")).alias("of"), F.when(alone, none).otherwise(F.col("upto")).alias("upto"))
    placed = exchanged(exchanged(waiting).join(ords, ["lib", "class"], "left")).join(own, ["lib", "id"], "left").withColumn("upto", upto).withColumn("key", key)
    placed = written(placed.select(*waiting.columns, "upto", "key", "by_file"), "placed")
    asking = placed.filter("by_file is null or not by_file").select("lib", "class", "upto", "key").distinct()
    each = exchanged(asking).join(meets, ["lib", "class"]).filter("ord <= upto or not ranked").withColumn("id", F.col("key"))
    single = pairs.withColumn("id", F.struct(F.lit(True).alias("alone"), F.col("id").alias("of"), none.alias("upto")))
    names = [c for c in pairs.columns if c not in ("own", "dead")]
    told = outcomes(each.select(*names).union(single.select(*names)).withColumn("dead", F.lit(False)), unmatched).withColumnRenamed("id", "key")
    state = written(exchanged(placed).join(told, ["lib", "key"], "left").select(*waiting.columns, "settled", *DECIDED[2:]), "state")
    forget(meets)
    forget(placed)
    return state


def _class_pairs(alike: DataFrame, found: DataFrame) -> DataFrame:
    names = [c for c in found.columns if c not in ("lib", "id", "cand", "ord", "own")]
    return alike.select("lib", F.col("id").alias("class"), F.col("cand").alias("of"), "ranked", *names)


def _opened(found: DataFrame, waiting: DataFrame) -> DataFrame:
    """Pairs of records with ``open`` where the candidate is undecided; none is dead."""
    opened = waiting.select("lib", F.col("id").alias("cand"), F.lit(True).alias("open"))
    return exchanged(found).join(opened, ["lib", "cand"], "left").withColumn("open", F.coalesce("open", F.lit(False))).withColumn("dead", F.lit(False))


def decided_alike(found: DataFrame, alike: DataFrame, members: DataFrame, unmatched: str) -> DataFrame:
    """As ``decided``, of records in classes: ``found`` has pairs of records, ``alike`` those of classes, ``members`` the records of each (``ladder.alike``).

    A record is to all members of a class what it is to one, so of those that may stay only the first counts, if it is better ranked. Each round a class
    has a pair for each class that it meets, for each place that its records have among the first of these, however many records it has. Members
    that aren't ``own`` stay. Records that meet nothing have no row.
    """
    key = ["lib", "id"]
    head = F.min(F.struct("ord", "id", "open")).alias("head")
    row = lambda df, open_: df.filter("cand").select("lib", "class", "ord", "id", F.lit(open_).alias("open"))
    first = lambda df: df.groupBy("lib", "class").agg(head)
    stay = written(first(row(members.filter("not own"), False)).select("lib", "class", "head.*"), "stay")
    waiting = written(members.filter("own").select("lib", "id", "ord", "class", "cand"), "waiting")
    by = _class_pairs(alike, found)
    pairs = written(_opened(found, waiting), "pairs")
    done = []
    while True:
        heads = first(stay.select("lib", "class", "ord", "id", "open").union(row(waiting, True))).select("lib", F.col("class").alias("of"), F.col("head.ord").alias("ord"), F.col("head.id").alias("cand"), F.col("head.open").alias("open"))
        state = _told(waiting, heads, pairs, by, unmatched)
        done.append(state.filter("settled").select(*DECIDED))
        more = state.filter("not settled").select(*waiting.columns)
        if not more.limit(1).count():
            break
        ended = state.filter("settled is null or settled")
        now = ended.select(*key, F.coalesce("action", F.lit(unmatched)).alias("action"))
        stays = ended.filter("action is null or action <> 'trash'")
        after = written(first(stay.select("lib", "class", "ord", "id", "open").union(row(stays, False))).select("lib", "class", "head.*"), "stay")
        left = written(_dead(exchanged(pairs).join(more.select(*key), key, "left_semi"), now).filter("not dead").select(*pairs.columns), "pairs")
        forget(stay)
        forget(pairs)
        stay, waiting, pairs = after, more, left
    forget(stay)
    forget(pairs)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _dead(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs with what the decisions ``made`` say of their candidates."""
    goes = made.select("lib", F.col("id").alias("cand"), (F.col("action") == "trash").alias("goes"))
    df = exchanged(pairs).join(goes, ["lib", "cand"], "left")
    return df.withColumn("dead", F.col("dead") | F.coalesce("goes", F.lit(False))).withColumn("open", F.col("open") & F.col("goes").isNull()).drop("goes")
