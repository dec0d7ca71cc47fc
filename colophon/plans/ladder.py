"""The decision ladder: candidate pairs of each rung, their verdicts, and a plan row for each source record.

All pairs with all verdicts are computed by joins first. What is left is order: a record is compared with
targets and with better-ranked source records that stay. ``plans.rounds`` decides that in parallel rounds.

Facts come as tables: texts that pairs share, what a reader of images said of pairs of covers, what a reader said of pairs of authors, machine readings of records.
Without such a table its rungs say nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.operators import blocking
from colophon.operators.groups import placeholders
from colophon.operators.tables import exchanged, forget, written
from colophon.operators.verdict import cover_kind, cover_verdict, verdict, with_publishers
from colophon.plans.answers import filled
from colophon.plans.features import features, put_right, without_junk_isbns
from colophon.plans.rounds import FILE, KEY, SERIES, TITLE, VARIANT, decided, decided_alike


@dataclass(frozen=True)
class Options:
    """What decides a plan."""

    similar_authors: bool = False
    same_series: bool = False
    similar_titles: bool = False
    author_variants: bool = False
    one_library: bool = False
    fix_swapped: bool = False
    cover_check: bool = False
    always_cover: bool = False
    recheck_years: bool = False
    trash_unreadable: bool = False


PLAN = "lib string, id bigint, action string, match bigint, match_side string, why string, notes array<string>, reason string, review string, selected boolean, override boolean"
#: A text so many times longer is other content (TX10).
LONGER = 3


def _files(df: DataFrame) -> DataFrame:
    return df.filter("digest is not null").select("lib", "id", "ord", F.lit("file").alias("fmt"), F.lit(1).alias("size"), "digest", "title_key", F.array_join("authors_key", "|").alias("authors_key"))


def ranked(feats: DataFrame) -> DataFrame:
    """WN1: ``ord`` sorts source records in the order in which they are decided; targets come before all.

    It is a list of numbers that compares like the rank itself, so no library is ranked in one task.
    """
    own = F.col("side") == "source"
    number = lambda c: F.when(own, c).otherwise(0).cast("bigint")
    # a key for both sides: targets get odd numbers
    return feats.withColumn("book", F.col("id")).withColumn("id", F.col("id") * 2 + (~own).cast("int")).withColumn("ord", F.array(own.cast("bigint"), number(F.col("rank")), number(-F.col("richness")), F.col("book")))


def _with_generic(feats: DataFrame) -> DataFrame:
    """IM2, AG4: ``generic``: the record's cover stands on three titles and three sets of authors."""
    junk = placeholders(feats.filter("cover is not null").withColumn("akey", F.array_join("authors_key", "|")), "lib", "cover", author="akey")
    junk = written(junk.select("lib", "cover"), "generic")
    if not junk.limit(1).count():
        forget(junk)
        return feats.withColumn("generic", F.lit(False))
    return exchanged(feats).join(junk.withColumn("generic", F.lit(True)), ["lib", "cover"], "left").withColumn("generic", F.coalesce("generic", F.lit(False)))


def _covers(pairs: DataFrame, answers: DataFrame | None, options: Options) -> DataFrame:
    """IM5: ``cover``, what the covers of each pair say; ``answers(a, b, answer)`` has digests with a <= b."""
    if answers is None:
        df = pairs.withColumn("_answer", F.lit(None).cast("string"))
    else:
        said = answers.select(F.col("a").alias("_ca"), F.col("b").alias("_cb"), F.col("answer").alias("_answer"))
        df = exchanged(pairs).join(said, (F.least("cover_a", "cover_b") == F.col("_ca")) & (F.greatest("cover_a", "cover_b") == F.col("_cb")), "left").drop("_ca", "_cb")
    # where a reader of images was asked at all, what it didn't say is unclear
    answer = F.col("_answer") if answers is None else F.coalesce("_answer", F.lit("unsure"))
    no = F.lit(False)
    on = F.lit(options.cover_check or options.always_cover)
    cover = cover_verdict(on, F.col("cover_a"), F.col("cover_b"), F.coalesce("page_a", no), F.coalesce("page_b", no), F.col("generic_a") | F.col("generic_b"), answer)
    return df.withColumn("cover", cover).drop("_answer")


def _found(src: DataFrame, cand: DataFrame, junk: DataFrame, options: Options, authors: DataFrame | None) -> DataFrame:
    """(lib, id, cand, ord, rung, weak) of what the rungs find between sources and candidates."""
    return _by_file(src, cand, junk).union(_by_facts(src, cand, options, authors))


def _by_file(src: DataFrame, cand: DataFrame, junk: DataFrame) -> DataFrame:
    return blocking.same_file(_files(src), _files(cand), junk).select("lib", "id", "cand", "ord", F.lit(FILE).alias("rung"), F.lit(False).alias("weak"))


def _by_facts(src: DataFrame, cand: DataFrame, options: Options, authors: DataFrame | None) -> DataFrame:
    """What the rungs find that look at titles, authors and series only."""
    parts = []

    def add(pairs: DataFrame, rung: int) -> None:
        weak = F.col("weak") if "weak" in pairs.columns else F.lit(False)
        parts.append(pairs.select("lib", "id", "cand", "ord", F.lit(rung).alias("rung"), weak.alias("weak")))

    if options.same_series:
        add(blocking.by_series(src, cand), SERIES)
    keyed = blocking.similar(src, cand) if options.similar_authors else blocking.strict(src, cand)
    add(blocking.without_other_volumes(keyed, src, cand), KEY)
    if options.author_variants:
        add(blocking.without_other_volumes(blocking.author_variants(src, cand, authors), src, cand), VARIANT)
    if options.similar_titles:
        add(blocking.similar_titles(src, cand), TITLE)
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.union(p)
    return pairs


def edges(feats: DataFrame, options: Options, texts: DataFrame | None = None, covers: DataFrame | None = None, of: DataFrame | None = None, authors: DataFrame | None = None) -> DataFrame:
    """Every pair that a rung finds, with its verdict and what texts, languages and covers say of it (DL2-DL8, DL10-DL12).

    ``texts(a, b, share)`` has the text pairs of records' text_id, where there are texts. With ``of(lib, id)``, only pairs of which one side is among these.
    """
    feats = _with_generic(feats)
    src, cand = feats.filter("side = 'source' and chosen"), feats.filter("size(all_formats) > 0")
    junk = placeholders(_files(feats), "fmt", "digest")
    if of is None:
        pairs = _found(src, cand, junk, options, authors)
    else:
        own = lambda df, how: exchanged(df).join(of.select("lib", "id"), ["lib", "id"], how)
        pairs = _found(own(src, "left_semi"), cand, junk, options, authors).union(_found(own(src, "left_anti"), own(cand, "left_semi"), junk, options, authors))
    return _judged(pairs.filter("id <> cand"), feats, options, texts, covers, ranked=True)


def _judged(pairs: DataFrame, feats: DataFrame, options: Options, texts: DataFrame | None, covers: DataFrame | None, ranked: bool) -> DataFrame:
    """``pairs`` with their verdicts, each by the first rung that finds it; if ``ranked``, only those with what is decided earlier or not at all."""
    facts = ["identity", "text_id", "text_lang", "text_chars", "cover", "page_cover", "generic"]
    short = ["i", "t", "l", "n", "cover_", "page_", "generic_"]
    named = lambda key, side: [F.col("id").alias(key), *(F.col(f).alias(f"{k}{side}") for f, k in zip(facts, short, strict=True))]
    order = feats.select("lib", F.col("ord").alias("own"), *named("id", "a"))
    other = feats.select("lib", F.col("chosen").alias("_chosen"), *named("cand", "b"))
    # only targets, records decided earlier and records that aren't to be decided; the first rung that finds a pair counts
    pairs = pairs.join(exchanged(order), ["lib", "id"]).join(exchanged(other), ["lib", "cand"])
    pairs = (pairs.filter("ord < own or not _chosen") if ranked else pairs).drop("_chosen")
    first = Window.partitionBy("lib", "id", "cand").orderBy("rung")
    pairs = pairs.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    judged = with_publishers(pairs.withColumnsRenamed({"ia": "a", "ib": "b"})).withColumn("v", verdict())
    if texts is None:
        judged = judged.withColumn("same_text", F.lit(False))
    else:
        same = texts.filter("share >= 0.95").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        judged = judged.join(exchanged(same), (F.least("ta", "tb") == F.col("_a")) & (F.greatest("ta", "tb") == F.col("_b")), "left").withColumn("same_text", F.col("_a").isNotNull()).drop("_a", "_b")
    no = F.lit(False)
    judged = _covers(judged, covers, options)
    kind = cover_kind(F.col("v.verdict"), F.col("v.incomparable"), F.col("v.year_only"), F.lit(options.recheck_years), F.lit(options.always_cover))
    longer = F.coalesce((F.least("na", "nb") > 0) & (F.greatest("na", "nb") >= F.least("na", "nb") * LONGER), no)
    # TX11: both languages are known and differ
    foreign = F.coalesce(F.col("la") != F.col("lb"), no)
    return judged.select("lib", "id", "cand", "ord", "own", "rung", "weak", "same_text", F.col("v.verdict").alias("verdict"), F.col("v.why").alias("why"), F.col("v.proof").alias("proof"), "cover", kind.alias("kind"), longer.alias("longer"), foreign.alias("foreign"))


#: What decides, beside a record's files and texts, which pairs it makes and what becomes of them.
_WORK = ["side", "chosen", "title_key", "authors", "authors_key", "similar_keys", "series", "series_key", "series_number", "publisher", "identity", "text_lang", "text_chars", "cover", "page_cover", "generic"]
#: Records to a class from which classes are paired instead of records.
COPIES = 2


def _works(feats: DataFrame, options: Options) -> DataFrame:
    """The features with ``work``: records with equal works are one class."""
    if not (options.cover_check or options.always_cover):
        for name, kind in (("text_chars", "bigint"), ("cover", "string"), ("page_cover", "boolean"), ("generic", "boolean")):
            feats = feats.withColumn(name, F.lit(None).cast(kind))
    return feats.withColumn("work", F.struct(*_WORK))


def _copies(feats: DataFrame) -> bool:
    """Whether there are so many records to a title, author and edition that their pairs would be many."""
    n, works = feats.select(F.count("*"), F.approx_count_distinct(F.xxhash64("lib", "side", "title_key", "authors", "identity"))).first()
    return n >= COPIES * works


def alike(feats: DataFrame, options: Options, texts: DataFrame | None = None, covers: DataFrame | None = None, authors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``edges`` gives, with classes of records instead of all their pairs: (pairs, classes, members), all written.

    ``members(lib, id, ord, class, own, cand)`` has the records, ``classes`` pairs of these with their verdicts (``id`` and ``cand`` are classes). Only what
    files, shared texts or different languages say is told by ``pairs`` of records.
    """
    feats = _with_generic(feats)
    junk = placeholders(_files(feats), "fmt", "digest")
    src, cand = feats.filter("side = 'source' and chosen"), feats.filter("size(all_formats) > 0")
    files = _judged(_by_file(src, cand, junk).filter("id <> cand"), feats, options, None, covers, ranked=True)
    rows = _works(feats, options)
    classes = written(rows.groupBy("lib", "work").agg(F.min("id").alias("id"), F.max(F.size("all_formats") > 0).alias("_cand")), "classes")
    named = classes.select("lib", "work", F.col("id").alias("class"))
    members = exchanged(rows.select("lib", "id", "ord", "text_id", "work", ((F.col("side") == "source") & F.col("chosen")).alias("own"), (F.size("all_formats") > 0).alias("cand"))).join(named, ["lib", "work"]).drop("work")
    members = written(members, "members")
    # a class counts as one record; its order and its text are those of its members
    one = classes.select("lib", "id", "_cand", F.array(F.col("id")).alias("ord"), "work.*", F.lit(None).cast("bigint").alias("text_id")).withColumn("generic", F.coalesce("generic", F.lit(False)))
    met = _by_facts(one.filter("side = 'source' and chosen"), one.filter("_cand"), options, authors)
    pairs = _judged(met, one, options, None, covers, ranked=False).join(exchanged(one.select("lib", F.col("id").alias("cand"), F.col("chosen").alias("ranked"))), ["lib", "cand"])
    pairs = written(pairs, "alike")
    a = members.filter("own").select("lib", F.col("id").alias("_id"), F.col("class").alias("id"), F.col("ord").alias("_own"), F.col("text_id").alias("_ta"))
    b = members.filter("cand").select("lib", F.col("id").alias("_cand"), F.col("class").alias("cand"), F.col("ord").alias("_ord"), F.col("text_id").alias("_tb"))
    earlier = (F.col("_ord") < F.col("_own")) | ~F.col("ranked")
    told = [files]

    def records(df: DataFrame, same_text: bool) -> DataFrame:
        df = df.filter(earlier).drop("id", "cand", "ord", "own", "same_text").withColumn("same_text", F.lit(same_text)).withColumnsRenamed({"_id": "id", "_cand": "cand", "_ord": "ord", "_own": "own"})
        return df.select(*files.columns)

    if texts is not None:
        same = texts.filter("share >= 0.95").select("a", "b")
        same = same.select(F.col("a").alias("_ta"), F.col("b").alias("_tb")).union(same.select("b", "a")).distinct()
        both = exchanged(a).join(same, "_ta").join(exchanged(b), ["lib", "_tb"]).filter("_id <> _cand")
        told.append(records(exchanged(both).join(pairs, ["lib", "id", "cand"]), True))
    told.append(records(exchanged(a).join(pairs.filter("foreign"), ["lib", "id"]).join(exchanged(b), ["lib", "cand"]).filter("_id <> _cand"), False))
    found = told[0]
    for more in told[1:]:
        found = found.unionByName(more)
    return written(found, "edges"), exchanged(pairs.filter("not foreign")), members


def _readings(feats: DataFrame, answers: DataFrame | None) -> DataFrame:
    """DL9, AI4, PF2: what machine readings ``answers(lib, side, id, publisher, edition, year, isbns)`` say fills what the records lack."""
    if answers is None:
        return feats
    said = answers.select("lib", "side", "id", F.struct("publisher", "edition", "year", "isbns").alias("answer"))
    df = exchanged(feats).join(said, ["lib", "side", "id"], "left")
    kept = df.withColumn("_identity", F.col("identity"))
    return filled(kept).withColumn("identity", F.when(F.col("answer").isNull(), F.col("_identity")).otherwise(F.col("identity"))).drop("answer", "_identity")


def described(books: DataFrame, options: Options, answers: DataFrame | None = None, chosen: Column | None = None) -> DataFrame:
    """The features of all records, as the rungs need them, over a written table: names and titles get their keys once."""
    books = books.withColumn("chosen", F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False)))
    books = put_right(books) if options.fix_swapped else books.withColumn("swapped", F.lit(False))
    feats = written(features(books, options.same_series), "features")
    right = _readings(without_junk_isbns(feats), answers)
    if right is not feats:
        right = written(right, "features")
        forget(feats)
    return ranked(right)


#: What a record needs to be compared.
USABLE = "side = 'target' or (size(formats) > 0 and title_key <> '' and size(authors_key) > 0)"


def prepared(books: DataFrame, options: Options, texts: DataFrame | None = None, covers: DataFrame | None = None, answers: DataFrame | None = None, chosen: Column | None = None, authors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The features of all records, and the pairs that the rungs find with their verdicts; both are written."""
    feats = described(books, options, answers, chosen)
    return feats, written(edges(feats.filter(USABLE), options, texts, covers, authors=authors), "edges")


def compared(books: DataFrame, options: Options, texts: DataFrame | None = None, covers: DataFrame | None = None, answers: DataFrame | None = None, chosen: Column | None = None, authors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """The features of all records, and (pairs, classes, members) as by ``alike`` where classes are paired; else all pairs, and none of these."""
    feats = described(books, options, answers, chosen)
    usable = feats.filter(USABLE)
    if _copies(usable):
        return feats, *alike(usable, options, texts, covers, authors)
    return feats, written(edges(usable, options, texts, covers, authors=authors), "edges"), None, None


def unmatched(options: Options) -> str:
    """What becomes of a record that no pair decides."""
    return "leave" if options.one_library else "move"


def plan(books: DataFrame, options: Options | None = None, texts: DataFrame | None = None, covers: DataFrame | None = None, answers: DataFrame | None = None, chosen: Column | None = None, authors: DataFrame | None = None) -> DataFrame:
    """PLAN for every source record (with ``chosen``, for those it holds for: PF4), in the order of ids within each library (SO1).

    Records that aren't chosen stay candidates for the others.
    """
    options = options or Options()
    feats, pairs, classes, members = compared(books, options, texts, covers, answers, chosen, authors)
    made = decided(pairs, unmatched(options)) if classes is None else decided_alike(pairs, classes, members, unmatched(options))
    return finished(feats, made, options)


def finished(feats: DataFrame, made: DataFrame, options: Options, only: Column | None = None) -> DataFrame:
    """PLAN from the features and the decisions ``made`` of records with pairs; with ``only``, of the source records it holds for."""
    source = feats.filter("side = 'source' and chosen")
    source = source if only is None else source.filter(only)
    rows = exchanged(source).join(made, ["lib", "id"], "left")
    unlike = F.lit(unmatched(options))
    no_file, closed = F.size("all_formats") == 0, F.size("formats") == 0
    held = (F.col("title_key") == "") | (F.size("authors_key") == 0)
    # PF6, PF7, DL4
    action = F.when(no_file, "trash").when(closed, F.when(F.size(F.coalesce("foreign", F.array().cast("array<string>"))) > 0, "leave").otherwise("trash"))
    action = action.when(F.col("action") == "trash", "trash").when(held, "leave").otherwise(F.coalesce("action", unlike))
    why = F.when(no_file, "no formats").when(closed, "no format that opens").when(held & F.col("action").isNull(), "held: no title or authors").otherwise(F.coalesce("why", F.lit("nothing like it")))
    rows = rows.withColumn("why", why).withColumn("action", action).withColumn("match", F.when(no_file | closed, None).otherwise(F.col("match")))
    rows = _held(rows, feats, options)
    rows = _kept_chosen(rows, feats)
    bad = F.array_sort(F.coalesce("broken", F.array().cast("array<string>")))
    closed = (F.size("all_formats") > 0) & (F.size("formats") == 0)
    none = F.lit("")
    notes = F.array_compact(F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array(
        F.when(F.col("swapped"), "title and author were swapped"),
        F.when((F.size(bad) > 0) & ~closed, F.concat(F.lit("unreadable: "), F.array_join(bad, ", "))),
    )))
    unopened = F.when((F.size(bad) > 0) & ~F.lit(options.trash_unreadable) & ((F.col("action") != "trash") | closed), F.concat(F.array_join(bad, ", "), F.lit(" open nowhere")))
    moved = F.col("why").startswith("held")
    review = F.concat_ws("; ", F.when(~moved, F.nullif(F.coalesce("review", none), none)), unopened)
    match = F.when(F.col("match").isNotNull(), F.floor(F.col("match") / 2))
    side = F.when(F.col("match") % 2 == 1, "target").when(F.col("match").isNotNull(), "source")
    out = rows.select("lib", F.col("book").alias("id"), "action", match.cast("bigint").alias("match"), side.alias("match_side"), "why", F.array_distinct(notes).alias("notes"), review.alias("review"), F.coalesce("override", F.lit(False)).alias("override"))
    # DL18, DL15
    reason = F.when(F.size("notes") > 0, F.concat("why", F.lit(" ["), F.array_join("notes", "; "), F.lit("]"))).otherwise(F.col("why"))
    return out.withColumn("reason", reason).withColumn("selected", (F.col("action") != "leave") & (F.col("review") == "")).select(*(c.split()[0] for c in PLAN.split(", ")))


def _held(rows: DataFrame, feats: DataFrame, options: Options) -> DataFrame:
    """DL13, PF11: what would move stays if its title is a file name, it was swapped, or a target's file-name title may be its own."""
    named = feats.filter("side = 'target' and is_file_name and file_title is not null")
    hidden = blocking.may_hide(rows.filter("action = 'move' and not is_file_name").drop("match", "action", "why", "notes", "review", "override"), named)
    rows = exchanged(rows).join(hidden, ["lib", "id"], "left")
    moves = F.col("action") == "move"
    why = F.when(moves & F.col("is_file_name"), "held: file-name title").when(moves & F.col("hidden_by").isNotNull(), "held: may be hidden").when(moves & F.col("swapped"), "held: swapped").otherwise(F.col("why"))
    match = F.when(moves & ~F.col("is_file_name") & F.col("hidden_by").isNotNull(), F.col("hidden_by")).otherwise(F.col("match"))
    return rows.withColumn("why", why).withColumn("match", match).withColumn("action", F.when(F.col("why").startswith("held"), "leave").otherwise(F.col("action"))).drop("hidden_by")


def _kept_chosen(rows: DataFrame, feats: DataFrame) -> DataFrame:
    """DL16: a copy that would go into a record that wasn't chosen, but is the better of the two, stays."""
    others = feats.filter("side = 'source' and not chosen").select("lib", F.col("id").alias("match"), F.col("ord").alias("_theirs"))
    joined = rows.join(exchanged(others), ["lib", "match"], "left")
    better = (F.col("action") == "trash") & F.coalesce(F.col("ord") < F.col("_theirs"), F.lit(False))
    return joined.withColumn("why", F.when(better, "the copy to keep; the other wasn't chosen").otherwise(F.col("why"))).withColumn("review", F.when(better, "").otherwise(F.col("review"))).withColumn("action", F.when(better, "leave").otherwise(F.col("action"))).drop("_theirs")


def cleanup_only(plan_: DataFrame, books: DataFrame) -> DataFrame:
    """DL14: the target is never written. What would move stays; a copy goes only if the kept one lacks none of its formats."""
    adds = formats_to_add(plan_, books).select("lib", "id", "add")
    joined = exchanged(plan_).join(adds, ["lib", "id"], "left")
    lacks = (F.col("action") == "trash") & F.col("match").isNotNull() & F.col("add").isNotNull()
    moves = F.col("action") == "move"
    why = F.when(moves, "kept").when(lacks, F.concat(F.lit("the kept copy lacks "), "add")).when((F.col("action") == "trash") & (F.col("match_side") == "source"), "another copy stays").otherwise(F.col("why"))
    out = joined.withColumn("why", why).withColumn("action", F.when(moves | lacks, "leave").otherwise(F.col("action")))
    return out.withColumn("selected", F.col("selected") & (F.col("action") != "leave")).select(*plan_.columns)


def formats_to_add(plan_: DataFrame, books: DataFrame) -> DataFrame:
    """PF18, WN3: (lib, id, add): readable formats that the match lacks, PDF aside, each promised by the first copy only; nothing where the metadata were overruled."""
    none = F.array().cast("array<string>")
    opens = F.array_except("formats", F.concat(F.coalesce("broken", none), F.coalesce("foreign", none)))
    names = books.select("lib", F.col("id").alias("_id"), "side", "formats", opens.alias("opens"))
    goes = plan_.filter("action = 'trash' and match is not null and not override")
    own = exchanged(goes).join(names.filter("side = 'source'").select("lib", F.col("_id").alias("id"), F.col("opens").alias("own")), ["lib", "id"])
    both = own.join(exchanged(names.select("lib", F.col("_id").alias("match"), F.col("side").alias("match_side"), F.col("formats").alias("theirs"))), ["lib", "match", "match_side"])
    missing = both.select("lib", "id", "match", "match_side", F.explode(F.array_except(F.array_except("own", "theirs"), F.array(F.lit("PDF")))).alias("fmt"))
    first = Window.partitionBy("lib", "match", "match_side", "fmt").orderBy("id")
    return missing.withColumn("n", F.row_number().over(first)).filter("n = 1").groupBy("lib", "id").agg(F.array_join(F.sort_array(F.collect_list("fmt")), ",").alias("add"))
