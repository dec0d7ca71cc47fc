"""The parallel rounds against one record after the other."""

import random
from collections import namedtuple

import pytest

from colophon.plans import rounds

Pair = namedtuple("Pair", "lib id cand ord own rung weak same_text verdict why proof cover kind longer foreign")
SCHEMA = "lib string, id bigint, cand bigint, ord array<bigint>, own array<bigint>, rung int, weak boolean, same_text boolean, verdict string, why string, proof boolean, cover string, kind string, longer boolean, foreign boolean"


def by_key(pairs, unmatched, notes):
    first = pairs[0]
    while pairs:
        found = next(((p, p.why, "", False, False) for p in pairs if p.verdict == "duplicate"), None)
        found = found or next(((p, "same text", "", p.verdict == "distinct", True) for p in pairs if p.same_text), None)
        asked = [p for p in pairs if p.kind is not None]
        found = found or next(((p, "same cover", rounds._BY_COVER, p.verdict == "distinct", False) for p in asked if p.cover == "same"), None)
        found = found or next(((p, "nothing tells them apart", "no edition: compare them", False, False) for p in asked if p.kind == "open" and p.cover == "unclear" and not p.longer), None)
        if not found:
            doubt = any(p.kind in ("open", "incomparable") or p.kind == "weak" and p.cover != "different" for p in asked) or any(p.verdict == "unknown" for p in pairs)
            return ("leave", pairs[0].cand, "to check", notes, "", False) if doubt else (unmatched, pairs[0].cand, "different", notes, "", False)
        p, why, review, override, content = found
        if content or not p.foreign:
            weak = "authors matched by the surname only" if p.weak and not content and not p.proof else ""
            return "trash", p.cand, why, notes, "; ".join(x for x in (review, weak) if x), override
        notes = [*notes, f"{p.cand // 2} is in another language"]
        pairs = [x for x in pairs if x is not p]
    return unmatched, first.cand, "different", notes, "", False


def one(live, unmatched):
    of = lambda r: [p for p in live if p.rung == r]
    if of(rounds.FILE):
        return "trash", of(rounds.FILE)[0].cand, "same file", [], "", False
    notes = [f"{p.cand // 2} is in another language" for p in of(rounds.SERIES) if p.foreign]
    series = [p for p in of(rounds.SERIES) if not p.foreign]
    if series:
        return "trash", series[0].cand, "same series and number", notes, "", False
    keyed = of(rounds.KEY) or of(rounds.VARIANT)
    if keyed:
        return by_key(keyed, unmatched, notes)
    titled = of(rounds.TITLE)
    if not titled:
        return unmatched, None, "nothing like it", notes, "", False
    for p in titled:
        if p.same_text or p.proof and not p.foreign:
            return "trash", p.cand, "similar title, proved", notes, "", False
    for p in titled:
        if p.cover == "same" and p.verdict != "distinct" and not p.foreign:
            return "trash", p.cand, "similar title, same cover", notes, rounds._BY_COVER, False
    left = [p for p in titled if p.verdict != "distinct" and p.cover != "different" and not p.foreign]
    return ("leave", left[0].cand, "similar title", notes, "", False) if left else (unmatched, titled[0].cand, "different", notes, "", False)


def in_turn(pairs, unmatched):
    """Record after record, in rank order."""
    own = {(p.lib, p.id): p.own for p in pairs}
    gone, out = set(), []
    for lib, i in sorted(own, key=lambda k: (k[0], own[k])):
        mine = sorted((p for p in pairs if (p.lib, p.id) == (lib, i) and (p.lib, p.cand) not in gone), key=lambda p: (p.rung, p.ord))
        action, match, why, notes, review, override = one(mine, unmatched)
        if action == "trash":
            gone.add((lib, i))
        out.append((lib, i, action, match, why, list(dict.fromkeys(notes)), review, override))
    return sorted(out)


def made(seed, records, density, rungs, verdicts, covers):
    """Random pairs of each record with better-ranked ones and targets, each pair on one rung."""
    rng = random.Random(seed)
    out = []
    for lib in ("p", "q"):
        for i in range(records):
            own = [1, i, 0, i]
            others = [(2 * j, [1, j, 0, j]) for j in range(i)] + [(2 * t + 1, [0, 0, 0, t]) for t in range(4)]
            for cand, rank in others:
                if rng.random() < density:
                    verdict = rng.choice(verdicts)
                    kind = {"unknown": rng.choice(["open", "incomparable"]), "distinct": rng.choice([None, "weak", "different"])}.get(verdict)
                    out.append(Pair(lib, 2 * i, cand, rank, own, rng.choice(rungs), rng.random() < 0.3, rng.random() < 0.1, verdict, rng.choice(["isbn", "year"]), rng.random() < 0.3, rng.choice(covers), kind, rng.random() < 0.3, rng.random() < 0.4))
    return out


def check(spark, pairs, unmatched):
    got = rounds.decided(spark.createDataFrame(pairs, SCHEMA), unmatched).select(*rounds.DECIDED).collect()
    assert sorted(map(tuple, got)) == in_turn(pairs, unmatched)


ALL = [rounds.FILE, rounds.SERIES, rounds.KEY, rounds.VARIANT, rounds.TITLE]
VERDICTS, COVERS = ["duplicate", "unknown", "distinct", "distinct"], ["skipped", "same", "different", "unclear"]


@pytest.mark.parametrize(
    ("records", "density", "rungs", "verdicts", "covers"),
    [(12, 0.5, ALL, VERDICTS, COVERS), (40, 0.08, ALL, VERDICTS, COVERS), (14, 0.9, [rounds.KEY], VERDICTS, COVERS), (14, 0.9, [rounds.KEY, rounds.VARIANT], ["unknown", "distinct"], ["skipped"]), (12, 0.6, [rounds.TITLE, rounds.SERIES], VERDICTS, COVERS)],
)
def test_rounds_equal_one_after_the_other(spark, records, density, rungs, verdicts, covers):
    for seed in (1, 2):
        check(spark, made(seed, records, density, rungs, verdicts, covers), ("move", "leave")[seed % 2])


def test_a_chain_is_decided_to_its_end(spark):
    """Each record is a copy of the one before it only, so every second one stays."""
    pairs = [Pair("p", 2 * i, 2 * i - 2, [1, i - 1, 0, i - 1], [1, i, 0, i], rounds.FILE, False, False, "distinct", "", False, "skipped", None, False, False) for i in range(1, 9)]
    check(spark, pairs, "move")


def counted_rounds(spark, pairs, monkeypatch):
    n = []
    outcomes = rounds.outcomes
    monkeypatch.setattr(rounds, "outcomes", lambda *a: (n.append(1), outcomes(*a))[1])
    check(spark, pairs, "move")
    return len(n)


@pytest.mark.parametrize(("rung", "verdict", "kind"), [(rounds.FILE, "distinct", None), (rounds.KEY, "duplicate", None), (rounds.KEY, "unknown", "open"), (rounds.KEY, "distinct", None)])
def test_many_copies_take_few_rounds(spark, monkeypatch, rung, verdict, kind):
    """All of one key: whatever they are to each other, not one round a record."""
    pairs = [Pair("p", 2 * i, 2 * j, [1, j, 0, j], [1, i, 0, i], rung, False, False, verdict, "year", False, "skipped", kind, False, False) for i in range(1, 25) for j in range(i)]
    assert counted_rounds(spark, pairs, monkeypatch) <= 2


def test_no_pairs(spark):
    assert rounds.decided(spark.createDataFrame([], SCHEMA), "move").count() == 0


def _copies(spark, seed, records):
    """A library of few titles, editions and languages, with files and texts that cross them."""
    from colophon.plans.features import BOOKS
    from colophon.queries.catalogue import book

    rng = random.Random(seed)
    names = [f.split()[0] for f in BOOKS.split(", ")]
    rows = []
    for i in range(records):
        of = {"publisher": rng.choice([None, "Osprey", "Kestrel"]), "year": rng.choice([None, 1990, 1991]), "formats": rng.choice([["EPUB"], ["PDF"], ["EPUB", "MOBI"]]), "digest": str(rng.randrange(records)) if rng.random() < 0.5 else None, "text_id": i, "text_lang": rng.choice([None, None, "ita", "eng"]), "cover": rng.choice([None, "s", "t"]), "tags": rng.choice([["New"], ["New"], []]), "series": rng.choice([None, "Saga"]), "series_number": rng.choice([2.0, 3.0])}
        of["comments"] = rng.choice([None, "rich"])
        rows.append(book("pq"[i % 2], rng.choice(["source"] * 4 + ["target"]), i, rng.choice(["Tides", "Tides", "Salt Roads", "4 Salt Roads"]), rng.choice([["Tove Almqvist"], ["Tove Almqvist", "Karl Holm"], ["Almqvist"]]), **of))
    texts = spark.createDataFrame([(a, b, 1.0) for a in range(records) for b in range(a + 1, records) if rng.random() < 0.01], "a bigint, b bigint, share double")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], BOOKS), texts


@pytest.mark.parametrize("options", [{"one_library": True}, {"one_library": True, "cover_check": True, "same_series": True, "similar_authors": True, "similar_titles": True, "author_variants": True, "recheck_years": True}])
def test_classes_of_records_give_the_plan_of_all_pairs(spark, monkeypatch, options):
    from colophon.plans import ladder
    from colophon.sources.catalogue import tag_selects

    books, texts = _copies(spark, len(options), 90)
    covers = spark.createDataFrame([("s", "t", "same")], "a string, b string, answer string")
    plans = []
    for copies in (0, 1 << 40):
        monkeypatch.setattr(ladder, "COPIES", copies)
        plans.append(sorted(map(str, ladder.plan(books, ladder.Options(**options), texts, covers, chosen=tag_selects("new")).collect())))
    assert plans[0] == plans[1] and len(plans[0]) > 20
    assert all(any(f"action='{a}'" in r for r in plans[0]) for a in ("trash", "leave"))
