"""People and publishers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions import words as fixed
from colophon.functions.text import bound, casefold, col, is_unknown, strings, tokens
from colophon.functions.titles import MIN_TYPO, one_edit

MIN_SURNAME = 4


def author_key(name: Column | str) -> Column:
    """NM1: sorted tokens; all spellings of "various authors" are one key."""
    told = lambda key: F.when(F.array_join(key, " ").isin(fixed.VARIOUS), F.array(F.lit(fixed.VARIOUS_KEY))).otherwise(key)
    return bound(told, F.sort_array(tokens(F.replace(col(name), F.lit("."), F.lit(" ")))))


def similar_author_key(name: Column | str) -> Column:
    """NM3: without initials, particles and suffixes, unless nothing is left."""
    return _similar(author_key(name))


def _similar(key: Column) -> Column:
    ignored = strings(fixed.IGNORED_NAME_WORDS)
    kept = lambda k: F.filter(k, lambda t: (F.char_length(t) > 1) & ~F.array_contains(ignored, t))
    return bound(lambda k: bound(lambda left: F.when(F.size(left) > 0, left).otherwise(k), kept(k)), key)


def both_author_keys(name: Column | str) -> Column:
    """NM1 and NM3 as an array of two strings, from one reading of the name."""
    return bound(lambda k: F.array(F.array_join(k, " "), F.array_join(_similar(k), " ")), author_key(name))


def _keys(authors: Column | str, of) -> Column:
    known = F.filter(col(authors), lambda a: ~is_unknown(a))
    return F.filter(F.array_distinct(F.transform(known, lambda a: F.array_join(of(a), " "))), lambda k: k != "")


def authors_key(authors: Column | str) -> Column:
    """NM2: sorted keys of the known authors, each as a string."""
    return F.sort_array(_keys(authors, author_key))


def similar_authors_keys(authors: Column | str) -> Column:
    """NM3: a key for each known author, in their order."""
    return _keys(authors, similar_author_key)


def names_nearly_equal(a: Column, b: Column) -> Column:
    """NM5: one long part of the names differs by one letter."""

    def equal(x: Column, y: Column) -> Column:
        only_a, only_b = F.filter(x, lambda t: ~F.array_contains(y, t)), F.filter(y, lambda t: ~F.array_contains(x, t))
        p, q = F.get(only_a, F.lit(0)), F.get(only_b, F.lit(0))
        single = (F.size(x) == F.size(y)) & (F.size(only_a) == 1) & (F.size(only_b) == 1)
        return F.coalesce(single & (F.least(F.char_length(p), F.char_length(q)) >= MIN_TYPO) & one_edit(p, q), F.lit(False))

    return bound(equal, similar_author_key(a), similar_author_key(b))


def surname_match(a: Column, b: Column) -> Column:
    """NM7: one name is a single long word of the other."""

    def within(s: Column, t: Column) -> Column:
        w = F.get(s, F.lit(0))
        return (F.size(s) == 1) & (F.size(t) > 1) & (F.char_length(w) >= MIN_SURNAME) & F.array_contains(t, w)

    return bound(lambda x, y: F.coalesce(within(x, y) | within(y, x), F.lit(False)), similar_author_key(a), similar_author_key(b))


def publisher_words(name: Column | str) -> Column:
    """NM9: the words that tell publishers apart; dotted abbreviations are one word."""
    text = col(name)
    # a point between single letters goes, and so does the last one of such a row
    joined = F.regexp_replace(text, r"(?U)(?<=\b\w)\.(?=\w\.)|(?<=\.\w)\.", "")
    stop = strings(fixed.PUBLISHER_STOPWORDS)
    return F.filter(tokens(joined), lambda t: ~F.array_contains(stop, t))


def same_publisher(a: Column, b: Column) -> Column:
    """NM10: equal when written together, or a shared full word and one side covered by the other."""

    def covered(xs: Column, ys: Column) -> Column:
        return F.forall(xs, lambda x: F.array_contains(ys, x) | ((F.char_length(x) == 1) & F.exists(ys, lambda y: y.startswith(x))))

    def same(wa: Column, wb: Column) -> Column:
        shared = F.exists(wa, lambda t: (F.char_length(t) > 1) & F.array_contains(wb, t))
        return (F.array_join(wa, "") == F.array_join(wb, "")) | (shared & (covered(wa, wb) | covered(wb, wa)))

    wa, wb = publisher_words(a), publisher_words(b)
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), tokens(a) == tokens(b)).otherwise(bound(same, wa, wb))


def initials_match(a: Column, b: Column) -> Column:
    """NM6: the parts of two names pair up one to one, as equal words or as a word and its initial.

    Equal words are taken out first. What is left pairs up exactly if each letter begins as many parts on either side, and
    no side has more whole words with that letter than the other has initials.
    """

    def numbered(key: Column) -> Column:
        # repeated words are told apart by their number; keys are sorted
        return F.transform(key, lambda w, i: F.struct(w.alias("w"), (i - F.array_position(key, w)).alias("n")))

    def pair_up(x: Column, y: Column) -> Column:
        whole = lambda parts: F.filter(parts, lambda p: F.char_length(p["w"]) > 1)
        short = lambda parts: F.filter(parts, lambda p: F.char_length(p["w"]) == 1)
        first = lambda parts: F.transform(parts, lambda p: F.substring(p["w"], 1, 1))
        left = lambda own, other: F.filter(whole(own), lambda p: ~F.array_contains(other, p))
        count = lambda letters, c: F.size(F.filter(letters, lambda d: d == c))
        wx, wy, sx, sy = first(left(x, y)), first(left(y, x)), first(short(x)), first(short(y))
        shared = F.size(whole(x)) > F.size(left(x, y))
        fits = lambda words, initials: F.forall(words, lambda c: count(words, c) <= count(initials, c))
        balanced = F.sort_array(F.concat(wx, sx)) == F.sort_array(F.concat(wy, sy))
        return (x != y) & (F.size(sx) + F.size(sy) > 0) & shared & balanced & fits(wx, sy) & fits(wy, sx)

    return F.coalesce(bound(lambda x, y: bound(pair_up, numbered(x), numbered(y)), author_key(a), author_key(b)), F.lit(False))


def looks_like_name(value: Column | str) -> Column:
    """NM8: one to four capitalised words, particles between them aside, without an article, numbers or a title's small words."""
    given = F.coalesce(col(value), F.lit(""))
    particles, small = strings(fixed.NAME_PARTICLES), strings(fixed.TITLE_WORDS)
    pieces = F.regexp_extract_all(given, F.lit(r"(\p{L}+|\p{Nd}+)"), F.lit(1))

    def person(found: Column) -> Column:
        core = F.filter(found, lambda w: ~F.array_contains(particles, w))
        inner = F.contains(given, F.lit(",")) | ~F.array_contains(particles, F.try_element_at(found, F.lit(-1)))
        return F.when((F.size(core) >= 2) & (F.size(core) < F.size(found)) & inner, core).otherwise(found)

    def named(words_: Column) -> Column:
        proper = lambda w: w.rlike(r"^\p{Lu}") & ~casefold(w).startswith("scan")
        dotted = given.rlike(r"^\s*\p{L}\.")
        article = casefold(F.get(words_, F.lit(0))).isin(fixed.ARTICLES) & ~dotted
        rest = F.slice(words_, F.lit(2), F.greatest(F.size(words_) - 1, F.lit(0)))
        plain = ~article & ~F.exists(rest, lambda w: F.array_contains(small, w))
        return F.size(words_).between(1, 4) & F.forall(words_, proper) & ((F.size(words_) == 1) | plain)

    return F.coalesce(bound(lambda found: bound(named, person(found)), pieces), F.lit(False))
