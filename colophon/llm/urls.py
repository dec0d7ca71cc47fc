"""URL filters: rules that are given, and association rules mined from labelled pages.

A given rule names a host and the start of a path; it fits that host and its subdomains, and the longest that fits
decides. Every other url is judged by association rules: a url becomes a transaction of at most KINDS tokens (scheme, host, site, top
domain, subdomain, first directory, extension, query names, fragment), Spark's FP-growth mines the token
combinations of labelled pages together with their label, and those that lead to the label ``block`` with enough support and confidence stay.
Of these only the shortest are kept: a combination that holds another rule's adds nothing. The index posts each rule under its rarest
token; a url meets the rules posted under its tokens, and those whose tokens it holds all apply.

A url has KINDS tokens at most, however long it is, so a labelled page has at most 2**KINDS combinations, and at most 2**KINDS / ``support``
combinations are frequent: that bounds the rules, which are written and broadcast only when small. Equal sets of tokens are matched once.

Cases: a null url, or one without ``://``, has an empty host and path and no tokens, so no mined rule fits it; null labels are no labels;
several labels of a page block it if one does; repeated pages are judged each; without labelled pages nothing is mined and ``allow`` is
the verdict; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import written
from colophon.operators.tables import bounded

KINDS = 9
#: Share and number of the labelled pages that a mined combination and its label must have, and the share of the combination's pages that must be blocked.
SUPPORT, PAGES, CONFIDENCE = 0.005, 20, 0.6
#: Rows of rules, or of token sets with a rule, up to which they are broadcast.
SMALL = 500_000
#: The item that stands for the label; no token has this form.
LABEL = "block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What stands after the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """At most KINDS different tokens, each with its kind."""
    labels = F.split(host, r"\.")
    site = F.concat_ws(".", F.slice(labels, -2, 2))
    many = F.size(labels) > 2
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)))))

    def token(kind: str, value: Column, there: Column | None = None) -> Column:
        return F.when((value != "") if there is None else there & (value != ""), F.concat(F.lit(kind + "="), value))

    kinds = [
        token("scheme", F.translate(F.regexp_extract(url, r"^(.*?)://", 1), _UPPER, _LOWER)),
        token("top", F.element_at(labels, -1)),
        token("site", site, F.size(labels) > 1),
        token("host", host, many),
        token("sub", F.element_at(labels, 1), many),
        token("dir", F.regexp_extract(path, r"^/([^/]*)/", 1)),
        token("ext", F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
        token("query", names),
        F.when(_rest(url).contains("#"), F.lit("fragment")),
    ]
    return F.when(_rest(url).isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*kinds)))


def given(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest of ``rules(host and start of a path, verdict)`` that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mined(transactions: DataFrame, support: float = SUPPORT, pages: int = PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, confidence, pages): the shortest token combinations that lead to LABEL; ``transactions(tokens, blocked)``.

    At least ``pages`` pages, and a share ``support`` of all, must hold the combination and the label.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = transactions.sparkSession
    total = transactions.count()
    least = max(pages, math.ceil(support * total))
    if total < least:
        return spark.createDataFrame([], "tokens array<string>, confidence double, pages bigint")
    items = transactions.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(LABEL))).otherwise(F.col("tokens")).alias("items"))
    # half a page less, so that rounding can't raise the least count
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=confidence).fit(items)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(LABEL)))
    rules = written(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * total).cast("bigint").alias("pages")), "rules")
    # a rule is longer than need be if another one's tokens are among its own
    parts = rules.select("tokens", F.explode("tokens").alias("token"))
    shorter = rules.select(F.col("tokens").alias("others"), F.element_at("tokens", 1).alias("token"))
    over = parts.join(shorter, "token").filter((F.size("others") < F.size("tokens")) & (F.size(F.array_except("others", "tokens")) == 0))
    return rules.join(over.select("tokens").distinct(), "tokens", "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, pattern): for each set of ``sets(tokens)`` that holds a rule's tokens, the surest such rule, by an inverted index of the rules."""
    each = rules.select(F.monotonically_increasing_id().alias("rid"), F.col("tokens").alias("of"), "confidence", "pages")
    each = written(each, "rules")
    words = each.select("rid", F.explode("of").alias("token"))
    rarity = words.groupBy("token").count()
    rarest = words.join(rarity, "token").groupBy("rid").agg(F.min(F.struct("count", "token")).alias("least")).select("rid", F.col("least.token").alias("token"))
    index = written(each.join(rarest, "rid").select("token", "of", "confidence", "pages"), "index")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(bounded(index, SMALL), "token").filter(F.size(F.array_except("of", "tokens")) == 0)
    best = F.max(F.struct("confidence", "pages", F.concat_ws(" ", "of").alias("pattern"))).alias("best")
    return met.groupBy("tokens").agg(best).select("tokens", F.col("best.pattern").alias("pattern"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], support: float = SUPPORT, least: int = PAGES, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (the mined rule that fits, where no given one does) of every page.

    ``labels(page_id, blocked)`` say of some pages whether they are to be blocked.
    """
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    read = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = read.select("page_id", host.alias("host"), path.alias("path"), F.array_sort(tokens_of(url, host, path)).alias("tokens"))
    marks = labels.filter("page_id is not null and blocked is not null").groupBy("page_id").agg(F.bool_or("blocked").alias("blocked"))
    found = mined(written(urls.join(marks, "page_id").select("tokens", "blocked"), "transactions"), support, least, confidence)
    hits = written(matched(urls.select("tokens").distinct(), found).select(F.col("tokens").alias("of"), "pattern"), "hits")
    own = urls.withColumn("given", given(F.col("host"), F.col("path"), rules)).join(bounded(hits, SMALL), F.col("tokens") == F.col("of"), "left")
    pattern = F.when(F.col("given").isNull(), F.col("pattern"))
    verdict = F.coalesce("given.verdict", F.when(pattern.isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return own.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), pattern.alias("pattern"))
