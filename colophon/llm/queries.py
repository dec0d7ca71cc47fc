"""The queries of this subpackage, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colophon.llm import chat, lines, media, mixing, packing, phrases, quality, rules, search, simhash, tokens, toxicity, urls
from colophon.llm.common import documents, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir), keep_media=False).drop("tile", "media")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), vocabulary())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    return chat.format_conversations(conversations.union(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: Rules given for urls: host and start of the path, verdict.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the pages are those that the table has for their ids: toxic or of bad quality is to be blocked."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id page_id", "coalesce(toxic = 1, false) or coalesce(quality = 0, false) blocked")
    return urls.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_token_counts, op3_toxicity, op4_quality_classifier, op5_simhash_near_dedup, op6_line_dedup, op7_mixing_sources, op8_chat_formatting, op9_quality_rules, op10_best_fit_packing, op11_ranked_search, op12_url_filters, op13_phrase_mining)}
#: A-Z made small, and no other letter; terms as runs of what isn't a sign.
_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLES: dict[str, str] = {
    "op8_chat_formatting": r"""
        SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
            coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) loss_sha256,
            sum(17 + 2 * length(role) - length(translate(role, '\<>', '')) + 2 * length(text) - length(translate(text, '\<', '')))::BIGINT formatted_chars
        FROM (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        GROUP BY conv_id""",
    "op11_ranked_search": rf"""
        WITH texts AS (SELECT doc_id, regexp_extract_all({_SMALL.format("text")}, '{_TERM}') AS ts FROM documents),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_SMALL.format("text")}, '{_TERM}')) AS t FROM benchmark),
        whole AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS nd, coalesce(sum(len(ts)), 0)::BIGINT AS l FROM texts),
        found AS (SELECT doc_id, len(ts)::BIGINT AS n, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM texts) GROUP BY doc_id, ts, t),
        weights AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, whole GROUP BY t, nd),
        sums AS (SELECT item_id, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * nd // l))))::BIGINT AS score
                 FROM asked JOIN found USING (t) JOIN weights USING (t), whole GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM sums WHERE score > 0
        QUALIFY rank <= 10""",
    "op12_url_filters": rf"""
        WITH parts AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        named AS (SELECT page_id, url, rest, coalesce({_SMALL.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
        cut AS (SELECT *, string_split(host, '.') AS labels, list_sort(list_distinct(list_transform(string_split(coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: regexp_extract(x, '^[^=]*')))) AS names FROM named),
        kinds AS (SELECT page_id, host, path, list_sort(list_filter(CASE WHEN rest IS NULL THEN [] ELSE [
            'scheme=' || nullif({_SMALL.format("regexp_extract(url, '^(.*?)://', 1)")}, ''), 'top=' || nullif(labels[-1], ''),
            CASE WHEN len(labels) > 1 THEN 'site=' || nullif(array_to_string(labels[-2:], '.'), '') END,
            CASE WHEN len(labels) > 2 THEN 'host=' || nullif(host, '') END, CASE WHEN len(labels) > 2 THEN 'sub=' || nullif(labels[1], '') END,
            'dir=' || nullif(regexp_extract(path, '^/([^/]*)/', 1), ''), 'ext=' || nullif(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1), ''),
            'query=' || nullif(array_to_string(names, ','), ''), CASE WHEN contains(rest, '#') THEN 'fragment' END] END, lambda x: x IS NOT NULL)) AS tokens FROM cut),
        marks AS (SELECT doc_id AS page_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS blocked FROM labels GROUP BY 1),
        learned AS (SELECT tokens, blocked, row_number() OVER () AS i FROM kinds JOIN marks USING (page_id)),
        subsets AS (SELECT i, blocked, list_filter(tokens, lambda x, k: (m >> (k - 1)) & 1 = 1) AS part FROM (SELECT *, unnest(range(1, (1 << len(tokens))::BIGINT)) AS m FROM learned)),
        rules AS (SELECT part, count(*) FILTER (blocked) / count(*) AS confidence, count(*) FILTER (blocked) AS n FROM subsets GROUP BY part
                  HAVING count(*) FILTER (blocked) >= greatest(20, (SELECT ceil(0.005 * count(*)) FROM learned)) AND count(*) FILTER (blocked) / count(*) >= 0.6),
        shortest AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules o WHERE len(o.part) < len(r.part) AND list_has_all(r.part, o.part))),
        fits AS (SELECT page_id, host, path, (SELECT max(row(confidence, n, array_to_string(part, ' '))) FROM shortest WHERE list_has_all(tokens, part)) AS best,
            CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM kinds)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN best IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
            CASE WHEN rule IS NULL THEN best[3] END AS pattern FROM fits""",
    "op13_phrase_mining": rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_SMALL.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
        spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        grams AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM spots),
        sums AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang),
        f1 AS (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
        f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        twos AS (SELECT lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
                 FROM f2 c JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2) LEFT JOIN longer o USING (lang, w1, w2)
                 WHERE c.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * c.f)),
        cuts AS (SELECT lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, x.f AS l1, p.f AS l2, q.f AS r1, y.f AS r2,
                 (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * q.f))::BIGINT AS s1, (1000000::HUGEINT * c.f * c.f // (p.f::HUGEINT * y.f))::BIGINT AS s2
                 FROM f3 c JOIN f1 x USING (lang, w1) JOIN f2 p USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM f2) q USING (lang, w2, w3) JOIN (SELECT lang, w1 AS w3, f FROM f1) y USING (lang, w3)),
        found AS (SELECT * FROM twos UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM found JOIN sums USING (lang) QUALIFY rank <= 2000""",
}
