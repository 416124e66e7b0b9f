"""The operators' registered queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, exact_dedup, language_id, license_scan, near_join, packing, quality_model, quality_rules, token_count, url_filter
from quarry.llm.common import is_held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


#: A dated list for the pages' domains: list, pattern, action, day.
LIST_EVENTS = [
    ("adult", "adult-x.example.net", "add", "2024-01-01"),
    ("adult", "adult-x.example.net", "remove", "2024-05-01"),
    ("adult", "adult-x.example.net", "add", "2024-08-15"),
    ("pharma", "cheap-pills.example.com", "add", "2024-02-10"),
    ("pharma", "www.cheap-pills.example.com", "add", "2024-06-01"),
    ("pharma", "www.cheap-pills.example.com", "remove", "2024-06-20"),
    ("spam", "tionsh.example.net", "add", "2024-03-01"),
    ("spam", "tionsh.example.net", "remove", "2024-03-15"),
    ("spam", "blog.tionsh.example.net/en", "add", "2024-04-01"),
    ("spam", "m.ththth.example.net/de/", "add", "2024-07-01"),
    ("spam", "blog.tionble.example.com/es", "add", "2024-09-01"),
    ("spam", "blog.tionble.example.com/es", "remove", "2024-12-01"),
]


def list_events(spark: SparkSession) -> DataFrame:
    events = spark.createDataFrame(LIST_EVENTS, "list_id string, pattern string, action string, day string")
    return events.select("list_id", "pattern", "action", F.to_date("day").alias("at"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of fetch; the n-th page stands for a capture on the n-th day of 2024, modulo a year."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_at"))
    return url_filter.filtered(captures, list_events(spark))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; each stands for a file of its source, the short ones for licence files."""
    docs = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/a"), F.col("doc_id") % 7)).otherwise(F.concat(F.lit("/a"), F.col("doc_id") % 7, F.lit("/b"), F.col("doc_id") % 5))
    name = F.when(F.length("text") < 600, F.lit("/LICENSE")).otherwise(F.concat(F.lit("/f"), F.col("doc_id"), F.lit(".txt")))
    files = docs.select("doc_id", F.concat("source", folder, name).alias("path"), "text")
    return license_scan.scan(files, license_scan.known_templates(spark))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_groups(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_url_filter, op4_license_scan, op5_quality_classifier, op6_ngram_jaccard, op7_exact_dedup, op8_quality_rules, op9_best_fit_packing, op10_byte_bpe)}
_QUOTED = [(1000 * kind + i, name, text.replace("'", "''"), kind) for kind, some in enumerate((license_scan.TEMPLATES, license_scan.FURTHER)) for i, (name, text) in enumerate(some)]
_TEMPLATES = ", ".join(f"({i}, '{name}', '{text}', {kind})" for i, name, text, kind in _QUOTED)
_SPDX = ", ".join(f"('{i.lower()}', '{name}')" for name, some in license_scan.SPDX.items() for i in some)
_TOKENS = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[^a-z0-9.]+'), lambda x: rtrim(x, '.')), lambda x: x <> '')"
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in LIST_EVENTS)
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": rf"""
        WITH changes(list_id, pattern, action, day) AS (VALUES {_VALUES}),
        spans AS (SELECT list_id, pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY list_id, pattern ORDER BY day) AS valid_to FROM changes),
        t AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ':[0-9]*$', '')) AS host,
                     regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_at FROM pages),
        hits AS (SELECT page_id, count(*) AS n, min(list_id) AS first_list FROM t JOIN spans ON action = 'add' AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)
                 AND (host = pattern OR ends_with(host, '.' || pattern)
                      OR (contains(pattern, '/') AND (host || path = pattern OR starts_with(host || path, rtrim(pattern, '/') || '/'))))
                 GROUP BY page_id)
        SELECT page_id, url, host, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, first_list FROM t LEFT JOIN hits USING (page_id)""",
    "op4_license_scan": rf"""
        WITH t(tno, license, body, kind) AS (VALUES {_TEMPLATES}),
        tf AS (SELECT kind, tno, license, term, count(*) AS tf FROM (SELECT kind, tno, license, unnest({_TOKENS.format('body')}) AS term FROM t) GROUP BY ALL),
        nk AS (SELECT kind, count(*) AS n FROM t GROUP BY kind),
        idf AS (SELECT kind, term, ln((1.0 + n) / (1 + count(DISTINCT tno))) + 1 AS idf FROM tf JOIN nk USING (kind) GROUP BY kind, term, n),
        tw AS (SELECT kind, tno, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tno)) AS w FROM tf JOIN idf USING (kind, term)),
        files AS (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/a' || doc_id % 7 ELSE '/a' || doc_id % 7 || '/b' || doc_id % 5 END
        || CASE WHEN length(text) < 600 THEN '/LICENSE' ELSE '/f' || doc_id || '.txt' END AS path, text FROM documents),
        ln0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_TOKENS.format('l')}), lambda l: len(l) > 0) AS ls FROM files),
        st AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ln0),
        runs AS (SELECT doc_id, flatten(ls[i:j]) AS terms FROM (SELECT doc_id, ls, i, unnest(range(i, least(i + {license_scan.RUN}, len(ls) + 1))) AS j FROM st)),
        blocks AS (SELECT doc_id, {_TOKENS.format('b')} AS terms FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\n[^a-z0-9\n]*\n[^a-z0-9]*')) AS b FROM files)),
        whole AS (SELECT doc_id, {_TOKENS.format('text')} AS terms FROM files WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{license_scan.LICENCE_FILE}')),
        units AS (SELECT doc_id, array_to_string(terms, ' ') AS u FROM (SELECT * FROM runs UNION ALL SELECT * FROM blocks UNION ALL SELECT * FROM whole)),
        du AS MATERIALIZED (SELECT u, row_number() OVER () AS uid FROM (SELECT DISTINCT u FROM units WHERE u <> '')),
        c AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(string_split(u, ' ')) AS term FROM du) GROUP BY ALL),
        x AS (SELECT uid, kind, term, tf * coalesce(idf, ln(1.0 + n) + 1) AS x FROM c CROSS JOIN nk LEFT JOIN idf USING (kind, term)),
        nm AS (SELECT uid, kind, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
        dots AS (SELECT uid, kind, tno, license, sum(x * w) AS dot FROM x JOIN tw USING (kind, term) GROUP BY ALL),
        near AS (SELECT u, license, round(dot / norm, 6) AS cosine FROM dots JOIN nm USING (uid, kind) JOIN du USING (uid) WHERE round(dot / norm, 6) >= 0.7),
        spdx(id, license) AS (VALUES {_SPDX}),
        tags AS (SELECT doc_id, license, 1.0::DOUBLE AS cosine FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(tag), '[^a-z0-9.+\-]+')) AS id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{license_scan.SPDX_TAG}', 1)) AS tag FROM files)) JOIN spdx USING (id)),
        best AS (SELECT doc_id, license AS own_license, cosine AS similarity FROM (SELECT doc_id, license, cosine FROM units JOIN near USING (u) UNION ALL SELECT doc_id, license, cosine FROM tags)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
        f AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, similarity FROM files LEFT JOIN best USING (doc_id)),
        d AS (SELECT dir AS up, own_license AS dir_license FROM f WHERE own_license IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{license_scan.LICENCE_FILE}')
              QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, own_license) = 1),
        n AS (SELECT f.dir, arg_max(up, length(up)) AS up, arg_max(dir_license, length(up)) AS dir_license FROM (SELECT DISTINCT dir FROM f) AS f JOIN d ON f.dir = up OR up = '' OR starts_with(f.dir, up || '/') GROUP BY f.dir)
        SELECT doc_id, path, own_license, similarity, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN up END AS inherited_from FROM f LEFT JOIN n USING (dir)""",
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h)""",
}
