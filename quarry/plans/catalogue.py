"""All registered queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.functions import word64
from quarry.operators import blobs, columnar, corpus, density, dictionary, ordered, profile, provenance, router, segment, sequences, shapes, twins
from quarry.sources.storage import spool, table, vault_get, vault_put

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL building blocks: lines and fields with their addresses
LINES = r"""l AS (SELECT doc_id, source, unnest(a) AS line, unnest(range(len(a))) AS line_no
    FROM (SELECT doc_id, source, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS a FROM documents))"""
FIELDS = LINES + r""", f AS (SELECT doc_id, line_no, unnest(a) AS value, unnest(range(len(a))) AS field_idx
    FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[,; \t|:]+|\n+|[^,; \t|:\n]+') AS a FROM l))"""
SIG = r"translate(regexp_replace(regexp_replace(line, '[^,; \t|:\n]+', 'x', 'g'), '[,; \t|:]+', 's', 'g'), 'xs' || chr(10), '102')"
VARINT = "CASE WHEN ({0}) < 128 THEN 1 WHEN ({0}) < 16384 THEN 2 WHEN ({0}) < 2097152 THEN 3 WHEN ({0}) < 268435456 THEN 4 ELSE 5 END"
HEXBYTES = "regexp_extract_all(hex(encode({0})), '[0-9A-F]{{2}}')"
#: Common prefix in bytes of two strings.
LCP = "coalesce(list_position(list_transform(range(1, least(strlen({0}), strlen({1})) + 1), lambda i: substr(hex(encode({0})), 2 * i - 1, 2) <> substr(hex(encode({1})), 2 * i - 1, 2)), true) - 1, least(strlen({0}), strlen({1})))"


def register(sql: str | None = None):
    """The function under its own name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def doc_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return segment.lines(table(spark, sf_dir, "documents").select("doc_id", *more, "text"))


# ---- segmentation ----


@register(f"WITH {LINES} SELECT doc_id, line_no, line FROM l")
def line_split(spark, sf_dir):
    return doc_lines(spark, sf_dir)


@register(r"""SELECT doc_id, unnest(range(len(a))) AS stanza_no, unnest(a) AS stanza
    FROM (SELECT doc_id, regexp_extract_all(text, '(?s).+?\n\n|(?s).+$') AS a FROM documents)""")
def stanza_split(spark, sf_dir):
    return segment.stanzas(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register(f"""WITH {FIELDS} SELECT doc_id, count(*) AS n_fields, sum(strlen(value))::BIGINT AS n_bytes, count(*) FILTER (regexp_matches(value, '^[,; \\t|:]')) AS n_separators,
    count(*) FILTER (regexp_matches(value, '^\\n')) AS n_newlines, max(field_idx) AS last_idx FROM f GROUP BY doc_id""")
def field_tokens(spark, sf_dir):
    f = segment.fields(doc_lines(spark, sf_dir))
    return f.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_fields"), F.sum(F.octet_length("value")).cast("long").alias("n_bytes"), F.sum((F.col("class") == 0).cast("long")).alias("n_separators"),
        F.sum((F.col("class") == 2).cast("long")).alias("n_newlines"), F.max("field_idx").cast("long").alias("last_idx"),
    )


@register(r"""SELECT page_id, unnest(range(len(a))) AS field_idx, unnest(a) AS value FROM (SELECT page_id, regexp_extract_all(url, '[,; \t|:]+|\n+|[^,; \t|:\n]+') AS a FROM pages)""")
def url_fields(spark, sf_dir):
    return segment.fields(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "field_idx", "value")


@register(r"""SELECT event_id, unnest(range(len(a))) AS field_idx, unnest(a) AS value FROM (SELECT event_id, regexp_extract_all(props, '[,; \t|:]+|\n+|[^,; \t|:\n]+') AS a FROM events)""")
def event_fields(spark, sf_dir):
    return segment.fields(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "field_idx", "value")


_CLASS_SQL = ", ".join(f"length(text) - length(regexp_replace(text, '{p}', '', 'g')) AS n_{c}" for c, p in (fn.CHAR_CLASSES | {"wide": r"[^\x00-\x7F]"}).items())


@register(f"SELECT doc_id, {_CLASS_SQL} FROM documents")
def class_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(fn.count_of(F.col("text"), p).cast("long").alias(f"n_{c}") for c, p in fn.CHAR_CLASSES.items()))


_BLOCKS = r"""b AS (SELECT page_id, unnest(range(0, greatest(strlen(html), 1), 4096)) // 4096 AS block_no, hex(encode(html)) AS h FROM pages WHERE strlen(html) > 0)"""


@register(f"WITH {_BLOCKS} SELECT page_id, block_no, length(substr(h, 8192 * block_no + 1, 8192)) // 2 AS n_bytes, md5(substr(h, 8192 * block_no + 1, 8192)) AS digest FROM b")
def block_split(spark, sf_dir):
    """Blocks of 4 KiB, so that a page has several."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    return segment.blocks(pages, "body", 4096).select("page_id", "block_no", F.octet_length("block").cast("long").alias("n_bytes"), F.md5(F.hex("block").cast("binary")).alias("digest"))


@register("""WITH t AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents), o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS start, sum(n) OVER () AS total FROM t)
    SELECT doc_id, start::BIGINT AS start, n, CASE WHEN start < (total % 8) * (total // 8 + 1) THEN start // (total // 8 + 1) ELSE total % 8 + (start - (total % 8) * (total // 8 + 1)) // greatest(total // 8, 1) END::BIGINT AS chunk FROM o""")
def chunk_plan(spark, sf_dir):
    """Running offsets of documents, and which of 8 even chunks each begins in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    total = docs.agg(F.sum("n")).first()[0] or 0
    base, rest = total // 8, total % 8
    rows = ordered.ranked(docs, ["doc_id"], {"start": "n"})
    long = rest * (base + 1)
    start = F.col("start")
    chunk = F.when(start < long, F.floor(start / (base + 1))).otherwise(rest + F.floor((start - long) / max(base, 1)))
    return rows.select("doc_id", "start", "n", chunk.cast("long").alias("chunk"))


# ---- predicates and profiles ----

_PRINT = r"strlen({0}) - strlen(regexp_replace({0}, '[\x20-\x7E\n\t\r]', '', 'g'))"


@register(" UNION ALL ".join(f"SELECT '{t}' AS source_table, {k} AS id, strlen({c}) AS n_bytes, {_PRINT.format(c)} AS n_printable, contains({c}, chr(0)) AS has_nul, NOT contains({c}, chr(0)) AND ({_PRINT.format(c)}) * 100 >= strlen({c}) * 85 AS accepted FROM {t}" for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))))
def printable_ratio(spark, sf_dir):
    parts = [profile.printable_profile(table(spark, sf_dir, t), k, c).select(F.lit(t).alias("source_table"), F.col(k).alias("id"), "n_bytes", "n_printable", "has_nul", "accepted") for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))]
    return parts[0].unionByName(parts[1])


_LINE_ARRAY = r"regexp_extract_all(text, '[^\n]*\n|[^\n]+')"
_COUNTS = r"list_transform(a, lambda x: len(regexp_extract_all(x, '[,; \t|:]+|\n+|[^,; \t|:\n]+')))"


@register(f"""WITH t AS (SELECT doc_id, strlen(text)::BIGINT AS n_bytes, {_LINE_ARRAY} AS a FROM documents),
    s AS (SELECT doc_id, n_bytes, len(a)::BIGINT AS n_lines, coalesce(list_max({_COUNTS}), 0)::BIGINT AS max_fields, coalesce(list_max(list_transform(a, lambda x: strlen(x))), 0)::BIGINT AS longest FROM t)
    SELECT *, n_lines > 0 AND n_bytes BETWEEN 8 * n_lines AND 4096 * n_lines AND n_bytes >= 4096 AND n_lines >= 64 AS column_gate, longest <= 4096 AND n_bytes >= 4096 AND n_lines >= 64 AS record_gate,
           n_lines > 0 AND n_bytes BETWEEN 8 * n_lines AND 4096 * n_lines AND n_bytes >= 1048576 AND n_lines >= 256 AS shape_gate FROM s""")
def line_stats(spark, sf_dir):
    return profile.line_stats(table(spark, sf_dir, "documents"), "doc_id")


@register(f"""WITH t AS (SELECT doc_id, text, list_transform({_COUNTS}, lambda n: least(n, 64)) AS c FROM (SELECT doc_id, text, {_LINE_ARRAY} AS a FROM documents)),
    e AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest(c) AS v FROM t) GROUP BY ALL), m AS (SELECT doc_id, arg_max(v, n * 100 - v) AS modal_fields, max(n) AS modal_lines FROM e GROUP BY doc_id),
    s AS (SELECT doc_id, len(c)::BIGINT AS n_lines, modal_fields::BIGINT AS modal_fields, coalesce(modal_lines, 0) AS modal_lines, strlen(text) - strlen(regexp_replace(text, '[,; \\t|:]', '', 'g')) AS separator_bytes, strlen(text) AS n_bytes FROM t LEFT JOIN m USING (doc_id))
    SELECT *, modal_lines * 100 >= n_lines * 90 AND separator_bytes * 100 >= n_bytes * 8 AND n_lines > 0 AS columnar FROM s""")
def modal_field_share(spark, sf_dir):
    return profile.modal_fields(table(spark, sf_dir, "documents"), "doc_id")


#: Tables as columns of text: name, order, columns.
TABLES = {
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "events": ("event_id", ["event_id", "user_id", "event_type", "props", "stamp"]),
}


def stamp() -> Column:
    """An event's time as text, to the millisecond."""
    return fn.format_ts(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") + fn.EPOCH_MS)


def long_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, (order, columns) in TABLES.items():
        rows = table(spark, sf_dir, name)
        long = profile.as_columns(rows.withColumn("stamp", stamp()) if "stamp" in columns else rows, order, columns)
        parts.append(long.select(F.concat(F.lit(f"{name}."), "column").alias("column"), F.col("at").cast("long").alias("at"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_STAMP = "strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
_LONG = "c AS (" + " UNION ALL ".join(f"SELECT '{t}.{c}' AS col, {o}::BIGINT AS at_row, {_STAMP if c == 'stamp' else c}::VARCHAR AS value FROM {t}" for t, (o, cs) in TABLES.items() for c in cs) + ")"
_MS = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[.][0-9]{{3}}Z') THEN epoch_us(try_strptime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')) // 1000 END"


@register(f'WITH {_LONG} SELECT col AS "column", count(*) AS n_rows, count(DISTINCT value) AS n_distinct, count(DISTINCT value) = 1 AS is_const, count(DISTINCT value) <= 256 AS is_dict FROM c GROUP BY col')
def column_const_dict(spark, sf_dir):
    return profile.distinct_profile(long_columns(spark, sf_dir))


@register(f"""WITH {_LONG}, p AS (SELECT col, value, lag(value) OVER (PARTITION BY col ORDER BY at_row) AS prev FROM c),
    y AS (SELECT col, value, prev, strlen(value) AS n, CASE WHEN prev IS NULL THEN 0 ELSE {LCP.format('value', 'prev')} END AS k, {_MS.format('value')} AS ms, {_MS.format('value')} - {_MS.format('prev')} AS delta FROM p),
    x AS (SELECT *, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS zz FROM y),
    s AS (SELECT col, count(*) AS n_rows, count(DISTINCT value) AS n_distinct, sum({VARINT.format('n')} + n)::BIGINT AS raw_cost,
                 sum(CASE WHEN prev IS NULL THEN {VARINT.format('n')} + n ELSE {VARINT.format('k')} + {VARINT.format('n - k')} + n - k END)::BIGINT AS prefix_cost,
                 min(CASE WHEN regexp_matches(value, '^[0-9]+$') AND regexp_matches(prev, '^[0-9]+$') THEN try_cast(value AS BIGINT) - try_cast(prev AS BIGINT) END) AS lo,
                 max(CASE WHEN regexp_matches(value, '^[0-9]+$') AND regexp_matches(prev, '^[0-9]+$') THEN try_cast(value AS BIGINT) - try_cast(prev AS BIGINT) END) AS hi,
                 bool_and(coalesce(try_cast(value AS BIGINT)::VARCHAR = value, false) AND regexp_matches(value, '^[0-9]+$')) AS plain,
                 CASE WHEN bool_and(ms IS NOT NULL AND (prev IS NULL OR coalesce(abs(delta) <= 1073741824, false))) THEN sum(CASE WHEN prev IS NULL THEN {VARINT.format('n')} + n ELSE {VARINT.format('zz')} END)::BIGINT END AS ts_cost FROM x GROUP BY col)
    SELECT col AS "column", n_rows, n_distinct, raw_cost, prefix_cost, ts_cost, CASE WHEN n_distinct = 1 THEN 'const' WHEN plain AND lo = hi THEN 'seq' WHEN n_distinct <= 256 THEN 'dict' WHEN ts_cost <= prefix_cost AND ts_cost < raw_cost THEN 'ts' WHEN prefix_cost < raw_cost THEN 'prefix' ELSE 'raw' END AS codec FROM s""")
def column_codec(spark, sf_dir):
    return profile.column_codecs(long_columns(spark, sf_dir))


@register("""WITH k AS (SELECT 'orders' AS t, o_orderkey AS v FROM orders UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem),
    d AS (SELECT t, v, v - lag(v) OVER (PARTITION BY t ORDER BY v) AS step FROM k)
    SELECT t AS source_table, count(*) AS n_rows, min(v) AS first, min(step) AS least_step, max(step) AS most_step, coalesce(min(step) = max(step), false) AS is_sequence FROM d GROUP BY t""")
def column_sequence(spark, sf_dir):
    """Whether sorted keys advance by one step (W4); by ranges, without a window over a whole table."""
    keys = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey", "lineitem": "l_orderkey"}
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), F.col(k).alias("v")) for t, k in keys.items()]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    rows = ordered.with_previous(ordered.ranked(rows, ["source_table", "v"]), ["v"], ["source_table"])
    step = F.col("v") - F.col("prev_v")
    found = rows.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_rows"), F.min("v").alias("first"), F.min(step).alias("least_step"), F.max(step).alias("most_step"))
    return found.withColumn("is_sequence", F.coalesce(F.col("least_step") == F.col("most_step"), F.lit(False)))


_EPOCH = "719162::BIGINT * 86400000"


@register(f"""WITH d AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events), s AS (SELECT event_id, ms, ms - lag(ms) OVER (ORDER BY event_id) AS delta FROM d), z AS (SELECT *, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS zz FROM s)
    SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp, ms + {_EPOCH} AS since_0001, delta, zz AS zigzag, {VARINT.format('zz')} AS cost FROM z""")
def ts_delta(spark, sf_dir):
    """Steps of the events' times in milliseconds, zigzag coded."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = ordered.with_previous(ordered.ranked(table(spark, sf_dir, "events").select("event_id", ms.alias("ms")), ["event_id"]), ["ms"])
    delta = F.col("ms") - F.col("prev_ms")
    since = F.col("ms") + fn.EPOCH_MS
    zz = fn.zigzag(delta)
    return rows.select("event_id", fn.format_ts(since).alias("stamp"), since.alias("since_0001"), delta.alias("delta"), zz.alias("zigzag"), fn.varint_len(zz).alias("cost"))


@register("""WITH u AS (SELECT 'customer' AS source_table, c_custkey AS id, c_name AS value FROM customer UNION ALL SELECT 'pages', page_id, url FROM pages),
    r AS (SELECT source_table, id, value, regexp_extract_all(value, '[0-9]+') AS a FROM u)
    SELECT source_table, id, list_filter(a, lambda x: length(x) = list_max(list_transform(a, lambda y: length(y))))[1] AS digits FROM r""")
def digit_run(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), F.col(k).alias("id"), fn.longest_digits(F.col(c)).alias("digits")) for t, k, c in (("customer", "c_custkey", "c_name"), ("pages", "page_id", "url"))]
    return parts[0].unionByName(parts[1])


@register("""WITH h AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN md5(o_orderkey::VARCHAR) WHEN 1 THEN upper(md5(o_orderkey::VARCHAR)) WHEN 2 THEN substr(md5(o_orderkey::VARCHAR), 1, 9) ELSE o_orderkey::VARCHAR || '-' || o_orderpriority END AS v FROM orders),
    n AS (SELECT id, v, length(v) AS n, length(regexp_replace(v, '[^0-9]', '', 'g')) AS d, length(regexp_replace(v, '[^a-f]', '', 'g')) AS lo, length(regexp_replace(v, '[^A-F]', '', 'g')) AS up FROM h)
    SELECT id, v AS value, CASE WHEN n >= 10 AND d >= 2 AND lo * 10 >= n * 3 AND (lo + d) * 20 >= n * 17 THEN 'lower' WHEN n >= 10 AND d >= 2 AND up * 10 >= n * 3 AND (up + d) * 20 >= n * 17 THEN 'upper' ELSE 'none' END AS lane FROM n""")
def hex_lane(spark, sf_dir):
    key = F.col("o_orderkey")
    digest = F.md5(key.cast("string").cast("binary"))
    value = F.when(key % 4 == 0, digest).when(key % 4 == 1, F.upper(digest)).when(key % 4 == 2, F.substring(digest, 1, 9)).otherwise(F.concat(key.cast("string"), F.lit("-"), "o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), value.alias("value"))
    return rows.select("id", "value", fn.hex_lane(F.col("value")).alias("lane"))


@register("""SELECT event_id, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS varint, lpad(v::VARCHAR, greatest(12, length(v::VARCHAR))::INTEGER, '0') AS padded, least(v, 28) AS bucket,
    v >> 4 AS high, v & 15 AS low, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back, lower(lpad(hex(event_id::UBIGINT), 16, '0')) || lower(lpad(hex(user_id::UBIGINT), 16, '0')) || '.obj' AS object_name,
    lower(event_type) AS folded, strpos('0123456789abcdef', substr(md5(event_id::VARCHAR), 1, 1)) - 1 AS first_hex
    FROM (SELECT *, event_id * 7919 AS v, (event_id % 1000 + 1) / 1002.0 AS p FROM events)""")
def scalar_functions(spark, sf_dir):
    """F3, F11-F13, F19-F22, G11 over the events."""
    v, p = F.col("v"), F.col("p")
    rows = table(spark, sf_dir, "events").withColumn("v", F.col("event_id") * 7919).withColumn("p", (F.col("event_id") % 1000 + 1).cast("double") / 1002.0)
    return rows.select(
        "event_id", fn.varint_len(v).alias("varint"), fn.padded(v, F.lit(12)).alias("padded"), fn.bucket_len(v).alias("bucket"), F.shiftright(v, 4).alias("high"), v.bitwiseAND(F.lit(15)).alias("low"),
        F.round(fn.stretch(p), 6).alias("logit"), F.round(fn.squash(fn.stretch(p)), 6).alias("back"), fn.object_name(F.col("event_id"), F.col("user_id")).alias("object_name"), fn.fold_case(F.col("event_type")).alias("folded"),
        fn.hex_value(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 1)).cast("long").alias("first_hex"),
    )


# ---- dictionaries ----


@register(f"WITH {LINES} SELECT line, count(*) AS n, min(doc_id) AS first_doc, arg_min(line_no, doc_id * 1000000 + line_no) AS first_line FROM l GROUP BY line")
def duplicate_lines(spark, sf_dir):
    found = dictionary.distinct_records(doc_lines(spark, sf_dir), ["doc_id", "line_no"], "line")
    return found.select("line", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


@register(f"""WITH {LINES}, o AS (SELECT source, line, row_number() OVER w - 1 AS place, coalesce(sum(strlen(line)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WINDOW w AS (PARTITION BY source ORDER BY doc_id, line_no)),
    h AS (SELECT source, count(*) AS seen, count(*) - count(DISTINCT line) AS duplicates FROM o WHERE place < 8192 AND before < 1048576 GROUP BY source)
    SELECT *, seen >= 1024 AND duplicates * 8 < seen AS rejected FROM h""")
def dup_probe(spark, sf_dir):
    return dictionary.probe(doc_lines(spark, sf_dir, "source"), "source", ["doc_id", "line_no"], "line")


@register(rf"""WITH {LINES}, c AS (SELECT conv_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line FROM conversations),
    a AS (SELECT 'documents' AS source_table, line FROM l UNION ALL SELECT 'conversations', line FROM c), e AS (SELECT source_table, line, count(*) AS n FROM a GROUP BY ALL)
    SELECT source_table, sum(n)::BIGINT AS n_records, count(*) AS n_distinct, sum((n - 1) * strlen(line))::BIGINT AS saved_bytes, count(*) * 3 <= sum(n) * 2 AS profitable FROM e GROUP BY source_table""")
def dedup_profit(spark, sf_dir):
    turns = segment.lines(table(spark, sf_dir, "conversations").select("conv_id", "text"))
    rows = doc_lines(spark, sf_dir).select(F.lit("documents").alias("source_table"), "line").union(turns.select(F.lit("conversations"), "line"))
    return dictionary.profit(rows, "source_table", "line")


@register(f"""WITH {LINES}, d AS (SELECT DISTINCT line FROM l), p AS (SELECT line, row_number() OVER (ORDER BY encode(line)) - 1 AS id, lag(line) OVER (ORDER BY encode(line)) AS prev FROM d),
    x AS (SELECT line, id, CASE WHEN prev IS NULL THEN 0 ELSE {LCP.format('line', 'prev')} END AS lcp FROM p)
    SELECT line, id, lcp, strlen(line) - lcp AS suffix, {VARINT.format('lcp')} + {VARINT.format('strlen(line) - lcp')} + strlen(line) - lcp AS cost FROM x""")
def line_dictionary(spark, sf_dir):
    return dictionary.dictionary(doc_lines(spark, sf_dir), "line")


@register(f"""WITH {LINES}, d AS (SELECT line, min(doc_id * 1000000 + line_no) AS first FROM l GROUP BY line), r AS (SELECT line, row_number() OVER (ORDER BY encode(line)) - 1 AS id, row_number() OVER (ORDER BY first) - 1 AS seen FROM d)
    SELECT doc_id, line_no, id, seen FROM l JOIN r USING (line)""")
def dictionary_index(spark, sf_dir):
    """Of every line its rank in the dictionary and its place in first-seen order."""
    rows = spool(doc_lines(spark, sf_dir))
    first = dictionary.distinct_records(rows, ["doc_id", "line_no"], "line")
    seen = ordered.ranked(first.select("line", "first.doc_id", "first.line_no"), ["doc_id", "line_no"]).select("line", F.col("pos").alias("seen"))
    both = ordered.ranked(seen, ["line"]).select("line", F.col("pos").alias("id"), "seen")
    return rows.join(both, "line").select("doc_id", "line_no", "id", "seen")


@register(f"""WITH d AS (SELECT DISTINCT url FROM pages), p AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS id, lag(url) OVER (ORDER BY url) AS prev FROM d), x AS (SELECT url, id, CASE WHEN prev IS NULL THEN 0 ELSE {LCP.format('url', 'prev')} END AS lcp FROM p)
    SELECT url, id, lcp, strlen(url) - lcp AS suffix, {VARINT.format('lcp')} + {VARINT.format('strlen(url) - lcp')} + strlen(url) - lcp AS cost FROM x""")
def front_coding_cost(spark, sf_dir):
    return dictionary.dictionary(table(spark, sf_dir, "pages"), "url")


@register("SELECT doc_id, sha256(text) AS digest FROM documents UNION ALL SELECT * FROM (VALUES (-1, sha256('')), (-2, NULL)) AS t(doc_id, digest)")
def dedup_roundtrip(spark, sf_dir):
    """Documents, an empty one and a null one put back together from their line dictionary and index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, ""), (-2, None)], "doc_id long, text string"))
    archive = {k: spool(v) for k, v in dictionary.encode_lines(docs).items()}
    return dictionary.decode_lines(archive).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# ---- byte statistics ----

_BYTES = f"b AS (SELECT doc_id, unnest({HEXBYTES.format('text')}) AS h FROM documents)"


@register(f"WITH {_BYTES} SELECT ('0x' || h)::INTEGER AS byte, count(*) AS n FROM b GROUP BY h")
def byte_histogram(spark, sf_dir):
    return density.byte_counts(table(spark, sf_dir, "documents").select("text"), [])


_ENTROPY = "round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 6) AS bits"


@register(f"WITH {_BYTES}, c AS (SELECT doc_id, h, count(*) AS n FROM b GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS n_bytes, {_ENTROPY} FROM c GROUP BY doc_id")
def doc_entropy(spark, sf_dir):
    return density.entropy(density.byte_counts(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


@register(f"""WITH b AS (SELECT page_id, strlen(html) AS n, unnest({HEXBYTES.format('html')}[:65536]) AS h FROM pages), c AS (SELECT page_id, n AS n_block, h, count(*) AS n FROM b GROUP BY ALL)
    SELECT page_id, 0 AS block_no, n_block AS n_bytes, {_ENTROPY}, n_block >= 4096 AND log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n) > 7.6 AS dense FROM c GROUP BY page_id, n_block""")
def dense_blocks(spark, sf_dir):
    return router.block_verdicts(table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body")), "page_id", "body")


def _order_k(k: int) -> str:
    before = " || ".join(f"lag(h, {i}) OVER w" for i in range(k, 0, -1))
    return f"""a AS (SELECT doc_id, unnest(a) AS h, unnest(range(len(a))) AS pos FROM (SELECT doc_id, {HEXBYTES.format('text')} AS a FROM documents)),
        b AS (SELECT {before} AS ctx, h AS byte FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), k AS (SELECT ctx, byte, count(*) AS n FROM b WHERE ctx IS NOT NULL GROUP BY ALL)"""


@register(f"WITH {_order_k(1)} SELECT ctx, byte, n FROM k")
def order_k_counts(spark, sf_dir):
    return density.context_counts(table(spark, sf_dir, "documents").select("text"), 1)


@register(f"WITH {_order_k(2)}, t AS (SELECT ctx, sum(n) AS m, sum(n * log2(n::DOUBLE)) AS s FROM k GROUP BY ctx) SELECT sum(m)::BIGINT AS n, round(sum(m * log2(m::DOUBLE) - s) / sum(m), 6) AS bits FROM t")
def cond_entropy(spark, sf_dir):
    return density.conditional_entropy(density.context_counts(table(spark, sf_dir, "documents").select("text"), 2))


@register(f"WITH {_order_k(3)}, t AS (SELECT ctx, sum(n)::BIGINT AS n_ctx FROM k GROUP BY ctx) SELECT ctx, byte, n, n_ctx FROM k JOIN t USING (ctx) WHERE n_ctx >= 15 AND n * 4096 > n_ctx * 3968")
def certain_contexts(spark, sf_dir):
    return density.certain(density.context_counts(table(spark, sf_dir, "documents").select("text"), 3))


# ---- shapes ----


@register(f"WITH {LINES} SELECT {SIG} AS sig, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes, min(doc_id) AS first_doc, count(*) >= 128 AS eligible FROM l GROUP BY sig")
def signature_groups(spark, sf_dir):
    found = shapes.groups(doc_lines(spark, sf_dir), ["doc_id", "line_no"])
    return found.select("sig", "n_lines", "n_bytes", F.col("first.doc_id").alias("first_doc"), "eligible")


@register(f"""WITH {LINES}, g AS (SELECT {SIG} AS sig, count(*) AS n, sum(strlen(line)) AS b FROM l GROUP BY sig), v AS (SELECT count(*) AS n_shapes, coalesce(sum(b) FILTER (n >= 128), 0)::BIGINT AS covered_bytes, coalesce(sum(b), 0)::BIGINT AS n_bytes FROM g)
    SELECT *, n_shapes <= 64 AND covered_bytes * 100 >= n_bytes * 70 AS accepted FROM v""")
def signature_verdict(spark, sf_dir):
    return shapes.verdict(shapes.groups(doc_lines(spark, sf_dir), ["doc_id", "line_no"]))


@register(f"WITH {LINES}, s AS (SELECT doc_id, line_no, {SIG} AS sig FROM l) SELECT doc_id, line_no, sig FROM s WHERE sig NOT IN (SELECT sig FROM s GROUP BY sig HAVING count(*) >= 128)")
def signature_residue(spark, sf_dir):
    rows = spool(doc_lines(spark, sf_dir))
    return shapes.residue(rows, shapes.groups(rows, ["doc_id", "line_no"])).select("doc_id", "line_no", "sig")


@register(f"WITH {LINES} SELECT doc_id, line_no, line FROM l")
def order_replay(spark, sf_dir):
    """Lines stored by shape and put back in order."""
    archive = {k: spool(v) for k, v in shapes.encode(doc_lines(spark, sf_dir), ["doc_id", "line_no"]).items()}
    return shapes.decode(archive, ["doc_id", "line_no"])


# ---- columns ----

_CSV = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) || chr(10)"


@register(f"SELECT o_orderkey AS at, {_CSV} AS line FROM orders".replace("AS at", 'AS "at"'))
def columnar_roundtrip(spark, sf_dir):
    """Orders as lines of text, lexed, encoded by column and decoded."""
    line = F.concat(F.concat_ws(",", *(F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))), F.lit("\n"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("line"))
    archive = {k: spool(v) for k, v in columnar.encode(columnar.columns_of_lines(lines)).items()}
    return columnar.lines_of_columns(columnar.decode(archive))


# ---- twins ----


@register(f"WITH {LINES} SELECT doc_id, line_no, lag(line_no) OVER (PARTITION BY doc_id, line ORDER BY line_no) AS twin FROM l")
def line_twin(spark, sf_dir):
    return twins.line_twins(table(spark, sf_dir, "documents"))


@register(f"WITH {LINES} SELECT doc_id, line_no, lag(line_no) OVER (PARTITION BY doc_id, substr(line, 1, 12) ORDER BY line_no) AS twin FROM l WHERE length(line) > 12")
def prefix_twin(spark, sf_dir):
    return twins.prefix_twins(table(spark, sf_dir, "documents"))


@register(f"""WITH {LINES}, s AS (SELECT *, sum((line = chr(10))::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS stanza FROM l), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, stanza ORDER BY line_no) - 1) // 8 AS turn FROM s),
    h AS (SELECT *, string_agg(line, '') OVER (PARTITION BY doc_id, stanza, turn ORDER BY line_no) AS history FROM n)
    SELECT doc_id, line_no, lag(line_no) OVER (PARTITION BY doc_id, history ORDER BY line_no) AS twin FROM h WHERE line <> chr(10) AND strlen(line) >= 5""")
def record_twin(spark, sf_dir):
    return twins.record_twins(table(spark, sf_dir, "documents"))


_GRAM = "c || " + " || ".join(f"lead(c, {i}) OVER w" for i in range(1, 6))


@register(f"""WITH a AS (SELECT doc_id, unnest(a) AS c, unnest(range(len(a))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS a FROM documents)),
    g AS (SELECT doc_id, pos, {_GRAM} AS gram FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    b AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) AS back FROM g WHERE gram IS NOT NULL)
    SELECT doc_id, count(*) AS n_grams, count(back) AS n_twins, coalesce(sum(back), 0)::BIGINT AS distance FROM b GROUP BY doc_id""")
def gram_twin(spark, sf_dir):
    return twins.gram_twins(table(spark, sf_dir, "documents"))


@register(f"""WITH {FIELDS}, p AS (SELECT field_idx, line_no, value, lag(value) OVER w AS prev, lag(line_no) OVER w AS prev_no FROM f WINDOW w AS (PARTITION BY doc_id, field_idx ORDER BY line_no))
    SELECT field_idx, count(*) AS asked, sum(starts_with(value, prev)::INTEGER)::BIGINT AS repeated, sum((value = prev)::INTEGER)::BIGINT AS exact FROM p
    WHERE prev_no = line_no - 1 AND strlen(prev) >= 2 AND substr(prev, 1, 1) = substr(value, 1, 1) GROUP BY field_idx""")
def prev_field_hit(spark, sf_dir):
    return twins.previous_fields(table(spark, sf_dir, "documents"))


@register(f"""WITH {LINES}, p AS (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS above FROM l),
    s AS (SELECT doc_id, array_to_string(list_transform(range(1, least(length(line), length(above)) + 1), lambda i: CASE WHEN substr(line, i, 1) = substr(above, i, 1) THEN '1' ELSE '0' END), '') AS s FROM p WHERE above IS NOT NULL)
    SELECT doc_id, sum(length(s))::BIGINT AS compared, sum(length(replace(s, '0', '')))::BIGINT AS agreed, max(list_max(list_transform(string_split(s, '0'), lambda r: length(r))))::BIGINT AS longest FROM s GROUP BY doc_id""")
def vertical_agreement(spark, sf_dir):
    return twins.vertical(table(spark, sf_dir, "documents"))


@register("""WITH p AS (SELECT c_name, lag(c_name) OVER (ORDER BY c_custkey) AS prev FROM customer), x AS (SELECT unnest(list_transform(range(1, least(length(c_name), length(prev)) + 1), lambda i: {'old': substr(prev, i, 1), 'new': substr(c_name, i, 1)})) AS d FROM p WHERE prev IS NOT NULL)
    SELECT d.old AS old, d.new AS new, count(*) AS n FROM x WHERE d.old <> d.new GROUP BY ALL""")
def substitution_pairs(spark, sf_dir):
    rows = ordered.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    return twins.substitutions(ordered.with_previous(rows, ["c_name"]), "c_name")


# ---- sequences ----


@register("""WITH RECURSIVE r AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    s AS (SELECT k, i, v, 1 AS conf, 0::BIGINT AS step, 0 AS asked, 0 AS hit FROM r WHERE i = 1
          UNION ALL
          SELECT r.k, r.i, r.v,
                 CASE WHEN s.conf = 1 THEN CASE WHEN r.v <> s.v THEN 2 ELSE 1 END WHEN s.step <> 0 AND r.v - s.v = s.step THEN least(63, s.conf + 1) ELSE 1 END,
                 CASE WHEN s.conf = 1 AND r.v <> s.v THEN r.v - s.v ELSE s.step END,
                 s.asked + (s.conf >= 3 AND s.v + s.step >= 0)::INTEGER, s.hit + (s.conf >= 3 AND s.v + s.step >= 0 AND r.v = s.v + s.step)::INTEGER
          FROM s JOIN r ON r.k = s.k AND r.i = s.i + 1)
    SELECT k AS key, max(i) AS n, max(asked)::BIGINT AS asked, max(hit)::BIGINT AS hit, arg_max(conf, i)::BIGINT AS confidence FROM s GROUP BY k""")
def seq_lock(spark, sf_dir):
    """Each customer's order numbers as a sequence."""
    return sequences.locked(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey")


@register("""WITH RECURSIVE r AS (SELECT l_partkey AS k, (l_returnflag = 'R')::INTEGER AS b, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, (l_returnflag = 'R')::INTEGER) AS i FROM lineitem),
    s AS (SELECT DISTINCT k, 0::BIGINT AS i, 2048 AS p, 0 AS n FROM r
          UNION ALL
          SELECT r.k, r.i, CASE WHEN r.b = 1 THEN least(4094, s.p + greatest(1, (4096 - s.p) >> least(6, 2 + (s.n >> 1)))) ELSE greatest(1, s.p - greatest(1, s.p >> least(6, 2 + (s.n >> 1)))) END, least(15, s.n + 1)
          FROM s JOIN r ON r.k = s.k AND r.i = s.i + 1)
    SELECT k AS l_partkey, arg_max(p, i) AS p, arg_max(n, i) AS n FROM s GROUP BY k""")
def adaptive_cell(spark, sf_dir):
    """Of each part, a cell that learns from its line items whether the next one is returned."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.struct("l_orderkey", "l_linenumber").alias("at"), (F.col("l_returnflag") == "R").cast("int").alias("bit"))
    return sequences.adaptive_cells(rows, "l_partkey", "at", "bit")


# ---- provenance ----

_M = "18446744073709551616::UHUGEINT"
_MUL = f"(({{0}})::UHUGEINT * {{1}}::UHUGEINT % {_M})::UBIGINT"


def _sql_mix(z: str) -> str:
    z1 = _MUL.format(f"xor({z}, ({z}) >> 30)", word64.MIX_1)
    z2 = _MUL.format("xor(z1, z1 >> 27)", word64.MIX_2)
    return f"m1 AS (SELECT *, {z1} AS z1 FROM w0), m2 AS (SELECT *, {z2} AS z2 FROM m1), m3 AS (SELECT *, xor(z2, z2 >> 31) AS z3 FROM m2)"


@register(f"WITH w0 AS (SELECT range AS pos, ((range::UHUGEINT * {word64.GOLDEN}::UHUGEINT + 42) % {_M})::UBIGINT AS s FROM range(10000)), {_sql_mix('s')} SELECT pos, lower(lpad(hex(z3), 16, '0')) AS word FROM m3")
def splitmix_words(spark, sf_dir):
    found = provenance.splitmix_stream(spark, 10000, 42)
    return found.select("pos", F.lower(F.lpad(F.hex("word"), 16, "0")).alias("word"))


@register("SELECT range AS pos, true AS restored FROM range(10000)")
def splitmix_inverse(spark, sf_dir):
    state = word64.add(F.lit(42).cast("long"), word64.mul(F.col("pos"), word64.GOLDEN))
    return provenance.splitmix_stream(spark, 10000, 42).select("pos", (word64.unmix(F.col("word")) == state).alias("restored"))


@register(f"""WITH RECURSIVE o AS (SELECT 0::BIGINT AS pos, 1::UBIGINT AS s UNION ALL SELECT pos + 1, ((s::UHUGEINT * {word64.MMIX}::UHUGEINT + {word64.MMIX_ADD}) % {_M})::UBIGINT FROM o WHERE pos < 1999)
    SELECT pos, lower(lpad(hex(s), 16, '0')) AS word FROM o""")
def lcg_orbit(spark, sf_dir):
    return provenance.lcg_stream(spark, 2000, 1).select("pos", F.lower(F.lpad(F.hex("word"), 16, "0")).alias("word"))




def _xs_sql() -> str:
    wrap = lambda v, n: f"((({v})::UHUGEINT << {n}) % {_M})::UBIGINT"
    a = f"xor(s, {wrap('s', 13)})"
    b = f"xor({a}, ({a}) >> 7)"
    return f"xor({b}, {wrap(b, 17)})"


@register(f"WITH RECURSIVE o AS (SELECT -1::BIGINT AS pos, 88172645463325252::UBIGINT AS s UNION ALL SELECT pos + 1, {_xs_sql()} FROM o WHERE pos < 9999) SELECT pos, lower(lpad(hex(s), 16, '0')) AS word FROM o WHERE pos >= 0")
def xorshift_orbit(spark, sf_dir):
    """The noise corpus: words of xorshift64 from the generator's first seed."""
    return provenance.xorshift_stream(spark, 10000, 88172645463325252).select("pos", F.lower(F.lpad(F.hex("word"), 16, "0")).alias("word"))


@register("SELECT * FROM (VALUES (1, 'xorshift64', 1000), (2, 'lcg_mmix', 600), (3, 'splitmix64', 2000), (12, 'lcg_knuth', 700), (13, 'lcg_plus_1', 700), (14, 'xorshift64_star', 700)) AS t(stream_id, generator, run_words)")
def genome_match(spark, sf_dir):
    """Streams of all six makers, one broken after 600 words, and one of hashes that nothing made."""
    import numpy as np

    xs = provenance.xorshift_stream(spark, 1000, 7).select(F.lit(1).alias("stream_id"), "pos", "word")
    lcg = provenance.lcg_stream(spark, 900, 7).select(F.lit(2), "pos", F.when(F.col("pos") < 600, F.col("word")).otherwise(F.xxhash64("pos")))
    mix = provenance.splitmix_stream(spark, 2000, 7).select(F.lit(3), "pos", "word")
    noise = spark.range(1000).select(F.lit(4), "id", F.xxhash64("id"))
    more = [(10 + g, i, w) for g in (2, 3, 4) for i, w in enumerate(np.frombuffer(blobs.expand_orbit(g, 99, 700), "<i8").tolist())]
    found = provenance.recognise(xs.union(lcg).union(mix).union(noise).union(spark.createDataFrame(more, "s int, p long, w long")))
    return found.select("stream_id", "generator", F.col("run_words").cast("int").alias("run_words"))


# ---- vault and routing ----


@register("""WITH o AS (SELECT DISTINCT sha256(text) AS digest, strlen(text) AS length FROM documents), v AS (SELECT DISTINCT sha256(text) AS digest, strlen(text) AS length FROM documents WHERE doc_id % 3 = 0)
    SELECT digest, length FROM o WHERE (digest, length) NOT IN (SELECT digest, length FROM v)""")
def vault_insert(spark, sf_dir):
    """A vault that has the texts of every third document is offered all of them."""
    body = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    empty = spark.createDataFrame([], "digest string, length long, body binary")
    vault = spool(vault_put(empty, body.where("doc_id % 3 = 0").select("body")))
    return vault_put(vault, body.select("body")).select("digest", "length")


@register("""WITH v AS (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, sha256(text) AS digest, strlen(text) AS length FROM documents WHERE sha256(text) NOT IN (SELECT digest FROM v)""")
def vault_missing(spark, sf_dir):
    """Of all documents, those whose text the vault can't give back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    vault = vault_put(spark.createDataFrame([], "digest string, length long, body binary"), docs.where("doc_id % 3 = 0").select("body"))
    wanted = docs.select("doc_id", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("length"))
    return vault_get(spool(vault), wanted)[1].select("doc_id", "digest", "length")


@register("""SELECT 'd' || doc_id AS "key", sha256(text) AS digest, 'core' AS kinds FROM documents
    UNION ALL SELECT 'p' || page_id, sha256(html), 'core' FROM pages UNION ALL SELECT * FROM (VALUES ('e', sha256(''), 'core'), ('n', NULL, 'none'))""")
def blob_roundtrip(spark, sf_dir):
    """Documents, pages, an empty and a null body through segments and back."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.encode("text", "UTF-8").alias("body"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.encode("html", "UTF-8").alias("body"))
    more = spark.createDataFrame([("e", bytearray()), ("n", None)], "key string, body binary")
    rows = spool(blobs.encode(docs.union(pages).union(more), "key", "body")[0])
    kinds = rows.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("kind")), "+").alias("kinds"))
    return blobs.decode(rows).select("key", F.sha2("body", 256).alias("digest")).join(kinds, "key")


_RATIO = r"(strlen({0}) - strlen(regexp_replace({0}, '[\x20-\x7E\n\t\r]', '', 'g'))) * 100 < strlen({0}) * 85"


@register(rf"""WITH {LINES}, z AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '(?s).+?\n\n|(?s).+$')) AS stanza FROM documents),
    b AS (SELECT source, sum(strlen(text))::BIGINT AS n_bytes, sum({_PRINT.format('text')}) AS pr, bool_or(contains(text, chr(0))) AS nul, sum(strlen(text) - strlen(regexp_replace(text, '[,; \t|:]', '', 'g'))) AS sep FROM documents GROUP BY source),
    ls AS (SELECT source, count(*) AS n, count(DISTINCT line) AS d, bool_or(strlen(line) > 4096 OR {_RATIO.format('line')}) AS bad FROM l GROUP BY source),
    zs AS (SELECT source, count(*) AS n, count(DISTINCT stanza) AS d, bool_or(strlen(stanza) > 4096 OR strlen(stanza) < 8 OR {_RATIO.format('stanza')}) AS bad FROM z GROUP BY source),
    m AS (SELECT source, max(n) AS modal FROM (SELECT source, least(len(regexp_extract_all(line, '[,; \t|:]+|\n+|[^,; \t|:\n]+')), 64) AS k, count(*) AS n FROM l GROUP BY ALL) GROUP BY source),
    o AS (SELECT source, line, row_number() OVER w - 1 AS place, coalesce(sum(strlen(line)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WINDOW w AS (PARTITION BY source ORDER BY doc_id, line_no)),
    p AS (SELECT source, count(*) >= 1024 AND (count(*) - count(DISTINCT line)) * 8 < count(*) AS rejected FROM o WHERE place < 8192 AND before < 1048576 GROUP BY source),
    g AS (SELECT source, b.n_bytes, ls.n AS n_lines, b.n_bytes >= 4096 AND NOT nul AND NOT zs.bad AND zs.d * 3 <= zs.n * 2 AND zs.n >= 64 AS stanza_ok, b.n_bytes >= 4096 AND NOT nul AND NOT ls.bad AND ls.d * 3 <= ls.n * 2 AND ls.n >= 64 AND NOT rejected AS line_ok,
                 b.n_bytes >= 4096 AND NOT nul AND pr * 100 >= b.n_bytes * 85 AND ls.n >= 64 AND b.n_bytes BETWEEN 8 * ls.n AND 4096 * ls.n AND modal * 100 >= ls.n * 90 AND sep * 100 >= b.n_bytes * 8 AS column_ok
          FROM b JOIN ls USING (source) JOIN zs USING (source) JOIN m USING (source) JOIN p USING (source))
    SELECT *, CASE WHEN stanza_ok THEN 'stanza' WHEN line_ok THEN 'line' WHEN column_ok THEN 'column' ELSE 'core' END AS lane FROM g""")
def lane_router(spark, sf_dir):
    return router.lanes(table(spark, sf_dir, "documents"), "source")


# ---- generated corpora ----

_CORPUS = f"""o AS (SELECT 0::BIGINT AS line_no, (({corpus.SEED}::UHUGEINT * {word64.MMIX}::UHUGEINT + {word64.MMIX_ADD}) % {_M})::UBIGINT AS s UNION ALL SELECT line_no + 1, ((s::UHUGEINT * {word64.MMIX}::UHUGEINT + {word64.MMIX_ADD}) % {_M})::UBIGINT FROM o WHERE line_no < 2999),
    d AS (SELECT line_no, (s >> 33)::BIGINT AS r FROM o), c AS (SELECT line_no, r, (sum(7 + (r & 63)) OVER (ORDER BY line_no))::BIGINT AS t, (count(*) FILTER (r % 10 >= 4) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS q FROM d),
    x AS (SELECT *, printf('%02d:%02d:%02d', (t // 1000 // 3600) % 24, (t // 1000 // 60) % 60, t // 1000 % 60) AS hms, printf('%03d', t % 1000) AS ms FROM c)"""


def _sql_pick(pool: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in pool) + f"][(({i}) % {len(pool)}) + 1]"


@register(f"""WITH RECURSIVE {_CORPUS} SELECT line_no, '2026-07-23T' || hms || '.' || ms || 'Z,' || {_sql_pick(corpus.HOSTS, 'r')} || ',' || {_sql_pick(corpus.SENSORS, 'r >> 3')} || ',' || (20 + r % 60) || '.' || printf('%02d', (r >> 6) % 100) || ',ok,' || (r >> 8) % 100000 || chr(10) AS text FROM x""")
def corpus_csv(spark, sf_dir):
    return corpus.corpus(spark, 3000, "csv")


@register(f"""WITH RECURSIVE {_CORPUS} SELECT line_no, '[service.' || {_sql_pick(corpus.SERVICES, 'r')} || ']' || chr(10) || 'endpoint = https://' || {_sql_pick(corpus.HOSTS, 'r >> 2')} || '.internal:8443' || {_sql_pick(corpus.PATHS, 'r >> 4')} || chr(10) || 'timeout_ms = ' || 100 * (1 + r % 40) || chr(10) || 'retries = ' || 1 + r % 5 || chr(10) || 'tls = true' || chr(10) || 'log_level = ' || {_sql_pick(corpus.LEVELS, 'r >> 6')} || chr(10) || chr(10) AS text FROM x""".replace("|| 100 * (1 + r % 40) ||", "|| (100 * (1 + r % 40)) ||").replace("|| 1 + r % 5 ||", "|| (1 + r % 5) ||"))
def corpus_config(spark, sf_dir):
    return corpus.corpus(spark, 3000, "config")


@register(f"""WITH RECURSIVE {_CORPUS} SELECT line_no, CASE
    WHEN r % 10 < 4 THEN {_sql_pick(corpus.IPS, 'r')} || ' - - [23/Jul/2026:' || hms || ' +0000] "GET ' || {_sql_pick(corpus.PATHS, 'r >> 3')} || ' HTTP/1.1" ' || CASE WHEN (r & 127) < 120 THEN '200' ELSE '500' END || ' ' || (512 + r % 8192) || ' "-" "' || {_sql_pick(corpus.AGENTS, 'r >> 7')} || '"' || chr(10)
    WHEN r % 10 < 8 THEN '{{"ts":"2026-07-23T' || hms || '.' || ms || 'Z","level":"' || {_sql_pick(corpus.LEVELS, 'r >> 2')} || '","service":"' || {_sql_pick(corpus.SERVICES, 'r >> 5')} || '","request_id":"req-' || printf('%07d', 100000 + q) || '","message":"' || {_sql_pick(corpus.MESSAGES, 'r >> 9')} || '","latency_ms":' || (1 + r % 900) || '}}' || chr(10)
    ELSE '  <event id="' || printf('%07d', 100000 + q) || '" ts="2026-07-23T' || hms || '"><service>' || {_sql_pick(corpus.SERVICES, 'r')} || '</service><level>' || {_sql_pick(corpus.LEVELS, 'r >> 4')} || '</level><detail>' || {_sql_pick(corpus.MESSAGES, 'r >> 6')} || '</detail></event>' || chr(10) END AS text FROM x""")
def corpus_mixed(spark, sf_dir):
    return corpus.corpus(spark, 3000, "mixed")
