"""Further queries of the catalogue: compound encoders, lanes, and the functions and segments that nothing else shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.functions import word64
from quarry.operators import blobs, density, dictionary, lanes, profile, router, segment, shapes, twins
from quarry.plans.catalogue import _LONG, _M, _MUL, _STAMP, FIELDS, LINES, ORACLE_SQL, QUERIES, SIG, VARINT, _order_k, _sql_mix, _xs_sql, doc_lines, long_columns, register, stamp
from quarry.sources.storage import read_archive, shared_dir, spool, table, write_archive

# ---- functions ----

_BYTE = "lpad(hex(((v >> {0}) & 127 | CASE WHEN v >> {1} > 0 THEN 128 ELSE 0 END)::UTINYINT), 2, '0')"
_VARINT_HEX = " || ".join([_BYTE.format(0, 7), *(f"CASE WHEN v >> {7 * i} > 0 THEN {_BYTE.format(7 * i, 7 * i + 7)} ELSE '' END" for i in range(1, 9))])
_SUFFIX = "coalesce(list_position(list_transform(range(1, least(length({0}), length({1}), 8) + 1), lambda i: {0}[-i] <> {1}[-i]), true) - 1, least(length({0}), length({1}), 8))"
_ODD = "CASE WHEN event_id % 7 = 0 THEN '2023-02-29' || substr(s, 11) WHEN event_id % 11 = 0 THEN replace(s, 'T', ' ') ELSE s END"


@register(f"""SELECT event_id, {_VARINT_HEX} AS varint, v AS number, stamp, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) // 1000 + 719162::BIGINT * 86400000 END AS since_0001,
    {_SUFFIX.format('e', 'u')} AS suffix, strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', substr(to_base64(encode(event_type)), 2, 1)) - 1 AS base64
    FROM (SELECT *, {_ODD} AS stamp FROM (SELECT *, event_id * 7919 * (event_id % 5 * 99991 + 1) AS v, event_id::VARCHAR AS e, user_id::VARCHAR AS u, {_STAMP} AS s FROM events))""")
def codec_functions(spark, sf_dir):
    """Variable-length numbers written and read, times parsed (some have no such day or shape), common suffixes, base64."""
    rows = table(spark, sf_dir, "events").withColumn("v", F.col("event_id") * 7919 * (F.col("event_id") % 5 * 99991 + 1)).withColumn("s", stamp())
    odd = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("2023-02-29"), F.substring("s", 11, 20))).when(F.col("event_id") % 11 == 0, F.replace("s", F.lit("T"), F.lit(" "))).otherwise(F.col("s"))
    body = fn.varint(F.col("v"))
    return rows.select(
        "event_id", F.hex(body).alias("varint"), fn.read_varint(body).alias("number"), odd.alias("stamp"), fn.parse_ts(odd).alias("since_0001"),
        fn.common_suffix(F.col("event_id").cast("string"), F.col("user_id").cast("string"), 8).cast("long").alias("suffix"),
        fn.base64_value(F.substring(F.base64(F.encode("event_type", "UTF-8")), 2, 1)).cast("long").alias("base64"),
    )


def _orbit(g: int) -> str:
    step = {0: _xs_sql(), 5: f"((s::UHUGEINT + {word64.GOLDEN}) % {_M})::UBIGINT"}
    step |= {i: f"((s::UHUGEINT * {m}::UHUGEINT + {a}) % {_M})::UBIGINT" for i, (m, a) in {1: (word64.MMIX, word64.MMIX_ADD), 2: (word64.KNUTH, word64.KNUTH_ADD), 3: (word64.MMIX, 1)}.items()}
    if g == 4:
        a = "xor(s, s >> 12)"
        b = f"xor({a}, ((({a})::UHUGEINT << 25) % {_M})::UBIGINT)"
        step[4] = f"xor({b}, ({b}) >> 27)"
    return f"SELECT {g} AS gen_id, pos + 1 AS pos, {step[g]} AS s FROM o WHERE gen_id = {g} AND pos < 599"


@register(f"""WITH RECURSIVE o AS (SELECT unnest(range(6))::INTEGER AS gen_id, 0::BIGINT AS pos, 88172645463325252::UBIGINT AS s UNION ALL ({' UNION ALL '.join(map(_orbit, range(6)))})),
    w0 AS (SELECT * FROM o), {_sql_mix('s')}
    SELECT gen_id, pos, lower(lpad(hex(CASE gen_id WHEN 4 THEN {_MUL.format('s', word64.STAR)} WHEN 5 THEN z3 ELSE s END), 16, '0')) AS word FROM m3""")
def generator_words(spark, sf_dir):
    """The first words of all six generators from one state, expanded from their first word alone."""
    import numpy as np

    def expand(batches):
        import pyarrow as pa

        for batch in batches:
            for g in batch.column(0).to_pylist():
                with np.errstate(over="ignore"):
                    first = int(blobs._emit(g, np.array([88172645463325252], np.uint64))[0])
                words = np.frombuffer(blobs.expand_orbit(g, first, 600), "<u8")
                yield pa.RecordBatch.from_arrays([pa.array([g] * 600, pa.int32()), pa.array(range(600), pa.int64()), pa.array([f"{w:016x}" for w in words.tolist()])], names=["gen_id", "pos", "word"])

    return spark.range(6).select("id").mapInArrow(expand, "gen_id int, pos long, word string")


# ---- segments and archives ----


@register(f"""WITH {LINES}, v AS (SELECT doc_id, line_no, line = chr(10) AS blank FROM l), c AS (SELECT *, coalesce((blank <> lag(blank) OVER w)::INTEGER, 1) AS change FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    r AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c) SELECT doc_id, blank, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM r GROUP BY doc_id, blank, run""")
def verdict_runs(spark, sf_dir):
    """Adjacent lines of one verdict, blank or not, as one run."""
    rows = doc_lines(spark, sf_dir).select("doc_id", "line_no", (F.col("line") == "\n").alias("blank"))
    return segment.merged_runs(rows, ["doc_id"], "line_no", "blank")


@register("SELECT doc_id, sha256(text) AS digest FROM documents")
def archive_roundtrip(spark, sf_dir):
    """Documents through an archive on storage with its manifest, and back."""
    import uuid

    where = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(dictionary.encode_lines(table(spark, sf_dir, "documents").select("doc_id", "text")), where)
    back = spool(dictionary.decode_lines(read_archive(spark, where)).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return back


@register("""SELECT * FROM (VALUES ('dense', 'dense', 50000, true), ('lcg', 'seed', 80000, true), ('mix', 'seed+core', 524288 + 262144, true), ('stored', 'stored', 200000, true), ('text', 'core', 300000, true)) AS t("key", kinds, n_bytes, restored)""")
def segment_kinds(spark, sf_dir):
    """Bodies made for each kind of segment: where the encoder sends them, and that they come back."""

    def noise(n: int, salt: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n // 32)), lambda i: F.sha2(F.concat(i.cast("string"), F.lit(f"-{salt}")).cast("binary"), 256)), "")

    base = spark.range(1)
    plain = F.encode(F.repeat(F.lit("plain words, "), 30_000), "UTF-8")
    dense = F.unhex(noise(1 << 18, 1))
    lcg, mix = bytearray(blobs.expand_orbit(1, 7, 10_000)), bytearray(blobs.expand_orbit(5, 9, 65_536))
    bodies = {"dense": F.substring(dense, 1, 50_000), "stored": F.substring(dense, 1, 200_000), "lcg": F.lit(bytes(lcg)), "mix": F.concat(F.lit(bytes(mix)), F.substring(plain, 1, 262144)), "text": F.substring(plain, 1, 300_000)}
    rows = base.select(F.explode(F.create_map(*(x for k, v in bodies.items() for x in (F.lit(k), v)))).alias("key", "body"))
    rows = spool(rows.union(base.select(F.lit("mix"), F.lit(None).cast("binary")).where("false")))
    found, fresh = blobs.encode(rows, "key", "body", spark.createDataFrame([], "digest string, length long, body binary"))
    found = spool(found)
    kinds = found.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind"))), lambda x: x["kind"]), "+").alias("kinds"))
    back = blobs.decode(found, fresh).select("key", F.col("body").alias("back"))
    both = rows.join(back, "key").join(kinds, "key")
    return both.select("key", "kinds", F.octet_length("back").alias("n_bytes"), (F.col("body") == F.col("back")).alias("restored"))


# ---- compound encoders ----


@register(f"WITH {LINES} SELECT doc_id, line_no, line FROM l")
def shape_columns_roundtrip(spark, sf_dir):
    """Lines by shape, each field of each large shape by a codec of its own, and back."""
    archive = {k: spool(v) for k, v in shapes.encode_columns(doc_lines(spark, sf_dir), ["doc_id", "line_no"]).items()}
    return shapes.decode_columns(archive, ["doc_id", "line_no"])


@register("""SELECT doc_id, sha256(text) AS digest FROM documents UNION ALL SELECT -1 - range, sha256(repeat('key = value and more' || chr(10) || 'other = thing' || chr(10), 60)) FROM range(40)
    UNION ALL SELECT -101, NULL UNION ALL SELECT -102, sha256('') UNION ALL SELECT -1001 - o_custkey, sha256(string_agg(o_orderkey || ',' || o_orderstatus || ',' || o_orderkey % 7 || chr(10), '' ORDER BY o_orderkey)) FROM orders GROUP BY o_custkey""")
def routed_roundtrip(spark, sf_dir):
    """Documents, a group of repeated lines and orders as CSV, each group by the lane that accepts it first, and back."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    same = spark.range(40).select(F.lit("repeated"), -1 - F.col("id"), F.repeat(F.lit("key = value and more\nother = thing\n"), 60))
    odd = spark.createDataFrame([("odd", -101, None), ("odd", -102, "")], "source string, doc_id long, text string")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", (F.col("o_orderkey") % 7).cast("string"))
    parts = F.sort_array(F.collect_list(F.struct("o_orderkey", F.concat(line, F.lit("\n")).alias("line"))))
    csv = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text"))
    every = docs.union(same).union(odd).union(csv.select(F.lit("csv"), -1001 - F.col("o_custkey"), "text"))
    archive = router.encode(spool(every), "source")
    return router.decode(archive).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@register(f"""WITH {LINES}, d AS (SELECT DISTINCT line FROM l), p AS (SELECT line, row_number() OVER (ORDER BY encode(line)) - 1 AS id, lag(line) OVER (ORDER BY encode(line)) AS prev FROM d),
    x AS (SELECT line, id, CASE WHEN prev IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(strlen(line), strlen(prev)) + 1), lambda i: substr(hex(encode(line)), 2 * i - 1, 2) <> substr(hex(encode(prev)), 2 * i - 1, 2)), true) - 1, least(strlen(line), strlen(prev))) END AS k FROM p),
    t AS (SELECT sum({VARINT.format('k')} + {VARINT.format('strlen(line) - k')} + strlen(line) - k)::BIGINT AS dict_bytes FROM x), i AS (SELECT sum(strlen(line))::BIGINT AS n_bytes, sum({VARINT.format('id')})::BIGINT AS index_bytes FROM l JOIN x USING (line))
    SELECT n_bytes, dict_bytes, index_bytes, round(n_bytes / (dict_bytes + index_bytes + 8), 6) AS ratio FROM t, i""")
def dictionary_ratio(spark, sf_dir):
    return dictionary.encoded_size(spool(doc_lines(spark, sf_dir)), "line")


# ---- lanes, twins, contexts ----

_HEX = "CASE o_orderkey % 5 WHEN 0 THEN substr(md5(o_orderkey::VARCHAR), 1, 9) WHEN 1 THEN upper(md5(o_orderkey::VARCHAR)) ELSE md5(o_orderkey::VARCHAR) END"
_LANE = "CASE WHEN length(v) >= 10 AND d >= 2 AND lo * 10 >= length(v) * 3 AND (lo + d) * 20 >= length(v) * 17 THEN 'lower' WHEN length(v) >= 10 AND d >= 2 AND up * 10 >= length(v) * 3 AND (up + d) * 20 >= length(v) * 17 THEN 'upper' ELSE 'none' END"
_LANES = f"""n AS (SELECT o_custkey AS k, o_orderkey AS o, v, length(regexp_replace(v, '[^0-9]', '', 'g')) AS d, length(regexp_replace(v, '[^a-f]', '', 'g')) AS lo, length(regexp_replace(v, '[^A-F]', '', 'g')) AS up FROM (SELECT *, {_HEX} AS v FROM orders)),
    t AS (SELECT k, o, v, {_LANE} AS lane, row_number() OVER (PARTITION BY k ORDER BY o) AS i FROM n)"""


def _identifiers(spark, sf_dir):
    digest = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    value = F.when(F.col("o_orderkey") % 5 == 0, F.substring(digest, 1, 9)).when(F.col("o_orderkey") % 5 == 1, F.upper(digest)).otherwise(digest)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", value.alias("value"))


@register(f"""WITH RECURSIVE {_LANES}, s AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS o, NULL::VARCHAR AS v, 'none' AS lane, NULL::VARCHAR AS before, 0 AS c_before, NULL::VARCHAR AS held, 0 AS c, false AS armed FROM (SELECT DISTINCT k FROM t)
    UNION ALL SELECT t.k, t.i, t.o, t.v, t.lane, s.held, s.c, CASE WHEN t.lane = 'none' THEN s.held ELSE t.lane END, CASE WHEN t.lane = 'none' THEN s.c WHEN t.lane = s.held THEN least(3, s.c + 1) ELSE 1 END, s.c >= 2 AND coalesce(length(s.v) >= 11, false) FROM s JOIN t ON t.k = s.k AND t.i = s.i + 1)
    SELECT k AS o_custkey, o AS o_orderkey, v AS value, lane, before AS belief, c_before::BIGINT AS confidence, armed FROM s WHERE i > 0""")
def lane_beliefs(spark, sf_dir):
    """Each customer's order digests, some cut short and some in capitals, as one field line after line."""
    return lanes.beliefs(_identifiers(spark, sf_dir), ["o_custkey"], "o_orderkey", "value")


@register(f"WITH {_LANES} SELECT o AS o_orderkey, CASE WHEN lane <> 'none' AND length(v) % 2 = 0 THEN lane ELSE 'raw' END AS kind, CASE WHEN lane <> 'none' AND length(v) % 2 = 0 THEN length(v) // 2 ELSE length(v) END AS n_stored, v AS value FROM t")
def hex_lane_roundtrip(spark, sf_dir):
    """Identifiers as bytes and back."""
    kind, body = lanes.packed(F.col("value"))
    stored = spool(_identifiers(spark, sf_dir).select("o_orderkey", kind.alias("kind"), body.alias("body")))
    return stored.select("o_orderkey", "kind", F.octet_length("body").cast("long").alias("n_stored"), lanes.unpacked(F.col("kind"), F.col("body")).alias("value"))


@register(f'WITH {_LONG}, p AS (SELECT col, value, lag(value) OVER (PARTITION BY col ORDER BY at_row) AS prev FROM c) SELECT col AS "column", count(*) AS n_rows, count(*) FILTER (value = prev) AS n_repeats FROM p GROUP BY col')
def immediate_repeats(spark, sf_dir):
    return profile.immediate_repeats(long_columns(spark, sf_dir))


@register(f"""WITH {LINES}, x AS (SELECT doc_id, line_no, line, unnest([7, 13, 25, 49, 97]) AS n FROM l), t AS (SELECT doc_id, line_no, n, lag(line_no) OVER (PARTITION BY doc_id, n, substr(line, 1, n) ORDER BY line_no) AS twin FROM x WHERE length(line) > n)
    SELECT doc_id, line_no, max(n) AS length, arg_max(twin, n) AS twin FROM t WHERE twin IS NOT NULL GROUP BY doc_id, line_no""")
def longest_prefix_twin(spark, sf_dir):
    return twins.longest_prefix_twins(table(spark, sf_dir, "documents"))


_BACK = "coalesce(list_position(list_transform(range(1, least(length(before), length({0})) + 1), lambda i: before[-i] <> {0}[-i]), true) - 1, least(length(before), length({0})))"


@register(f"""WITH p AS (SELECT page_id, url, unnest(range(length(url) - 5)) AS pos FROM pages WHERE length(url) >= 6), g AS (SELECT page_id, pos, substr(url, pos + 1, 6) AS gram, substr(url, greatest(pos - 58, 0) + 1, pos + 6 - greatest(pos - 58, 0)) AS before FROM p),
    c AS (SELECT page_id, pos, before, lag(pos) OVER w AS p1, lag(before) OVER w AS b1, lag(pos, 2) OVER w AS p2, lag(before, 2) OVER w AS b2 FROM g WINDOW w AS (PARTITION BY page_id, gram ORDER BY pos)),
    k AS (SELECT page_id, pos, p1, p2, {_BACK.format('b1')} AS k1, {_BACK.format('b2')} AS k2 FROM c WHERE p1 IS NOT NULL)
    SELECT page_id, pos, CASE WHEN p2 IS NOT NULL AND k2 > k1 THEN p2 ELSE p1 END AS twin, CASE WHEN p2 IS NOT NULL AND k2 > k1 THEN k2 ELSE k1 END AS agreement FROM k""")
def best_gram_twin(spark, sf_dir):
    """In urls, the one of two earlier places of each six characters after which more of the text agrees."""
    return twins.best_gram_twins(table(spark, sf_dir, "pages"), key="page_id", text="url")


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}') THEN '{name}'" for name, p in fn.CHAR_CLASSES.items()) + " ELSE 'other' END"


@register(f"""WITH {LINES}, p AS (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS above FROM l),
    c AS (SELECT doc_id, line_no, unnest(range(1, least(length(line), length(above)) + 1)) AS i, line, above FROM p WHERE above IS NOT NULL), x AS (SELECT doc_id, line_no, i, substr(above, i, 1) AS b, substr(line, i, 1) = substr(above, i, 1) AS same FROM c),
    r AS (SELECT *, coalesce(sum((NOT same)::INTEGER) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM x),
    h AS (SELECT b, same, row_number() OVER (PARTITION BY doc_id, line_no, stretch ORDER BY i) - 1 AS held FROM r)
    SELECT {_CLASS} AS class, least(held // 16, 7)::INTEGER AS hold, count(*) AS n, count(*) FILTER (same) AS agreed FROM h GROUP BY ALL""")
def mirror_counters(spark, sf_dir):
    return twins.mirror_counters(table(spark, sf_dir, "documents"))


_TOKEN = r"[\x00-\x60\x7B-\x7F](?:[a-z]|[^\x00-\x7F])*|(?:[a-z]|[^\x00-\x7F])+"


@register(f"""WITH t AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TOKEN}') AS r FROM documents),
    u AS (SELECT unnest(list_transform(range(1, len(r) + 1), lambda i: {{'run': r[i], 'after': nullif(substr(r[i + 1], 1, 1), '')}})) AS x FROM t), k AS (SELECT x.run AS run, x.after AS after, unnest(range(1, length(x.run) + 1)) AS k FROM u)
    SELECT substr(run, 1, k) AS ctx, CASE WHEN k < length(run) THEN substr(run, k + 1, 1) ELSE after END AS next, count(*) AS n FROM k GROUP BY ALL""")
def token_contexts(spark, sf_dir):
    return density.token_contexts(table(spark, sf_dir, "documents"))


_BOTH = _order_k(6).replace("a AS (", "a6 AS (").replace("b AS (", "b6 AS (").replace("k AS (", "k6 AS (").replace("FROM a ", "FROM a6 ").replace("FROM b ", "FROM b6 ")


@register(f"""WITH {_order_k(3)}, {_BOTH}, t AS (SELECT ctx, sum(n)::BIGINT AS n_ctx FROM k GROUP BY ctx), t6 AS (SELECT ctx, sum(n)::BIGINT AS n_ctx FROM k6 GROUP BY ctx),
    s AS (SELECT ctx, byte FROM k JOIN t USING (ctx) WHERE n_ctx >= 15 AND n * 4096 > n_ctx * 3968)
    SELECT ctx, byte, n, n_ctx FROM k6 JOIN t6 USING (ctx) WHERE n_ctx >= 15 AND n * 4096 > n_ctx * 3968 AND (right(ctx, 6), byte) IN (SELECT (ctx, byte) FROM s)""")
def certain_at_both_orders(spark, sf_dir):
    """Contexts of six bytes that are certain, as are their last three."""
    text = table(spark, sf_dir, "documents").select("text")
    short, long = (density.certain(density.context_counts(text, k)) for k in (3, 6))
    return density.certain_at_both(short, long, 3)


@register(f"WITH {FIELDS}, s AS (SELECT {SIG} AS sig FROM l) SELECT (SELECT count(*) FROM f) AS n_fields, (SELECT sum(length(sig))::BIGINT FROM s) AS n_classes")
def fields_and_classes(spark, sf_dir):
    """Every field has its place in its line's shape."""
    rows = doc_lines(spark, sf_dir)
    n = segment.fields(rows).agg(F.count(F.lit(1)).alias("n_fields"))
    return n.crossJoin(rows.agg(F.sum(F.length(shapes.signature(F.col("line")))).cast("long").alias("n_classes")))  # one row each
