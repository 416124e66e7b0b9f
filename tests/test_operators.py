import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as fn
from quarry.functions import word64
from quarry.operators import blobs, columnar, density, dictionary, ordered, profile, provenance, router, segment, sequences, shapes, twins
from quarry.sources import storage

M = (1 << 64) - 1


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


EDGES = ["", "\n", "\n\n\n", "a", "a\n", "no newline at end", "a\r\nb\r\n", "é, ä: ç\n\nü|x\n", "x\n\ny\n\nz", " ,;\t|:", None]


def test_segments_lose_nothing(spark):
    docs = texts(spark, *EDGES)
    for cut, piece in ((segment.lines, "line"), (segment.stanzas, "stanza")):
        parts = cut(docs)
        number = f"{piece}_no"
        back = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number, piece))), lambda p: p[piece]), "").alias("t"))
        assert {r.doc_id: r.t for r in back.collect()} == {i: t for i, t in enumerate(EDGES) if t}
    fields = segment.fields(segment.lines(docs))
    assert fields.agg(F.sum(F.octet_length("value"))).first()[0] == sum(len(t.encode()) for t in EDGES if t)


@pytest.mark.parametrize("n,total", [(3, 10), (4, 10), (1, 0), (7, 7)])
def test_chunks_are_even(spark, n, total):
    start, length = segment.chunks(F.lit(total), F.lit(n), F.col("id"))
    rows = spark.range(n).select(start.alias("s"), length.alias("l")).orderBy("s").collect()
    assert sum(r.l for r in rows) == total and [r.l for r in rows] == [total // n + (i < total % n) for i in range(n)]
    assert [r.s for r in rows] == [sum(r.l for r in rows[:i]) for i in range(n)]


@pytest.mark.parametrize("distinct,codec", [(255, "dict"), (256, "dict"), (257, "raw")])
def test_dictionary_boundary(spark, distinct, codec):
    rows = spark.range(1024).select(F.lit("c").alias("column"), F.col("id").alias("at"), F.substring(F.md5((F.col("id") % distinct).cast("string").cast("binary")), 1, 6).alias("value"))
    assert profile.column_codecs(rows).first().codec == codec
    archive = columnar.encode(rows)
    assert columnar.decode(archive).exceptAll(rows).count() == 0 and columnar.decode(archive).count() == 1024


@pytest.mark.parametrize("values,codec", [(["0", "01", "02"], "dict"), (["9", "10", "11"], "seq"), (["08", "09", "10"], "dict"), (["1700000000000", "1700000000500", "1700000001000"], "seq"), (["7", "7", "7"], "const")])
def test_sequences_must_render_back(spark, values, codec):
    rows = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "column string, at long, value string")
    assert profile.column_codecs(rows).first().codec == codec
    assert sorted(r.value for r in columnar.decode(columnar.encode(rows)).collect()) == sorted(values)


def test_front_coding_over_blocks(spark):
    rows = spark.range(3000).select(F.lit("c").alias("column"), F.col("id").alias("at"), F.concat(F.lit("préfixe/"), F.lpad((F.col("id") * 7).cast("string"), 9, "x")).alias("value"))
    assert profile.column_codecs(rows).first().codec == "prefix"
    back = columnar.decode(columnar.encode(rows))
    assert back.exceptAll(rows).count() == 0 and back.count() == 3000


def test_lock_relocks_after_a_break(spark):
    values = [0, 1, 2, 7, 12, 17, 22]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(2, 0, 5)], "k long, o long, v long")
    found = {r.key: (r.n, r.asked, r.hit) for r in sequences.locked(rows, "k", "o", "v").collect()}
    assert found == {1: (7, 2, 1), 2: (1, 0, 0)}
    lock, asked = sequences.Lock(), []
    for v in values:
        asked.append(int(lock.prediction() is not None))
        lock.feed(v)
    assert asked == [0, 0, 0, 1, 0, 0, 1]


def test_words_wrap(spark):
    rows = spark.range(200).select(F.xxhash64("id").alias("x"))
    out = rows.select("x", word64.mul(F.col("x"), word64.MMIX).alias("m"), word64.mix(F.col("x")).alias("z"), word64.unmix(word64.mix(F.col("x"))).alias("u"), *(word64.state(g, word64.emit(g, F.col("x"))).alias(f"s{g}") for g in range(6)))
    for r in out.collect():
        assert r.m & M == (r.x & M) * word64.MMIX & M and r.u == r.x and all(r[f"s{g}"] == r.x for g in range(6))


def test_orbits_of_every_generator(spark):
    for g in range(6):
        x, words = 88172645463325252, []
        for _ in range(600):
            s = x
            words.append(s)
            if g == 0:
                s ^= s << 13 & M
                s ^= s >> 7
                s ^= s << 17 & M
            elif g == 4:
                s ^= s >> 12
                s ^= s << 25 & M
                s ^= s >> 27
            else:
                s = {1: s * word64.MMIX + word64.MMIX_ADD, 2: s * word64.KNUTH + word64.KNUTH_ADD, 3: s * word64.MMIX + 1, 5: s + word64.GOLDEN}[g] & M
            x = s
        stream = spark.createDataFrame([(g, i, word64.signed(w)) for i, w in enumerate(words)], "stream_id int, pos long, word long")
        stream = stream.select("stream_id", "pos", word64.emit(g, F.col("word")).alias("word"))
        found = provenance.recognise(stream).collect()
        assert [(r.gen_id, r.run_words) for r in found] == [(g, 600)]
        assert provenance.recognise(stream.where("pos < 500")).count() == 0


def test_timestamps(spark):
    good = ["0001-01-01T00:00:00.000Z", "2024-02-29T23:59:59.999Z", "2000-02-29T12:00:00.001Z"]
    bad = ["2026-02-31T00:00:00.000Z", "1900-02-29T00:00:00.000Z", "2026-01-01T24:00:00.000Z", "2026-01-01 00:00:00.000Z", ""]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", fn.format_ts(fn.parse_ts(F.col("t"))).alias("back")).collect()
    assert [r.back for r in rows] == good + [None] * len(bad)


def test_small_functions(spark):
    r = spark.sql("SELECT 'abcd' a, 'abxd' b, '' e, CAST(NULL AS STRING) z").select(
        fn.lcp(F.col("a"), F.col("b")).alias("l"), fn.lcp(F.col("a"), F.col("e")).alias("e"), fn.lcp(F.col("a"), F.col("z")).alias("z"), fn.common_suffix(F.col("a"), F.col("b"), 8).alias("s"),
        fn.longest_digits(F.lit("a12b345c678")).alias("d"), fn.longest_digits(F.lit("none")).alias("n"), fn.unzigzag(fn.zigzag(F.lit(-5).cast("long"))).alias("g"),
        fn.hex_lane(F.lit("0123456789")).alias("digits"), fn.hex_lane(F.lit("123e4567-e89b-12d3-a456-426614174abc")).alias("uuid"), fn.base64_value(F.lit("/")).alias("b64"),
    ).first()
    assert (r.l, r.e, r.z, r.s, r.d, r.n, r.g, r.digits, r.uuid, r.b64) == (2, 0, 0, 1, "345", None, -5, "none", "none", 63)


def test_density(spark):
    noise = spark.range(1).select(F.lit(1).alias("k"), F.lit(bytes((i * i * 31 + i * 7 + (i >> 3) * 13) % 256 if i % 2 else (i * 167 + i // 256) % 256 for i in range(8192))).alias("body"))
    small = noise.select(F.lit(2).alias("k"), F.substring("body", 1, 4095).alias("body"))
    text = noise.select(F.lit(3).alias("k"), F.lit(b"plain text " * 800).alias("body"))
    found = {r.k: (r.dense, r.n_bytes) for r in router.block_verdicts(noise.union(small).union(text), "k", "body").collect()}
    assert found[2] == (False, 4095) and found[3][0] is False
    runs = segment.merged_runs(spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbba")], "k int, o int, v string"), ["k"], "o", "v").orderBy("first").collect()
    assert [(r.v, r.first, r.last, r.n) for r in runs] == [("a", 0, 1, 2), ("b", 2, 4, 3), ("a", 5, 5, 1)]
    bits = density.entropy(spark.createDataFrame([(1, 0, 5), (1, 1, 5)], "k int, byte int, n long"), ["k"]).first().bits
    assert math.isclose(bits, 1.0)


def test_ranks_spread_hot_groups(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("g"), F.col("id").alias("o"))
    for parts in ("1", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = ordered.ranked_within(rows, ["g"], ["o"])
        assert {(r.g, r.o, r.place) for r in found.collect()} == {(1 if i < 900 else 2, i, i if i < 900 else i - 900) for i in range(1000)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ordered.ranked(rows.where("false"), ["o"], {"s": "o"}).count() == 0


def test_archives(spark, tmp_path):
    docs = texts(spark, *EDGES)
    archive = dictionary.encode_lines(docs)
    storage.write_archive(archive, str(tmp_path / "a"))
    back = dictionary.decode_lines(storage.read_archive(spark, str(tmp_path / "a")))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(EDGES))
    short = dictionary.encode_lines(docs)
    with pytest.raises(Exception, match="lines are missing"):
        dictionary.decode_lines(short | {"index": short["index"].where("line_no < 1")}).collect()
    lines = segment.lines(docs)
    assert shapes.decode(shapes.encode(lines, ["doc_id", "line_no"]), ["doc_id", "line_no"]).exceptAll(lines).count() == 0
    (tmp_path / "blob").write_bytes(b"\x00\x01")
    assert storage.read_blobs(spark, str(tmp_path / "blob")).first().length == 2


def test_vault_is_idempotent(spark):
    body = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "body binary")
    vault = storage.vault_put(spark.createDataFrame([], "digest string, length long, body binary"), body)
    assert vault.count() == 2 and storage.vault_put(vault, body).count() == 0
    found, missing = storage.vault_get(vault, vault.select("digest", "length").union(spark.sql("SELECT 'x', 1L")))
    assert found.count() == 2 and missing.first().digest == "x"


def test_router_accepts_repeated_lines(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("g").alias("source"), F.repeat(F.lit("key = value and more\nother = thing\n"), 60).alias("text"))
    assert router.lanes(docs, "source").first().lane == "line"


def test_twins_reset_at_blank_lines(spark):
    docs = texts(spark, "alpha one\nbeta two\n\nalpha one\nbeta two\n\nbeta two\n")
    found = {r.line_no: r.twin for r in twins.record_twins(docs).collect()}
    assert found == {0: None, 1: None, 3: None, 4: None, 6: None}
    assert {r.line_no: r.twin for r in twins.line_twins(docs).collect()}[3] == 0


def test_blobs(spark):
    import hashlib

    noise = {g: blobs.expand_orbit(g, 88172645463325252, 40_000) for g in range(6)}
    dense = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(4000))
    rows = [(f"g{g}", b"\x01" * g + n + b"tail") for g, n in noise.items()]
    rows += [("stored", dense), ("short", dense[:60_000]), ("text", b"plain words " * 500), ("mixed", b"plain words " * 30_000 + dense * 4), ("tiny", b"ab"), ("none", b""), ("late", dense[:16] + noise[0])]
    source = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "key string, body binary")
    empty = spark.createDataFrame([], "digest string, length long, body binary")
    segments, fresh = blobs.encode(source, "key", "body", empty)
    kinds = {}
    for r in segments.collect():
        kinds.setdefault(r.key, []).append((r.start, r.kind, r.gen_id))
    assert all(kinds[f"g{g}"][0][1:] == ("seed", g) for g in range(6))
    assert [k for _, k, _ in kinds["stored"]] == ["stored"] and [k for _, k, _ in kinds["short"]] == ["dense"] and [k for _, k, _ in kinds["text"]] == ["core"]
    assert len(kinds["mixed"]) == 2 and kinds["late"][0][1] == "stored"
    assert {r.key: bytes(r.body) for r in blobs.decode(segments, fresh).collect()} == dict(rows)
    with pytest.raises(Exception, match="the vault lacks object"):
        blobs.decode(segments, empty).collect()


def test_router_sends_groups_by_their_gates(spark):
    same = spark.range(40).select(F.lit("repeated").alias("source"), F.col("id").alias("doc_id"), F.repeat(F.lit("key = value and more\nother = thing\n"), 60).alias("text"))
    csv = spark.range(40).select(F.lit("csv"), 100 + F.col("id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat_ws(",", F.col("id") * 30 + i, F.substring(F.md5((F.col("id") * 99 + i).cast("string").cast("binary")), 1, 6), F.lit("x\n"))), ""))
    odd = spark.createDataFrame([("odd", 900, None), ("odd", 901, ""), (None, 902, "no group")], "source string, doc_id long, text string")
    docs = same.union(csv).union(odd)
    archive = router.encode(docs, "source")
    assert {r.source: r.lane for r in archive["lanes"].collect()}.items() >= {"repeated": "line", "csv": "column"}.items()
    assert archive["line/dict"].count() == 2 and archive["column/codecs"].count() > 4
    assert {r.doc_id: r.text for r in router.decode(archive).collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert router.decode(router.encode(docs.limit(0), "source")).count() == 0


def test_lane_needs_two_detections(spark):
    import hashlib

    values = [hashlib.md5(str(i).encode()).hexdigest() for i in range(6)]
    values = [values[0], "word", values[1], values[2].upper(), values[3].upper(), "short", values[4]]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, o int, v string")
    from quarry.operators import lanes

    found = [(r.lane, r.belief, r.confidence, r.armed) for r in lanes.beliefs(rows, ["k"], "o", "v").orderBy("o").collect()]
    assert found == [
        ("lower", None, 0, False), ("none", "lower", 1, False), ("lower", "lower", 1, False), ("upper", "lower", 2, True), ("upper", "upper", 1, False), ("none", "upper", 2, True), ("lower", "upper", 2, False),
    ]


def test_mirror_counters_of_long_lines(spark):
    """A line that agrees and disagrees very often; its places are counted once each, not once for each stretch."""
    above, below = "a1 B,\u00e9\U0001f600\t" * 30_000 + "\n", "a1 X,\u00e9\U0001f601 " * 30_000 + "z" * 100 + "\n"
    docs = texts(spark, above + below + "a" * 300 + "\n" + "a" * 299, *EDGES)
    want = {}
    for text in (above + below + "a" * 300 + "\n" + "a" * 299, *EDGES):
        rows = (text or "").split("\n")
        rows = [r + "\n" for r in rows[:-1]] + [r for r in rows[-1:] if r]
        for b, a in zip(rows, rows[1:]):
            held = 0
            for x, y in zip(a, b):
                name = next((n for n, p in fn.CHAR_CLASSES.items() if re.match(p, y)), "other")
                n, agreed = want.get((name, min(held // 16, 7)), (0, 0))
                want[name, min(held // 16, 7)] = n + 1, agreed + (x == y)
                held = held + 1 if x == y else 0
    got = {(r["class"], r.hold): (r.n, r.agreed) for r in twins.mirror_counters(docs).collect()}
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 7, 8, 11])
def test_contexts_are_counted_where_they_lie(spark, k, monkeypatch):
    """Also in small steps, over the ends of texts and of steps; no row for each byte."""
    monkeypatch.setattr(density, "WINDOWS", 16)
    monkeypatch.setattr(density, "REMEMBERED", 20)
    values = [*EDGES, "abcabcabcabd" * 9, "x" * 200, "\x00\x00" * 12, "\u00ff\U0001f600" * 7, "ab", "abcdefgh", "abcdefghi"]
    want = Counter(b[i : i + k + 1] for b in ((v or "").encode() for v in values) for i in range(len(b) - k))
    counts = density.context_counts(texts(spark, *values).repartition(2), k)
    assert "Generate" not in counts._jdf.queryExecution().toString()
    assert {(r.ctx + r.byte): r.n for r in counts.collect()} == {w.hex().upper(): n for w, n in want.items()}
    of = Counter()
    for w, n in want.items():
        of[w[:k]] += n
    sure = {(w.hex().upper(), n, of[w[:k]]) for w, n in want.items() if of[w[:k]] >= 15 and n * 4096 > of[w[:k]] * 3968}
    assert {(r.ctx + r.byte, r.n, r.n_ctx) for r in density.certain(counts).collect()} == sure and (k > 3 or sure)


def test_certain_contexts_read_texts_once(spark, sf_dir):
    plan = density.certain(density.context_counts(storage.table(spark, sf_dir, "documents"), 6))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan
