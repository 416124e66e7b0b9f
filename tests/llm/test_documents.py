import collections
import hashlib
import re
import zlib

import pytest
from oracle import same
from pyspark.sql import functions as F

from quarry.llm import common, exact_dedup, graph, language_id, license_scan, near_join, quality_model, quality_rules, queries, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, sf).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(truth)
    out = [r for r in rows if r.held_out and len(truth[r.doc_id][1]) > 100]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in out) >= 0.97 * len(out)


def test_language_edges(spark, awkward):
    rows = language_id.identify(awkward, language_id.fit(awkward)).collect()
    assert len(rows) == awkward.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {2, 3, 4, 9}
    nothing = language_id.fit(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(awkward, nothing).collect()} == {"und"}
    assert language_id.identify(awkward.limit(0), nothing).count() == 0 and language_id.fit(awkward.limit(0)).dictionaries == {}


def test_language_query_equals_plain_version(spark, sf_dir):
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text", F.xxhash64("doc_id", "lang").alias("h")).collect()
    excerpts = collections.defaultdict(list)
    for r in sorted(docs, key=lambda r: (r.h, str(r.doc_id))):
        if r.lang and not held_out(r.doc_id) and len(excerpts[r.lang]) < 600:
            at = r.h % max(len(r.text) - 200, 1)
            if (part := r.text[at : at + 200].lower()) not in excerpts[r.lang]:
                excerpts[r.lang].append(part)
    content = {lang: " ".join(some).encode()[-96_000:] for lang, some in sorted(excerpts.items())}
    assert language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet")).dictionaries == content
    coders = {lang: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for lang, c in content.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op1_language_id(spark, sf_dir).collect()}
    for r in docs:
        if not any(map(str.isalpha, r.text)):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        data = f" {r.text.lower()} ".encode()
        sizes = {lang: len(coder.compress((content[lang][-192:-96] if len(data) < 256 else b"") + data)) for lang, coder in coders.items()}
        best = min(sizes, key=lambda lang: (sizes[lang], lang))
        assert got[r.doc_id][0] == best and abs(got[r.doc_id][1] - 1 / sum(2.718281828459045 ** ((sizes[best] - n) / 4) for n in sizes.values())) < 1e-9


def test_quality_query_equals_plain_version(spark, sf_dir):
    import math

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op5_quality_classifier(spark, sf_dir).collect()}
    for r in docs.limit(60).collect():
        ids, x = quality_model.features(r.text, r.n_chars, {})
        v = model.factors[ids].astype(float) * x[:, None]
        pairs = sum(float(v[i] @ v[i + 1 :].sum(0)) for i in range(len(ids) - 1))
        score = 1 / (1 + math.exp(-(float(model.weights[ids] @ x) + pairs)))
        assert abs(got[r.doc_id][0] - score) < 1e-4 and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.5)


def test_training_equals_plain_version():
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(30, 5, replace=False)), rng.normal(size=5)) for _ in range(20)]
    labels = rng.integers(0, 2, 20).astype(float)
    got = quality_model.train(rows, labels, rank=3, epochs=2, batch=8, seed=5)

    rng = np.random.default_rng(5)
    w, v = np.zeros(quality_model.PLACES), rng.normal(0, 0.02, (quality_model.PLACES, 3))
    share = (labels.sum() + 0.5) / 21
    w[quality_model.WORD_PLACES + quality_model.STATISTICS.index("bias")] = np.log(share / (1 - share))
    theta = np.concatenate([w[:, None], v], 1)
    m, s, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(2):
        order = rng.permutation(20)
        for at in range(0, 20, 8):
            chosen, g, used = order[at : at + 8], np.zeros_like(theta), set()
            for i in chosen:
                ids, x = rows[i]
                margin = theta[ids, 0] @ x + sum(theta[ids[a], 1:] @ theta[ids[b], 1:] * x[a] * x[b] for a in range(5) for b in range(a))
                error = (1 / (1 + np.exp(-margin)) - labels[i]) / len(chosen)
                for a in range(5):
                    g[ids[a], 0] += error * x[a]
                    g[ids[a], 1:] += error * x[a] * sum(theta[ids[b], 1:] * x[b] for b in range(5) if b != a)
                    used.add(int(ids[a]))
            at_ = sorted(used)
            g[at_] += 1e-5 * theta[at_]
            step += 1
            m[at_], s[at_] = 0.9 * m[at_] + 0.1 * g[at_], 0.999 * s[at_] + 0.001 * g[at_] ** 2
            theta[at_] -= 0.02 * (m[at_] / (1 - 0.9**step)) / (np.sqrt(s[at_] / (1 - 0.999**step)) + 1e-8)
    assert np.abs(got.weights - theta[:, 0]).max() < 1e-5 and np.abs(got.factors - theta[:, 1:]).max() < 1e-5


def test_ids_with_several_rows_fit_once(spark, awkward, awkward_labels):
    one = quality_model.fit(awkward, awkward_labels)
    two = quality_model.fit(awkward.union(awkward), awkward_labels)
    assert (one.weights == two.weights).all() and (one.factors == two.factors).all()
    assert language_id.fit(awkward).dictionaries == language_id.fit(awkward.union(awkward)).dictionaries


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_quality_classifier(spark, sf).collect()
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in out) >= 0.95 * len(out)


def test_sum_of_squares_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    model = quality_model.FactorisationMachine(rng.normal(size=50), rng.normal(size=(50, 4)))
    ids, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(model.factors[ids[i]] @ model.factors[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(model.margin(ids, x) - (model.weights[ids] @ x + pairs)) < 1e-9


def test_quality_edges(spark, awkward, awkward_labels):
    model = quality_model.fit(awkward, awkward_labels)
    rows = quality_model.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.accepted(awkward, model).columns == awkward.columns
    none = quality_model.fit(awkward.limit(0), awkward_labels.limit(0))
    assert quality_model.score(awkward.limit(0), none).count() == 0 and quality_model.score(awkward.drop("n_chars"), none).count() == awkward.count()


def rules_of(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark, sf_dir, awkward, awkward_labels):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for d, labels in ((docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), (awkward, awkward_labels)):
        rules = quality_rules.fit(d, labels)
        got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(d, rules).collect())
        want = collections.Counter()
        for r in d.select("doc_id", "text").collect():
            f = rules_of(r.text)
            want[(r.doc_id, *f, f[0] < 10 or 100 * f[4] > 20 * f[0])] += 1
        assert got == want
        assert d.where(rules.keeps(F.col("text"))).count() == quality_rules.judged(d, rules).where("kept").count()
    empty = quality_rules.fit(docs.limit(0), awkward_labels.limit(0))
    assert quality_rules.judged(docs.limit(0), empty).count() == 0
    assert all(r.llr == 0 for r in quality_rules.judged(docs, empty).collect())


def test_log_ratios_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a x"), (3, "b")], "doc_id long, text string")
    places = 64
    got = quality_rules.log_ratios(docs, docs.where("doc_id < 2").select("doc_id"), places, 0.5, "doc_id", "text")
    hashed = docs.select("doc_id", quality_rules.grams(quality_rules.hashes_of(quality_rules.words_of(F.col("text"))), places).alias("g")).collect()
    assert [len(r.g) for r in sorted(hashed)] == [5, 5, 1]
    import math

    raw, target = collections.Counter(p for r in hashed for p in r.g), collections.Counter(p for r in hashed if r.doc_id < 2 for p in r.g)
    n_raw = sum(raw.values()) + places
    for p in range(places):
        share = (raw[p] + 1) / n_raw
        assert got[p] == round(1024 * math.log((target[p] + 0.5 * places * share) / (5 + 0.5 * places) / share))


def test_verdicts_equal_brute_force(spark, sf_dir):
    import math

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    places, trusted = 1 << 14, {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = docs.select("doc_id", "text", quality_rules.grams(quality_rules.hashes_of(quality_rules.words_of(F.coalesce("text", F.lit("")))), places).alias("g")).collect()
    raw, target = collections.Counter(p for r in rows for p in r.g), collections.Counter(p for r in rows if r.doc_id in trusted for p in r.g)
    n_raw, n_target = sum(raw.values()) + places, sum(target.values()) + 20.0 * places
    ratio = [round(1024 * math.log((target[p] + 20.0 * places * (raw[p] + 1) / n_raw) / n_target * n_raw / (raw[p] + 1))) for p in range(places)]
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    for r in rows:
        llr, f = sum(ratio[p] for p in r.g) / ((len(r.g) + 20) * 1024), rules_of(r.text)
        failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
        assert abs(got[r.doc_id].llr - llr) < 1e-9 and got[r.doc_id].kept == (not failed and llr >= -0.06)


def test_exact_classes(spark, awkward):
    for digest_all in (True, False):
        rows = exact_dedup.classes(awkward, digest_all=digest_all).collect()
        norm = {i: hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest() for i, t in awkward.select("doc_id", "text").collect()}
        assert len(rows) == awkward.count() and all(r.text_sha256 in (norm[r.doc_id], None) for r in rows)
        by = {(r.doc_id, r.kept): (r.keep_id, r.group_size) for r in rows}
        assert by[(1, True)] == (1, 4) and by[(10, False)] == (1, 4) and by[(2, True)] == (2, 2) and by[(3, False)] == (2, 2)
        assert sum(r.kept for r in rows if r.doc_id == 5) == 0 and by[(None, True)] == (None, 1)
    assert exact_dedup.classes(awkward.limit(0)).count() == 0
    assert exact_dedup.deduplicated(awkward.where("doc_id IN (1, 10, 4)")).columns == awkward.columns
    twice = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert sorted((r.group_size, r.kept) for r in exact_dedup.classes(twice).collect()) == [(2, False), (2, True)]


def test_refined_classes_by_rows(spark):
    p = "p" * 300
    rows = [(1, p + "a"), (1, p + "b"), (3, p + "c"), (None, p + "c"), (None, p + "c"), (4, p + "a"), (4, p + "a"), (5, None), (6, ""), (7, "alone"), (8, "x  y"), (9, "x\ty")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, __mark int, row int")
    for digest_all in (True, False):
        got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(docs, digest_all=digest_all).collect())
        assert got == collections.Counter([
            (1, 1, 3, True), (1, 1, 1, True), (3, 3, 3, True), (None, 3, 3, False), (None, 3, 3, False), (4, 1, 3, False), (4, 1, 3, False),
            (5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True), (8, 8, 2, True), (9, 8, 2, False),
        ])
    assert exact_dedup.deduplicated(docs).count() == 6 and exact_dedup.deduplicated(docs.where("doc_id > 4")).columns == docs.columns
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs.where("doc_id > 4")).collect()) == [5, 7, 8]


def test_bitmap_marks_what_it_was_given(spark):
    keys = spark.range(1, 200_000, 977).select(F.col("id").alias("mark"))
    found = exact_dedup.is_marked(spark.range(1, 200_000), F.col("id"), exact_dedup.marked(keys))
    assert sorted(r.id for r in found.collect()) == list(range(1, 200_000, 977))


def brute_components(docs, width, num, den):
    sets, parent = {}, {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
        parent[i] = i

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width,num,den,band_rows", [(4, 85, 100, 1024), (5, 80, 100, 7)])
def test_near_groups_equal_brute_force(spark, sf_dir, monkeypatch, width, num, den, band_rows):
    import random

    monkeypatch.setattr(near_join, "BLOCK", band_rows)
    rng = random.Random(width)
    base = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = list(enumerate(base))
    hot = [f"w{i}" for i in range(120)]
    for _ in range(90):  # one family of near copies with one to eight edits
        words = hot[:]
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(120)] = f"e{rng.random()}"
        rows.append((len(rows), " ".join(words)))
    for t in base[:20]:
        words = t.split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "Edit"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one two three", "One  two\tthree", hot[0]])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den).collect()}
    assert got == brute_components(rows, width, num, den)


def test_near_edges(spark, awkward):
    rows = near_join.near_groups(awkward).collect()
    assert len(rows) == awkward.count() and {r.component_id for r in rows if r.doc_id in (1, 5, 10)} == {1}
    assert near_join.near_groups(awkward.limit(0)).count() == 0
    kept = near_join.representatives(awkward.where("doc_id IS NOT NULL"))
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, 9}


def test_pigeonhole_never_misses():
    import numpy as np

    measure = near_join.Measure(4, 85, 100)
    sketcher, rng = near_join.Sketcher(measure), np.random.default_rng(3)
    for n in [1, 2, 5, 6, 7, 12, 13, 20, 40, 99, 100, 333, 1000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            lost = int(rng.integers(0, n // 6 + 1))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both >= 85 * either:
                assert np.intersect1d(sketcher.keys(a), sketcher.keys(b)).size
                width = min(len(sketcher.short(a)), len(sketcher.short(b)))
                x, y = (near_join._folded(np.array([sketcher.short(v), b""], object)[:1], width) for v in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= either - both <= measure.furthest(len(a) + len(b))


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_shared_keys_over_batches(spark, batch):
    import random

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(5)
    rows = [(rng.choice([7, 7, 7, rng.randint(0, 60)]), rng.randint(0, 40), rng.randint(0, 1)) for _ in range(400)]
    got = [tuple(r) for r in near_join._shared(spark.createDataFrame(rows, "key long, node long, check long")).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    by = collections.defaultdict(set)
    for r in rows:
        by[r[0]].add(r)
    many = {r for v in by.values() if len(v) > 1 for r in v}
    assert len(got) == len(set(got)) and many <= set(got) <= set(rows) and len(set(got) - many) <= 2 * 4  # first and last keys of 4 partitions


def test_links_of_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    other = [f"o{i}" for i in range(60)]
    near = lambda some, i: " ".join([*some[:i], "edit", *some[i + 1 :]])
    rows = [(7, " ".join(words)), (None, near(words, 59)), (None, near(other, 59)), (None, " ".join(other)), (9, "one row alone"), (9, " ".join(words)), (4, near(words, 0))]
    got = [(r.doc_id, r.component_id) for r in near_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(7, 4), (None, 4), (None, None), (None, None), (9, 9), (9, 4), (4, 4)], key=str)


@pytest.mark.parametrize("num", [20, 50, 80, 95, 100])
def test_pigeonhole_of_any_threshold(num):
    import numpy as np

    measure = near_join.Measure(4, num, 100)
    sketcher, rng = near_join.Sketcher(measure), np.random.default_rng(num)
    hit = 0
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 5, 9, 20, 60, 200]))
        pool = np.unique(rng.integers(0, 2**63, 2 * n + 2, dtype=np.uint64))
        rng.shuffle(pool)
        a = np.sort(pool[:n])
        lost, more = (int(rng.integers(0, max(1, n * (100 - num) // 100) + 1)) for _ in range(2))
        b = np.sort(np.concatenate([pool[min(lost, n - 1) : n], pool[n : n + more]]))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both >= num * either:
            hit += 1
            assert np.intersect1d(sketcher.keys(a), sketcher.keys(b)).size
    assert hit > 300


def test_components(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (7, 9), (5, 5), (4, 3), (12, 11), (11, 10), (10, 12)], "a long, b long")
    assert {r.node: r.comp for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 10, 11: 10, 12: 10}


def test_url_filter(spark):
    events = spark.createDataFrame([("a", "x.org", "add", 10), ("a", "x.org", "remove", 20), ("a", "x.org", "add", 20), ("a", "x.org", "remove", 30), ("b", "sub.x.org/p/", "add", 5), ("b", None, "add", 1), ("b", "sub.x.org/p/", "add", 5)], "list_id string, pattern string, action string, at long")
    cases = [("http://x.org", 9, 0), ("http://x.org/", 10, 1), ("https://U@Sub.X.org.:80/p/q?x", 15, 2), ("http://sub.x.org/p", 50, 0), ("http://sub.x.org/p/", 50, 1), ("http://ax.org/", 15, 0), ("http://x.org/", 20, 1), ("http://x.org/", 30, 0), (None, 15, 0), ("nonsense", 15, 0), ("http://x.org/", None, 0), ("http://x.org/", 10, 1)]
    captures = spark.createDataFrame([(i, u, t, 1) for i, (u, t, _) in enumerate(cases)], "page_id long, url string, fetched_at long, pattern int")
    got = {r.page_id: r for r in url_filter.filtered(captures, events).collect()}
    assert {i: got[i].n_entries for i in got} == {i: n for i, (_, _, n) in enumerate(cases)} and all(got[i].blocked == (got[i].n_entries > 0) for i in got)
    assert url_filter.filtered(captures.limit(0), events).count() == 0 and url_filter.filtered(captures, events.limit(0)).where("blocked").count() == 0


def test_url_paths_keep_their_case(spark):
    events = spark.createDataFrame([("a", " X.org/Docs/", "add", 1)], "list_id string, pattern string, action string, at long")
    urls = ["http://x.ORG/Docs/a", "http://x.org/docs/a"]
    captures = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, fetched_at long")
    assert {r.page_id: r.blocked for r in url_filter.filtered(captures, events).collect()} == {0: True, 1: False}


def test_url_of_many_segments(spark):
    import time

    events = spark.createDataFrame([("a", "x.org/s0/s1/", "add", 1), ("b", "x.org/s0", "add", 1), ("c", "org", "add", 9), ("d", "a.b.x.org", "add", 1)], "list_id string, pattern string, action string, at long")
    long = "/".join(f"s{i}" for i in range(10_000))
    urls = [f"http://x.org/{long}", f"http://{'y.' * 10_000}x.org/s0", "http://a.b.x.org/" + "/" * 10_000]
    captures = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, fetched_at long")
    url_filter.filtered(captures, events).collect()
    began = time.time()
    assert {r.page_id: r.n_entries for r in url_filter.filtered(captures, events).collect()} == {0: 2, 1: 0, 2: 1}
    assert time.time() - began < 5


def test_license_scan(spark):
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(license_scan.TEMPLATES)], "tno int, license string, text string")
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/x.py", "no word on it"), (3, "r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "r/a/b/c/y.py", None),
        (5, "r/a/b/z.py", "code\n# Licensed under the Apache License, Version 2.0.\ncode"), (6, "q/x.py", "we license nothing to anybody at all in this long line about other things"), (7, None, "Licensed under CC BY-NC 4.0."), (8, "LICENSE2", ""), (2, "r/a/x.py", "no word on it"),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, dir string")
    got = sorted(((r.doc_id, r.own_license, r.license, r.inherited_from) for r in license_scan.scan(files, templates).collect()), key=str)
    assert got == sorted([
        (1, "MIT", "MIT", None), (2, None, "MIT", "r"), (2, None, "MIT", "r"), (3, "GPL-3.0", "GPL-3.0", None), (4, None, "GPL-3.0", "r/a/b"),
        (5, "Apache-2.0", "Apache-2.0", None), (6, None, None, None), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (8, None, None, None),
    ], key=str)
    assert license_scan.scan(files.limit(0), templates).count() == 0


@pytest.mark.parametrize("width", [0, 40, 70])
def test_license_templates_find_themselves(spark, width):
    import textwrap

    every = [*license_scan.TEMPLATES, *license_scan.FURTHER]
    rows = [(i, f"r{i}/x.py", "import os\n\n" + "\n".join(f"# {line}" for line in (textwrap.wrap(t, width, break_long_words=False) if width else [t])) + "\n\nprint(1)\n") for i, (_, t) in enumerate(every)]
    got = {r.doc_id: (r.own_license, r.similarity) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), license_scan.known_templates(spark)).collect()}
    assert {i: got[i][0] for i in got} == {i: name for i, (name, _) in enumerate(every)} and all(s == 1 for _, s in got.values())


def test_license_blocks_and_files(spark):
    mit = license_scan.TEMPLATES[2][1] + ' (the "Software"), to deal in the Software without restriction, subject to the following conditions: the above notice shall be included in all copies.'
    rows = [
        (1, "r/LICENSE", "MIT\n\nCopyright (c) 2020 Somebody\n\n" + mit.replace(", to", ",\nto").replace(": ", ":\n\n")), (2, "q/x.c", "/* SPDX-License-Identifier: Zlib */"), (3, "q/COPYING", "Nothing is said of it here.\n\nThe use of any work under version 2."),
        (4, "p/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Everyone is permitted to copy."), (5, "p/y.c", ""), (6, "o/z.c", "// SPDX-License-Identifier: GPL-3.0-or-later"), (7, "o/z.txt", "mit\n\nmit"),
    ]
    got = {r.doc_id: (r.own_license, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), license_scan.known_templates(spark)).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, None), 3: (None, None), 4: ("GPL-2.0", "GPL-2.0"), 5: (None, "GPL-2.0"), 6: ("GPL-3.0", "GPL-3.0"), 7: (None, None)}


@pytest.mark.parametrize("stage", [exact_dedup.deduplicated, near_join.representatives])
def test_rows_go_by_numbers(spark, stage):
    a, b, c = ("first text of some length here", "another text that is quite unique", "the third text without any id")
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (2, a), (None, c), (None, c), (3, "text with one row")], "doc_id long, text string")
    kept = stage(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (3, "text with one row")], key=str)


def test_stages_on_awkward_rows(spark, sf_dir, awkward, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 1), (9, 0), (10, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward.where("key = 7").cache()
    for name, stage in corpus_pipeline.STAGES:
        kept, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if name == corpus_pipeline.STAGES[-1][0]:
            assert kept.where("offset = 0").count() >= 1 and kept.select("piece", "start").where("piece = 0").count() == docs.count()
        else:
            assert kept.columns == docs.columns == none.columns and kept.exceptAll(docs).count() == 0, name
    left = corpus_pipeline.near_copies(spark, corpus_pipeline.spool(corpus_pipeline.exact_copies(spark, docs, str(tmp_path))), str(tmp_path))
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 4, 6, 7, 8, 9, None]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.spool(after)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and kept, name
        ids = kept
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert all(c == i for i, (_, c) in brute_components(texts, 5, 80, 100).items())
    assert sum(label.get(i, 1) for i in ids) >= 0.97 * len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == ids
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_jaccard_join_holds_few_texts_at_once(spark, monkeypatch):
    """Its jobs over whole texts give Python short batches; the session's own size holds again afterwards."""
    name, sizes, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], near_join.spool
    before = spark.conf.get(name)

    def noted(df):
        if "text#" in df._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            sizes.append(int(spark.conf.get(name)))
        return write(df)

    monkeypatch.setattr(near_join, "spool", noted)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 2 :])) for i in range(6)], "doc_id long, text string")
    assert {r.component_id for r in near_join.near_groups(docs).collect()} == {0}
    assert sizes and max(sizes) <= common.BATCH_ROWS and spark.conf.get(name) == before
