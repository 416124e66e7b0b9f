"""Quality rules: counts over a text's words and lines, and a log-likelihood ratio between two multinomials.

Hashed words and word pairs are counted over a trusted target and over the raw corpus. A document's score is the mean,
over its words and pairs and a few neutral ones, of log(p_target / p_raw); each document is kept or not by that score and by the counts.
DataFrame operations only, no shuffle of texts.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import bound
from quarry.llm.common import small_or_shuffled

BLANK = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Log ratios are whole numbers of 1/STEPS, so that sums don't depend on their order.
STEPS = 1024
#: Grams of ratio 0 that every document has besides its own: a few unlucky ones don't condemn a short text.
NEUTRAL = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{BLANK}]+"), "")


def repeated_words(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs at two places or more."""

    def covered(places: Column) -> Column:
        ends = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(ends, F.lit(0), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: (F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))) | ((j > 0) & F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    some = F.size(F.array_distinct(windows)) < F.size(windows)
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(some, bound(bound(ordered, places), covered)).otherwise(F.lit(0)).cast("long")


def windows_of(hashes: Column) -> Column:
    n = F.size(hashes)
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, places: int) -> Column:
    """Places of the words and of the pairs of neighbours."""
    pairs = F.transform(hashes, lambda h, i: F.when(i > 0, F.pmod(F.xxhash64(h, F.get(hashes, i - 1)), F.lit(places)).cast("int")))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(places)).cast("int")), F.slice(pairs, 2, F.greatest(F.size(hashes) - 1, F.lit(0))))


def log_ratios(docs: DataFrame, target_ids: DataFrame, places: int, prior: float, id_col: str, text_col: str) -> list[int]:
    """log(p_target / p_raw) by place, in STEPS to the nat. All documents count, and all of target_ids.

    The target's multinomial has the raw one as its prior, worth prior grams a place: where little is known of the
    target the ratio is near 0, and documents of the target aren't favoured for their rare words.

    Counted by place on the executors; what reaches the driver is one pair of counts for each of the places.
    """
    held = small_or_shuffled(target_ids.select(F.col("doc_id").alias("__id")).distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(held, F.col("doc_id") == F.col("__id"), "left")
    # the outer form, since the other one makes Catalyst compute the array once more, for a filter
    found = F.explode_outer(bound(hashes_of(words_of(F.col("text"))), lambda h: grams(h, places)))
    rows = rows.select(F.col("__id").isNotNull().cast("long").alias("trusted"), found.alias("place")).where("place IS NOT NULL")
    counts = rows.groupBy("place").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    spark = docs.sparkSession
    every = spark.range(places).select(F.col("id").cast("int").alias("place"))
    table = every.join(counts, "place", "left").select("place", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target"))).collect()
    raw, target = [1.0] * places, [0.0] * places
    for row in table:
        raw[row.place] += row.raw
        target[row.place] += row.target
    n_raw, n_target = sum(raw), sum(target) + prior * places
    return [round(STEPS * math.log((t + prior * places * r / n_raw) / n_target * n_raw / r)) for r, t in zip(raw, target, strict=True)]


def constant(spark: SparkSession, values: list[int]) -> Column:
    """An array of integers as one literal of the plan."""
    context = spark.sparkContext
    held = context._gateway.new_array(context._jvm.int, len(values))
    context._jvm.java.nio.ByteBuffer.wrap(struct.pack(f">{len(values)}i", *values)).asIntBuffer().get(held)
    return Column(context._jvm.org.apache.spark.sql.functions.lit(held))


def facts(text: Column, ratios: Column, places: int) -> Column:
    """A struct of the counts of one text and its score. Words and hashes are computed once each."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))

    def of_hashes(words: Column, hashes: Column) -> Column:
        total = F.aggregate(grams(hashes, places), F.lit(0).cast("long"), lambda a, g: a + F.get(ratios, g))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            bound(windows_of(hashes), repeated_words).alias("n_repeat_words"),
            (total / ((F.greatest(2 * F.size(hashes) - 1, F.lit(0)) + NEUTRAL) * STEPS)).alias("llr"),
        )

    return bound(words_of(text), lambda words: bound(hashes_of(words), lambda hashes: of_hashes(words, hashes)))


@dataclass(frozen=True)
class Rules:
    """Thresholds, and the ratios that one corpus and its labels gave."""

    ratios: Column
    places: int
    threshold: float
    min_words: int
    max_repeated: int

    def failed(self, found: Column) -> Column:
        return (found["n_words"] < self.min_words) | (100 * found["n_repeat_words"] > self.max_repeated * found["n_words"])

    def keeps(self, text: Column) -> Column:
        """The verdict as one expression, for a filter.

        Null and empty texts fail; equal texts are judged alike; texts are taken whole; no column is needed but the text.
        """
        return bound(facts(text, self.ratios, self.places), lambda f: ~self.failed(f) & (f["llr"] >= self.threshold))


def fit(
    docs: DataFrame, labels: DataFrame, threshold: float = -0.06, places: int = 1 << 14, prior: float = 20.0,
    min_words: int = 10, max_repeated: int = 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Rules:
    """The target is all documents labelled 1; the raw corpus is every row of docs. Without labels all ratios are 0 and
    the counts alone decide. Texts stay where they are while the trusted ids are few enough to be broadcast.
    """
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    ratios = log_ratios(docs, trusted, places, prior, id_col, text_col)
    return Rules(constant(docs.sparkSession, ratios), places, threshold, min_words, max_repeated)


def judged(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    base_failed: fewer words than the rules ask for, or more than max_repeated percent of them in repeated windows.
    kept: not base_failed and llr >= threshold, a fixed number, so that equal texts are judged alike.

    Null and empty texts have no words and fail; very long texts are counted whole. Repeated rows each give a row and each count in the corpus; an
    empty table gives an empty result; columns other than those named are ignored.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), facts(F.col(text_col), rules.ratios, rules.places).alias("f"))
    f = F.col("f")
    return found.select(
        "doc_id", *(f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        rules.failed(f).alias("base_failed"), f["llr"].alias("llr"), (~rules.failed(f) & (f["llr"] >= rules.threshold)).alias("kept"),
    )
