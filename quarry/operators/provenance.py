"""Words of known pseudo-random generators: making them, and finding out which one made a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import word64
from quarry.operators.ordered import ranked, with_previous

#: Words that an orbit must have to be recognised: 4096 bytes (fixed value).
LEAST_WORDS = 512


def splitmix_stream(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """pos, word of provenance noise: each word is a function of its place alone."""
    start = F.lit(word64.signed(seed)).cast("long")
    return spark.range(n).select(F.col("id").alias("pos"), word64.mix(word64.add(start, word64.mul(F.col("id"), word64.GOLDEN))).alias("word"))


def lcg_stream(spark: SparkSession, n: int, seed: int, generator: int = 1) -> DataFrame:
    """pos, word of a linear congruential generator, by jumping to each place."""
    m, a = ((word64.MMIX, word64.MMIX_ADD), (word64.KNUTH, word64.KNUTH_ADD), (word64.MMIX, 1))[generator - 1]
    return spark.range(n).select(F.col("id").alias("pos"), word64.lcg_at(seed, m, a, F.col("id")).alias("word"))


def _xorshift_columns(x: np.ndarray, shifts: tuple[int, int, int]) -> np.ndarray:
    for n in shifts:
        x = x ^ (x << np.uint64(n) if n > 0 else x >> np.uint64(-n))
    return x


def _apply(columns: np.ndarray, x: int) -> int:
    """A matrix over GF(2), given by the images of the bits, times x."""
    out = 0
    for i in range(64):
        if x >> i & 1:
            out ^= int(columns[i])
    return out


def xorshift_stream(spark: SparkSession, n: int, seed: int, run: int = 4096) -> DataFrame:
    """pos, word of xorshift64 (13, 7, 17). Runs start from a jump with powers of the step's matrix, then go on."""
    shifts = (13, -7, 17)
    powers = [_xorshift_columns(np.uint64(1) << np.arange(64, dtype=np.uint64), shifts)]
    for _ in range(47):
        powers.append(np.array([_apply(powers[-1], int(c)) for c in powers[-1]], np.uint64))
    out = pa.schema([("pos", pa.int64()), ("word", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in (batch.column(0).to_numpy() * run).tolist():
                x, jump = seed, first + 1
                for bit in range(48):
                    if jump >> bit & 1:
                        x = _apply(powers[bit], x)
                words = np.empty(min(run, n - first), np.uint64)
                for i in range(len(words)):
                    words[i] = x
                    x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
                    x ^= x >> 7
                    x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(words))), pa.array(words.view(np.int64))], schema=out)

    return spark.range(-(-n // run)).mapInArrow(make, "pos long, word long")


def recognise(streams: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """stream_id, gen_id, generator, seed_word, run_words: of streams(stream_id, pos, word), the first generator whose
    orbit the head of the stream follows for least words or more; without one a stream is left out (A11, E9). A stream of
    any length is spread over tasks.
    """
    placed = ranked(streams.select("stream_id", F.col("pos").alias("at"), "word"), ["stream_id", "at"])
    rows = with_previous(placed, ["word"], ["stream_id"]).where("prev_word IS NOT NULL")
    follows = F.array(*[F.when(word64.emit(g, word64.step(g, word64.state(g, F.col("prev_word")))) == F.col("word"), True).otherwise(False) for g in range(6)])
    each = rows.select("stream_id", "at", "prev_word", F.posexplode(follows).alias("gen_id", "ok"))
    head = F.min(F.struct("at", F.col("prev_word").alias("word")))
    runs = each.groupBy("stream_id", "gen_id").agg(F.min(F.when(~F.col("ok"), F.col("at"))).alias("broken"), (F.max("at") + 1).alias("n"), head.alias("head"))
    runs = runs.withColumn("seed_word", F.col("head.word")).withColumn("start", F.col("head.at") - 1)
    runs = runs.withColumn("run_words", F.coalesce("broken", "n") - F.col("start")).where(F.col("run_words") >= least)
    best = runs.groupBy("stream_id").agg(F.min(F.struct("gen_id", "seed_word", "run_words")).alias("b"))
    names = F.array(*map(F.lit, word64.GENERATORS))
    return best.select("stream_id", "b.gen_id", F.get(names, F.col("b.gen_id")).alias("generator"), "b.seed_word", "b.run_words")
