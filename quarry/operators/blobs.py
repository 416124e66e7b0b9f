"""Encoding binary bodies segment by segment: recognised noise as its seed, dense segments by reference, the rest as it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import word64
from quarry.operators.router import block_verdicts
from quarry.operators.segment import merged_runs
from quarry.sources.storage import spool, vault_put

#: Bytes of a block, of the least segment that is stored by reference, and of the least orbit (fixed values).
BLOCK, LEAST_STORED, LEAST_ORBIT = 262144, 65536, 4096
#: Kinds of segments: seed of a generator, reference to the vault, dense bytes, other bytes; a null body has none.
SEED, STORED, DENSE, CORE, NONE = "seed", "stored", "dense", "core", "none"

_U = np.uint64
_LINEAR = {1: (word64.MMIX, word64.MMIX_ADD), 2: (word64.KNUTH, word64.KNUTH_ADD), 3: (word64.MMIX, 1)}


def _mix(z):
    z = (z ^ (z >> _U(30))) * _U(word64.MIX_1)
    z = (z ^ (z >> _U(27))) * _U(word64.MIX_2)
    return z ^ (z >> _U(31))


def _unmix(z):
    for shift, factor in ((31, word64.MIX_2), (27, word64.MIX_1), (30, None)):
        z = z ^ (z >> _U(shift)) ^ (z >> _U(2 * shift)) if 2 * shift < 64 else z ^ (z >> _U(shift))
        if factor:
            z = z * _U(pow(factor, -1, 1 << 64))
    return z


def _step(g: int, s):
    if g in _LINEAR:
        return s * _U(_LINEAR[g][0]) + _U(_LINEAR[g][1])
    if g == 5:
        return s + _U(word64.GOLDEN)
    for n in (13, -7, 17) if g == 0 else (-12, 25, -27):
        s = s ^ (s << _U(n) if n > 0 else s >> _U(-n))
    return s


def _emit(g: int, s):
    return s * _U(word64.STAR) if g == 4 else _mix(s) if g == 5 else s


def _state(g: int, w):
    return w * _U(pow(word64.STAR, -1, 1 << 64)) if g == 4 else _unmix(w) if g == 5 else w


def find_orbit(body: bytes) -> tuple[int, int, int, int] | None:
    """(phase, generator, first word, words) of the first orbit of LEAST_ORBIT bytes that starts in the first 8 bytes."""
    with np.errstate(over="ignore"):
        for phase in range(8):
            n = (len(body) - phase) // 8
            if n * 8 < LEAST_ORBIT:
                return None
            words = np.frombuffer(body, "<u8", n, phase)
            for g in range(6):
                if _emit(g, _step(g, _state(g, words[:1])))[0] != words[1]:
                    continue
                ok = _emit(g, _step(g, _state(g, words[:-1]))) == words[1:]
                run = n if ok.all() else int(ok.argmin()) + 1
                if run * 8 >= LEAST_ORBIT:
                    return phase, g, int(words[0]), run
    return None


def _matrix_of(g: int) -> np.ndarray:
    """Of a shifting generator, which is linear over bits: the states after those with a single bit."""
    return _step(g, _U(1) << np.arange(64, dtype=_U))


def _applied(matrix: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.zeros_like(s)
    for bit in range(64):
        out ^= np.where(s >> _U(bit) & _U(1), matrix[bit], _U(0))
    return out


def expand_orbit(g: int, first: int, n: int) -> bytes:
    """The n words of an orbit, from the first word that it put out: what is known is doubled by jumps of its length."""
    with np.errstate(over="ignore"):
        s = _state(g, np.array([first], _U))
        if g == 5:
            return _emit(g, s + np.arange(n, dtype=_U) * _U(word64.GOLDEN)).astype("<u8").tobytes()
        if g in _LINEAR:
            k, c = (_U(v) for v in _LINEAR[g])
            while len(s) < n:
                s = np.concatenate([s, s * k + c])
                k, c = k * k, k * c + c
        else:
            matrix = _matrix_of(g)
            while len(s) < n:
                s = np.concatenate([s, _applied(matrix, s)])
                matrix = _applied(matrix, matrix)
        return _emit(g, s[:n]).astype("<u8").tobytes()


def encode(blobs: DataFrame, key: str, body: str, vault: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Segments key, start, kind, head, gen_id, seed, n_words, digest, length, tail; and what the vault has to add.

    Blocks of one density verdict form a segment; an empty body is one of no bytes, a null body one without. A dense one that an orbit fills from its first bytes is kept as
    head, seed and tail; else, if it has 64 KiB and a vault is given, as a digest; all others as bytes in tail.
    """
    source = blobs.select(F.col(key).alias("key"), F.col(body).alias("body"))
    runs = merged_runs(block_verdicts(source, "key", "body"), ["key"], "block_no", "dense")
    segments = source.join(runs.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"))
    start = (F.col("first") * BLOCK).cast("long")
    cut = segments.select("key", start.alias("start"), "dense", F.substring(F.col("body"), start.cast("int") + 1, ((F.col("last") - F.col("first") + 1) * BLOCK).cast("int")).alias("segment"))
    few = source.where(F.col("body").isNull() | (F.octet_length("body") == 0)).select("key", F.lit(0).cast("long"), F.lit(None).cast("boolean"), "body")
    cut = cut.union(few)
    store = vault is not None
    kind_of_key = source.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("start", pa.int64()), ("kind", pa.string()), ("head", pa.binary()), ("gen_id", pa.int32()), ("seed", pa.int64()), ("n_words", pa.int64()), ("tail", pa.binary())]
    out = pa.schema([("key", to_arrow_type(kind_of_key)), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, dense, segment in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                orbit = find_orbit(segment) if dense else None
                if orbit:
                    phase, g, first, n = orbit
                    rows.append((at, SEED, segment[:phase], g, word64.signed(first), n, segment[phase + 8 * n :]))
                else:
                    kind = CORE if segment is not None else NONE
                    if dense:
                        kind = STORED if store and len(segment) >= LEAST_STORED else DENSE
                    rows.append((at, kind, b"", None, None, None, segment))
            columns = zip(*rows, strict=True) if rows else [()] * (len(out) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    found = spool(cut.mapInArrow(run, f"key {kind_of_key.simpleString()}, start long, kind string, head binary, gen_id int, seed long, n_words long, tail binary"))
    held = F.col("kind") == STORED
    rows = found.select("*", F.when(held, F.sha2("tail", 256)).alias("digest"), F.when(held, F.octet_length("tail").cast("long")).alias("length")).withColumn("tail", F.when(~held, F.col("tail")))
    fresh = spool(vault_put(vault, found.where(held).select(F.col("tail").alias("body")))) if store else None
    return rows, fresh


def decode(rows: DataFrame, vault: DataFrame | None = None) -> DataFrame:
    """key, body. A segment whose object the vault lacks is an error, as its body can't be whole."""
    if vault is not None:
        objects = vault.select(F.col("digest").alias("__d"), F.col("length").alias("__n"), F.col("body").alias("__body"))
        rows = rows.join(objects, (F.col("digest") == F.col("__d")) & (F.col("length") == F.col("__n")), "left").withColumn("tail", F.coalesce("tail", "__body"))
    lost = F.raise_error(F.concat(F.lit("the vault lacks object "), F.coalesce("digest", F.lit("?"))))
    tail = F.when(F.col("kind") == NONE, F.lit(None).cast("binary")).otherwise(F.coalesce("tail", lost.cast("binary")))
    rows = rows.select("key", "start", "head", "gen_id", "seed", "n_words", tail.alias("tail"))
    out = pa.schema([("key", pa.string()), ("start", pa.int64()), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for head, g, seed, n, tail in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                middle = expand_orbit(g, seed & (1 << 64) - 1, n) if g is not None else b""
                parts.append(None if tail is None else head + middle + tail)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, pa.binary())], schema=out)

    key_type = rows.schema["key"].dataType
    parts = rows.withColumn("key", F.col("key").cast("string")).mapInArrow(run, "key string, start long, part binary")
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("p"))
    body = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["part"]))
    return whole.select(F.col("key").cast(key_type).alias("key"), body.alias("body"))
