"""Byte statistics: histograms, entropy, density verdicts, context statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fold_case

#: Bits per byte above which a block counts as dense, and the least sample that can (fixed values).
DENSE_BITS, LEAST_SAMPLE, SAMPLE = 7.60, 4096, 65536


def byte_counts(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, byte (0..255), n of a text's UTF-8 (A1)."""
    return binary_counts(df.select(*key, F.encode(text, "UTF-8").alias("body")), key, "body")


def binary_counts(df: DataFrame, key: list[str], body: str) -> DataFrame:
    """key, byte, n of a binary column: each body is counted where it lies, and what moves is 256 counts at most for each."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = df.where(F.octet_length(body) > 0).select(*key, body)
    kinds = [(c, source.schema[c].dataType) for c in key]
    out = pa.schema([*((c, to_arrow_type(t)) for c, t in kinds), ("byte", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            counts = [np.bincount(np.frombuffer(b.as_buffer(), np.uint8), minlength=256) for b in batch.column(len(key))]
            if not key:
                total += sum(counts, np.zeros(256, np.int64))
            elif counts:
                rows, byte = np.nonzero(np.stack(counts))
                n = np.concatenate([c[c > 0] for c in counts])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at).cast(out.field(i).type) for i in range(len(key))), pa.array(byte, pa.int32()), pa.array(n, pa.int64())], schema=out)
        if not key:
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], schema=out)

    found = source.mapInArrow(run, ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds), "byte int", "n long"]))
    return found.groupBy(*key, "byte").agg(F.sum("n").alias("n"))


def entropy(counts: DataFrame, key: list[str]) -> DataFrame:
    """key, n_bytes, bits: Shannon entropy per byte of counts(key, byte, n) (A2)."""
    # sum of -p log2 p = log2 N - sum(n log2 n) / N
    totals = counts.groupBy(*key).agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return totals.select(*key, "n_bytes", F.round(F.log2(F.col("n_bytes").cast("double")) - F.col("s") / F.col("n_bytes"), 6).alias("bits"))


def is_dense(bits: Column, n_sampled: Column) -> Column:
    """The density verdict."""
    return (n_sampled >= LEAST_SAMPLE) & (bits > DENSE_BITS)


#: Windows counted at once, and distinct ones that a task remembers before it gives their counts (memory, not results).
WINDOWS, REMEMBERED = 1 << 20, 1 << 20


def context_counts(df: DataFrame, k: int, text: str = "text") -> DataFrame:
    """ctx, byte, n over all texts, contexts never crossing from one to the next.

    Texts are counted where they lie. What moves is a task's distinct windows of k + 1 bytes, as numbers where they
    have eight bytes at most.
    """
    source = df.where(F.octet_length(text) > k).select(F.encode(text, "UTF-8").alias("body"))
    packed = k < 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            seen = pa.array(held[0].view(np.int64)) if packed else pa.array(held[0].tolist(), pa.binary())
            return pa.RecordBatch.from_arrays([seen, pa.array(held[1])], names=["seen", "n"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            body = batch.column(0)
            if not len(body):
                continue
            _, offsets, data = body.buffers()
            wide = np.int64 if pa.types.is_large_binary(body.type) else np.int32
            ends = np.frombuffer(offsets, wide)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            data, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
            for at in range(0, len(data) - k, WINDOWS):
                windows = _windows(data[at : at + WINDOWS + k], k)
                inner = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + WINDOWS + k)] - at
                whole = np.ones(len(windows), bool)
                for i in range(1, k + 1):  # those that begin i bytes before a text's end go beyond it
                    crossing = inner - i
                    whole[crossing[(crossing >= 0) & (crossing < len(windows))]] = False
                parts.append(_tallied(windows[whole]))
                waiting += len(parts[-1][0])
                if waiting > 2 * REMEMBERED:
                    parts = [_tallied(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                    waiting = len(parts[0][0])
                    if waiting > REMEMBERED:
                        yield given(parts[0])
                        parts, waiting = [], 0
        if parts:
            yield given(_tallied(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))

    found = source.mapInArrow(run, f"seen {'long' if packed else 'binary'}, n long").groupBy("seen").agg(F.sum("n").alias("n"))
    digits = F.lpad(F.hex("seen"), 2 * k + 2, "0")
    return found.select(F.substring(digits, 1, 2 * k).alias("ctx"), F.substring(digits, 2 * k + 1, 2).alias("byte"), "n")


def _windows(data: np.ndarray, k: int) -> np.ndarray:
    """All windows of k + 1 bytes, as numbers where they fit into 64 bits."""
    if k < 8:
        out = np.zeros(len(data) - k, np.uint64)
        for i in range(k + 1):
            out = out << np.uint64(8) | data[i : len(data) - k + i]
        return out
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k + 1)).view(f"V{k + 1}").ravel()


def _tallied(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often they stand there."""
    if counts is None and values.dtype == np.uint64:
        values = np.sort(values)
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
        return values[starts], np.diff(starts, append=len(values))
    distinct, where = np.unique(values, return_inverse=True)
    if counts is None:
        return distinct, np.bincount(where, minlength=len(distinct))
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, counts)
    return distinct, total


def conditional_entropy(counts: DataFrame) -> DataFrame:
    """n, bits: entropy per byte given its context."""
    by_context = counts.groupBy("ctx").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return by_context.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.log2(F.col("n").cast("double")) - F.col("s")) / F.sum("n"), 6).alias("bits"))


def certain(counts: DataFrame, least: int = 15) -> DataFrame:
    """ctx, byte, n, n_ctx of contexts seen least times or more whose byte is all but settled.

    Such a byte has more than half of its context's count, so it is the one with the largest.
    """
    most = F.max(F.struct("n", "byte")).alias("most")
    found = counts.groupBy("ctx").agg(F.sum("n").alias("n_ctx"), most).where(F.col("n_ctx") >= least)
    return found.select("ctx", "most.byte", "most.n", "n_ctx").where(F.col("n") * 4096 > F.col("n_ctx") * 3968)


def certain_at_both(short: DataFrame, long: DataFrame, k: int) -> DataFrame:
    """The certain contexts among long whose last k bytes are certain of the same byte (P14); both from certain()."""
    ends = short.select(F.col("ctx").alias("__ctx"), F.col("byte").alias("__byte"))
    return long.join(ends, (F.right("ctx", F.lit(2 * k)) == F.col("__ctx")) & (F.col("byte") == F.col("__byte")), "left_semi")


def token_contexts(df: DataFrame, text: str = "text") -> DataFrame:
    """ctx, next, n: what follows a run of letters so far, with the character before the run; A-Z folded.

    Characters beyond ASCII count as letters. The last context of a text has no next.
    """
    folded = fold_case(F.col(text))
    runs = F.regexp_extract_all(folded, F.lit(r"[\x00-\x60\x7B-\x7F](?:[a-z]|[^\x00-\x7F])*|(?:[a-z]|[^\x00-\x7F])+"), 0)
    rows = df.select(runs.alias("r")).select(F.posexplode("r").alias("i", "run"), "r").groupBy("run", F.substring(F.get("r", F.col("i") + 1), 1, 1).alias("after")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("run", "after", "n", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("k"))
    follows = F.when(F.col("k") < F.length("run"), F.substring("run", F.col("k") + 1, F.lit(1))).otherwise(F.col("after"))
    return rows.groupBy(F.substring("run", F.lit(1), F.col("k")).alias("ctx"), follows.alias("next")).agg(F.sum("n").alias("n"))
