"""Counters: a fold over ordered values that locks on to a constant step."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence that allows a prediction, and its ceiling (fixed values).
SURE, CEILING = 3, 63


class Lock:
    """State of one sequence. A break of the step keeps the value and forgets the step."""

    __slots__ = ("confidence", "step", "value")

    def __init__(self):
        self.confidence, self.value, self.step = 0, 0, 0

    def prediction(self) -> int | None:
        return self.value + self.step if self.confidence >= SURE and self.value + self.step >= 0 else None

    def feed(self, value: int) -> None:
        if self.confidence == 0:
            self.confidence = 1
        elif self.confidence == 1:
            if value != self.value:
                self.step, self.confidence = value - self.value, 2
        elif self.step and value - self.value == self.step:
            self.confidence = min(CEILING, self.confidence + 1)
        else:
            self.confidence = 1
        self.value = value


class Cell:
    """An adaptive probability of 12 bits: it moves by 2^-2 of the error at first and by 2^-6 later."""

    __slots__ = ("n", "p")

    def __init__(self):
        self.p, self.n = 2048, 0

    def feed(self, bit: int) -> None:
        rate = min(6, 2 + (self.n >> 1))
        self.p = min(4094, self.p + max(1, (4096 - self.p) >> rate)) if bit else max(1, self.p - max(1, self.p >> rate))
        self.n = min(15, self.n + 1)


class _Locked:
    """A lock and how often it foretold a value, and rightly."""

    def __init__(self):
        self.lock, self.n, self.asked, self.hit = Lock(), 0, 0, 0

    def feed(self, value: int) -> None:
        p = self.lock.prediction()
        self.n, self.asked, self.hit = self.n + 1, self.asked + (p is not None), self.hit + (p is not None and p == value)
        self.lock.feed(value)

    def row(self) -> tuple:
        return self.n, self.asked, self.hit, self.lock.confidence


class _Celled(Cell):
    def row(self) -> tuple:
        return self.p, self.n


def _folded(rows: DataFrame, key: str, order: str, value: str, make: type, columns: list[str]) -> DataFrame:
    """key and the columns that make().row() gives once it was fed a key's values in their order.

    A fold is sequential by its nature. Rows are sorted within partitions and folded as they stream by, so that a
    long sequence costs time but no memory.
    """
    out = pa.schema([("key", pa.int64()), *((c, pa.int64()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != current:
                    if state is not None:
                        done.append((current, *state.row()))
                    current, state = k, make()
                state.feed(v)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], schema=out)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (current, *state.row())], schema=out)

    ordered = rows.select(F.col(key).cast("long").alias("k"), F.col(value).cast("long").alias("v"), F.col(order).alias("o"))
    ordered = ordered.where("k IS NOT NULL AND v IS NOT NULL").repartition("k").sortWithinPartitions("k", "o", "v").select("k", "v")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *columns)))


def locked(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, n, asked, hit, confidence: of each sequence of whole numbers, how often it was predicted, and rightly."""
    return _folded(rows, key, order, value, _Locked, ["n", "asked", "hit", "confidence"])


def adaptive_cells(rows: DataFrame, key: str, order: str, bit: str) -> DataFrame:
    """key, p, n: a probability cell for each key, fed with its bits."""
    return _folded(rows, key, order, bit, _Celled, ["p", "n"]).select(F.col("key").alias(key), F.col("p").cast("int").alias("p"), F.col("n").cast("int").alias("n"))
