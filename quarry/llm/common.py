"""Helpers of the corpus operators: shared storage, lineage cuts, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.storage import cut, shared_dir, spool

__all__ = ["cut", "discard", "fold", "has_unique", "is_held_out", "numbered", "per_row", "released", "shared_dir", "short_batches", "small_or_shuffled", "spool", "without"]

#: Rows turned into Python objects at once; bounds a worker's memory when texts are long.
SLICE_ROWS = 64


#: Rows of an Arrow batch of whole texts: it is held in the JVM and in Python at once, in every running task.
BATCH_ROWS = 1000


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside give Python batches of BATCH_ROWS rows at most. The size changes no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives what it has freed back to the system: it may wait for its next task for long."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return lean


def discard(spooled: DataFrame) -> None:
    """Deletes the files of a spooled table that no later step reads."""
    context = spooled.sparkSession.sparkContext
    for file in {f.rpartition("/")[0] for f in spooled.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Up to this many rows, and bytes in them, go to every executor with a scan; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 64_000_000


def small_or_shuffled(ids: DataFrame) -> DataFrame:
    """ids for the right side of a join with texts: broadcast if a count proves them few and short, else as they are."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in ids.dtypes]
    size = sum(sizes, F.lit(0)).cast("long")
    found = ids.limit(BROADCAST_IDS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(ids) if found["n"] <= BROADCAST_IDS and found["bytes"] <= BROADCAST_BYTES else ids


#: A row's number in a spooled table; ids may repeat or be null.
ROW = "__quarry_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, written down so that every later scan sees the same numbers."""
    return spool(docs.withColumn(ROW, F.monotonically_increasing_id()))


def has_unique(docs: DataFrame, id_col: str) -> bool:
    """Whether no id is null or stands in two rows; ids alone are read."""
    ids = docs.select(F.col(id_col).alias("id"))
    return ids.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty()


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is among ids(doc_id)."""
    gone = spool(ids.select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(small_or_shuffled(gone), docs[id_col] == F.col("__gone"), "left_anti")


def fold(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that matter, under fixed names; whatever else the frame has cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def is_held_out(id_column: Column) -> Column:
    """True where crc32 of the id's text leaves 1 when divided by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


def per_row(schema: pa.Schema, make: Callable[[], Callable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function. make() builds, once a task, the function from (id, text, ...) to the row's columns after the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = [act(*row) for row in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))],
                    schema=schema,
                )

    return run
