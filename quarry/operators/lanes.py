"""Fields that hold hexadecimal identifiers line after line: belief in them, and their storage as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import hex_lane

#: Detections that arm a lane, the most that count, and the length that the field before must have (fixed values).
ARMED, CEILING, LEAST_LENGTH = 2, 3, 11


def beliefs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """rows with lane (none, lower, upper), belief and confidence before the row, armed.

    Equal detections in a row confirm a lane, a different one starts afresh, rows without one change nothing. A row
    is armed if the lane is confirmed and the value before it in the order is long enough.
    """
    by = Window.partitionBy(*key).orderBy(order)
    found = rows.withColumn("lane", hex_lane(F.col(value))).withColumn("__found", F.when(F.col("lane") != "none", F.col("lane")))
    so_far = by.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("belief", F.last("__found", ignorenulls=True).over(so_far))
    found = found.withColumn("__other", (F.col("__found").isNotNull() & (~F.col("__found").eqNullSafe(F.col("belief")))).cast("int"))
    found = found.withColumn("__run", F.sum("__other").over(by))
    seen = F.count("__found").over(Window.partitionBy(*key, "__run").orderBy(order))
    found = found.withColumn("__confidence", F.when(F.col("__run") > 0, F.least(seen, F.lit(CEILING))).otherwise(0))
    found = found.withColumn("confidence", F.coalesce(F.lag("__confidence").over(by), F.lit(0)).cast("long"))
    long = F.coalesce(F.lag(F.octet_length(value)).over(by) >= LEAST_LENGTH, F.lit(False))
    return found.withColumn("armed", (F.col("confidence") >= ARMED) & long).drop("__found", "__other", "__run", "__confidence")


def packed(value: Column) -> tuple[Column, Column]:
    """A value's kind (lower, upper, raw) and bytes: two hexadecimal digits to the byte where all of it is such."""
    lane, even = hex_lane(value), F.length(value) % 2 == 0
    kind = F.when((lane == "lower") & even & value.rlike("^[0-9a-f]*$"), "lower").when((lane == "upper") & even & value.rlike("^[0-9A-F]*$"), "upper").otherwise("raw")
    return kind, F.when(kind == "raw", F.encode(value, "UTF-8")).otherwise(F.unhex(value))


def unpacked(kind: Column, body: Column) -> Column:
    """The value that packed was given."""
    return F.when(kind == "raw", F.decode(body, "UTF-8")).when(kind == "lower", F.lower(F.hex(body))).otherwise(F.hex(body))
