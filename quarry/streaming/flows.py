"""The stateless operators on streams, and first-seen records with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import hex_lane, longest_digits
from quarry.operators.profile import printable_profile
from quarry.operators.segment import fields, lines


def line_stream(stream: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of a stream of texts; the same expressions as for tables."""
    return lines(stream.select(key, F.col(text).alias("text")))


def field_stream(stream: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Fields with their class, lane and longest digit run."""
    found = fields(line_stream(stream, key, text))
    return found.withColumn("lane", hex_lane(F.col("value"))).withColumn("digits", longest_digits(F.col("value")))


def text_gate(stream: DataFrame, key: str, text: str = "text") -> DataFrame:
    return printable_profile(stream, key, text)


def first_seen(stream: DataFrame, record: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Records not seen within the watermark: state is dropped as the watermark passes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([record])


def record_counts(stream: DataFrame, record: str, at: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts of records by event-time window; late rows up to delay count."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), record).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), record, "n")
