"""Grouping lines by their shape, and restoring their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import columnar
from quarry.operators.ordered import ranked_within
from quarry.operators.segment import fields
from quarry.sources.storage import spool

#: Lines a shape needs, shapes a lane allows, percent of bytes the eligible shapes must cover (fixed values).
LEAST_LINES, MOST_SHAPES, COVER_PERCENT = 128, 64, 70


def signature(line: Column) -> Column:
    """The classes of a line's fields in their order: 0 separators, 1 content, 2 newline."""
    marks = F.regexp_replace(F.regexp_replace(line, r"[^,; \t|:\n]+", "x"), r"[,; \t|:]+", "s")
    return F.translate(marks, "xs\n", "102")


def groups(records: DataFrame, address: list[str]) -> DataFrame:
    """sig, n_lines, n_bytes, first (struct), eligible."""
    found = records.groupBy(signature(F.col("line")).alias("sig")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("line")).cast("long").alias("n_bytes"), F.min(F.struct(*address)).alias("first"))
    return found.withColumn("eligible", F.col("n_lines") >= LEAST_LINES)


def verdict(shapes: DataFrame) -> DataFrame:
    """n_shapes, covered_bytes, n_bytes, accepted: the lane as a whole."""
    found = shapes.agg(F.count(F.lit(1)).alias("n_shapes"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("n_bytes"))), F.lit(0)).alias("covered_bytes"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
    return found.withColumn("accepted", (F.col("n_shapes") <= MOST_SHAPES) & (F.col("covered_bytes") * 100 >= F.col("n_bytes") * COVER_PERCENT))


def residue(records: DataFrame, shapes: DataFrame) -> DataFrame:
    """The lines whose shape is not eligible."""
    return records.withColumn("sig", signature(F.col("line"))).join(shapes.where("eligible").select("sig"), "sig", "left_anti")


def encode(records: DataFrame, address: list[str]) -> dict[str, DataFrame]:
    """body(sig, place, line): lines by shape; order(address, sig): the shapes in the order of the lines (E5)."""
    placed = ranked_within(records.withColumn("sig", signature(F.col("line"))), ["sig"], address)
    return {"body": placed.select("sig", "place", "line"), "order": placed.select(*address, "sig")}


def encode_columns(records: DataFrame, address: list[str]) -> dict[str, DataFrame]:
    """order(address, sig), residue(sig, place, line) of shapes with few lines, and the columns of all others, each
    field of each shape by a codec of its own (E5). Where the lane as a whole is not accepted all lines are residue.
    """
    placed = spool(ranked_within(records.withColumn("sig", signature(F.col("line"))), ["sig"], address))
    found = groups(records, address)
    large = spool(found.crossJoin(verdict(found).select("accepted")).where("eligible AND accepted").select("sig"))  # one verdict
    rows = placed.join(large, "sig", "left_semi").select("sig", "place", "line")
    parts = fields(rows).select(F.concat_ws(":", "sig", F.format_string("%05d", "field_idx")).alias("column"), F.col("place").alias("at"), "value")
    residue_rows = placed.join(large, "sig", "left_anti").select("sig", "place", "line")
    return {"order": placed.select(*address, "sig"), "residue": residue_rows, **columnar.encode(parts)}


def decode_columns(archive: dict[str, DataFrame], address: list[str]) -> DataFrame:
    """address, line."""
    values = columnar.decode(archive).select(F.split_part("column", F.lit(":"), F.lit(1)).alias("sig"), F.split_part("column", F.lit(":"), F.lit(2)).alias("field"), F.col("at").alias("place"), "value")
    parts = F.sort_array(F.collect_list(F.struct("field", "value")))
    body = values.groupBy("sig", "place").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("line"))
    return decode({"order": archive["order"], "body": body.unionByName(archive["residue"])}, address)


def decode(archive: dict[str, DataFrame], address: list[str]) -> DataFrame:
    """address, line: the k-th line of a shape goes where the order has that shape for the k-th time."""
    return ranked_within(archive["order"], ["sig"], address).join(archive["body"], ["sig", "place"]).select(*address, "line")
