"""Columnar encoding: a codec for each column, typed tables for the values, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import common_prefix_bytes, format_ts, padded, parse_ts, unzigzag, zigzag
from quarry.operators.ordered import ranked_within, with_previous
from quarry.operators.profile import codecs_of_placed
from quarry.operators.segment import fields
from quarry.sources.storage import spool

#: Rows after which a front-coded column starts afresh with a whole value, which bounds the fold of its decoder.
BLOCK = 1024


def encode(long: DataFrame) -> dict[str, DataFrame]:
    """Tables of column, at, value rows: codecs, dict, index, delta, times, raw, places.

    codecs holds constants and sequences whole: first value and step. A column's rows are at unique places.
    """
    placed = spool(ranked_within(long.select("column", "at", "value"), ["column"], ["at"]))
    choice = codecs_of_placed(placed)
    firsts = placed.where("place < 2").groupBy("column").agg(F.max(F.when(F.col("place") == 0, F.col("value"))).alias("first"), F.max(F.when(F.col("place") == 1, F.col("value"))).alias("second"))
    step = F.col("second").try_cast("long") - F.col("first").try_cast("long")
    codecs = spool(choice.join(firsts, "column").select("column", "codec", "n_rows", "first", F.when(F.col("codec") == "seq", step).alias("step")))
    rows = placed.join(codecs.select("column", "codec"), "column")

    entries = rows.where("codec = 'dict'").groupBy("column", "value").agg(F.min("place").alias("seen"))
    entries = spool(ranked_within(entries, ["column"], ["seen"]).select("column", "value", F.col("place").alias("slot")))
    index = rows.where("codec = 'dict'").join(entries, ["column", "value"]).select("column", "at", "slot")

    front = with_previous(rows.where("codec = 'prefix'").select("column", "at", "place", "pos", "value"), ["value"], ["column"])
    shared = F.when(F.col("place") % BLOCK == 0, 0).otherwise(common_prefix_bytes(F.col("value"), F.col("prev_value")))
    front = front.withColumn("lcp", F.coalesce(shared, F.lit(0)))
    delta = front.select("column", "at", "place", "lcp", F.substring(F.encode("value", "UTF-8"), F.col("lcp") + 1, F.octet_length("value")).alias("suffix"))
    times = with_previous(rows.where("codec = 'ts'").select("column", "at", "place", "pos", parse_ts(F.col("value")).alias("ms")), ["ms"], ["column"])
    times = times.select("column", "at", "place", zigzag(F.col("ms") - F.when(F.col("place") % BLOCK == 0, F.lit(0)).otherwise(F.col("prev_ms"))).alias("step"))
    raw = rows.where("codec = 'raw'").select("column", "at", "value")
    places = placed.join(codecs.where("codec IN ('const', 'seq')").select("column"), "column").select("column", "at", "place")
    return {"codecs": codecs, "dict": entries, "index": index, "delta": delta, "times": times, "raw": raw, "places": places}


def decode(archive: dict[str, DataFrame]) -> DataFrame:
    """column, at, value."""
    codecs = archive["codecs"]
    stepped = padded(F.col("first").try_cast("long") + F.col("place") * F.col("step"), F.lit(1))
    fixed = archive["places"].join(codecs, "column").select("column", "at", F.when(F.col("codec") == "const", F.col("first")).otherwise(stepped).alias("value"))
    coded = archive["index"].join(archive["dict"], ["column", "slot"]).select("column", "at", "value")

    def restore(done: Column, x: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1)["value"], F.unhex(F.lit("")))
        return F.concat(done, F.array(F.struct(x["at"].alias("at"), F.concat(F.substring(last, F.lit(1), x["lcp"]), x["suffix"]).alias("value"))))

    delta = archive["delta"]
    at_type = delta.schema["at"].dataType.simpleString()
    parts = F.sort_array(F.collect_list(F.struct("place", "at", "lcp", "suffix")))
    folded = F.aggregate(parts, F.array().cast(f"array<struct<at: {at_type}, value: binary>>"), restore)
    front = delta.groupBy("column", F.floor(F.col("place") / BLOCK).alias("block")).agg(folded.alias("rows"))
    front = front.select("column", F.explode("rows").alias("r")).select("column", "r.at", F.decode("r.value", "UTF-8").alias("value"))
    within = Window.partitionBy("column", F.floor(F.col("place") / BLOCK)).orderBy("place")
    times = archive["times"].select("column", "at", format_ts(F.sum(unzigzag(F.col("step"))).over(within)).alias("value"))
    return fixed.unionByName(coded).unionByName(front).unionByName(times).unionByName(archive["raw"])


def columns_of_lines(lines: DataFrame, at: str = "line_no", line: str = "line") -> DataFrame:
    """column (the field's index), at, value of lines."""
    found = fields(lines.select(F.col(at).alias("at"), F.col(line).alias("line")))
    return found.select(F.format_string("%05d", "field_idx").alias("column"), "at", "value")


def lines_of_columns(long: DataFrame) -> DataFrame:
    """at, line."""
    parts = F.sort_array(F.collect_list(F.struct("column", "value")))
    return long.groupBy("at").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("line"))
