"""Order over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.storage import spool


def ranked(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """df with pos, its rows' 0-based places in order; sums: new column to the column whose running total before the row it has.

    Rows are dealt by ranges of the order, numbered within each range, and shifted by what lies in earlier ranges:
    a table of one row for each partition. order must tell all rows apart.
    """
    sums = sums or {}
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id()  # the partition's number above bit 33, the row's below
    dealt = spool(dealt.withColumn("__id", within))
    dealt = dealt.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    totals = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__sum_{k}") for k, c in sums.items()))
    rows = sorted(totals.collect())  # one row for each partition
    starts, n, run = [], 0, [0] * len(sums)
    for row in rows:
        starts.append((row[0], n, *run))
        n += row[1]
        run = [a + (b or 0) for a, b in zip(run, row[2:], strict=True)]
    if not starts:
        starts = [(0, 0, *run)]
    offsets = spark.createDataFrame(starts, ", ".join(["__p long", "__start long", *(f"__before_{k} long" for k in sums)]))
    found = dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    out = found.withColumn("pos", F.col("__start") + F.col("__at"))
    if sums:
        from pyspark.sql.window import Window

        before = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        for k, c in sums.items():
            out = out.withColumn(k, F.col(f"__before_{k}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.select(*df.columns, "pos", *sums)


#: Rows that one window looks at when each is given the row before it.
STRETCH = 1 << 14


def with_previous(rows: DataFrame, columns: list[str], group: list[str] = ()) -> DataFrame:
    """rows (which have pos) with prev_<column> of the row before, null at the start and where the group changes.

    One shuffle, by stretches of places; the last row of each stretch is handed on to the next one.
    """
    from pyspark.sql.window import Window

    held = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)), *(F.col(c).alias(f"g{i}") for i, c in enumerate(group)))
    stretch = F.floor(F.col("pos") / STRETCH).cast("long")
    handed = rows.where(F.col("pos") % STRETCH == STRETCH - 1).select((stretch + 1).alias("__next"), held.alias("__handed"))
    placed = rows.withColumn("__stretch", stretch)
    placed = placed.withColumn("__before", F.lag(held).over(Window.partitionBy("__stretch").orderBy("pos")))
    placed = placed.join(handed, F.col("__stretch") == F.col("__next"), "left")
    before = F.when(F.col("pos") % STRETCH == 0, F.col("__handed")).otherwise(F.col("__before"))
    same = before.isNotNull()
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(before[f"g{i}"])
    return placed.select(*rows.columns, *(F.when(same, before[f"v{i}"]).alias(f"prev_{c}") for i, c in enumerate(columns)))


def ranked_within(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with pos (over all) and place, the 0-based place within the group; a hot group is spread like any other."""
    rows = ranked(df, [*group, *order])  # its rows are written down already, their places are one addition away
    first = spool(rows.groupBy(*group).agg(F.min("pos").alias("__first"))).select(*(F.col(c).alias(f"__{c}") for c in group), "__first")
    same: Column = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(first, same).withColumn("place", F.col("pos") - F.col("__first")).select(*rows.columns, "place")
