"""Statistics of texts and columns, and the gates that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import bound, bytes_of, common_prefix_bytes, is_number, parse_ts, prefixed_len, varint_len, zigzag
from quarry.operators.ordered import ranked, with_previous
from quarry.operators.segment import FIELD, LINE

#: Gates (fixed values): printable share in percent; records and bytes a lane asks for.
PRINTABLE_PERCENT, LEAST_BYTES, LEAST_RECORDS = 85, 4096, 64
SHAPE_BYTES, SHAPE_LINES = 1 << 20, 256


def printable(text: Column) -> Column:
    """Printable bytes: 0x20-0x7E, newline, tab, carriage return (A3)."""
    return bytes_of(text, r"[\x20-\x7E\n\t\r]")


def printable_profile(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_bytes, n_printable, has_nul, accepted."""
    t = F.col(text)
    n, p, nul = F.octet_length(t).cast("long"), printable(t).cast("long"), F.coalesce(F.instr(t, "\x00") > 0, F.lit(False))
    return df.select(key, n.alias("n_bytes"), p.alias("n_printable"), nul.alias("has_nul"), (~nul & (p * 100 >= n * PRINTABLE_PERCENT)).alias("accepted"))


def line_stats(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_lines, n_bytes, max_fields, longest, and which lanes' size gates it passes."""
    t = F.col(text)

    def stats(lines: Column) -> Column:
        n_fields = F.transform(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit(FIELD), 0)))
        lengths = F.transform(lines, lambda x: F.octet_length(x))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.array_max(n_fields), F.lit(0)).cast("long").alias("max_fields"), F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest"))

    found = df.select(key, F.octet_length(t).cast("long").alias("n_bytes"), bound(F.regexp_extract_all(t, F.lit(LINE), 0), stats).alias("s")).select(key, "n_bytes", "s.*")
    n, b = F.col("n_lines"), F.col("n_bytes")
    mean = (b >= 8 * n) & (b <= 4096 * n) & (n > 0)
    return found.select(
        key, "n_bytes", "n_lines", "max_fields", "longest",
        (mean & (b >= LEAST_BYTES) & (n >= LEAST_RECORDS)).alias("column_gate"),
        ((F.col("longest") <= 4096) & (b >= LEAST_BYTES) & (n >= LEAST_RECORDS)).alias("record_gate"),
        (mean & (b >= SHAPE_BYTES) & (n >= SHAPE_LINES)).alias("shape_gate"),
    )


def modal_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_lines, modal_fields (counts of 64 and more are one), modal_lines, separator_bytes, n_bytes, columnar."""
    t = F.col(text)

    def of(counts: Column) -> Column:
        grouped = F.transform(F.array_distinct(counts), lambda v: F.struct(F.size(F.filter(counts, lambda x: x == v)).alias("n"), (-v).alias("minus")))
        return F.struct(F.size(counts).cast("long").alias("n_lines"), F.array_max(grouped).alias("m"))

    counts = F.transform(F.regexp_extract_all(t, F.lit(LINE), 0), lambda x: F.least(F.size(F.regexp_extract_all(x, F.lit(FIELD), 0)), F.lit(64)))
    found = df.select(key, bound(counts, of).alias("s"), bytes_of(t, r"[,; \t|:]").cast("long").alias("separator_bytes"), F.octet_length(t).cast("long").alias("n_bytes"))
    n, m = F.col("s.n_lines"), F.coalesce(F.col("s.m.n"), F.lit(0)).cast("long")
    columnar = (m * 100 >= n * 90) & (F.col("separator_bytes") * 100 >= F.col("n_bytes") * 8) & (n > 0)
    return found.select(key, n.alias("n_lines"), (-F.col("s.m.minus")).cast("long").alias("modal_fields"), m.alias("modal_lines"), "separator_bytes", "n_bytes", columnar.alias("columnar"))


def as_columns(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """column, at, value: the table in long form, values as text, at the row's order."""
    return df.select(F.col(order).alias("at"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("at", columns, "column", "value").select("column", "at", "value")


def distinct_profile(long: DataFrame) -> DataFrame:
    """column, n_rows, n_distinct, is_const, is_dict (at most 256 values) of column, value rows."""
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    n = values.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return n.select("column", "n_rows", "n_distinct", (F.col("n_distinct") == 1).alias("is_const"), (F.col("n_distinct") <= 256).alias("is_dict"))


def immediate_repeats(long: DataFrame) -> DataFrame:
    """column, n_rows, n_repeats: values equal to the one before them."""
    rows = with_previous(ranked(long.select("column", "at", "value"), ["column", "at"]), ["value"], ["column"])
    return rows.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(F.col("value") == F.col("prev_value"), F.lit(False)).cast("long")).alias("n_repeats"))


#: The largest step, in milliseconds, that times may have to be stored by their steps (fixed value).
MOST_STEP = 1 << 30


def column_codecs(long: DataFrame) -> DataFrame:
    """Per column of column, at, value rows: counts, costs in bytes and the codec chosen.

    Columns are ordered by at, whole tables at once: rows are dealt by ranges, so that a long column is no one's task.
    """
    return codecs_of_placed(ranked(long.select("column", "at", "value"), ["column", "at"]))


def codecs_of_placed(placed: DataFrame) -> DataFrame:
    """column_codecs of rows that have their pos.

    The first that holds: const, seq (numbers with one step that render back), dict (at most 256 values), ts (times
    that render back, by their steps, if no dearer than prefix and cheaper than raw), prefix if cheaper than raw, raw.
    """
    rows = with_previous(placed.select("column", "value", "pos", parse_ts(F.col("value")).alias("ms")), ["value", "ms"], ["column"])
    v, p = F.col("value"), F.col("prev_value")
    n = F.octet_length(v)
    raw = prefixed_len(n)
    number = F.when(is_number(v) & (F.length(v) <= 18), v.try_cast("long"))
    before = F.when(is_number(p) & (F.length(p) <= 18), p.try_cast("long"))
    plain = F.coalesce(number.cast("string") == v, F.lit(False))
    rows = rows.select("column", "value", "prev_value", n.alias("n"), common_prefix_bytes(v, p).alias("shared"), (F.col("ms") - F.col("prev_ms")).alias("delta"), F.col("ms").isNotNull().alias("is_ts"))
    shared, n = F.col("shared"), F.col("n")
    prefix = F.when(p.isNull(), raw).otherwise(varint_len(shared) + varint_len(n - shared) + n - shared)
    stepped = F.when(p.isNull(), raw).otherwise(varint_len(zigzag(F.col("delta"))))
    costs = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(raw).cast("long").alias("raw_cost"), F.sum(prefix).cast("long").alias("prefix_cost"),
        F.sum(stepped).cast("long").alias("ts_sum"), F.min((F.col("is_ts") & (p.isNull() | F.coalesce(F.abs("delta") <= MOST_STEP, F.lit(False)))).cast("int")).alias("all_ts"),
        F.min(number - before).alias("least_step"), F.max(number - before).alias("most_step"), F.min(plain.cast("int")).alias("plain"),
    ).withColumn("ts_cost", F.when(F.col("all_ts") == 1, F.col("ts_sum")))
    both = distinct_profile(placed).select("column", "n_distinct").join(costs, "column")
    seq = (F.col("plain") == 1) & (F.col("least_step") == F.col("most_step"))
    ts = (F.col("ts_cost") <= F.col("prefix_cost")) & (F.col("ts_cost") < F.col("raw_cost"))
    codec = F.when(F.col("n_distinct") == 1, "const").when(seq, "seq").when(F.col("n_distinct") <= 256, "dict").when(ts, "ts").when(F.col("prefix_cost") < F.col("raw_cost"), "prefix").otherwise("raw")
    return both.select("column", "n_rows", "n_distinct", "raw_cost", "prefix_cost", "ts_cost", codec.alias("codec"))
