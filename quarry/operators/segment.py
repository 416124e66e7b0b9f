"""Cutting texts into stanzas, lines, fields, blocks and contexts. Every piece carries its address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import byte_class

LINE = r"[^\n]*\n|[^\n]+"
STANZA = r"(?s).+?\n\n|(?s).+$"
FIELD = r"[,; \t|:]+|\n+|[^,; \t|:\n]+"


def pieces(df: DataFrame, text: str, pattern: str, number: str, piece: str) -> DataFrame:
    """df without text, one row for each match: its 0-based number and itself."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias(number, piece))


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """line_no, line with its newline; a last line may lack one."""
    return pieces(df, text, LINE, "line_no", "line")


def stanzas(df: DataFrame, text: str = "text") -> DataFrame:
    """stanza_no, stanza up to and with an empty line (G1)."""
    return pieces(df, text, STANZA, "stanza_no", "stanza")


def fields(df: DataFrame, line: str = "line") -> DataFrame:
    """field_idx, value, class of maximal runs of one byte class; separators and newlines are fields too."""
    found = pieces(df, line, FIELD, "field_idx", "value")
    return found.withColumn("class", byte_class(F.substring("value", 1, 1)))


def blocks(df: DataFrame, body: str, size: int = 262144) -> DataFrame:
    """block_no, block of size bytes of a binary column."""
    rest = [c for c in df.columns if c != body]
    n = F.octet_length(body)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    cut = df.where(n > 0).select(*rest, body, F.posexplode(starts).alias("block_no", "__start"))
    return cut.select(*rest, "block_no", F.substring(F.col(body), F.col("__start") + 1, F.lit(size)).alias("block"))


def merged_runs(df: DataFrame, key: list[str], order: str, verdict: str) -> DataFrame:
    """One row for each maximal run of equal verdicts in order: key, verdict, first, last, n."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*key).orderBy(order)
    changed = F.coalesce((F.lag(verdict).over(w) != F.col(verdict)).cast("int"), F.lit(1))
    runs = df.withColumn("__change", changed).withColumn("run", F.sum("__change").over(w))
    return runs.groupBy(*key, verdict, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def hex_bytes(text: Column) -> Column:
    """The bytes of a text, each as two hexadecimal digits."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("[0-9A-F]{2}"), 0)


def contexts(df: DataFrame, k: int, text: str = "text") -> DataFrame:
    """ctx (the k bytes before), byte, of every byte that has k bytes before it in its text."""
    rest = [c for c in df.columns if c != text]
    pairs = lambda b: F.transform(F.filter(F.sequence(F.lit(k), F.greatest(F.size(b) - 1, F.lit(k))), lambda i: i < F.size(b)), lambda i: F.struct(F.array_join(F.slice(b, i - k + 1, k), "").alias("ctx"), F.get(b, i).alias("byte")))
    from quarry.functions.text import bound

    found = df.where(F.octet_length(text) > k).select(*rest, F.explode_outer(bound(hex_bytes(F.col(text)), pairs)).alias("p"))
    return found.select(*rest, "p.ctx", "p.byte")


def chunks(total: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of the i-th of n even chunks of total bytes; the first total % n have one byte more."""
    base, rest = F.floor(total / n), total % n
    return (i * base + F.least(i, rest)).cast("long"), (base + F.when(i < rest, 1).otherwise(0)).cast("long")
