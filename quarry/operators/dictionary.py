"""Record dictionaries: distinct records, their order, their front coding, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import common_prefix_bytes, varint_len
from quarry.operators.ordered import ranked, with_previous
from quarry.operators.segment import LINE, lines
from quarry.sources.storage import spool


def distinct_records(records: DataFrame, address: list[str], record: str) -> DataFrame:
    """record, n, first (a struct of the smallest address), in one aggregation."""
    return records.groupBy(record).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*address)).alias("first"))


def dictionary(records: DataFrame, record: str) -> DataFrame:
    """record, id (its rank in byte order), lcp with the record before, suffix (bytes left), cost."""
    rows = with_previous(ranked(records.select(record).distinct(), [record]), [record])
    shared = F.when(F.col("pos") > 0, common_prefix_bytes(F.col(record), F.col(f"prev_{record}"))).otherwise(0)
    found = rows.select(record, F.col("pos").alias("id"), shared.alias("lcp"), (F.octet_length(record) - shared).alias("suffix"))
    return found.withColumn("cost", varint_len(F.col("lcp")) + varint_len(F.col("suffix")) + F.col("suffix"))


def encode_lines(docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """dict(line, id), index(key, line_no, id) of the texts' lines, and texts(key, n_lines: null for a null text)."""
    records = lines(docs.select(key, "text"))
    entries = ranked(records.select("line").distinct(), ["line"]).select("line", F.col("pos").alias("id"))
    texts = docs.select(key, F.size(F.regexp_extract_all("text", F.lit(LINE), 0)).cast("long").alias("n_lines"))
    return {"dict": entries, "index": records.join(entries, "line").select(key, "line_no", "id"), "texts": texts.withColumn("n_lines", F.when(F.col("n_lines") >= 0, F.col("n_lines")))}


def decode_lines(archive: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """key, text (E2, J2): texts without lines are empty or null, as they were. A line that is missing is an error."""
    rows = archive["index"].join(archive["dict"], "id")
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    whole = rows.groupBy(F.col(key).alias("__key")).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text"), F.count(F.lit(1)).alias("n"))
    found = archive["texts"].join(whole, F.col(key).eqNullSafe(F.col("__key")) & (F.col("n_lines") > 0), "left")
    lost = F.raise_error(F.concat(F.lit("lines are missing of text "), F.coalesce(F.col(key).cast("string"), F.lit("?")))).cast("string")
    text = F.when(F.col("n_lines") == 0, "").when(F.col("n_lines").isNull() | (F.col("n_lines") == F.col("n")), F.col("text")).otherwise(lost)
    return found.select(key, text.alias("text"))


def encoded_size(records: DataFrame, record: str) -> DataFrame:
    """n_bytes, dict_bytes, index_bytes, ratio: of a record dictionary and its stream of ids, before any entropy coder."""
    entries = spool(dictionary(records, record))
    index = records.join(entries.select(record, "id"), record).agg(F.sum(F.octet_length(record)).cast("long").alias("n_bytes"), F.sum(varint_len(F.col("id"))).cast("long").alias("index_bytes"))
    found = entries.agg(F.sum("cost").cast("long").alias("dict_bytes")).crossJoin(index)  # one row each
    return found.select("n_bytes", "dict_bytes", "index_bytes", F.round(F.col("n_bytes") / (F.col("dict_bytes") + F.col("index_bytes") + 8), 6).alias("ratio"))


def profit(records: DataFrame, group: str, record: str) -> DataFrame:
    """group, n_records, n_distinct, saved_bytes, profitable: at most two thirds of the records are distinct."""
    each = records.groupBy(group, record).agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy(group).agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_distinct"), F.sum((F.col("n") - 1) * F.octet_length(record)).cast("long").alias("saved_bytes"))
    return found.withColumn("profitable", F.col("n_distinct") * 3 <= F.col("n_records") * 2)


def probe(records: DataFrame, group: str, order: list[str], record: str, most_rows: int = 8192, most_bytes: int = 1 << 20) -> DataFrame:
    """group, seen, duplicates, rejected, of each group's first records in order: a sampling operator.

    Places and running bytes come from ordered ranges, so that a group of any size is no one's task.
    """
    rows = spool(ranked(records.withColumn("n_bytes", F.octet_length(record).cast("long")), [group, *order], {"bytes_before": "n_bytes"}))
    first = rows.groupBy(group).agg(F.min("pos").alias("__first"), F.min("bytes_before").alias("__bytes"))
    head = rows.join(first, group).where((F.col("pos") - F.col("__first") < most_rows) & (F.col("bytes_before") - F.col("__bytes") < most_bytes))
    found = head.groupBy(group, record).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.sum("n").alias("seen"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
    return found.withColumn("rejected", (F.col("seen") >= 1024) & (F.col("duplicates") * 8 < F.col("seen")))
