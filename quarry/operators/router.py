"""Choosing a lane for a group of texts from its statistics, and sending blocks by their density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import bytes_of
from quarry.operators import columnar
from quarry.operators.density import binary_counts, entropy, is_dense
from quarry.operators.dictionary import probe, profit
from quarry.operators.ordered import ranked
from quarry.operators.profile import LEAST_BYTES, LEAST_RECORDS, PRINTABLE_PERCENT, printable
from quarry.operators.segment import FIELD, blocks, lines, stanzas
from quarry.sources.storage import spool


def lanes(docs: DataFrame, group: str, key: str = "doc_id") -> DataFrame:
    """group, n_bytes, n_lines, stanza_ok, line_ok, column_ok, lane.

    In order: stanza dictionary, line dictionary, columns, core; the first whose gates all hold.
    """
    sizes = docs.groupBy(group).agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum(printable(F.col("text"))).cast("long").alias("n_printable"), F.max((F.instr("text", "\x00") > 0).cast("int")).alias("nul"), F.sum(bytes_of(F.col("text"), r"[,; \t|:]")).cast("long").alias("separators"))
    line_rows, stanza_rows = lines(docs.select(group, key, "text")), stanzas(docs.select(group, key, "text"))

    def dictionary_gate(rows: DataFrame, record: str, least: int, name: str) -> DataFrame:
        n = F.octet_length(record)
        bad = rows.groupBy(group).agg(F.max(((n < least) | (n > 4096) | (printable(F.col(record)) * 100 < n * PRINTABLE_PERCENT)).cast("int")).alias("bad"))
        found = profit(rows, group, record).join(bad, group)
        return found.select(group, F.col("n_records").alias(f"n_{name}"), ((F.col("bad") == 0) & F.col("profitable") & (F.col("n_records") >= LEAST_RECORDS)).alias(f"{name}_ok"))

    counts = line_rows.groupBy(group, F.least(F.size(F.regexp_extract_all("line", F.lit(FIELD), 0)), F.lit(64)).alias("n_fields")).agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy(group).agg(F.max("n").alias("modal"))
    head = probe(line_rows, group, [key, "line_no"], "line").select(group, "rejected")
    all_ = sizes.join(dictionary_gate(stanza_rows, "stanza", 8, "stanza"), group).join(dictionary_gate(line_rows, "line", 1, "line"), group).join(modal, group).join(head, group)
    large = (F.col("n_bytes") >= LEAST_BYTES) & (F.col("nul") == 0)
    text = large & (F.col("n_printable") * 100 >= F.col("n_bytes") * PRINTABLE_PERCENT)
    b, n = F.col("n_bytes"), F.col("n_line")
    column = text & (n >= LEAST_RECORDS) & (b >= 8 * n) & (b <= 4096 * n) & (F.col("modal") * 100 >= n * 90) & (F.col("separators") * 100 >= b * 8)
    stanza_ok, line_ok = large & F.col("stanza_ok"), large & F.col("line_ok") & ~F.col("rejected")
    lane = F.when(stanza_ok, "stanza").when(line_ok, "line").when(column, "column").otherwise("core")
    return all_.select(group, "n_bytes", F.col("n_line").alias("n_lines"), stanza_ok.alias("stanza_ok"), line_ok.alias("line_ok"), column.alias("column_ok"), lane.alias("lane"))


def encode(docs: DataFrame, group: str, key: str = "doc_id") -> dict[str, DataFrame]:
    """lanes(group, lane), and each lane's tables (named lane/table) of the groups that it accepted first.

    Stanzas and lines go through dictionaries, columns through codecs; other texts are kept as they are.
    """
    chosen = spool(lanes(docs, group, key).select(F.col(group).alias("__group"), "lane"))
    # lanes are as many as groups, and a group may hold most texts: they are joined, and texts split, by size
    rows = spool(docs.select(group, key, "text").join(chosen, F.col(group).eqNullSafe(F.col("__group")), "left").withColumn("lane", F.coalesce("lane", F.lit("core"))).drop("__group"))
    archive = {"lanes": chosen.select(F.col("__group").alias(group), "lane"), "core/texts": rows.where("lane = 'core'").select(key, "text")}
    for lane, cut in (("stanza", stanzas), ("line", lines)):
        records = cut(rows.where(F.col("lane") == lane).select(key, "text")).toDF(key, "no", "record")
        entries = ranked(records.select("record").distinct(), ["record"]).select("record", F.col("pos").alias("id"))
        archive |= {f"{lane}/dict": entries, f"{lane}/index": records.join(entries, "record").select(key, "no", "id")}
    cells = lines(rows.where("lane = 'column'").select(key, "text"))
    long = columnar.columns_of_lines(cells.select(F.struct(key, "line_no").alias("line_no"), "line"))
    archive |= {f"column/{name}": table for name, table in columnar.encode(long).items()}
    archive["texts"] = rows.where("lane <> 'core'").select(key, F.col("text").isNull().alias("null_text"))
    return {name: spool(table) for name, table in archive.items()}


def decode(archive: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """key, text of all lanes."""
    parts = [archive[f"{lane}/index"].join(archive[f"{lane}/dict"], "id").select(key, F.col("no").cast("long").alias("no"), "record") for lane in ("stanza", "line")]
    back = columnar.lines_of_columns(columnar.decode({name.partition("/")[2]: table for name, table in archive.items() if name.startswith("column/")}))
    parts.append(back.select(F.col(f"at.{key}").alias(key), F.col("at.line_no").cast("long").alias("no"), F.col("line").alias("record")))
    pieces = F.sort_array(F.collect_list(F.struct("no", "record")))
    whole = parts[0].union(parts[1]).union(parts[2]).groupBy(F.col(key).alias("__key")).agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "").alias("text"))
    texts = archive["texts"].join(whole, F.col(key).eqNullSafe(F.col("__key")), "left")
    return texts.select(key, F.when(~F.col("null_text"), F.coalesce("text", F.lit(""))).alias("text")).union(archive["core/texts"])


def block_verdicts(blobs: DataFrame, key: str, body: str) -> DataFrame:
    """key, block_no, n_bytes, bits, dense: verdicts of 256 KiB blocks by their first 64 KiB."""
    from quarry.operators.density import SAMPLE

    cut = blocks(blobs.select(key, body), body)
    sample = cut.select(key, "block_no", F.octet_length("block").cast("long").alias("n_block"), F.substring("block", 1, SAMPLE).alias("head"))
    bits = entropy(binary_counts(sample.select(key, "block_no", "n_block", "head"), [key, "block_no", "n_block"], "head"), [key, "block_no", "n_block"])
    return bits.select(key, "block_no", F.col("n_block").alias("n_bytes"), "bits", is_dense(F.col("bits"), F.col("n_bytes")).alias("dense"))
