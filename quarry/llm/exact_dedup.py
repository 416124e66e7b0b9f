"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows of one length are candidates; of these, rows whose first characters hash alike; of these, rows with one full
digest. Each level only looks at rows that share their key so far with another row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ROW, has_unique, numbered, small_or_shuffled, spool, without

#: What counts as white space (fixed values).
BLANK = r"\x20\x09-\x0D"
#: Runs of white space other than one space: only these are rewritten.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), RUNS, " ")


def shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key another row has too.

    Keys are counted before any row moves, and rows don't move at all while the repeated keys are few enough to be
    broadcast; beyond that by a shuffle, where a hot key's rows are split.
    """
    names = [F.col(k).alias(f"__{k}") for k in key]
    repeated = spool(rows.groupBy(*key).count().where("count > 1").select(*names))
    same = [F.col(k) == F.col(f"__{k}") for k in key]
    return rows.join(small_or_shuffled(repeated), same, "left_semi")


#: Places of the bitmap that marks keys worth reading texts for: 16 MB whatever the table's size.
MARKS = 1 << 27


def marked(keys: DataFrame) -> DataFrame:
    """A bitmap of keys(mark) in rows (__bucket, __bits) of 32,768 places each."""
    return keys.groupBy(F.bitmap_bucket_number("mark").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("__bits"))


def is_marked(docs: DataFrame, mark: Column, bitmap: DataFrame) -> DataFrame:
    """The rows of docs whose mark is set, and no others; docs stay where they are, the bitmap has a fixed size."""
    held = docs.withColumn("__mark", mark).join(F.broadcast(bitmap), F.bitmap_bucket_number("__mark") == F.col("__bucket"))
    place = F.bitmap_bit_position("__mark")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return held.where(F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("__mark", "__bucket", "__bits")


def classes(docs: DataFrame, prefix_chars: int = 256, digest_all: bool = True, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256; row_col too, if it names unique row numbers.

    Texts are equal if their normalised forms are. The row with the smallest id stays; null ids come last, and of
    rows with one id and one text exactly one stays. Null texts equal empty ones; very long texts are hashed whole.
    With digest_all the digest of every row is taken while its length is; otherwise full texts are read again, for
    surviving groups alone, and text_sha256 is null for rows that no other row resembles. An empty table gives an
    empty result. Columns other than the two named are ignored.
    """
    if not digest_all and not row_col:  # texts are read twice: rows need names
        docs = numbered(docs)
    row = F.col(row_col or ROW) if row_col or not digest_all else F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), row.alias("row"))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    length, prefix = F.octet_length("norm").cast("long"), F.xxhash64(F.substring("norm", 1, prefix_chars))
    facts = spool(base.select("doc_id", length.alias("length"), prefix.alias("prefix"), "row", *([digest.alias("text_sha256")] if digest_all else [])))

    survivors = shared(shared(facts, ["length"]), ["length", "prefix"])
    if not digest_all:
        mark = lambda n, p: F.pmod(F.xxhash64(n, p), F.lit(MARKS)) + 1
        bitmap = spool(marked(survivors.select(mark(F.col("length"), F.col("prefix")).alias("mark"))))
        digests = spool(is_marked(base, mark(length, prefix), bitmap).select(F.col("row").alias("__row"), digest.alias("text_sha256")))
        facts = facts.join(digests, F.col("row") == F.col("__row"), "left").drop("__row")
        survivors = facts.where(F.col("text_sha256").isNotNull())

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    groups = survivors.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = spool(groups.select(F.col("text_sha256").alias("key"), F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row"), "n"))

    alone = F.col("key").isNull()
    return facts.join(groups, facts.text_sha256 == groups.key, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        *([F.col("row").alias(row_col)] if row_col and row_col != "doc_id" else []),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that classes() drops, by progressive refinement: only survivors' full texts are hashed.

    Rows go by their ids if these are unique, else by numbers: ids may repeat or be null, and of repeated rows one
    stays. Null and empty texts are equal. All columns are kept, whatever their names; an empty table stays empty.
    """
    row = id_col if has_unique(docs, id_col) else ROW
    docs = docs if row == id_col else numbered(docs)
    gone = classes(docs, digest_all=False, id_col=id_col, text_col=text_col, row_col=row).where("NOT kept")
    return without(docs, gone.select(F.col(row).alias("doc_id")), row).drop(ROW)
