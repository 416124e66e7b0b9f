"""Intermediate and archived tables, on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is absent, one of this machine, in local sessions only."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return where or known.get()
    if not where and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    where = where or tempfile.mkdtemp(prefix="quarry-")
    context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: for small frames that many later steps read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spool(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, for wide or large intermediate results. Deleted when the driver ends."""
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(where)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def read_blobs(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, content of whole files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "content")


def write_archive(tables: dict[str, DataFrame], where: str) -> None:
    """The tables of one encoding, and a manifest of their rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{where}/{name}")
    rows = [(name, spark.read.parquet(f"{where}/{name}").count()) for name in tables]
    spark.createDataFrame(rows, "name string, n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{where}/manifest")


def read_archive(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    """The archive's tables; an error if one of them has not the rows that the manifest promises."""
    tables = {}
    for row in spark.read.parquet(f"{where}/manifest").collect():
        tables[row.name] = spark.read.parquet(f"{where}/{row.name}")
        if tables[row.name].count() != row.n_rows:
            raise ValueError(f"table {row.name} of this archive is incomplete")
    return tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vault_put(vault: DataFrame, objects: DataFrame) -> DataFrame:
    """The rows (digest, length, body) that the vault lacks; objects(body). Equal bodies count once."""
    fresh = objects.select(F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("length"), "body").dropDuplicates(["digest", "length"])
    return fresh.join(vault.select("digest", "length"), ["digest", "length"], "left_anti")


def vault_get(vault: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies of wanted(digest, length), and the rows of wanted that the vault lacks."""
    return wanted.join(vault, ["digest", "length"]), wanted.join(vault.select("digest", "length"), ["digest", "length"], "left_anti")
