from pyspark.sql import functions as F

from quarry.operators.segment import fields, lines
from quarry.streaming import flows


def _drain(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streamed_fields_equal_those_of_the_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(50)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _drain(spark, flows.field_stream(stream, "doc_id"), "fields_out")
    want = fields(lines(spark.read.parquet(str(tmp_path / "in"))))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "record string, s int").select("record", F.timestamp_seconds("s").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.record for r in _drain(spark, flows.first_seen(stream, "record", "at"), "seen_out").collect()) == ["a", "b"]
