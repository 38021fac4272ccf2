"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from loomgraph.streaming.observations import newest


def test_newest(spark, tmp_path):
    rows = [("s", "k", "prod", str(i), f"2024-01-01 00:{i:02d}:00") for i in range(20)] + [("t", "k", "prod", "x", "2024-01-05 00:00:00")]
    df = spark.createDataFrame(rows, "subject string, key string, environment string, value_json string, captured_at string").withColumn("captured_at", F.to_timestamp("captured_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = newest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("newest_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    pick = lambda d: sorted((r.subject, r.value_json, r.n) for r in d.collect())
    assert pick(spark.table("newest_out")) == pick(newest(df)) == [("s", "19", 20), ("t", "x", 1)]
