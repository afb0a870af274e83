"""Streams over files give what the batch gives."""

from pyspark.sql import functions as F

from ledgerscope.sources import fixture
from ledgerscope.streaming import monitor


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = fixture.ledger(spark, "/root/testdata/sf0.001").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    path = f"file://{tmp_path}/in"
    rows.unionAll(rows.limit(50)).repartition(2).write.parquet(path)
    stream = monitor.deliveries(spark.readStream.schema(rows.schema).parquet(path), "60 days")
    query = monitor.hourly_rates(stream, "60 minutes").writeStream.outputMode("append").format("memory").queryName("rates").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    query.awaitTermination(120)
    once = stream_rows = spark.read.parquet(path).dropDuplicates(["source_txn_id"])
    batch = monitor.hourly_rates(once, "60 minutes")
    assert stream_rows.count() == rows.count() and batch.agg(F.sum("n")).first()[0] > 0
    closed = spark.table("rates")
    assert closed.exceptAll(batch.select(closed.columns)).count() == 0
