"""Deliveries into the ledger's store: once each, without shuffling what is stored."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerscope.sources.ledger_store import LedgerStore

SCHEMA = "source_txn_id string, merchant_id string, occurred_at timestamp_ntz, total_amount double, arrival long"


def delivery(spark, ids, value=1.0):
    at = datetime(2026, 3, 1)
    return spark.createDataFrame([(f"T{i:05d}", "M", at + timedelta(hours=i), value + k, k) for k, i in enumerate(ids)], SCHEMA)


def test_deliveries_count_once(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), 4)
    assert store.append(delivery(spark, [1, 2, 3, 2, 1]), "a") == (3, 2)
    assert store.append(delivery(spark, [3, 4, 4, 5], 100.0), "b") == (2, 2)
    assert store.append(delivery(spark, [3, 4, 4, 5, 6]), "b") == (2, 2)  # delivered already
    assert store.append(delivery(spark, []), "none") == (0, 0)
    assert {r["source_txn_id"]: r["total_amount"] for r in store.ledger().collect()} == {"T00001": 1.0, "T00002": 2.0, "T00003": 3.0, "T00004": 101.0, "T00005": 103.0}
    assert sorted((r["delivery"], r["inserted"], r["skipped"]) for r in store.deliveries().collect()) == [("a", 3, 2), ("b", 2, 2), ("none", 0, 0)]


def test_a_delivery_that_died_is_invisible_and_comes_again(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), 4)
    store.append(delivery(spark, [1]), "a")
    # rows and ids are written, the commit is not
    half = store.fresh(delivery(spark, [2, 3]), "arrival").drop("arrival").withColumn("txn_date", F.to_date("occurred_at"))
    half.write.partitionBy("txn_date").parquet(f"{store.folder}/rows/attempt=half")
    half.select("source_txn_id", F.lit("half").alias("attempt")).write.mode("append").bucketBy(4, "source_txn_id").sortBy("source_txn_id").format("parquet").option("path", f"{store.folder}/ids").saveAsTable(store.table)
    assert store.ledger().count() == 1
    assert LedgerStore(spark, str(tmp_path / "ledger"), 4).append(delivery(spark, [2, 3]), "b") == (2, 0)
    assert store.ledger().count() == 3


def test_stored_ids_are_not_shuffled(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), 4)
    store.append(delivery(spark, range(50)), "a")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = store.fresh(delivery(spark, range(40, 60)), "arrival")
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert new.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stored = plan[plan.index(store.table) - 2500 : plan.index(store.table)]
    branch = plan[plan.rindex("Join", 0, plan.index(store.table)) :]
    assert "Exchange hashpartitioning" not in branch.split("BroadcastExchange")[0], stored
