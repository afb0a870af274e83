"""The ledger's store: deliveries are appended once, whatever they repeat."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMITS = "delivery string, attempt string, inserted long, skipped long, loaded_at timestamp_ntz"


class LedgerStore:
    """Transactions by day, and beside them their ids in buckets, in ``folder``.

    A delivery is compared with the ids alone, bucket by bucket: its own rows are shuffled to the
    buckets, those that are stored are not. It writes its rows, then its ids, then a commit record
    that readers go by; one that died is invisible and may be delivered again. The number of
    buckets is fixed when the store is made: as many as a full store's ids need to fit into memory.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, clock: Callable[[], datetime] = datetime.now) -> None:
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock
        self.table = f"ledger_ids_{hashlib.md5(self.folder.encode()).hexdigest()[:12]}"
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (source_txn_id STRING, attempt STRING) USING parquet "
            f"CLUSTERED BY (source_txn_id) SORTED BY (source_txn_id) INTO {buckets} BUCKETS LOCATION '{self.folder}/ids'"
        )

    def _commits(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits")

    def known(self) -> DataFrame:
        """(source_txn_id) of all committed deliveries, as it lies in its buckets."""
        done = self._commits().select("attempt")
        return self.spark.table(self.table).join(F.broadcast(done), "attempt", "left_semi").select("source_txn_id")

    def fresh(self, rows: DataFrame, order: str) -> DataFrame:
        """The first row, by ``order``, of each transaction of a delivery that isn't stored yet."""
        first = F.row_number().over(Window.partitionBy("source_txn_id").orderBy(order))
        dealt = rows.repartition(self.buckets, "source_txn_id").withColumn("__k", first).where("__k = 1").drop("__k")
        return dealt.join(self.known(), "source_txn_id", "left_anti")

    def append(self, rows: DataFrame, delivery: str, order: str = "arrival") -> tuple[int, int]:
        """Store a delivery's new rows; (inserted, skipped). A delivery that is committed already is passed over.

        ``order`` names the column that tells which of a transaction's rows came first; it isn't stored.
        """
        before = self._commits().where(F.col("delivery") == delivery).first()
        if before:
            return before["inserted"], before["skipped"]
        attempt = uuid.uuid4().hex
        path = f"{self.folder}/rows/attempt={attempt}"
        new = self.fresh(rows, order).drop(order).withColumn("txn_date", F.to_date("occurred_at"))
        new.repartition("txn_date").write.partitionBy("txn_date").parquet(path)
        stored = self.spark.read.schema(new.schema).parquet(path)
        ids = stored.select("source_txn_id", F.lit(attempt).alias("attempt"))
        ids.repartition(self.buckets, "source_txn_id").write.mode("append").bucketBy(self.buckets, "source_txn_id").sortBy("source_txn_id").format("parquet").option("path", f"{self.folder}/ids").saveAsTable(self.table)
        inserted = stored.count()
        record = {"delivery": delivery, "attempt": attempt, "inserted": inserted, "skipped": rows.count() - inserted, "loaded_at": self.clock()}
        self.spark.createDataFrame([record], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return record["inserted"], record["skipped"]

    def deliveries(self) -> DataFrame:
        """Committed deliveries with the rows they inserted and skipped."""
        return self._commits().drop("attempt")

    def ledger(self, with_delivery: bool = False) -> DataFrame:
        """All committed rows; filters of ``txn_date`` prune folders. ``delivery`` and ``loaded_at`` tell how a row came."""
        done = self._commits().select("attempt", "delivery", "loaded_at")
        rows = self.spark.read.parquet(f"{self.folder}/rows").join(F.broadcast(done), "attempt").drop("attempt")
        return rows if with_delivery else rows.drop("delivery", "loaded_at")
