"""Closing days from a stream: each batch is stored once, a day is scored when it is over, and late rows score it again."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.sources.ledger_store import LedgerStore
from ledgerscope.sources.store import RunStore

#: score(as_of, label): opens, scores and publishes a run of the day before ``as_of``, under that label.
Score = Callable[[datetime, str], int]


class Closer:
    """A ``foreachBatch`` function: ``rows.writeStream.foreachBatch(closer)`` with a checkpoint.

    A batch's rows are a delivery of the ledger store, named by the batch: repeated after a crash, it
    is passed over if it was committed, and made again if it wasn't. A day is over when rows of
    ``late`` after its midnight have come. Days that are over and have rows that no run has seen are
    scored, in order; the run's label names the batch, so that a repeated batch scores none twice. Rows
    that come for a day that is scored already reopen it: its new run supersedes the old one.
    """

    def __init__(self, ledger: LedgerStore, runs: RunStore, score: Score, late: timedelta = timedelta(hours=9)) -> None:
        self.ledger, self.runs, self.score, self.late = ledger, runs, score, late

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id}"
        self.ledger.append(batch, name)
        for day in self.due(name):
            label = f"{name}/{day}"
            done = self.runs.runs().where(F.col("label") == label)
            if done.isEmpty():
                self.score(datetime(day.year, day.month, day.day) + timedelta(days=1), label)

    def due(self, name: str) -> list[date]:
        """Days that are over and hold rows loaded after the latest run of another batch had scored them."""
        rows = self.ledger.ledger(with_delivery=True).groupBy("txn_date", "delivery", "loaded_at").agg(F.max("occurred_at").alias("newest"))
        newest = rows.agg(F.max("newest")).first()[0]
        if newest is None:
            return []
        over = (newest - self.late).date()
        scored = self.runs.runs().where(~F.coalesce(F.col("label").startswith(f"{name}/"), F.lit(False)))
        seen = scored.groupBy(F.date_sub("as_of", 1).alias("txn_date")).agg(F.max("started_at").alias("seen"))
        live = rows.where(F.col("txn_date") < F.lit(over.isoformat()).cast("date")).join(seen, "txn_date", "left").where("seen is null or loaded_at > seen")
        # days, of which a batch touches few
        return [r["txn_date"] for r in live.select("txn_date").distinct().orderBy("txn_date").collect()]
