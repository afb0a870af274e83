"""The ledger as a stream: delivery without repeats, and rates that are counted as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.predicates import has_card, settled_sale


def deliveries(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows with each transaction once, as long as repeats come within ``late``."""
    return rows.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["source_txn_id"])


def hourly_rates(rows: DataFrame, slide: str = "5 minutes") -> DataFrame:
    """Settled sales per merchant and sliding hour; windows close as the watermark passes."""
    w = F.window("occurred_at", "60 minutes", slide)
    counts = rows.where(settled_sale()).groupBy("merchant_id", w).agg(F.count("*").alias("n"), F.sum("total_amount").alias("value"))
    return counts.select("merchant_id", F.col("window.start").alias("start"), "n", "value")


def card_spread(rows: DataFrame, minutes: int = 120, slide: str = "15 minutes") -> DataFrame:
    """Merchants, about, that each card touches within a sliding window; a first sieve for swarms."""
    w = F.window("occurred_at", f"{minutes} minutes", slide)
    counts = rows.where(has_card()).groupBy("hashed_pan", w).agg(F.approx_count_distinct("merchant_id").alias("merchants"), F.count("*").alias("n"))
    return counts.select("hashed_pan", F.col("window.start").alias("start"), "merchants", "n")
