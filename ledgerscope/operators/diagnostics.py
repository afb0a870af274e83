"""What stands behind a verdict: statistics of the day, the place among peers, and hour curves side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import density, robust
from ledgerscope.operators.detectors import Portfolio
from ledgerscope.operators.profiles import cohort_members, gathered

#: Bars of a cohort's histogram.
BARS = 20


def stat_blocks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, mean, median, mad, n``: the mean stands beside the median so that the skew between them can be seen."""
    means = rows.groupBy(key).agg(F.avg(value).alias("mean"))
    stats = robust.robust_stats(rows, [key], F.col(value)).select(key, F.col("center").alias("median"), "mad", "n")
    return means.where("mean is not null").join(stats, key)


def peer_places(members: DataFrame) -> DataFrame:
    """(mcc, merchant_id, vote, below, alike, n, percentile) of ``members(mcc, merchant_id, vote)``: how many of its cohort lie below a merchant.

    Votes are counted by value first; along a cohort only its different votes are summed. The
    percentile counts half of those alike, itself among them.
    """
    counted = members.groupBy("mcc", "vote").agg(F.count("*").alias("alike"))
    w = Window.partitionBy("mcc")
    upto = counted.select("mcc", "vote", "alike", F.sum("alike").over(w.orderBy("vote")).alias("upto"), F.sum("alike").over(w).alias("n"))
    placed = members.join(upto, ["mcc", "vote"])
    below = F.col("upto") - F.col("alike")
    return placed.select("mcc", "merchant_id", "vote", below.alias("below"), "alike", "n", ((below + F.col("alike") / 2) / F.col("n")).alias("percentile"))


def bar_of(vote: Column, low: Column, high: Column) -> Column:
    """The histogram's bar of a vote, from 0; the highest vote belongs to the last."""
    at = F.floor((vote - low) / ((high - low) / BARS))
    return F.when(high > low, F.least(at, F.lit(BARS - 1))).otherwise(F.lit(0)).cast("int")


def peer_histograms(members: DataFrame) -> DataFrame:
    """(mcc, bar, low, high, merchants): each cohort's votes in bars of equal width between its least and its greatest; empty bars are left out."""
    ends = members.groupBy("mcc").agg(F.min("vote").alias("least"), F.max("vote").alias("most"))
    each = members.join(ends, "mcc").withColumn("bar", bar_of(F.col("vote"), F.col("least"), F.col("most")))
    width = (F.col("most") - F.col("least")) / BARS
    bars = each.groupBy("mcc", "bar", "least", "most").agg(F.count("*").alias("merchants"))
    return bars.select("mcc", "bar", (F.col("least") + F.col("bar") * width).alias("low"), (F.col("least") + (F.col("bar") + 1) * width).alias("high"), "merchants")


def hour_curves(p: Portfolio) -> DataFrame:
    """(merchant_id, bin, own, own_threshold, cohort, cohort_threshold, sales): a merchant's density, its cohort's and the day's sales, for each quarter of an hour.

    For merchants with sales on the scored day; a curve that wasn't fitted is null.
    """
    day = p.sales().groupBy("merchant_id", "mcc", density.bin_of().alias("bin")).agg(F.count("*").alias("sales"))
    live = day.select("merchant_id", "mcc").distinct()
    own = p.fitted("own_hours").select("merchant_id", F.col("density").alias("own"), F.col("threshold").alias("own_threshold"))
    cohort = p.fitted("cohort_hours").select("mcc", F.col("density").alias("cohort"), F.col("threshold").alias("cohort_threshold"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(density.BINS - 1)))
    each = live.join(own, "merchant_id", "left").join(cohort, "mcc", "left").withColumn("bin", bins)
    at = lambda c: robust.rounded(F.get(c, F.col("bin")), 6).alias(c)
    return each.join(day.drop("mcc"), ["merchant_id", "bin"], "left").select(
        "merchant_id", "bin", at("own"), robust.rounded(F.col("own_threshold"), 6).alias("own_threshold"), at("cohort"), robust.rounded(F.col("cohort_threshold"), 6).alias("cohort_threshold"), F.coalesce("sales", F.lit(0)).alias("sales")
    )


def pages(p: Portfolio, verdicts: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per merchant with rows on the scored day: verdicts, statistics of merchant and cohorts, place among peers, window.

    ``verdicts`` are those of ``study.study`` (14 a merchant), ``profiles`` those of
    ``profiles.assemble``. All parts meet in one shuffle by merchant.
    """
    value = lambda df, *fields: df.select("merchant_id", F.struct(*fields).alias("value"))
    listed = verdicts.groupBy("merchant_id").agg(F.array_sort(F.collect_list(F.struct("step", "detector", "status"))).alias("value"))
    parts = {
        "day": value(stat_blocks(p.sales(), "merchant_id", "total_amount"), "mean", "median", "mad", "n"),
        "detectors": listed,
        "place": value(peer_places(cohort_members(p)), "vote", "below", "alike", "n", "percentile"),
        "baseline": value(profiles, "own.center", "own.dispersion", "own.method", "own.n", "own.usable"),
        "peers": value(profiles, "peer.center", "peer.dispersion", "peer.fence", "peer.n_merchants"),
        "district": value(profiles, "district_txn.center", "district_txn.dispersion"),
        "window": profiles.select("merchant_id", F.col("window").alias("value")),
    }
    rows = p.day().select("merchant_id").distinct()
    first = F.filter("detectors", lambda v: v["status"] == "FAIL")
    return rows.join(gathered("merchant_id", parts), "merchant_id").withColumn("root_cause", F.get(first, F.lit(0))["detector"])
