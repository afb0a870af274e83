"""Baselines of merchants and of their cohorts over a lagged window of the ledger.

Every fit takes the ledger, the window, and the confirmed days to leave out where it leaves them
out. A merchant's rows are never gathered: amounts are counted by value, days and bins by key.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import density, robust
from ledgerscope.operators.predicates import HOME, UNSETTLED, Span, dated, has_card_origin, micros, scored_day, settled_sale, without_confirmed
from ledgerscope.sources import tables


@dataclass(frozen=True)
class FitSettings:
    """Settings of the fits; the defaults are the fixed values of production."""

    min_observations: int = 12
    min_span_days: int = 14
    lag_days: int = 7
    window_days: int = 30
    count_floor: float = 1.0
    ratio_floor: float = 0.02
    min_members: int = 3
    member_cap: int = 200
    min_member_times: int = 10
    min_origins: int = 20
    short_days: int = 7
    long_days: int = 90
    trend_rows: int = 6
    ramp: float = 1.75
    min_times: int = 20


def settled(ledger: DataFrame, span: Span, confirmed: DataFrame | None) -> DataFrame:
    """Settled sales of a window, dated, without confirmed days."""
    return without_confirmed(dated(ledger.where(span.holds(F.col("occurred_at")) & settled_sale())), confirmed)


def own_amount(ledger: DataFrame, merchants: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    """A row for every merchant: baseline of its amounts, usable from enough rows over enough days."""
    rows = settled(ledger, span, confirmed)
    seconds = F.max(micros()) - F.min(micros())
    days = rows.groupBy("merchant_id").agg((seconds / F.lit(86_400_000_000.0)).alias("span_days"))
    stats = robust.robust_stats(rows, ["merchant_id"], F.col("total_amount")).join(days, "merchant_id")
    every = merchants.select("merchant_id").join(stats, "merchant_id", "left")
    return robust.fit(every, s.min_observations, enough=F.col("span_days") >= s.min_span_days)


def rail_amount(ledger: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    """Baseline of amounts per merchant and payment rail; a blank rail is a rail, a null one none."""
    rows = settled(ledger, span, confirmed).where("card_type is not null")
    return robust.fit(robust.robust_stats(rows, ["merchant_id", "card_type"], F.col("total_amount")), s.min_observations)


def peer_amount(ledger: DataFrame, merchants: DataFrame, span: Span, confirmed: DataFrame | None) -> DataFrame:
    """Per MCC, the distribution of its merchants' median amounts, one vote each."""
    rows = settled(ledger, span, confirmed)
    members = robust.robust_stats(rows, ["merchant_id"], F.col("total_amount")).select("merchant_id", F.col("center").alias("vote"), F.col("n").alias("rows"))
    return _votes(members, merchants, 0.0)


def _votes(members: DataFrame, merchants: DataFrame, floor: float) -> DataFrame:
    """Statistics over the members' centers. These are written first: statistics read their rows several times."""
    grouped = tables.write(members, "members").join(merchants.select("merchant_id", "mcc").where("mcc is not null"), "merchant_id")
    sizes = grouped.groupBy("mcc").agg(F.sum("rows").alias("n_observations"))
    return robust.fit_peers(robust.robust_stats(grouped, ["mcc"], F.col("vote")), floor).join(sizes, "mcc")


def daily_counts(ledger: DataFrame, span: Span, confirmed: DataFrame | None) -> DataFrame:
    """(merchant_id, txn_date, v): settled sales per active day."""
    return settled(ledger, span, confirmed).groupBy("merchant_id", "txn_date").agg(F.count("*").alias("v"))


def own_daily_count(ledger: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    return robust.fit(robust.robust_stats(daily_counts(ledger, span, confirmed), ["merchant_id"], F.col("v")), s.min_observations, s.count_floor)


def peer_daily_count(ledger: DataFrame, merchants: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    stats = robust.robust_stats(daily_counts(ledger, span, confirmed), ["merchant_id"], F.col("v"))
    return _votes(stats.select("merchant_id", F.col("center").alias("vote"), F.col("n").alias("rows")), merchants, s.count_floor)


def in_last_hour(partition: list[str]) -> Column:
    """Rows of the partition in the 60 minutes that end with this one; the row an hour ago is not among them."""
    return within_hour(F.lit(1), partition)


def within_hour(counted: Column, partition: list[str]) -> Column:
    """How often ``counted`` is not null in those rows: all up to now less all up to an hour ago, two running counts, as a sliding one goes over a busy hour for each of its rows."""
    w = Window.partitionBy(*partition).orderBy(micros())
    return F.count(counted).over(w.rangeBetween(Window.unboundedPreceding, 0)) - F.count(counted).over(w.rangeBetween(Window.unboundedPreceding, -3_600_000_000))


def daily_peaks(rows: DataFrame) -> DataFrame:
    """(merchant_id, txn_date, v): most rows within any 60 minutes of a day."""
    return rows.withColumn("__n", in_last_hour(["merchant_id", "txn_date"])).groupBy("merchant_id", "txn_date").agg(F.max("__n").alias("v"))


def own_velocity(ledger: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    peaks = daily_peaks(settled(ledger, span, confirmed))
    return robust.fit(robust.robust_stats(peaks, ["merchant_id"], F.col("v")), s.min_observations, s.count_floor)


def sampled_by_rank(rows: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows of each merchant, evenly spread over its time order.

    Of n rows over the cap those at floor(i * n / cap) stay. A row's rank is its rank within the
    day plus the rows of the days before, so no merchant's rows meet in one task.
    """
    per_day = rows.groupBy("merchant_id", "txn_date").agg(F.count("*").alias("__c"))
    w = Window.partitionBy("merchant_id")
    earlier = F.coalesce(F.sum("__c").over(w.orderBy("txn_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = per_day.select("merchant_id", "txn_date", earlier.alias("__before"), F.sum("__c").over(w).alias("__n"))
    in_day = F.row_number().over(Window.partitionBy("merchant_id", "txn_date").orderBy("occurred_at", "source_txn_id"))
    ranked = rows.withColumn("__k", in_day).join(days, ["merchant_id", "txn_date"]).withColumn("__r", F.col("__before") + F.col("__k") - 1)
    i = F.ceil(F.col("__r") * cap / F.col("__n"))
    return ranked.where((F.col("__n") <= cap) | ((i < cap) & (F.floor(i * F.col("__n") / cap) == F.col("__r")))).drop("__k", "__before", "__n", "__r")


def cohort_tickets(ledger: DataFrame, merchants: DataFrame, dimension: str, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    """Per cohort (``mcc`` or ``merchant_subdistrict``), the distribution of its members' sampled amounts."""
    if dimension not in ("mcc", "merchant_subdistrict"):
        raise ValueError(f"no cohort dimension: {dimension}")
    member = merchants.select("merchant_id", dimension).where(F.col(dimension).isNotNull())
    # some hundred rows a member, written as the statistics read them several times
    rows = tables.write(sampled_by_rank(settled(ledger, span, confirmed), s.member_cap).join(member, "merchant_id").select(dimension, "merchant_id", "total_amount"), "sampled")
    members = rows.groupBy(dimension).agg(F.countDistinct("merchant_id").alias("members"))
    stats = robust.robust_stats(rows, [dimension], F.col("total_amount")).join(members, dimension)
    return robust.fit(stats, 1, enough=F.col("members") >= s.min_members)


def foreign_share(rows: DataFrame) -> DataFrame:
    """(merchant_id, share): cards issued abroad among those with a known origin."""
    return rows.where(has_card_origin()).groupBy("merchant_id").agg(F.avg((F.col("card_issuing_country") != HOME).cast("int")).alias("share"))


def subdistrict_foreign(ledger: DataFrame, merchants: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    """Per subdistrict, the distribution of its merchants' shares of foreign cards."""
    member = merchants.select("merchant_id", "merchant_subdistrict").where("merchant_subdistrict is not null")
    shares = foreign_share(settled(ledger, span, confirmed)).join(member, "merchant_id")
    return robust.fit(robust.robust_stats(shares, ["merchant_subdistrict"], F.col("share")), s.min_members, s.ratio_floor)


def unsettled_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share): attempts, refunds among them, that did not settle."""
    return rows.groupBy(*keys).agg(F.avg(F.coalesce(F.col("transaction_status").isin(*UNSETTLED), F.lit(False)).cast("int")).alias("share"))


def attempts(ledger: DataFrame, span: Span, confirmed: DataFrame | None) -> DataFrame:
    return without_confirmed(dated(ledger.where(span.holds(F.col("occurred_at")))), confirmed)


def own_unsettled(ledger: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    days = unsettled_share(attempts(ledger, span, confirmed), ["merchant_id", "txn_date"])
    return robust.fit(robust.robust_stats(days, ["merchant_id"], F.col("share")), s.min_observations, s.ratio_floor)


def peer_unsettled(ledger: DataFrame, merchants: DataFrame, span: Span, confirmed: DataFrame | None, s: FitSettings = FitSettings()) -> DataFrame:
    member = merchants.select("merchant_id", "mcc").where("mcc is not null")
    shares = unsettled_share(attempts(ledger, span, confirmed), ["merchant_id"]).join(member, "merchant_id")
    return robust.fit(robust.robust_stats(shares, ["mcc"], F.col("share")), s.min_members, s.ratio_floor)


def trend(ledger: DataFrame, as_of: datetime, s: FitSettings = FitSettings()) -> DataFrame:
    """Per merchant, medians of the last week and of the last quarter before the lag, and their ratio.

    Both need enough rows, else medians and ratio are zero and there is no ramp.
    """
    end = as_of - timedelta(days=s.lag_days)
    rows = ledger.where(settled_sale())

    def of(days: int, name: str) -> DataFrame:
        part = rows.where(Span(end - timedelta(days=days), end).holds(F.col("occurred_at")))
        stats = robust.robust_stats(part, ["merchant_id"], F.col("total_amount"))
        return stats.select("merchant_id", F.col("n").alias(f"{name}_n"), F.col("center").alias(f"{name}_center"))

    both = of(s.long_days, "long").join(of(s.short_days, "short"), "merchant_id", "left")
    enough = (F.col("long_n") >= s.trend_rows) & (F.coalesce("short_n", F.lit(0)) >= s.trend_rows)
    ratio = F.when(enough & (F.col("long_center") > 0), F.col("short_center") / F.col("long_center")).otherwise(F.lit(0.0))
    return both.select(
        "merchant_id",
        F.when(enough, F.col("short_center")).otherwise(F.lit(0.0)).alias("trend_short"),
        F.when(enough, F.col("long_center")).otherwise(F.lit(0.0)).alias("trend_long"),
        ratio.alias("trend_ratio"),
        (ratio >= s.ramp).alias("is_ramp"),
    )


def own_hours(ledger: DataFrame, span: Span, s: FitSettings = FitSettings()) -> DataFrame:
    """Per merchant, the density of its times of day; confirmed days take part."""
    binned = _binned(ledger, span, ["merchant_id"])
    out = density.estimate(binned.withColumn("w", F.col("c")), ["merchant_id"], density.OWN_PERCENTILE)
    return out.withColumn("usable", F.col("n") >= s.min_times)


def _binned(ledger: DataFrame, span: Span, keys: list[str]) -> DataFrame:
    rows = ledger.where(span.holds(F.col("occurred_at")) & settled_sale())
    counts = rows.groupBy(*keys, density.bin_of().alias("bin")).agg(F.count("*").alias("c"))
    return counts.withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))


def cohort_hours(ledger: DataFrame, merchants: DataFrame, span: Span, dimension: str = "mcc", s: FitSettings = FitSettings()) -> DataFrame:
    """Per cohort, the density of its members' times, each member with enough rows weighing the same.

    With too few such members all densities, the threshold and n are zero.
    """
    member = merchants.select("merchant_id", dimension).where(F.col(dimension).isNotNull())
    each = _binned(ledger, span, ["merchant_id"]).join(member, "merchant_id")
    voting = each.where(F.col("n") >= s.min_member_times)
    sizes = each.select(dimension, "merchant_id", "n").distinct().groupBy(dimension).agg(
        F.count(F.when(F.col("n") >= s.min_member_times, 1)).alias("voters"), F.coalesce(F.sum(F.when(F.col("n") >= s.min_member_times, F.col("n"))), F.lit(0)).alias("observations")
    )
    pooled = voting.groupBy(dimension, "bin").agg(F.sum(F.col("c") / F.col("n")).alias("w")).join(sizes.where(F.col("voters") >= s.min_members), dimension).withColumn("n", F.col("observations"))
    made = density.estimate(pooled, [dimension], density.COHORT_PERCENTILE)
    zero = F.lit(0.0)
    return sizes.select(dimension).join(made, dimension, "left").select(
        dimension,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("bandwidth", zero).alias("bandwidth"),
        F.coalesce("density", F.array_repeat(zero, density.BINS)).alias("density"),
        F.coalesce("threshold", zero).alias("threshold"),
        F.coalesce("peak_hour", zero).alias("peak_hour"),
        (F.coalesce("n", F.lit(0)) >= s.min_times).alias("usable"),
    )


def origin_mix(ledger: DataFrame, span: Span) -> DataFrame:
    """(merchant_id, country, c, n, kinds): overseas issuing countries, their total and how many differ."""
    rows = ledger.where(span.holds(F.col("occurred_at")) & settled_sale() & has_card_origin() & (F.col("card_issuing_country") != HOME))
    w = Window.partitionBy("merchant_id")
    counts = rows.groupBy("merchant_id", F.col("card_issuing_country").alias("country")).agg(F.count("*").alias("c"))
    return counts.select("*", F.sum("c").over(w).alias("n"), F.count("*").over(w).alias("kinds"))


def daily_value(ledger: DataFrame, as_of: datetime, s: FitSettings = FitSettings()) -> DataFrame:
    """(merchant_id, txn_date, gross): settled value per day of the last quarter, the scored day included."""
    end = scored_day(as_of).end
    rows = ledger.where(Span(as_of - timedelta(days=s.long_days), end).holds(F.col("occurred_at")) & settled_sale())
    return dated(rows).groupBy("merchant_id", "txn_date").agg(F.sum("total_amount").alias("gross"))


def last_activity(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """(merchant_id, last_active): date of the last row, of any status, before the scored day."""
    start = F.lit(scored_day(as_of).start.isoformat(sep=" ")).cast("timestamp_ntz")
    return ledger.where(F.col("occurred_at") < start).groupBy("merchant_id").agg(F.to_date(F.max("occurred_at")).alias("last_active"))


def cohort_snapshots(peers: DataFrame, as_of: datetime) -> DataFrame:
    """Peer baselines as written per run: center, spread, quartiles, fence."""
    return peers.select(
        F.lit(as_of.date().isoformat()).cast("date").alias("as_of"), "mcc", "center", "dispersion", "q1", "q3",
        robust.upper_fence(F.col("center"), F.col("dispersion")).alias("upper_fence"), F.col("n").alias("n_merchants"), "usable",
    )
