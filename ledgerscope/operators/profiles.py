"""The profile of a merchant: every baseline in force on a night, as one row of typed fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import robust
from ledgerscope.operators.detectors import Portfolio
from ledgerscope.operators.predicates import by_mcc


def gathered(key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per key with a field for each of ``parts(key, value)``; null where a part has no row.

    The parts are stacked and meet in one shuffle, however many they are; each has one row a key.
    """
    kinds = {n: df.schema["value"].dataType for n, df in parts.items()}
    stacked = [df.select(key, *[(F.col("value") if n == m else F.lit(None).cast(kinds[m])).alias(m) for m in parts]) for n, df in parts.items()]
    return reduce(DataFrame.unionAll, stacked).where(F.col(key).isNotNull()).groupBy(key).agg(*[F.first(n, ignorenulls=True).alias(n) for n in parts])


def _value(df: DataFrame, key: str, *fields: str | Column) -> DataFrame:
    return df.select(key, F.struct(*fields).alias("value"))


def _merchant_parts(p: Portfolio) -> dict[str, DataFrame]:
    m, fit = "merchant_id", ("center", "dispersion", "usable")
    hours = _value(p.fitted("own_hours"), m, F.transform("density", lambda d: robust.rounded(d, 6)).alias("density"), robust.rounded(F.col("threshold"), 6).alias("threshold"), "bandwidth", "n", "usable")
    mix = p.fitted("origin_mix").groupBy(m).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("country", "c")))).alias("counts"), F.max("n").alias("n"))
    rails = p.fitted("rail_amount").where("usable").groupBy(m).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("card_type", F.struct("center", "dispersion", "n", "usable"))))).alias("value"))
    trend = _value(p.fitted("trend"), m, robust.rounded(F.col("trend_ratio"), 3).alias("ratio"), F.col("is_ramp"))
    out = {
        "own": _value(p.fitted("own_amount"), m, "center", "dispersion", "method", "n", "usable"),
        "volume": _value(p.fitted("own_daily_count"), m, *fit),
        "velocity": _value(p.fitted("own_velocity"), m, *fit),
        "unsettled": _value(p.fitted("own_unsettled"), m, "center", "dispersion", "n", "usable"),
        "hours": hours,
        "origins": _value(mix, m, "counts", "n", (F.col("n") >= p.fit.min_origins).alias("usable")),
        "rails": rails,
        "trend": trend,
    }
    if p.confirmed is not None:
        out["quarantined_days"] = p.confirmed.groupBy(m).agg(F.count("*").alias("value"))
    return out


def _cohort_parts(p: Portfolio) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """By MCC and by subdistrict."""
    fit = ("center", "dispersion", "usable")
    fence = F.when(F.col("usable"), robust.upper_fence(F.col("center"), F.col("dispersion"))).alias("fence")
    hours = _value(p.fitted("cohort_hours"), "mcc", F.transform("density", lambda d: robust.rounded(d, 6)).alias("density"), robust.rounded(F.col("threshold"), 6).alias("threshold"), "n", "usable")
    mcc = {
        "peer": _value(p.fitted("peer_amount"), "mcc", "center", "dispersion", fence, F.col("n").alias("n_merchants"), "usable"),
        "peer_txn": _value(p.fitted("mcc_tickets"), "mcc", *fit),
        "peer_volume": _value(p.fitted("peer_daily_count"), "mcc", *fit),
        "peer_unsettled": _value(p.fitted("peer_unsettled"), "mcc", *fit),
        "cohort_hours": hours,
    }
    district = {"district_txn": _value(p.fitted("subdistrict_tickets"), "merchant_subdistrict", *fit), "foreign_cards": _value(p.fitted("subdistrict_foreign"), "merchant_subdistrict", *fit)}
    return mcc, district


def settings(p: Portfolio, days: Column) -> Column:
    """The window that a profile was fitted under, ``days`` of it left out as confirmed."""
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.struct(
        at(p.span.start).alias("start"), at(p.span.end).alias("end"), F.lit(p.fit.window_days).alias("days"), F.lit(p.fit.lag_days).alias("lag_days"),
        F.lit(p.fit.min_observations).alias("min_observations"), F.lit(p.fit.min_span_days).alias("min_span_days"), days.cast("long").alias("quarantined_days"),
    )


def headlines(p: Portfolio) -> DataFrame:
    """``(merchant_id, own, window)`` of each merchant's profile: all that ``overview`` reads."""
    own = _value(p.fitted("own_amount"), "merchant_id", "usable").withColumnRenamed("value", "own")
    rows = p.merchants.select("merchant_id").join(own, "merchant_id", "left")
    if p.confirmed is None:
        return rows.select("merchant_id", "own", settings(p, F.lit(0)).alias("window"))
    days = p.confirmed.groupBy("merchant_id").agg(F.count("*").alias("quarantined_days"))
    return rows.join(days, "merchant_id", "left").select("merchant_id", "own", settings(p, F.coalesce("quarantined_days", F.lit(0))).alias("window"))


def assemble(p: Portfolio) -> DataFrame:
    """One row per merchant: its baselines, those of its cohorts, and the settings and window they were fitted under.

    A merchant without rows of the window has the baseline of too little data; a baseline that
    doesn't exist is null.
    """
    mcc, district = _cohort_parts(p)
    rows = p.merchants.select("merchant_id", "mcc", F.col("merchant_subdistrict").alias("subdistrict"))
    rows = rows.join(gathered("merchant_id", _merchant_parts(p)), "merchant_id", "left").join(gathered("mcc", mcc), "mcc", "left")
    rows = rows.join(gathered("merchant_subdistrict", district).withColumnRenamed("merchant_subdistrict", "subdistrict"), "subdistrict", "left")
    window = settings(p, F.coalesce("quarantined_days", F.lit(0)) if p.confirmed is not None else F.lit(0))
    z, floor = (by_mcc(s, getattr(p.tuning, s), p.tuning.mcc_overrides).alias(s) for s in ("outlier_z", "materiality_floor"))
    lane = F.when(F.coalesce("own.usable", F.lit(False)), "A").otherwise("B").alias("lane")
    fits = ("own", "volume", "velocity", "unsettled", "hours", "origins", "rails", "trend", *mcc, *district)
    return rows.select("merchant_id", "mcc", "subdistrict", lane, window.alias("window"), *fits, z, floor)


def latest(profiles: DataFrame) -> DataFrame:
    """Of each merchant the profile of the latest day; of a day's runs that of the latest run."""
    w = Window.partitionBy("merchant_id").orderBy(F.desc("as_of"), F.desc("run_id"))
    return profiles.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def cohort_members(p: Portfolio) -> DataFrame:
    """(mcc, merchant_id, vote): what each member adds to its cohort's baseline; a snapshot's members, as rows.

    A cohort may hold very many merchants, so its members are rows of a table and no array of its row.
    """
    own = p.fitted("own_amount").where("n > 0").select("merchant_id", F.col("center").alias("vote"))
    return p.merchants.where("mcc is not null").select("merchant_id", "mcc").join(own, "merchant_id").select("mcc", "merchant_id", "vote")


def overview(profiles: DataFrame) -> DataFrame:
    """One row: merchants, usable baselines, confirmed days, the window, and the day that the next night takes in.

    The window is half-open, so its end is the first day that isn't part of it yet.
    """
    return profiles.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("own.usable"), 1)).alias("usable"), F.coalesce(F.sum("window.quarantined_days"), F.lit(0)).alias("quarantined_days"),
        F.to_date(F.min("window.start")).alias("window_start"), F.to_date(F.max("window.end")).alias("next_inclusion_date"),
    )
