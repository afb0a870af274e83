"""Detectors of family A: a scored day against the merchant's own and its cohorts' baselines.

Every detector gives hits in HIT_COLUMNS; ``evidence`` is the number of rows that support a hit.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, datetime, time
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import density, robust
from ledgerscope.operators import baselines as bl, daytables
from ledgerscope.operators.predicates import HOME, UNSETTLED, baseline_span, by_mcc, dated, fires, has_card_origin, micros, not_refund, scored_day, settled_sale
from ledgerscope.sources import tables

HIT_COLUMNS = ("merchant_id", "family", "detector", "sub_score", "feature_name", "merchant_value", "baseline_value", "deviation", "evidence")
ORIGIN_PRIOR, SURPRISAL_FLAG = 0.5, 3.0


@dataclass(frozen=True)
class Tuning:
    """Cut-offs that analysts may set, per MCC too; the other cut-offs are fixed."""

    outlier_z: float = 3.5
    materiality_floor: float = 1000.0
    mcc_overrides: dict = field(default_factory=dict)
    moderate_z: float = 2.5

    def fires(self, deviation: Column, amount: Column) -> Column:
        return fires(deviation, amount, by_mcc("outlier_z", self.outlier_z, self.mcc_overrides), by_mcc("materiality_floor", self.materiality_floor, self.mcc_overrides))


@dataclass(frozen=True)
class Portfolio:
    """What a run reads: ledger, merchants, confirmed days, and its date and settings."""

    ledger: DataFrame
    merchants: DataFrame
    confirmed: DataFrame | None
    as_of: datetime
    tuning: Tuning = Tuning()
    fit: bl.FitSettings = bl.FitSettings()
    written: Mapping[str, DataFrame] = field(default_factory=dict)
    days: Mapping[str, DataFrame] | None = None  #: day tables up to the scored day, from ``daytables.DayStore``

    @property
    def span(self):
        return baseline_span(self.as_of, self.fit.window_days, self.fit.lag_days)

    def fitted(self, name: str) -> DataFrame:
        """A table of FITS: read back if the run has written it, else planned from the ledger."""
        return self.written[name] if name in self.written else FITS[name](self)

    def day(self) -> DataFrame:
        """All rows of the scored day, dated, with their merchants' cohorts."""
        if "day" in self.written:
            return self.written["day"]
        rows = dated(self.ledger.where(scored_day(self.as_of).holds(F.col("occurred_at"))))
        return rows.join(self.merchants.select("merchant_id", "mcc", "merchant_subdistrict"), "merchant_id")

    def sales(self) -> DataFrame:
        """Rows of the scored day that are no refunds; declines are among them."""
        return self.day().where(not_refund())


#: Tables that a run reads more than once: baselines of merchants and cohorts.
FITS: dict[str, Callable[[Portfolio], DataFrame]] = {
    "own_amount": lambda p: bl.own_amount(p.ledger, p.merchants, p.span, p.confirmed, p.fit),
    "rail_amount": lambda p: bl.rail_amount(p.ledger, p.span, p.confirmed, p.fit),
    "peer_amount": lambda p: bl.peer_amount(p.ledger, p.merchants, p.span, p.confirmed),
    "own_daily_count": lambda p: bl.own_daily_count(p.ledger, p.span, p.confirmed, p.fit),
    "peer_daily_count": lambda p: bl.peer_daily_count(p.ledger, p.merchants, p.span, p.confirmed, p.fit),
    "own_velocity": lambda p: bl.own_velocity(p.ledger, p.span, p.confirmed, p.fit),
    "own_hours": lambda p: bl.own_hours(p.ledger, p.span, p.fit),
    "cohort_hours": lambda p: bl.cohort_hours(p.ledger, p.merchants, p.span, "mcc", p.fit),
    "subdistrict_tickets": lambda p: bl.cohort_tickets(p.ledger, p.merchants, "merchant_subdistrict", p.span, p.confirmed, p.fit),
    "mcc_tickets": lambda p: bl.cohort_tickets(p.ledger, p.merchants, "mcc", p.span, p.confirmed, p.fit),
    "own_unsettled": lambda p: bl.own_unsettled(p.ledger, p.span, p.confirmed, p.fit),
    "peer_unsettled": lambda p: bl.peer_unsettled(p.ledger, p.merchants, p.span, p.confirmed, p.fit),
    "subdistrict_foreign": lambda p: bl.subdistrict_foreign(p.ledger, p.merchants, p.span, p.confirmed, p.fit),
    "origin_mix": lambda p: bl.origin_mix(p.ledger, p.span),
    "trend": lambda p: bl.trend(p.ledger, p.as_of, p.fit),
    "daily_value": lambda p: bl.daily_value(p.ledger, p.as_of, p.fit),
    "last_activity": lambda p: bl.last_activity(p.ledger, p.as_of),
}


def hit(
    df: DataFrame, detector: Column | str, feature: Column | str, value: Column, base: Column, deviation: Column, score: Column | None = None,
    evidence: Column | None = None, family: str = "A", places: tuple[int | None, int | None, int | None] = (None, None, 2),
) -> DataFrame:
    """Rows of ``df`` as hits; without a score, a tenth of the deviation, at most 1.

    ``places`` are those that value, baseline and deviation are rounded to.
    """
    value, base, given = (c.cast("double") if n is None else robust.rounded(c.cast("double"), n) for c, n in zip((value, base, deviation), places))
    return df.select(
        "merchant_id",
        F.lit(family).alias("family"),
        (F.lit(detector) if isinstance(detector, str) else detector).alias("detector"),
        (F.least(deviation / 10, F.lit(1.0)) if score is None else score).cast("double").alias("sub_score"),
        (F.lit(feature) if isinstance(feature, str) else feature).alias("feature_name"),
        value.alias("merchant_value"),
        base.alias("baseline_value"),
        given.alias("deviation"),
        (F.lit(0) if evidence is None else evidence).cast("long").alias("evidence"),
    )


def _above(measured: DataFrame, base: DataFrame, key: str, detector: str, feature: str, above_center: bool = False, places: int | None = None) -> DataFrame:
    """Hits of ``measured(merchant_id, key, v, evidence)`` that are outliers of the usable baselines of their key."""
    both = measured.join(base.where("usable").select(key, "center", "dispersion"), key)
    z = robust.modified_z(F.col("v"), F.col("center"), F.col("dispersion"))
    found = both.withColumn("z", z).where((F.col("z") > robust.OUTLIER_Z) & (F.col("v") > F.col("center") if above_center else F.lit(True)))
    return hit(found, detector, feature, F.col("v"), F.col("center"), F.col("z"), evidence=F.col("evidence"), places=(places, places, 2))


def _counts(p: Portfolio) -> DataFrame:
    n = F.count("*")
    return p.sales().groupBy("merchant_id", "mcc").agg(n.alias("v"), n.alias("evidence"))


def count_vs_own_baseline(p: Portfolio) -> DataFrame:
    return _above(_counts(p), p.fitted("own_daily_count"), "merchant_id", "count_vs_own_baseline", "daily_transaction_count")


def count_vs_mcc_peers(p: Portfolio) -> DataFrame:
    return _above(_counts(p), p.fitted("peer_daily_count"), "mcc", "count_vs_mcc_peers", "daily_count_vs_mcc_peers")


def burst_rate_vs_own_baseline(p: Portfolio) -> DataFrame:
    """The most sales within 60 minutes; they are the evidence."""
    peak = p.sales().withColumn("n", bl.in_last_hour(["merchant_id"])).groupBy("merchant_id").agg(F.max("n").alias("v"))
    return _above(peak.withColumn("evidence", F.col("v")), p.fitted("own_velocity"), "merchant_id", "burst_rate_vs_own_baseline", "peak_transactions_per_hour")


def peak_rows(rows: DataFrame) -> DataFrame:
    """Per merchant, the rows of the first 60-minute window with the most rows."""
    timed = rows.withColumn("t", micros()).withColumn("n", bl.in_last_hour(["merchant_id"]))
    most = timed.groupBy("merchant_id").agg(F.max(F.struct("n", -F.col("t"))).alias("m")).select("merchant_id", (-F.col("m.col2")).alias("last"))
    return timed.join(most, "merchant_id").where((F.col("t") <= F.col("last")) & (F.col("t") > F.col("last") - 3_600_000_000)).drop("t", "n", "last")


def _odd_hours(p: Portfolio, hours: DataFrame, key: str, detector: str, feature: str) -> DataFrame:
    timed = p.sales().join(hours.where("usable").select(key, "usable", "threshold", "peak_hour", "density"), key)
    at = timed.withColumn("at", robust.rounded(density.density_at(F.col("density"), density.bin_of()), 6)).withColumn("threshold", robust.rounded(F.col("threshold"), 6))
    odd = density.is_unusual(F.col("usable"), F.col("at"), F.col("threshold"))
    day = at.groupBy("merchant_id").agg(
        F.count("*").alias("day"),
        F.count(F.when(odd, 1)).alias("odd"),
        F.min(F.when(odd, F.struct("at", density.local_hour().alias("hour"), "threshold"))).alias("worst"),
        F.first("peak_hour").alias("peak_hour"),
    )
    deep = density.depth(F.lit(True), F.col("worst.at"), F.col("worst.threshold"))
    score = density.temporal_severity(F.col("odd"), F.col("day"), deep)
    return hit(day.where("odd > 0"), detector, feature, F.col("worst.hour"), F.col("peak_hour"), F.col("worst.at"), score, F.col("odd"), places=(2, 2, 4))


def hour_vs_own_pattern(p: Portfolio) -> DataFrame:
    return _odd_hours(p, p.fitted("own_hours"), "merchant_id", "hour_vs_own_pattern", "transaction_hour")


def hour_vs_mcc_peers(p: Portfolio) -> DataFrame:
    return _odd_hours(p, p.fitted("cohort_hours"), "mcc", "hour_vs_mcc_peers", "hour_vs_trade_hours")


def surprisal(count: Column, n: Column, kinds: Column) -> Column:
    """Bits of surprise at a country, smoothed so that an unseen one is finite."""
    return -F.log2((count + ORIGIN_PRIOR) / (n + ORIGIN_PRIOR * (kinds + 1)))


def card_origin_vs_own_mix(p: Portfolio) -> DataFrame:
    """Overseas countries of the day that surprise; of equal surprises the first country by name."""
    mix = p.fitted("origin_mix")
    usable = mix.where(F.col("n") >= p.fit.min_origins)
    today = p.sales().where(has_card_origin() & (F.col("card_issuing_country") != HOME)).groupBy("merchant_id", F.col("card_issuing_country").alias("country")).agg(F.count("*").alias("today"))
    totals = today.groupBy("merchant_id").agg(F.sum("today").alias("all_today"))
    each = today.join(usable.select("merchant_id", "n", "kinds").distinct(), "merchant_id").join(usable.select("merchant_id", "country", "c"), ["merchant_id", "country"], "left")
    bits = each.withColumn("c", F.coalesce("c", F.lit(0))).withColumn("bits", surprisal(F.col("c"), F.col("n"), F.col("kinds"))).where(F.col("bits") > SURPRISAL_FLAG)
    worst = bits.groupBy("merchant_id").agg(F.min(F.struct((-F.col("bits")).alias("b"), "country", "today", "c", "n")).alias("w"), F.sum("today").alias("evidence")).join(totals, "merchant_id")
    return hit(worst, "card_origin_vs_own_mix", F.concat(F.lit("card_origin_"), F.col("w.country")), F.col("w.today") / F.col("all_today"), F.col("w.c") / F.col("w.n"), -F.col("w.b"), evidence=F.col("evidence"), places=(3, 3, 2))


def _tickets(p: Portfolio, base: DataFrame, keys: list[str], detector: str, feature: str, rows: DataFrame | None = None) -> DataFrame:
    """Hits of single amounts: rows that fire, the largest deviation reported."""
    sales = p.sales() if rows is None else rows
    both = sales.join(base.where("usable").select(*keys, "center", "dispersion"), keys)
    scored = both.withColumn("z", robust.modified_z(F.col("total_amount"), F.col("center"), F.col("dispersion"))).where(p.tuning.fires(F.col("z"), F.col("total_amount")))
    group = ["merchant_id", *[k for k in keys if k == "card_type"]]
    worst = scored.groupBy(*group).agg(F.max(F.struct("z", "total_amount")).alias("w"), F.first("center").alias("center"), F.count("*").alias("evidence"))
    named = F.concat(F.lit(f"{feature}_"), F.lower("card_type")) if "card_type" in keys else feature
    return hit(worst, detector, named, F.col("w.total_amount"), F.col("center"), F.col("w.z"), evidence=F.col("evidence"))


def ticket_vs_subdistrict_peers(p: Portfolio) -> DataFrame:
    return _tickets(p, p.fitted("subdistrict_tickets"), ["merchant_subdistrict"], "ticket_vs_subdistrict_peers", "ticket_vs_subdistrict_peers")


def ticket_vs_mcc_peers(p: Portfolio) -> DataFrame:
    return _tickets(p, p.fitted("mcc_tickets"), ["mcc"], "ticket_vs_mcc_peers", "ticket_vs_mcc_peers")


def amount_vs_payment_method_baseline(p: Portfolio) -> DataFrame:
    """One hit for each rail."""
    return _tickets(p, p.fitted("rail_amount"), ["merchant_id", "card_type"], "amount_vs_payment_method_baseline", "amount_on")


def amount_vs_own_baseline(p: Portfolio) -> DataFrame:
    """Lane A alone: merchants whose own baseline is usable."""
    return _tickets(p, p.fitted("own_amount"), ["merchant_id"], "amount_vs_own_baseline", "ticket_amount")


def _day_unsettled(p: Portfolio) -> DataFrame:
    bad = F.coalesce(F.col("transaction_status").isin(*UNSETTLED), F.lit(False)).cast("int")
    return p.day().groupBy("merchant_id", "mcc").agg(F.avg(bad).alias("v"), F.sum(bad).alias("evidence"))


def unsettled_ratio_vs_own_baseline(p: Portfolio) -> DataFrame:
    return _above(_day_unsettled(p), p.fitted("own_unsettled"), "merchant_id", "unsettled_ratio_vs_own_baseline", "unsettled_share_vs_own_history", True, 4)


def unsettled_ratio_vs_mcc_peers(p: Portfolio) -> DataFrame:
    return _above(_day_unsettled(p), p.fitted("peer_unsettled"), "mcc", "unsettled_ratio_vs_mcc_peers", "unsettled_share_vs_mcc_peers", True, 4)


def foreign_card_ratio_vs_subdistrict(p: Portfolio) -> DataFrame:
    share = bl.foreign_share(p.day().where(settled_sale()))
    abroad = p.sales().where(has_card_origin() & (F.col("card_issuing_country") != HOME)).groupBy("merchant_id").agg(F.count("*").alias("evidence"))
    measured = share.withColumnRenamed("share", "v").join(p.merchants.select("merchant_id", "merchant_subdistrict"), "merchant_id").join(abroad, "merchant_id", "left").fillna(0, ["evidence"])
    return _above(measured, p.fitted("subdistrict_foreign"), "merchant_subdistrict", "foreign_card_ratio_vs_subdistrict", "foreign_card_share_vs_district", places=3)


def merchant_level_vs_mcc_peers(p: Portfolio) -> DataFrame:
    """The merchant's typical amount among its peers'; not comparable without peers, own baseline or sales that day."""
    own = p.fitted("own_amount").where("usable and center <> 0").select("merchant_id", F.col("center").alias("own"))
    peers = p.fitted("peer_amount").where("usable").select("mcc", "center", "dispersion")
    active = p.sales().select("merchant_id").distinct()
    both = own.join(active, "merchant_id").join(p.merchants.select("merchant_id", "mcc"), "merchant_id").join(peers, "mcc")
    found = both.withColumn("z", robust.modified_z(F.col("own"), F.col("center"), F.col("dispersion"))).where(p.tuning.fires(F.col("z"), F.col("own")))
    return hit(found, "merchant_level_vs_mcc_peers", "typical_ticket_vs_mcc_peers", F.col("own"), F.col("center"), F.col("z"))


def level_shift_ramp(p: Portfolio) -> DataFrame:
    ramps = p.fitted("trend").where("is_ramp").withColumn("ratio", robust.rounded(F.col("trend_ratio"), 3))
    own = p.fitted("own_amount").select("merchant_id", "center")
    found = ramps.join(own, "merchant_id")
    return hit(found, "level_shift_ramp", "level_shift_7d_vs_90d", F.col("center"), F.col("center") / F.col("ratio"), F.col("ratio"), places=(None, None, 3))


DETECTORS = (
    count_vs_own_baseline, count_vs_mcc_peers, burst_rate_vs_own_baseline, hour_vs_own_pattern, card_origin_vs_own_mix,
    hour_vs_mcc_peers, ticket_vs_subdistrict_peers, unsettled_ratio_vs_own_baseline, unsettled_ratio_vs_mcc_peers,
    foreign_card_ratio_vs_subdistrict, amount_vs_payment_method_baseline, ticket_vs_mcc_peers, merchant_level_vs_mcc_peers,
    level_shift_ramp, amount_vs_own_baseline,
)


#: Fits that DETECTORS read.
DETECTOR_FITS = tuple(name for name in FITS if name not in ("daily_value", "last_activity"))


def detect(p: Portfolio) -> DataFrame:
    """All hits of family A."""
    return reduce(DataFrame.unionByName, [d(p) for d in DETECTORS])


def lanes(p: Portfolio) -> DataFrame:
    """(merchant_id, lane): A with a usable baseline of its own, else B."""
    own = p.fitted("own_amount")
    return own.select("merchant_id", F.when(F.col("usable"), "A").otherwise("B").alias("lane"))


def write_fits(p: Portfolio, names: Collection[str] = tuple(FITS)) -> Portfolio:
    """``p`` with FITS, or those of ``names``, and the scored day's rows written once; what reads it reads them back.

    All fits are summed from day tables: those that ``p`` brings along, so that of the ledger only the
    scored day is read, or else tables made in one pass over the windows' days. A run that doesn't
    start at midnight has windows that cut days, and fits from the ledger's rows.
    """
    spark = p.ledger.sparkSession
    made = {name: partial(make, p) for name, make in FITS.items() if name in names}
    if p.as_of.time() == time():
        dates = (p.as_of.date(),)
        days = p.days
        # without day tables the last activity may lie before all windows
        summed = [name for name in made if name not in p.written and (name != "last_activity" or days is not None)]
        common, parts = daytables.needed(summed)
        if days is None:
            built = daytables.build(p.ledger, daytables.reach(dates, p.fit))
            days = tables.write_all(spark, {name: partial(lambda df: df, df) for name, df in built.items() if name in parts})
        w = daytables.Windows(days, p.merchants, p.confirmed, dates, p.fit)
        shared = tables.write_all(spark, {name: partial(make, w) for name, make in daytables.SHARED.items() if name in common})
        made |= {name: partial(lambda make: make(w, shared).drop("as_of"), daytables.FITS[name]) for name in summed}
    made = {name: make for name, make in made.items() if name not in p.written} | {"day": p.day}
    return replace(p, written={**p.written, **tables.write_all(spark, made)})


def backfill(days: Mapping[str, DataFrame], merchants: DataFrame, confirmed: DataFrame | None, dates: Sequence[date], fit: bl.FitSettings = bl.FitSettings(), names: Collection[str] = tuple(FITS)) -> dict[str, DataFrame]:
    """FITS, or those of ``names``, of many dates at once, keyed by ``as_of``: one plan each over the day tables, whatever the number of dates."""
    spark = merchants.sparkSession
    w = daytables.Windows(days, merchants, confirmed, tuple(dates), fit)
    common, _ = daytables.needed(names)
    shared = tables.write_all(spark, {name: partial(make, w) for name, make in daytables.SHARED.items() if name in common})
    return tables.write_all(spark, {name: partial(make, w, shared) for name, make in daytables.FITS.items() if name in names})
