"""Verdicts of every check for every merchant: failed, passed, or not comparable."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import detectors as det
from ledgerscope.operators.detectors import Portfolio, Tuning
from ledgerscope.operators.predicates import HOME, has_card_origin, settled_sale
from ledgerscope.operators.typology import Rule, day_features, evaluate

#: The order in which verdicts are read.
ORDER = (
    "amount_vs_own_baseline", "count_vs_own_baseline", "burst_rate_vs_own_baseline", "level_shift_ramp", "hour_vs_own_pattern", "card_origin_vs_own_mix",
    "ticket_vs_mcc_peers", "merchant_level_vs_mcc_peers", "count_vs_mcc_peers", "hour_vs_mcc_peers", "ticket_vs_subdistrict_peers",
    "foreign_card_ratio_vs_subdistrict", "unsettled_ratio_vs_own_baseline", "unsettled_ratio_vs_mcc_peers",
)


class Study(Portfolio):
    """A portfolio whose sales of the day are settled ones, as the baselines' are."""

    def sales(self) -> DataFrame:
        return self.day().where(settled_sale())


def comparable(p: Portfolio) -> DataFrame:
    """(merchant_id, detector): checks whose baseline is usable and that have rows of the day to compare."""
    sales, day = p.sales().select("merchant_id").distinct(), p.day().select("merchant_id").distinct()
    abroad = p.sales().where(has_card_origin() & (F.col("card_issuing_country") != HOME)).select("merchant_id").distinct()
    cards = p.day().where(settled_sale() & has_card_origin()).select("merchant_id").distinct()
    by = lambda base, key: base.where("usable").join(p.merchants, key).select("merchant_id") if key != "merchant_id" else base.where("usable").select("merchant_id")
    own = p.fitted("own_amount")
    mix = p.fitted("origin_mix").where(F.col("n") >= p.fit.min_origins).select("merchant_id").distinct()
    peers = by(p.fitted("peer_amount"), "mcc")
    gates = {
        "amount_vs_own_baseline": (by(own, "merchant_id"), sales),
        "count_vs_own_baseline": (by(p.fitted("own_daily_count"), "merchant_id"), sales),
        "burst_rate_vs_own_baseline": (by(p.fitted("own_velocity"), "merchant_id"), sales),
        "level_shift_ramp": (p.merchants.select("merchant_id"), p.merchants.select("merchant_id")),
        "hour_vs_own_pattern": (by(p.fitted("own_hours"), "merchant_id"), sales),
        "card_origin_vs_own_mix": (mix, abroad),
        "ticket_vs_mcc_peers": (by(p.fitted("mcc_tickets"), "mcc"), sales),
        "merchant_level_vs_mcc_peers": (own.where("usable and center <> 0").join(peers, "merchant_id", "left_semi").select("merchant_id"), sales),
        "count_vs_mcc_peers": (by(p.fitted("peer_daily_count"), "mcc"), sales),
        "hour_vs_mcc_peers": (by(p.fitted("cohort_hours"), "mcc"), sales),
        "ticket_vs_subdistrict_peers": (by(p.fitted("subdistrict_tickets"), "merchant_subdistrict"), sales),
        "foreign_card_ratio_vs_subdistrict": (by(p.fitted("subdistrict_foreign"), "merchant_subdistrict"), cards),
        "unsettled_ratio_vs_own_baseline": (by(p.fitted("own_unsettled"), "merchant_id"), day),
        "unsettled_ratio_vs_mcc_peers": (by(p.fitted("peer_unsettled"), "mcc"), day),
    }
    return reduce(DataFrame.unionByName, [base.join(rows, "merchant_id", "left_semi").select("merchant_id", F.lit(d).alias("detector")) for d, (base, rows) in gates.items()])


def study(p: Portfolio) -> DataFrame:
    """(merchant_id, step, detector, status): FAIL, OK or SKIP for each of 14 checks, at fixed cut-offs without a materiality floor."""
    fits = det.write_fits(p, [name for name in det.DETECTOR_FITS if name != "rail_amount"]).written
    s = Study(p.ledger, p.merchants, p.confirmed, p.as_of, Tuning(materiality_floor=float("-inf")), p.fit, fits)
    checks = {d.__name__: d for d in det.DETECTORS}
    failed = reduce(DataFrame.unionByName, [checks[d](s).select("merchant_id", "detector").distinct() for d in ORDER]).withColumn("failed", F.lit(True))
    live = comparable(s).withColumn("live", F.lit(True))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(d).alias("detector")) for k, d in enumerate(ORDER)]))
    every = p.merchants.select("merchant_id", steps.alias("s")).select("merchant_id", "s.step", "s.detector")
    joined = every.join(failed, ["merchant_id", "detector"], "left").join(live, ["merchant_id", "detector"], "left")
    return joined.select("merchant_id", "step", "detector", F.when(F.col("failed"), "FAIL").when(F.col("live"), "OK").otherwise("SKIP").alias("status"))


def root_cause(verdicts: DataFrame) -> DataFrame:
    """(merchant_id, detector): the first check that failed, in reading order."""
    return verdicts.where("status = 'FAIL'").groupBy("merchant_id").agg(F.min(F.struct("step", "detector")).alias("f")).select("merchant_id", "f.detector")


def rule_study(p: Portfolio, rules: list[Rule]) -> DataFrame:
    """(merchant_id, rule, status) of every enabled rule of family B for merchants with rows of the day: FAIL, OK, or SKIP out of scope."""
    f = day_features(p)
    live = [r for r in rules if r.enabled]
    hits = evaluate(p, live, f).select("merchant_id", F.col("detector").alias("rule"), F.lit(True).alias("failed"))
    scopes = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), r.in_scope().alias("scope")) for r in live]))
    each = f.select("merchant_id", "mcc", scopes.alias("r")).select("merchant_id", "r.rule", "r.scope")
    return each.join(hits, ["merchant_id", "rule"], "left").select("merchant_id", "rule", F.when(F.col("failed"), "FAIL").when(F.col("scope"), "OK").otherwise("SKIP").alias("status"))


def backfill(p: Portfolio, days: int, step: int = 1):
    """Portfolios of the ``days`` before and the date itself, oldest first, for replaying fits."""
    return [replace(p, as_of=p.as_of - timedelta(days=d)) for d in range(days, -1, -step)]
