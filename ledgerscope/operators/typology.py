"""Family B: typology rules, parameterised templates over a merchant's scored day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import density, robust
from ledgerscope.operators import baselines as bl
from ledgerscope.operators.detectors import Portfolio, hit
from ledgerscope.operators.predicates import scored_day


@dataclass(frozen=True)
class Param:
    """Default and bounds of a rule's parameter."""

    default: float
    low: float
    high: float


#: The templates' parameters with defaults and bounds.
TEMPLATES: dict[str, dict[str, Param]] = {
    "structuring_below_threshold": {"threshold": Param(8000, 1000, 200000), "band_fraction": Param(0.15, 0.01, 0.5), "min_count": Param(3, 2, 50), "max_baseline_ratio": Param(0.5, 0.05, 1)},
    "refund_ratio_spike": {"min_refunds": Param(3, 1, 100), "ratio": Param(0.30, 0.05, 1)},
    "bust_out": {"spike_ratio": Param(3, 1.5, 20), "recent_days": Param(7, 2, 60), "refund_ratio": Param(0.10, 0, 1)},
    "dormant_reactivation": {"silence_days": Param(45, 7, 365), "return_count": Param(10, 1, 500)},
    "rapid_movement": {"min_value": Param(20000, 0, 1000000), "match_tolerance": Param(0.10, 0.01, 0.5)},
    "declared_vs_actual_mismatch": {"ticket_ratio": Param(4, 1.5, 50), "hours_overlap": Param(0.25, 0, 1)},
    "decline_ratio_spike": {"min_attempts": Param(20, 5, 1000), "ratio": Param(0.25, 0.05, 1)},
    "shared_identity_ring": {"min_members": Param(3, 2, 100), "min_flagged": Param(1, 0, 50)},
    "agent_alert_concentration": {"min_merchants": Param(5, 2, 500), "rate_multiple": Param(3, 1.2, 20)},
    "card_across_related_merchants": {"max_branches": Param(3, 1, 20)},
    "card_swarm": {"min_merchants": Param(5, 2, 100), "window_minutes": Param(120, 5, 1440)},
    "impossible_geo_velocity": {"max_kmh": Param(60, 5, 300), "min_km": Param(3, 0, 50), "max_minutes": Param(240, 5, 1440)},
}
FAMILY_C = ("shared_identity_ring", "agent_alert_concentration", "card_across_related_merchants", "card_swarm", "impossible_geo_velocity")


@dataclass(frozen=True)
class Rule:
    """An instance of a template. Rules are data: no expression of a user's is ever evaluated."""

    template: str
    params: dict = field(default_factory=dict)
    instance_id: str | None = None
    enabled: bool = True
    mcc_scope: tuple[str, ...] = ()
    custom: bool = False  #: added by a person, so that it may be deleted
    label: str | None = None

    @property
    def name(self) -> str:
        return self.instance_id or self.template

    def value(self, name: str) -> float:
        return float(self.params.get(name, TEMPLATES[self.template][name].default))

    def in_scope(self) -> Column:
        """An empty scope holds all merchants; a null MCC counts as an empty one."""
        return F.coalesce("mcc", F.lit("")).isin(*self.mcc_scope) if self.mcc_scope else F.lit(True)

#: Fits that the rules read.
FITS = ("own_amount", "peer_amount", "cohort_hours", "last_activity", "daily_value")

def validate(rules: list[Rule]) -> None:
    """Reject a set with an unknown template or parameter, a value out of bounds, a repeated id, or a scope on family C."""
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("two rules have one id")
    for r in rules:
        if r.template not in TEMPLATES:
            raise ValueError(f"no template {r.template}")
        if r.mcc_scope and r.template in FAMILY_C:
            raise ValueError(f"{r.name}: this template takes no scope")
        for k, v in r.params.items():
            p = TEMPLATES[r.template].get(k)
            if p is None or not p.low <= v <= p.high:
                raise ValueError(f"{r.name}: {k} = {v} is not allowed")


DEFAULT_RULES = [Rule(t) for t in TEMPLATES]


class Instances:
    """The enabled instances of one template as data: each row is spread to those that apply, and all are judged in one pass."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.template = rules[0].template

    @property
    def name(self) -> Column:
        return F.col("__rule.name")

    def value(self, name: str) -> Column:
        return F.col(f"__rule.{name}")

    def spread(self, rows: DataFrame) -> DataFrame:
        """``rows`` once for each instance whose scope holds their MCC, with the instance's name and values as ``__rule``.

        Instances are set by hand and few; they are literals of the plan. An empty scope holds all
        merchants; a null MCC counts as an empty one.
        """
        one = lambda r: F.struct(
            F.lit(r.name).alias("name"), *[F.lit(r.value(k)).alias(k) for k in TEMPLATES[self.template]], F.array(*[F.lit(m) for m in r.mcc_scope]).cast("array<string>").alias("scope")
        )
        each = rows.withColumn("__rule", F.explode(F.array(*map(one, self.rules))))
        return each.where((F.size("__rule.scope") == 0) | F.array_contains("__rule.scope", F.coalesce("mcc", F.lit(""))))


def _judged(check: Callable[[Portfolio, DataFrame, Instances], DataFrame]) -> Callable[[Portfolio, DataFrame, Rule | Instances], DataFrame]:
    """``check`` for one rule, or for all instances of its template at once."""

    def of(p: Portfolio, f: DataFrame, r: Rule | Instances) -> DataFrame:
        given = r if isinstance(r, Instances) else Instances([r])
        return check(p, given.spread(f), given)

    of.__name__ = check.__name__
    return of


def day_features(p: Portfolio) -> DataFrame:
    """One row per merchant with any row on the scored day: sums, counts, levels and history that the rules read.

    Statuses are compared in upper case; a sale settles unless it is a refund or declined, cancelled
    or voided; refunds count whatever their status.
    """
    status = F.upper(F.coalesce("transaction_status", F.lit("")))
    refund = F.coalesce("is_refund", F.lit(False))
    settled = ~refund & ~status.isin("DECLINED", "CANCELLED", "VOIDED")
    amount = F.coalesce("total_amount", F.lit(0.0))
    own = p.fitted("own_amount").select("merchant_id", F.col("center").alias("own_center"))
    peers = p.fitted("peer_amount").select("mcc", F.col("center").alias("cohort_center"))
    hours = p.fitted("cohort_hours").select("mcc", "density", robust.rounded(F.col("threshold"), 6).alias("threshold"))
    rows = p.day().join(hours, "mcc", "left").withColumn("inside", robust.rounded(density.density_at(F.col("density"), density.bin_of()), 6) >= F.col("threshold"))
    day = rows.groupBy("merchant_id", "mcc").agg(
        F.count("*").alias("rows"),
        F.count(F.when(settled, 1)).alias("settled"),
        F.count(F.when(refund, 1)).alias("refunds"),
        F.sum(F.when(settled, amount).otherwise(0.0)).alias("gross"),
        F.sum(F.when(refund, amount).otherwise(0.0)).alias("refunded"),
        F.count(F.when(~refund & (status != ""), 1)).alias("attempts"),
        F.count(F.when(~refund & (status == "DECLINED"), 1)).alias("declined"),
        F.count(F.when(F.col("inside"), 1)).alias("inside"),
        F.max(F.col("density").isNotNull()).alias("has_hours"),
    )
    return day.join(own, "merchant_id", "left").join(peers, "mcc", "left").join(p.fitted("last_activity"), "merchant_id", "left")


def structuring(p: Portfolio, f: DataFrame, r: Instances) -> DataFrame:
    top, low = r.value("threshold"), r.value("threshold") * (1 - r.value("band_fraction"))
    status = F.upper(F.coalesce("transaction_status", F.lit("")))
    near = r.spread(p.sales()).where(~status.isin("DECLINED", "CANCELLED", "VOIDED") & (F.col("total_amount") >= low) & (F.col("total_amount") < top))
    counts = near.groupBy("merchant_id", r.name.alias("__name")).agg(F.count("*").alias("near"))
    found = f.withColumn("__name", r.name).join(counts, ["merchant_id", "__name"]).where((F.col("own_center") < top * r.value("max_baseline_ratio")) & (F.col("near") >= r.value("min_count")))
    n = F.col("near")
    return hit(found, r.name, "near_threshold_transaction_count", n, F.lit(r.value("min_count")), n - r.value("min_count"), F.least(0.55 + 0.05 * (n - r.value("min_count")), F.lit(1.0)), n, "B")


def refund_ratio(p: Portfolio, f: DataFrame, r: Instances) -> DataFrame:
    found = f.where((F.col("refunds") >= r.value("min_refunds")) & (F.col("gross") > 0)).withColumn("v", F.col("refunded") / F.col("gross")).where(F.col("v") >= r.value("ratio"))
    return hit(found, r.name, "refund_value_share", F.col("v"), F.lit(r.value("ratio")), F.col("v") - r.value("ratio"), F.least("v", F.lit(1.0)), F.col("refunds"), "B", (4, None, 4))


def bust_out(p: Portfolio, f: DataFrame, r: Instances) -> DataFrame:
    """The last active days' median value against all earlier ones'. Days are few, so a window ranks them, once for all instances."""
    w = Window.partitionBy("merchant_id")
    ranked = p.fitted("daily_value").withColumn("k", F.row_number().over(w.orderBy(F.desc("txn_date")))).withColumn("days", F.count("*").over(w))
    recent = r.value("recent_days").cast("int")
    both = f.join(ranked.select("merchant_id", "k", "days", F.col("gross").alias("value")), "merchant_id").where(F.col("days") >= 2 * recent)
    keys = ["merchant_id", "__rule", "gross", "refunded", "refunds"]
    levels = both.groupBy(*keys).agg(F.median(F.when(F.col("k") <= recent, F.col("value"))).alias("now"), F.median(F.when(F.col("k") > recent, F.col("value"))).alias("before"))
    share = F.when(F.col("gross") > 0, F.col("refunded") / F.col("gross")).otherwise(F.lit(0.0))
    found = levels.where("before > 0").withColumn("v", F.col("now") / F.col("before")).where((F.col("v") >= r.value("spike_ratio")) & (share >= r.value("refund_ratio")))
    return hit(found, r.name, "recent_vs_earlier_daily_value", F.col("now"), F.col("before"), F.col("v"), evidence=F.col("refunds"), family="B", places=(2, 2, 2))


def dormant(p: Portfolio, f: DataFrame, r: Instances) -> DataFrame:
    gap = F.datediff(F.lit(scored_day(p.as_of).start.date().isoformat()).cast("date"), F.col("last_active"))
    found = f.withColumn("gap", gap).where((F.col("gap") >= r.value("silence_days")) & (F.col("settled") >= r.value("return_count")))
    return hit(found, r.name, "days_dormant_before_return", F.col("gap"), F.lit(r.value("silence_days")), F.col("gap") - r.value("silence_days"), F.least(0.5 + F.col("gap") / 365, F.lit(1.0)), F.col("settled"), "B")


def rapid_movement(p: Portfolio, f: DataFrame, r: Instances) -> DataFrame:
    limit = r.value("match_tolerance")
    live = f.where((F.col("gross") >= r.value("min_value")) & (F.col("gross") > 0) & (F.col("refunded") > 0))
    found = live.withColumn("v", F.abs(F.col("gross") - F.col("refunded")) / F.col("gross")).where(F.col("v") <= limit)
    return hit(found, r.name, "same_day_in_out_mismatch", F.col("v"), F.lit(limit), limit - F.col("v"), F.least(0.6 + (limit - F.col("v")), F.lit(1.0)), F.col("settled") + F.col("refunds"), "B", (4, None, 4))


def declared_mismatch(p: Portfolio, f: DataFrame, r: Instances) -> DataFrame:
    live = f.where("own_center <> 0 and cohort_center > 0 and has_hours").withColumn("v", F.col("own_center") / F.col("cohort_center")).withColumn("overlap", F.col("inside") / F.col("rows"))
    found = live.where((F.col("v") >= r.value("ticket_ratio")) & (F.col("overlap") < r.value("hours_overlap")))
    return hit(found, r.name, "declared_category_divergence", F.col("v"), F.lit(r.value("ticket_ratio")), F.col("v") - r.value("ticket_ratio"), F.least(F.col("v") / 20 + (1 - F.col("overlap")) / 2, F.lit(1.0)), F.col("rows") - F.col("inside"), "B", (2, None, 2))


def decline_ratio(p: Portfolio, f: DataFrame, r: Instances) -> DataFrame:
    found = f.where(F.col("attempts") >= r.value("min_attempts")).withColumn("v", F.col("declined") / F.col("attempts")).where(F.col("v") >= r.value("ratio"))
    return hit(found, r.name, "declined_authorisation_share", F.col("v"), F.lit(r.value("ratio")), F.col("v") - r.value("ratio"), F.least("v", F.lit(1.0)), F.col("declined"), "B", (4, None, 4))


EVALUATORS = {
    "structuring_below_threshold": _judged(structuring), "refund_ratio_spike": _judged(refund_ratio), "bust_out": _judged(bust_out), "dormant_reactivation": _judged(dormant),
    "rapid_movement": _judged(rapid_movement), "declared_vs_actual_mismatch": _judged(declared_mismatch), "decline_ratio_spike": _judged(decline_ratio),
}


def by_template(rules: list[Rule]) -> dict[str, Instances]:
    """The enabled rules of family B, those of a template together; rules of other families are passed over."""
    validate(rules)
    live = [r for r in rules if r.enabled and r.template in EVALUATORS]
    return {t: Instances([r for r in live if r.template == t]) for t in dict.fromkeys(r.template for r in live)}


def evaluate(p: Portfolio, rules: list[Rule], features: DataFrame | None = None) -> DataFrame:
    """Hits of all enabled rules of family B: one pass for each template, whatever the number of its instances."""
    f = day_features(p) if features is None else features
    found = [EVALUATORS[t](p, f, given) for t, given in by_template(rules).items()]
    return reduce(DataFrame.unionByName, found) if found else hit(f.limit(0), "", "", F.lit(0.0), F.lit(0.0), F.lit(0.0), family="B")
