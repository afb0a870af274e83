"""The rows behind a hit: each transaction that drives it, the field that counts, its value, and why.

A hit's ``evidence`` is the number of its contributions. Hits about a merchant as such (its level,
its ramp, its registration, its agent) have none. Contributions are rows of a table that is
published with the alerts, and no array of an alert: a busy merchant's day may be long.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions import density, robust, text
from ledgerscope.operators import detectors as det, typology as ty
from ledgerscope.operators.detectors import Portfolio
from ledgerscope.operators.predicates import HOME, UNSETTLED, has_card_origin, not_refund
from ledgerscope.operators.typology import Rule

COLUMNS = ("merchant_id", "detector", "source_txn_id", "field", "value", "feature_name", "reason")


def shown(field: str) -> Column:
    """The displayed value of a transaction's field."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    if field == "total_amount":
        return text.money(F.col(field))
    return text.iso(F.col(field)) if field == "occurred_at" else known(field)


def _rows(hits: DataFrame, rows: DataFrame, field: str | Column, reason: Column | str, value: Column | None = None, feature: Column | None = None) -> DataFrame:
    """Contributions of ``hits`` from the day's ``rows`` of their merchants, of the same feature where ``feature`` is given.

    ``reason`` may use the rows' columns and the hit's measure and baseline as ``seen`` and ``usual``.
    """
    keys = ["merchant_id", *([] if feature is None else ["feature_name"])]
    each = rows if feature is None else rows.withColumn("feature_name", feature)
    named = hits.select("merchant_id", "detector", "feature_name", F.col("merchant_value").alias("seen"), F.col("baseline_value").alias("usual"))
    both = each.join(named, keys)
    given = F.lit(field) if isinstance(field, str) else field
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return both.select("merchant_id", "detector", "source_txn_id", given.alias("field"), (shown(field) if value is None else value).alias("value"), "feature_name", reason.alias("reason"))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


_SEEN, _USUAL = "seen", "usual"


def _count(which: str) -> Callable[[Portfolio, DataFrame], DataFrame]:
    def of(p: Portfolio, h: DataFrame) -> DataFrame:
        n, usual = F.col(_SEEN).cast("long").cast("string"), text.whole(F.col(_USUAL))
        reason = _say("one of ", n, " transactions today, against a usual ", usual) if which == "own" else _say("one of ", n, " transactions today, against ", usual, " for this trade")
        return _rows(h, p.sales(), "occurred_at", reason)

    return of


def _burst(p: Portfolio, h: DataFrame) -> DataFrame:
    return _rows(h, det.peak_rows(p.sales()), "occurred_at", _say("one of ", F.col(_SEEN).cast("long").cast("string"), " transactions inside the busiest hour"))


def _tickets(base: str, keys: list[str], before: str, after: str) -> Callable[[Portfolio, DataFrame], DataFrame]:
    """Amounts that fire against the baseline of their key."""

    def of(p: Portfolio, h: DataFrame) -> DataFrame:
        both = p.sales().join(p.fitted(base).where("usable").select(*keys, "center", "dispersion"), keys)
        z = robust.modified_z(F.col("total_amount"), F.col("center"), F.col("dispersion"))
        rail = "card_type" in keys
        feature = F.concat(F.lit("amount_on_"), F.lower("card_type")) if rail else None
        reason = _say("large for ", F.col("card_type"), " at this merchant (typical ", text.whole(F.col("center")), " on this rail)") if rail else _say(before, text.whole(F.col("center")), after)
        return _rows(h, both.where(p.tuning.fires(z, F.col("total_amount"))), "total_amount", reason, feature=feature)

    return of


def _hours(base: str, key: str, before: str) -> Callable[[Portfolio, DataFrame], DataFrame]:
    """Rows at hours whose density is below the threshold."""

    def of(p: Portfolio, h: DataFrame) -> DataFrame:
        timed = p.sales().join(p.fitted(base).where("usable").select(key, "usable", "threshold", "density"), key)
        at, threshold = robust.rounded(density.density_at(F.col("density"), density.bin_of()), 6), robust.rounded(F.col("threshold"), 6)
        odd = density.is_unusual(F.col("usable"), at, threshold)
        return _rows(h, timed.where(odd), "occurred_at", _say(before, text.whole(F.col(_USUAL)), ":00)"))

    return of


def _abroad(p: Portfolio) -> DataFrame:
    return p.sales().where(has_card_origin() & (F.col("card_issuing_country") != HOME))


def _origins(p: Portfolio, hits: DataFrame) -> DataFrame:
    """Rows of every country that surprises, the hit's own and others."""
    mix = p.fitted("origin_mix").where(F.col("n") >= p.fit.min_origins)
    totals, known = mix.select("merchant_id", "n", "kinds").distinct(), mix.select("merchant_id", F.col("country").alias("card_issuing_country"), "c")
    each = _abroad(p).join(totals, "merchant_id").join(known, ["merchant_id", "card_issuing_country"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    bits = det.surprisal(F.col("c"), F.col("n"), F.col("kinds"))
    reason = _say("cards issued in ", F.col("card_issuing_country"), " are ", text.percent(F.col("c") / F.col("n")), " of this merchant's normal mix")
    return _rows(hits, each.where(bits > det.SURPRISAL_FLAG), "card_issuing_country", reason)


def _unsettled(before: str) -> Callable[[Portfolio, DataFrame], DataFrame]:
    return lambda p, h: _rows(h, p.day().where(F.col("transaction_status").isin(*UNSETTLED)), "transaction_status", _say(before, text.percent(F.col(_USUAL))))


#: How each detector of family A finds its rows, and what it says of them.
FAMILY_A: dict[str, Callable[[Portfolio, DataFrame], DataFrame]] = {
    "count_vs_own_baseline": _count("own"),
    "count_vs_mcc_peers": _count("peers"),
    "burst_rate_vs_own_baseline": _burst,
    "hour_vs_own_pattern": _hours("own_hours", "merchant_id", "outside this merchant's trading pattern (usual peak "),
    "hour_vs_mcc_peers": _hours("cohort_hours", "mcc", "outside the hours this trade normally operates (cohort peak "),
    "card_origin_vs_own_mix": _origins,
    "ticket_vs_subdistrict_peers": _tickets("subdistrict_tickets", ["merchant_subdistrict"], "above what merchants in this district normally take (typical ", ")"),
    "ticket_vs_mcc_peers": _tickets("mcc_tickets", ["mcc"], "above what this trade normally takes (typical ", ")"),
    "amount_vs_own_baseline": _tickets("own_amount", ["merchant_id"], "far above this merchant's typical transaction (", ")"),
    "amount_vs_payment_method_baseline": _tickets("rail_amount", ["merchant_id", "card_type"], "", ""),
    "unsettled_ratio_vs_own_baseline": _unsettled("did not settle, against this merchant's usual "),
    "unsettled_ratio_vs_mcc_peers": _unsettled("did not settle, against an MCC norm of "),
    "foreign_card_ratio_vs_subdistrict": lambda p, h: _rows(h, _abroad(p), "card_issuing_country", _say("overseas-issued, against a district norm of ", text.percent(F.col(_USUAL)))),
}


def _rule_rows(p: Portfolio, hits: DataFrame, r: Rule) -> DataFrame:
    """Contributions of a rule of family B: the day's rows that it counts."""
    status = F.upper(F.coalesce("transaction_status", F.lit("")))
    refund, amount = ~not_refund(), F.col("total_amount")
    settled = ~refund & ~status.isin("DECLINED", "CANCELLED", "VOIDED")
    stated = lambda default: F.coalesce(F.nullif(F.col("transaction_status"), F.lit("")), F.lit(default))
    if r.template == "structuring_below_threshold":
        top = r.value("threshold")
        low = top * (1 - r.value("band_fraction"))
        rows = p.sales().where(settled & (amount >= low) & (amount < top))
        return _rows(hits, rows, "total_amount", _say(text.percent(1 - amount / top), " below the ", text.money(F.lit(top)), " threshold"))
    if r.template == "refund_ratio_spike":
        return _rows(hits, p.day().where(refund), "transaction_status", _say("refund of ", text.money(amount)), stated("REFUND"))
    if r.template == "bust_out":
        return _rows(hits, p.day().where(refund), "transaction_status", "refund during the spike", stated("REFUND"))
    if r.template == "dormant_reactivation":
        return _rows(hits, p.day().where(settled), "occurred_at", _say("first activity in ", F.col(_SEEN).cast("long").cast("string"), " days"))
    if r.template == "rapid_movement":
        field, reason = F.when(refund, "net_amount").otherwise("total_amount"), F.when(refund, "value out").otherwise("value in")
        return _rows(hits, p.day().where(settled | refund), field, reason, text.money(amount))
    if r.template == "decline_ratio_spike":
        return _rows(hits, p.day().where(~refund & (status == "DECLINED")), "transaction_status", "declined authorisation", stated("DECLINED"))
    hours = p.fitted("cohort_hours").select("mcc", "density", robust.rounded(F.col("threshold"), 6).alias("threshold"))
    inside = robust.rounded(density.density_at(F.col("density"), density.bin_of()), 6) >= F.col("threshold")
    return _rows(hits, p.day().join(hours, "mcc", "left").where(~F.coalesce(inside, F.lit(False))), "occurred_at", "outside the declared category's normal hours")


def family_a(p: Portfolio) -> dict[str, Callable[[], DataFrame]]:
    """Contributions of the hits of family A by detector."""
    checks = {d.__name__: d for d in det.DETECTORS}
    return {name: partial(lambda of, name: of(p, checks[name](p)), of, name) for name, of in FAMILY_A.items()}


def family_b(p: Portfolio, rules: list[Rule], features: DataFrame | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Contributions of the hits of family B by rule."""
    f = ty.day_features(p) if features is None else features
    return {r.name: partial(lambda r: _rule_rows(p, ty.evaluate(p, [r], f), r), r) for r in rules if r.enabled and r.template in ty.EVALUATORS}
