"""Row predicates and windows of time of the ledger."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status lists and payment rails that are no cards.
UNSETTLED = ("DECLINED", "CANCELLED", "REVERSED", "VOIDED")
REFUND_STATUS = ("REFUNDED", "REFUND", "REVERSED", "CHARGEBACK")
WALLETS = ("ALIPAY", "ALIPAYHK", "OCTOPUS", "WECHAT", "WECHATPAY", "PAYME", "FPS", "TAPNGO", "TAP&GO")
HOME = "HK"


@dataclass(frozen=True)
class Span:
    """Half-open stretch of local time."""

    start: datetime
    end: datetime

    def holds(self, ts: Column) -> Column:
        lit = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
        return (ts >= lit(self.start)) & (ts < lit(self.end))


def baseline_span(as_of: datetime, days: int = 30, lag: int = 7) -> Span:
    """The ``days`` before ``lag`` days before ``as_of``."""
    end = as_of - timedelta(days=lag)
    return Span(end - timedelta(days=days), end)


def scored_day(as_of: datetime) -> Span:
    """The day before the local midnight of ``as_of``."""
    end = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return Span(end - timedelta(days=1), end)


def not_refund() -> Column:
    return ~F.coalesce("is_refund", F.lit(False))


def settled_sale() -> Column:
    """No refund, and no status of the unsettled four (case-sensitive; a null or other status settles)."""
    return not_refund() & (F.col("transaction_status").isNull() | ~F.col("transaction_status").isin(*UNSETTLED))


def has_card_origin() -> Column:
    return F.col("card_issuing_country").isNotNull() & (F.col("card_issuing_country") != "")


def fold(c: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def on_card_rail() -> Column:
    """A blank rail counts as a card; wallets don't."""
    return ~F.coalesce(F.upper(fold(F.col("card_type"))).isin(*WALLETS), F.lit(False))


def has_card() -> Column:
    """Card rail and a card number that is not blank."""
    return on_card_rail() & (F.length(fold(F.coalesce("hashed_pan", F.lit("")))) > 0)


def fires(deviation: Column, amount: Column, outlier_z: Column, materiality: Column) -> Column:
    """Above the cut-off, and, if there is an amount, not below the materiality floor."""
    return (deviation > outlier_z) & (amount.isNull() | (amount >= materiality))


def by_mcc(setting: str, default: float, overrides: dict[str, dict[str, float]]) -> Column:
    """A setting with overrides per MCC, looked up in one map; what an MCC doesn't override is inherited."""
    own = {mcc: float(values[setting]) for mcc, values in sorted(overrides.items()) if setting in values}
    if not own:
        return F.lit(float(default))
    table = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col("mcc")), F.lit(float(default)))


def dated(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("txn_date", F.to_date("occurred_at"))


def without_confirmed(ledger: DataFrame, confirmed: DataFrame | None) -> DataFrame:
    """The ledger without the days of merchants that analysts have confirmed."""
    rows = ledger if "txn_date" in ledger.columns else dated(ledger)
    return rows if confirmed is None else rows.join(confirmed.select("merchant_id", "txn_date"), ["merchant_id", "txn_date"], "left_anti")


def micros() -> Column:
    """Local time as microseconds."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', occurred_at)")
