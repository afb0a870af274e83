"""A made-up portfolio with known shapes, for trials and tests of the checks at production thresholds.

Every value is a function of the seed, the merchant, the day and the row alone, so that the ledger is
equal whatever the partitioning, and a copy of the portfolio is as large as asked for.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """A merchant's ordinary trade."""

    name: str
    mcc: str
    place: str
    ticket: float
    per_day: int = 5
    days: int = 90
    spread: float = 0.35  #: of the logarithm of its tickets
    growth: float = 0.0  #: a day


#: Shapes by merchant; the others are company for their trades and districts.
SPECS = (
    Spec("STEADY", "5411", "Central", 118.0, 6), Spec("GROCER2", "5411", "Central", 97.0), Spec("GROCER3", "5411", "Sha Tin", 136.0), Spec("GROCER4", "5411", "Central", 112.0, 6),
    Spec("PEEROUT", "5411", "Central", 4300.0, spread=0.05), Spec("FLOOD", "5411", "Central", 116.0), Spec("NEWBIE", "5411", "Central", 108.0, 3, 4),
    Spec("NIGHT", "5411", "Sai Kung", 111.0, 4), Spec("TOURIST", "5411", "Sai Kung", 101.0), Spec("LOCAL2", "5411", "Sai Kung", 94.0), Spec("LOCAL3", "5411", "Sai Kung", 106.0),
    Spec("SPIKE", "5944", "Central", 2950.0, 4), Spec("JEWEL2", "5944", "Sha Tin", 2650.0, 4), Spec("JEWEL3", "5944", "Sha Tin", 3350.0, 4), Spec("BURST", "5944", "Central", 2880.0, 12),
    Spec("FIXED", "5814", "Sha Tin", 38.0, 8, spread=0.0), Spec("RAMP", "5814", "Central", 60.0, growth=0.04),
    Spec("STRUCT", "5732", "Central", 610.0, 6), Spec("ELEC2", "5732", "Sha Tin", 690.0, 6), Spec("ELEC3", "5732", "Sha Tin", 560.0), Spec("DECLINER", "5732", "Sha Tin", 300.0, 30),
    Spec("REFUNDER", "5812", "Central", 890.0, 8), Spec("DORMANT", "5812", "Central", 410.0, 6),
    Spec("RINGA", "5814", "Central", 85.0, 6), Spec("RINGB", "5814", "Central", 90.0, 6), Spec("RINGC", "5814", "Sha Tin", 88.0, 6), Spec("RINGD", "5814", "Sha Tin", 92.0, 6),
    Spec("FARA", "5541", "Tuen Mun", 405.0), Spec("FARB", "5541", "Sai Kung", 415.0),
    Spec("WALLETA", "5814", "Tuen Mun", 60.0, 6), Spec("WALLETB", "5814", "Sai Kung", 62.0, 6), Spec("WALLETC", "5814", "Sha Tin", 58.0, 6),
    Spec("WALLETD", "5814", "Tuen Mun", 64.0, 6), Spec("WALLETE", "5814", "Central", 66.0, 6), Spec("WALLETF", "5814", "Sai Kung", 61.0, 6),
)
#: What production thresholds have to find: (merchant, check).
TRUTH = (
    ("SPIKE", "amount_vs_own_baseline"), ("NEWBIE", "ticket_vs_mcc_peers"), ("RAMP", "level_shift_ramp"), ("PEEROUT", "merchant_level_vs_mcc_peers"), ("FLOOD", "count_vs_own_baseline"),
    ("BURST", "burst_rate_vs_own_baseline"), ("NIGHT", "hour_vs_mcc_peers"), ("TOURIST", "foreign_card_ratio_vs_subdistrict"), ("STRUCT", "structuring_below_threshold"),
    ("REFUNDER", "refund_ratio_spike"), ("DORMANT", "dormant_reactivation"), ("DECLINER", "decline_ratio_spike"), ("RINGA", "shared_identity_ring"), ("RINGD", "shared_identity_ring"),
)
REPORTING_LINE, SILENT_DAYS = 8000.0, 60
_RING, _FAR = ("RINGA", "RINGB", "RINGC", "RINGD"), ("FARA", "FARB")


def chance(seed: int, *what: Column | str) -> Column:
    """A number between 0 and 1 that hangs on the seed and the named columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11) + 0.5) / float(1 << 53)


def _bell(seed: int, *what: Column | str) -> Column:
    """Normally distributed, from two chances."""
    return F.sqrt(-2 * F.log(chance(seed, F.lit("r"), *what))) * F.cos(2 * math.pi * chance(seed, F.lit("a"), *what))


def _specs(spark: SparkSession, copies: int) -> DataFrame:
    """Merchants of all copies; the first copy's ids are the plain names."""
    kinds = "name string, mcc string, place string, ticket double, per_day int, days int, spread double, growth double"
    specs = spark.createDataFrame([asdict(s) for s in SPECS], kinds)
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    return specs.select("*", copy).withColumn("merchant_id", F.when(F.col("copy") == 0, F.col("name")).otherwise(F.concat_ws("-", "name", "copy")))


def merchants(spark: SparkSession, copies: int = 1) -> DataFrame:
    shared = F.when(F.col("name").isin(*_RING), F.concat(F.lit("br-"), F.col("copy").cast("string")))
    own = F.concat(F.lit("hash-"), "merchant_id")
    return _specs(spark, copies).select(
        "merchant_id", "mcc", F.col("place").alias("merchant_subdistrict"), F.lit(None).cast("string").alias("merchant_district"), F.lit(None).cast("string").alias("mcc_description"),
        F.lit(None).cast("string").alias("agent_id"), F.coalesce(shared, own).alias("hashed_br_number"), own.alias("hashed_merchant_address"), own.alias("hashed_merchant_name"),
    )


def ledger(spark: SparkSession, as_of: datetime, seed: int = 7, copies: int = 1) -> DataFrame:
    """The portfolio's rows of the 90 days before ``as_of``; what is planted lies on the last of them, the day that a run scores."""
    is_ = lambda *names: F.col("name").isin(*names)
    back = F.explode(F.sequence(F.lit(1), F.col("days"))).alias("back")
    each = _specs(spark, copies).select("*", back).where(~(is_("DORMANT") & (F.col("back") > 1) & (F.col("back") <= SILENT_DAYS + 1)))
    last = F.col("back") == 1
    number = F.when(last & is_("FLOOD"), F.col("per_day") * 12).when(last & is_("DORMANT"), 14).otherwise(F.col("per_day"))
    extra = F.when(last & is_(*_RING, *_FAR), 1).otherwise(0)
    rows = each.select("*", number.alias("number"), F.explode(F.sequence(F.lit(0), number + extra - 1)).alias("n"))
    planted, at = F.col("n") >= F.col("number"), ("merchant_id", "back", "n")
    level = F.col("ticket") * F.pow(1 + F.col("growth"), F.col("days") - F.col("back"))
    usual = F.round(F.greatest(level * F.exp(F.col("spread") * _bell(seed, *at)), F.lit(1.0)), 2)
    amount = (
        F.when(last & is_("SPIKE", "RINGA") & (F.col("n") == 0), F.col("ticket") * 25).when(last & is_("NEWBIE") & (F.col("n") == 0), 48_000.0)
        .when(last & is_("STRUCT") & (F.col("n") < 4), REPORTING_LINE * (0.98 - 0.02 * F.col("n"))).when(planted & is_(*_RING), 1800.0).when(planted, 520.0).otherwise(usual)
    )
    order = F.array_position(F.array(*[F.lit(m) for m in (*_RING, *_FAR)]), F.col("name")) - 1
    spread = 9 + 11 * (F.col("n") + chance(seed, F.lit("t"), *at)) / F.col("number")
    hour = (
        F.when(planted & is_(*_RING), 12 + order * 25 / 60).when(planted, 14 + (order - len(_RING)) * 20 / 60)
        .when(last & is_("NIGHT"), 3 + F.col("n") / 60).when(last & is_("BURST"), 13 + F.col("n") * 4 / 60).otherwise(spread)
    )
    start = F.date_sub(F.lit(as_of.date().isoformat()).cast("date"), F.col("back")).cast("timestamp_ntz")
    wallet, pick = is_(*[s.name for s in SPECS if s.name.startswith("WALLET")]), chance(seed, F.lit("c"), *at)
    rail = F.when(wallet, F.when(pick < 0.4, "ALIPAYHK").when(pick < 0.8, "OCTOPUS").otherwise("PAYME")).otherwise(F.when(planted | (pick < 0.6), "VISA").otherwise("MASTERCARD"))
    refund = last & is_("REFUNDER") & (F.col("n") >= 4)
    declined = (last & is_("DECLINER") & (F.col("n") < 18)) | (~planted & (chance(seed, F.lit("d"), *at) < 0.02))
    country = F.when(last & is_("TOURIST"), "US").when(chance(seed, F.lit("o"), *at) < 0.03, "CN").otherwise("HK")
    card = F.when(wallet, "").when(planted & is_(*_RING), F.concat(F.lit("ring-"), F.col("copy").cast("string"))).when(planted, F.concat(F.lit("far-"), F.col("copy").cast("string")))
    return rows.select(
        F.concat_ws("-", "merchant_id", "back", "n").alias("source_txn_id"), "merchant_id", amount.alias("total_amount"),
        (start + F.make_dt_interval(secs=F.round(hour * 3600).cast("decimal(18,6)"))).alias("occurred_at"), refund.alias("is_refund"),
        F.when(refund, "REFUNDED").when(declined, "DECLINED").otherwise("SUCCESS").alias("transaction_status"), rail.alias("card_type"), country.alias("card_issuing_country"),
        F.coalesce(card, F.concat(F.lit("pan-"), F.hex(F.xxhash64(F.lit(seed), *at)))).alias("hashed_pan"),
    )

