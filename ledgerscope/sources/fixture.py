"""A transaction ledger derived from the ``events`` table, with merchants, confirmed days and places.

``LEDGER_SQL`` and the others are the same views for an independent SQL engine.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
#: Status of each event type; none for views.
STATUS = {"click": "SUCCESS", "purchase": "SUCCESS", "error": "DECLINED", "signup": "REFUNDED"}
#: Places: (kind, name, latitude, longitude); approximate public coordinates of areas in Hong Kong.
PLACES = (
    ("subdistrict", "Central", 22.2819, 114.1581), ("subdistrict", "Sha Tin", 22.3771, 114.1974), ("subdistrict", "Tuen Mun", 22.3908, 113.9725),
    ("subdistrict", "Sai Kung", 22.3814, 114.2705), ("district", "Island", 22.2650, 114.1880), ("district", "Kowloon", 22.3186, 114.1796),
)
SUBDISTRICTS = ("Central", "Sha Tin", "Tuen Mun", "Sai Kung", "Lei Tung", "  sha  tin ")
DISTRICTS = ("Island", "Kowloon", "New Territories")


def _pick(index, values):
    out = F.when(index == 0, F.lit(values[0]))
    for k, v in enumerate(values[1:], 1):
        out = out.when(index == k, F.lit(v))
    return out


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, with planted shapes.

    Every tenth merchant begins on 20 January (lane B); every fifteenth is silent from then until the
    scored day. On that day a quarter of the rows goes to five merchants, some merchants take twenty
    times their amounts, and others see cards of a new country. One of the five has its rows within
    an hour, another amounts just below a threshold; three cards go round the shops of a chain. Some merchants are dear all along; those with
    dear days take one rail alone.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at, day = F.col("ts").cast("timestamp_ntz"), F.lit("2024-01-30").cast("timestamp_ntz")
    late = at >= F.lit("2024-01-20").cast("timestamp_ntz")
    e = e.where(~((F.col("user_id") % 10 == 9) & ~late) & ~((F.col("user_id") % 15 == 4) & late & (at < day)))
    e = e.withColumn("user_id", F.when((at >= day) & (F.col("event_id") % 4 == 0), F.col("user_id") % 5 + 10).otherwise(F.col("user_id")))
    factor = F.when((F.col("user_id") % 20 == 1) & (at >= day), 20).when((F.col("user_id") % 50 == 2) | (F.col("user_id") == 12), 8).otherwise(1)
    abroad = F.col("user_id") % 10 == 7
    # columns of their own, as the branches below mention them many times and JSON is slow to read
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    e = e.withColumns({"rail": F.when(F.col("user_id") % 20 == 1, 0).otherwise((F.col("event_id") + k) % 6), "origin": (F.col("event_id") * 7 + k) % 20})
    rail, origin = F.col("rail"), F.col("origin")
    burst, below = (F.col("user_id") == 13) & (at >= day), (F.col("user_id") == 14) & (at >= day)
    chain = (F.col("user_id") % 24 == 11) & (at >= day)
    noon = F.date_trunc("day", at).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12), mins=(F.col("event_id") % 50).cast("int"))
    status = F.lit(None).cast("string")
    for kind, name in STATUS.items():
        status = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(status)
    return e.select(
        F.concat(F.lit("T"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("source_txn_id"),
        F.concat(F.lit("M"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("merchant_id"),
        F.when(below, (F.col("event_id") % 200 + 700).cast("double")).otherwise(F.col("value") * factor).alias("total_amount"),
        F.when(burst, noon).otherwise(at).alias("occurred_at"),
        (F.col("event_type") == "signup").alias("is_refund"),
        status.alias("transaction_status"),
        _pick(rail, ("VISA", "MASTERCARD", "AMEX", " AlipayHK ", "")).alias("card_type"),
        F.when(abroad, F.when(at >= day, "JP").when(origin % 2 == 0, "US").otherwise("CN")).when(origin == 0, "US").when(origin == 1, "CN").when(origin == 2, "JP").when(origin == 3, "").when(origin > 4, "HK").alias("card_issuing_country"),
        F.when(chain, F.concat(F.lit("P"), (F.col("event_id") % 3).cast("string"))).when(rail == 4, F.lit(" ")).otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("hashed_pan"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user seen in the events."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").where("user_id is not null").distinct()
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    i = F.col("user_id")
    return u.select(
        F.concat(F.lit("M"), F.lpad(i.cast("string"), 6, "0")).alias("merchant_id"),
        text("500", i % 4).alias("mcc"),
        F.when(i % 3 > 0, text("Trade ", i % 4)).alias("mcc_description"),
        _pick(i % 6, SUBDISTRICTS).alias("merchant_subdistrict"),
        _pick(i % 3, DISTRICTS).alias("merchant_district"),
        text("A", i % 5).alias("agent_id"),
        F.when(i % 2 == 0, text("BR", i % 40)).alias("hashed_br_number"),
        F.when(i % 3 == 0, text("AD", i % 45)).alias("hashed_merchant_address"),
        F.when(i % 24 == 11, "NMCHAIN").when(i % 10 == 0, text("NM", i % 30)).alias("hashed_merchant_name"),
    )


def confirmed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(merchant_id, txn_date) pairs that an analyst has confirmed: two days of every 25th merchant."""
    m = merchants(spark, sf_dir).where(F.substring("merchant_id", 2, 6).cast("int") % 25 == 3)
    return m.select("merchant_id", F.explode(F.array(*[F.lit(d).cast("date") for d in ("2024-01-10", "2024-01-11")])).alias("txn_date"))


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLACES), "kind string, place string, lat double, lon double")


def _case(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


LEDGER_SQL = f"""
ledger AS (
  SELECT 'T' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS source_txn_id, 'M' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS merchant_id,
    CASE WHEN user_id = 14 AND ts >= TIMESTAMP '2024-01-30' THEN CAST(event_id % 200 + 700 AS DOUBLE)
      ELSE value * CASE WHEN user_id % 20 = 1 AND ts >= TIMESTAMP '2024-01-30' THEN 20 WHEN user_id % 50 = 2 OR user_id = 12 THEN 8 ELSE 1 END END AS total_amount,
    CASE WHEN user_id = 13 AND ts >= TIMESTAMP '2024-01-30' THEN date_trunc('day', CAST(ts AS TIMESTAMP)) + INTERVAL 12 HOUR + to_minutes(CAST(event_id % 50 AS INT)) ELSE CAST(ts AS TIMESTAMP) END AS occurred_at, event_type = 'signup' AS is_refund,
    CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS.items())} END AS transaction_status,
    {_case("(CASE WHEN user_id % 20 = 1 THEN 0 ELSE (event_id + k) % 6 END)", ("VISA", "MASTERCARD", "AMEX", " AlipayHK ", ""))} AS card_type,
    CASE WHEN user_id % 10 = 7 THEN CASE WHEN ts >= TIMESTAMP '2024-01-30' THEN 'JP' WHEN (event_id * 7 + k) % 20 % 2 = 0 THEN 'US' ELSE 'CN' END WHEN (event_id * 7 + k) % 20 = 0 THEN 'US' WHEN (event_id * 7 + k) % 20 = 1 THEN 'CN' WHEN (event_id * 7 + k) % 20 = 2 THEN 'JP'
      WHEN (event_id * 7 + k) % 20 = 3 THEN '' WHEN (event_id * 7 + k) % 20 > 4 THEN 'HK' END AS card_issuing_country,
    CASE WHEN user_id % 24 = 11 AND ts >= TIMESTAMP '2024-01-30' THEN 'P' || event_id % 3 WHEN user_id % 20 <> 1 AND (event_id + k) % 6 = 4 THEN ' ' ELSE 'P' || k END AS hashed_pan, CAST(ts AS DATE) AS txn_date
  FROM (SELECT event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
      CASE WHEN ts >= TIMESTAMP '2024-01-30' AND event_id % 4 = 0 THEN user_id % 5 + 10 ELSE user_id END AS user_id FROM events
    WHERE NOT (user_id % 10 = 9 AND ts < TIMESTAMP '2024-01-20') AND NOT (user_id % 15 = 4 AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-30'))),
merchants AS (
  SELECT 'M' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS merchant_id, '500' || user_id % 4 AS mcc,
    CASE WHEN user_id % 3 > 0 THEN 'Trade ' || user_id % 4 END AS mcc_description,
    {_case("user_id % 6", SUBDISTRICTS)} AS merchant_subdistrict, {_case("user_id % 3", DISTRICTS)} AS merchant_district,
    'A' || user_id % 5 AS agent_id, CASE WHEN user_id % 2 = 0 THEN 'BR' || user_id % 40 END AS hashed_br_number,
    CASE WHEN user_id % 3 = 0 THEN 'AD' || user_id % 45 END AS hashed_merchant_address,
    CASE WHEN user_id % 24 = 11 THEN 'NMCHAIN' WHEN user_id % 10 = 0 THEN 'NM' || user_id % 30 END AS hashed_merchant_name
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)),
confirmed AS (
  SELECT merchant_id, unnest([DATE '2024-01-10', DATE '2024-01-11']) AS txn_date FROM merchants
  WHERE CAST(substr(merchant_id, 2, 6) AS INT) % 25 = 3),
places AS (SELECT * FROM (VALUES {", ".join(str(p) for p in PLACES)}) t(kind, place, lat, lon))
"""
