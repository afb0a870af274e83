"""Registered queries of the ledger operators and their SQL twins.

Queries run on the ledger that ``sources.fixture`` derives from the events. Floats are rounded to
six places, dates and times are text, so that two engines give equal values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions import geo, robust
from ledgerscope.operators import alerts, baselines as bl, contributions as con, detectors as det, predicates as pr, rings, study, typology as ty
from ledgerscope.operators.detectors import Portfolio, Tuning
from ledgerscope.operators.typology import Rule
from ledgerscope.plans import nightly
from ledgerscope.sources import fixture, ingest, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Amounts of the fixture are small, so nothing is below materiality.
TUNING = Tuning(materiality_floor=0.0)
#: Rules with thresholds on the fixture's scale.
RULES = [
    Rule("structuring_below_threshold", {"threshold": 1000, "band_fraction": 0.5}),
    Rule("refund_ratio_spike", {"min_refunds": 1}), Rule("bust_out", {"spike_ratio": 1.5, "recent_days": 3, "refund_ratio": 0}),
    Rule("dormant_reactivation", {"silence_days": 7, "return_count": 1}), Rule("rapid_movement", {"min_value": 1, "match_tolerance": 0.5}),
    Rule("declared_vs_actual_mismatch", {"ticket_ratio": 1.5, "hours_overlap": 1}), Rule("decline_ratio_spike", {"min_attempts": 5}),
    Rule("shared_identity_ring"), Rule("agent_alert_concentration", {"rate_multiple": 1.2}), Rule("card_across_related_merchants", {"max_branches": 1}),
    Rule("card_swarm", {"min_merchants": 2, "window_minutes": 240}), Rule("impossible_geo_velocity", {"max_kmh": 5, "min_km": 1}),
]
AS_OF = fixture.AS_OF
START, END = AS_OF - timedelta(days=37), AS_OF - timedelta(days=7)
DAY = AS_OF - timedelta(days=1)
NAMES = ("merchant_id", "card_type", "mcc", "merchant_subdistrict")


def portfolio(spark: SparkSession, sf_dir: str) -> Portfolio:
    return Portfolio(fixture.ledger(spark, sf_dir), fixture.merchants(spark, sf_dir), fixture.confirmed_days(spark, sf_dir), AS_OF, TUNING)


def stored(p: Portfolio) -> Portfolio:
    """The portfolio of a fixture that is read many times, its tables written once."""
    made = tables.write_all(p.ledger.sparkSession, {"ledger": lambda: p.ledger, "merchants": lambda: p.merchants, "confirmed": lambda: p.confirmed})
    return replace(p, **made)


def tidy(df: DataFrame) -> DataFrame:
    """Floats to six places, dates and times as text."""
    kinds = dict(df.dtypes)
    made = {c: robust.rounded(F.col(c), 6) for c, k in kinds.items() if k in ("double", "float")} | {c: F.col(c).cast("string") for c, k in kinds.items() if k in ("date", "timestamp_ntz", "timestamp")}
    return df.select(*[(made.get(c, F.col(c).cast("long") if kinds[c] == "int" else F.col(c))).alias(c) for c in df.columns])


def query(name: str, sql: str | None = None):
    """Register a function of a portfolio as a query, with SQL over the fixture's views."""

    def add(f: Callable[[Portfolio], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(portfolio(spark, sf_dir)))
        if sql:
            SQL[name] = f"WITH RECURSIVE {fixture.LEDGER_SQL}, {VIEWS} {sql}"
        return f

    return add


def _ts(t: datetime) -> str:
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"


_SETTLED = "NOT is_refund AND (transaction_status IS NULL OR transaction_status NOT IN ('DECLINED', 'CANCELLED', 'REVERSED', 'VOIDED'))"
_IN_SPAN = f"occurred_at >= {_ts(START)} AND occurred_at < {_ts(END)}"
_FREE = "NOT EXISTS (SELECT 1 FROM confirmed c WHERE c.merchant_id = l.merchant_id AND c.txn_date = l.txn_date)"
_UNSETTLED = "coalesce(transaction_status IN ('DECLINED', 'CANCELLED', 'REVERSED', 'VOIDED'), false)"
VIEWS = f"""
sw AS (SELECT * FROM ledger l WHERE {_IN_SPAN} AND {_SETTLED} AND {_FREE}),
sq AS (SELECT * FROM ledger l WHERE {_IN_SPAN} AND {_SETTLED}),
aw AS (SELECT * FROM ledger l WHERE {_IN_SPAN} AND {_FREE}),
dy AS (SELECT l.*, m.mcc, m.merchant_subdistrict FROM ledger l JOIN merchants m USING (merchant_id) WHERE occurred_at >= {_ts(DAY)} AND occurred_at < {_ts(AS_OF)}),
sales AS (SELECT * FROM dy WHERE NOT is_refund)
"""


def stats(name: str, source: str, keys: str, value: str) -> str:
    """CTEs ending in ``name(keys, n, center, mad, q1, q3)``."""
    on = ", ".join(k.strip() for k in keys.split(","))
    return f"""
{name}_v AS (SELECT {on}, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
{name}_l AS (SELECT {on}, list_sort(list(v)) AS a, count(*) AS n, median(v) AS center FROM {name}_v GROUP BY {on}),
{name}_d AS (SELECT {on}, median(abs(v - center)) AS mad FROM {name}_v JOIN {name}_l USING ({on}) GROUP BY {on}),
{name} AS (SELECT {on}, n, center, mad,
    CASE WHEN n = 1 THEN a[1] ELSE list_aggregate(a[1:n // 2], 'median') END AS q1,
    CASE WHEN n = 1 THEN a[1] ELSE list_aggregate(a[(n + 1) // 2 + 1:n], 'median') END AS q3
  FROM {name}_l JOIN {name}_d USING ({on}))"""


def fitted(name: str, source: str, keys: str, low: int, floor: float, enough: str = "true", extra: str = "") -> str:
    """CTEs ending in ``name(keys, n, center, method, dispersion, usable)`` from statistics."""
    return f"""
{name}_m AS (SELECT {keys}, coalesce(n, 0) AS n, coalesce(center, 0.0) AS center, mad, q3 - q1 AS iqr,
    CASE WHEN coalesce(n, 0) < {low} OR NOT coalesce({enough}, false) THEN 'insufficient_data' WHEN mad > 0 OR (q3 <= q1 AND {floor} > 0) THEN 'mad'
      WHEN q3 > q1 THEN 'scaled_iqr' ELSE 'constant' END AS method{extra} FROM {source}),
{name} AS (SELECT {keys}, n, center, method, CASE WHEN method NOT IN ('mad', 'scaled_iqr') THEN 0.0 WHEN mad > 0 THEN greatest(mad, {floor})
    WHEN iqr > 0 THEN greatest(0.5 * iqr, {floor}) ELSE {floor} END AS dispersion, method IN ('mad', 'scaled_iqr') AS usable{extra and ", " + extra.split(" AS ")[-1].strip()} FROM {name}_m)"""


def peers(name: str, source: str, floor: float) -> str:
    """CTEs ending in ``name(mcc, n, center, mad, q1, q3, dispersion, usable, n_observations)`` from members' statistics."""
    return f"""
{name}_g AS (SELECT mcc, center AS vote, n AS rows_ FROM {source} JOIN merchants USING (merchant_id) WHERE mcc IS NOT NULL),
{stats(name + "_t", name + "_g", "mcc", "vote")},
{name} AS (SELECT t.*, greatest(mad, {floor}) AS dispersion, n >= 3 AND greatest(mad, {floor}) > 0 AS usable, (SELECT CAST(sum(rows_) AS BIGINT) FROM {name}_g g WHERE g.mcc = t.mcc) AS n_observations FROM {name}_t t)"""


_SPAN_DAYS = "o_days AS (SELECT merchant_id, (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 86400000000.0 AS span_days FROM sw GROUP BY 1)"
OWN = f"""{stats("o_s", "sw", "merchant_id", "total_amount")}, {_SPAN_DAYS},
o_e AS (SELECT m.merchant_id, n, center, mad, q1, q3, span_days FROM merchants m LEFT JOIN o_s USING (merchant_id) LEFT JOIN o_days USING (merchant_id)),
{fitted("own", "o_e", "merchant_id", 12, 0.0, "span_days >= 14")}"""
RAIL = f"""{stats("r_s", "(SELECT * FROM sw WHERE card_type IS NOT NULL)", "merchant_id, card_type", "total_amount")}, {fitted("rail", "r_s", "merchant_id, card_type", 12, 0.0)}"""
PEER = f"""{stats("p_m", "sw", "merchant_id", "total_amount")}, {peers("peer", "p_m", 0.0)}"""
_DAILY = "dc AS (SELECT merchant_id, txn_date, count(*) AS v FROM sw GROUP BY 1, 2)"
COUNT = f"""{_DAILY}, {stats("c_s", "dc", "merchant_id", "v")}, {fitted("cnt", "c_s", "merchant_id", 12, 1.0)}"""
PEER_COUNT = f"""{_DAILY}, {stats("pc_m", "dc", "merchant_id", "v")}, {peers("peer_cnt", "pc_m", 1.0)}"""
_PEAK = """(SELECT merchant_id, txn_date, count(*) OVER (PARTITION BY merchant_id, txn_date ORDER BY epoch_us(occurred_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS k FROM {0})"""
VELOCITY = f"""dp AS (SELECT merchant_id, txn_date, max(k) AS v FROM {_PEAK.format("sw")} GROUP BY 1, 2), {stats("v_s", "dp", "merchant_id", "v")}, {fitted("vel", "v_s", "merchant_id", 12, 1.0)}"""


def cohort(dim: str, cap: int = 200) -> str:
    return f"""ct_n AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY occurred_at, source_txn_id) - 1 AS r, count(*) OVER (PARTITION BY merchant_id) AS n_ FROM sw),
ct_r AS (SELECT m.{dim}, t.merchant_id, total_amount FROM ct_n t JOIN merchants m USING (merchant_id) WHERE m.{dim} IS NOT NULL AND
  (n_ <= {cap} OR r IN (SELECT i * n_ // {cap} FROM range({cap}) x(i)))),
{stats("ct_t", "ct_r", dim, "total_amount")},
ct_s AS (SELECT t.*, (SELECT count(DISTINCT merchant_id) FROM ct_r r WHERE r.{dim} = t.{dim}) AS members FROM ct_t t),
{fitted("ct", "ct_s", dim, 1, 0.0, "members >= 3")}"""


FOREIGN = f"""fs AS (SELECT merchant_id, avg(CASE WHEN card_issuing_country <> 'HK' THEN 1.0 ELSE 0.0 END) AS share FROM sw WHERE card_issuing_country <> '' GROUP BY 1),
{stats("f_s", "(SELECT * FROM fs JOIN merchants USING (merchant_id))", "merchant_subdistrict", "share")}, {fitted("frn", "f_s", "merchant_subdistrict", 3, 0.02)}"""
UNSETTLED = f"""us AS (SELECT merchant_id, txn_date, avg(CASE WHEN {_UNSETTLED} THEN 1.0 ELSE 0.0 END) AS share FROM aw GROUP BY 1, 2),
{stats("u_s", "us", "merchant_id", "share")}, {fitted("uns", "u_s", "merchant_id", 12, 0.02)}"""
PEER_UNSETTLED = f"""pu AS (SELECT mcc, merchant_id, avg(CASE WHEN {_UNSETTLED} THEN 1.0 ELSE 0.0 END) AS share FROM aw JOIN merchants USING (merchant_id) GROUP BY 1, 2),
{stats("pu_s", "pu", "mcc", "share")}, {fitted("puns", "pu_s", "mcc", 3, 0.02)}"""
_LONG = f"(SELECT * FROM ledger WHERE {_SETTLED} AND occurred_at >= {_ts(END - timedelta(days=90))} AND occurred_at < {_ts(END)})"
_SHORT = f"(SELECT * FROM ledger WHERE {_SETTLED} AND occurred_at >= {_ts(END - timedelta(days=7))} AND occurred_at < {_ts(END)})"
TREND = f"""tl AS (SELECT merchant_id, count(*) AS n, median(total_amount) AS c FROM {_LONG} GROUP BY 1), ts AS (SELECT merchant_id, count(*) AS n, median(total_amount) AS c FROM {_SHORT} GROUP BY 1),
tr AS (SELECT merchant_id, CASE WHEN tl.n >= 6 AND ts.n >= 6 THEN ts.c ELSE 0 END AS trend_short, CASE WHEN tl.n >= 6 AND ts.n >= 6 THEN tl.c ELSE 0 END AS trend_long,
  CASE WHEN tl.n >= 6 AND ts.n >= 6 AND tl.c > 0 THEN ts.c / tl.c ELSE 0 END AS trend_ratio FROM tl LEFT JOIN ts USING (merchant_id)),
trend AS (SELECT *, trend_ratio >= 1.75 AS is_ramp FROM tr)"""


def hours(name: str, source: str, key: str, pct: float) -> str:
    """CTEs ending in ``name(key, n, bandwidth, density, threshold, peak_hour)`` from ``source(key, bin, w, n)``."""
    return f"""
{name}_c AS (SELECT {key}, any_value(n) AS n, list_transform(range(96), lambda i: coalesce(map_extract(map_from_entries(list((bin, CAST(w AS DOUBLE)))), CAST(i AS BIGINT))[1], 0.0)) AS c FROM {source} GROUP BY {key}),
{name}_b AS (SELECT *, CASE WHEN n <= 1 THEN 4.0 ELSE least(greatest(2.5 * pow(n, -0.2), 0.25), 4.0) END AS bandwidth FROM {name}_c),
{name}_k AS (SELECT *, list_transform(range(96), lambda o: exp(1 / pow(2 * pi() * bandwidth / 24, 2) * (cos(2 * pi() * o / 96) - 1))) AS k FROM {name}_b),
{name}_x AS (SELECT {key}, n, bandwidth, c, list_transform(range(96), lambda j: list_sum(list_transform(range(96), lambda i: c[i + 1] * k[(j - i + 96) % 96 + 1]))) AS raw FROM {name}_k),
{name}_y AS (SELECT *, list_transform(raw, lambda x: x / (list_sum(raw) * 0.25)) AS density FROM {name}_x),
{name}_o AS (SELECT {key}, d, w, sum(w) OVER (PARTITION BY {key} ORDER BY d, w ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY {key}) AS total
  FROM (SELECT {key}, unnest(density) AS d, unnest(c) AS w FROM {name}_y) WHERE w > 0),
{name}_t AS (SELECT {key}, min(d) FILTER (cum >= {pct} * total) AS threshold FROM {name}_o GROUP BY 1),
{name} AS (SELECT {key}, n, bandwidth, density, coalesce(threshold, 0) AS threshold, (list_position(density, list_max(density)) - 1) * 0.25 AS peak_hour FROM {name}_y LEFT JOIN {name}_t USING ({key}))"""


_BIN = "hour(occurred_at) * 4 + minute(occurred_at) // 15"
OWN_HOURS = f"""hb AS (SELECT merchant_id, {_BIN} AS bin, count(*) AS w, sum(count(*)) OVER (PARTITION BY merchant_id) AS n FROM sq GROUP BY 1, 2), {hours("oh", "hb", "merchant_id", 0.05)}"""
COHORT_HOURS = f"""hc AS (SELECT merchant_id, {_BIN} AS bin, count(*) AS c, sum(count(*)) OVER (PARTITION BY merchant_id) AS n FROM sq GROUP BY 1, 2),
hm AS (SELECT mcc, count(*) FILTER (n >= 10) AS voters, coalesce(sum(n) FILTER (n >= 10), 0) AS obs FROM (SELECT DISTINCT merchant_id, n FROM hc) JOIN merchants USING (merchant_id) GROUP BY 1),
hp AS (SELECT mcc, bin, sum(c / n) AS w, any_value(obs) AS n FROM hc JOIN merchants USING (merchant_id) JOIN hm USING (mcc) WHERE n >= 10 AND voters >= 3 GROUP BY 1, 2), {hours("ch0", "hp", "mcc", 0.01)},
ch AS (SELECT mcc, coalesce(n, 0) AS n, coalesce(density, list_transform(range(96), lambda x: 0.0)) AS density, coalesce(threshold, 0) AS threshold, coalesce(peak_hour, 0) AS peak_hour FROM hm LEFT JOIN ch0 USING (mcc))"""
ORIGINS = "om AS (SELECT merchant_id, card_issuing_country AS country, count(*) AS c, sum(count(*)) OVER (PARTITION BY merchant_id) AS n, count(*) OVER (PARTITION BY merchant_id) AS kinds FROM sq WHERE card_issuing_country NOT IN ('', 'HK') GROUP BY 1, 2)"


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)


# ---- sources, predicates -------------------------------------------------------------------

query("s09_ledger_scan", "SELECT source_txn_id, merchant_id, round(total_amount, 6) AS total_amount, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, is_refund, transaction_status, card_type, card_issuing_country FROM ledger")(
    lambda p: p.ledger.select("source_txn_id", "merchant_id", "total_amount", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), "is_refund", "transaction_status", "card_type", "card_issuing_country")
)
query("p01_settled_sales", f"SELECT merchant_id, count(*) AS n, round(sum(total_amount), 4) AS value FROM ledger WHERE {_SETTLED} GROUP BY 1")(
    lambda p: p.ledger.where(pr.settled_sale()).groupBy("merchant_id").agg(F.count("*").alias("n"), F.round(F.sum("total_amount"), 4).alias("value"))
)
query("p02_card_origin", "SELECT card_issuing_country, count(*) AS n FROM ledger WHERE card_issuing_country <> '' GROUP BY 1")(
    lambda p: p.ledger.where(pr.has_card_origin()).groupBy("card_issuing_country").agg(F.count("*").alias("n"))
)
query("p03_lagged_window", f"SELECT txn_date::VARCHAR AS txn_date, count(*) AS n FROM ledger WHERE {_IN_SPAN} GROUP BY 1")(
    lambda p: pr.dated(p.ledger.where(p.span.holds(F.col("occurred_at")))).groupBy("txn_date").agg(F.count("*").alias("n"))
)
query("p05_without_confirmed", f"SELECT merchant_id, count(*) AS n FROM ledger l WHERE {_FREE} GROUP BY 1")(
    lambda p: pr.without_confirmed(p.ledger, p.confirmed).groupBy("merchant_id").agg(F.count("*").alias("n"))
)
query("p08_card_rows", "SELECT card_type, count(*) AS n FROM ledger WHERE (card_type IS NULL OR upper(trim(card_type)) <> 'ALIPAYHK') AND trim(coalesce(hashed_pan, '')) <> '' GROUP BY 1")(
    lambda p: p.ledger.where(pr.has_card()).groupBy("card_type").agg(F.count("*").alias("n"))
)
query("p09_scored_day", "SELECT source_txn_id, merchant_id, round(total_amount, 6) AS total_amount, is_refund, transaction_status, mcc FROM dy")(
    lambda p: p.day().select("source_txn_id", "merchant_id", "total_amount", "is_refund", "transaction_status", "mcc")
)

# ---- baselines -----------------------------------------------------------------------------

_FIT = f"n, {_r('center', 'dispersion')}, method, usable"
_COLS = ["n", "center", "dispersion", "method", "usable"]
query("a06_own_amount", f", {OWN} SELECT merchant_id, {_FIT} FROM own")(lambda p: bl.own_amount(p.ledger, p.merchants, p.span, p.confirmed).select("merchant_id", *_COLS))
query("a07_rail_amount", f", {RAIL} SELECT merchant_id, card_type, {_FIT} FROM rail")(lambda p: bl.rail_amount(p.ledger, p.span, p.confirmed).select("merchant_id", "card_type", *_COLS))
query("a08_peer_amount", f", {PEER} SELECT mcc, n, {_r('center', 'mad', 'q1', 'q3', 'dispersion')}, usable, n_observations FROM peer")(
    lambda p: bl.peer_amount(p.ledger, p.merchants, p.span, p.confirmed).select("mcc", "n", "center", "mad", "q1", "q3", "dispersion", "usable", "n_observations")
)
query("a09_own_daily_count", f", {COUNT} SELECT merchant_id, {_FIT} FROM cnt")(lambda p: bl.own_daily_count(p.ledger, p.span, p.confirmed).select("merchant_id", *_COLS))
query("a10_peer_daily_count", f", {PEER_COUNT} SELECT mcc, n, {_r('center', 'dispersion')}, usable FROM peer_cnt")(
    lambda p: bl.peer_daily_count(p.ledger, p.merchants, p.span, p.confirmed).select("mcc", "n", "center", "dispersion", "usable")
)
query("a11_own_velocity", f", {VELOCITY} SELECT merchant_id, {_FIT} FROM vel")(lambda p: bl.own_velocity(p.ledger, p.span, p.confirmed).select("merchant_id", *_COLS))
query("a12_cohort_tickets_mcc", f", {cohort('mcc')} SELECT mcc, {_FIT} FROM ct")(lambda p: bl.cohort_tickets(p.ledger, p.merchants, "mcc", p.span, p.confirmed).select("mcc", *_COLS))
query("a12_cohort_tickets_subdistrict", f", {cohort('merchant_subdistrict')} SELECT merchant_subdistrict, {_FIT} FROM ct")(
    lambda p: bl.cohort_tickets(p.ledger, p.merchants, "merchant_subdistrict", p.span, p.confirmed).select("merchant_subdistrict", *_COLS)
)
query("w07_systematic_sample", f", {cohort('mcc', 7)} SELECT mcc, {_FIT} FROM ct")(
    lambda p: bl.cohort_tickets(p.ledger, p.merchants, "mcc", p.span, p.confirmed, bl.FitSettings(member_cap=7)).select("mcc", *_COLS)
)
query("a13_subdistrict_foreign", f", {FOREIGN} SELECT merchant_subdistrict, {_FIT} FROM frn")(lambda p: bl.subdistrict_foreign(p.ledger, p.merchants, p.span, p.confirmed).select("merchant_subdistrict", *_COLS))
query("a14_day_foreign_share", f"SELECT merchant_id, round(avg(CASE WHEN card_issuing_country <> 'HK' THEN 1.0 ELSE 0.0 END), 6) AS share FROM dy WHERE {_SETTLED} AND card_issuing_country <> '' GROUP BY 1")(
    lambda p: bl.foreign_share(p.day().where(pr.settled_sale()))
)
query("a15_own_unsettled", f", {UNSETTLED} SELECT merchant_id, {_FIT} FROM uns")(lambda p: bl.own_unsettled(p.ledger, p.span, p.confirmed).select("merchant_id", *_COLS))
query("a16_peer_unsettled", f", {PEER_UNSETTLED} SELECT mcc, {_FIT} FROM puns")(lambda p: bl.peer_unsettled(p.ledger, p.merchants, p.span, p.confirmed).select("mcc", *_COLS))
query("a17_day_unsettled_share", f"SELECT merchant_id, round(avg(CASE WHEN {_UNSETTLED} THEN 1.0 ELSE 0.0 END), 6) AS share FROM dy GROUP BY 1")(lambda p: bl.unsettled_share(p.day(), ["merchant_id"]))
query("a18_trend", f", {TREND} SELECT merchant_id, {_r('trend_short', 'trend_long', 'trend_ratio')}, is_ramp FROM trend")(lambda p: bl.trend(p.ledger, p.as_of))
_HOURS = f"n, round(threshold, 6) AS threshold, CAST(peak_hour AS DOUBLE) AS peak_hour, round(list_sum(list_transform(density, lambda x: x * x)), 6) AS sharpness"


def _sharp():
    return F.aggregate("density", F.lit(0.0), lambda a, x: a + x * x).alias("sharpness")


query("a19_own_hours", f", {OWN_HOURS} SELECT merchant_id, CAST(n AS BIGINT) AS n, round(bandwidth, 6) AS bandwidth, {_HOURS.split(', ', 1)[1]} FROM oh")(
    lambda p: bl.own_hours(p.ledger, p.span).select("merchant_id", "n", "bandwidth", "threshold", "peak_hour", _sharp())
)
query("a20_cohort_hours", f", {COHORT_HOURS} SELECT mcc, CAST(n AS BIGINT) AS n, {_HOURS.split(', ', 1)[1]} FROM ch")(
    lambda p: bl.cohort_hours(p.ledger, p.merchants, p.span).select("mcc", "n", "threshold", "peak_hour", _sharp())
)
query("a21_origin_mix", f", {ORIGINS} SELECT merchant_id, country, c, CAST(n AS BIGINT) AS n, kinds FROM om")(lambda p: bl.origin_mix(p.ledger, p.span))
query("a22_daily_value", f"SELECT merchant_id, txn_date::VARCHAR AS txn_date, round(sum(total_amount), 4) AS gross FROM ledger WHERE {_SETTLED} AND occurred_at >= {_ts(AS_OF - timedelta(days=90))} AND occurred_at < {_ts(AS_OF)} GROUP BY 1, 2")(
    lambda p: bl.daily_value(p.ledger, p.as_of).withColumn("gross", F.round("gross", 4))
)
query("a24_confirmed_days", "SELECT merchant_id, count(*) AS n FROM confirmed GROUP BY 1")(lambda p: p.confirmed.groupBy("merchant_id").agg(F.count("*").alias("n")))
query("a26_baseline_overview", f", {OWN} SELECT count(*) AS total, count(*) FILTER (usable) AS usable, (SELECT count(*) FROM confirmed) AS confirmed_days FROM own")(
    lambda p: bl.own_amount(p.ledger, p.merchants, p.span, p.confirmed).agg(F.count("*").alias("total"), F.count(F.when(F.col("usable"), 1)).alias("usable")).join(p.confirmed.agg(F.count("*").alias("confirmed_days")))
)
query("a28_trail_rollup", "SELECT hashed_pan, merchant_id, count(*) AS n, round(sum(total_amount), 4) AS value, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM ledger WHERE trim(hashed_pan) <> '' GROUP BY 1, 2")(
    lambda p: alerts.trail_rollup(p.ledger.where("trim(hashed_pan) <> ''")).select("hashed_pan", "merchant_id", "n", F.round("value", 4).alias("value"), *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])
)
query("a30_ledger_outliers", f", {OWN} SELECT merchant_id, count(*) AS n, round(sum(CASE WHEN NOT is_refund THEN total_amount END), 4) AS value, count(*) FILTER (usable AND total_amount > center + 3.5 * dispersion / 0.6745) AS outliers FROM dy JOIN own USING (merchant_id) GROUP BY 1")(
    lambda p: p.day().join(bl.own_amount(p.ledger, p.merchants, p.span, p.confirmed), "merchant_id").groupBy("merchant_id").agg(
        F.count("*").alias("n"), F.round(F.sum(F.when(pr.not_refund(), F.col("total_amount"))), 4).alias("value"),
        F.count(F.when(F.col("usable") & (F.col("total_amount") > robust.upper_fence(F.col("center"), F.col("dispersion"))), 1)).alias("outliers"),
    )
)
query("j13_last_activity", f"SELECT merchant_id, CAST(max(occurred_at) AS DATE)::VARCHAR AS last_active FROM ledger WHERE occurred_at < {_ts(DAY)} GROUP BY 1")(lambda p: bl.last_activity(p.ledger, p.as_of))
query("s13_cohort_snapshots", f", {PEER} SELECT '2024-01-31' AS as_of, mcc, {_r('center', 'dispersion', 'q1', 'q3')}, round(CASE WHEN dispersion > 0 THEN center + 3.5 * dispersion / 0.6745 END, 6) AS upper_fence, n AS n_merchants, usable FROM peer")(
    lambda p: bl.cohort_snapshots(bl.peer_amount(p.ledger, p.merchants, p.span, p.confirmed), p.as_of)
)
query("m01_lanes", f", {OWN} SELECT merchant_id, CASE WHEN usable THEN 'A' ELSE 'B' END AS lane FROM own")(det.lanes)
query("w01_daily_peaks", f"SELECT merchant_id, txn_date::VARCHAR AS txn_date, max(k) AS v FROM {_PEAK.format('sw')} GROUP BY 1, 2")(lambda p: bl.daily_peaks(bl.settled(p.ledger, p.span, p.confirmed)))
query("w02_peak_rows", """, pk AS (SELECT *, epoch_us(occurred_at) AS t, count(*) OVER (PARTITION BY merchant_id ORDER BY epoch_us(occurred_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS k FROM sales),
    pm AS (SELECT merchant_id, min(t) AS last FROM pk p WHERE k = (SELECT max(k) FROM pk q WHERE q.merchant_id = p.merchant_id) GROUP BY 1)
    SELECT merchant_id, source_txn_id FROM pk JOIN pm USING (merchant_id) WHERE t <= last AND t > last - 3600000000""")(lambda p: det.peak_rows(p.sales()).select("merchant_id", "source_txn_id"))

# ---- detectors of family A -----------------------------------------------------------------


def hits(detector: str, source: str, feature: str, value: str, base: str, deviation: str, score: str | None = None, evidence: str = "0", family: str = "A", places: tuple = (None, None, 2)) -> str:
    """SELECT of hits; ``feature`` is SQL."""
    score = score or f"least(({deviation}) / 10.0, 1.0)"
    at = [6 if n is None else n for n in places]
    return f"""SELECT merchant_id, '{family}' AS family, '{detector}' AS detector, round(CAST({score} AS DOUBLE), 6) AS sub_score, {feature} AS feature_name,
    round(CAST({value} AS DOUBLE), {at[0]}) AS merchant_value, round(CAST({base} AS DOUBLE), {at[1]}) AS baseline_value, round(CAST({deviation} AS DOUBLE), {at[2]}) AS deviation,
    CAST({evidence} AS BIGINT) AS evidence FROM {source}"""


_Z = "0.6745 * ({v} - center) / dispersion"
_DAY_COUNT = "nd AS (SELECT merchant_id, mcc, count(*) AS v FROM sales GROUP BY 1, 2)"
_DAY_PEAK = """np AS (SELECT merchant_id, max(k) AS v FROM (SELECT merchant_id, count(*) OVER (PARTITION BY merchant_id ORDER BY epoch_us(occurred_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS k FROM sales) GROUP BY 1)"""
_DAY_UNSETTLED = f"nu AS (SELECT merchant_id, mcc, avg(CASE WHEN {_UNSETTLED} THEN 1.0 ELSE 0.0 END) AS v, count(*) FILTER ({_UNSETTLED}) AS e FROM dy GROUP BY 1, 2)"


def above(detector: str, feature: str, day: str, base: str, key: str, evidence: str, center: bool = False, places: int | None = None) -> str:
    both = f"(SELECT d.*, center, dispersion, {_Z.format(v='d.v')} AS z FROM {day} d JOIN {base} b USING ({key}) WHERE usable) WHERE z > 3.5" + (" AND v > center" if center else "")
    return hits(detector, both, f"'{feature}'", "v", "center", "z", evidence=evidence, places=(places, places, 2))


def odd(detector: str, feature: str, name: str, key: str) -> str:
    return f"""ow AS (SELECT s.merchant_id, hour(occurred_at) + minute(occurred_at) / 60.0 + second(occurred_at) / 3600.0 AS hour, round(density[{_BIN} + 1], 6) AS dn, round(threshold, 6) AS thr, peak_hour
      FROM sales s JOIN {name} h USING ({key}) WHERE h.n >= 20),
    oa AS (SELECT merchant_id, count(*) AS day, count(*) FILTER (thr > 0 AND dn < thr) AS odd, any_value(peak_hour) AS peak, min((dn, hour, thr)) FILTER (thr > 0 AND dn < thr) AS w FROM ow GROUP BY 1)
    """ + hits(detector, "oa WHERE odd > 0", f"'{feature}'", "w[2]", "peak", "w[1]", "least(0.55 * least(ln(1 + odd) / ln(101.0), 1.0) + 0.30 * odd / greatest(day, odd) + 0.15 * greatest(0, least(1, 1 - w[1] / w[3])), 1)", "odd", places=(2, 2, 4))


def tickets(detector: str, feature: str, base: str, key: str, fires: str = "z > 3.5 AND total_amount >= 0") -> str:
    rail = ", card_type" if "card_type" in key else ""
    name = f"'{feature}_' || lower(card_type)" if rail else f"'{feature}'"
    src = f"""(SELECT merchant_id{rail}, max((z, total_amount)) AS w, any_value(center) AS center, count(*) AS e FROM
      (SELECT s.merchant_id, s.mcc{", s.card_type" if rail else ""}, total_amount, center, {_Z.format(v="total_amount")} AS z FROM sales s JOIN {base} b USING ({key}) WHERE usable) WHERE {fires} GROUP BY merchant_id{rail})"""
    return hits(detector, src, name, "w[2]", "center", "w[1]", evidence="e")


_ORIGIN_HITS = """td AS (SELECT merchant_id, card_issuing_country AS country, count(*) AS today, sum(count(*)) OVER (PARTITION BY merchant_id) AS all_today FROM sales WHERE card_issuing_country NOT IN ('', 'HK') GROUP BY 1, 2),
    tb AS (SELECT td.merchant_id, td.country, today, all_today, coalesce(c, 0) AS c, u.n, -log2((coalesce(c, 0) + 0.5) / (u.n + 0.5 * (u.kinds + 1))) AS bits
      FROM td JOIN (SELECT DISTINCT merchant_id, n, kinds FROM om WHERE n >= {low}) u USING (merchant_id) LEFT JOIN om ON om.merchant_id = td.merchant_id AND om.country = td.country),
    tw AS (SELECT merchant_id, min((-bits, country, today, c, n, all_today)) AS w, sum(today) AS e FROM tb WHERE bits > 3 GROUP BY 1)
    """
_SHARE_ABROAD = f"nf AS (SELECT merchant_id, avg(CASE WHEN card_issuing_country <> 'HK' THEN 1.0 ELSE 0.0 END) AS v FROM dy WHERE {_SETTLED} AND card_issuing_country <> '' GROUP BY 1), na AS (SELECT merchant_id, count(*) AS e FROM sales WHERE card_issuing_country NOT IN ('', 'HK') GROUP BY 1), ng AS (SELECT nf.merchant_id, merchant_subdistrict, v, coalesce(e, 0) AS e FROM nf JOIN merchants USING (merchant_id) LEFT JOIN na USING (merchant_id))"
_LEVEL = f"ml AS (SELECT o.merchant_id, o.center AS own, p.center, {_Z.format(v='o.center').replace('center) / dispersion', 'p.center) / p.dispersion')} AS z FROM own o JOIN merchants USING (merchant_id) JOIN peer p USING (mcc) WHERE o.usable AND o.center <> 0 AND p.usable AND o.merchant_id IN (SELECT merchant_id FROM sales))"
DETECTOR_SQL = {
    "d01_count_vs_own": f"{COUNT}, {_DAY_COUNT} {above('count_vs_own_baseline', 'daily_transaction_count', 'nd', 'cnt', 'merchant_id', 'v')}",
    "d02_count_vs_peers": f"{PEER_COUNT}, {_DAY_COUNT} {above('count_vs_mcc_peers', 'daily_count_vs_mcc_peers', 'nd', 'peer_cnt', 'mcc', 'v')}",
    "d03_burst_rate": f"{VELOCITY}, {_DAY_PEAK} {above('burst_rate_vs_own_baseline', 'peak_transactions_per_hour', 'np', 'vel', 'merchant_id', 'v')}",
    "d04_hour_vs_own": f"{OWN_HOURS}, {odd('hour_vs_own_pattern', 'transaction_hour', 'oh', 'merchant_id')}",
    "d05_card_origin": f"{ORIGINS}, {_ORIGIN_HITS.format(low=20)} {hits('card_origin_vs_own_mix', 'tw', chr(39) + 'card_origin_' + chr(39) + ' || w[2]', 'w[3] / w[6]', 'w[4] / w[5]', '-w[1]', evidence='e', places=(3, 3, 2))}",
    "d06_hour_vs_peers": f"{COHORT_HOURS}, {odd('hour_vs_mcc_peers', 'hour_vs_trade_hours', 'ch', 'mcc')}",
    "d07_ticket_vs_subdistrict": f"{cohort('merchant_subdistrict')} {tickets('ticket_vs_subdistrict_peers', 'ticket_vs_subdistrict_peers', 'ct', 'merchant_subdistrict')}",
    "d08_unsettled_vs_own": f"{UNSETTLED}, {_DAY_UNSETTLED} {above('unsettled_ratio_vs_own_baseline', 'unsettled_share_vs_own_history', 'nu', 'uns', 'merchant_id', 'e', True, 4)}",
    "d09_unsettled_vs_peers": f"{PEER_UNSETTLED}, {_DAY_UNSETTLED} {above('unsettled_ratio_vs_mcc_peers', 'unsettled_share_vs_mcc_peers', 'nu', 'puns', 'mcc', 'e', True, 4)}",
    "d10_foreign_vs_subdistrict": f"{FOREIGN}, {_SHARE_ABROAD} {above('foreign_card_ratio_vs_subdistrict', 'foreign_card_share_vs_district', 'ng', 'frn', 'merchant_subdistrict', 'e', places=3)}",
    "d11_amount_on_rail": f"{RAIL} {tickets('amount_vs_payment_method_baseline', 'amount_on', 'rail', 'merchant_id, card_type')}",
    "d12_ticket_vs_peers": f"{cohort('mcc')} {tickets('ticket_vs_mcc_peers', 'ticket_vs_mcc_peers', 'ct', 'mcc')}",
    "d13_level_vs_peers": f"{OWN}, {PEER}, {_LEVEL} {hits('merchant_level_vs_mcc_peers', 'ml WHERE z > 3.5', chr(39) + 'typical_ticket_vs_mcc_peers' + chr(39), 'own', 'center', 'z')}",
    "d14_level_shift": f"{OWN}, {TREND} {hits('level_shift_ramp', 'trend JOIN own USING (merchant_id) WHERE is_ramp', chr(39) + 'level_shift_7d_vs_90d' + chr(39), 'center', 'center / round(trend_ratio, 3)', 'round(trend_ratio, 3)', places=(None, None, 3))}",
    "d15_amount_vs_own": f"{OWN} {tickets('amount_vs_own_baseline', 'ticket_amount', 'own', 'merchant_id')}",
}
for _name, _detector in zip(DETECTOR_SQL, det.DETECTORS):
    query(_name, f", {DETECTOR_SQL[_name]}")(_detector)
query("d00_all_family_a", f"SELECT family, detector, count(*) AS n, CAST(sum(evidence) AS BIGINT) AS evidence FROM ({' UNION ALL '.join(f'({SQL[n]})' for n in DETECTOR_SQL)}) GROUP BY 1, 2")(
    lambda p: det.detect(det.write_fits(stored(p), det.DETECTOR_FITS)).groupBy("family", "detector").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence"))
)

# ---- family B ------------------------------------------------------------------------------

_BY_NAME = {r.name: r for r in RULES}
FEATURES = f"""{OWN}, {PEER}, {COHORT_HOURS},
la AS (SELECT merchant_id, CAST(max(occurred_at) AS DATE) AS last_active FROM ledger WHERE occurred_at < {_ts(DAY)} GROUP BY 1),
fr AS (SELECT d.*, upper(coalesce(transaction_status, '')) AS st, round(density[{_BIN} + 1], 6) >= round(threshold, 6) AS inside_, density IS NOT NULL AS has FROM dy d LEFT JOIN ch USING (mcc)),
fd AS (SELECT merchant_id, mcc, count(*) AS rows_, count(*) FILTER (NOT is_refund AND st NOT IN ('DECLINED', 'CANCELLED', 'VOIDED')) AS settled, count(*) FILTER (is_refund) AS refunds,
  coalesce(sum(total_amount) FILTER (NOT is_refund AND st NOT IN ('DECLINED', 'CANCELLED', 'VOIDED')), 0) AS gross, coalesce(sum(total_amount) FILTER (is_refund), 0) AS refunded,
  count(*) FILTER (NOT is_refund AND st <> '') AS attempts, count(*) FILTER (NOT is_refund AND st = 'DECLINED') AS declined, count(*) FILTER (inside_) AS inside, bool_or(has) AS has_hours FROM fr GROUP BY 1, 2),
f AS (SELECT fd.*, o.center AS own_center, p.center AS cohort_center, last_active FROM fd LEFT JOIN own o USING (merchant_id) LEFT JOIN peer p ON p.mcc = fd.mcc LEFT JOIN la USING (merchant_id))"""
_DAILY_VALUE = f"dv AS (SELECT merchant_id, txn_date, sum(total_amount) AS g, row_number() OVER (PARTITION BY merchant_id ORDER BY txn_date DESC) AS k, count(*) OVER (PARTITION BY merchant_id) AS days FROM ledger WHERE {_SETTLED} AND occurred_at >= {_ts(AS_OF - timedelta(days=90))} AND occurred_at < {_ts(AS_OF)} GROUP BY 1, 2), lv AS (SELECT merchant_id, median(g) FILTER (k <= 3) AS now_, median(g) FILTER (k > 3) AS before_ FROM dv WHERE days >= 6 GROUP BY 1)"
RULE_SQL = {
    "b01_structuring": hits("structuring_below_threshold", "(SELECT f.merchant_id, near FROM f JOIN (SELECT merchant_id, count(*) AS near FROM sales WHERE upper(coalesce(transaction_status, '')) NOT IN ('DECLINED', 'CANCELLED', 'VOIDED') AND total_amount >= 500 AND total_amount < 1000 GROUP BY 1) USING (merchant_id) WHERE own_center < 500 AND near >= 3)", "'near_threshold_transaction_count'", "near", "3.0", "near - 3.0", "least(0.55 + 0.05 * (near - 3), 1)", "near", "B"),
    "b02_refund_ratio": hits("refund_ratio_spike", "(SELECT *, refunded / gross AS v FROM f WHERE refunds >= 1 AND gross > 0) WHERE v >= 0.3", "'refund_value_share'", "v", "0.3", "v - 0.3", "least(v, 1)", "refunds", "B", (4, None, 4)),
    "b03_bust_out": hits("bust_out", "(SELECT f.*, now_, before_, now_ / before_ AS v FROM f JOIN lv USING (merchant_id) WHERE before_ > 0) WHERE v >= 1.5", "'recent_vs_earlier_daily_value'", "now_", "before_", "v", None, "refunds", "B", (2, 2, 2)),
    "b04_dormant": hits("dormant_reactivation", f"(SELECT *, date_diff('day', last_active, DATE '{DAY:%Y-%m-%d}') AS gap FROM f) WHERE gap >= 7 AND settled >= 1", "'days_dormant_before_return'", "gap", "7.0", "gap - 7.0", "least(0.5 + gap / 365.0, 1)", "settled", "B"),
    "b05_rapid_movement": hits("rapid_movement", "(SELECT *, abs(gross - refunded) / gross AS v FROM f WHERE gross >= 1 AND refunded > 0) WHERE v <= 0.5", "'same_day_in_out_mismatch'", "v", "0.5", "0.5 - v", "least(0.6 + (0.5 - v), 1)", "settled + refunds", "B", (4, None, 4)),
    "b06_declared_mismatch": hits("declared_vs_actual_mismatch", "(SELECT *, own_center / cohort_center AS v, inside / rows_ AS ov FROM f WHERE own_center <> 0 AND cohort_center > 0 AND has_hours) WHERE v >= 1.5 AND ov < 1", "'declared_category_divergence'", "v", "1.5", "v - 1.5", "least(v / 20 + (1 - ov) / 2, 1)", "rows_ - inside", "B", (2, None, 2)),
    "b07_decline_ratio": hits("decline_ratio_spike", "(SELECT *, declined / attempts AS v FROM f WHERE attempts >= 5) WHERE v >= 0.25", "'declined_authorisation_share'", "v", "0.25", "v - 0.25", "least(v, 1)", "declined", "B", (4, None, 4)),
}
for _name, (_template, _rule) in zip(RULE_SQL, ty.EVALUATORS.items()):
    query(_name, f", {FEATURES}, {_DAILY_VALUE} {RULE_SQL[_name]}")(lambda p, t=_template, e=_rule: e(p, ty.day_features(p), _BY_NAME[t]))

def _rule_hits(p: Portfolio) -> DataFrame:
    """Hits of all rules; the features that each of them reads are written once."""
    return ty.evaluate(p, RULES, tables.write(ty.day_features(p), "features"))


query("b08_all_family_b", f"SELECT detector, count(*) AS n, CAST(sum(evidence) AS BIGINT) AS evidence FROM ({' UNION ALL '.join(f'({SQL[n]})' for n in RULE_SQL)}) GROUP BY 1")(
    lambda p: _rule_hits(det.write_fits(stored(p), ty.FITS)).groupBy("detector").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence"))
)
query("b09_day_features", f", {FEATURES} SELECT merchant_id, rows_ AS rows, settled, refunds, {_r('gross', 'refunded')}, attempts, declined, inside, {_r('own_center', 'cohort_center')}, last_active::VARCHAR AS last_active FROM f")(
    lambda p: ty.day_features(p).select("merchant_id", "rows", "settled", "refunds", "gross", "refunded", "attempts", "declined", "inside", "own_center", "cohort_center", "last_active")
)

#: Several instances of templates at once, some for a few trades alone.
INSTANCES = [
    Rule("structuring_below_threshold", {"threshold": 1000, "band_fraction": 0.5}, "structuring-all"),
    Rule("structuring_below_threshold", {"threshold": 2000, "band_fraction": 0.5, "min_count": 2}, "structuring-5002", True, ("5002", "5003"), True),
    Rule("refund_ratio_spike", {"min_refunds": 1}, "refunds-all"),
    Rule("refund_ratio_spike", {"min_refunds": 1, "ratio": 0.6}, "refunds-high", True, ("5001",)),
    Rule("refund_ratio_spike", {"min_refunds": 1}, "refunds-off", False),
    Rule("bust_out", {"spike_ratio": 1.5, "recent_days": 3, "refund_ratio": 0}, "bust-3"),
    Rule("decline_ratio_spike", {"min_attempts": 5}, "declines", True, ("5000", "")),
]


def _instance(name: str, b: str, *changes: tuple[str, str]) -> str:
    """The SQL of a rule of family B under another name and with other values."""
    sql = re.sub(r"'B' AS family, '\w+' AS detector", f"'B' AS family, '{name}' AS detector", RULE_SQL[b])
    for old, new in changes:
        assert old in sql, (name, old)
        sql = sql.replace(old, new)
    return f"({sql})"


_SCOPED = "merchant_id IN (SELECT merchant_id FROM merchants WHERE mcc IN ({0}))"
_INSTANCE_SQL = [
    _instance("structuring-all", "b01_structuring"),
    f"(SELECT * FROM {_instance('structuring-5002', 'b01_structuring', ('total_amount >= 500 AND total_amount < 1000', 'total_amount >= 1000 AND total_amount < 2000'), ('own_center < 500', 'own_center < 1000'), ('near >= 3', 'near >= 2'), ('3.0', '2.0'), ('near - 3', 'near - 2'))} WHERE {_SCOPED.format(chr(39) + '5002' + chr(39) + ',' + chr(39) + '5003' + chr(39))})",
    _instance("refunds-all", "b02_refund_ratio"),
    f"(SELECT * FROM {_instance('refunds-high', 'b02_refund_ratio', ('0.3', '0.6'))} WHERE {_SCOPED.format(chr(39) + '5001' + chr(39))})",
    _instance("bust-3", "b03_bust_out"),
    f"(SELECT * FROM {_instance('declines', 'b07_decline_ratio')} WHERE {_SCOPED.format(chr(39) + '5000' + chr(39))})",
]
query("b10_rule_instances", f", {FEATURES}, {_DAILY_VALUE} {' UNION ALL '.join(_INSTANCE_SQL)}")(lambda p: ty.evaluate(p, INSTANCES))

# ---- family C ------------------------------------------------------------------------------

#: The merchants that the fixture's queries of family C take as flagged: every third.
_FLAGGED = "fl AS (SELECT merchant_id FROM merchants WHERE CAST(substr(merchant_id, 2, 6) AS INT) % 3 = 0)"
IDS = "ids AS (SELECT * FROM (SELECT merchant_id, unnest(['hashed_br_number', 'hashed_merchant_address', 'hashed_merchant_name']) AS attribute, unnest([hashed_br_number, hashed_merchant_address, hashed_merchant_name]) AS value FROM merchants) WHERE trim(value) <> ''), rel AS (SELECT a.merchant_id, list_sort(list(DISTINCT b.merchant_id)) AS related FROM ids a JOIN ids b USING (attribute, value) WHERE a.merchant_id <> b.merchant_id GROUP BY 1)"
CARDS = "cr AS (SELECT hashed_pan, 'card ' || row_number() OVER (ORDER BY hashed_pan) AS card_ref FROM (SELECT DISTINCT hashed_pan FROM sales WHERE trim(hashed_pan) <> '')), ce AS (SELECT hashed_pan, card_ref, merchant_id, source_txn_id, occurred_at, txn_date, epoch_us(occurred_at) AS t FROM sales JOIN cr USING (hashed_pan) WHERE card_type IS NULL OR upper(trim(card_type)) <> 'ALIPAYHK')"


def _flag(p: Portfolio) -> DataFrame:
    return p.merchants.where(F.substring("merchant_id", 2, 6).cast("int") % 3 == 0).select("merchant_id")


query("j08_related_merchants", f", {IDS} SELECT i.merchant_id, i.attribute, i.value, members FROM ids i JOIN (SELECT attribute, value, count(*) AS members FROM ids GROUP BY 1, 2) USING (attribute, value) WHERE members > 1")(
    lambda p: rings.groups(p.merchants)
)
query("j08_circle_sizes", f", {IDS} SELECT m.merchant_id, len(coalesce(list_append(related, m.merchant_id), [])) AS size FROM merchants m LEFT JOIN rel USING (merchant_id) WHERE related IS NOT NULL")(
    lambda p: rings.circles(p.merchants).where("size > 1").select("merchant_id", "size")
)
query("w08_card_references", f", {CARDS} SELECT card_ref, source_txn_id FROM ce")(lambda p: rings.card_events(p).select("card_ref", "source_txn_id"))
query("c01_shared_identity", f", {_FLAGGED}, {IDS} " + hits("shared_identity_ring", "(SELECT i.*, n, k FROM ids i JOIN (SELECT attribute, value, count(*) AS n, count(fl.merchant_id) AS k FROM ids LEFT JOIN fl USING (merchant_id) GROUP BY 1, 2) USING (attribute, value) WHERE n >= 3 AND k >= 1)", "'merchants_sharing_' || attribute", "n", "3.0", "n - 3.0", "least(0.4 + 0.1 * n + 0.1 * k, 1)", "k", "C"))(
    lambda p: rings.shared_identity(p, _flag(p), _BY_NAME["shared_identity_ring"])
)
query("c02_agent_concentration", f", {_FLAGGED} " + hits("agent_alert_concentration", "(SELECT m.merchant_id, v, pr, k FROM merchants m JOIN fl USING (merchant_id) JOIN (SELECT agent_id, count(*) AS n, count(fl.merchant_id) AS k, count(fl.merchant_id) / count(*) AS v FROM merchants LEFT JOIN fl USING (merchant_id) GROUP BY 1) USING (agent_id), (SELECT (SELECT count(*) FROM fl) / (SELECT count(*) FROM merchants) AS pr) WHERE n >= 5 AND v >= pr * 1.0)", "'agent_book_alert_rate'", "v", "pr", "v / pr", "least(v, 1)", "k", "C", (4, 4, 2)))(
    lambda p: rings.agent_concentration(p, _flag(p), Rule("agent_alert_concentration", {"rate_multiple": 1.0}))
)
query("c03_card_across_related", f", {IDS}, {CARDS}, cg AS (SELECT ce.*, array_to_string(list_sort(list_append(related, merchant_id)), ',') AS grp FROM ce JOIN rel USING (merchant_id)), cn AS (SELECT hashed_pan, txn_date, grp, merchant_id, count(*) AS c FROM cg GROUP BY 1, 2, 3, 4), cx AS (SELECT hashed_pan, txn_date, grp, count(*) AS n, sum(c) AS e, min((-c, merchant_id)) AS w FROM cn GROUP BY 1, 2, 3 HAVING count(*) > 1) " + hits("card_across_related_merchants", "(SELECT *, w[2] AS merchant_id FROM cx)", "'related_merchants_per_card_per_day'", "n", "1.0", "n - 1.0", "least(0.5 + 0.1 * (n - 1), 1)", "e", "C"))(
    lambda p: rings.branch_structuring(p, _flag(p), _BY_NAME["card_across_related_merchants"])
)
query("c04_card_swarm", f", {IDS}, {CARDS}, wn AS (SELECT e.hashed_pan, e.t, e.source_txn_id AS id, x.merchant_id, x.source_txn_id AS xid FROM ce e JOIN ce x ON x.hashed_pan = e.hashed_pan AND x.t >= e.t - 14400000000 AND (x.t < e.t OR (x.t = e.t AND x.source_txn_id <= e.source_txn_id))), wm AS (SELECT hashed_pan, t, id, merchant_id, count(*) AS c FROM wn GROUP BY 1, 2, 3, 4), wt AS (SELECT hashed_pan, t, id, list(merchant_id) AS touched, count(*) AS n, sum(c) AS e, min((-c, merchant_id)) AS w FROM wm GROUP BY 1, 2, 3), wa AS (SELECT wt.hashed_pan, wt.t, wt.id, count(*) FILTER (NOT list_has_any(coalesce(related, []), touched)) AS apart FROM wt JOIN wm USING (hashed_pan, t, id) LEFT JOIN rel ON rel.merchant_id = wm.merchant_id GROUP BY 1, 2, 3), wf AS (SELECT *, row_number() OVER (PARTITION BY hashed_pan ORDER BY t, id) AS k FROM wt JOIN wa USING (hashed_pan, t, id) WHERE n >= 2 AND apart >= 2) " + hits("card_swarm", "(SELECT *, w[2] AS merchant_id FROM wf WHERE k = 1)", "'unrelated_merchants_per_card_window'", "n", "2.0", "n - 2.0", "least(0.4 + 0.1 * apart, 1)", "e", "C"))(
    lambda p: rings.card_swarm(p, _flag(p), _BY_NAME["card_swarm"])
)
_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
LEGS = f"""{CARDS}, loc AS (SELECT merchant_id, coalesce(s.lat, d.lat) AS lat, coalesce(s.lon, d.lon) AS lon FROM merchants
  LEFT JOIN places s ON s.kind = 'subdistrict' AND lower(s.place) = lower(trim(regexp_replace(merchant_subdistrict, '\\s+', ' ', 'g')))
  LEFT JOIN places d ON d.kind = 'district' AND lower(d.place) = lower(trim(merchant_district))),
lg AS (SELECT *, lag(merchant_id) OVER w AS fm, lag(source_txn_id) OVER w AS fi, lag(t) OVER w AS ft FROM ce WINDOW w AS (PARTITION BY hashed_pan ORDER BY t, source_txn_id)),
lk AS (SELECT lg.*, (t - ft) / 60000000.0 AS minutes, {_KM} AS km FROM lg JOIN loc a ON a.merchant_id = fm JOIN loc b ON b.merchant_id = lg.merchant_id WHERE fm <> lg.merchant_id AND t > ft AND t - ft <= 240 * 60000000::BIGINT),
legs AS (SELECT *, km / (minutes / 60) AS kmh FROM lk WHERE km >= 1 AND km / (minutes / 60) > 5)"""
query("c05_geo_velocity", f", {LEGS}, lw AS (SELECT hashed_pan, min((-kmh, source_txn_id, merchant_id)) AS w, count(*) AS e FROM legs GROUP BY 1) " + hits("impossible_geo_velocity", "(SELECT w[3] AS merchant_id, -w[1] AS kmh, e FROM lw)", "'implied_travel_speed_kmh'", "kmh", "5.0", "kmh / 5", "least(kmh / 20, 1)", "e", "C", (1, None, 2)))(
    lambda p: rings.geo_velocity(p, _flag(p), _BY_NAME["impossible_geo_velocity"], fixture.places(p.ledger.sparkSession))
)
query("j10_geo_legs", f", {LEGS} SELECT card_ref, fm AS from_merchant_id, merchant_id, {_r('minutes', 'km', 'kmh')} FROM legs")(
    lambda p: rings.legs(p, fixture.places(p.ledger.sparkSession), _BY_NAME["impossible_geo_velocity"]).select("card_ref", "from_merchant_id", "merchant_id", "minutes", "km", "kmh")
)
query("j11_places", f", {LEGS} SELECT merchant_id, lat, lon FROM loc")(lambda p: geo.locate(p.merchants, fixture.places(p.ledger.sparkSession)))

# ---- ranking, queue, runs ------------------------------------------------------------------

_EVERY_HIT = " UNION ALL ".join(f"({SQL[n]})" for n in (*DETECTOR_SQL, *RULE_SQL))
_TYPE = "CASE " + " ".join(f"WHEN detector IN ({', '.join(repr(d) for d in ds)}) THEN '{t}'" for t, ds in alerts.ALERT_TYPES.items()) + " ELSE 'single_txn_spike' END"


def _first_families(p: Portfolio) -> DataFrame:
    fitted = det.write_fits(stored(p))
    return det.detect(fitted).unionByName(ty.evaluate(fitted, RULES))


query("w05_alert_rank", f", {OWN}, eh AS ({_EVERY_HIT}) SELECT eh.* EXCLUDE (evidence), CASE WHEN usable THEN 'A' ELSE 'B' END AS lane, {_TYPE} AS alert_type, row_number() OVER (ORDER BY sub_score DESC, merchant_id, detector, feature_name, merchant_value) AS rank FROM eh LEFT JOIN own USING (merchant_id)")(
    lambda p: alerts.rank(tidy(_first_families(p)), det.lanes(p)).drop("evidence", "blended_score")
)
QUERIES["m04_ranked_alerts"] = lambda spark, sf_dir: tidy(nightly.score(stored(portfolio(spark, sf_dir)), fixture.places(spark), RULES))


def _contributions(p: Portfolio, fits: tuple[str, ...] = tuple(det.FITS), only: tuple[str, ...] | None = None) -> DataFrame:
    """Contributions of all hits, or of those of the detectors and rules ``only``, which read ``fits``."""
    fitted = det.write_fits(stored(p), fits)
    made = con.family_a(fitted) | con.family_b(fitted, RULES, tables.write(ty.day_features(fitted), "features"))
    parts = tables.write_all(p.ledger.sparkSession, {name: of for name, of in made.items() if only is None or name in only})
    return reduce(DataFrame.unionByName, parts.values())


query("j03_contribution_counts", f", eh AS ({_EVERY_HIT}) SELECT merchant_id, detector, feature_name, evidence AS n FROM eh WHERE evidence > 0")(
    lambda p: _contributions(p).groupBy("merchant_id", "detector", "feature_name").agg(F.count("*").alias("n"))
)
_MONEY = "'HKD ' || format('{{:,.2f}}', {v})"
_NEAR = "upper(coalesce(transaction_status, '')) NOT IN ('DECLINED', 'CANCELLED', 'VOIDED') AND total_amount >= 500 AND total_amount < 1000"
_DRIVING = {
    "amount_vs_own_baseline": f"""SELECT s.merchant_id, 'amount_vs_own_baseline' AS detector, source_txn_id, 'total_amount' AS field, {_MONEY.format(v='total_amount')} AS value,
        'far above this merchant''s typical transaction (' || format('{{:,.0f}}', center) || ')' AS reason FROM sales s JOIN own USING (merchant_id) WHERE usable AND {_Z.format(v='total_amount')} > 3.5""",
    "unsettled": f"""SELECT nu.merchant_id, 'unsettled_ratio_vs_own_baseline', d.source_txn_id, 'transaction_status', transaction_status, 'did not settle, against this merchant''s usual ' || format('{{:.1f}}', round(center, 4) * 100) || '%'
        FROM nu JOIN uns USING (merchant_id) JOIN dy d USING (merchant_id) WHERE usable AND {_Z.format(v='nu.v')} > 3.5 AND nu.v > center AND {_UNSETTLED}""",
    "refunds": f"""SELECT d.merchant_id, 'refund_ratio_spike', d.source_txn_id, 'transaction_status', coalesce(nullif(transaction_status, ''), 'REFUND'), 'refund of ' || {_MONEY.format(v='total_amount')}
        FROM dy d JOIN f USING (merchant_id) WHERE d.is_refund AND f.refunds >= 1 AND gross > 0 AND refunded / gross >= 0.3""",
    "declines": """SELECT d.merchant_id, 'decline_ratio_spike', d.source_txn_id, 'transaction_status', transaction_status, 'declined authorisation'
        FROM dy d JOIN f USING (merchant_id) WHERE NOT d.is_refund AND upper(d.transaction_status) = 'DECLINED' AND attempts >= 5 AND declined / attempts >= 0.25""",
    "structuring": f"""SELECT s.merchant_id, 'structuring_below_threshold', s.source_txn_id, 'total_amount', {_MONEY.format(v='total_amount')}, format('{{:.1f}}', (1 - total_amount / 1000.0) * 100) || '% below the HKD 1,000.00 threshold'
        FROM sales s JOIN f USING (merchant_id) WHERE {_NEAR} AND own_center < 500 AND (SELECT count(*) FROM sales n WHERE n.merchant_id = s.merchant_id AND {_NEAR}) >= 3""",
    "counts": f"""SELECT s.merchant_id, 'count_vs_own_baseline', s.source_txn_id, 'occurred_at', strftime(occurred_at, '%Y-%m-%dT%H:%M:%S'), 'one of ' || nd.v || ' transactions today, against a usual ' || format('{{:,.0f}}', center)
        FROM sales s JOIN nd USING (merchant_id) JOIN cnt USING (merchant_id) WHERE usable AND {_Z.format(v='nd.v')} > 3.5""",
    "dormant": f"""SELECT s.merchant_id, 'dormant_reactivation', s.source_txn_id, 'occurred_at', strftime(occurred_at, '%Y-%m-%dT%H:%M:%S'), 'first activity in ' || date_diff('day', last_active, DATE '{DAY:%Y-%m-%d}') || ' days'
        FROM sales s JOIN f USING (merchant_id) WHERE upper(coalesce(transaction_status, '')) NOT IN ('DECLINED', 'CANCELLED', 'VOIDED') AND date_diff('day', last_active, DATE '{DAY:%Y-%m-%d}') >= 7 AND settled >= 1""",
}
_DRIVEN = ("amount_vs_own_baseline", "unsettled_ratio_vs_own_baseline", "refund_ratio_spike", "decline_ratio_spike", "structuring_below_threshold", "count_vs_own_baseline", "dormant_reactivation")
query("j03_contributions", f", {FEATURES}, {UNSETTLED}, {_DAY_UNSETTLED}, {COUNT}, {_DAY_COUNT} {' UNION ALL '.join(_DRIVING.values())}")(
    lambda p: _contributions(p, (*ty.FITS, "own_daily_count", "own_unsettled"), _DRIVEN).where(F.col("detector").isin(*_DRIVEN)).select("merchant_id", "detector", "source_txn_id", "field", "value", "reason")
)
_RING_HITS = [SQL[n].replace(_FLAGGED, "fl AS (SELECT merchant_id FROM flg)").replace("pr * 1.0", "pr * 1.2") for n in ("c01_shared_identity", "c02_agent_concentration", "c03_card_across_related", "c04_card_swarm", "c05_geo_velocity")]
SQL["m04_ranked_alerts"] = f"""WITH RECURSIVE {fixture.LEDGER_SQL}, {VIEWS}, {OWN}, eh AS ({_EVERY_HIT}), flg AS (SELECT DISTINCT merchant_id FROM eh),
  ah AS (SELECT * FROM eh UNION ALL {' UNION ALL '.join(f'({s})' for s in _RING_HITS)})
  SELECT ah.*, CASE WHEN usable THEN 'A' ELSE 'B' END AS lane, {_TYPE} AS alert_type, sub_score AS blended_score,
    row_number() OVER (ORDER BY sub_score DESC, merchant_id, detector, feature_name, merchant_value) AS rank FROM ah LEFT JOIN own USING (merchant_id)"""

#: An alert store derived from the ledger: three runs of two days, alerts with types, decisions on some.
STORE = """runs AS (SELECT * FROM (VALUES (1, DATE '2024-01-30', TIMESTAMP '2024-01-31 01:00:00'), (2, DATE '2024-01-30', NULL), (3, DATE '2024-01-31', NULL)) t(run_id, as_of, superseded_at)),
alert AS (SELECT CAST(substr(source_txn_id, 2) AS BIGINT) AS alert_id, merchant_id, CASE WHEN CAST(substr(source_txn_id, 2) AS BIGINT) % 4 > 0 THEN CAST(substr(source_txn_id, 2) AS BIGINT) % 4 END AS run_id,
  CASE CAST(substr(source_txn_id, 2) AS BIGINT) % 5 WHEN 0 THEN 'temporal_anomaly' WHEN 1 THEN 'ring_signal' WHEN 2 THEN 'typology_match' WHEN 3 THEN 'single_txn_spike' END AS alert_type,
  total_amount AS score, row_number() OVER (ORDER BY total_amount DESC, source_txn_id) AS rank, occurred_at AS created_at FROM ledger WHERE transaction_status = 'DECLINED'),
disposition AS (SELECT alert_id + 1000000 AS disposition_id, alert_id, CASE WHEN alert_id % 3 = 0 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS verdict, created_at AS decided_at FROM alert WHERE alert_id % 7 = 0),
case_event AS (SELECT disposition_id * 10 + i AS event_id, disposition_id, CASE WHEN i = 0 THEN 'MERCHANT_CONTACTED' WHEN disposition_id % 2 = 0 THEN 'CLEARED' ELSE 'DOCUMENTS_REQUESTED' END AS event_type, decided_at + i * INTERVAL 1 DAY AS occurred_at
  FROM disposition, (VALUES (0), (1)) e(i) WHERE verdict = 'TRUE_POSITIVE' AND disposition_id % 5 <> i)"""
_OPEN = "oq AS (SELECT * FROM alert a WHERE alert_id NOT IN (SELECT alert_id FROM disposition) AND (run_id IS NULL OR run_id IN (SELECT run_id FROM runs WHERE superseded_at IS NULL)))"


def store(p: Portfolio) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, alerts, dispositions, case events), as STORE defines them."""
    spark = p.ledger.sparkSession
    runs = spark.sql("SELECT * FROM VALUES (1L, DATE '2024-01-30', TIMESTAMP_NTZ '2024-01-31 01:00:00'), (2L, DATE '2024-01-30', NULL), (3L, DATE '2024-01-31', NULL) AS t(run_id, as_of, superseded_at)")
    i = F.substring("source_txn_id", 2, 9).cast("long")
    kind = F.when(i % 5 == 0, "temporal_anomaly").when(i % 5 == 1, "ring_signal").when(i % 5 == 2, "typology_match").when(i % 5 == 3, "single_txn_spike")
    declined = p.ledger.where("transaction_status = 'DECLINED'")
    declined = tables.numbered(declined, [F.desc("total_amount"), F.asc("source_txn_id")], "rank")
    alert = declined.select(i.alias("alert_id"), "merchant_id", F.when(i % 4 > 0, i % 4).alias("run_id"), kind.alias("alert_type"), F.col("total_amount").alias("score"), "rank", F.col("occurred_at").alias("created_at"))
    verdict = F.when(F.col("alert_id") % 3 == 0, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE")
    disposition = alert.where("alert_id % 7 = 0").select((F.col("alert_id") + 1_000_000).alias("disposition_id"), "alert_id", verdict.alias("verdict"), F.col("created_at").alias("decided_at"))
    d = F.col("disposition_id")
    events = disposition.where("verdict = 'TRUE_POSITIVE'").select("disposition_id", "decided_at", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).where(d % 5 != F.col("i"))
    stage = F.when(F.col("i") == 0, "MERCHANT_CONTACTED").when(d % 2 == 0, "CLEARED").otherwise("DOCUMENTS_REQUESTED")
    case_event = events.select((d * 10 + F.col("i")).alias("event_id"), "disposition_id", stage.alias("event_type"), (F.col("decided_at") + F.make_dt_interval(F.col("i"))).alias("occurred_at"))
    return runs, alert, disposition, case_event


def _queue(p: Portfolio) -> DataFrame:
    runs, alert, disposition, _ = store(p)
    return alerts.open_queue(alert, disposition, runs)


def _cleared(p: Portfolio, part: int) -> DataFrame:
    runs, alert, disposition, _ = store(p)
    return alerts.clear_superseded(alert, runs, disposition, "2024-01-30")[part]


query("p14_undecided", f", {STORE} SELECT alert_id, merchant_id FROM alert WHERE alert_id NOT IN (SELECT alert_id FROM disposition)")(lambda p: alerts.undecided(store(p)[1], store(p)[2]).select("alert_id", "merchant_id"))
query("p15_current_runs", f", {STORE} SELECT alert_id, run_id FROM alert WHERE run_id IS NULL OR run_id IN (SELECT run_id FROM runs WHERE superseded_at IS NULL)")(lambda p: alerts.current(store(p)[1], store(p)[0]).select("alert_id", "run_id"))
query("k02_queue_page", f", {STORE}, {_OPEN} SELECT alert_id, rank, greatest(1, CAST(ceil((SELECT count(*) FROM oq) / 20.0) AS BIGINT)) AS pages FROM oq ORDER BY rank LIMIT 20 OFFSET 20")(lambda p: alerts.queue_page(_queue(p), 2, 20).select("alert_id", "rank", "pages"))
query("a25_queue_counts", f", {STORE}, {_OPEN} SELECT alert_type, count(*) AS n FROM oq WHERE alert_type IS NOT NULL GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM oq")(lambda p: alerts.queue_counts(_queue(p)))
#: Two runs for each day of the ledger, the first superseded but on even days.
_DAY_RUNS = """dr AS (SELECT date_diff('day', DATE '2024-01-01', txn_date) * 2 + i AS run_id, CAST(txn_date + INTERVAL 1 DAY AS DATE) AS as_of,
  CASE WHEN i = 0 AND day(txn_date) % 2 = 1 THEN CAST(txn_date AS TIMESTAMP) + INTERVAL 25 HOUR END AS superseded_at FROM (SELECT DISTINCT txn_date FROM ledger), (VALUES (0), (1)) t(i))"""


def _day_runs(p: Portfolio) -> DataFrame:
    days = pr.dated(p.ledger).select("txn_date").distinct().select("txn_date", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    old = F.col("txn_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(25))
    return days.select(
        (F.datediff("txn_date", F.lit("2024-01-01").cast("date")) * 2 + F.col("i")).cast("long").alias("run_id"), F.date_add("txn_date", 1).alias("as_of"),
        F.when((F.col("i") == 0) & (F.day("txn_date") % 2 == 1), old).alias("superseded_at"),
    )


query("m03_supersede", f""", {_DAY_RUNS} SELECT run_id, as_of::VARCHAR AS as_of,
  strftime(CASE WHEN as_of = DATE '2024-01-25' AND run_id <> 47 AND superseded_at IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE superseded_at END, '%Y-%m-%d %H:%M:%S') AS superseded_at FROM dr""")(
    lambda p: alerts.supersede(_day_runs(p), 47, "2024-01-25", datetime(2024, 2, 1))
)
query("m05_cleared_alerts", f", {STORE} SELECT alert_id FROM alert a WHERE NOT (coalesce(run_id, 0) = 1 AND alert_id NOT IN (SELECT alert_id FROM disposition))")(lambda p: _cleared(p, 0).select("alert_id"))
query("m05_cleared_runs", f", {STORE} SELECT run_id FROM runs WHERE NOT (run_id = 1 AND NOT EXISTS (SELECT 1 FROM alert JOIN disposition USING (alert_id) WHERE run_id = 1))")(lambda p: _cleared(p, 1).select("run_id"))
query("u02_flagged", f", {STORE}, {_DAY_COUNT} SELECT merchant_id FROM alert WHERE alert_id NOT IN (SELECT alert_id FROM disposition) UNION SELECT merchant_id FROM nd WHERE v > 2")(
    lambda p: alerts.flagged(store(p)[1], store(p)[2], p.sales().groupBy("merchant_id").agg(F.count("*").alias("v")).where("v > 2"))
)
query("j02_confirmed_days", f", {STORE} SELECT DISTINCT merchant_id, CAST(created_at AS DATE)::VARCHAR AS txn_date FROM alert JOIN disposition USING (alert_id) WHERE verdict = 'TRUE_POSITIVE'")(lambda p: alerts.confirmed_days(store(p)[1], store(p)[2]))
query("m07_cases", f""", {STORE}, ev AS (SELECT *, row_number() OVER (PARTITION BY disposition_id ORDER BY occurred_at DESC, event_id DESC) AS k FROM case_event),
  cs AS (SELECT d.disposition_id, d.alert_id, a.merchant_id, coalesce(event_type, 'OPENED') AS stage, coalesce(e.occurred_at, d.decided_at) AS updated_at FROM disposition d LEFT JOIN (SELECT * FROM ev WHERE k = 1) e USING (disposition_id) LEFT JOIN alert a ON a.alert_id = d.alert_id WHERE verdict = 'TRUE_POSITIVE')
  SELECT disposition_id, alert_id, merchant_id, stage, strftime(updated_at, '%Y-%m-%d') AS updated_at, (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(updated_at)) // 86400000000 AS days,
    (epoch_us(TIMESTAMP '2024-02-15') - epoch_us(updated_at)) // 86400000000 >= 7 AND stage NOT IN ('CLEARED', 'CONFIRMED_ILLICIT', 'OFFBOARDED') AS stale FROM cs""")(
    lambda p: alerts.cases(store(p)[2], store(p)[3], store(p)[1], datetime(2024, 2, 15)).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))
)
query("m06_record_disposition", f", {STORE} SELECT alert_id, verdict FROM disposition UNION ALL SELECT alert_id, 'FALSE_POSITIVE' FROM alert WHERE alert_id % 2 = 0 AND alert_id NOT IN (SELECT alert_id FROM disposition)")(
    lambda p: alerts.record_disposition(store(p)[2].select("alert_id", "verdict"), store(p)[1].where("alert_id % 2 = 0").select("alert_id", F.lit("FALSE_POSITIVE").alias("verdict")))
)
query("w06_card_trail", "SELECT source_txn_id, merchant_id, round((epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (ORDER BY occurred_at, source_txn_id)) / 60000000.0, 1) AS gap_minutes FROM ledger WHERE hashed_pan = 'P7'")(
    lambda p: alerts.card_trail(p.ledger, "P7").select("source_txn_id", "merchant_id", "gap_minutes")
)
query("s08_top_merchants", "SELECT merchant_id, count(*) AS n FROM ledger GROUP BY 1 ORDER BY n DESC, merchant_id LIMIT 20")(lambda p: ingest.dry_run(p.ledger)[1])
query("s02_idempotent_ingest", ", b AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, txn_date ORDER BY source_txn_id) AS k FROM ledger) SELECT merchant_id || txn_date AS source_txn_id, source_txn_id AS arrived FROM b WHERE k = 1 AND txn_date >= DATE '2024-01-16'")(
    lambda p: ingest.new_rows(
        pr.dated(p.ledger).select(F.concat("merchant_id", F.col("txn_date").cast("string")).alias("source_txn_id"), F.col("source_txn_id").alias("arrived")),
        pr.dated(p.ledger).where("txn_date < date'2024-01-16'").select(F.concat("merchant_id", F.col("txn_date").cast("string")).alias("source_txn_id")), "arrived",
    )
)
query("s03_merchant_upsert", ", lr AS (SELECT merchant_id, max_by(nullif(trim(card_type), ''), source_txn_id) FILTER (trim(card_type) <> '') AS city FROM ledger GROUP BY 1) SELECT merchant_id, mcc, mcc_description, coalesce(city, NULL) AS city FROM merchants LEFT JOIN lr USING (merchant_id)")(
    lambda p: ingest.upsert_merchants(p.merchants, p.ledger.select("merchant_id", F.col("card_type").alias("city"), F.lit(None).cast("string").alias("mcc"), F.col("source_txn_id").alias("seq")), "seq").select("merchant_id", "mcc", "mcc_description", "city")
)
query("p16_refund_rows", "SELECT source_txn_id, upper(coalesce(transaction_status, '')) IN ('REFUNDED', 'REFUND', 'REVERSED', 'CHARGEBACK') OR total_amount < 0 AS is_refund, nullif(trim(card_type), '') AS card_type, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM ledger")(
    lambda p: ingest.to_ledger(p.ledger.select(F.col("source_txn_id").alias("payment_id"), "merchant_id", F.col("total_amount").cast("string").alias("total_amount"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'+09:00'").alias("hkt_transaction_time"), "transaction_status", "card_type")).select(
        "source_txn_id", "is_refund", "card_type", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at")
    )
)

# ---- verdicts ------------------------------------------------------------------------------

_BY_DETECTOR = dict(zip((d.__name__ for d in det.DETECTORS), DETECTOR_SQL))
_STUDY_SALES = VIEWS.replace("sales AS (SELECT * FROM dy WHERE NOT is_refund)", f"sales AS (SELECT * FROM dy WHERE {_SETTLED})")
_FAILS = " UNION ".join(f"SELECT merchant_id, detector FROM (WITH {DETECTOR_SQL[_BY_DETECTOR[d]].strip()})" for d in study.ORDER)
_GATE = {
    "amount_vs_own_baseline": (OWN, "own", "merchant_id", "sales"), "count_vs_own_baseline": (COUNT, "cnt", "merchant_id", "sales"),
    "burst_rate_vs_own_baseline": (VELOCITY, "vel", "merchant_id", "sales"), "hour_vs_own_pattern": (f"{OWN_HOURS}, g AS (SELECT *, n >= 20 AS usable FROM oh)", "g", "merchant_id", "sales"),
    "card_origin_vs_own_mix": (f"{ORIGINS}, g AS (SELECT *, n >= 20 AS usable FROM om)", "g", "merchant_id", "(SELECT * FROM sales WHERE card_issuing_country NOT IN ('', 'HK'))"),
    "ticket_vs_mcc_peers": (cohort("mcc"), "ct", "mcc", "sales"), "count_vs_mcc_peers": (PEER_COUNT, "peer_cnt", "mcc", "sales"),
    "merchant_level_vs_mcc_peers": (f"{OWN}, {PEER}, g AS (SELECT o.merchant_id, o.usable AND o.center <> 0 AND p.usable AS usable FROM own o JOIN merchants USING (merchant_id) JOIN peer p USING (mcc))", "g", "merchant_id", "sales"),
    "hour_vs_mcc_peers": (f"{COHORT_HOURS}, g AS (SELECT *, n >= 20 AS usable FROM ch)", "g", "mcc", "sales"), "ticket_vs_subdistrict_peers": (cohort("merchant_subdistrict"), "ct", "merchant_subdistrict", "sales"),
    "foreign_card_ratio_vs_subdistrict": (FOREIGN, "frn", "merchant_subdistrict", f"(SELECT * FROM dy WHERE {_SETTLED} AND card_issuing_country <> '')"),
    "unsettled_ratio_vs_own_baseline": (UNSETTLED, "uns", "merchant_id", "dy"), "unsettled_ratio_vs_mcc_peers": (PEER_UNSETTLED, "puns", "mcc", "dy"),
}
_LIVE = "SELECT merchant_id, 'level_shift_ramp' AS detector FROM merchants UNION ALL " + " UNION ALL ".join(
    f"SELECT * FROM (WITH {ctes.strip()} SELECT DISTINCT m.merchant_id, '{d}' AS detector FROM merchants m JOIN {base} b USING ({key}) WHERE usable AND m.merchant_id IN (SELECT merchant_id FROM {rows}))"
    for d, (ctes, base, key, rows) in _GATE.items()
)
_STUDY = f"""WITH {fixture.LEDGER_SQL}, {_STUDY_SALES}, fails AS ({_FAILS}), live AS ({_LIVE}),
  vd AS (SELECT m.merchant_id, s.step, s.detector, CASE WHEN f.detector IS NOT NULL THEN 'FAIL' WHEN l.detector IS NOT NULL THEN 'OK' ELSE 'SKIP' END AS status
    FROM merchants m, (VALUES {", ".join(f"({k}, '{d}')" for k, d in enumerate(study.ORDER))}) s(step, detector)
    LEFT JOIN fails f ON f.merchant_id = m.merchant_id AND f.detector = s.detector LEFT JOIN live l ON l.merchant_id = m.merchant_id AND l.detector = s.detector)"""
query("m10_merchant_study")(lambda p: study.study(stored(p)))
query("m12_root_cause")(lambda p: study.root_cause(study.study(stored(p))))
SQL["m10_merchant_study"] = f"{_STUDY} SELECT merchant_id, step, detector, status FROM vd"
SQL["m12_root_cause"] = f"{_STUDY} SELECT merchant_id, arg_min(detector, step) AS detector FROM vd WHERE status = 'FAIL' GROUP BY 1"
query("m11_rule_study", f", {FEATURES}, {_DAILY_VALUE}, bh AS ({' UNION ALL '.join(f'SELECT merchant_id, detector FROM ({s})' for s in RULE_SQL.values())}) SELECT f.merchant_id, r.rule, CASE WHEN bh.detector IS NULL THEN 'OK' ELSE 'FAIL' END AS status FROM f, (VALUES {', '.join(f'({t!r})' for t in ty.EVALUATORS)}) r(rule) LEFT JOIN bh ON bh.merchant_id = f.merchant_id AND bh.detector = r.rule")(
    lambda p: study.rule_study(p, [r for r in RULES if r.template in ty.EVALUATORS])
)
