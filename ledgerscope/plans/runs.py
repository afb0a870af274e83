"""Registered queries of published runs, of profiles and of fits over many dates, and their SQL twins."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import alerts, baselines as bl, daytables, detectors as det, diagnostics, profiles, study
from ledgerscope.operators.detectors import Portfolio, Tuning
from ledgerscope.plans import nightly
from ledgerscope.plans import registry as reg
from ledgerscope.plans.registry import AS_OF, query
from ledgerscope.sources import fixture, tables
from ledgerscope.sources.ledger_store import LedgerStore
from ledgerscope.sources.store import RunStore

#: Thresholds that an analyst has set: the production floor, a trade that is lumpy, and one without a floor.
TUNED = Tuning(3.5, 1000.0, {"5001": {"outlier_z": 8.0}, "5002": {"materiality_floor": 0.0}})
_NOW = datetime(2024, 2, 1)


def dated_sql(sql: str, d: date) -> str:
    """``sql``, which is written for AS_OF, for another date: all bounds of windows move with it."""
    shift = AS_OF.date() - d
    moved = lambda m: f"TIMESTAMP '{datetime.fromisoformat(m[1]) - shift:%Y-%m-%d %H:%M:%S}'"
    return re.sub(r"TIMESTAMP '(\d{4}-\d\d-\d\d 00:00:00)'", moved, sql)


# ---- the run store -------------------------------------------------------------------------


def _amounts(p: Portfolio, rules: list, places: DataFrame) -> dict[str, DataFrame]:
    """What a night of one check publishes: amounts against the merchant's own."""
    return {"alerts": alerts.rank(reg.tidy(det.amount_vs_own_baseline(p)), det.lanes(p))}


def published(p: Portfolio) -> RunStore:
    """A store with two nights of one day, the second under other thresholds, and a third that died before its commit."""
    spark = p.ledger.sparkSession
    ticks = iter(_NOW + timedelta(minutes=i) for i in range(1000))
    store = RunStore(spark, f"{tables.shared_folder(spark)}/runs-{uuid.uuid4().hex}", lambda: next(ticks))
    p = reg.stored(p)
    p = replace(p, written={"own_amount": tables.write(p.fitted("own_amount"), "own"), "day": tables.write(p.day(), "day")})
    store.save_settings(reg.TUNING, p.fit, "a.chan")
    store.save_rules(reg.RULES, "a.chan")
    for label, tuning in (("first pass", reg.TUNING), ("with a floor", TUNED)):
        store.save_settings(tuning, p.fit, "b.lee")
        nightly.night(store, p, fixture.places(spark), label, "query", _amounts)
    dead = store.open_run(AS_OF, "died")
    alert = store.read("alerts", current=True)
    alert.drop("as_of", "run_id", "superseded_at").write.parquet(f"{store.folder}/tables/alerts/as_of={AS_OF.date()}/run_id={dead}/attempt=none")
    return store


_TUNED = reg.tickets(
    "amount_vs_own_baseline", "ticket_amount", "own", "merchant_id",
    "z > CASE WHEN mcc = '5001' THEN 8.0 ELSE 3.5 END AND total_amount >= CASE WHEN mcc = '5002' THEN 0 ELSE 1000 END",
)
_PUBLISHED = f"""{reg.OWN}, r1 AS ({reg.tickets('amount_vs_own_baseline', 'ticket_amount', 'own', 'merchant_id')}), r2 AS ({_TUNED}),
pub AS (SELECT 1 AS run_id, true AS superseded, * FROM r1 UNION ALL SELECT 2, false, * FROM r2)"""

query("s14_alert_store", f""", {_PUBLISHED} SELECT CAST(run_id AS BIGINT) AS run_id, '2024-01-31' AS as_of, superseded, pub.merchant_id, detector, sub_score, merchant_value, deviation,
    row_number() OVER (PARTITION BY run_id ORDER BY sub_score DESC, pub.merchant_id, detector, feature_name, merchant_value) AS rank, 'A' AS lane, 'single_txn_spike' AS alert_type FROM pub""")(
    lambda p: published(p).read("alerts").select(
        "run_id", "as_of", F.col("superseded_at").isNotNull().alias("superseded"), "merchant_id", "detector", "sub_score", "merchant_value", "deviation", "rank", "lane", "alert_type"
    )
)
query("m02_runs", f""", {_PUBLISHED}, s(run_id, label, outlier_z, materiality_floor, overrides) AS (VALUES (1, 'first pass', 3.5, 0.0, 0), (2, 'with a floor', 3.5, 1000.0, 2))
    SELECT CAST(run_id AS BIGINT) AS run_id, '2024-01-31' AS as_of, label, 'query' AS triggered_by, CAST(outlier_z AS DOUBLE) AS outlier_z, CAST(materiality_floor AS DOUBLE) AS materiality_floor,
      CAST(overrides AS BIGINT) AS overrides, CAST({len(reg.RULES)} AS BIGINT) AS rules, run_id = 1 AS superseded, (SELECT count(*) FROM pub WHERE pub.run_id = s.run_id) AS alert_count FROM s""")(
    lambda p: published(p).runs().select(
        "run_id", "as_of", "label", "triggered_by", "settings.outlier_z", "settings.materiality_floor", F.size("settings.mcc_overrides").alias("overrides"), F.size("rules").alias("rules"),
        F.col("superseded_at").isNotNull().alias("superseded"), "alert_count",
    )
)

# ---- profiles ------------------------------------------------------------------------------


def _profiles(p: Portfolio) -> DataFrame:
    """Profiles as they are published and read back."""
    spark = p.ledger.sparkSession
    store = RunStore(spark, f"{tables.shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    run = store.open_run(AS_OF)
    store.publish(run, {"profiles": profiles.assemble(det.write_fits(reg.stored(p), det.DETECTOR_FITS))}, "profiles")
    return profiles.latest(store.read("profiles", current=True))


query("s12_profiles", f""", {reg.OWN}, {reg.PEER}, {reg.COUNT}, {reg.VELOCITY}, {reg.FOREIGN}, {reg.UNSETTLED}, {reg.PEER_UNSETTLED}, {reg.TREND}, {reg.OWN_HOURS}, {reg.COHORT_HOURS}, {reg.cohort('merchant_subdistrict')}, {reg.RAIL}, {reg.ORIGINS},
    rl AS (SELECT merchant_id, count(*) AS k, sum(center) AS s FROM rail WHERE usable GROUP BY 1), oc AS (SELECT merchant_id, any_value(n) AS n, count(*) AS k FROM om GROUP BY 1),
    qd AS (SELECT merchant_id, count(*) AS k FROM confirmed GROUP BY 1)
    SELECT merchant_id, '2024-01-31' AS as_of, m.mcc, CASE WHEN own.usable THEN 'A' ELSE 'B' END AS lane, own.n AS own_n, {reg._r('own.center')}, own.method, round(peer.center, 6) AS peer_center,
      round(CASE WHEN peer.usable THEN peer.center + 3.5 * peer.dispersion / 0.6745 END, 6) AS peer_fence, round(cnt.center, 6) AS volume_center, round(vel.dispersion, 6) AS velocity_dispersion,
      round(uns.center, 6) AS unsettled_center, round(puns.center, 6) AS peer_unsettled_center, round(frn.center, 6) AS foreign_center, round(ct.center, 6) AS district_center,
      round(trend_ratio, 3) AS trend_ratio, round(oh.threshold, 6) AS hours_threshold, round(ch.threshold, 6) AS cohort_threshold, CAST(oc.n AS BIGINT) AS origin_n, oc.k AS origins, rl.k AS rails, round(rl.s, 6) AS rail_centers,
      coalesce(qd.k, 0) AS quarantined_days
    FROM merchants m LEFT JOIN own USING (merchant_id) LEFT JOIN peer ON peer.mcc = m.mcc LEFT JOIN cnt USING (merchant_id) LEFT JOIN vel USING (merchant_id) LEFT JOIN uns USING (merchant_id)
      LEFT JOIN puns ON puns.mcc = m.mcc LEFT JOIN frn ON frn.merchant_subdistrict = m.merchant_subdistrict LEFT JOIN ct ON ct.merchant_subdistrict = m.merchant_subdistrict LEFT JOIN trend USING (merchant_id)
      LEFT JOIN oh USING (merchant_id) LEFT JOIN ch ON ch.mcc = m.mcc LEFT JOIN oc USING (merchant_id) LEFT JOIN rl USING (merchant_id) LEFT JOIN qd USING (merchant_id)""")(
    lambda p: _profiles(p).select(
        "merchant_id", "as_of", "mcc", "lane", F.col("own.n").alias("own_n"), "own.center", "own.method", F.col("peer.center").alias("peer_center"), F.col("peer.fence").alias("peer_fence"),
        F.col("volume.center").alias("volume_center"), F.col("velocity.dispersion").alias("velocity_dispersion"), F.col("unsettled.center").alias("unsettled_center"),
        F.col("peer_unsettled.center").alias("peer_unsettled_center"), F.col("foreign_cards.center").alias("foreign_center"), F.col("district_txn.center").alias("district_center"),
        F.col("trend.ratio").alias("trend_ratio"), F.col("hours.threshold").alias("hours_threshold"), F.col("cohort_hours.threshold").alias("cohort_threshold"),
        F.col("origins.n").alias("origin_n"), F.when(F.col("origins").isNotNull(), F.size("origins.counts")).alias("origins"), F.when(F.col("rails").isNotNull(), F.size("rails")).alias("rails"),
        F.aggregate(F.map_values("rails"), F.lit(0.0), lambda a, r: a + r["center"]).alias("rail_centers"), "window.quarantined_days",
    )
)
query("s13_cohort_members", f", {reg.stats('p_m', 'sw', 'merchant_id', 'total_amount')} SELECT mcc, merchant_id, round(center, 6) AS vote FROM p_m JOIN merchants USING (merchant_id)")(profiles.cohort_members)

# ---- fits over many dates ------------------------------------------------------------------

DATES = tuple(AS_OF.date() - timedelta(days=d) for d in (9, 4, 1, 0))


def _backfilled(p: Portfolio, columns: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """The fits that ``columns`` name, of DATES, from day tables that are loaded once and of which the last day came in a night of its own."""
    names = {fit for fit, _ in columns.values()}
    _, parts = daytables.needed(names)
    spark = p.ledger.sparkSession
    p = reg.stored(p)
    days = daytables.DayStore(spark, f"{tables.shared_folder(spark)}/days-{uuid.uuid4().hex}")
    last = datetime(AS_OF.year, AS_OF.month, AS_OF.day) - timedelta(days=1)
    days.load(p.ledger.where(F.col("occurred_at") < F.lit(last.isoformat(sep=" ")).cast("timestamp_ntz")), names=parts)
    days.update(p.ledger, [last.date()], parts)
    return det.backfill(days.read(parts), p.merchants, p.confirmed, DATES, bl.FitSettings(), names)


def _over_dates(ctes: str, select: str) -> str:
    each = [f"SELECT '{d}' AS as_of, * FROM (WITH RECURSIVE {fixture.LEDGER_SQL}, {dated_sql(f'{reg.VIEWS}, {ctes} {select}', d)})" for d in DATES]
    return " UNION ALL ".join(each)


def _joined(parts: dict[str, DataFrame], key: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    keyed = {n: parts[t].select("as_of", key, F.col(c).alias(n)) for n, (t, c) in columns.items()}
    first, *rest = keyed.values()
    for df in rest:
        first = first.join(df, ["as_of", key], "left")
    return first


_MERCHANT = {
    "n": ("own_amount", "n"), "center": ("own_amount", "center"), "usable": ("own_amount", "usable"), "daily": ("own_daily_count", "center"), "peak": ("own_velocity", "center"),
    "unsettled": ("own_unsettled", "dispersion"), "threshold": ("own_hours", "threshold"), "ratio": ("trend", "trend_ratio"), "last_active": ("last_activity", "last_active"),
}
_COHORT = {
    "n": ("peer_amount", "n"), "center": ("peer_amount", "center"), "daily": ("peer_daily_count", "center"), "unsettled": ("peer_unsettled", "center"), "ticket": ("mcc_tickets", "center"),
    "threshold": ("cohort_hours", "threshold"),
}
reg.QUERIES["m16_backfilled_profiles"] = lambda spark, sf_dir: reg.tidy(_joined(_backfilled(reg.portfolio(spark, sf_dir), _MERCHANT), "merchant_id", _MERCHANT))
reg.SQL["m16_backfilled_profiles"] = _over_dates(
    f"{reg.OWN}, {reg.COUNT}, {reg.VELOCITY}, {reg.UNSETTLED}, {reg.OWN_HOURS}, {reg.TREND}, la AS (SELECT merchant_id, CAST(max(occurred_at) AS DATE) AS last_active FROM ledger WHERE occurred_at < {reg._ts(reg.DAY)} GROUP BY 1)",
    """SELECT merchant_id, own.n, round(own.center, 6) AS center, own.usable, round(cnt.center, 6) AS daily, round(vel.center, 6) AS peak, round(uns.dispersion, 6) AS unsettled, round(oh.threshold, 6) AS threshold,
      round(trend_ratio, 6) AS ratio, last_active::VARCHAR AS last_active FROM own LEFT JOIN cnt USING (merchant_id) LEFT JOIN vel USING (merchant_id) LEFT JOIN uns USING (merchant_id) LEFT JOIN oh USING (merchant_id)
      LEFT JOIN trend USING (merchant_id) LEFT JOIN la USING (merchant_id)""",
)
reg.QUERIES["m16_backfilled_cohorts"] = lambda spark, sf_dir: reg.tidy(_joined(_backfilled(reg.portfolio(spark, sf_dir), _COHORT), "mcc", _COHORT))
reg.SQL["m16_backfilled_cohorts"] = _over_dates(
    f"{reg.PEER}, {reg.PEER_COUNT}, {reg.PEER_UNSETTLED}, {reg.cohort('mcc')}, {reg.COHORT_HOURS}",
    """SELECT mcc, peer.n, round(peer.center, 6) AS center, round(peer_cnt.center, 6) AS daily, round(puns.center, 6) AS unsettled, round(ct.center, 6) AS ticket, round(ch.threshold, 6) AS threshold
      FROM peer LEFT JOIN peer_cnt USING (mcc) LEFT JOIN puns USING (mcc) LEFT JOIN ct USING (mcc) LEFT JOIN ch USING (mcc)""",
)

# ---- diagnostics ---------------------------------------------------------------------------

query("a29_stat_blocks", f", {reg.stats('sb', 'sales', 'merchant_id', 'total_amount')} SELECT merchant_id, round(avg(total_amount), 6) AS mean, round(any_value(center), 6) AS median, round(any_value(mad), 6) AS mad, any_value(n) AS n FROM sales JOIN sb USING (merchant_id) GROUP BY 1")(
    lambda p: diagnostics.stat_blocks(p.sales(), "merchant_id", "total_amount")
)
_VOTE = "vo AS (SELECT mcc, merchant_id, center AS vote FROM p_m JOIN merchants USING (merchant_id) WHERE mcc IS NOT NULL)"
_VOTES = f"{reg.stats('p_m', 'sw', 'merchant_id', 'total_amount')}, {_VOTE}"
query("m13_peer_places", f""", {_VOTES} SELECT mcc, merchant_id, round(vote, 6) AS vote, rank() OVER (PARTITION BY mcc ORDER BY vote) - 1 AS below, count(*) OVER (PARTITION BY mcc, vote) AS alike, count(*) OVER (PARTITION BY mcc) AS n,
    round((rank() OVER (PARTITION BY mcc ORDER BY vote) - 1 + count(*) OVER (PARTITION BY mcc, vote) / 2) / count(*) OVER (PARTITION BY mcc), 6) AS percentile FROM vo""")(
    lambda p: diagnostics.peer_places(profiles.cohort_members(p))
)
query("m13_peer_histograms", f""", {_VOTES}, ve AS (SELECT mcc, min(vote) AS least, max(vote) AS most FROM vo GROUP BY 1),
    vb AS (SELECT mcc, least, most, CASE WHEN most > least THEN least(CAST(floor((vote - least) / ((most - least) / 20)) AS BIGINT), 19) ELSE 0 END AS bar FROM vo JOIN ve USING (mcc))
    SELECT mcc, bar, round(least + bar * ((most - least) / 20), 6) AS low, round(least + (bar + 1) * ((most - least) / 20), 6) AS high, count(*) AS merchants FROM vb GROUP BY mcc, bar, least, most""")(
    lambda p: diagnostics.peer_histograms(profiles.cohort_members(p))
)
query("m13_hour_curves", f""", {reg.OWN_HOURS}, {reg.COHORT_HOURS}, sb AS (SELECT merchant_id, {reg._BIN} AS bin, count(*) AS sales FROM sales GROUP BY 1, 2),
    b AS (SELECT * FROM (SELECT DISTINCT merchant_id, mcc FROM sales), range(96) r(i))
    SELECT b.merchant_id, b.i AS bin, round(oh.density[i + 1], 6) AS own, round(oh.threshold, 6) AS own_threshold, round(ch.density[i + 1], 6) AS cohort, round(ch.threshold, 6) AS cohort_threshold, coalesce(sales, 0) AS sales
    FROM b LEFT JOIN oh ON oh.merchant_id = b.merchant_id LEFT JOIN ch ON ch.mcc = b.mcc LEFT JOIN sb ON sb.merchant_id = b.merchant_id AND sb.bin = b.i""")(diagnostics.hour_curves)


def _pages(p: Portfolio) -> DataFrame:
    p = det.write_fits(reg.stored(p))
    return diagnostics.pages(p, tables.write(study.study(p), "study"), tables.write(profiles.assemble(p), "profiles"))


query("m13_pages", f""", {reg.OWN}, {reg.PEER}, {_VOTE}, {reg.stats('sb', 'sales', 'merchant_id', 'total_amount')}
    SELECT d.merchant_id, round(sb.center, 6) AS day_median, sb.n AS day_n, round(own.center, 6) AS center, round(peer.center, 6) AS peer_center, v.n AS peers,
      round((v.below + v.alike / 2) / v.n, 6) AS percentile
    FROM (SELECT DISTINCT merchant_id, mcc FROM dy) d LEFT JOIN sb USING (merchant_id) LEFT JOIN own USING (merchant_id) LEFT JOIN peer ON peer.mcc = d.mcc
      LEFT JOIN (SELECT merchant_id, rank() OVER (PARTITION BY mcc ORDER BY vote) - 1 AS below, count(*) OVER (PARTITION BY mcc, vote) AS alike, count(*) OVER (PARTITION BY mcc) AS n FROM vo) v ON v.merchant_id = d.merchant_id""")(
    lambda p: _pages(p).select("merchant_id", F.col("day.median").alias("day_median"), F.col("day.n").alias("day_n"), "baseline.center", F.col("peers.center").alias("peer_center"), F.col("place.n").alias("peers"), "place.percentile")
)

# ---- bulk load -----------------------------------------------------------------------------

_CUT = datetime(2024, 1, 20)


def _loaded(p: Portfolio) -> LedgerStore:
    """The ledger in two deliveries: its beginning, every third row of it twice, then all of it again."""
    spark = p.ledger.sparkSession
    store = LedgerStore(spark, f"{tables.shared_folder(spark)}/ledger-{uuid.uuid4().hex}", 8)
    rows = p.ledger.withColumn("arrival", F.col("source_txn_id"))
    early = rows.where(F.col("occurred_at") < F.lit(_CUT.isoformat(sep=" ")).cast("timestamp_ntz"))
    again = early.where(F.substring("source_txn_id", 2, 9).cast("long") % 3 == 0).withColumns({"arrival": F.concat(F.lit("Z"), "arrival"), "total_amount": F.lit(-1.0)})
    store.append(early.unionByName(again), "early")
    store.append(rows, "all")
    return store


query("s07_deliveries", f""", e AS (SELECT count(*) AS n, count(*) FILTER (CAST(substr(source_txn_id, 2, 9) AS BIGINT) % 3 = 0) AS k FROM ledger WHERE occurred_at < {reg._ts(_CUT)}), a AS (SELECT count(*) AS n FROM ledger)
    SELECT 'early' AS delivery, n AS inserted, k AS skipped FROM e UNION ALL SELECT 'all', a.n - e.n, e.n FROM a, e""")(lambda p: _loaded(p).deliveries().drop("loaded_at"))
query("s07_stored_ledger", "SELECT txn_date::VARCHAR AS txn_date, count(*) AS n, round(sum(total_amount), 4) AS value FROM ledger GROUP BY 1")(
    lambda p: _loaded(p).ledger().groupBy("txn_date").agg(F.count("*").alias("n"), F.round(F.sum("total_amount"), 4).alias("value"))
)
