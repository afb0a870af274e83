"""Ranking of hits into alerts, and the tables behind the queue: runs, dispositions, cases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import robust
from ledgerscope.sources import tables

#: Detectors by alert type; any other detector is ``single_txn_spike``.
ALERT_TYPES = {
    "mcc_peer_discrepancy": ("count_vs_mcc_peers", "level_shift_ramp", "merchant_level_vs_mcc_peers", "ticket_vs_mcc_peers"),
    "temporal_anomaly": ("hour_vs_mcc_peers", "hour_vs_own_pattern"),
    "subdistrict_anomaly": ("card_origin_vs_own_mix", "foreign_card_ratio_vs_subdistrict", "ticket_vs_subdistrict_peers"),
    "failed_txn_rate": ("unsettled_ratio_vs_mcc_peers", "unsettled_ratio_vs_own_baseline"),
    "typology_match": (
        "bust_out", "declared_vs_actual_mismatch", "decline_ratio_spike", "dormant_reactivation", "rapid_movement",
        "refund_ratio_spike", "structuring_below_threshold",
    ),
    "ring_signal": ("agent_alert_concentration", "card_across_related_merchants", "card_swarm", "impossible_geo_velocity", "shared_identity_ring"),
}
#: Stages of a case that end it, and days without update after which it is stale.
RESOLVED = ("CLEARED", "CONFIRMED_ILLICIT", "OFFBOARDED")
STALE_DAYS = 7


def alert_type(detector: Column) -> Column:
    out = F.lit("single_txn_spike")
    for kind, detectors in ALERT_TYPES.items():
        out = F.when(detector.isin(*detectors), kind).otherwise(out)
    return out


def rank(hits: DataFrame, lanes: DataFrame) -> DataFrame:
    """One alert for each hit, numbered from 1 by (score down, merchant, detector, feature, value).

    Scores that are equal to six places count as equal, so that the order doesn't hang on the last bits of a sum.
    Hits that are equal in all of these follow each other by their other columns, so that the order doesn't hang on the rows' places.
    """
    order = [F.desc(robust.rounded(F.col("sub_score"), 6)), F.asc("merchant_id"), F.asc("detector"), F.asc("feature_name"), F.asc("merchant_value")]
    order += [F.asc(c) for c in ("family", "baseline_value", "deviation", "evidence") if c in hits.columns]
    named = hits.join(lanes, "merchant_id", "left").withColumn("lane", F.coalesce("lane", F.lit("B"))).withColumn("alert_type", alert_type(F.col("detector")))
    return tables.numbered(named, order, "rank").withColumn("blended_score", F.col("sub_score"))


def supersede(runs: DataFrame, run_id: int, as_of: str, now: datetime) -> DataFrame:
    """``runs`` with all other runs of the day that are not superseded yet stamped as superseded."""
    old = (F.col("as_of") == F.lit(as_of).cast("date")) & (F.col("run_id") != run_id) & F.col("superseded_at").isNull()
    return runs.withColumn("superseded_at", F.when(old, F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")).otherwise(F.col("superseded_at")))


def undecided(alerts: DataFrame, dispositions: DataFrame) -> DataFrame:
    return alerts.join(dispositions.select("alert_id"), "alert_id", "left_anti")


def current(alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts without a run, or of a run that is not superseded."""
    live = runs.where("superseded_at is null").select("run_id", F.lit(True).alias("__live"))
    return alerts.join(live, "run_id", "left").where("run_id is null or __live").select(*alerts.columns)


def open_queue(alerts: DataFrame, dispositions: DataFrame, runs: DataFrame) -> DataFrame:
    return current(undecided(alerts, dispositions), runs)


def queue_page(queue: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Rows of one page in rank order, with the number of pages; page from 1, size from 1 to 200."""
    page, size = max(1, page), min(200, max(1, size))
    pages = queue.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("long").alias("pages"))
    rows = queue.orderBy("rank", "alert_id").offset((page - 1) * size).limit(size)
    return rows.join(F.broadcast(pages))


def queue_counts(queue: DataFrame) -> DataFrame:
    """Open alerts by type; those without a type count in the total alone."""
    by_type = queue.where("alert_type is not null").groupBy("alert_type").agg(F.count("*").alias("n"))
    return by_type.unionByName(queue.agg(F.lit("total").alias("alert_type"), F.count("*").alias("n")))


def clear_superseded(alerts: DataFrame, runs: DataFrame, dispositions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(alerts, runs) without the undecided alerts of the day's superseded runs, and without runs left empty thereby."""
    old = runs.where((F.col("as_of") == F.lit(as_of).cast("date")) & F.col("superseded_at").isNotNull()).select("run_id")
    decided = alerts.join(dispositions.select("alert_id"), "alert_id", "left_semi")
    gone = alerts.join(old, "run_id", "left_semi").join(decided.select("alert_id"), "alert_id", "left_anti").select("alert_id")
    keep = decided.select("run_id").distinct()
    return alerts.join(gone, "alert_id", "left_anti"), runs.join(old.join(keep, "run_id", "left_anti"), "run_id", "left_anti")


def flagged(alerts: DataFrame, dispositions: DataFrame, hits: DataFrame) -> DataFrame:
    """Merchants with an undecided alert, of any run, or a hit in this one."""
    return undecided(alerts, dispositions).select("merchant_id").union(hits.select("merchant_id")).distinct()


def confirmed_days(alerts: DataFrame, dispositions: DataFrame, by: str = "created_date") -> DataFrame:
    """(merchant_id, txn_date) of alerts confirmed as true: the date they were written, or the day they scored."""
    true = alerts.join(dispositions.where("verdict = 'TRUE_POSITIVE'").select("alert_id"), "alert_id")
    day = F.to_date("created_at") if by == "created_date" else F.date_sub(F.to_date("as_of"), 1)
    return true.select("merchant_id", day.alias("txn_date")).distinct()


def record_disposition(dispositions: DataFrame, new: DataFrame) -> DataFrame:
    """``dispositions`` with ``new`` ones appended; an alert that is decided already keeps its decision."""
    return dispositions.unionByName(new.join(dispositions.select("alert_id"), "alert_id", "left_anti").select(dispositions.columns))


def cases(dispositions: DataFrame, events: DataFrame, alerts: DataFrame, now: datetime) -> DataFrame:
    """Cases of confirmed alerts with their latest stage; stale ones first, then the longest without update."""
    latest = events.groupBy("disposition_id").agg(F.max(F.struct("occurred_at", "event_id", "event_type")).alias("e"))
    base = dispositions.where("verdict = 'TRUE_POSITIVE'").join(latest, "disposition_id", "left").join(alerts.select("alert_id", "merchant_id"), "alert_id", "left")
    updated = F.coalesce("e.occurred_at", "decided_at")
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    days = F.expr(f"timestampdiff(DAY, updated_at, timestamp_ntz'{now.isoformat(sep=' ')}')").cast("long")
    out = base.withColumn("updated_at", updated).withColumn("stage", F.coalesce("e.event_type", F.lit("OPENED"))).where(F.col("updated_at") <= at)
    stale = out.withColumn("days", days).withColumn("stale", (F.col("days") >= STALE_DAYS) & ~F.col("stage").isin(*RESOLVED))
    return stale.select("disposition_id", "alert_id", "merchant_id", "stage", "updated_at", "days", "stale").orderBy(F.desc("stale"), "updated_at", "disposition_id")


def card_trail(ledger: DataFrame, pan: str) -> DataFrame:
    """One card's rows across merchants in order, with minutes since the row before."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', occurred_at)")
    w = Window.orderBy("occurred_at", "source_txn_id")
    rows = ledger.where(F.col("hashed_pan") == pan).withColumn("t", t)
    return rows.select("source_txn_id", "merchant_id", "occurred_at", "total_amount", robust.rounded((F.col("t") - F.lag("t").over(w)) / 60_000_000, 1).alias("gap_minutes"))


def trail_rollup(ledger: DataFrame) -> DataFrame:
    """Per card and merchant: rows, value, first and last time."""
    return ledger.groupBy("hashed_pan", "merchant_id").agg(
        F.count("*").alias("n"), F.sum("total_amount").alias("value"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen")
    )


#: The stages of a case, in the order in which they are offered.
CASE_STAGES = (
    "OPENED", "MERCHANT_CONTACTED", "DOCUMENTS_REQUESTED", "DOCUMENTS_RECEIVED", "DOCUMENTS_VERIFIED", "NO_RESPONSE", "ESCALATED_LEGAL", "STR_FILED",
    "CLEARED", "CONFIRMED_ILLICIT", "OFFBOARDED",
)


def decide(dispositions: DataFrame, events: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dispositions, events) after ``new`` decisions: each alert keeps its first, and a confirmed one opens a case.

    ``new`` has the columns of ``dispositions``; an opening is an event of the decision's time, by its
    analyst if there is one. Of several new decisions of one alert the earliest counts.
    """
    first = Window.partitionBy("alert_id").orderBy("decided_at", "disposition_id")
    once = new.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    fresh = once.join(dispositions.select("alert_id"), "alert_id", "left_anti").select(dispositions.columns)
    known = {"disposition_id": F.col("disposition_id"), "event_type": F.lit("OPENED"), "occurred_at": F.col("decided_at"), "actor": F.col("analyst_id") if "analyst_id" in new.columns else F.lit(None)}
    # negative ids can't meet those of events that are added later
    known["event_id"] = -F.col("disposition_id")
    openings = fresh.where("verdict = 'TRUE_POSITIVE'").select(*[known.get(c, F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    return dispositions.unionByName(fresh), events.unionByName(openings)


def add_events(events: DataFrame, dispositions: DataFrame, new: DataFrame) -> DataFrame:
    """``events`` with ``new`` ones appended; stages are never replaced. A stage that isn't among CASE_STAGES, or a decision that doesn't exist, raises an error."""
    known = dispositions.select("disposition_id", F.lit(True).alias("__known"))
    refuse = lambda why, c: F.raise_error(F.concat(F.lit(why), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("string")
    stage = F.when(F.col("event_type").isin(*CASE_STAGES), F.col("event_type")).otherwise(refuse("unknown stage ", "event_type"))
    checked = F.when(F.col("__known"), stage).otherwise(refuse("no case ", "disposition_id"))
    return events.unionByName(new.join(known, "disposition_id", "left").withColumn("event_type", checked).select(events.columns))


def timeline(dispositions: DataFrame, events: DataFrame) -> DataFrame:
    """Events of confirmed cases with their ``place`` in the case, by (time, id)."""
    place = F.row_number().over(Window.partitionBy("disposition_id").orderBy("occurred_at", "event_id"))
    return events.join(dispositions.where("verdict = 'TRUE_POSITIVE'").select("disposition_id"), "disposition_id", "left_semi").withColumn("place", place)


def described(alerts: DataFrame, merchants: DataFrame) -> DataFrame:
    """``alerts`` with their merchant's mcc and its description, borrowed from another of the trade (the first by name) where it has none."""
    borrowed = merchants.where("mcc_description <> ''").groupBy("mcc").agg(F.min("mcc_description").alias("__borrowed"))
    known = merchants.select("merchant_id", "mcc", F.nullif(F.col("mcc_description"), F.lit("")).alias("__own")).join(borrowed, "mcc", "left")
    return alerts.join(known.select("merchant_id", "mcc", F.coalesce("__own", "__borrowed").alias("mcc_description")), "merchant_id", "left")


def runs_by_day(runs: DataFrame) -> DataFrame:
    """(as_of, runs, current_run): of each day its runs and the one that speaks for it, newest day first."""
    live = F.max(F.when(F.col("superseded_at").isNull(), F.col("run_id")))
    return runs.groupBy("as_of").agg(F.count("*").alias("runs"), live.alias("current_run")).orderBy(F.desc("as_of"))


def newest_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("as_of"), F.desc("run_id"))


def first_alert(queue: DataFrame) -> DataFrame:
    """The alert at the head of the queue, whose day the queue is headed with."""
    return queue.orderBy("rank", "alert_id").limit(1)


def ledger_rows(day: DataFrame, own: DataFrame) -> DataFrame:
    """The scored day's rows with ``place`` in their merchant's day, the fence of its own baseline, and whether they are above it."""
    fence = F.when(F.col("usable"), robust.upper_fence(F.col("center"), F.col("dispersion")))
    fenced = own.select("merchant_id", fence.alias("upper_fence"))
    place = F.row_number().over(Window.partitionBy("merchant_id").orderBy("occurred_at", "source_txn_id"))
    marked = F.coalesce(F.col("total_amount") > F.col("upper_fence"), F.lit(False))
    return day.join(fenced, "merchant_id", "left").withColumns({"place": place, "is_outlier": marked})


def inspected(ledger: DataFrame) -> DataFrame:
    """One row: rows, merchants, rows a merchant, least, greatest and mean amount."""
    return ledger.agg(
        F.count("*").alias("rows"), F.countDistinct("merchant_id").alias("merchants"), (F.count("*") / F.countDistinct("merchant_id")).alias("per_merchant"),
        F.min("total_amount").alias("least"), F.max("total_amount").alias("greatest"), F.avg("total_amount").alias("mean"),
    )
