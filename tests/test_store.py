"""Runs, thresholds and rules: a rerun replaces its day, a dead run is invisible, what a run ran under stays on record."""

from datetime import date, datetime, timedelta

import pytest

from ledgerscope.functions import robust
from ledgerscope.operators import alerts, baselines as bl, daytables, profiles
from ledgerscope.operators.baselines import FitSettings
from ledgerscope.operators.detectors import Tuning
from ledgerscope.operators.predicates import Span
from ledgerscope.operators.typology import DEFAULT_RULES, Rule
from ledgerscope.sources.store import RunStore
from pyspark.sql import functions as F

DAY, OTHER = datetime(2026, 5, 1), datetime(2026, 4, 30)


@pytest.fixture()
def store(spark, tmp_path):
    ticks = iter(datetime(2026, 5, 2) + timedelta(minutes=i) for i in range(100))
    return RunStore(spark, str(tmp_path / "store"), lambda: next(ticks))


def found(spark, *merchants):
    return spark.createDataFrame([(m, 0.8, i) for i, m in enumerate(merchants, 1)], "merchant_id string, sub_score double, rank long")


def queue(store):
    return sorted((r["run_id"], r["merchant_id"]) for r in store.read("alerts", current=True).collect())


def test_a_rerun_replaces_the_day_and_stays_on_record(spark, store):
    monday, first = store.open_run(OTHER), store.open_run(DAY, "first pass")
    store.publish(monday, {"alerts": found(spark, "M0")})
    store.publish(first, {"alerts": found(spark, "M1", "M2", "M3")})
    second = store.open_run(DAY, triggered_by="b.lee")
    assert queue(store) == [(monday, "M0"), (first, "M1"), (first, "M2"), (first, "M3")]
    store.publish(second, {"alerts": found(spark, "M2")})
    assert queue(store) == [(monday, "M0"), (second, "M2")]
    assert store.read("alerts").count() == 5
    runs = {r["run_id"]: r for r in store.runs().collect()}
    assert runs[first]["superseded_at"] == runs[second]["finished_at"] and runs[second]["superseded_at"] is None and runs[monday]["superseded_at"] is None
    assert [runs[r]["alert_count"] for r in (monday, first, second)] == [1, 3, 1]
    assert (runs[first]["label"], runs[second]["triggered_by"]) == ("first pass", "b.lee")


def test_a_dead_run_is_invisible_and_can_be_repeated(spark, store):
    a = store.open_run(DAY)
    store.publish(a, {"alerts": found(spark, "M1")})
    b = store.open_run(DAY)
    half = f"{store.folder}/tables/alerts/as_of={DAY.date()}/run_id={b}/attempt=half"
    found(spark, "M8", "M9").write.parquet(half)
    assert queue(store) == [(a, "M1")] and {r["run_id"] for r in store.runs().collect()} == {a}
    store.publish(b, {"alerts": found(spark, "M2")})
    assert queue(store) == [(b, "M2")]
    store.publish(b, {"alerts": found(spark, "M3")})  # published again: in its own place
    assert queue(store) == [(b, "M3")] and store.read("alerts").count() == 2
    c = store.open_run(DAY)
    assert c == b + 1
    assert store.vacuum() == 2 and queue(store) == [(b, "M3")]  # the half attempt and the one that was replaced


def test_decisions_outlive_their_run(spark, store):
    a = store.open_run(DAY)
    store.publish(a, {"alerts": found(spark, "M1", "M2").withColumn("alert_id", F.col("rank"))})
    store.append("dispositions", spark.createDataFrame([(1, "TRUE_POSITIVE")], "alert_id long, verdict string"))
    b = store.open_run(DAY)
    store.publish(b, {"alerts": found(spark, "M2").withColumn("alert_id", F.col("rank") + 10)})
    decided = store.records("dispositions", "alert_id long, verdict string")
    days = alerts.confirmed_days(store.read("alerts").withColumn("created_at", F.col("as_of").cast("timestamp_ntz")), decided, by="scored")
    assert [(r["merchant_id"], r["txn_date"]) for r in days.collect()] == [("M1", date(2026, 4, 30))]


def test_thresholds_are_replaced_whole_and_captured_at_opening(spark, store):
    assert store.load_settings() == (Tuning(), FitSettings()) and store.load_rules() == DEFAULT_RULES
    run = store.open_run(DAY)
    tuned = Tuning(4.0, 0.0, {"5944": {"outlier_z": 6.0}})
    store.save_settings(tuned, FitSettings(lag_days=3, window_days=60), "a.chan")
    store.save_settings(Tuning(3.0, 10.0), FitSettings(), "b.lee")
    assert store.load_settings() == (Tuning(3.0, 10.0), FitSettings())
    assert store.settings_of_run(run)[:2] == (Tuning(), FitSettings())
    after = store.open_run(DAY)
    assert store.settings_of_run(after)[0] == Tuning(3.0, 10.0)
    versions = store.history().where("key = 'detection'").orderBy("version").collect()
    assert [(r["version"], r["updated_by"], r["settings"]["outlier_z"]) for r in versions] == [(1, "a.chan", 4.0), (2, "b.lee", 3.0)]
    assert versions[0]["settings"]["mcc_overrides"]["5944"]["outlier_z"] == 6.0


def test_rules_are_replaced_whole_and_refused_whole(spark, store):
    strict = Rule("structuring_below_threshold", {"threshold": 50000}, "jewellers", True, ("5944",), True, "Jewellers")
    store.save_rules([Rule("card_swarm", enabled=False), strict])
    assert store.load_rules() == [Rule("card_swarm", {}, "card_swarm", False), strict]
    with pytest.raises(ValueError):
        store.save_rules([strict, strict])
    with pytest.raises(ValueError):
        store.save_rules([Rule("card_swarm", mcc_scope=("5944",))])
    assert len(store.load_rules()) == 2
    with pytest.raises(ValueError):
        store.publish(99, {})


LEDGER = "source_txn_id string, merchant_id string, total_amount double, occurred_at timestamp_ntz, is_refund boolean, transaction_status string, card_type string, card_issuing_country string"


def rows(day, n, amount=10.0, merchant="M1"):
    at = datetime(2026, 3, 1) + timedelta(days=day)
    return [(f"{merchant}-{day}-{i}", merchant, amount + i % 3, at + timedelta(minutes=7 * i), i % 11 == 10, "DECLINED" if i % 5 == 4 else None, "VISA", "US" if i % 4 == 0 else "HK") for i in range(n)]


def test_a_new_day_reads_no_other_and_a_corrected_day_replaces_itself(spark, tmp_path):
    old = [r for d in range(6) for r in rows(d, 20)]
    store = daytables.DayStore(spark, str(tmp_path / "days"))
    store.load(spark.createDataFrame(old, LEDGER))
    # what is handed over holds the new day alone
    store.update(spark.createDataFrame(rows(6, 30), LEDGER), [date(2026, 3, 7)])
    whole = spark.createDataFrame(old + rows(6, 30), LEDGER)
    for name, df in daytables.build(whole).items():
        cols = sorted(df.columns)
        assert sorted(map(str, store.read()[name].select(cols).collect())) == sorted(map(str, df.select(cols).collect())), name
    store.update(spark.createDataFrame(rows(2, 3), LEDGER), [date(2026, 3, 3), date(2026, 3, 4)])
    left = {r["txn_date"]: r["attempts"] for r in store.read()["activity"].collect()}
    assert left[date(2026, 3, 3)] == 3 and date(2026, 3, 4) not in left and left[date(2026, 3, 7)] == 30


def test_windows_of_dates_equal_fits_of_the_ledger(spark):
    ledger = spark.createDataFrame([r for d in range(45) for m, k in (("M1", 9), ("M2", 13), ("M3", 4)) for r in rows(d, (d * k) % 7 + 1, 10.0 + k, m)], LEDGER)
    merchants = spark.createDataFrame([("M1", "a", "x"), ("M2", "a", "x"), ("M3", "a", "y"), ("M4", "b", "y")], "merchant_id string, mcc string, merchant_subdistrict string")
    confirmed = spark.createDataFrame([("M2", date(2026, 3, 20))], "merchant_id string, txn_date date")
    dates = [date(2026, 4, 10), date(2026, 4, 15)]
    w = daytables.Windows(daytables.build(ledger), merchants, confirmed, tuple(dates))
    stats = daytables.own_stats(w)
    for d in dates:
        end = datetime(d.year, d.month, d.day) - timedelta(days=7)
        span = Span(end - timedelta(days=30), end)
        for made, plain in (
            (daytables.own_amount(w, stats), bl.own_amount(ledger, merchants, span, confirmed)),
            (daytables.peer_amount(w, stats), bl.peer_amount(ledger, merchants, span, confirmed)),
            (daytables.cohort_tickets(w, "mcc"), bl.cohort_tickets(ledger, merchants, "mcc", span, confirmed)),
        ):
            got = made.where(F.col("as_of") == F.lit(d.isoformat()).cast("date")).select(plain.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_no_task_sorts_the_values_of_a_key(spark):
    """One key with 200,000 different values: the largest window of the selection holds a small part of them."""
    n = 200_000
    values = spark.range(n).select(F.lit("M").alias("k"), (F.col("id") * 7919 % n / 3.0 + 5).alias("v"))
    got = robust.robust_stats(values, ["k"], F.col("v")).first()
    plain = sorted(i / 3.0 + 5 for i in range(n))
    median = lambda xs: (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2
    center = median(plain)
    assert (got["n"], got["center"], got["q1"], got["q3"]) == (n, center, median(plain[: n // 2]), median(plain[n // 2 :]))
    assert abs(got["mad"] - median(sorted(abs(v - center) for v in plain))) < 1e-9
    hist = values.groupBy("k", "v").agg(F.count("*").alias("c"))
    ranked = robust._ranked(hist, ["k"], [F.lit(n // 2), F.lit(n // 4)])
    assert ranked.count() < 200
    assert hist.select(robust._bucket(F.col("v"))).distinct().count() < n // 4


def test_latest_profile(spark):
    p = spark.createDataFrame([("M1", date(2026, 5, 1), 1, "old"), ("M1", date(2026, 5, 2), 2, "a"), ("M1", date(2026, 5, 2), 3, "b"), ("M2", date(2026, 4, 1), 1, "c")], "merchant_id string, as_of date, run_id long, x string")
    assert sorted((r["merchant_id"], r["x"]) for r in profiles.latest(p).collect()) == [("M1", "b"), ("M2", "c")]
