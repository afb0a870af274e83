"""Ledger operators at their boundaries."""

import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import density, geo, robust
from ledgerscope.operators import alerts, predicates as pr, typology
from ledgerscope.operators.typology import Rule
from ledgerscope.sources import ingest


def halves(v):
    v, n = sorted(v), len(v)
    return (v[0], v[0]) if n == 1 else (statistics.median(v[: n // 2]), statistics.median(v[(n + 1) // 2 :]))


def test_robust_stats_against_python(spark):
    rnd = random.Random(1)
    groups = {k: [round(rnd.gauss(50, 20), 1) for _ in range(n)] for k, n in enumerate((1, 2, 3, 4, 5, 8, 31, 200))} | {9: [7.0] * 20}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(1, None)]
    got = {r["k"]: r for r in robust.robust_stats(spark.createDataFrame(rows, "k int, v double"), ["k"], F.col("v")).collect()}
    for k, vs in groups.items():
        c = statistics.median(vs)
        want = (len(vs), c, statistics.median([abs(v - c) for v in vs]), *halves(vs))
        assert (got[k]["n"], *[pytest.approx(got[k][x]) for x in ("center", "mad", "q1", "q3")]) == want


def test_fit_cascade(spark):
    rows = [("short", 3, 5.0, 1.0, 4.0, 6.0), ("mad", 20, 5.0, 1.0, 4.0, 6.0), ("iqr", 20, 5.0, 0.0, 4.0, 6.0), ("constant", 20, 5.0, 0.0, 5.0, 5.0), ("none", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, n int, center double, mad double, q1 double, q3 double")
    got = {r["k"]: (r["method"], r["dispersion"], r["center"]) for r in robust.fit(df, 12).collect()}
    assert got == {"short": ("insufficient_data", 0, 5), "mad": ("mad", 1, 5), "iqr": ("scaled_iqr", 1, 5), "constant": ("constant", 0, 5), "none": ("insufficient_data", 0, 0)}
    floored = {r["k"]: (r["method"], r["dispersion"]) for r in robust.fit(df, 12, 2.0).collect()}
    assert floored["constant"] == ("mad", 2) and floored["mad"] == ("mad", 2)


def test_settled_and_refund_predicates(spark):
    rows = [("SUCCESS", False), ("DECLINED", False), ("declined", False), (None, False), ("", False), ("REVERSED", False), ("SUCCESS", True), ("PENDING", None)]
    df = spark.createDataFrame(rows, "transaction_status string, is_refund boolean").withColumn("ok", pr.settled_sale())
    assert [r["ok"] for r in df.collect()] == [True, False, True, True, True, False, False, True]


def test_card_rails(spark):
    rows = [("VISA", "p"), ("  wechat  ", "p"), ("tap&go", "p"), (None, "p"), ("", "p"), ("VISA", " "), ("VISA", None)]
    df = spark.createDataFrame(rows, "card_type string, hashed_pan string").withColumn("ok", pr.has_card())
    assert [r["ok"] for r in df.collect()] == [True, False, False, True, True, False, False]


def test_spans_are_half_open(spark):
    span = pr.baseline_span(datetime(2024, 2, 1), 30, 7)
    assert (span.start, span.end) == (datetime(2023, 12, 26), datetime(2024, 1, 25))
    df = spark.sql("SELECT explode(array(timestamp_ntz'2023-12-26', timestamp_ntz'2024-01-24 23:59:59.999999', timestamp_ntz'2024-01-25')) AS t")
    assert [r["ok"] for r in df.select(span.holds(F.col("t")).alias("ok")).collect()] == [True, True, False]


def test_distance_and_speed(spark):
    km = spark.range(1).select(geo.haversine(F.lit(22.28), F.lit(114.16), F.lit(22.38), F.lit(114.19)).alias("d"), geo.speed(F.lit(10.0), F.lit(0)).alias("s")).first()
    assert km["d"] == pytest.approx(11.54, abs=0.05) and km["s"] is None


def test_severity_orders_by_volume(spark):
    got = [spark.range(1).select(density.temporal_severity(F.lit(n), F.lit(500), F.lit(0.5)).alias("v")).first()["v"] for n in (0, 1, 5, 40, 400)]
    assert got[0] == 0 and got == sorted(got) and got[-1] <= 1


def test_rule_sets_are_validated():
    typology.validate(typology.DEFAULT_RULES)
    for bad in ([Rule("nothing")], [Rule("bust_out"), Rule("bust_out")], [Rule("bust_out", {"spike_ratio": 99})], [Rule("bust_out", {"x": 1})], [Rule("card_swarm", mcc_scope=("5411",))]):
        with pytest.raises(ValueError):
            typology.validate(bad)
    typology.validate([Rule("bust_out"), Rule("bust_out", {"spike_ratio": 5}, "bust_out_2", mcc_scope=("5411",))])


def test_alert_types_cover_all_rules(spark):
    names = [*typology.TEMPLATES, "count_vs_own_baseline", "unknown"]
    got = {r["d"]: r["t"] for r in spark.createDataFrame([(n,) for n in names], "d string").select("d", alerts.alert_type(F.col("d")).alias("t")).collect()}
    assert got["bust_out"] == "typology_match" and got["card_swarm"] == "ring_signal" and got["unknown"] == got["count_vs_own_baseline"] == "single_txn_spike"


def test_csv_with_flexible_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Txn ID, Merchant,AMOUNT,Transaction-Time,Status,note\nT1, M1 ,-5.5,2024-01-02T03:04:05+08:00,open,x\nT2,M1,,2024-01-02,,\nT3,M2,7\n")
    rows = ingest.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert [r["payment_id"] for r in rows.collect()] == ["T1"] and rows.columns == ["payment_id", "merchant_id", "total_amount", "hkt_transaction_time", "merchant_status"]
    r = ingest.to_ledger(rows).first()
    assert (r["total_amount"], r["is_refund"], str(r["occurred_at"])) == (5.5, True, "2024-01-02 03:04:05")
    (tmp_path / "b.csv").write_text("id,amount\n1,2\n")
    with pytest.raises(ValueError, match="merchant_id, hkt_transaction_time"):
        ingest.read_csv(spark, f"file://{tmp_path}/b.csv")


@pytest.mark.parametrize("text", ['[{"payment_id":"a"},{"payment_id":"b"}]', '{"rows":[{"payment_id":"a"},{"payment_id":"b"}]}', '{"payment_id":"a"}\n{"payment_id":"b"}\n', '{"meta":1,\n "records":[{"payment_id":"a"},\n{"payment_id":"b"}]}'])
def test_json_payloads(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    assert sorted(r["payment_id"] for r in ingest.read_json(spark, f"file://{tmp_path}/p.json").collect()) == ["a", "b"]


def test_ingest_is_idempotent(spark):
    rows = spark.createDataFrame([("T1", 1, "first"), ("T1", 2, "second"), ("T2", 3, "x")], "source_txn_id string, seq int, v string")
    got = ingest.new_rows(rows, spark.createDataFrame([("T2",)], "source_txn_id string"), "seq").collect()
    assert [(r["source_txn_id"], r["v"]) for r in got] == [("T1", "first")]


def test_merchants_keep_their_latest_value(spark):
    stored = spark.createDataFrame([("M1", "5411", "old"), ("M3", "1", "c")], "merchant_id string, mcc string, city string")
    rows = spark.createDataFrame([("M1", " ", "new", 1), ("M1", "", " ", 2), ("M2", None, "b", 3)], "merchant_id string, mcc string, city string, seq int")
    got = {r["merchant_id"]: (r["mcc"], r["city"]) for r in ingest.upsert_merchants(stored, rows, "seq").collect()}
    assert got == {"M1": ("5411", "new"), "M2": ("", "b"), "M3": ("1", "c")}


def test_ranks_are_dense_and_total(spark):
    hits = spark.createDataFrame([(f"M{i % 7}", "A", f"d{i % 3}", (i % 5) / 10, "f", float(i), 0.0, 0.0, 1) for i in range(100)], "merchant_id string, family string, detector string, sub_score double, feature_name string, merchant_value double, baseline_value double, deviation double, evidence long")
    got = sorted(alerts.rank(hits, spark.createDataFrame([("M1", "A")], "merchant_id string, lane string")).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 101))
    keys = [(-r["sub_score"], r["merchant_id"], r["detector"], r["merchant_value"]) for r in got]
    assert keys == sorted(keys) and {r["lane"] for r in got} == {"A", "B"}


def test_json_files_of_all_kinds_in_one_folder(spark, tmp_path):
    (tmp_path / "array.json").write_text('[\n {"payment_id": "a", "total_amount": 1}\n]')
    (tmp_path / "lines.json").write_text('{"payment_id": "b"}\n\n{"payment_id": "c", "mcc": "5411"}\n')
    (tmp_path / "wrapped.json").write_text('{"n": 1, "rows": [{"payment_id": "d"}, {"payment_id": "e"}]}')
    (tmp_path / "one.json").write_text('{\n "payment_id": "f"\n}')
    (tmp_path / "empty.json").write_text("")
    got = {r["payment_id"]: (r["total_amount"], r["mcc"]) for r in ingest.read_json(spark, str(tmp_path)).collect()}
    assert got == {"a": ("1", None), "b": (None, None), "c": (None, "5411"), "d": (None, None), "e": (None, None), "f": (None, None)}
    only = ingest.read_json(spark, str(tmp_path / "lines.json"))
    assert sorted(r["payment_id"] for r in only.collect()) == ["b", "c"]


def test_rows_without_a_readable_time_are_refused(spark):
    rows = [("a", "m", "1", "2024-01-02T03:04:05+08:00"), ("b", "m", "2", "yesterday"), ("c", "m", "3", None)]
    df = spark.createDataFrame(rows, "payment_id string, merchant_id string, total_amount string, hkt_transaction_time string")
    assert sorted(r["payment_id"] for r in ingest.unreadable(df).collect()) == ["b", "c"]
    assert ingest.to_ledger(df.where("payment_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="no readable time"):
        ingest.to_ledger(df).select("occurred_at").collect()


def test_a_cut_line_loses_no_other(spark, tmp_path):
    good = [f'{{"payment_id": "{c}", "total_amount": 1}}' for c in "abcde"]
    for name, lines in {"middle": [*good[:3], '{"payment_id": "x", "tot', *good[3:]], "first": ['{"payment_id": "x"', *good], "last": [*good, '{"payment_id": "x"']}.items():
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(lines))
        assert sorted(r["payment_id"] for r in ingest.read_json(spark, str(path), bad="skip").collect()) == list("abcde")
        assert [r["value"] for r in ingest.unparsed(spark, str(path)).collect()] == [x for x in lines if x not in good]
        with pytest.raises(Exception, match="no JSON in"):
            ingest.read_json(spark, str(path)).collect()
    broken = tmp_path / "broken.json"
    broken.write_text('[{"payment_id": "a"},\n{"payment_id": "b"')
    with pytest.raises(Exception, match="no JSON in"):
        ingest.read_json(spark, str(broken)).collect()
    assert ingest.read_json(spark, str(broken), bad="skip").count() == 0 and ingest.unparsed(spark, str(broken)).count() == 1
