"""Results that may not hang on the order of rows, and halves that are rounded as SQL rounds them."""

import math
import random

from pyspark.sql import functions as F

from ledgerscope.functions import density, robust
from ledgerscope.operators import alerts
from ledgerscope.plans import desk, registry


def plain_density(bins, n):
    width = 4.0 if n <= 1 else min(max(2.5 * n**-0.2, 0.25), 4.0)
    kappa = 1 / (2 * math.pi * width / 24) ** 2
    k = [math.exp(kappa * (math.cos(2 * math.pi * o / 96) - 1)) for o in range(96)]
    raw = [sum(w * k[(j - i) % 96] for i, w in sorted(bins.items())) for j in range(96)]
    dense = [x / (sum(raw) * 0.25) for x in raw]
    cum, threshold = 0.0, 0.0
    for d, w in sorted((dense[i], w) for i, w in bins.items()):
        cum += w
        if cum >= 0.05 * sum(bins.values()):
            threshold = d
            break
    return dense, threshold, dense.index(max(dense)) * 0.25


def test_density_in_the_order_of_the_day(spark):
    rng = random.Random(3)
    keys = {f"M{m}": {i: float(rng.randint(1, 9)) for i in rng.sample(range(96), rng.randint(1, 60))} for m in range(12)}
    keys["alike"] = {i: 1.0 for i in range(0, 96, 8)}
    rows = [(m, i, w, int(sum(b.values()))) for m, b in keys.items() for i, w in b.items()]
    seen = []
    for parts in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "m string, bin int, w double, n long").repartition(parts)
        got = {r["m"]: r for r in density.estimate(df, ["m"], 0.05).collect()}
        seen.append({m: (r["density"], r["threshold"], r["peak_hour"]) for m, r in got.items()})
        assert len(got) == len(keys)
        for m, b in keys.items():
            dense, threshold, peak = plain_density(b, int(sum(b.values())))
            assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(got[m]["density"], dense))
            assert math.isclose(got[m]["threshold"], threshold, rel_tol=1e-12)
            assert m == "alike" or got[m]["peak_hour"] == peak
    assert seen[0] == seen[1]
    # rows of one key are not spread to 96 each before they are grouped
    assert "Generate" not in density.estimate(df, ["m"], 0.05)._jdf.queryExecution().optimizedPlan().toString()


def test_halves_are_rounded_as_doubles(spark):
    values = (0.01775, 57.645, 1.005, -2.5, 0.5, 1.15, 1e17, float("inf"))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: (r["four"], r["two"], r["none"]) for r in df.select("v", *[robust.rounded(F.col("v"), n).alias(a) for a, n in (("four", 4), ("two", 2), ("none", 0))]).collect()}
    away = lambda v, n: v if math.isinf(v) else math.copysign(math.floor(abs(v) * 10**n + 0.5) / 10**n, v)
    assert got == {v: (away(v, 4), away(v, 2), away(v, 0)) for v in values}
    assert got[0.01775][0] == 0.0177


def test_equal_alerts_keep_their_order(spark):
    hits = [("M1", "C", "card_swarm", 0.6, "f", 2.0, 2.0, 0.0, e) for e in range(40)]
    schema = "merchant_id string, family string, detector string, sub_score double, feature_name string, merchant_value double, baseline_value double, deviation double, evidence long"
    lanes = spark.createDataFrame([("M1", "A")], "merchant_id string, lane string")
    ranks = []
    for seed in (1, 2):
        random.Random(seed).shuffle(hits)
        out = alerts.rank(spark.createDataFrame(hits, schema).repartition(5), lanes)
        ranks.append({r["rank"]: r["evidence"] for r in out.collect()})
    assert ranks[0] == ranks[1] and sorted(ranks[0]) == list(range(1, 41))


def test_openings_of_a_large_store(spark, monkeypatch):
    """The store's own decisions reach the numbers of the new ones; the twin opens their cases likewise."""
    alert = spark.sql("SELECT * FROM VALUES (1500003L, TIMESTAMP_NTZ '2024-01-02 00:00:00'), (9L, TIMESTAMP_NTZ '2024-01-03 00:00:00') AS t(alert_id, created_at)")
    disposition = alert.select((F.col("alert_id") + 1_000_000).alias("disposition_id"), "alert_id", F.lit("TRUE_POSITIVE").alias("verdict"), F.col("created_at").alias("decided_at"))
    events = disposition.limit(0).select(F.col("disposition_id").alias("event_id"), "disposition_id", F.lit("CLEARED").alias("event_type"), F.col("decided_at").alias("occurred_at"))
    monkeypatch.setattr(registry, "store", lambda p: (None, alert, disposition, events))
    got = [(r["event_id"], r["event_type"]) for r in alerts.timeline(*desk._decided(None)).collect()]
    assert got == [(-2500003, "OPENED")]


def test_few_values_are_gathered_and_many_are_not(spark, monkeypatch):
    """Both ways give equal statistics; keys with few values take fewer shuffles than the buckets do."""
    rng = random.Random(5)
    rows = [(f"M{m}", rng.choice([1.5, -2.0, 0.0, float("nan")]) if m % 3 == 0 else rng.uniform(-5, 900)) for m in range(9) for _ in range([1, 2, 3, 4, 5, 8, 41, 200, 333][m])]
    df = spark.createDataFrame([*rows, ("M1", None)], "m string, v double").repartition(3)
    text = lambda out: sorted((r["m"], r["n"], *(f"{r[c]!r}" for c in ("center", "mad", "q1", "q3"))) for r in out.collect())
    stats = lambda: robust.robust_stats(df, ["m"], F.col("v"))
    got = {}
    for few in (4096, 40, 0):
        monkeypatch.setattr(robust, "FEW", few)
        got[few] = text(stats())
    assert got[4096] == got[40] == got[0] and len(got[0]) == 9
    hist = robust._histogram(df, ["m"], F.col("v"))
    shuffles = lambda out: out._jdf.queryExecution().sparkPlan().toString().count("Window ")
    assert shuffles(robust._gathered(hist, ["m"])) == 0 < shuffles(robust._by_bucket(hist, ["m"]))
