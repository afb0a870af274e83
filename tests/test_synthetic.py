"""The made-up portfolio: equal on any partitioning, and found at production thresholds through a published night."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.detectors import Portfolio, Tuning
from ledgerscope.operators.typology import DEFAULT_RULES
from ledgerscope.plans import nightly
from ledgerscope.sources import fixture, synthetic
from ledgerscope.sources.store import RunStore

AS_OF = datetime(2026, 5, 1)


@pytest.fixture(scope="module")
def night(spark, tmp_path_factory):
    """A whole night with nothing but defaults, published and read back."""
    p = Portfolio(synthetic.ledger(spark, AS_OF), synthetic.merchants(spark), None, AS_OF)
    store = RunStore(spark, str(tmp_path_factory.mktemp("runs")))
    assert (p.tuning, store.load_rules()) == (Tuning(), DEFAULT_RULES)
    run = nightly.night(store, p, fixture.places(spark))
    return store, run


def test_rows_hang_on_their_place_alone(spark):
    one = synthetic.ledger(spark, AS_OF)
    rows = {r["source_txn_id"]: r for r in one.collect()}
    assert len(rows) == one.count() > 15_000
    assert {r["source_txn_id"]: r for r in synthetic.ledger(spark, AS_OF).repartition(7).collect()} == rows
    more = synthetic.ledger(spark, AS_OF, copies=3)
    assert more.count() == 3 * len(rows)
    assert {r["source_txn_id"]: r for r in more.where(~F.col("merchant_id").contains("-")).collect()} == rows
    other = {r["source_txn_id"]: r["total_amount"] for r in synthetic.ledger(spark, AS_OF, seed=8).collect()}
    assert sum(other[i] != r["total_amount"] for i, r in rows.items()) > 0.9 * len(rows)


def test_planted_shapes_are_found(night):
    store, run = night
    alerts = store.read("alerts", current=True).collect()
    hits = {(a["merchant_id"], a["detector"]) for a in alerts}
    assert [t for t in synthetic.TRUTH if t not in hits] == []
    assert not [h for h in hits if h[0] == "STEADY"]
    assert not [h for h in hits if h[0] in ("NEWBIE", "FIXED") and h[1] == "amount_vs_own_baseline"]
    cards = ("card_across_related_merchants", "card_swarm", "impossible_geo_velocity")
    assert not [h for h in hits if h[0].startswith("WALLET") and h[1] in cards]
    assert {m[:4] for m, d in hits if d == "card_across_related_merchants"} == {"RING"}
    assert {m for m, d in hits if d == "impossible_geo_velocity"} == {"FARB"}
    assert [a["rank"] for a in sorted(alerts, key=lambda a: a["rank"])] == list(range(1, len(alerts) + 1))
    assert store.runs().first()["alert_count"] == len(alerts)


def test_every_alert_is_explained_by_frozen_rows(night):
    """Contributions and trails agree with what the alerts claim, and hold no card number."""
    store, _ = night
    alerts = store.read("alerts").collect()
    rows = store.read("contributions").collect()
    counted = {}
    for r in rows:
        key = (r["merchant_id"], r["detector"], r["feature_name"])
        counted[key] = counted.get(key, 0) + 1
    for a in alerts:
        if a["family"] != "C":
            assert counted.get((a["merchant_id"], a["detector"], a["feature_name"]), 0) == a["evidence"], a
    reasons = {(r["merchant_id"], r["detector"]): r["reason"] for r in rows}
    assert reasons["SPIKE", "amount_vs_own_baseline"].startswith("far above this merchant's typical transaction (")
    assert reasons["STRUCT", "structuring_below_threshold"].endswith("% below the HKD 8,000.00 threshold")
    trails = store.read("trails").collect()
    ring = [r for r in trails if r["detector"] == "card_across_related_merchants"]
    assert sorted(r["value"] for r in ring) == ["RINGA", "RINGB", "RINGC", "RINGD"] and all(r["focus"] for r in ring)
    leg = store.read("journeys").first()
    assert (leg["from_merchant"], leg["to_merchant"], leg["minutes"], leg["from_place"], leg["to_place"]) == ("FARA", "FARB", 20.0, "Tuen Mun", "Sai Kung")
    assert not [r for r in (*alerts, *rows, *trails) if any("ring-0" in str(v) or "far-0" in str(v) for v in r)]


def test_profiles_and_cohorts_are_published(night):
    store, run = night
    profiles = {r["merchant_id"]: r for r in store.read("profiles", current=True).collect()}
    assert len(profiles) == len(synthetic.SPECS)
    assert (profiles["STEADY"]["lane"], profiles["NEWBIE"]["lane"], profiles["FIXED"]["own"]["method"]) == ("A", "B", "constant")
    assert profiles["RAMP"]["trend"]["is_ramp"] and profiles["STEADY"]["peer"]["n_merchants"] >= 9
    assert {r["run_id"] for r in store.read("cohorts").collect()} == {run}
    assert store.read("cohort_members").where("mcc = '5944'").count() == 4
