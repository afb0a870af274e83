"""Rules about cards on a replayed day, and days that are closed by a stream."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import rings
from ledgerscope.plans import registry as reg
from ledgerscope.sources import fixture
from ledgerscope.sources.ledger_store import LedgerStore
from ledgerscope.sources.store import RunStore
from ledgerscope.streaming import cards
from ledgerscope.streaming.closing import Closer

SMALL = "/root/testdata/sf0.01"


def test_a_replayed_day_finds_what_the_night_finds(spark, tmp_path):
    p = reg.portfolio(spark, SMALL)
    rules = {r.template: r for r in reg.RULES}
    swarm, travel = rules["card_swarm"], rules["impossible_geo_velocity"]
    places = fixture.places(spark)
    day = p.day().select("source_txn_id", "merchant_id", "occurred_at", "is_refund", "card_type", "hashed_pan")
    # three deliveries out of order within the allowed lateness, and a row far ahead that ends all state
    parts = day.withColumn("part", F.pmod(F.xxhash64("source_txn_id"), F.lit(3)))
    for k in range(3):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    end = spark.createDataFrame([("END", "M0", datetime(2024, 2, 3), False, "VISA", "sentinel")], day.schema)
    end.coalesce(1).write.parquet(str(tmp_path / "in/8"))
    end.withColumn("source_txn_id", F.lit("END2")).withColumn("occurred_at", F.col("occurred_at") + F.make_dt_interval(F.lit(5))).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    merchants = p.merchants.cache()
    batches = []
    stream = spark.readStream.schema(day.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = cards.watch(cards.card_rows(stream, merchants, places), swarm, travel, "2 days")
    query = found.writeStream.foreachBatch(lambda df, i: batches.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    progress = [x for x in query.recentProgress if x["stateOperators"]]
    got = sorted((r["source_txn_id"], r["touched"], r["apart"]) for r in batches if r["kind"] == "card_swarm")
    want = sorted((r["last"], r["touched"], r["apart"]) for r in rings.swarm_windows(p, swarm).collect())
    assert got == want != []
    legs = sorted((r["from_source_txn_id"], r["source_txn_id"], round(r["kmh"], 4)) for r in batches if r["kind"] == "impossible_geo_velocity")
    assert legs == sorted((r["from_source_txn_id"], r["source_txn_id"], round(r["kmh"], 4)) for r in rings.legs(p, places, travel).collect()) != []
    # after the day has expired only the last sentinel's card is left
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


LEDGER = "source_txn_id string, merchant_id string, occurred_at timestamp_ntz, total_amount double, arrival long"


def rows(spark, *items):
    return spark.createDataFrame([(i, "M", datetime(2026, 3, 1) + timedelta(days=d, hours=h), 1.0, k) for k, (i, d, h) in enumerate(items)], LEDGER)


@pytest.fixture()
def closer(spark, tmp_path):
    ticks = iter(datetime(2026, 4, 1) + timedelta(minutes=i) for i in range(1000))
    clock = lambda: next(ticks)
    ledger, runs = LedgerStore(spark, str(tmp_path / "ledger"), 2, clock), RunStore(spark, str(tmp_path / "runs"), clock)

    def score(as_of, label):
        run = runs.open_run(as_of, label)
        day = (as_of - timedelta(days=1)).date()
        runs.publish(run, {"alerts": ledger.ledger().where(F.col("txn_date") == F.lit(day.isoformat()).cast("date")).select("merchant_id", "source_txn_id")})
        return run

    return Closer(ledger, runs, score)


def seen(closer):
    return sorted((r["as_of"], r["source_txn_id"]) for r in closer.runs.read("alerts", current=True).collect())


def test_days_close_once_and_late_rows_reopen_them(spark, closer):
    closer(rows(spark, ("a", 0, 1), ("b", 0, 20)), 0)
    assert closer.runs.runs().isEmpty()
    closer(rows(spark, ("c", 1, 8)), 1)  # not yet nine hours into the next day
    assert closer.runs.runs().isEmpty()
    closer(rows(spark, ("d", 1, 23), ("a", 0, 1)), 2)
    assert seen(closer) == [(date(2026, 3, 2), "a"), (date(2026, 3, 2), "b")]
    closer(rows(spark, ("e", 0, 23), ("f", 2, 12)), 3)  # a late row of the first day, and the second is over
    assert seen(closer) == [(date(2026, 3, 2), "a"), (date(2026, 3, 2), "b"), (date(2026, 3, 2), "e"), (date(2026, 3, 3), "c"), (date(2026, 3, 3), "d")]
    assert closer.runs.runs().count() == 3 and closer.runs.runs().where("superseded_at is null").count() == 2


def test_a_batch_that_died_half_way_gives_no_double_alerts(spark, closer):
    batch = rows(spark, ("a", 0, 1), ("b", 1, 1), ("c", 2, 12))
    real, scored = closer.score, []

    def dies(as_of, label):
        if scored:
            raise RuntimeError("lost")
        scored.append(as_of)
        return real(as_of, label)

    closer.score = dies
    with pytest.raises(RuntimeError):
        closer(batch, 0)
    assert seen(closer) == [(date(2026, 3, 2), "a")]
    closer.score = real
    closer(batch, 0)  # the stream repeats the batch after its restart
    closer(batch, 0)
    assert seen(closer) == [(date(2026, 3, 2), "a"), (date(2026, 3, 3), "b")]
    assert closer.runs.runs().count() == 2
