"""Day tables and windows over them: what is shuffled, and that every way of counting gives the fits of the ledger's rows."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from ledgerscope.functions import robust
from ledgerscope.operators import baselines as bl, daytables
from ledgerscope.operators.predicates import Span

LEDGER = "source_txn_id string, merchant_id string, total_amount double, occurred_at timestamp_ntz, is_refund boolean, transaction_status string, card_type string, card_issuing_country string"
DATES = (date(2026, 4, 10), date(2026, 4, 12), date(2026, 4, 15))


def ledger(spark):
    rng = random.Random(7)
    at = lambda d: datetime(2026, 3, 1) + timedelta(days=d, seconds=rng.randrange(86400))
    amount = lambda: rng.choice([None, 0.0, -0.0, 7.5, rng.uniform(1, 90), float("nan")])
    rows = [
        (f"T{m}-{d}-{i}", f"M{m}", amount(), at(d), rng.random() < 0.1, rng.choice([None, "DECLINED", "SUCCESS"]), rng.choice(["VISA", None]), "US")
        for d in range(45) for m in range(5) for i in range(rng.randrange(m * 2 + 2))
    ]
    return spark.createDataFrame(rows, LEDGER)


def text(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_day_table_takes_one_shuffle(spark):
    rows = ledger(spark)
    for name, df in daytables.build(rows).items():
        assert exchanges(df) == 1, name
    peaks = daytables.build(rows)["activity"].where("settled > 0").select("merchant_id", "txn_date", F.col("peak").alias("v"))
    settled = bl.settled(rows, Span(datetime(2026, 1, 1), datetime(2027, 1, 1)), None)
    assert text(peaks) == text(bl.daily_peaks(settled))


def test_every_way_of_counting_gives_the_fits_of_the_ledger(spark, monkeypatch):
    rows = ledger(spark).cache()
    merchants = spark.createDataFrame([(f"M{m}", "ab"[m % 2], "xyz"[m % 3]) for m in range(6)], "merchant_id string, mcc string, merchant_subdistrict string")
    confirmed = spark.createDataFrame([("M2", date(2026, 3, 20))], "merchant_id string, txn_date date")
    days = {name: df.cache() for name, df in daytables.build(rows).items()}
    for few, at_once, cap in ((4096, 8, 200), (30, 1, 9)):
        monkeypatch.setattr(robust, "FEW", few)
        monkeypatch.setattr(daytables, "DATES_AT_ONCE", at_once)
        fit = bl.FitSettings(member_cap=cap, min_members=2)
        w = daytables.Windows(days, merchants, confirmed, DATES, fit)
        made = (
            (daytables.own_amount(w, daytables.own_stats(w)), lambda s: bl.own_amount(rows, merchants, s, confirmed, fit)),
            (daytables.rail_amount(w), lambda s: bl.rail_amount(rows, s, confirmed, fit)),
            (daytables.own_velocity(w), lambda s: bl.own_velocity(rows, s, confirmed, fit)),
            (daytables.cohort_tickets(w, "mcc"), lambda s: bl.cohort_tickets(rows, merchants, "mcc", s, confirmed, fit)),
            (daytables.own_hours(w), lambda s: bl.own_hours(rows, s, fit)),
        )
        for table, plain in made:
            d = DATES[few % 2]
            end = datetime(d.year, d.month, d.day) - timedelta(days=7)
            want = plain(Span(end - timedelta(days=30), end))
            assert text(table.where(F.col("as_of") == F.lit(d.isoformat()).cast("date")).select(want.columns)) == text(want)


def test_a_busy_hour_is_counted_by_running_sums(spark):
    """The row an hour ago is not counted, equal instants are, and no frame slides along the hour, which is quadratic."""
    at = [datetime(2026, 3, 1, 9) + timedelta(microseconds=x) for x in (0, 0, 1, 3_599_999_999, 3_600_000_000, 3_600_000_001)]
    df = spark.createDataFrame([("M", t) for t in at], "merchant_id string, occurred_at timestamp_ntz").withColumn("n", bl.in_last_hour(["merchant_id"]))
    assert sorted(r["n"] for r in df.collect()) == [2, 2, 3, 3, 3, 4]
    assert "3599999999" not in df._jdf.queryExecution().sparkPlan().toString()
