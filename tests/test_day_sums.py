"""Sums of a day's amounts, of which medians are rounded at a half."""

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerscope.functions import robust
from ledgerscope.operators import baselines as bl

AS_OF = datetime(2024, 1, 31)


def test_day_sums_are_those_of_doubles_in_order_so_that_halves_fall_as_in_sql(spark):
    """The median of 79.13 and a sum of 90.52000000000001 is 84.825, that of 79.13 and 90.52 a little less."""
    amounts = [[79.13], [30.07, 17.77, 42.68]]
    sums = [0.0, 0.0]
    for d, of in enumerate(amounts):
        for x in of:
            sums[d] += x
    rows = [(f"T{d}{k}", "M1", x, AS_OF - timedelta(days=5 + d) + timedelta(minutes=k), False, "SUCCESS") for d, of in enumerate(amounts) for k, x in enumerate(of)]
    ledger = spark.createDataFrame(rows, "source_txn_id string, merchant_id string, total_amount double, occurred_at timestamp_ntz, is_refund boolean, transaction_status string").coalesce(1)
    got = bl.daily_value(ledger, AS_OF)
    assert sums[1] == 90.52000000000001 and sorted(r["gross"] for r in got.collect()) == sums
    middle = got.agg(robust.rounded(F.median("gross"), 2)).first()[0]
    assert middle == 84.83 and math.floor((79.13 + 90.52) / 2 * 100 + 0.5) / 100 == 84.82
