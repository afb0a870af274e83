"""Linked transactions: a card's day across merchants, with gaps, owner groups and the legs that condemn it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.robust import rounded
from ledgerscope.operators.predicates import micros
from ledgerscope.operators.rings import identities
from ledgerscope.sources import tables


def owner_groups(members: DataFrame, merchants: DataFrame, case: list[str]) -> DataFrame:
    """(case, merchant_id, leader): of each case's merchants that share a registration value with another of it, the one that names their group.

    In order of their ids a merchant leads a group unless one before it leads it already; it then
    belongs to the first leader that it shares a value with. No pairs are made: a round takes, along
    each value, the least id that is undecided. Those that are least along all their values lead,
    and all along their values are decided; chains of relatives take a few rounds, cliques one.
    """
    values = identities(merchants)
    key = [*case, "attribute", "value"]
    each = members.select(*case, "merchant_id").distinct().join(values, "merchant_id")
    shared = each.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    todo = tables.write(each.join(shared, key), "owner-ties")
    ties, leaders = todo, todo.select(*case, "merchant_id").limit(0)
    while not todo.isEmpty():
        least = todo.groupBy(*key).agg(F.min("merchant_id").alias("least"))
        leads = todo.join(least, key).groupBy(*case, "merchant_id").agg(F.min(F.col("least") == F.col("merchant_id")).alias("leads")).where("leads").drop("leads")
        leads = tables.write(leads, "owner-leaders")
        leaders = leaders.unionByName(leads)
        led = todo.join(leads, [*case, "merchant_id"]).select(*key).distinct()
        decided = todo.join(led, key).select(*case, "merchant_id").distinct()
        todo = tables.write(todo.join(decided, [*case, "merchant_id"], "left_anti"), "owner-ties")
    # a leader of a later round may come before one of an earlier round, so members are dealt when all are known
    led = ties.join(leaders, [*case, "merchant_id"]).groupBy(*key).agg(F.min("merchant_id").alias("leader"))
    return ties.join(led, key).groupBy(*case, "merchant_id").agg(F.min("leader").alias("leader"))


def labelled(groups: DataFrame, case: list[str]) -> DataFrame:
    """``groups`` with ``owner_group``: Chain A, Chain B and so on, in order of the leaders' ids; beyond Z the characters that follow it."""
    leaders = groups.select(*case, "leader").distinct()
    k = F.row_number().over(Window.partitionBy(*case).orderBy("leader"))
    name = F.concat(F.lit("Chain "), F.decode(F.unhex(F.lpad(F.hex(F.lit(64) + k), 8, "0")), "UTF-32"))
    return groups.join(leaders.withColumn("owner_group", name), [*case, "leader"]).drop("leader")


def linked_transactions(trails: DataFrame, ledger: DataFrame, merchants: DataFrame, journeys: DataFrame | None = None) -> DataFrame:
    """A row for each transaction of each case's trail, in ``place`` order: merchant, amount, owner group, minutes since the one before, arriving leg.

    ``trails`` are those of ``rings.trails``, as they were frozen: transactions are looked up by id,
    never by card. A leg's figures stand with the transaction that it arrives at, for cases of
    impossible travel alone.
    """
    case = ["detector", "subject"]
    rows = trails.join(ledger.select("source_txn_id", "merchant_id", "total_amount", "card_type"), "source_txn_id")
    known = merchants.select("merchant_id", "mcc", "mcc_description", "merchant_district", "merchant_subdistrict")
    groups = labelled(owner_groups(rows, merchants, case), case)
    w = Window.partitionBy(*case).orderBy("occurred_at", "source_txn_id")
    gap = rounded((F.col("t") - F.lag("t").over(w)) / 60_000_000, 1)
    timed = rows.withColumn("t", micros()).withColumns({"place": F.row_number().over(w), "minutes_since_previous": gap}).drop("t")
    out = timed.join(known, "merchant_id", "left").join(groups, [*case, "merchant_id"], "left").withColumn("is_alert_merchant", F.col("merchant_id") == F.col("carrier"))
    if journeys is None:
        return out.withColumns({"arrived_at_kmh": F.lit(None).cast("double"), "arrived_from_km": F.lit(None).cast("double")})
    legs = journeys.select(F.lit("impossible_geo_velocity").alias("detector"), "subject", F.col("to_txn_id").alias("source_txn_id"), F.col("kmh").alias("arrived_at_kmh"), F.col("distance_km").alias("arrived_from_km"))
    return out.join(legs, [*case, "source_txn_id"], "left")


def rolled_up(linked: DataFrame) -> DataFrame:
    """Per case and merchant: transactions, value, first and last time; where the card went, in a case's header."""
    return linked.groupBy("detector", "subject", "merchant_id", "owner_group", "is_alert_merchant").agg(
        F.count("*").alias("transactions"), F.sum("total_amount").alias("total_amount"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen")
    )
