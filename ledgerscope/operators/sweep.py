"""Distinct merchants of a card in a sliding span, and those with no relative among them, by sweeping along time.

A merchant is alive for a card from a visit until ``reach`` after the last of visits that are no
farther apart than that; what a window that ends at an event holds is what is alive then. Counts are
running sums of +1 and -1 where lives begin and end, so the work is that of sorting the card's
events, whatever the number of events in a window. No window's content is ever gathered.

Positions are (t, kind, id): beginnings are events (kind 0); ends (kind 1) come after all events of
their instant, as both ends of a window belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POSITION = ("t", "kind", "id")


def lives(events: DataFrame, card: str, merchant: str, reach: int) -> DataFrame:
    """(card, merchant, life, t, id, until): stretches of time in which a merchant is among those of the window."""
    w = Window.partitionBy(card, merchant).orderBy("t", "id")
    apart = F.coalesce(F.col("t") - F.lag("t").over(w) > reach, F.lit(True)).cast("int")
    parted = events.withColumn("__new", apart).withColumn("__k", F.sum("__new").over(w))
    each = parted.groupBy(card, merchant, "__k").agg(F.min(F.struct("t", "id")).alias("s"), (F.max("t") + reach).alias("until"))
    return each.select(card, merchant, F.xxhash64(card, merchant, "s.t", "s.id").alias("life"), "s.t", "s.id", "until")


def _ends(stretches: DataFrame, begin: Column, end: Column, *columns: str) -> DataFrame:
    """Each stretch as two rows, +1 at its beginning and -1 at its end."""
    at = lambda p, step: F.struct(p["t"].alias("t"), p["kind"].alias("kind"), p["id"].alias("id"), F.lit(step).alias("step"))
    return stretches.select(*columns, F.explode(F.array(at(begin, 1), at(end, -1))).alias("p")).select(*columns, "p.t", "p.kind", "p.id", "p.step")


def _position(t: Column, kind: int, id_: Column) -> Column:
    return F.struct(t.alias("t"), F.lit(kind).alias("kind"), id_.alias("id"))


def _life() -> tuple[Column, Column]:
    """Where a life begins and ends."""
    return _position(F.col("t"), 0, F.col("id")), _position(F.col("until"), 1, F.lit(""))


def linked(alive: DataFrame, values: DataFrame, card: str, merchant: str) -> DataFrame:
    """(card, begin, end): stretches in which a merchant that is alive has a relative that is alive, too.

    ``values(merchant, attribute, value)`` are what relatives share. Along each value of a card the
    number alive is swept; from where it rises to two until it falls below, all its merchants are
    linked. The one that was alone before is known by the exclusive or of all lives that are on, which
    is its own then. So every life gives a stretch when it begins among others, and one whenever
    another joins it while it is alone: as many as there are beginnings, twice at most. A merchant
    that is linked by several values at once counts once.
    """
    each = alive.join(values, merchant)
    keys = [card, "attribute", "value"]
    rows = _ends(each, *_life(), *keys, "life", "until")
    w = Window.partitionBy(*keys).orderBy(*_POSITION, "life")
    n = F.sum("step").over(w)
    on = lambda c: F.bit_xor(c).over(w).bitwiseXOR(F.col(c))  # noqa: E731 - of those before this row
    swept = rows.withColumns({"n": n, "alone": on("life"), "alone_until": on("until"), "position": F.struct(*_POSITION)})
    ahead = Window.partitionBy(*keys).orderBy(*_POSITION, "life").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    over = swept.withColumn("over", F.min(F.when(F.col("n") < 2, F.col("position"))).over(ahead)).where("step = 1 and n >= 2")
    stretch = lambda life, until: F.struct(life.alias("life"), F.least(F.col("over"), _position(until, 1, F.lit(""))).alias("end"))
    mine, other = stretch(F.col("life"), F.col("until")), stretch(F.col("alone"), F.col("alone_until"))
    both = over.select(card, F.col("position").alias("begin"), F.explode(F.when(F.col("n") == 2, F.array(mine, other)).otherwise(F.array(mine))).alias("s"))
    flat = both.select(card, "begin", "s.life", "s.end")
    # union over the values of one life
    own = Window.partitionBy(card, "life").orderBy("begin")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parted = flat.withColumn("__new", F.coalesce(F.col("begin") > before, F.lit(True)).cast("int")).withColumn("__k", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy(card, "life", "__k").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select(card, "begin", "end")


def counts(events: DataFrame, values: DataFrame, card: str, merchant: str, reach: int) -> DataFrame:
    """(card, t, id, touched, apart): for each of ``events(card, merchant, t, id)`` the merchants of the window that ends with it, and those without a relative among them."""
    alive = lives(events, card, merchant, reach)
    zero = F.lit(0)
    marks = events.select(card, "t", zero.alias("kind"), "id", zero.alias("touched"), zero.alias("linked"), F.lit(True).alias("event"))
    on = _ends(alive, *_life(), card).select(card, *_POSITION, F.col("step").alias("touched"), zero.alias("linked"), F.lit(False).alias("event"))
    ties = linked(alive, values, card, merchant)
    tied = _ends(ties, F.col("begin"), F.col("end"), card).select(card, *_POSITION, zero.alias("touched"), F.col("step").alias("linked"), F.lit(False).alias("event"))
    # rows of one position count together: a range, not rows
    w = Window.partitionBy(card).orderBy(*_POSITION).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = marks.unionAll(on).unionAll(tied).select(card, "t", "id", "event", F.sum("touched").over(w).alias("touched"), F.sum("linked").over(w).alias("__linked"))
    return swept.where("event").select(card, "t", "id", "touched", (F.col("touched") - F.col("__linked")).alias("apart"))
