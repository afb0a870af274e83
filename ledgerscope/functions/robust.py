"""Robust statistics per key from order statistics, without gathering or sorting a key's values in one place."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consistency constant of the modified z-score, and the cut-offs of its bands.
CONSISTENCY = 0.6745
OUTLIER_Z = 3.5
MODERATE_Z = 2.5
USABLE = ("mad", "scaled_iqr")


def rounded(value: Column, places: int) -> Column:
    """``value`` to ``places``, halves away from zero, told by the product in doubles as SQL engines do.

    Spark's own function takes the shortest decimal for the number, so that 0.01775, a little less
    in binary, goes up.
    """
    scale = F.lit(10.0**places)
    return F.when(F.abs(value) < F.lit(1e15) / scale, F.round(value * scale) / scale).otherwise(value)


def _histogram(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys, v, c``: how often each value occurs; combined before the shuffle."""
    return rows.select(*keys, value.cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c"))


#: Values of a key are counted by bucket first; a bucket holds values within about a 6000th of their size.
FINENESS = 4096


def _bucket(v: Column) -> Column:
    """A number that never falls as the value rises; NaN, which sorts last, shares the last one with infinity."""
    size = F.floor(F.log1p(F.abs(v)) / F.log(F.lit(2.0)) * FINENESS)
    last = F.lit((1 << 63) - 1)
    return F.when(F.isnan(v) | (v == float("inf")), last).when(v >= 0, size).otherwise(-1 - size)


def _ranked(hist: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """Rows of the histogram that may hold one of ``ranks`` (1-based, of ``n``), with ``cum`` (values up to v) and ``n`` (all values of the key).

    A key's values never meet in one place: counts per bucket are summed along the key, and only
    the buckets that hold a rank are looked into, each by itself. So what one task sorts is the
    buckets of a key, some thousands whatever the number of its values, or the values of one bucket.
    """
    parted = hist.withColumn("__b", _bucket(F.col("v")))
    key = Window.partitionBy(*keys)
    buckets = parted.groupBy(*keys, "__b").agg(F.sum("c").alias("__c"))
    placed = buckets.select(*keys, "__b", "__c", F.sum("__c").over(key.orderBy("__b")).alias("__upto"), F.sum("__c").over(key).alias("n"))
    holds = reduce(Column.__or__, [(F.col("__upto") >= r) & (F.col("__upto") - F.col("__c") < r) for r in ranks])
    wanted = placed.where(holds).select(*keys, "__b", (F.col("__upto") - F.col("__c")).alias("__before"), "n")
    within = Window.partitionBy(*keys, "__b").orderBy("v")
    return parted.join(wanted, [*keys, "__b"]).withColumn("cum", F.sum("c").over(within) + F.col("__before")).drop("__b", "__before")


def _at(rank: Column) -> Column:
    """Aggregate: the value at a 1-based rank of a ranked histogram."""
    return F.min(F.when(F.col("cum") >= rank, F.col("v")))


def _middle(low: Column, high: Column) -> Column:
    """Aggregate: mean of the values at two ranks (median of a stretch)."""
    return (_at(low) + _at(high)) / 2


def robust_stats(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys, n, center, mad, q1, q3`` of the non-null values of each key; see ``stats_of_counts``."""
    return stats_of_counts(_histogram(rows, keys, value), keys)


#: Different values of a key up to which they are gathered; a key with more is worked on by bucket.
FEW = 4096


def once(made: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is made once a row, not at each mention."""
    return F.transform(F.array(made), use)[0]


def _picked(values: Column, ranks: list[Column]) -> Column:
    """The values at 1-based ``ranks`` of an ascending array of (v, c): a struct of ``r0``, ``r1`` and so on."""
    names = [f"r{k}" for k in range(len(ranks))]
    start = F.struct(F.lit(0).cast("long").alias("cum"), *[F.lit(None).cast("double").alias(r) for r in names])

    def step(a: Column, x: Column) -> Column:
        upto = a["cum"] + x["c"]
        return F.struct(upto.alias("cum"), *[F.when(a[r].isNull() & (upto >= rank), x["v"]).otherwise(a[r]).alias(r) for r, rank in zip(names, ranks)])

    return F.aggregate(values, start, step)


def _ranks() -> tuple[list[Column], list[Column], list[Column], Column]:
    """Ranks, of ``n`` values, of the middle two and of those of both halves; and the size of a half."""
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    low = lambda size, start: [start + F.floor((size + 1) / 2), start + F.floor(size / 2) + 1]
    return low(n, F.lit(0)), low(half, F.lit(0)), low(half, n - half), half


def stats_of_counts(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, center, mad, q1, q3`` of values that are counted already: ``hist(keys, v, c)``, each value of a key once.

    Medians are means of the middle two; the quartiles are medians of the halves, an odd count's
    middle value belonging to neither; one value is its own quartile. Keys are not null. The values
    of a key with at most FEW different ones are gathered, which takes one shuffle; the names of the
    others, fewer than one in FEW values, are broadcast, and their values stay apart.
    """
    hist = hist.where("v is not null")
    # counted by way of c, so that the counts stay in the plan and its shuffle is used by all three
    sizes = hist.groupBy(*keys).agg(F.sum((F.col("c") > 0).cast("long")).alias("__m"))
    many = F.broadcast(sizes.where(F.col("__m") > FEW).select(*keys))
    return _gathered(hist.join(many, keys, "left_anti"), keys).unionByName(_by_bucket(hist.join(many, keys, "left_semi"), keys))


def _gathered(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``stats_of_counts`` of keys whose different values are few."""
    middle, first_half, second_half, half = _ranks()
    each = hist.groupBy(*keys).agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("__a"))
    placed = each.select(*keys, "n", "__a", _picked(F.col("__a"), [*middle, *first_half, *second_half]).alias("__r"))
    mean = lambda x, y: (F.col(f"__r.{x}") + F.col(f"__r.{y}")) / 2
    stats = placed.select(
        *keys, "n", "__a", mean("r0", "r1").alias("center"),
        F.when(half > 0, mean("r2", "r3")).otherwise(F.col("__a")[0]["v"]).alias("q1"), F.when(half > 0, mean("r4", "r5")).otherwise(F.element_at("__a", -1)["v"]).alias("q3"),
    )
    apart = once(F.col("center"), lambda m: F.sort_array(F.transform("__a", lambda x: F.struct(F.abs(x["v"] - m).alias("v"), x["c"].alias("c")))))
    mad = once(_picked(apart, middle), lambda r: (r["r0"] + r["r1"]) / 2)
    return stats.select(*keys, "n", "center", mad.alias("mad"), "q1", "q3")


def stats_of_lists(lists: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, center, mad, q1, q3`` of ``lists(keys, values)``: a key's values, ascending and at least one, in an array without nulls."""
    n = F.size("values")
    half = F.floor(n / 2).cast("int")
    # of an array without nulls, so that it is sorted as plain numbers
    known = lambda c: F.coalesce(c, F.lit(0.0))
    middle = lambda a, size, start: (F.get(a, start + F.floor((size + 1) / 2).cast("int") - 1) + F.get(a, start + F.floor(size / 2).cast("int"))) / 2
    v = F.col("values")
    stats = lists.select(
        *keys, "values", n.cast("long").alias("n"), middle(v, n, F.lit(0)).alias("center"),
        F.when(half > 0, middle(v, half, F.lit(0))).otherwise(F.get(v, F.lit(0))).alias("q1"), F.when(half > 0, middle(v, half, n - half)).otherwise(F.get(v, n - 1)).alias("q3"),
    )
    apart = F.sort_array(F.transform("values", lambda x: known(F.abs(x - F.col("center")))))
    return stats.select(*keys, "n", "center", once(apart, lambda a: middle(a, F.col("n").cast("int"), F.lit(0))).alias("mad"), "q1", "q3")


def _by_bucket(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``stats_of_counts`` of keys with many values, which never meet in one place."""
    middle, first_half, second_half, half = _ranks()
    n = F.col("n")
    # a single value has empty halves
    ranks = [*middle, *(F.greatest(r, F.lit(1)) for r in first_half), *(F.least(r, n) for r in second_half)]
    first = _ranked(hist, keys, ranks).groupBy(*keys).agg(
        F.max("n").alias("n"),
        _middle(*middle).alias("center"),
        F.coalesce(F.when(F.max(half) > 0, _middle(*first_half)), F.min("v")).alias("q1"),
        F.coalesce(F.when(F.max(half) > 0, _middle(*second_half)), F.max("v")).alias("q3"),
    )
    apart = hist.join(first.select(*keys, "center"), keys).select(*keys, F.abs(F.col("v") - F.col("center")).alias("v"), "c")
    mad = _ranked(apart.groupBy(*keys, "v").agg(F.sum("c").alias("c")), keys, list(middle)).groupBy(*keys).agg(_middle(*middle).alias("mad"))
    return first.join(mad, keys).select(*keys, "n", "center", "mad", "q1", "q3")


def fit(stats: DataFrame, min_obs: int, floor: float = 0.0, enough: Column | None = None) -> DataFrame:
    """Adds ``dispersion, method, usable`` to rows of robust statistics, and a center of 0 where there is none.

    The cascade: too few values (or not ``enough``) is ``insufficient_data``; else the MAD if it is
    positive; else half the interquartile range; else the floor; else ``constant``.
    """
    n = F.coalesce("n", F.lit(0))
    short = (n < min_obs) if enough is None else (n < min_obs) | ~F.coalesce(enough, F.lit(False))
    iqr = F.col("q3") - F.col("q1")
    method = (
        F.when(short, "insufficient_data")
        .when((F.col("mad") > 0) | ((iqr <= 0) & F.lit(floor > 0)), "mad")
        .when(iqr > 0, "scaled_iqr")
        .otherwise("constant")
    )
    spread = F.when(F.col("mad") > 0, F.greatest("mad", F.lit(floor))).when(iqr > 0, F.greatest(0.5 * iqr, F.lit(floor))).otherwise(F.lit(floor))
    out = stats.withColumn("n", n.cast("long")).withColumn("center", F.coalesce("center", F.lit(0.0)))
    out = out.withColumn("method", method)
    out = out.withColumn("dispersion", F.when(F.col("method").isin(*USABLE), spread).otherwise(F.lit(0.0)))
    return out.withColumn("usable", F.col("method").isin(*USABLE))


def fit_peers(stats: DataFrame, floor: float = 0.0, min_members: int = 3) -> DataFrame:
    """Adds ``dispersion, usable`` to rows of statistics over members' centers: the MAD, no cascade."""
    out = stats.withColumn("dispersion", F.greatest("mad", F.lit(floor)))
    return out.withColumn("usable", (F.col("n") >= min_members) & (F.col("dispersion") > 0))


def modified_z(value: Column, center: Column, dispersion: Column) -> Column:
    """Modified z-score; null without a positive dispersion."""
    return F.when(dispersion > 0, F.lit(CONSISTENCY) * (value - center) / dispersion)


def band(z: Column) -> Column:
    """One-sided band of a z-score."""
    return F.when(z > OUTLIER_Z, "outlier").when(z > MODERATE_Z, "moderate").otherwise("normal")


def upper_fence(center: Column, dispersion: Column) -> Column:
    return F.when(dispersion > 0, center + OUTLIER_Z * dispersion / CONSISTENCY)
