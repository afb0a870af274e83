"""Time-of-day densities on a circle of 96 bins, and the measures built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.robust import once

#: Fixed values of the estimate.
BINS, BIN_HOURS = 96, 0.25
OWN_PERCENTILE, COHORT_PERCENTILE = 0.05, 0.01
NARROWEST, WIDEST, SCALE = 0.25, 4.0, 2.5
#: Weights of volume, share and depth in the severity, and the count that saturates the volume.
VOLUME, SHARE, DEPTH, SATURATION = 0.55, 0.30, 0.15, 100.0


def local_hour(ts: str = "occurred_at") -> Column:
    """Hours since local midnight; parts of a second don't count."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.floor(F.second(ts)) / F.lit(3600.0)


def bin_of(ts: str = "occurred_at") -> Column:
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("int")


def bandwidth(n: Column) -> Column:
    return F.when(n <= 1, F.lit(WIDEST)).otherwise(F.least(F.greatest(SCALE * F.pow(n.cast("double"), F.lit(-0.2)), F.lit(NARROWEST)), F.lit(WIDEST)))


def estimate(binned: DataFrame, keys: list[str], percentile: float) -> DataFrame:
    """Densities of ``binned(keys, bin, w, n)``: ``keys, n, bandwidth, density, threshold, peak_hour``.

    ``w`` is a bin's weight, ``n`` (equal within a key) the observations that set the bandwidth. The
    bins are folded with a von Mises kernel and normalised to integrate to one over the day. The
    threshold is the first density, over bins with weight in order of (density, weight), at which
    the running weight reaches ``percentile`` of all. A key has at most 96 bins, which are gathered
    and summed in order of the day, so that equal bins give equal densities to the last bit.
    """
    steps, zero = F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0.0)
    gathered = binned.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("bin", F.col("w").cast("double").alias("w")))).alias("bins"))
    sized = gathered.withColumn("bandwidth", bandwidth(F.col("n")))
    kappa = 1 / F.pow(2 * math.pi * F.col("bandwidth") / 24, F.lit(2.0))
    kernel = F.transform(steps, lambda o: F.exp(kappa * (F.cos(2 * math.pi * o / BINS) - 1)))

    turned = lambda twice, bin_: F.slice(twice, F.lit(BINS + 1) - bin_, F.lit(BINS))
    folded = lambda twice: F.aggregate("bins", F.array_repeat(zero, BINS), lambda a, x: F.zip_with(a, turned(twice, x["bin"]), lambda r, k: r + x["w"] * k))
    raw = sized.select(*keys, "n", "bandwidth", "bins", once(kernel, lambda k: once(F.concat(k, k), folded)).alias("raw"))
    total = lambda r: F.aggregate(r, zero, lambda a, x: a + x) * BIN_HOURS
    scaled = once(F.col("raw"), lambda r: once(total(r), lambda t: F.when(t > 0, F.transform(r, lambda x: x / t)).otherwise(r)))
    dense = raw.select(*keys, "n", "bandwidth", "bins", scaled.alias("density"))
    weighed = F.filter("bins", lambda x: x["w"] > 0)
    ordered = once(F.col("density"), lambda d: F.array_sort(F.transform(weighed, lambda x: F.struct(F.get(d, x["bin"]).alias("d"), x["w"].alias("w")))))
    all_ = F.aggregate(weighed, zero, lambda a, x: a + x["w"])
    start = F.struct(zero.alias("cum"), F.lit(None).cast("double").alias("at"))
    reached = lambda a, x, of: F.when(a["at"].isNull() & (a["cum"] + x["w"] >= percentile * of), x["d"]).otherwise(a["at"])
    first = lambda of: F.aggregate(ordered, start, lambda a, x: F.struct((a["cum"] + x["w"]).alias("cum"), reached(a, x, of).alias("at")), lambda a: a["at"])
    return dense.select(
        *keys, "n", "bandwidth", "density", F.coalesce(once(all_, first), zero).alias("threshold"),
        once(F.col("density"), lambda d: (F.array_position(d, F.array_max(d)) - 1) * BIN_HOURS).alias("peak_hour"),
    )


def density_at(density: Column, bin_: Column) -> Column:
    return F.get(density, bin_)


def is_unusual(usable: Column, at: Column, threshold: Column) -> Column:
    return usable & (threshold > 0) & (at < threshold)


def depth(usable: Column, at: Column, threshold: Column) -> Column:
    """How far below the threshold a density lies, 0 to 1."""
    return F.when(usable & (threshold > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - at / threshold))).otherwise(F.lit(0.0))


def temporal_severity(odd: Column, day: Column, deep: Column) -> Column:
    """0 to 1 from the number of odd rows, their share of the day and the depth of the deepest."""
    volume = F.least(F.log1p(odd.cast("double")) / math.log1p(SATURATION), F.lit(1.0))
    share = odd / F.greatest(day, odd)
    return F.when(odd <= 0, F.lit(0.0)).otherwise(F.least(VOLUME * volume + SHARE * share + DEPTH * F.least(F.greatest(deep, F.lit(0.0)), F.lit(1.0)), F.lit(1.0)))
