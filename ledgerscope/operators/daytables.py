"""Mergeable tables of single days, from which the windows of any date, or of many, are summed.

A day's tables are made from that day's ledger rows alone: amounts counted by value, times by bin,
origins by country, counts of attempts, the rank and amount of each sale within the day. A night
adds one day and reads no other day of the ledger; a backfill fits many dates in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions import density, robust
from ledgerscope.operators.baselines import FitSettings, within_hour
from ledgerscope.operators.predicates import HOME, UNSETTLED, Span, dated, has_card_origin, micros, settled_sale
from ledgerscope.sources import tables

TABLES = ("amounts", "activity", "bins", "origins", "sales")
FILES = 8  #: parts of a day, by merchant: a busy day is no single task's work


def build(ledger: DataFrame, span: Span | None = None) -> dict[str, DataFrame]:
    """The day tables of all days of ``span``, which has to hold whole days; of the whole ledger without one.

    ``amounts(txn_date, merchant_id, card_type, v, c)``; ``activity`` with a row per merchant and day
    with any row: all and unsettled attempts, settled sales, their sum, first and last instant, cards of known and
    foreign origin, most sales within 60 minutes; ``bins(.., bin, c)``; ``origins(.., country, c)`` of
    foreign cards; ``sales(.., k, total_amount)``, the day's k-th sale. Confirmed days are among them:
    whoever reads leaves them out, as an analyst may confirm a day at any time.
    """
    part = F.pmod(F.xxhash64(F.lit(5), "merchant_id"), F.lit(FILES)).alias("part")
    rows = dated(ledger if span is None else ledger.where(span.holds(F.col("occurred_at"))))
    # one shuffle a table: all that follows keeps to a day and a merchant, so to a day and a part
    rows = rows.select("*", part).repartition("txn_date", "part")
    settled = rows.where(settled_sale())
    day = ["txn_date", "part", "merchant_id"]
    known, abroad = has_card_origin(), has_card_origin() & (F.col("card_issuing_country") != HOME)
    bad, good = F.coalesce(F.col("transaction_status").isin(*UNSETTLED), F.lit(False)), settled_sale()
    counted = rows.withColumn("__n", within_hour(F.when(good, 1), day)).groupBy(*day).agg(
        F.count("*").alias("attempts"),
        F.count(F.when(bad, 1)).alias("unsettled"),
        F.count(F.when(good, 1)).alias("settled"),
        F.sum(F.when(good, F.col("total_amount"))).alias("gross"),
        F.min(F.when(good, micros())).alias("first"),
        F.max(F.when(good, micros())).alias("last"),
        F.count(F.when(good & known, 1)).alias("known"),
        F.count(F.when(good & abroad, 1)).alias("abroad"),
        F.max(F.when(good, F.col("__n"))).alias("peak"),
    )
    rank = F.row_number().over(Window.partitionBy(*day).orderBy("occurred_at", "source_txn_id"))
    made = {
        "amounts": settled.groupBy(*day, "card_type", F.col("total_amount").cast("double").alias("v")).agg(F.count("*").alias("c")),
        "activity": counted,
        "bins": settled.groupBy(*day, density.bin_of().alias("bin")).agg(F.count("*").alias("c")),
        "origins": settled.where(abroad).groupBy(*day, F.col("card_issuing_country").alias("country")).agg(F.count("*").alias("c")),
        "sales": settled.select(*day, rank.alias("k"), "total_amount"),
    }
    return {name: df.drop("part") for name, df in made.items()}


class DayStore:
    """Day tables in a folder, by day; a day that is made again replaces itself."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def load(self, ledger: DataFrame, span: Span | None = None, names: Collection[str] = TABLES) -> None:
        """Make the tables, or those of ``names``, of all days of a ledger, once, in a folder that has none yet.

        A day has at most FILES files, as ``build`` deals it.
        """
        made = {n: df for n, df in build(ledger, span).items() if n in names}
        tables.at_once(made, lambda n: made[n].write.partitionBy("txn_date").parquet(f"{self.folder}/{n}"))

    def update(self, ledger: DataFrame, days: Sequence[date], names: Collection[str] = TABLES) -> None:
        """Make the tables, or those of ``names``, of single days anew from their ledger rows; no other day is read.

        That is the new day each night, and every day that late rows or corrections touch. A day that
        has lost all its rows gets empty tables.
        """
        for d in days:
            start = datetime(d.year, d.month, d.day)
            made = {n: df for n, df in build(ledger, Span(start, start + timedelta(days=1))).items() if n in names}
            tables.at_once(made, lambda n: made[n].drop("txn_date").write.mode("overwrite").parquet(f"{self.folder}/{n}/txn_date={d}"))  # noqa: B023 - done within the turn

    def read(self, names: Collection[str] = TABLES) -> dict[str, DataFrame]:
        made = {n: self.spark.read.parquet(f"{self.folder}/{n}") for n in TABLES if n in names}
        return {n: df.withColumn("txn_date", F.col("txn_date").cast("date")) for n, df in made.items()}


@dataclass(frozen=True)
class Windows:
    """Day tables, seen through the windows of ``dates`` (midnights): every result is keyed by ``as_of`` too."""

    days: Mapping[str, DataFrame]
    merchants: DataFrame
    confirmed: DataFrame | None
    dates: tuple[date, ...]
    fit: FitSettings = FitSettings()

    def _dates(self) -> Column:
        return F.array(*[F.lit(d.isoformat()).cast("date") for d in self.dates])

    def _bounds(self, back: int | None, lag: int | None) -> tuple[int, int]:
        return self.fit.window_days if back is None else back, self.fit.lag_days if lag is None else lag

    def reached(self, name: str, back: int | None = None, lag: int | None = None, clean: bool = True) -> DataFrame:
        """Rows of a day table, each once, that the window of ``back`` days before ``lag`` days of any date holds; ``clean`` leaves confirmed days out."""
        back, lag = self._bounds(back, lag)
        low, high = min(self.dates) - timedelta(days=lag + back), max(self.dates) - timedelta(days=lag)
        day = F.col("txn_date")
        lit = lambda d: F.lit(d.isoformat()).cast("date")
        rows = self.days[name].where((day >= lit(low)) & (day < lit(high)))
        if clean and self.confirmed is not None:
            rows = rows.join(self.confirmed.select("merchant_id", "txn_date"), ["merchant_id", "txn_date"], "left_anti")
        return rows

    def spread(self, rows: DataFrame, back: int | None = None, lag: int | None = None) -> DataFrame:
        """``rows`` with each ``as_of`` whose window holds their day: at most once for each date and never more than ``back`` times."""
        back, lag = self._bounds(back, lag)
        day = F.col("txn_date")
        holds = F.filter(self._dates(), lambda d: (day >= F.date_sub(d, lag + back)) & (day < F.date_sub(d, lag)))
        return rows.withColumn("as_of", F.explode(holds))

    def holds(self, d: date) -> Column:
        """Whether the window of ``d``, of the settings' length and lag, holds a row's day."""
        last = d - timedelta(days=self.fit.lag_days)
        lit = lambda x: F.lit(x.isoformat()).cast("date")
        return (F.col("txn_date") >= lit(last - timedelta(days=self.fit.window_days))) & (F.col("txn_date") < lit(last))

    def within(self, name: str, back: int | None = None, lag: int | None = None, clean: bool = True) -> DataFrame:
        """Rows of a day table with each ``as_of`` whose window holds their day."""
        return self.spread(self.reached(name, back, lag, clean), back, lag)

    def dealt(self, name: str, clean: bool = True) -> DataFrame:
        """``within``, a merchant's rows together, so that they are shuffled once each and not once a window.

        For tables with few rows a merchant and day.
        """
        return self.spread(self.reached(name, clean=clean).repartition("merchant_id"))

    def stats(self, rows: DataFrame, by: tuple[str, ...] = (), back: int | None = None, lag: int | None = None) -> DataFrame:
        """``robust.robust_stats`` by ``as_of``, merchant and ``by`` of ``rows(txn_date, merchant_id, by, v)``, few of a key.

        A key's values are gathered once, whatever the number of windows that hold them.
        """
        back, lag = self._bounds(back, lag)
        keys = ["merchant_id", *by]
        each = rows.where("v is not null").groupBy(*keys).agg(F.collect_list(F.struct("txn_date", (F.col("v").cast("double") + F.lit(0.0)).alias("v"))).alias("all"))
        span = lambda d: F.struct(d.alias("as_of"), F.date_sub(d, lag + back).alias("low"), F.date_sub(d, lag).alias("high"))
        held = lambda d: F.filter("all", lambda x: (x["txn_date"] >= d["low"]) & (x["txn_date"] < d["high"]))
        windows = F.transform(F.transform(self._dates(), span), lambda d: F.struct(d["as_of"].alias("as_of"), F.transform(held(d), lambda x: F.coalesce(x["v"], F.lit(0.0))).alias("values")))
        lists = each.select(*keys, F.explode(windows).alias("w")).select("w.as_of", *keys, F.sort_array("w.values").alias("values"))
        return robust.stats_of_lists(lists.where(F.size("values") > 0), ["as_of", *keys])

    def members(self, dimension: str) -> DataFrame:
        return self.merchants.select("merchant_id", dimension).where(F.col(dimension).isNotNull())


KEY = ["as_of", "merchant_id"]
DATES_AT_ONCE = 8  #: windows that are counted in columns of one table


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "v").agg(F.sum("c").alias("c"))


def _each(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Statistics, by cohort, of one value a row. These are counted and written first, as statistics read them several times."""
    return robust.stats_of_counts(tables.write(_counts(rows.select(*keys, value.cast("double").alias("v"), F.lit(1).alias("c")), keys), "counted"), keys)


def _daily(w: Windows, rows: DataFrame, value: Column) -> DataFrame:
    """Statistics, by merchant, of one value of each of ``rows`` of ``activity``, which has one row a merchant and day."""
    if (max(w.dates) - min(w.dates)).days + w.fit.window_days > robust.FEW:
        return robust.robust_stats(w.spread(rows), KEY, value)
    return w.stats(rows.select("txn_date", "merchant_id", value.alias("v")))


def _amounts(w: Windows, by: tuple[str, ...] = (), back: int | None = None, clean: bool = True) -> DataFrame:
    """Statistics of settled amounts by merchant and ``by``; those of keys with over ``robust.FEW`` amounts in all windows by way of their counts."""
    keys = ["merchant_id", *by]
    rows = w.reached("amounts", back, clean=clean).where(" and ".join(["v is not null", *[f"{c} is not null" for c in by]])).select("txn_date", *keys, "v", "c")
    many = F.broadcast(rows.groupBy(*keys).agg(F.sum("c").alias("__n")).where(F.col("__n") > robust.FEW).select(*keys))
    few = rows.join(many, keys, "left_anti").select("txn_date", *keys, F.explode(F.array_repeat("v", F.col("c").cast("int"))).alias("v"))
    spread = w.spread(rows.join(many, keys, "left_semi"), back)
    return w.stats(few, by, back).unionByName(robust.stats_of_counts(_counts(spread, ["as_of", *keys]), ["as_of", *keys]))


def own_stats(w: Windows) -> DataFrame:
    """(as_of, merchant_id, n, center, mad, q1, q3, span_days) of settled amounts; a cohort's members vote with it, too."""
    seconds = (F.max("last") - F.min("first")) / F.lit(86_400_000_000.0)
    days = w.dealt("activity").groupBy(*KEY).agg(seconds.alias("span_days"))
    return _amounts(w).join(days, KEY)


def own_amount(w: Windows, stats: DataFrame) -> DataFrame:
    every = w.merchants.select("merchant_id", F.explode(w._dates()).alias("as_of"))
    return robust.fit(every.join(stats, KEY, "left"), w.fit.min_observations, enough=F.col("span_days") >= w.fit.min_span_days)


def rail_amount(w: Windows) -> DataFrame:
    return robust.fit(_amounts(w, ("card_type",)), w.fit.min_observations)


def _votes(w: Windows, stats: DataFrame, floor: float) -> DataFrame:
    grouped = stats.select(*KEY, F.col("center").alias("vote"), F.col("n").alias("rows")).join(w.members("mcc"), "merchant_id")
    sizes = grouped.groupBy("as_of", "mcc").agg(F.sum("rows").alias("n_observations"))
    return robust.fit_peers(_each(grouped, ["as_of", "mcc"], F.col("vote")), floor).join(sizes, ["as_of", "mcc"])


def peer_amount(w: Windows, stats: DataFrame) -> DataFrame:
    return _votes(w, stats, 0.0)


def count_stats(w: Windows) -> DataFrame:
    return _daily(w, w.reached("activity").where("settled > 0"), F.col("settled"))


def own_velocity(w: Windows) -> DataFrame:
    return robust.fit(_daily(w, w.reached("activity"), F.col("peak")), w.fit.min_observations, w.fit.count_floor)


def sampled(w: Windows) -> DataFrame:
    """``(as_of, mcc, merchant_subdistrict, v, c)``: counts of the sales of each merchant, of n over the cap of those at floor(i * n / cap).

    Merchants that are over the cap in no window give all their amounts, as they are counted by day.
    For others, the rank of a sale in the window is its rank within its day and the sales of the
    window's days before.
    """
    cap, key = w.fit.member_cap, Window.partitionBy(*KEY)
    per_day = w.dealt("activity").where("settled > 0").select(*KEY, "txn_date", "settled")
    over = tables.write(per_day.groupBy(*KEY).agg(F.sum("settled").alias("all")).where(F.col("all") > cap).select("merchant_id").distinct(), "over")
    whole = w.spread(w.reached("amounts").join(over, "merchant_id", "left_anti")).select(*KEY, "v", "c")
    earlier = F.coalesce(F.sum("settled").over(key.orderBy("txn_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = per_day.join(over, "merchant_id", "left_semi").select(*KEY, "txn_date", earlier.alias("before"), F.sum("settled").over(key).alias("all"))
    sales = w.spread(w.reached("sales").join(over, "merchant_id", "left_semi"))
    ranked = sales.join(days, [*KEY, "txn_date"]).withColumn("r", F.col("before") + F.col("k") - 1)
    i = F.ceil(F.col("r") * cap / F.col("all"))
    rows = ranked.where((F.col("all") <= cap) | ((i < cap) & (F.floor(i * F.col("all") / cap) == F.col("r"))))
    every = whole.unionAll(rows.select(*KEY, F.col("total_amount").cast("double").alias("v"), F.lit(1).cast("long").alias("c")))
    return _counts(every.join(w.merchants.select("merchant_id", "mcc", "merchant_subdistrict"), "merchant_id"), ["as_of", "mcc", "merchant_subdistrict"])


def cohort_tickets(w: Windows, dimension: str, counts: DataFrame | None = None) -> DataFrame:
    """Per cohort the distribution of its members' sampled sales; ``counts`` are those of ``sampled``, written for more than one dimension."""
    keys = ["as_of", dimension]
    counts = tables.write(sampled(w), "sampled") if counts is None else counts
    stats = robust.stats_of_counts(tables.write(_counts(counts.where(F.col(dimension).isNotNull()), keys), "counted"), keys)
    active = w.dealt("activity").where("settled > 0").select(*KEY).distinct()
    members = active.join(w.members(dimension), "merchant_id").groupBy(*keys).agg(F.count("*").alias("members"))
    return robust.fit(stats.join(members, keys), 1, enough=F.col("members") >= w.fit.min_members)


def own_unsettled(w: Windows) -> DataFrame:
    return robust.fit(_daily(w, w.reached("activity"), F.col("unsettled") / F.col("attempts")), w.fit.min_observations, w.fit.ratio_floor)


def _shares(w: Windows, part: str, whole: str, dimension: str) -> DataFrame:
    """Per cohort the distribution of its members' shares over the window."""
    sums = w.dealt("activity").groupBy(*KEY).agg(F.sum(part).alias("a"), F.sum(whole).alias("b")).where("b > 0").join(w.members(dimension), "merchant_id")
    return robust.fit(_each(sums, ["as_of", dimension], F.col("a") / F.col("b")), w.fit.min_members, w.fit.ratio_floor)


def _binned(w: Windows) -> DataFrame:
    """``(as_of, merchant_id, bin, c, n)``: a merchant's sales by time of day, and all of them. Windows are counted side by side, DATES_AT_ONCE at a time."""
    parts = []
    for k in range(0, len(w.dates), DATES_AT_ONCE):
        some = replace(w, dates=w.dates[k : k + DATES_AT_ONCE])
        rows = some.reached("bins", clean=False).repartition("merchant_id")
        each = rows.groupBy("merchant_id", "bin").agg(*[F.sum(F.when(some.holds(d), F.col("c"))).alias(f"c{i}") for i, d in enumerate(some.dates)])
        all_ = [F.sum(f"c{i}").over(Window.partitionBy("merchant_id")).alias(f"n{i}") for i in range(len(some.dates))]
        windows = F.array(*[F.struct(F.lit(d.isoformat()).cast("date").alias("as_of"), F.col(f"c{i}").alias("c"), F.col(f"n{i}").alias("n")) for i, d in enumerate(some.dates)])
        parts.append(each.select("*", *all_).select("merchant_id", "bin", F.explode(windows).alias("w")).where("w.c is not null").select("w.as_of", "merchant_id", "bin", "w.c", "w.n"))
    return reduce(DataFrame.unionAll, parts)


def own_hours(w: Windows) -> DataFrame:
    out = density.estimate(_binned(w).withColumn("w", F.col("c")), KEY, density.OWN_PERCENTILE)
    return out.withColumn("usable", F.col("n") >= w.fit.min_times)


def cohort_hours(w: Windows, dimension: str = "mcc") -> DataFrame:
    # written, as it is read for the cohorts' sizes and for their bins
    each, keys = tables.write(_binned(w).join(w.members(dimension), "merchant_id"), "binned"), ["as_of", dimension]
    votes = F.col("n") >= w.fit.min_member_times
    sizes = each.select(*keys, "merchant_id", "n").distinct().groupBy(*keys).agg(F.count(F.when(votes, 1)).alias("voters"), F.coalesce(F.sum(F.when(votes, F.col("n"))), F.lit(0)).alias("observations"))
    pooled = each.where(votes).groupBy(*keys, "bin").agg(F.sum(F.col("c") / F.col("n")).alias("w")).join(sizes.where(F.col("voters") >= w.fit.min_members), keys).withColumn("n", F.col("observations"))
    made, zero = density.estimate(pooled, keys, density.COHORT_PERCENTILE), F.lit(0.0)
    n = F.coalesce("n", F.lit(0))
    return sizes.select(*keys).join(made, keys, "left").select(
        *keys, n.alias("n"), F.coalesce("bandwidth", zero).alias("bandwidth"), F.coalesce("density", F.array_repeat(zero, density.BINS)).alias("density"),
        F.coalesce("threshold", zero).alias("threshold"), F.coalesce("peak_hour", zero).alias("peak_hour"), (n >= w.fit.min_times).alias("usable"),
    )


def origin_mix(w: Windows) -> DataFrame:
    key = Window.partitionBy(*KEY)
    counts = w.dealt("origins", clean=False).groupBy(*KEY, "country").agg(F.sum("c").alias("c"))
    return counts.select("*", F.sum("c").over(key).alias("n"), F.count("*").over(key).alias("kinds"))


def trend(w: Windows) -> DataFrame:
    s = w.fit

    def of(days: int, name: str) -> DataFrame:
        stats = _amounts(w, back=days, clean=False)
        return stats.select(*KEY, F.col("n").alias(f"{name}_n"), F.col("center").alias(f"{name}_center"))

    both = of(s.long_days, "long").join(of(s.short_days, "short"), KEY, "left")
    enough = (F.col("long_n") >= s.trend_rows) & (F.coalesce("short_n", F.lit(0)) >= s.trend_rows)
    ratio = F.when(enough & (F.col("long_center") > 0), F.col("short_center") / F.col("long_center")).otherwise(F.lit(0.0))
    level = lambda c: F.when(enough, F.col(c)).otherwise(F.lit(0.0))
    return both.select(*KEY, level("short_center").alias("trend_short"), level("long_center").alias("trend_long"), ratio.alias("trend_ratio"), (ratio >= s.ramp).alias("is_ramp"))


def daily_value(w: Windows) -> DataFrame:
    """Of the last quarter, the scored day included."""
    return w.within("activity", w.fit.long_days, 0, clean=False).where("settled > 0").select(*KEY, "txn_date", "gross")


def last_activity(w: Windows) -> DataFrame:
    """Over all days that there are tables of."""
    before = F.filter(w._dates(), lambda d: F.col("txn_date") < F.date_sub(d, 1))
    rows = w.days["activity"].select("merchant_id", "txn_date", F.explode(before).alias("as_of"))
    return rows.groupBy(*KEY).agg(F.max("txn_date").alias("last_active"))


#: Fits over the windows of dates; what several fits share comes first.
SHARED: dict[str, Callable[[Windows], DataFrame]] = {"own_stats": own_stats, "count_stats": count_stats, "sampled": sampled}
FITS: dict[str, Callable[[Windows, Mapping[str, DataFrame]], DataFrame]] = {
    "own_amount": lambda w, s: own_amount(w, s["own_stats"]),
    "rail_amount": lambda w, s: rail_amount(w),
    "peer_amount": lambda w, s: peer_amount(w, s["own_stats"]),
    "own_daily_count": lambda w, s: robust.fit(s["count_stats"], w.fit.min_observations, w.fit.count_floor),
    "peer_daily_count": lambda w, s: _votes(w, s["count_stats"], w.fit.count_floor),
    "own_velocity": lambda w, s: own_velocity(w),
    "own_hours": lambda w, s: own_hours(w),
    "cohort_hours": lambda w, s: cohort_hours(w),
    "subdistrict_tickets": lambda w, s: cohort_tickets(w, "merchant_subdistrict", s["sampled"]),
    "mcc_tickets": lambda w, s: cohort_tickets(w, "mcc", s["sampled"]),
    "own_unsettled": lambda w, s: own_unsettled(w),
    "peer_unsettled": lambda w, s: _shares(w, "unsettled", "attempts", "mcc"),
    "subdistrict_foreign": lambda w, s: _shares(w, "abroad", "known", "merchant_subdistrict"),
    "origin_mix": lambda w, s: origin_mix(w),
    "trend": lambda w, s: trend(w),
    "daily_value": lambda w, s: daily_value(w),
    "last_activity": lambda w, s: last_activity(w),
}

#: What each of SHARED and FITS reads: day tables or what is shared.
READS: dict[str, tuple[str, ...]] = {
    "own_stats": ("amounts", "activity"), "count_stats": ("activity",), "sampled": ("activity", "amounts", "sales"),
    "own_amount": ("own_stats",), "rail_amount": ("amounts",), "peer_amount": ("own_stats",), "own_daily_count": ("count_stats",), "peer_daily_count": ("count_stats",),
    "own_velocity": ("activity",), "own_hours": ("bins",), "cohort_hours": ("bins",), "subdistrict_tickets": ("sampled",), "mcc_tickets": ("sampled",),
    "own_unsettled": ("activity",), "peer_unsettled": ("activity",), "subdistrict_foreign": ("activity",), "origin_mix": ("origins",), "trend": ("amounts",),
    "daily_value": ("activity",), "last_activity": ("activity",),
}


def needed(fits: Collection[str]) -> tuple[set[str], set[str]]:
    """What is shared, and the day tables, that ``fits`` read."""
    shared = {x for f in fits for x in READS[f] if x in SHARED}
    return shared, {x for f in [*fits, *shared] for x in READS[f] if x in TABLES}


def reach(dates: Sequence[date], fit: FitSettings = FitSettings()) -> Span:
    """The days that the windows of ``dates`` read, the scored days included."""
    back = max(fit.window_days, fit.long_days, fit.short_days) + fit.lag_days
    first, last = min(dates) - timedelta(days=back), max(dates)
    return Span(datetime(first.year, first.month, first.day), datetime(last.year, last.month, last.day))
