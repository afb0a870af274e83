"""Family C: rules over merchants that belong together and cards that move between merchants.

No output holds a card number; a card appears as ``card <k>``, its rank among the day's cards.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions import geo
from ledgerscope.functions.robust import rounded
from ledgerscope.operators import sweep
from ledgerscope.operators.detectors import Portfolio, hit
from ledgerscope.operators.predicates import fold, has_card, micros
from ledgerscope.operators.typology import Rule, validate
from ledgerscope.sources import tables

IDENTITY = ("hashed_br_number", "hashed_merchant_address", "hashed_merchant_name")


def identities(merchants: DataFrame) -> DataFrame:
    """(merchant_id, attribute, value) for each identity hash that is not blank."""
    pairs = F.expr("stack({}, {}) as (attribute, value)".format(len(IDENTITY), ", ".join(f"'{c}', {c}" for c in IDENTITY)))
    return merchants.select("merchant_id", pairs).where("value is not null and trim(value) <> ''")


def groups(merchants: DataFrame) -> DataFrame:
    """(merchant_id, attribute, value, members): merchants that share an identity value with others; no pairs are made."""
    each = identities(merchants)
    sizes = each.groupBy("attribute", "value").agg(F.count("*").alias("members")).where("members > 1")
    return each.join(sizes, ["attribute", "value"]).select("merchant_id", "attribute", "value", "members")


def circles(merchants: DataFrame) -> DataFrame:
    """(merchant_id, circle, size): a 128-bit name and the size of the set of a merchant and all that share a value with it.

    Merchants with equal sets have equal names. The set is the union of the merchant's groups, so
    its name and size follow by inclusion and exclusion from those of the groups and of their
    intersections, the merchants alike in two or three values. Each is an aggregate that Spark
    combines before its shuffle; no set is gathered.
    """
    value = lambda c: F.when(F.trim(c) != "", F.col(c))
    out = merchants.select("merchant_id", *[value(c).alias(c) for c in IDENTITY])
    names = [F.bit_xor(F.xxhash64(F.lit(seed), "merchant_id")) for seed in (1, 2)]
    zero = F.lit(0).cast("long")
    total = [zero, zero, zero]
    for size in (1, 2, 3):
        for k, keys in enumerate(combinations(IDENTITY, size)):
            at = [f"{x}{size}{k}" for x in "abn"]
            made = out.select("merchant_id", *keys).where(" and ".join(f"{c} is not null" for c in keys)).groupBy(*keys)
            out = out.join(made.agg(*[e.alias(n) for e, n in zip((*names, F.count("*")), at)]), list(keys), "left")
            a, b, n = (F.coalesce(c, zero) for c in at)
            total = [total[0].bitwiseXOR(a), total[1].bitwiseXOR(b), total[2] + (n if size != 2 else -n)]
    return out.select("merchant_id", F.struct(total[0].alias("a"), total[1].alias("b")).alias("circle"), total[2].alias("size"))


def card_events(p: Portfolio) -> DataFrame:
    """Card rows of the scored day that are no refunds, whether settled or not, with the card's reference.

    References count the day's cards, wallet tokens among them, in order of their numbers.
    """
    if "card_events" in p.written:
        return p.written["card_events"]
    rows = p.sales().where(F.length(fold(F.coalesce("hashed_pan", F.lit("")))) > 0).withColumn("t", micros())
    cards = rows.select("hashed_pan").distinct()
    refs = tables.numbered(cards, [F.asc("hashed_pan")], "k").select("hashed_pan", F.concat(F.lit("card "), "k").alias("card_ref"))
    return rows.where(has_card()).join(refs, "hashed_pan").select("hashed_pan", "card_ref", "merchant_id", "source_txn_id", "occurred_at", "txn_date", "t")


def shared_identity(p: Portfolio, flagged: DataFrame, r: Rule) -> DataFrame:
    """One hit for each member and attribute of a group that holds enough flagged merchants."""
    each = identities(p.merchants).join(flagged.select("merchant_id", F.lit(1).alias("flag")), "merchant_id", "left")
    groups = each.groupBy("attribute", "value").agg(F.count("*").alias("n"), F.count("flag").alias("k"))
    live = groups.where((F.col("n") >= r.value("min_members")) & (F.col("k") >= r.value("min_flagged")))
    found = each.join(live, ["attribute", "value"])
    score = F.least(0.4 + 0.1 * F.col("n") + 0.1 * F.col("k"), F.lit(1.0))
    return hit(found, r.name, F.concat(F.lit("merchants_sharing_"), F.col("attribute")), F.col("n"), F.lit(r.value("min_members")), F.col("n") - r.value("min_members"), score, F.col("k"), "C")


def agent_concentration(p: Portfolio, flagged: DataFrame, r: Rule) -> DataFrame:
    """The flagged merchants of agents whose books alert far more often than the portfolio."""
    total = p.merchants.agg(F.count("*").alias("total"))
    rate = flagged.agg(F.count("*").alias("k")).join(total).select((F.col("k") / F.col("total")).alias("portfolio"))
    flags = p.merchants.where("agent_id is not null and agent_id <> ''").join(flagged.select("merchant_id", F.lit(1).alias("flag")), "merchant_id", "left")
    books = flags.groupBy("agent_id").agg(F.count("*").alias("n"), F.count("flag").alias("k")).withColumn("v", F.col("k") / F.col("n"))
    live = books.join(rate).where((F.col("portfolio") > 0) & (F.col("n") >= r.value("min_merchants")) & (F.col("v") >= F.col("portfolio") * r.value("rate_multiple")))
    found = flags.where("flag = 1").join(live, "agent_id")
    return hit(found, r.name, "agent_book_alert_rate", F.col("v"), F.col("portfolio"), F.col("v") / F.col("portfolio"), F.least("v", F.lit(1.0)), F.col("k"), "C", (4, 4, 2))


def _busiest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, merchant_id): the merchant with the most rows; of equals the first by id."""
    counts = rows.groupBy(*keys, "merchant_id").agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("c"), "merchant_id")).alias("m")).select(*keys, F.col("m.merchant_id").alias("merchant_id"))


def branch_cases(p: Portfolio, r: Rule) -> tuple[DataFrame, DataFrame]:
    """(cases, focus): cards at more branches of one owner in a day than allowed, and the rows at those branches.

    A case is a card, a day and an owner group; ``subject`` names it without the card's number.
    """
    rows = card_events(p).join(circles(p.merchants).where("size > 1"), "merchant_id")
    subject = F.concat_ws(" ", "card_ref", F.col("txn_date").cast("string"), F.hex("circle.a"))
    rows = rows.withColumn("subject", subject)
    keys = ["hashed_pan", "card_ref", "subject"]
    live = rows.groupBy(*keys).agg(F.countDistinct("merchant_id").alias("n"), F.count("*").alias("evidence")).where(F.col("n") > r.value("max_branches"))
    cases = live.join(_busiest(rows, keys), keys)
    return cases, rows.join(live.select("subject"), "subject").select(*FOCUS)


def branch_structuring(p: Portfolio, flagged: DataFrame, r: Rule) -> DataFrame:
    """A card at more branches of one owner in a day than allowed: one hit for card, day and owner group."""
    cases, _ = branch_cases(p, r)
    over = F.col("n") - r.value("max_branches")
    return hit(cases, r.name, "related_merchants_per_card_per_day", F.col("n"), F.lit(r.value("max_branches")), over, F.least(0.5 + 0.1 * over, F.lit(1.0)), F.col("evidence"), "C")


def swarm_windows(p: Portfolio, r: Rule) -> DataFrame:
    """(hashed_pan, t0, t1, last, touched, apart): a card's first window with enough unrelated merchants.

    A window ends at an event and reaches back ``window_minutes``, both ends included; of events at
    one instant the later by id see the earlier. Only cards with enough merchants that day are swept.
    """
    reach, least = int(r.value("window_minutes") * 60_000_000), r.value("min_merchants")
    events = card_events(p).select("hashed_pan", "merchant_id", "t", F.col("source_txn_id").alias("id"))
    busy = events.groupBy("hashed_pan").agg(F.countDistinct("merchant_id").alias("m")).where(F.col("m") >= least)
    swept = sweep.counts(events.join(busy.select("hashed_pan"), "hashed_pan"), identities(p.merchants), "hashed_pan", "merchant_id", reach)
    live = swept.where((F.col("touched") >= least) & (F.col("apart") >= least))
    first = live.groupBy("hashed_pan").agg(F.min(F.struct("t", "id", "touched", "apart")).alias("w"))
    return first.select("hashed_pan", (F.col("w.t") - reach).alias("t0"), F.col("w.t").alias("t1"), F.col("w.id").alias("last"), "w.touched", "w.apart")


def swarm_cases(p: Portfolio, r: Rule) -> tuple[DataFrame, DataFrame]:
    """(cases, focus): each card's first window with enough unrelated merchants, and the rows in it."""
    windows = swarm_windows(p, r)
    rows = card_events(p).join(windows, "hashed_pan").where("t >= t0 and (t < t1 or (t = t1 and source_txn_id <= last))").withColumn("subject", F.col("card_ref"))
    each = rows.groupBy("hashed_pan", "card_ref", "subject").agg(F.count("*").alias("evidence"))
    return windows.join(each, "hashed_pan").join(_busiest(rows, ["hashed_pan"]), "hashed_pan"), rows.select(*FOCUS)


def card_swarm(p: Portfolio, flagged: DataFrame, r: Rule) -> DataFrame:
    cases, _ = swarm_cases(p, r)
    limit = r.value("min_merchants")
    return hit(cases, r.name, "unrelated_merchants_per_card_window", F.col("touched"), F.lit(limit), F.col("touched") - limit, F.least(0.4 + 0.1 * F.col("apart"), F.lit(1.0)), F.col("evidence"), "C")


def legs(p: Portfolio, places: DataFrame, r: Rule) -> DataFrame:
    """Journeys of cards between consecutive events at different, located merchants that are too fast."""
    at = geo.locate(p.merchants, places)
    w = Window.partitionBy("hashed_pan").orderBy("t", "source_txn_id")
    pairs = card_events(p).select(
        "hashed_pan", "card_ref", "merchant_id", "source_txn_id", "t",
        *[F.lag(c).over(w).alias(f"from_{c}") for c in ("merchant_id", "source_txn_id", "t")],
    )
    minutes = (F.col("t") - F.col("from_t")) / F.lit(60_000_000.0)
    near = pairs.withColumn("minutes", minutes).where((F.col("merchant_id") != F.col("from_merchant_id")) & (F.col("minutes") > 0) & (F.col("minutes") <= r.value("max_minutes")))
    start = at.select(F.col("merchant_id").alias("from_merchant_id"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    far = near.join(at, "merchant_id").join(start, "from_merchant_id")
    km = geo.haversine(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon"))
    timed = far.withColumn("km", km).withColumn("kmh", geo.speed(F.col("km"), F.col("minutes")))
    return timed.where((F.col("km") >= r.value("min_km")) & (F.col("kmh") > r.value("max_kmh")))


def geo_cases(p: Portfolio, r: Rule, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, focus): cards with a leg that is too fast, and the rows at the ends of such legs.

    The arrival of the fastest leg carries the case; of equals the first by id.
    """
    far = legs(p, places, r).withColumn("subject", F.col("card_ref"))
    keys = ["hashed_pan", "card_ref", "subject"]
    worst = far.groupBy(*keys).agg(F.min(F.struct(-F.col("kmh"), "source_txn_id", "merchant_id")).alias("w"), F.count("*").alias("evidence"))
    cases = worst.select(*keys, F.col("w.merchant_id").alias("merchant_id"), (-F.col("w.col1")).alias("kmh"), "evidence")
    ends = far.select("hashed_pan", "subject", F.explode(F.array(*[F.struct(F.col(f"{x}merchant_id").alias("merchant_id"), F.col(f"{x}source_txn_id").alias("source_txn_id")) for x in ("", "from_")])).alias("e"))
    return cases, ends.select("hashed_pan", "subject", "e.merchant_id", "e.source_txn_id").distinct()


def geo_velocity(p: Portfolio, flagged: DataFrame, r: Rule, places: DataFrame) -> DataFrame:
    """One hit for each card with a leg that is too fast."""
    cases, _ = geo_cases(p, r, places)
    limit = r.value("max_kmh")
    return hit(cases, r.name, "implied_travel_speed_kmh", F.col("kmh"), F.lit(limit), F.col("kmh") / limit, F.least(F.col("kmh") / (4 * limit), F.lit(1.0)), F.col("evidence"), "C", (1, None, 2))


#: Columns of the rows that a card's case rests on.
FOCUS = ("hashed_pan", "subject", "merchant_id", "source_txn_id")
#: What a case says of the rows that it rests on.
_REASONS = {
    "card_across_related_merchants": lambda n: F.lit("same card, same owner group, same day"),
    "card_swarm": lambda n: F.lit("part of a same-card burst across merchants"),
    "impossible_geo_velocity": lambda n: F.concat(F.lit("same card at "), n.cast("string"), F.lit(" merchants, at times the journey between them does not allow")),
}


def card_cases(p: Portfolio, places: DataFrame, rules: list[Rule]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(cases, focus) of every enabled rule about cards, by rule."""
    make = {"card_across_related_merchants": branch_cases, "card_swarm": swarm_cases, "impossible_geo_velocity": lambda p, r: geo_cases(p, r, places)}
    return {r.name: make[r.template](p, r) for r in rules if r.enabled and r.template in make}


def linkage(p: Portfolio, places: DataFrame, rules: list[Rule]) -> DataFrame:
    """(detector, merchant_id, subject, card_ref, related, merchants, transactions): what each case about a card links.

    ``merchant_id`` carries the alert. How many merchants and transactions a case links is counted;
    which, is in ``trails``: a card may touch very many.
    """
    out, templates = [], {r.name: r.template for r in rules}
    for name, (cases, focus) in card_cases(p, places, rules).items():
        sizes = focus.groupBy("subject").agg(F.countDistinct("merchant_id").alias("merchants"), F.count("*").alias("transactions"))
        related = F.lit(templates[name] == "card_across_related_merchants")
        out.append(cases.join(sizes, "subject").select(F.lit(name).alias("detector"), "merchant_id", "subject", "card_ref", related.alias("related"), "merchants", "transactions"))
    return reduce(DataFrame.unionByName, out)


def trails(p: Portfolio, places: DataFrame, rules: list[Rule]) -> DataFrame:
    """(detector, subject, card_ref, carrier, source_txn_id, occurred_at, field, value, focus, reason): the whole day of each case's card, across all merchants.

    What else a card did has to be on the page; the rows that the case rests on are told apart by
    ``focus`` and by their reason. These are the contributions of hits about cards.
    """
    out, templates = [], {r.name: r.template for r in rules}
    for name, (cases, focus) in card_cases(p, places, rules).items():
        n = focus.groupBy("subject").agg(F.countDistinct("merchant_id").alias("__n"))
        own = cases.join(n, "subject").select("hashed_pan", "card_ref", "subject", F.col("merchant_id").alias("carrier"), "__n")
        day = card_events(p).select("hashed_pan", "merchant_id", "source_txn_id", "occurred_at").join(own, "hashed_pan")
        both = day.join(focus.select("subject", "source_txn_id", F.lit(True).alias("__f")), ["subject", "source_txn_id"], "left")
        mark = F.coalesce("__f", F.lit(False))
        reason = F.when(mark, _REASONS[templates[name]](F.col("__n"))).otherwise(F.lit("same card, same day — context for the trail"))
        out.append(both.select(
            F.lit(name).alias("detector"), "subject", "card_ref", "carrier", "source_txn_id", "occurred_at", F.lit("merchant_id").alias("field"), F.col("merchant_id").alias("value"),
            mark.alias("focus"), reason.alias("reason"),
        ))
    return reduce(DataFrame.unionByName, out)


def journeys(p: Portfolio, places: DataFrame, r: Rule) -> DataFrame:
    """The legs behind cases of impossible travel as they are shown: places, times, and rounded arithmetic."""
    name = F.coalesce(F.nullif(F.col("merchant_subdistrict"), F.lit("")), F.nullif(F.col("merchant_district"), F.lit("")), F.lit("unknown"))
    named = p.merchants.select("merchant_id", name.alias("place"))
    here, there = named.select(F.col("merchant_id").alias("from_merchant_id"), F.col("place").alias("from_place")), named.withColumnRenamed("place", "to_place")
    far = legs(p, places, r).join(here, "from_merchant_id").join(there, "merchant_id")
    limit = r.value("max_kmh")
    return far.select(
        F.col("card_ref").alias("subject"), F.col("from_merchant_id").alias("from_merchant"), "from_place", F.col("from_source_txn_id").alias("from_txn_id"), "from_t",
        F.col("merchant_id").alias("to_merchant"), "to_place", F.col("source_txn_id").alias("to_txn_id"), F.col("t").alias("to_t"),
        rounded(F.col("km"), 2).alias("distance_km"), rounded(F.col("minutes"), 1).alias("minutes"), rounded(F.col("kmh"), 1).alias("kmh"), F.lit(round(limit, 1)).alias("limit_kmh"), rounded(F.col("kmh") / limit, 2).alias("over_limit_multiple"),
    )


EVALUATORS = {
    "shared_identity_ring": shared_identity, "agent_alert_concentration": agent_concentration,
    "card_across_related_merchants": branch_structuring, "card_swarm": card_swarm, "impossible_geo_velocity": geo_velocity,
}


def evaluate(p: Portfolio, flagged: DataFrame, places: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of all enabled rules of family C, given the merchants that are flagged already."""
    validate(rules)
    found = [EVALUATORS[r.template](p, flagged, r, *([places] if r.template == "impossible_geo_velocity" else [])) for r in rules if r.enabled and r.template in EVALUATORS]
    none = hit(p.merchants.limit(0), "", "", F.lit(0.0), F.lit(0.0), F.lit(0.0), family="C")
    return reduce(DataFrame.unionByName, found, none)
