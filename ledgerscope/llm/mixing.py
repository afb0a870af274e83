"""Mixing sources to target weights: temperature, then budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize, with_columns


@dataclass(frozen=True)
class Mix:
    """What the mixture has to meet.

    The weights are token shares to the power of an exponent between 0 (all sources alike) and 1
    (as they are). ``repetition`` bounds the passes over any source; ``entropy``, a share of the
    way from the natural entropy (0) to the largest (1), bounds the flattening. The smallest
    exponent that meets all given bounds is taken. ``budget`` is the number of tokens to deal out;
    None is the smallest budget that takes each source at least once, so that no document is lost.
    """

    repetition: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None
    blocks: int = 1024  #: blocks of each source, at most
    seed: int = 7
    broadcast_rows: int = 100_000  #: a plan of more rows is joined by a shuffle


def count_tokens(text: str = "text"):
    """Words by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The smallest exponent that meets the bounds, to 1e-6, by bisection.

    Both bounds are easier to meet the larger the exponent. ``sources(tokens)`` is aggregated in
    Spark at each step, whatever the number of sources.
    """
    live = sources.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    n, total, most, least = live.agg(F.count("*"), F.sum("t"), F.max("t"), F.min("t")).first()
    if not n or most == least:
        return 1.0
    if mix.budget and mix.repetition and mix.budget > mix.repetition * total:
        raise ValueError(f"{mix.budget} tokens take more than {mix.repetition} passes over all {total}")
    share = F.col("t") / F.lit(most)

    def measured(a: float) -> tuple[float, float]:
        """Normalisation and entropy at an exponent."""
        z, s = live.agg(F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share) * a)).first()
        return z, math.log(z) - s / z

    natural = measured(1.0)[1]

    def meets(a: float, z: float, entropy: float) -> bool:
        # passes over a source: weight * budget / tokens, largest for the smallest source
        passes = (most / least) ** (1 - a) if mix.budget is None else mix.budget / most / z * (least / most) ** (a - 1)
        most_entropy = None if mix.entropy is None else natural + mix.entropy * (math.log(n) - natural)
        return (mix.repetition is None or passes <= mix.repetition * (1 + 1e-9)) and (most_entropy is None or entropy <= most_entropy + 1e-9)

    if meets(0.0, *measured(0.0)):
        return 0.0
    low, high = 0.0, 1.0  # the bounds hold at high, not at low
    while high - low > 1e-6:
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle, *measured(middle)) else (middle, high)
    return high


def plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """``(source, block, epoch, block_rank, room)``: the blocks that each pass over a source takes.

    Every pass takes the blocks in an order of its own. ``room`` is null where a block is taken
    whole, else the tokens left for it at the end of the source's budget.
    """
    sized = materialize(_blocked(docs, mix).groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = materialize(sized.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    a = exponent(sources, mix)
    live = sources.where("tokens > 0")
    most, z = live.agg(F.max("tokens").cast("double"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()
    budget = 0.0 if not most else mix.budget if mix.budget is not None else z * most ** (1 - a)
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z or 1.0)
    dealt = F.when(F.col("tokens") > 0, F.round(weight * F.lit(float(budget)))).otherwise(0).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("dealt") / F.col("tokens"))).otherwise(1).cast("int")
    passed = sources.withColumn("dealt", dealt).withColumn("passes", passes)
    left = F.when(F.col("tokens") > 0, F.col("dealt") - F.col("passes") * F.col("tokens")).otherwise(0)
    epochs = passed.select(F.col("source").alias("s"), "passes", left.alias("left"), F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("epoch"))
    each = sized.join(epochs, sized["source"].eqNullSafe(epochs["s"])).drop("s").where("epoch < passes or left > 0")
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(mix.seed), "epoch", "block"), "block")
    ranked = each.withColumn("block_rank", F.row_number().over(turn) - 1).withColumn(
        "before", F.coalesce(F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    last = F.col("epoch") == F.col("passes")
    room = F.when(last & (F.col("before") + F.col("tokens") > F.col("left")), F.col("left") - F.col("before"))
    return ranked.withColumn("room", room).where("room is null or room > 0").select("source", "block", "epoch", "block_rank", "room")


def _blocked(docs: DataFrame, mix: Mix) -> DataFrame:
    block = F.pmod(F.xxhash64(F.lit(mix.seed), F.col("doc_id"), F.col("text")), F.lit(mix.blocks)).cast("int")
    return with_columns(docs, {"tokens": count_tokens(), "block": block})


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` as the mixture takes them, with ``tokens, block, epoch, block_rank`` (replacing columns of those names).

    A document occurs once for each pass that takes it; sorting by (source, epoch, block_rank,
    hash of the document) gives the order of a source's stream. Tokens are words. A null source is
    a source like any other; a source without tokens is passed once; a null text has no tokens.
    Within the one block that a source's budget ends in, parts of it come in hash order and, in the
    part that the budget ends in, documents, as long as the budget is not used up. A budget of more
    passes than ``repetition`` is refused. Repeated rows count as often as they occur; an empty table gives no
    rows.
    """
    taken = materialize(plan(docs.select("doc_id", "source", "text"), mix), "mix-plan")
    small = taken.count() <= mix.broadcast_rows
    named = taken.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "epoch", "block_rank", "room")

    def joined(part: DataFrame) -> DataFrame:
        part = F.broadcast(part) if small else part
        left = _blocked(docs.drop("epoch", "block_rank", "room"), mix)
        return left.join(part, left["source"].eqNullSafe(part["__s"]) & (left["block"] == part["__b"])).drop("__s", "__b")

    whole = joined(named.where("room is null")).drop("room")
    parted = with_columns(joined(named.where("room is not null")), {"__part": F.pmod(F.xxhash64(F.lit(mix.seed + 1), "doc_id", "text"), F.lit(mix.blocks))})
    before = lambda turn: F.coalesce(F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = ["source", "block", "epoch"]
    sizes = parted.groupBy(*at, "room", "__part").agg(F.sum("tokens").alias("tokens"))
    ranked = sizes.withColumn("__before", before(Window.partitionBy(*at).orderBy(F.xxhash64("epoch", "__part"), "__part"))).where("__before < room")
    parts = materialize(ranked.select(*[F.col(c).alias(f"__{c}") for c in at], F.col("__part").alias("__p"), (F.col("room") - F.col("__before")).alias("__room")), "mix-parts")
    same = (parted["source"].eqNullSafe(parts["__source"])) & (parted["block"] == parts["__block"]) & (parted["epoch"] == parts["__epoch"]) & (parted["__part"] == parts["__p"])
    live = parted.drop("room").join(parts, same)
    turn = Window.partitionBy(*at, "__part").orderBy(F.xxhash64(F.lit(mix.seed), "epoch", "doc_id"), "doc_id")
    cut = live.withColumn("__before", before(turn)).where("__before < __room")
    return whole.unionByName(cut.select(whole.columns))
