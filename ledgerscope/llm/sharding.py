"""Sharding by rendezvous hashing: each record goes to the shard that bids least for its key."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize, with_columns

#: The bids are taken modulo this prime, so that products of two fit in 64 bits.
PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Shards:
    """The shards' weights by number; a shard of twice the weight takes twice the keys."""

    weights: tuple[float, ...] = (1.0,) * 24
    seed: int = 11

    def salts(self) -> list[tuple[int, int, int, float]]:
        """(shard, a, b, weight) of each shard; a shard's salts depend on its number and the seed alone."""
        if not self.weights or min(self.weights) <= 0:
            raise ValueError("there must be shards, of positive weight")
        words = [hashlib.md5(f"{self.seed}:{s}".encode()).hexdigest() for s in range(len(self.weights))]
        return [(s, int(h[:8], 16) % PRIME, int(h[8:16], 16) % PRIME, float(w)) for s, (h, w) in enumerate(zip(words, self.weights))]

    def grown(self, weight: float = 1.0) -> Shards:
        """The same shards and one more."""
        return Shards((*self.weights, weight), self.seed)


def key_words(key: Column) -> tuple[Column, Column]:
    """Two 31-bit words of a record's key, from one digest; a null key is an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME
    return word(1), word(9)


def bid(k1: Column, k2: Column, a: Column, b: Column, weight: Column) -> Column:
    """Exponential bid of a shard for a key: the least of all bids falls to a shard in proportion to its weight."""
    x = ((k1 + a) % PRIME) * ((k2 + b) % PRIME) % PRIME
    y = x * ((x + k2) % PRIME) % PRIME
    return -F.log((y + 0.5) / PRIME) / weight


def assign(records: DataFrame, key: str, shards: Shards = Shards(), more: float | None = None) -> DataFrame:
    """``records`` with ``shard`` and, with the weight of one ``more`` shard, ``grown_shard`` (columns of those names give way).

    The key's value and the shards alone decide: equal keys share a shard, wherever and however
    often they come; a null key is a key like any other. Of equal bids the smaller shard takes the
    record. A shard's bid depends on no other, so a shard that is added takes records only into
    itself (a share of its weight), one that is removed gives away only its own, and a changed
    weight moves records only from or to that shard. No shuffle; the shards are literals of the
    expression. An empty table gives no rows.
    """
    k1, k2 = key_words(F.col(f"`{key}`"))
    named = with_columns(records, {"__k1": k1, "__k2": k2})
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("s", "a", "b", "w"), row)]) for row in shards.salts()])
    offer = lambda t: F.struct(bid(F.col("__k1"), F.col("__k2"), t["a"], t["b"], t["w"]).alias("bid"), t["s"].alias("s"))
    out = named.withColumn("__least", F.array_min(F.transform(table, offer)))
    new = {"shard": F.col("__least.s").cast("int")}
    if more is not None:
        s, a, b, w = shards.grown(more).salts()[-1]
        offered = bid(F.col("__k1"), F.col("__k2"), F.lit(a), F.lit(b), F.lit(w))
        new["grown_shard"] = F.when(offered < F.col("__least.bid"), F.lit(s)).otherwise(F.col("__least.s")).cast("int")
    return with_columns(out, new).drop("__k1", "__k2", "__least")


def numbered(placed: DataFrame, order: list[str]) -> DataFrame:
    """``placed`` with ``slot``: rows of each ``shard`` from 0 without gaps, in ``order`` (nulls first).

    Rows are dealt to ranges of (shard, order), written with their range, and numbered within the
    part of a shard that a range holds; only the parts' sizes are summed along a shard. Rows that
    are alike in all columns of the order are told apart by their place in the input, so that a
    range never has to hold all copies of one row. ``placed`` should be narrow: it is written twice.
    """
    thin = materialize(with_columns(placed, {"__row": F.monotonically_increasing_id()}), "shards")
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (*order, "__row")]
    ranged = materialize(thin.repartitionByRange(F.col("shard"), *by).withColumn("__part", F.spark_partition_id()), "shard-ranges")
    sizes = ranged.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("shard", "__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("shard", "__part").orderBy(*by))
    out = ranged.join(before, ["shard", "__part"]).withColumn("slot", (F.col("__before") + place - 1).cast("long"))
    return out.drop("__row", "__part", "__before")


def shard_documents(docs: DataFrame, shards: Shards = Shards(), more: float = 1.0) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: none) and 8; the checksum is of those bytes. The law is
    ``key``: doc_id and the shards decide (see ``assign``), ``grown_shard`` is the shard with one
    more of weight ``more``. Slots follow (doc_id, checksum, size) within a shard, whatever the
    partitioning of ``docs``. Repeated rows get slots of their own; other columns are not read.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    thin = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = numbered(assign(thin, "doc_id", shards, more), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(records: DataFrame, key: str, path: str, shards: Shards = Shards()) -> None:
    """Write whole ``records`` as Parquet, a folder ``shard=<k>`` for each shard.

    A shard's rows are dealt out by size, so that a large one is written by many tasks and small
    ones don't scatter into a file for each task.
    """
    assign(records, key, shards).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def twin(shards: Shards = Shards(), more: float = 1.0) -> str:
    """``shard_documents`` over the view ``documents`` in SQL."""
    rows = ", ".join(str(r) for r in shards.grown(more).salts())
    last = len(shards.weights)
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
        lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END) AS c FROM range(256) r(i))),
     raw AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     d AS (SELECT r, doc_id, octet_length(raw) + 8 AS size,
        list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS octets,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) % {PRIME} AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % {PRIME} AS k2 FROM raw),
     s(shard, a, b, w) AS (VALUES {rows}),
     x AS (SELECT r, shard, w, k2, ((k1 + a) % {PRIME}) * ((k2 + b) % {PRIME}) % {PRIME} AS x FROM d, s),
     o AS (SELECT r, shard, -ln((x * ((x + k2) % {PRIME}) % {PRIME} + 0.5) / {PRIME}) / w AS bid FROM x),
     p AS (SELECT r, min((bid, shard)) FILTER (shard < {last}) AS own, min((bid, shard)) AS grown FROM o GROUP BY r),
     z AS (SELECT doc_id, size, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), octets),
        lambda a, y: xor(a // 256, tab[xor(a, y) % 256 + 1]))) AS text_crc32, own[2] AS shard, grown[2] AS grown_shard FROM d JOIN p USING (r), crc)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM z
"""
