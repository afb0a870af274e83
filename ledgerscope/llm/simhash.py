"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.components import components
from ledgerscope.llm.shared import materialize, ship, with_columns

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the word shingles of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), 42) for s in zip(*parts)), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8")[0])


def add_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` as a signed long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    ship(docs.sparkSession)
    return with_columns(docs, {name: prints(F.col(f"`{text_col}`"))})


def ball(bits: int, radius: int) -> list[int]:
    """Signed masks that flip up to ``radius`` of ``bits`` bits, the empty one included."""
    masks = [sum(1 << b for b in at) for r in range(radius + 1) for at in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints ``fp`` differing in at most ``distance`` bits.

    Two fingerprints within ``distance`` share a variant within ``ceil(distance / 2)`` flips of
    both. All fingerprints of one variant are sorted and chained, neighbour to neighbour, so a
    variant gives fewer edges than it has members. For an even ``distance`` any two members of a
    variant are within it, so chaining loses no link; the pairs are deduplicated and verified all
    the same. An odd ``distance`` is refused.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    masks = F.array(*[F.lit(m) for m in ball(64, distance // 2)])
    variants = prints.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    chained = variants.select("fp", F.lag("fp").over(Window.partitionBy("v").orderBy("fp")).alias("b"))
    pairs = chained.where("b is not null").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Words are lower-cased in A-Z and split at ASCII white space; a bit is set if it is set in over
    half of the shingles' XXH64 values. Fewer words than a shingle give one shingle of them all; a
    null, empty or blank text has fingerprint zero, which links like any other. Repeated rows stay
    repeated; a row with a null id takes part in its component but names it only if no member has
    an id. An empty table gives an empty result.
    """
    parts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    marked = materialize(add_fingerprint(parts, "text", shingle).drop("text"), "simhash-fp")
    each = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-each")
    roots = components(close_pairs(each.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(names, "root").select("fp", "component_id"), "simhash-named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select(id_col, digits, "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, distance: int = 2) -> DataFrame:
    """``docs`` without near copies: of each group the document with the smallest id stays.

    Of rows that repeat the smallest id, one stays. A row without an id can't be named as a copy,
    so it stays.
    """
    ids = near_duplicates(docs.select("doc_id", "text"), shingle=shingle, distance=distance)
    firsts = ids.where("doc_id = component_id").select("doc_id").distinct()
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
    named = docs.join(firsts, "doc_id", "left_semi").withColumn("__row", row).where("__row = 1").drop("__row")
    return named.select(docs.columns).unionAll(docs.where("doc_id is null"))
