"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import shared_path, ship, with_columns

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6, 7)
#: Changes of a learner's state are summed as whole multiples of 2 ** -STEP.
STEP = 36


@dataclass(frozen=True)
class FtrlParams:
    """Learner and bounds of the fit; the weights are at most 2^bits doubles, whatever the data."""

    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    passes: int = 10
    positive_weight: float = 5.0  #: of the gradients of class 1
    shards: int = 8  #: learners that run side by side; their states are averaged after each pass
    rows: int = 20_000  #: labelled documents learned from, at most; both classes are drawn at one rate


class _Hashes(dict):
    """Hash of a word, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 17)
        return out


_HASHES = _Hashes()


def features(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct hash indexes of the words, their stems, word pairs and pairs that skip one word.

    Stems are words cut to the lengths in STEMS: languages that build words by joining parts have
    few words twice, but their first parts often.
    """
    words = WORD.findall(text.lower()) if text else []
    stems = {w[:k] + "*" for w in set(words) for k in STEMS if len(w) > k}
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    mix = lambda a, b, by: (a * np.uint64(by)) ^ (b + (a >> np.uint64(31)))
    s = np.fromiter(map(_HASHES.__getitem__, stems), np.uint64, len(stems))
    parts = [h, s, mix(h[:-1], h[1:], 0x9E3779B97F4A7C15), mix(h[:-2], h[2:], 0xC2B2AE3D27D4EB4F)]
    spread = np.concatenate(parts) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique((spread >> np.uint64(64 - bits)).astype(np.int32))


def weights(z: np.ndarray, n: np.ndarray, p: FtrlParams) -> np.ndarray:
    """FTRL-proximal weights; those whose |z| is within l1 are zero."""
    return np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def learn(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, p: FtrlParams) -> None:
    """One pass of per-coordinate updates over ``rows``, in place; the last coordinate is the bias."""
    bias = np.array([len(z) - 1])
    heavy = p.positive_weight
    for x, y in zip(rows, labels):
        i = np.concatenate([x, bias])
        w = weights(z[i], n[i], p)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        g *= heavy if y else 1.0
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
        n[i] += g * g


class ToxicModel:
    """Sparse weights, kept dense for lookups, and a bias."""

    def __init__(self, w: np.ndarray, p: FtrlParams):
        self.w, self.p = w, p

    def score(self, text: str | None) -> float:
        s = self.w[features(text, self.p.bits)].sum() + self.w[-1]
        return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))


def sample(labelled: DataFrame, p: FtrlParams) -> DataFrame:
    """``(doc_id, y)``: of all labelled ids those with the ``rows`` smallest hashes.

    The hash knows nothing of the class, so the classes keep their natural balance, and with it the
    odds behind a score, whatever the size of the table.
    """
    each = labelled.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.rows)


def fit(docs: DataFrame, labelled: DataFrame, p: FtrlParams = FtrlParams()) -> ToxicModel:
    """Learn from ``labelled(doc_id, y)``, y 0 or 1, and the whole texts of those ``docs``.

    Several labels of one id count as their largest, of several texts of one id the least is learned
    from. The drawn ids, bounded by ``rows``, are broadcast to the texts. Their features are written
    once. A row's learner follows from its id, so there are ``shards`` learners on any cluster. In each pass
    every learner starts from the common state and takes its rows in order of their hash; the changes
    are averaged, as whole multiples of 2^-STEP, so that their sum doesn't hang on its order. Equal tables give equal
    scores, whatever their partitioning. Without labelled rows all weights are zero and every score is 0.5.
    """
    spark = docs.sparkSession
    ship(docs.sparkSession)
    size = (1 << p.bits) + 1
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample(labelled, p)), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    @F.pandas_udf("array<int>")
    def indexed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t, p.bits) for t in texts])

    shard = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(p.shards)).alias("shard")
    # a table in buckets by learner: no pass shuffles it
    table = f"toxic_rows_{uuid.uuid4().hex}"
    made = drawn.select(shard, F.col("doc_id").cast("long"), F.col("y").cast("long"), indexed("text").alias("x")).repartition(p.shards, "shard")
    made.write.bucketBy(p.shards, "shard").format("parquet").option("compression", "zstd").option("path", shared_path(spark, "toxic-rows")).saveAsTable(table)
    rows = spark.table(table)
    z, n = np.zeros(size), np.zeros(size)
    for turn in range(p.passes):
        state = spark.sparkContext.broadcast((z, n))

        def one_pass(table: pa.Table) -> pa.Table:
            ids, y = table["doc_id"].to_pylist(), table["y"].to_numpy()
            order = sorted(range(len(ids)), key=lambda k: (xxhash.xxh64_intdigest(str(ids[k]), turn), ids[k]))
            x = [table["x"][k].values.to_numpy() for k in order]
            z0, n0 = state.value
            z1, n1 = z0.copy(), n0.copy()
            learn(x, y[order], z1, n1, p)
            i = np.flatnonzero(n1 != n0)
            return pa.table({"i": i, "dz": np.rint((z1[i] - z0[i]) * 2.0**STEP).astype(np.int64), "dn": np.rint((n1[i] - n0[i]) * 2.0**STEP).astype(np.int64)})

        moved = rows.groupBy("shard").applyInArrow(one_pass, "i long, dz long, dn long")
        # an entry that only one learner has seen moves by that learner's change
        step = moved.groupBy("i").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn"), F.count("*").alias("c")).toPandas()
        z[step["i"]] += step["dz"] / step["c"] / 2.0**STEP
        n[step["i"]] += step["dn"] / step["c"] / 2.0**STEP
        state.unpersist()
    spark.sql(f"DROP TABLE {table}")
    return ToxicModel(weights(z, n, p), p)


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from 0.5 on), replacing columns of those names.

    Only the whole text counts; a null or empty one has the bias alone. Repeated rows get equal
    scores; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)

    out = with_columns(docs, {"score": scored(F.col(f"`{text_col}`"))})
    return with_columns(out, {"predicted": (F.col("score") >= 0.5).cast("int")})
