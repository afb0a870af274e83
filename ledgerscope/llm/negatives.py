"""Hard negatives by exact inner products: clusters of anchors walk shared lists sorted by angular bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize, ship

#: Scale of the components; percentages of the positive's score between which negatives lie.
SCALE, LOW, HIGH = 256, 30, 90
#: Angles and bounds carry rounding errors below these.
ANGLE_SLACK, BOUND_SLACK = 1e-6, 1e-9
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class NegativeParams:
    anchors: int = 100  #: anchors are the rows whose id is divisible by this
    positives: int = 5
    negatives: int = 10
    members: int = 128  #: anchors of a cluster, about
    clusters: int = 1024  #: clusters of all anchors, at most
    sample: int = 16_384  #: anchors that the clusters' centers are fitted to, at most, drawn by hash
    block: int = 2048  #: anchors of a cluster that walk in one task
    slice: int = 2048  #: candidates of a list that are walked in one task, about
    step: int = 256  #: candidates that are scored at a time
    seed: int = 12


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, which hold it exactly."""
    return np.floor(SCALE * x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, pinned to 62 bits beyond that."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in a], object) @ np.array([[int(v) for v in row] for row in b], object).T
    return np.array([[min(max(int(s), LEAST), MOST) for s in row] for row in exact], np.int64)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms) of rows; a zero row keeps a zero direction."""
    top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    y = x / np.where(top > 0, top, 1)
    length = np.sqrt((y * y).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return y / np.where(length > 0, length, 1), (top * length)[:, 0]


def angles(units: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ center, -1.0, 1.0))


@dataclass
class Walk:
    """Anchors of one cluster and the windows of scores in which each looks for its ``k`` best candidates."""

    vectors: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    low: np.ndarray  #: anchors x windows: the least score that counts
    high: np.ndarray  #: and the greatest
    same: bool  #: candidates of the anchor's own label, else of another
    k: int


def walk(w: Walk, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray, ids: np.ndarray, step: int) -> list[tuple[int, int, int, int]]:
    """(anchor, window, score, candidate), the ``k`` best of each window, of equals the smaller id.

    The candidates are sorted once for all anchors by norm times the cosine of the least angle that
    an anchor within the cluster's radius can have to them. Every anchor walks that list from the
    top and leaves it when the next bound, times its own norm, is below what all its windows still
    ask for: then no candidate further down can count.
    """
    units, norms = directions(w.vectors)
    center = units.sum(axis=0)
    size = float(np.linalg.norm(center))
    center = center / size if size > 0 else center
    turned = norms > 0
    radius = float(angles(units[turned], center).max(initial=0.0)) if size > 0 else math.pi
    theirs, lengths = directions(vectors)
    nearest = np.maximum(0.0, angles(theirs, center) - radius - ANGLE_SLACK) if size > 0 else np.zeros(len(vectors))
    with np.errstate(invalid="ignore"):
        ceiling = np.nan_to_num(lengths * np.cos(nearest), nan=np.inf)
    order = np.argsort(-ceiling, kind="stable")
    low, found = w.low.copy(), {}
    live = np.arange(len(w.rows))
    for at in range(0, len(order), step):
        with np.errstate(invalid="ignore"):
            bound = norms[live] * ceiling[order[at]]
        bound = np.nan_to_num(bound + np.abs(bound) * BOUND_SLACK + BOUND_SLACK, nan=np.inf)
        wanted = np.where(low[live] <= w.high[live], low[live], MOST).min(axis=1)
        live = live[bound >= wanted]
        if not len(live):
            break
        part = order[at : at + step]
        scores = products(w.vectors[live], vectors[part])
        alike = w.labels[live][:, None] == labels[part][None, :]
        fit = alike & (w.rows[live][:, None] != rows[part][None, :]) if w.same else ~alike
        for j in range(low.shape[1]):
            a, c = np.nonzero(fit & (scores >= low[live, j][:, None]) & (scores <= w.high[live, j][:, None]))
            if not len(a):
                continue
            starts = np.flatnonzero(np.r_[True, np.diff(a) > 0])
            for s, e in zip(starts, [*starts[1:], len(a)]):
                anchor, key = int(live[a[s]]), (int(live[a[s]]), j)
                more = np.stack([scores[a[s], c[s:e]], ids[part[c[s:e]]], part[c[s:e]]])
                both = np.concatenate([found[key], more], axis=1) if key in found else more
                best = both[:, np.lexsort((both[1], -both[0]))[: w.k]]
                found[key] = best
                if best.shape[1] == w.k:
                    low[anchor, j] = max(low[anchor, j], best[0, -1])
    return [(anchor, j, int(s), int(c)) for (anchor, j), best in found.items() for s, c in zip(best[0], best[2])]


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector): rows that take part, some relabelled, components as doubles."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e * SCALE) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors.where(sound).select("vec_id", moved.alias("label"), v.alias("vector"))


def centers(anchors: DataFrame, p: NegativeParams) -> dict[int, np.ndarray]:
    """Directions of the clusters' centers by dimension, by spherical k-means over a bounded sample of anchors.

    Only the sample and counts by dimension reach the driver. A dimension that the sample misses has
    one cluster without a center, which bounds nothing.
    """
    counts = {r["dim"]: r["n"] for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(p.clusters).collect()}
    rows = anchors.orderBy(F.xxhash64(F.lit(p.seed), "row")).limit(p.sample).select("dim", "vector").collect()
    total, out = sum(counts.values()), {}
    for dim in sorted(counts.keys() & {r["dim"] for r in rows}):
        drawn = [r["vector"] for r in rows if r["dim"] == dim]
        units, norms = directions(whole(np.array(drawn, float).reshape(len(drawn), dim)))
        units = np.unique(units[norms > 0], axis=0)
        k = min(len(units), max(1, math.ceil(min(counts[dim] / p.members, p.clusters * counts[dim] / total))))
        if not k:
            continue
        units = units[np.random.default_rng(p.seed).permutation(len(units))]
        c = units[:k]
        for _ in range(8):
            of = (units @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, of, units)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), c)
        out[dim] = c
    return out


def _placed(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """``rows`` with ``cell`` (nearest center of the dimension), ``angle`` to it and ``norm``."""

    def place(batches):
        for b in batches:
            cell, angle, norm = np.zeros(len(b), np.int32), np.zeros(len(b)), np.zeros(len(b))
            lists, dims = b.column("vector"), b.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = whole(lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim))
                units, norm[at] = directions(x)
                if (c := shared.value.get(int(dim))) is not None:
                    cosines = units @ c.T
                    cell[at] = cosines.argmax(axis=1)
                    angle[at] = np.where(norm[at] > 0, np.arccos(np.clip(cosines.max(axis=1), -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle), pa.array(norm)], names=[*b.schema.names, "cell", "angle", "norm"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{kinds}, cell int, angle double, norm double")


def _parted(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``part``: those of a cell dealt by hash to parts of about ``size``."""
    n = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("__n"))
    return rows.join(n, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("__n"))).drop("__n")


_FOUND = "anchor long, window int, score long, vec_id long, candidate long"
_SIDE = ("row", "vec_id", "label", "vector", "low", "high")


def _grid(anchors: DataFrame, slices: DataFrame, pairs: DataFrame, same: bool, k: int, step: int) -> DataFrame:
    """What the anchors' blocks find in the slices that ``pairs(dim, cell, part, cell_b, part_b)`` names."""
    key = ["dim", "cell", "part", "cell_b", "part_b"]
    none = F.lit(None).cast("array<long>")
    left = anchors.join(pairs, ["dim", "cell", "part"]).select(*key, F.lit(0).alias("side"), *_SIDE)
    theirs = slices.withColumnsRenamed({"cell": "cell_b", "part": "part_b"}).withColumns({"low": none, "high": none})
    right = theirs.join(pairs, ["dim", "cell_b", "part_b"]).select(*key, F.lit(1).alias("side"), *_SIDE)

    def read(t: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
        return whole(t["vector"].combine_chunks().flatten().to_numpy().reshape(len(t), dim)), t["label"].to_numpy(), t["row"].to_numpy()

    def linked(key: tuple, rows: pa.Table) -> pa.Table:
        side, dim = rows["side"].to_numpy(), key[0].as_py()
        a, c = rows.filter(pa.array(side == 0)).sort_by("row"), rows.filter(pa.array(side == 1)).sort_by("row")
        out: list[tuple] = []
        if len(a) and len(c):
            windows = max(max(map(len, a["low"].to_pylist())), 1)
            pad = lambda lists, v: np.array([[*x, *[v] * (windows - len(x))] for x in lists.to_pylist()], np.int64)
            x, labels, numbers = read(a, dim)
            y, other, theirs = read(c, dim)
            names = c["vec_id"].to_pylist()
            ids = np.array([MOST if v is None else v for v in names], np.int64)  # a null id comes last among equals
            found = walk(Walk(x, labels, numbers, pad(a["low"], MOST), pad(a["high"], LEAST), same, k), y, other, theirs, ids, step)
            out = [(int(numbers[i]), j, s, names[q], int(theirs[q])) for i, j, s, q in found]
        columns = zip(*out) if out else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["anchor", "window", "score", "vec_id", "candidate"])

    return left.unionAll(right).groupBy(*key).applyInArrow(linked, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor's window, ranked from 1; each task gave ``k`` at most."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("candidate")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "window").orderBy(*order))).where(F.col("rank") <= k)


def _raised(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``anchors`` whose windows ask for at least the ``k``-th best score that is found already."""
    full = _top(found, k).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("__got"))
    got = lambda i: F.coalesce(F.element_at("__got", i), F.lit(LEAST).cast("long"))
    low = F.when(F.col("__got").isNull(), F.col("low")).otherwise(F.transform("low", lambda v, i: F.greatest(v, got(i))))
    return anchors.join(full.withColumnRenamed("anchor", "row"), "row", "left").withColumn("low", low).drop("__got")


class _Index:
    """Rows in cells and slices, anchors in blocks, and what bounds the scores between two cells."""

    def __init__(self, vectors: DataFrame, p: NegativeParams) -> None:
        spark = vectors.sparkSession
        ship(spark)
        self.p = p
        numbered = materialize(prepared(vectors).withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vector")}), "vectors")
        self.shared = spark.sparkContext.broadcast(centers(numbered.where(self.is_anchor()), p))
        placed = materialize(_placed(numbered, self.shared), "vectors-placed")
        self.slices = materialize(_parted(placed, p.slice), "vectors-slices")
        self.anchors = materialize(_parted(placed.where(self.is_anchor()), p.block), "vectors-anchors")
        self.parts = self.slices.groupBy("dim", "cell", "part").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm"))

    def is_anchor(self) -> Column:
        return F.col("vec_id") % self.p.anchors == 0

    def search(self, anchors: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The ``k`` best of each window of ``anchors(low, high)``: first in the anchors' own cells, then wherever bounds leave a chance."""
        other = self.parts.select("dim", F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("angle").alias("angle_b"), F.col("norm").alias("norm_b"))
        key = ["dim", "cell", "part"]
        home = anchors.select(*key).distinct().join(other, ["dim"]).where("cell = cell_b").select(*key, "cell_b", "part_b")
        near = materialize(_grid(anchors, self.slices, home, same, k, self.p.step), f"{name}-home")
        raised = materialize(_raised(anchors, near, k), f"{name}-raised")
        # the least that an anchor of the block still asks for, per unit of its norm
        asked = F.array_min(F.zip_with("low", "high", lambda a, b: F.when(a <= b, a.cast("double")).otherwise(F.lit(math.inf))))
        ratio = F.when((F.col("norm") > 0) & (asked > LEAST), asked / F.col("norm")).when(asked == math.inf, asked).otherwise(F.lit(-math.inf))
        blocks = raised.groupBy(*key).agg(F.min(ratio).alias("ratio"), F.max("angle").alias("angle")).where(F.col("ratio") < math.inf)
        shared = self.shared

        @F.pandas_udf("double")
        def between(dim: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            t = shared.value
            return pd.Series([float(angles(t[d][[i]], t[d][j])[0]) if d in t else 0.0 for d, i, j in zip(dim, a, b)], dtype=float)

        least = F.greatest(F.lit(0.0), between("dim", "cell", "cell_b") - F.col("angle") - F.col("angle_b") - 3 * ANGLE_SLACK)
        bound = F.col("norm_b") * F.greatest(F.cos(least), F.lit(0.0)) * (1 + BOUND_SLACK) + BOUND_SLACK
        far = blocks.join(other, "dim").where("cell <> cell_b").where(bound >= F.col("ratio")).select(*key, "cell_b", "part_b")
        rest = _grid(raised, self.slices, materialize(far, f"{name}-pairs"), same, k, self.p.step)
        return materialize(_top(near.unionAll(rest), k), name)


def mine(vectors: DataFrame, p: NegativeParams = NegativeParams()) -> DataFrame:
    """Hard negatives of ``vectors(vec_id, embedding, label)``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label or vector, or a null or non-finite component (also one that isn't finite
    when scaled) take no part; a vec_id divisible by 7 moves the label on. Scores are exact inner
    products of the scaled, floored components, pinned to 62 bits beyond that; vectors of different
    lengths are not compared. Of equal scores the smaller id comes first, null last; null ids are no
    anchors. Repeated rows are rows of their own: each is an anchor, and a copy may be its positive.
    Other columns are not read. An empty table, or one without anchors, gives no rows.

    Anchors are clustered; rows belong to the nearest center's cell and are dealt by hash to slices.
    A task holds a block of a cluster's anchors and one slice, whose list all of them walk. Each
    search goes first through the anchors' own cells; the scores found there are what the other
    slices have to reach, and a slice whose bound is below that is not read for the block.
    """
    index = _Index(vectors, p)
    array = lambda v: F.array(F.lit(v).cast("long"))
    asked = index.anchors.withColumns({"low": array(LEAST), "high": array(MOST)})
    positives = index.search(asked, True, p.positives, "positives").select("anchor", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # five scores an anchor
    per = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))), lambda x: x["positive_score"]).alias("__s"))
    s = lambda x: x.cast("decimal(38,0)")
    low = F.transform("__s", lambda x: F.ceil(s(x) * LOW / F.lit(100).cast("decimal(3,0)")).cast("long"))
    high = F.transform("__s", lambda x: F.floor(s(x) * HIGH / F.lit(100).cast("decimal(3,0)")).cast("long"))
    windows = index.anchors.join(per.withColumnRenamed("anchor", "row"), "row").withColumns({"low": low, "high": high}).drop("__s")
    negatives = index.search(windows, False, p.negatives, "negatives")
    names = index.anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    found = negatives.select("anchor", (F.col("window") + 1).alias("positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = reduce(lambda a, b: a.join(b[0], b[1]), [(positives, ["anchor", "positive"]), (names, ["anchor"])], found)
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: ``mine`` over the view ``embeddings`` in SQL.
TWIN = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
     s AS (SELECT r, vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(256 * x))) = 0),
     c AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS alike, b.r AS b, b.vec_id AS other, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
           FROM s a JOIN s b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)),
     p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other NULLS LAST, b) AS k FROM c WHERE alike QUALIFY k <= 5),
     n AS (SELECT p.anchor_id, p.other AS positive_id, c.other AS negative_id, p.score AS positive_score, c.score AS negative_score,
           row_number() OVER (PARTITION BY p.a, p.k ORDER BY c.score DESC, c.other NULLS LAST, c.b) AS rank
           FROM p JOIN c ON c.a = p.a AND NOT c.alike AND 30 * p.score <= 100 * c.score AND 100 * c.score <= 90 * p.score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n
"""
