"""Near-duplicate embeddings: exact cosine threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.components import components
from ledgerscope.llm.shared import materialize, ship

#: Distances between unit vectors carry rounding errors below this.
SLACK = 1e-9


@dataclass(frozen=True)
class CoverParams:
    cosine: float = 0.93
    block: int = 2048  #: vectors of a tree, at most about
    pivots: int = 1024  #: cells at the top level of all groups together, at most
    leaf: int = 16  #: members from which a node is divided

    @property
    def reach(self) -> float:
        """Distance of unit vectors at the cosine."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine)))


@dataclass
class Node:
    """A ball around a member: all members are within ``radius`` of ``center``."""

    center: int
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def cover_tree(x: np.ndarray, leaf: int) -> Node:
    """Nested levels over the unit vectors ``x``; the radius that children cover halves from level to level.

    A node's children are a net of its members, its own center among them: members are taken in
    turn as centers unless one within the radius is there already, and belong to the nearest
    center. A node keeps the largest distance that occurs, which is its covering radius.
    """
    root = Node(0, float(distances(x[:1], x).max()), np.arange(len(x)))
    todo = [(root, 1.0)]
    while todo:
        node, radius = todo.pop()
        while radius > node.radius:
            radius /= 2
        if len(node.members) <= leaf or node.radius < 1e-6:
            continue
        members, vectors = node.members, x[node.members]
        near, of = np.full(len(members), np.inf), np.zeros(len(members), np.int64)
        centers = []
        at = int(np.flatnonzero(members == node.center)[0])
        while True:
            d = distances(vectors[at : at + 1], vectors)[0]
            d[at] = 0.0
            closer = d < near
            near[closer], of[closer] = d[closer], len(centers)
            centers.append(at)
            left = np.flatnonzero(near > radius)
            if not len(left):
                break
            at = int(left[0])
        order = np.argsort(of, kind="stable")
        for k, part in enumerate(np.split(order, np.searchsorted(of[order], np.arange(1, len(centers))))):
            child = Node(int(members[centers[k]]), float(near[part].max()), members[part])
            node.children.append(child)
            todo.append((child, radius / 2))
    return root


def dual_traversal(x: np.ndarray, y: np.ndarray, tx: Node, ty: Node, p: CoverParams) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of all pairs of ``x`` and ``y`` with the cosine asked for.

    Two nodes are dropped if their centers are farther apart than their radii and the reach
    together; what remains is divided until both have no children.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [([tx], [ty])]
    while todo:
        us, vs = todo.pop()
        apart = distances(x[[u.center for u in us]], y[[v.center for v in vs]])
        bound = np.array([u.radius for u in us])[:, None] + np.array([v.radius for v in vs])[None, :]
        for a, b in zip(*np.nonzero(apart <= bound + p.reach + SLACK)):
            u, v = us[a], vs[b]
            if u.children or v.children:
                todo.append((u.children or [u], v.children or [v]))
            else:
                i, j = np.nonzero(x[u.members] @ y[v.members].T >= p.cosine)
                found.append((u.members[i], v.members[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def least_connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` points the smallest point reachable over the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            return label


LINKS = "node long, n_links long, root long"


def link_blocks(left: pa.Table, right: pa.Table | None, p: CoverParams) -> pa.Table:
    """Links of two blocks' different vectors, or (``right`` None) of one block's: per node the copies linked and a root.

    The root connects all nodes that the links connect, so a block pair gives at most one row a
    node, however many links there are.
    """

    def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.array(t["vector"].combine_chunks().flatten(), np.float64).reshape(len(t), -1)
        return t["node"].to_numpy(), t["copies"].to_numpy(), v / np.linalg.norm(v, axis=1, keepdims=True)

    nx, wx, x = read(left)
    ny, wy, y = read(right) if right is not None else (nx, wx, x)
    tx = cover_tree(x, p.leaf)
    i, j = dual_traversal(x, y, tx, cover_tree(y, p.leaf) if right is not None else tx, p)
    if right is None:
        apart = i != j
        i, j = i[apart], j[apart]
        nodes, links = nx, np.bincount(i, wy[j], len(nx))
        root = least_connected(len(nx), i, j)
    else:
        nodes = np.concatenate([nx, ny])
        links = np.concatenate([np.bincount(i, wy[j], len(nx)), np.bincount(j, wx[i], len(ny))])
        root = least_connected(len(nodes), i, j + len(nx))
    some = links > 0
    return pa.table({"node": nodes[some], "n_links": links[some].astype(np.int64), "root": nodes[root[some]]})


def _cells(reps: DataFrame, p: CoverParams) -> tuple[DataFrame, DataFrame]:
    """``reps`` with ``cell`` and ``sub`` (block of the cell), and the pairs of blocks' cells that may hold links.

    Each (label, dimension) has a pivot for every ``block`` vectors, as far as ``pivots`` go,
    drawn by hash; a vector belongs to the cell of its nearest pivot, the cells being the trees'
    common top level. Two cells whose pivots are farther apart than the cells' radii and the reach
    together are not compared. Only pivots and cell figures, bounded by ``pivots``, reach the driver.
    """
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    share = F.least(F.ceil(F.col("n") / p.block), F.greatest(F.lit(1), F.floor(F.lit(p.pivots // 2) * F.col("n") / F.lit(max(1, reps.count())))))
    drawn = reps.join(sizes.withColumn("want", share), ["label", "dim"]).where(F.col("want") > 1)
    rate = F.col("want") / F.col("n") * (1 << 30)
    rows = drawn.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < rate).orderBy(F.xxhash64("node")).limit(p.pivots)
    pivots: dict[tuple, list] = {}
    for r in rows.select("label", "dim", "vector").collect():
        v = np.array(r["vector"], float)
        pivots.setdefault((r["label"], r["dim"]), []).append(v / np.linalg.norm(v))
    tables = {k: np.stack(v) for k, v in pivots.items()}
    ship(reps.sparkSession)
    shared = reps.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("at int, distance double")
    def nearest(labels: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        out = []
        for label, v in zip(labels, vectors):
            table = shared.value.get((label, len(v)))
            if table is None:
                out.append((0, 2.0))
                continue
            d = distances(table, (np.array(v, float) / np.linalg.norm(np.array(v, float)))[None])[:, 0]
            out.append((int(d.argmin()), float(d.min())))
        return pd.DataFrame(out, columns=["at", "distance"])

    placed = materialize(reps.withColumn("p", nearest("label", "vector")).withColumn("at", F.col("p.at")).withColumn("distance", F.col("p.distance")).drop("p"), "vectors-placed")
    cells = placed.groupBy("label", "dim", "at").agg(F.max("distance").alias("radius"), F.ceil(F.count("*") / p.block).alias("subs"))
    other = cells.select("label", "dim", F.col("at").alias("at_b"), F.col("radius").alias("radius_b"), F.col("subs").alias("subs_b"))
    pairs = cells.withColumnsRenamed({"at": "at_a", "radius": "radius_a", "subs": "subs_a"}).join(other, ["label", "dim"]).where("at_a <= at_b")

    @F.pandas_udf("double")
    def between(label: pd.Series, dim: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        t = shared.value
        return pd.Series([float(distances(t[k][[i]], t[k][[j]])[0, 0]) if (k := (x, n)) in t else 0.0 for x, n, i, j in zip(label, dim, a, b)])

    near = pairs.where(between("label", "dim", "at_a", "at_b") <= F.col("radius_a") + F.col("radius_b") + p.reach + SLACK)
    subs = placed.join(cells.select("label", "dim", "at", "subs"), ["label", "dim", "at"])
    return subs.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs"))).drop("distance", "subs"), materialize(near, "vectors-pairs")


def near_duplicates(vectors: DataFrame, p: CoverParams = CoverParams()) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine, in doubles, is at least
    ``p.cosine``. Null or zero vectors, vectors with null or non-finite components, and vectors of
    different lengths link with nothing; without links component_id is vec_id. Equal vectors of a
    label are compared once and count as often as they occur (repeated rows too, as others).
    ``kept`` is vec_id = component_id; a null vec_id counts, but names a component only if it has
    no other id. An empty table gives no rows.
    """
    v = F.col("embedding")
    sound = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    keyed = vectors.select("vec_id", "label", v.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    good = keyed.where("sound")
    # float components may overflow or vanish when squared; doubles don't
    each = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = materialize(each.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")
    placed, pairs = _cells(reps.select("label", "dim", "node", "copies", "vector"), p)
    # both sides of every pair of blocks; a block with itself has one side
    left = placed.join(pairs.withColumnRenamed("at_a", "at"), ["label", "dim", "at"])
    left = left.withColumn("sub_b", F.explode(F.sequence(F.lit(0), F.col("subs_b") - 1))).where("at < at_b or sub <= sub_b")
    right = placed.join(pairs.withColumnRenamed("at_b", "at"), ["label", "dim", "at"])
    right = right.withColumn("sub_a", F.explode(F.sequence(F.lit(0), F.col("subs_a") - 1))).where("at_a < at or sub_a < sub")
    key = ["label", "dim", "at_a", "sub_a", "at_b", "sub_b"]
    sides = left.withColumnsRenamed({"at": "at_a", "sub": "sub_a"}).select(*key, F.lit(0).alias("side"), "node", "copies", "vector").unionAll(
        right.withColumnsRenamed({"at": "at_b", "sub": "sub_b"}).select(*key, F.lit(1).alias("side"), "node", "copies", "vector")
    )

    def linked(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        side = rows["side"].to_numpy()
        a, b = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        same = key[2].as_py() == key[4].as_py() and key[3].as_py() == key[5].as_py()
        if not len(a) or (not same and not len(b)):
            return pa.table({n: pa.array([], pa.int64()) for n in ("node", "n_links", "root")})
        return link_blocks(a, None if same else b, p)

    links = materialize(sides.groupBy(*key).applyInArrow(linked, LINKS), "vectors-links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    rooted = reps.drop("vector").join(roots, "node", "left").join(totals, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(names, "root").select("label", "h1", "h2", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectors-named")
    found = good.join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
