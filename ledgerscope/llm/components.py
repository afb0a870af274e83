"""Connected components of an edge table: distributed union-find by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """Map each node of ``edges(a, b)`` to one root of its component: ``(node, root)``.

    Each round every node hooks onto the neighbour whose hash is smallest (itself included), and
    the edges are contracted onto those parents; about half of the nodes go each time, whatever
    the shape of the component, so long chains take logarithmically many rounds. Hooking is a
    minimum, which Spark combines before its shuffle; a node with very many edges is no single
    task's work. Every round's tables are written to the shared folder. Null nodes are dropped;
    an empty edge table gives an empty map. Roots are arbitrary members.
    """
    live = materialize(_tidy(edges.select("a", "b")), "cc-edges")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        near = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = near.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        hook = materialize(ranked.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("parent")), "cc-hook")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = hook.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        joined = live.join(left, "a").join(right, "b")
        live = materialize(_tidy(joined.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "cc-edges")
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[-1].select("node", F.col("parent").alias("root"))
    for hook in reversed(hooks[:-1]):
        # a parent may be settled already (no longer in the next round's graph): then it is the root
        later = out.select(F.col("node").alias("parent"), "root")
        out = hook.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return materialize(out, "cc-roots") if len(hooks) > 1 else out


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, the smaller end first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
