"""Hard negatives against a plain version: pruning, ties, copies, nulls, odd lengths and sizes."""

import math

import duckdb
import numpy as np
import pytest

from ledgerscope.llm import negatives, queries
from ledgerscope.llm.negatives import NegativeParams

SCHEMA = "vec_id long, embedding array<double>, label int, row string, Cell string"


def plain(rows, p):
    live = []
    for r, (vec_id, e, label, *_) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        live.append((r, vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    last = lambda v: (v is None, v)
    for r, vec_id, label, e in live:
        if vec_id is None or vec_id % p.anchors:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(e, f)), last(o), q, lab == label) for q, o, lab, f in live if q != r and len(f) == len(e)))
        for s, (_, pos), _, _ in [x for x in scored if x[3]][: p.positives]:
            fit = [(-t, neg) for t, (_, neg), _, alike in scored if not alike and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(vec_id, pos, k, neg, -s, t) for k, (t, neg) in enumerate(fit[: p.negatives], 1)]
    return sorted(map(str, out))


def mined(spark, rows, p):
    out = negatives.mine(spark.createDataFrame([(*x, "c", "c") for x in rows], SCHEMA).repartition(3), p)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in out.collect())


def vectors(n, dim, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, dim))
    x = heads[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    x *= rng.uniform(0.2, 1, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("p", [NegativeParams(anchors=10), NegativeParams(anchors=5, members=8, block=5, slice=40, step=16), NegativeParams(anchors=20, members=4, slice=64, positives=2, negatives=100)])
def test_mines_as_the_plain_version(spark, p):
    rows = vectors(400, 12, 1)
    rows += [(1000 + i, rows[30][1], 1) for i in range(120)]  # one very common vector: ties
    rows += [rows[40], rows[40], (50, rows[3][1], 2), (None, rows[30][1], 1), (None, rows[31][1], 3)]
    rows += [(2000, None, 1), (2010, rows[1][1], None), (2020, [1.0, float("nan")] + [0.0] * 10, 1), (2030, [None] + [0.0] * 11, 1), (2040, [0.0] * 12, 1), (2050, [0.5, 0.25], 1), (2060, [0.5, 0.3], 1), (2061, [0.5, 0.1], 2), (2070, [], 1)]
    assert mined(spark, rows, p) == plain(rows, p)


def test_large_components_are_exact(spark):
    p = NegativeParams(anchors=2, members=2)
    rows = [(i, [1e4 + i, 3e5 - 7 * i, 1e6 / (i + 1), 0.3], i % 3) for i in range(40)]
    assert mined(spark, rows, p) == plain(rows, p)


def test_few_rows_and_none(spark):
    p = NegativeParams()
    assert mined(spark, [], p) == [] == mined(spark, [(1, [0.5], 1), (2, [0.5], 1)], p)
    assert mined(spark, [(0, [0.5], 1)], p) == []
    few = [(0, [0.5, 0.5], 0), (1, [0.5, 0.4], 1), (2, [0.2, 0.3], 2), (3, [0.5, 0.45], 1)]
    assert mined(spark, few, p) == plain(few, p) != []


def test_walks_end_early_and_lose_nothing():
    rng = np.random.default_rng(5)
    head = rng.normal(size=32)
    near = head + 0.05 * rng.normal(size=(300, 32))
    x = np.floor(256 * np.concatenate([near, rng.normal(size=(5000, 32))]))
    a = np.floor(256 * (head + 0.05 * rng.normal(size=(20, 32))))
    seen = []
    real = negatives.products
    low, high = np.full((20, 1), negatives.LEAST), np.full((20, 1), negatives.MOST)
    w = negatives.Walk(a, np.zeros(20, int), np.arange(20) - 100, low, high, True, 5)
    try:
        negatives.products = lambda q, c: seen.append(q.shape[0] * c.shape[0]) or real(q, c)
        found = negatives.walk(w, x, np.zeros(len(x), int), np.arange(len(x)), np.arange(len(x)), 64)
    finally:
        negatives.products = real
    assert sum(seen) < 0.2 * 20 * len(x)
    s = (a @ x.T).astype(int)
    for i in range(20):
        want = sorted(((-s[i, c], c) for c in range(len(x))))[:5]
        assert sorted((-t, c) for anchor, _, t, c in found if anchor == i) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    cur = con.execute(queries.SQL["op12_hard_negatives"])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    out = queries.QUERIES["op12_hard_negatives"](spark, path)
    assert want and out.columns == names and sorted(str(tuple(r)) for r in out.collect()) == want
