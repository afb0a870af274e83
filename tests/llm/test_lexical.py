"""Ranked search against a plain version: trees, batches, ties, nulls, repeats."""

import math
import random
import re
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from ledgerscope.llm import lexical, queries
from ledgerscope.llm.lexical import SearchParams

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    vectors = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    size, length = len(vectors), sum(n for *_, n in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    w = {t: math.floor(1000 * math.log((2 * size + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in set(items):
        scored = []
        for d, c, n in vectors:
            m = 50 + (50 * n * size) // length
            if (s := sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)) > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def ranked(spark, docs, items, p):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, term string").repartition(3)
    i = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    out = lexical.rank_documents(d, i, p)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ähre", "ñu", "x9", "Ünd"]
    weights = [1 / (1 + i) for i in range(len(words))]
    line = lambda n: " ".join(rng.choices(words, weights, k=n)).replace("w1 ", "W1, ")
    docs = [(i, line(rng.randint(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)]  # copies: ties
    docs += [(7, docs[7][1]), (7, "other w59"), (None, docs[5][1]), (None, None), (2000, None), (2001, ""), (2002, " .,-"), (2003, "w3 " * 50_000)]
    items = [(i, line(rng.randint(1, 25))) for i in range(30)]
    items += [items[0], (items[1][0], "w40 w41"), (None, "w2 w9"), (50, None), (51, ""), (52, "unseen words"), (53, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("p", [SearchParams(), SearchParams(k=3, block=64, leaf=4), SearchParams(k=500, block=100, leaf=8, group_terms=20), SearchParams(k=7, batch_terms=100, salts=2)])
def test_ranks_as_the_plain_version(spark, corpus, p):
    docs, items = corpus
    assert ranked(spark, docs, items, p) == plain(docs, items, p.k)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert ranked(spark, [], items, SearchParams()) == [] == ranked(spark, docs, [], SearchParams())
    assert ranked(spark, docs, [(1, None)], SearchParams()) == []


def test_bounds_hold_and_prune(corpus):
    docs, items = corpus
    vectors = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    names = sorted({t for _, c in vectors for t in c})
    df = Counter(t for _, c in vectors for t in c)
    names.sort(key=lambda t: (-df[t], t))
    number = {t: i for i, t in enumerate(names)}
    n = np.array([sum(c.values()) for _, c in vectors])
    weight = np.array([math.floor(1000 * math.log((2 * len(n) + 2) / (2 * df[t] + 1))) for t in names])
    asked = [np.array(sorted({number[t] for t in terms(text) if t in number}), np.int64) for _, text in items if set(terms(text)) & set(number)]
    batch = lexical.Items(asked, weight, len(n), int(n.sum())).arrange(SearchParams(group_terms=30))
    start = np.concatenate([[0], np.cumsum([len(c) for _, c in vectors])])
    tree = lexical.Tree(batch, [d for d, _ in vectors], n, start, np.array([number[t] for _, c in vectors for t in c]), np.array([x for _, c in vectors for x in c.values()]), 4)
    seen, todo = 0, [(0, len(n), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        most = tree.bound(lo, hi)
        for _, columns, matrix in batch.groups:
            assert (tree.scores(lo, hi, columns, matrix).max(axis=0) <= matrix @ most[columns]).all()
        seen += 1
        if hi - lo > 4:
            depth, parts = tree.children(lo, hi, depth)
            assert [a for a, _ in parts][0] == lo and parts[-1][1] == hi and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
            paths = {tuple(tree.term[tree.start[d] : tree.start[d] + depth]) for d in range(lo, hi)}
            assert len(paths) == 1  # a node's documents share its path
            todo += [(a, b, depth) for a, b in parts]
    assert seen > 50
    total = 0
    for one in asked:  # an item alone leaves out what can't reach its best
        tree.items = lexical.Items([one], weight, len(n), int(n.sum())).arrange(SearchParams())
        visited, real = [], type(tree).bound
        tree.bound = lambda lo, hi: visited.append((lo, hi)) or real(tree, lo, hi)
        lexical.search(tree, lexical.Best(1, 1))
        total += len(visited)
    assert total < 0.8 * seen * len(asked)


def test_many_terms_stay_exact():
    items = lexical.Items([np.arange(3)], np.array([1 << 40, 1, 1]), 10, 100).arrange(SearchParams())
    assert items.groups[0][2].dtype == np.int64
    assert replace(SearchParams(), k=1).k == 1


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    cur = con.execute(queries.SQL["op13_lexical_search"])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    out = queries.QUERIES["op13_lexical_search"](spark, path)
    assert want and out.columns == names and sorted(str(tuple(r)) for r in out.collect()) == want
