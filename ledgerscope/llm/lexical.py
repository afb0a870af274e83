"""Ranked lexical search: document FP-trees searched by depth-first branch-and-bound."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize, ship

#: Fixed values of the score: weight of a term, saturation, length in per cent.
WEIGHT, FULL, STEEP, BEND, FLAT, LENGTH = 1000, 1_000_000_000, 1000, 20, 50, 50
#: In UTF-8 a term is a run of ASCII letters, digits and bytes beyond ASCII; capitals of ASCII are lowered.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class SearchParams:
    k: int = 50
    block: int = 4096  #: documents of a tree
    leaf: int = 32  #: documents below which a node isn't divided
    batch_terms: int = 65_536  #: terms of the items that are searched together; more items take more passes
    group_terms: int = 4096  #: columns of a matrix of items
    salts: int = 64  #: parts in which an item's candidates are ranked before they meet


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the different terms of each different item that has any."""
    kind = items.schema["item_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted(set(terms_of(t))) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    each = items.select("item_id", "text").distinct()
    return materialize(each.mapInArrow(read, f"item_id {kind}, terms array<binary>").where("size(terms) > 0"), "search-items")


def restricted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): of each document with a term the number of all, and the numbers and counts of those in ``vocabulary``.

    Whole texts are read, in Arrow batches; the vocabulary is that of a batch of items.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for b in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for text in b.column("text"):
                words = terms_of(text.cast(pa.binary()).as_py())
                counts = Counter(map(number, words))
                counts.pop(None, None)
                n.append(len(words))
                terms.extend(counts)
                tfs.extend(counts.values())
                sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    found = docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")
    return materialize(found.where("n > 0"), "search-vectors")


@dataclass
class Items:
    """A batch of items over terms that are numbered by falling document frequency."""

    terms: list[np.ndarray]  #: of each item
    weight: np.ndarray  #: of each term
    size: int  #: documents with a term
    length: int  #: terms of all documents
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  #: items, their terms, matrix

    def arrange(self, p: SearchParams) -> Items:
        """Deal the items to matrices of at most ``group_terms`` columns; an item with more has one of its own."""
        # whole numbers below 2 ** 53 add up exactly as doubles
        exact = max(map(len, self.terms)) * int(self.weight.max(initial=0)) * (FULL // STEEP) < 1 << 53
        now, held = [], set()

        def close() -> None:
            columns = np.array(sorted(held), np.int64)
            matrix = np.zeros((len(now), len(columns)), np.float64 if exact else np.int64)
            for row, i in enumerate(now):
                matrix[row, np.searchsorted(columns, self.terms[i])] = 1
            self.groups.append((np.array(now), columns, matrix))

        for i, terms in enumerate(self.terms):
            if now and (len(held | set(terms.tolist())) > p.group_terms or len(now) == 512):
                close()
                now, held = [], set()
            now.append(i)
            held |= set(terms.tolist())
        close()
        return self

    def parts(self, tf: np.ndarray, term: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        """What ``tf`` occurrences of terms add to the score of a document of length figure ``m``."""
        return self.weight[term] * ((FULL * tf) // (STEEP * tf + BEND * m))


class Tree:
    """An FP-tree of documents: those that begin with the same frequent terms share a path.

    Documents are sorted by their terms in order of frequency, so a subtree is a range of them and
    its path the terms that all of the range begin with. A node's bounds are, for each term, the
    most occurrences in a document below it, and the least length figure.
    """

    def __init__(self, items: Items, ids: list, n: np.ndarray, start: np.ndarray, term: np.ndarray, tf: np.ndarray, leaf: int) -> None:
        m = 100 - LENGTH + (LENGTH * n * items.size) // items.length
        inner = np.lexsort((term, np.repeat(np.arange(len(n)), np.diff(start))))
        term, tf = term[inner], tf[inner]
        raw = term.astype(">u4").tobytes()
        order = sorted(range(len(n)), key=lambda i: (raw[4 * start[i] : 4 * start[i + 1]], m[i]))
        sizes = np.diff(start)[order]
        self.items, self.leaf, self.m, self.ids = items, leaf, m[order], [ids[i] for i in order]
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(self.start[-1]) + np.repeat(start[:-1][order] - self.start[:-1], sizes)
        self.term, self.tf = term[take], tf[take]
        self.parts = items.parts(self.tf, self.term, np.repeat(self.m, sizes))
        self.rich = np.add.reduceat(self.parts, self.start[:-1])  #: what all terms of a document can add

    def path(self, lo: int, hi: int, depth: int) -> int:
        """Length of the path that documents ``lo`` to ``hi`` share, at least ``depth``."""
        a, b = self.term[self.start[lo] : self.start[lo + 1]], self.term[self.start[hi - 1] : self.start[hi]]
        k = min(len(a), len(b))
        apart = np.flatnonzero(a[depth:k] != b[depth:k])
        return depth + int(apart[0]) if len(apart) else k

    def children(self, lo: int, hi: int, depth: int) -> tuple[int, list[tuple[int, int]]]:
        """The shared path's length and the ranges below it; neighbours that fit into one leaf stay together."""
        depth = self.path(lo, hi, depth)
        first = self.start[lo:hi] + depth
        after = np.where(first < self.start[lo + 1 : hi + 1], self.term[np.minimum(first, len(self.term) - 1)], -1)
        cuts = [lo, *(np.flatnonzero(np.diff(after)) + 1 + lo).tolist(), hi]
        if len(cuts) == 2:  # all alike: copies
            cuts = [*range(lo, hi, self.leaf), hi]
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts, cuts[1:]):
            if out and b - out[-1][0] <= self.leaf:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return depth, out

    def bound(self, lo: int, hi: int) -> np.ndarray:
        """The most that each term can add to a score below the node."""
        at = slice(self.start[lo], self.start[hi])
        most = np.zeros(len(self.items.weight), np.int64)
        np.maximum.at(most, self.term[at], self.tf[at])
        return self.items.parts(most, np.arange(len(most)), self.m[lo:hi].min())

    def scores(self, lo: int, hi: int, columns: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Scores of the documents of a range (rows) for items (columns)."""
        at = slice(self.start[lo], self.start[hi])
        dense = np.zeros((hi - lo, len(columns)), matrix.dtype)
        row, column = np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1])), np.searchsorted(columns, self.term[at])
        held = column < len(columns)
        held[held] = columns[column[held]] == self.term[at][held]
        dense[row[held], column[held]] = self.parts[at][held]
        return (dense @ matrix.T).astype(np.int64)


class Best:
    """The ``k`` best documents of each item so far, and the score that a further one has to reach."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, item: int, score: int, doc_id: int | None) -> None:
        heap, entry = self.heaps[item], (score, -math.inf if doc_id is None else -doc_id)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


def search(tree: Tree, best: Best) -> None:
    """Depth-first branch-and-bound of all items: an item leaves a subtree whose bound is below its k-th best score."""
    groups = tree.items.groups
    everyone = [np.arange(len(members)) for members, _, _ in groups]
    todo = [(0, len(tree.ids), 0, everyone)]
    while todo:
        lo, hi, depth, live = todo.pop()
        most, left, total = tree.bound(lo, hi), [], 0
        for (members, columns, matrix), some in zip(groups, live):
            can = (matrix if len(some) == len(members) else matrix[some]) @ most[columns].astype(matrix.dtype) if len(some) else np.zeros(0)
            left.append(some[can >= best.least[members[some]]])
            total += len(left[-1])
        if not total:
            continue
        if hi - lo > tree.leaf:
            depth, parts = tree.children(lo, hi, depth)
            # rich documents last on the stack, so that they are searched first and raise what others have to reach
            todo += [(a, b, depth, left) for a, b in sorted(parts, key=lambda part: tree.rich[part[0] : part[1]].max())]
            continue
        for (members, columns, matrix), some in zip(groups, left):
            if len(some):
                scores = tree.scores(lo, hi, columns, matrix if len(some) == len(members) else matrix[some])
                for d, i in zip(*np.nonzero(scores >= best.least[members[some]])):
                    item = int(members[some[i]])
                    if scores[d, i] >= best.least[item]:
                        best.offer(item, int(scores[d, i]), tree.ids[lo + d])


def _search_batch(vectors: DataFrame, batch: list, vocabulary: list[bytes], p: SearchParams) -> DataFrame:
    """(item, doc_id, score): for each item of a batch the best documents of every partition of ``vectors``."""
    spark = vectors.sparkSession
    size, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        df[r["t"]] = r["df"]
    order = np.lexsort((np.arange(len(df)), -df))  # by frequency
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    number = {t: int(rank[i]) for i, t in enumerate(vocabulary)}
    weight = np.array([math.floor(WEIGHT * math.log((2 * size + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
    terms = [np.array(sorted(number[bytes(t)] for t in r["terms"]), np.int64) for r in batch]
    shared = spark.sparkContext.broadcast((rank, Items(terms, weight, size, length)))
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, items = shared.value
        items = Items(items.terms, items.weight, items.size, items.length).arrange(p)
        best, held, rows = Best(len(items.terms), p.k), [], 0

        def grow() -> None:
            t = pa.Table.from_batches(held)
            lists, tfs = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
            start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            tree = Tree(items, t["doc_id"].to_pylist(), t["n"].to_numpy(), start, rank[lists.flatten().to_numpy()], tfs.flatten().to_numpy(), p.leaf)
            search(tree, best)

        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= p.block:
                grow()
                held, rows = [], 0
        if rows:
            grow()
        out = [(i, None if neg == -math.inf else -neg, score) for i, heap in enumerate(best.heaps) for score, neg in heap]
        for at in range(0, len(out), 10_000):
            item, doc, score = zip(*out[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    found = vectors.where("size(terms) > 0").mapInArrow(read, "item int, doc_id long, score long")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def rank_documents(docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items(item_id, text)`` its ``k`` best rows of ``docs(doc_id, text)``.

    A document's score sums, over the item's different terms, the term's weight times its saturated
    count (see FIXED values above and the README); counts and lengths are taken over all documents
    and whole texts. Only scores above zero count; equal scores go by ascending doc_id, null last.
    Repeated documents rank as often as they occur; items that repeat id and text count once, one id
    with two texts is ranked for each. Null texts have no terms; items without terms and empty
    tables give no rows. Other columns are not read. doc_id must be a whole number.

    Documents are reduced to the counts of the items' terms, which are written once. Every task
    gathers blocks of documents into trees and searches them for all items, keeping the best so far
    from block to block, so that no row is shuffled before it is one of its partition's k best for
    an item. Items are taken in batches of about ``batch_terms`` terms, by hash; each batch's terms
    are what is broadcast, and each takes a pass of its own over the documents.
    """
    ship(docs.sparkSession)
    asked = _item_terms(items)
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = max(1, -(-total // p.batch_terms))
    parts = []
    for b in range(n):
        batch = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)) == b).collect()
        if not batch:
            continue
        vocabulary = sorted({bytes(t) for r in batch for t in r["terms"]})
        found = _search_batch(restricted(docs, vocabulary), batch, vocabulary, p)
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(batch)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(_best(found, p).join(F.broadcast(names), "item"))
    if not parts:
        none = docs.select("doc_id").limit(0)
        return none.join(items.select("item_id").limit(0)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionAll, [d.select("item_id", "rank", "doc_id", "score") for d in parts])


def _best(found: DataFrame, p: SearchParams) -> DataFrame:
    """``found(item, doc_id, score)`` ranked, ``k`` for each item; parts of an item are ranked before they meet."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(p.salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= p.k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= p.k).drop("salt")


#: ``rank_documents`` over the views ``documents`` and ``benchmark`` in SQL.
TWIN = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
     d AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY r, doc_id),
     s AS (SELECT count(*) AS size, CAST(sum(n) AS BIGINT) AS length FROM d),
     q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
     f AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * size + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, size),
     c AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * size) // length)))) AS BIGINT) AS score
           FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""
