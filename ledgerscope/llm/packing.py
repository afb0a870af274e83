"""Packing of token sequences: sum-of-squares placement in shards, after tokenization."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.shared import materialize, ship

SPANS = "array<struct<piece:int,start:long,length:long,ids_crc32:long,ids:array<int>>>"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Pieces of one shard, about; shards are packed apart from each other.
SHARD_PIECES = 16_384
#: Targets that are tried, as shares of the least number of sequences that could hold a shard.
TARGETS = (0.9, 0.95, 1.0)


def vocabulary_paths() -> tuple[str, str]:
    """The places of the byte-level BPE vocabulary as tokenizer file and as ranks (the same vocabulary)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str):
    """A function from text to the ids that ``tokenizers`` gives without special tokens of its own.

    The rank file gives the same ids as the tokenizer file at a fifth of the time. The tokenizer
    file encodes what the faster library refuses, and texts that spell an added token.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(json_path)
    added = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if not any(a in text for a in added):
            try:
                return fast.encode_ordinary(text)
            except (ValueError, OverflowError, RuntimeError):
                pass
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def spans(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; of several, only the first may be shorter than ``capacity``."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` for each piece of each document of ``docs``."""
    json_path, ranks_path = vocabulary_paths()

    @F.pandas_udf(SPANS)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(json_path, ranks_path)
        for texts in batches:
            out = []
            for text in texts:
                ids = np.array([*encode(text or ""), end_id], "<u4")
                out.append(
                    [
                        {"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n].tobytes()), "ids": ids[s : s + n].tolist() if with_ids else None}
                        for k, (s, n) in enumerate(spans(len(ids), capacity))
                    ]
                )
            yield pd.Series(out)

    ship(docs.sparkSession)
    each = docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")
    return each if with_ids else each.drop("ids")


def sum_of_squares(lengths: np.ndarray, capacity: int, target: int) -> list[list[int]]:
    """Indexes of ``lengths`` by sequence, longest pieces placed first.

    A piece goes where the sum, over all gaps, of the squared number of open sequences with that
    gap becomes smallest; of equal choices the fullest sequence. A new sequence is a choice like
    the others while fewer than ``target`` are made; after that only where no open one has room.
    """
    never = np.iinfo(np.int64).max
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        leaves, becomes = count[n:], count[: capacity + 1 - n]
        change = np.where(leaves > 0, 2 * (becomes - leaves) + 2, never)
        if leaves[0]:
            change[0] = 1 - 2 * leaves[0]  # a filled sequence is no longer open
        fresh = 2 * becomes[-1] + 1 if n < capacity else 0
        change[-1] = fresh if len(bins) < target else never
        best = int(np.argmin(change))
        gap = capacity if change[best] == never else n + best
        if gap == capacity:
            at = len(bins)
            bins.append([])
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
        bins[at].append(int(i))
        if gap > n:
            open_at[gap - n].append(at)
            count[gap - n] += 1
    return bins


def fewest(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The best of some sum-of-squares packings, with targets up to the least number of sequences possible.

    The rule alone keeps sequences of all gaps open for pieces to come; with a target the last
    pieces, the short ones, fill them.
    """
    least = -(-int(lengths.sum()) // capacity)
    return min((sum_of_squares(lengths, capacity, int(share * least)) for share in TARGETS), key=len)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens: one row per piece.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Documents
    longer than ``capacity`` are cut; of their pieces only the first may be shorter than
    ``capacity``. Full pieces are sequences of their own. The others are dealt by a hash of
    (doc_id, piece, crc) into shards of about ``shard_pieces``, each packed by sum of squares in one
    task; no text or ids are shuffled. Repeated rows are packed as often as they occur; null ids like any other; an
    empty table gives no rows. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    cut = materialize(pieces(docs.select("doc_id", "text"), capacity, end_id), "pieces")
    full = cut.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = cut.where(F.col("length") < capacity)
    shards = -(-part.count() // shard_pieces) or 1
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        bins = fewest(lengths, capacity)
        where, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            where[b] = k
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        placed = rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + where)).append_column("offset", pa.array(offset))
        return placed.select([x.split()[0] for x in PLACED.split(", ")])

    placed = dealt.groupBy("shard").applyInArrow(place, PLACED)
    return full.select(placed.columns).unionAll(placed)
