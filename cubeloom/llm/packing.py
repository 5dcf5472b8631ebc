"""Vector best-fit packing of tokenised documents.

A piece of n tokens asks (n tokens, 1 document, n*n attention cost) of a bin.  Pieces come
longest first; of the bins that can take a piece under every capacity, the one chosen is
that of least residual norm (``rule="norm"``, residuals as shares of the capacities) or of
largest weighted dot product of demand and residual (``rule="dot"``).

What a piece asks depends on its length only, so the packing is computed once for the counts
of the lengths 1..capacity, a table of fixed size whatever the input, over groups of equal
bins.  The result is a list of intervals (length, ranks, first bin, place); each piece finds
its bin from its rank among the pieces of its length, which needs two prefix counts and no
sorting of pieces.

Null text is an empty document (the end mark only).  Null and repeated ids are documents of
their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch, lean

CAPACITY = 1024
END = 2
#: Runs from this length on are left to the tokenizers library.
LONG_RUN = 1 << 14


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def fast_encoder(path: str):
    """A function from texts to lists of ids, equal to the tokenizers file's own, by tiktoken's faster loop.

    Ranks are the ids of the byte strings, which holds for files whose merges are listed in the
    order of their results' ids; that is checked, and the tokenizers library is used otherwise.
    It also takes the texts with a run of ``LONG_RUN`` characters without a change between white
    space and other characters, on which the faster loop's expressions run out of stack or time.
    """
    import json

    from tokenizers import Tokenizer

    own: list[Tokenizer] = []

    def by_library(texts: list[str]) -> list[list[int]]:
        if not own:
            own.append(Tokenizer.from_file(path))
        return [e.ids for e in own[0].encode_batch(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    results = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if results == sorted(results) and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]:
        import public_tokenizers
        import tiktoken

        # Byte-level files write bytes as printable characters: printable ones as themselves, others from 256 up.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items() if k not in special}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        long_run = re.compile(f"\\s{{{LONG_RUN}}}|\\S{{{LONG_RUN}}}")

        def encode(texts: list[str]) -> list[list[int]]:
            return [by_library([t])[0] if len(t) >= LONG_RUN and long_run.search(t) else enc.encode(t, allowed_special="all") for t in texts]

        return encode
    return by_library


@dataclass(frozen=True)
class Capacities:
    """What a bin holds: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    cost: int = CAPACITY * CAPACITY


def plan(counts: dict[int, int], most: Capacities = Capacities(), rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, int]:
    """Intervals (length, first rank, number, first bin, place in the bin) for counts of lengths, and the number of bins.

    Groups of equal bins are kept by their contents; a piece length is put into whole groups at
    a time, and the last group is split, so there are at most two groups more for each length.
    """
    caps = np.array([most.tokens, most.documents, most.cost], float)
    by = np.array(weights, float)
    residual = np.zeros((0, 3))
    first, number, bins, out = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, []
    for length in sorted(counts, reverse=True):
        ask, left, rank = np.array([length, 1.0, float(length) ** 2]), counts[length], 0
        if (ask > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            fits = np.flatnonzero((residual >= ask).all(axis=1) & (number > 0))
            if len(fits):
                if rule == "norm":
                    score = -((by * (residual[fits] - ask) / caps) ** 2).sum(axis=1)
                else:
                    score = (by * ask / caps * (residual[fits] / caps)).sum(axis=1)
                g = fits[np.lexsort((first[fits], -score))[0]]
            else:  # new bins: as many as the rest of this length fills, each with as many pieces as fit
                each = int(min(caps[0] // length, caps[1], caps[2] // (length * length)))
                fresh = max(1, left // each)
                residual = np.vstack([residual, caps])
                first, number = np.append(first, bins), np.append(number, fresh)
                bins += fresh
                g = len(number) - 1
                for _ in range(each - 1):
                    n = int(min(left, number[g]))
                    if n < number[g] or n == left:
                        break
                    out.append((length, rank, n, first[g], caps[0] - residual[g, 0]))
                    residual[g] -= ask
                    rank, left = rank + n, left - n
            n = int(min(left, number[g]))
            out.append((length, rank, n, first[g], caps[0] - residual[g, 0]))
            if n < number[g]:  # the rest of the group stays as it was
                residual = np.vstack([residual, residual[g]])
                first, number = np.append(first, first[g] + n), np.append(number, number[g] - n)
                number[g] = n
            residual[g] = residual[g] - ask
            rank, left = rank + n, left - n
        if len(number) > 64:  # bins that not even one token more fits into are closed
            open_ = (residual >= 1).all(axis=1)
            residual, first, number = residual[open_], first[open_], number[open_]
    return np.array(out, np.int64).reshape(-1, 5), bins


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = encode([t or "" for t in b.column(1).to_pylist()])
                docs, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, x in enumerate(ids):
                    x = np.array([*x, END], dtype="<u4")
                    head = len(x) % capacity if len(x) > capacity else len(x)
                    cuts = [0, *([head] if head else []), *range(head + capacity, len(x) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        docs.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(x[a:z].tobytes()))
                        rank.append(int(seen[z - a]))
                        seen[z - a] += 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(docs), pa.int64()), pa.array(rank, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return run


def pack(docs: DataFrame, most: Capacities = Capacities(), rule: str = "norm", path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(lean(_pieces(path or tokenizer_path(), most.tokens)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")
    pieces = scratch.write(pieces, "pieces")
    per = scratch.write(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    # At most one row per length: no more rows than tokens in a bin.
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    intervals, _ = plan(counts, most, rule)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(per.select("length", "task", before.alias("before")), ["length", "task"])
    shared = spark.sparkContext.broadcast(intervals)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        iv = shared.value
        iv = iv[np.lexsort((iv[:, 1], iv[:, 0]))]
        length_at = np.searchsorted(iv[:, 0], np.arange(most.tokens + 2))
        for b in batches:
            length = b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows, mine = np.flatnonzero(length == n), iv[length_at[n] : length_at[n + 1]]
                at = np.searchsorted(mine[:, 1], rank[rows], side="right") - 1
                seq[rows], off[rows] = mine[at, 3] + rank[rows] - mine[at, 1], mine[at, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    wanted = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return wanted.mapInArrow(lean(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
