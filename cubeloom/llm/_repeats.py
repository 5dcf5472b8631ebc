"""Which of many 64-bit keys occur more than once, asked in packed blocks.

A block (one row of a written table) holds thousands of keys as one binary value.  Keys
travel as packed arrays split by value range, each key of a block once; answers travel back
as packed places.  Rows stay few, and a key that occurs everywhere costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import lean, tasks

#: Keys that one bucket holds, about.
BUCKET_KEYS = 1 << 20
_MANY = np.uint32(0xFFFFFFFF)


def _split(buckets: int):
    shift = np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                src, keys = b.column(0)[row].as_py(), np.frombuffer(b.column(1)[row].as_py(), np.uint64)
                if not len(keys):
                    continue
                own, first, count = np.unique(keys, return_index=True, return_counts=True)
                place = np.where(count > 1, _MANY, first.astype(np.uint32)).astype(np.uint32)
                at = ((own >> shift) * np.uint64(buckets)) >> shift  # ascends with the keys
                cut = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([src] * len(full), pa.int64()), pa.array([own[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()), pa.array([place[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())],
                    names=["bucket", "src", "keys", "places"],
                )

    return run


def _answer(rows: list[tuple[int, bytes, bytes]]) -> tuple[list[int], list[bytes]]:
    keys = np.concatenate([np.frombuffer(k, np.uint64) for _, k, _ in rows])
    places = np.concatenate([np.frombuffer(p, np.uint32) for _, _, p in rows])
    owner = np.repeat(np.arange(len(rows)), [len(k) // 8 for _, k, _ in rows])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    twin = np.zeros(len(keys), bool)
    same = ordered[1:] == ordered[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    hit = np.zeros(len(keys), bool)
    hit[order] = twin
    hit &= places != _MANY
    cut = np.searchsorted(owner[hit], np.arange(len(rows) + 1))
    found = places[hit]
    full = [i for i in range(len(rows)) if cut[i] < cut[i + 1]]
    return [rows[i][0] for i in full], [found[cut[i] : cut[i + 1]].tobytes() for i in full]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, rows = None, []

    def out() -> pa.RecordBatch:
        src, places = _answer(rows)
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(places, pa.binary())], names=["src", "places"])

    for b in batches:
        for k, s, keys, places in zip(*(c.to_pylist() for c in b.columns)):
            if k != bucket and rows:
                yield out()
                rows = []
            bucket = k
            rows.append((s, keys, places))
    if rows:
        yield out()


def repeated(asks: DataFrame) -> DataFrame:
    """(src, hits: array<binary>) of blocks (src, keys): packed uint32 places of keys that occur in other blocks too.

    A key that occurs twice in its own block isn't listed; whoever holds the block sees that.
    """
    spark = asks.sparkSession
    total = asks.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = max(tasks(spark), -(-(total // 8) // BUCKET_KEYS))
    split = asks.select("src", "keys").mapInArrow(lean(_split(buckets)), "bucket int, src long, keys binary, places binary")
    answers = split.repartition(tasks(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_reduce), "src long, places binary")
    return answers.groupBy("src").agg(F.collect_list("places").alias("hits"))


def mask(keys: np.ndarray, hits: list[bytes] | None) -> np.ndarray:
    """Which keys of a block are repeated, in the block or elsewhere."""
    out = np.zeros(len(keys), bool)
    for h in hits or ():
        out[np.frombuffer(h, np.uint32)] = True
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
