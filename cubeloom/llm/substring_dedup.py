"""Substring dedup by level-wise doubling.

A window is ``WINDOW`` words.  At each level of lengths 9, 18, 35 (each at most twice the
one before) a window is represented by one of the stretches of that length inside it: the
one with the least hash, so that equal windows choose equal stretches and neighbouring
windows share them.  Windows whose stretch occurs only once in the corpus are unique and
drop out; the others are extended to the next length.  At the last length the stretch is the
window itself, and those left are the repeated windows.  The search ends early if no
candidates survive.  Every word that a repeated window covers is removed.

The last length is gone through twice: a window is removed only if it is repeated under two
64-bit hashes of its words that are independent of each other, so that equal hashes of
different windows don't decide (at 1e13 windows about one in two million meets another under
one of them, none in 1e12 under both).

Between levels only packed hashes and, for each document, ranges of windows move; texts are
read again at each level.

Null or word-less texts have no words.  Null or repeated ids are allowed: a row is known by
its id and its text's hash, and rows equal in both count as copies of each other.  Empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats, _text
from ._spark import Scratch, checked, lean, text_or_empty

WINDOW = 35
SHORTEST = 9
#: Bytes of texts in a block.
BYTES_CHUNK = 1 << 20


def lengths(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """The levels: the window's length halved (rounded up) as long as it is over ``shortest``."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _ranges_mask(ranges: list[bytes | None], first: np.ndarray, n: int) -> np.ndarray:
    """Mask over a chunk's n word places of the windows that are candidates; ranges are uint32 pairs counted from a text's first word."""
    edge = np.zeros(n + 1, np.int32)
    for i, r in enumerate(ranges):
        if r:
            pair = np.frombuffer(r, np.uint32).reshape(-1, 2).astype(np.int64) + first[i]
            np.add.at(edge, pair[:, 0], 1)
            np.add.at(edge, pair[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def slices(b: pa.RecordBatch, col: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes in a string column."""
    off = np.cumsum([0, *(n or 0 for n in pc.binary_length(b.column(col)).to_pylist())])
    for lo, hi in _text.chunks(off, most):
        yield b.slice(lo, hi - lo)


_ASKS = "src long, doc_ids array<bigint>, ths array<bigint>, run_doc binary, run_start binary, run_asks binary, widths binary, keys binary"


def chosen(raw: np.ndarray, off: np.ndarray, window: int, length: int, ranges: list | None, of_bytes: bool, second: bool = False) -> tuple[np.ndarray, ...]:
    """Candidate windows of a chunk by the stretch they chose.

    (first place of each text, window places, their texts, place in these of the first window
    of each ask, keys of the asks): consecutive windows of one choice are one ask.
    """
    if of_bytes:
        first, n, stretch = off, len(raw), _text.byte_window_hashes(raw, length)
    else:
        starts, ends, first = _text.words(raw, off)
        n, stretch = len(starts), _text.window_hashes(_text.word_hashes(raw, starts, ends, second=second), length)
    arg = _text.sliding_min_args(stretch, window - length + 1)
    live = _text.inside(first, n, window)[: len(arg)]
    if ranges is not None:
        live &= _ranges_mask(ranges, first, n)[: len(arg)]
    p = np.flatnonzero(live)
    doc = np.searchsorted(first, p, side="right") - 1
    a = arg[p]
    new_ask = np.ones(len(p), bool)
    new_ask[1:] = (p[1:] != p[:-1] + 1) | (doc[1:] != doc[:-1]) | (a[1:] != a[:-1])
    at = np.flatnonzero(new_ask)
    # The least of many hashes is small: mixed anew, keys spread over all values.
    return first, p, doc, at, _text.mix(stretch[a[at]] + np.uint64(0x2545F4914F6CDD1D))


def _asks(window: int, length: int, narrowed: bool, of_bytes: bool, second: bool):
    """Rows (doc_id, th, text[, ranges]) to blocks of asks: for each stretch its key and how many consecutive windows chose it."""

    def block(src: int, ids: list, ths: list, col: pa.Array, ranges: list | None) -> list:
        raw, off = _text.string_buffers(col)
        first, p, doc, at, keys = chosen(raw, off, window, length, ranges, of_bytes, second)
        widths = np.diff(np.append(at, len(p))).astype(np.uint16)
        new_run = np.ones(len(at), bool)
        new_run[1:] = (p[at[1:]] != p[at[1:] - 1] + 1) | (doc[at[1:]] != doc[at[1:] - 1])
        runs = np.flatnonzero(new_run)
        per_run = np.diff(np.append(runs, len(at))).astype(np.uint32)
        r = at[runs]
        return [src, ids, ths, doc[r].astype(np.uint32).tobytes(), (p[r] - first[doc[r]]).astype(np.uint32).tobytes(), per_run.tobytes(), widths.tobytes(), keys.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in slices(b, 2, BYTES_CHUNK):
                row = block(src, part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist() if narrowed else None)
                src += 1
                if len(row[-1]):
                    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["src", "doc_ids", "ths", "run_doc", "run_start", "run_asks", "widths", "keys"])

    return run


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their hits to (doc_id, th, ranges) of the windows whose stretch is repeated."""
    for b in batches:
        for row in b.to_pylist():
            hit = _repeats.mask(np.frombuffer(row["keys"], np.uint64), row["hits"])
            if not hit.any():
                continue
            widths = np.frombuffer(row["widths"], np.uint16).astype(np.int64)
            per_run = np.frombuffer(row["run_asks"], np.uint32).astype(np.int64)
            run_at = np.cumsum(per_run) - per_run
            ends = np.cumsum(widths)
            begin = ends - widths
            start = begin - np.repeat(begin[run_at], per_run) + np.repeat(np.frombuffer(row["run_start"], np.uint32).astype(np.int64), per_run)
            doc = np.repeat(np.frombuffer(row["run_doc"], np.uint32).astype(np.int64), per_run)
            s, e, d = start[hit], (start + widths)[hit], doc[hit]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != e[:-1]) | (d[1:] != d[:-1])
            at = np.flatnonzero(fresh)
            pairs = np.stack([s[at], e[np.append(at[1:], len(s)) - 1]], axis=1).astype(np.uint32)
            docs, cut = np.unique(d[at], return_index=True)
            cut = np.append(cut, len(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["doc_ids"][i] for i in docs], pa.int64()), pa.array([row["ths"][i] for i in docs], pa.int64()), pa.array([pairs[cut[i] : cut[i + 1]].tobytes() for i in range(len(docs))], pa.binary())],
                names=["doc_id", "th", "ranges"],
            )


def level(rows: DataFrame, window: int, length: int, narrowed: bool, scratch: Scratch, of_bytes: bool = False, second: bool = False) -> DataFrame:
    """One level: (doc_id, th, ranges) of the windows that survive it, a written table, one row for each id and text."""
    asks = scratch.write(rows.mapInArrow(lean(_asks(window, length, narrowed, of_bytes, second)), _ASKS), f"asks{length}")
    joined = asks.join(_repeats.repeated(asks), "src", "left")
    found = joined.mapInArrow(lean(_survivors), "doc_id long, th long, ranges binary").groupBy("doc_id", "th").agg(F.first("ranges").alias("ranges"))
    found = scratch.write(found, f"ranges{length}")
    scratch.drop(asks)
    return found


def with_ranges(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    size = found.agg(F.sum(F.octet_length("ranges") + 64)).first()[0] or 0
    side = checked(found.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "ranges"), size)
    return rows.join(side, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["th"] == F.col("_t")), how).select(*rows.columns, "ranges")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, text), and (doc_id, th, ranges) of their repeated windows: packed uint32 pairs [first, end) of word places."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    found, levels = None, [(n, False) for n in lengths(window)] + [(window, True)]
    for length, second in levels:
        step = rows if found is None else with_ranges(rows, found, "inner")
        found = level(step, window, length, found is not None, scratch, second=second)
        if not found.limit(1).count():
            break
    return rows, found


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out: list[list] = [[], [], [], []]
                for text, ranges in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    words = text.encode().split()
                    gone = 0
                    if ranges:
                        pair = np.frombuffer(ranges, np.uint32).reshape(-1, 2).astype(np.int64)
                        edge = np.zeros(len(words) + 1, np.int32)
                        np.add.at(edge, pair[:, 0], 1)
                        np.add.at(edge, np.minimum(pair[:, 1] - 1 + window, len(words)), -1)
                        kept = np.flatnonzero(np.cumsum(edge[:-1]) <= 0).tolist()
                        gone = len(words) - len(kept)
                        left = b" ".join([words[i] for i in kept])
                    else:
                        left = b" ".join(words)
                    out[0].append(len(words))
                    out[1].append(gone)
                    out[2].append(hashlib.sha256(left).hexdigest())
                    out[3].append(left.decode() if with_text else None)
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), *([pa.array(out[3], pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row of ``docs``."""
    rows, found = repeated_windows(docs, window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return with_ranges(rows, found, "left").select("doc_id", "th", "text", "ranges").mapInArrow(lean(_cut(window, with_text)), schema)
