"""Suffix-array dedup with a logarithmic index family.

A string is ``WINDOW`` bytes.  A byte is removed if a string that covers it also starts in a
document with a smaller id.

1. Each string chooses the 16-byte stretch in it with the least hash; strings whose stretch
   occurs once in the corpus are unique and go no further.
2. The others are dealt to shards by their stretch, so that equal strings meet: for each
   stretch the bytes of all its strings are sent once, as one fragment.  A task's shards are
   sent to together, a row for each ``ROOM`` bytes of text, so that rows don't multiply with
   the number of shards.  Of equal fragments, first in a block and then in a shard, only the
   smallest document's is searched; the others are removed as a whole.
3. In a shard, documents come in ascending order of id, in batches.  A batch gets a suffix
   array: the places of its strings in the shared bytes of its fragments, in byte order, sorted
   by eight bytes at a time and only as far as strings are still alike.  It is merge-scanned
   against the suffix array of every level of the index, and its new strings become a level
   (bytes and places); levels of about equal size are merged in one pass over both, so there
   are at most log2(batches) of them.  Strings are compared byte by byte, never by hash.

``add_batch`` keeps the levels between calls: each takes a further batch of documents and returns
the levels for the caller to store.

Null text counts as empty.  A null id has no order: such rows lose nothing and take nothing
from others.  Rows that repeat an id are parts of one document.  Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import Scratch, lean, tasks, text_or_empty
from .substring_dedup import BYTES_CHUNK, chosen, level, slices, with_ranges

WINDOW = 50
STRETCH = 16
#: Strings in a batch, in a shard, and in a block of a merge-scan, about.
BATCH = 1 << 17
SHARD = 1 << 19
SCAN = 1 << 15
#: Shards that a task gets at once, at most, and bytes of texts whose fragments a task deals out together, about.
TASK_SHARDS = 16
ROOM = 1 << 24


@dataclass
class Run:
    """Distinct strings of ``window`` bytes in byte order: their places in shared bytes."""

    data: np.ndarray
    places: np.ndarray
    window: int

    def __len__(self) -> int:
        return len(self.places)

    def string(self, i: int) -> bytes:
        at = int(self.places[i])
        return self.data[at : at + self.window].tobytes()

    def strings(self, lo: int, hi: int) -> np.ndarray:
        """Strings lo to hi as fixed-width values: copied out for a block only."""
        return np.lib.stride_tricks.sliding_window_view(self.data, self.window)[self.places[lo:hi]].view(f"S{self.window}").ravel()

    def below(self, value: bytes, lo: int) -> int:
        """How many strings are at most ``value``, at least the first ``lo``."""
        hi = len(self)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.string(mid) <= value else (lo, mid)
        return lo


def suffix_array(data: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): places by their strings of ``window`` bytes, equal ones as they came, and which of these are the first of equal ones."""
    n = len(places)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order, first, alike = np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    for at in range(0, window, 8):
        slots = np.flatnonzero(alike)
        if len(slots) < 2:
            break
        key = np.lib.stride_tricks.sliding_window_view(padded, 8)[places[order[slots]] + at].view(">u8").ravel().astype(np.uint64)
        key >>= np.uint64(8 * max(0, at + 8 - window))
        by = np.lexsort((key, first[slots])) if at else np.argsort(key, kind="stable")
        order[slots], key, group = order[slots][by], key[by], first[slots]
        new = np.ones(len(slots), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(slots)))
        first[slots] = np.repeat(slots[starts], sizes)
        alike[slots] = np.repeat(sizes > 1, sizes)
    return order, first == np.arange(n)


def merge_scan(level: Run, run: Run) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``run`` how many of ``level`` are less, and whether it is one of them: one pass over both, block by block."""
    at, held, done = np.zeros(len(run), np.int64), np.zeros(len(run), bool), 0
    for lo in range(0, len(level), SCAN):
        if done == len(run):
            break
        hi = min(lo + SCAN, len(level))
        block = level.strings(lo, hi)
        end = run.below(level.string(hi - 1), done)
        for a in range(done, end, SCAN):
            b = min(a + SCAN, end)
            mine = run.strings(a, b)
            place = np.searchsorted(block, mine)
            at[a:b], held[a:b] = lo + place, block[np.minimum(place, len(block) - 1)] == mine
        done = end
    at[done:] = len(level)
    return at, held


def merged(a: Run, b: Run) -> Run:
    """Both runs' strings, which differ, in one order."""
    at, _ = merge_scan(a, b)
    out = np.empty(len(a) + len(b), np.int64)
    mine = np.zeros(len(out), bool)
    mine[at + np.arange(len(b))] = True
    out[mine], out[~mine] = b.places + len(a.data), a.places
    return Run(np.concatenate([a.data, b.data]), out, a.window)


class IndexFamily:
    """Levels of distinct strings; sizes fall by half at least from one level to the next."""

    def __init__(self) -> None:
        self.levels: list[Run] = []

    def holds(self, run: Run) -> np.ndarray:
        """Which strings of a run are in any level."""
        found = np.zeros(len(run), bool)
        for x in self.levels:
            found |= merge_scan(x, run)[1]
        return found

    def add(self, run: Run) -> None:
        """A new level of strings that no level holds; levels of about equal size merge."""
        if not len(run):
            return
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b))


def repeated_later(data: np.ndarray, places: np.ndarray, docs: np.ndarray, window: int, batch: int = BATCH, family: IndexFamily | None = None) -> np.ndarray:
    """Which strings (ascending places in ``data``) are also there with a smaller document, or in ``family``, which takes up the others; docs ascend."""
    out = np.zeros(len(places), bool)
    family = IndexFamily() if family is None else family
    border = np.append(np.flatnonzero(np.diff(docs)) + 1, len(docs))  # batches end between documents
    a = 0
    while a < len(places):
        b = int(border[min(np.searchsorted(border, a + batch), len(border) - 1)])
        begin = places[a]
        part, at, d = data[begin : places[b - 1] + window], places[a:b] - begin, docs[a:b]
        order, fresh = suffix_array(part, at, window)
        group = np.cumsum(fresh) - 1
        own = Run(part, at[order[fresh]], window)
        old = family.holds(own)
        out[a + order] = old[group] | (d[order] > d[order[fresh]][group])
        family.add(Run(part, own.places[~old], window))
        a = b
    return out


_FRAGMENTS = "part int, src long, docs binary, ths binary, f_doc binary, f_start binary, f_width binary, counts binary, bytes binary"
_NAMES = ["part", "src", "docs", "ths", "f_doc", "f_start", "f_width", "counts", "bytes"]


def _fragments(window: int, parts: int, each: int = 1, narrowed: bool = True):
    """Texts to fragments, dealt to ``parts`` parts of ``each`` shards: a row for each part and about ROOM bytes of text, its fragments by shard."""
    shards = np.uint64(parts * each)

    def block(part: pa.RecordBatch) -> tuple | None:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        ths = part.column(1).to_numpy(zero_copy_only=False)
        raw, off = _text.string_buffers(part.column(2))
        first, p, doc, at, keys = chosen(raw, off, window, STRETCH, part.column(3).to_pylist() if narrowed else None, True)
        if not len(at):
            return None
        width = np.diff(np.append(at, len(p)))
        begin, owner = p[at], doc[at]
        start = begin - first[owner]
        flat = raw.tobytes()
        pieces = [flat[s : s + w] for s, w in zip(begin.tolist(), (width + window - 1).tolist())]
        least: dict[bytes, int] = {}
        id_of = ids[owner]
        for piece, d in zip(pieces, id_of.tolist()):
            if d < least.get(piece, d + 1):
                least[piece] = d
        later = id_of > np.fromiter(map(least.__getitem__, pieces), np.int64, len(pieces))
        shard = (((keys >> np.uint64(32)) * shards) >> np.uint64(32)).astype(np.int32)
        shard[later] = -1
        return flat, ids, ths, owner.astype(np.uint32), begin.astype(np.uint32), start.astype(np.uint32), width.astype(np.uint16), shard

    def dealt(src: int, blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        n_bytes, n_docs = (np.cumsum([0, *(len(b[i]) for b in blocks[:-1])]).astype(np.uint32) for i in (0, 1))
        flats, ids, ths, owner, begin, start, width, shard = zip(*blocks)
        owner = np.concatenate([x + k for x, k in zip(owner, n_docs)])
        begin = np.concatenate([x + k for x, k in zip(begin, n_bytes)])
        ids, ths, start, width, shard = map(np.concatenate, (ids, ths, start, width, shard))
        flat = b"".join(flats)
        order = np.argsort(shard, kind="stable")
        part = shard[order] // each
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-2)), len(order))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
        rows: list[list] = []
        held = 0
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            mine, k = order[lo:hi], int(part[lo])
            used, f_doc = np.unique(owner[mine], return_inverse=True)
            counts, sent = b"", b""
            if k >= 0:
                counts = np.bincount(shard[mine] - k * each, minlength=each).astype(np.uint32).tobytes()
                at = begin[mine].astype(np.int64)
                sent = b"".join([flat[x:y] for x, y in zip(at.tolist(), (at + width[mine] + window - 1).tolist())])
            rows.append([k, src, ids[used].tobytes(), ths[used].tobytes(), f_doc.astype(np.uint32).tobytes(), start[mine].tobytes(), width[mine].tobytes(), counts, sent])
            held += len(sent)
            if held >= BYTES_CHUNK or hi == len(order):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=_NAMES)
                rows, held = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 32
        blocks: list[tuple] = []
        held = 0
        for b in batches:
            for part in slices(b, 2, BYTES_CHUNK):
                if (found := block(part)) is not None:
                    blocks.append(found)
                    held += len(found[0])
                if held >= ROOM:
                    yield from dealt(src, blocks)
                    src, blocks, held = src + 1, [], 0
        if blocks:
            yield from dealt(src, blocks)

    return run


_HITS = "src long, docs binary, ths binary, h_doc binary, lo binary, hi binary"


def _hits(src: int, docs: bytes, ths: bytes, f_doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list:
    """One row of removed string places [lo, hi) by document; only documents that have some."""
    used, again = np.unique(f_doc, return_inverse=True)
    take = lambda x: np.frombuffer(x, np.int64)[used].tobytes()
    return [src, take(docs), take(ths), again.astype(np.uint32).tobytes(), lo.astype(np.uint32).tobytes(), hi.astype(np.uint32).tobytes()]


def _part_hits(window: int):
    def searched(blob: bytes, at: np.ndarray, width: np.ndarray, ids: np.ndarray, mine: np.ndarray, family: IndexFamily | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fragments, lo, hi): the removed strings of a shard, whose fragments are ``mine``, as places in their fragments."""
        order = mine[np.argsort(ids[mine], kind="stable")]
        size = width[order] + window - 1
        # A fragment that a smaller document has too is removed as a whole; the others are searched.
        least: dict[bytes, int] = {}
        later = np.fromiter((least.setdefault(blob[lo : lo + n], d) < d for lo, n, d in zip(at[order].tolist(), size.tolist(), ids[order].tolist())), bool, len(order))
        del least
        whole, order, n = order[later], order[~later], size[~later]
        w = width[order]
        data = np.frombuffer(b"".join([blob[lo : lo + k] for lo, k in zip(at[order].tolist(), n.tolist())]), np.uint8)
        inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        frag = np.repeat(order, w)
        hit = repeated_later(data, np.repeat(np.cumsum(n) - n, w) + inner, ids[frag], window, family=family)
        frag, inner = frag[hit], inner[hit]
        fresh = np.ones(len(frag), bool)
        fresh[1:] = (frag[1:] != frag[:-1]) | (inner[1:] != inner[:-1] + 1)
        lo_at = np.flatnonzero(fresh)
        hi_at = np.append(lo_at[1:], len(frag))[: len(lo_at)] - 1
        return np.concatenate([frag[lo_at], whole]), np.concatenate([inner[lo_at], np.zeros(len(whole), np.int64)]), np.concatenate([inner[hi_at] + 1, width[whole]])

    def part_rows(rows: list[dict], family: IndexFamily | None = None) -> Iterator[list]:
        """Hits of a part's rows; a family is that of a part of one shard."""
        f_doc, f_start, f_width = ([np.frombuffer(r[name], kind).astype(np.int64) for r in rows] for name, kind in (("f_doc", np.uint32), ("f_start", np.uint32), ("f_width", np.uint16)))
        if rows[0]["part"] < 0:
            for r, d, s, w in zip(rows, f_doc, f_start, f_width):
                yield _hits(r["src"], r["docs"], r["ths"], d, s, s + w)
            return
        owner = np.repeat(np.arange(len(rows)), [len(d) for d in f_doc])
        ids = np.concatenate([np.frombuffer(r["docs"], np.int64)[d] for r, d in zip(rows, f_doc)])
        doc, start, width = map(np.concatenate, (f_doc, f_start, f_width))
        del f_doc, f_start, f_width
        counts = np.stack([np.frombuffer(r["counts"], np.uint32) for r in rows])
        shard = np.repeat(np.tile(np.arange(counts.shape[1]), len(rows)), counts.ravel())
        at = np.cumsum(width + window - 1) - (width + window - 1)
        blob = b"".join([r.pop("bytes") for r in rows])
        by_shard = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[by_shard], np.arange(counts.shape[1] + 1))
        found = [searched(blob, at, width, ids, by_shard[a:b], family) for a, b in zip(cut[:-1], cut[1:]) if a < b]
        del blob
        f, lo, hi = map(np.concatenate, zip(*found))
        by_row = np.argsort(owner[f], kind="stable")
        f, lo, hi = f[by_row], lo[by_row], hi[by_row]
        cut = np.searchsorted(owner[f], np.arange(len(rows) + 1))
        for r, a, b in zip(rows, cut[:-1], cut[1:]):
            if a < b:
                yield _hits(r["src"], r["docs"], r["ths"], doc[f[a:b]], start[f[a:b]] + lo[a:b], start[f[a:b]] + hi[a:b])

    return part_rows


def _search(window: int):
    part_rows = _part_hits(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            for values in part_rows(rows):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, [pa.int64(), *[pa.binary()] * 5])], names=["src", "docs", "ths", "h_doc", "lo", "hi"])

        rows: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if rows and (rows[0]["part"] != r["part"] or r["part"] < 0):
                    yield from out(rows)
                    rows = []
                rows.append(r)
            del b
        if rows:
            yield from out(rows)

    return run


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All hits of a block to (doc_id, th, ranges)."""
    for b in batches:
        for row in b.column(0).to_pylist():
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            for h in row:
                docs, ths = np.frombuffer(h["docs"], np.int64), np.frombuffer(h["ths"], np.int64)
                d = np.frombuffer(h["h_doc"], np.uint32)
                pair = np.stack([np.frombuffer(h["lo"], np.uint32), np.frombuffer(h["hi"], np.uint32)], axis=1)
                order = np.argsort(d, kind="stable")
                cut = np.searchsorted(d[order], np.arange(len(docs) + 1))
                for i in range(len(docs)):
                    found.setdefault((int(docs[i]), int(ths[i])), []).append(pair[order[cut[i] : cut[i + 1]]])
            ranges = []
            for pairs in found.values():
                pair = np.concatenate(pairs).astype(np.int64)
                pair = pair[np.argsort(pair[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pair[:, 1])
                fresh = np.ones(len(pair), bool)
                fresh[1:] = pair[1:, 0] > reach[:-1]
                at = np.flatnonzero(fresh)
                ranges.append(np.stack([pair[at, 0], reach[np.append(at[1:], len(pair)) - 1]], axis=1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(ranges, pa.binary())], names=["doc_id", "th", "ranges"])


def _cut(window: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out: list[list] = [[], [], [], [], []]
                for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    raw = text.encode()
                    left, gone, spans = raw, 0, 0
                    if ranges:
                        pair = np.frombuffer(ranges, np.uint32).reshape(-1, 2).astype(np.int64)
                        edge = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(edge, pair[:, 0], 1)
                        np.add.at(edge, pair[:, 1] - 1 + window, -1)
                        cut = np.cumsum(edge[:-1]) > 0
                        gone, spans = int(cut.sum()), int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                        left = np.frombuffer(raw, np.uint8)[~cut].tobytes()
                    for c, x in zip(out, (len(raw), gone, spans, hashlib.sha256(left).hexdigest(), left)):
                        c.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_bytes else [])]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", *names])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``; kept holds the remaining bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    named = rows.where("doc_id is not null")
    found = level(named, window, STRETCH, False, scratch, of_bytes=True)
    strings = found.mapInArrow(lean(_count), "n long").agg(F.sum("n")).first()[0] or 0
    shards = -(-strings // SHARD)
    parts = max(tasks(spark), -(-shards // TASK_SHARDS))
    each = max(1, -(-shards // parts))
    sent = with_ranges(named, found, "inner").select("doc_id", "th", "text", "ranges").mapInArrow(lean(_fragments(window, parts, each)), _FRAGMENTS)
    # Texts' own hits (part -1) need no meeting and stay spread.
    deal = F.when(F.col("part") < 0, F.pmod(F.xxhash64("src"), F.lit(parts))).otherwise(F.col("part")).cast("int")
    dealt = sent.repartitionById(parts, deal).sortWithinPartitions("part")
    hits = dealt.mapInArrow(lean(_search(window)), _HITS)
    out = _told(spark, rows, hits, window, with_bytes, scratch)
    scratch.drop(found)
    return out


def _told(spark: SparkSession, rows: DataFrame, hits: DataFrame, window: int, with_bytes: bool, scratch: Scratch) -> DataFrame:
    """Rows (doc_id, th, text) without the bytes that hits cover, as ``remove_repeats`` returns them."""
    grouped = hits.groupBy("src").agg(F.collect_list(F.struct("docs", "ths", "h_doc", "lo", "hi")).alias("hits")).select("hits")
    removed = grouped.mapInArrow(lean(_per_document), "doc_id long, th long, ranges binary")
    removed = scratch.write(removed.groupBy("doc_id", "th").agg(F.first("ranges").alias("ranges")), "removed")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return with_ranges(rows, removed, "left").select("doc_id", "text", "ranges").mapInArrow(lean(_cut(window, with_bytes)), schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of places that packed ranges name."""
    for b in batches:
        n = 0
        for r in b.column(b.schema.get_field_index("ranges")).to_pylist():
            pair = np.frombuffer(r, np.uint32).reshape(-1, 2).astype(np.int64)
            n += int((pair[:, 1] - pair[:, 0]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


_LEVELS = "shard int, level int, data binary, places binary"


def _extended(window: int):
    """A shard's new fragments and stored levels to its hits (kind 0) and its levels after them (kind 1)."""
    part_rows = _part_hits(window)
    hit_kinds = [pa.int64(), *[pa.binary()] * 5]

    def run(key: tuple, new: pa.Table, stored: pa.Table) -> pa.Table:
        family = IndexFamily()
        for r in sorted(stored.to_pylist(), key=lambda r: r["level"]):
            family.levels.append(Run(np.frombuffer(r["data"], np.uint8), np.frombuffer(r["places"], np.int64), window))
        hits = list(part_rows(new.to_pylist(), family)) if new.num_rows else []
        levels = [[i, x.data.tobytes(), x.places.astype(np.int64).tobytes()] for i, x in enumerate(family.levels)]
        n, m, shard = len(hits), len(levels), key[0].as_py()
        columns = [pa.array([0] * n + [1] * m, pa.int32()), pa.array([shard] * (n + m), pa.int32())]
        columns += [pa.array([None] * n + [x[i] for x in levels], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        columns += [pa.array([x[i] for x in hits] + [None] * m, k) for i, k in enumerate(hit_kinds)]
        return pa.Table.from_arrays(columns, names=["kind", "shard", "level", "data", "places", "src", "docs", "ths", "h_doc", "lo", "hi"])

    return run


def add_batch(docs: DataFrame, levels: DataFrame | None = None, window: int = WINDOW, shards: int = 64, with_bytes: bool = False) -> tuple[DataFrame, DataFrame]:
    """A new batch against an index of all strings of earlier ones: (what ``remove_repeats`` tells of its documents, the levels after it).

    ``levels`` (shard, level, data, places) is what the call before returned, as the caller has
    stored it; None starts an index.  All calls take the same ``shards``, which bounds what a task
    holds.  The documents count as later than all before, in the order of their ids; a batch with
    greater ids than those before gives what one call over everything gives.  The index holds
    every string, as any may come again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-batch")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    sent = rows.where("doc_id is not null").withColumn("ranges", F.lit(None).cast("binary")).mapInArrow(lean(_fragments(window, shards, narrowed=False)), _FRAGMENTS)
    sent = scratch.write(sent, "fragments")
    levels = spark.createDataFrame([], _LEVELS) if levels is None else levels
    both = sent.where("part >= 0").groupBy("part").cogroup(levels.groupBy("shard"))
    both = scratch.write(both.applyInArrow(_extended(window), "kind int, " + _LEVELS + ", " + _HITS), "levels")
    own = sent.where("part < 0").mapInArrow(lean(_search(window)), _HITS)
    hits = both.where("kind = 0").select(own.columns).union(own)
    return _told(spark, rows, hits, window, with_bytes, scratch), both.where("kind = 1").select("shard", "level", "data", "places")
