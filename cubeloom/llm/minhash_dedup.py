"""Near-duplicate groups by MinHash.

1. Each text's set of distinct 5-word shingles (64-bit digests of lower-cased words) gives a
   128-bit digest of the set and ``MINIMA`` minima under universal hash functions.
2. Documents with equal sets form a class; from here on its smallest id stands for it.
3. ``BANDS`` bands of ``ROWS`` minima deal the classes into buckets.  In each bucket every
   class is tied to the smallest one only; of the smallest ones a class meets, the one met
   in most bands is tried first.
4. A tie is checked on the signatures, then confirmed on the full sets of both texts.
5. Confirmed links are closed by alternating large-star and small-star.  The classes of the
   texts of one id are linked from the start.
6. Buckets in which several components still meet are reopened.  One of up to ``BLOCK`` members
   is compared as it is: members of different components on fine sketches (the least digest of
   each of ``BINS`` bins of the set), and similar ones are confirmed on the full sets, so that a
   link missed by step 3 is found.  A larger one is split by finer bands first (``FINER`` of 8,
   then 16, ... other minima), so that no bucket is compared by all its pairs.  A pair is tried
   at most with the ``k`` most similar partners of a class in a bucket at first; as long as that
   bound cut something off, the step is repeated on what is still apart with a larger one.

What isn't compared: two texts without a common bucket, at similarity 0.75 with probability
(1 - 0.75**4)**32 = 5e-6, in a bucket of over ``BLOCK`` without a common finer bucket, at most
``MISS`` (1e-5); and pairs whose sketches agree ``DEVIATIONS`` (6) standard deviations less than
at 0.75 (sketches of small sets rule a pair out with certainty only).

Null or word-less texts have an empty set, link with nothing and are kept.  A null id can't
be named: its component is null, it is kept and links with nothing.  Rows that repeat an id
are one document with the links of all its texts.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import BROADCAST_BYTES, Scratch, checked, lean, tasks
from .components import connected_components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: A pair isn't confirmed on the full sets if its sketches agree so many standard deviations less than at similarity 0.75.
DEVIATIONS = 6
#: Bins of fine sketches, and filled ones up to which they rule a pair out with certainty only.
BINS, FEW = 1024, 64
#: Minima in each finer band of a bucket of over BLOCK members, at first and more in each round after that, and the chance that a pair of similarity 0.75 shares none of the finer bands.
FINER_ROWS, MORE_ROWS, MISS = 8, 4, 1e-5
#: Members of a bucket compared in one block, and members of a leader confirmed in one group.
BLOCK = 2048
CHUNK = 256
_rng = np.random.Generator(np.random.PCG64(75))
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64 - 1, MINIMA, dtype=np.uint64)
_SHORT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle digests of each text."""
    raw, off = _text.string_buffers(col)
    for a, b in _text.chunks(off):
        part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends, first = _text.words(part, o)
        h = _text.word_hashes(part, starts, ends, lower=True)
        w = _text.window_hashes(h, WORDS)
        for i in range(b - a):
            s, e = first[i], first[i + 1]
            if e - s >= WORDS:
                yield np.unique(w[s : e - WORDS + 1])
            elif e > s:
                x = np.full(1, e - s, np.uint64)
                for v in h[s:e]:
                    x = _text.mix(x * _SHORT + v)
                yield x
            else:
                yield np.zeros(0, np.uint64)


def _fine(sets: list[np.ndarray]) -> np.ndarray:
    """For each set one byte per bin: 0 if empty, else a mark of the bin's least digest."""
    out = np.zeros((len(sets), BINS), np.uint8)
    for i, s in enumerate(sets):
        if len(s):
            at, first = np.unique(s >> np.uint64(54), return_index=True)
            out[i, at.astype(np.int64)] = _text.mix(s[first]) % np.uint64(255) + np.uint64(1)
    return out


def _digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set two digests of the whole set and the minima (n x MINIMA uint32)."""
    n = len(sets)
    one, two, minima = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, MINIMA), np.uint32)
    full = [i for i in range(n) if len(sets[i])]
    at = 0
    while at < len(full):
        take, size = [], 0
        while at < len(full) and (not take or size + len(sets[full[at]]) <= 1 << 16):
            take.append(full[at])
            size += len(sets[full[at]])
            at += 1
        x = np.concatenate([sets[i] for i in take])
        cut = np.cumsum([0, *(len(sets[i]) for i in take)])[:-1]
        one[take] = np.add.reduceat(_text.mix(x ^ np.uint64(11)), cut)
        two[take] = np.add.reduceat(_text.mix(x ^ np.uint64(13)), cut)
        for k in range(MINIMA):
            minima[take, k] = np.minimum.reduceat(x * _A[k] + _B[k], cut) >> np.uint64(32)
    return one, two, minima


def _fixed(data: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    n, width = data.shape[0], data.dtype.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            sets = list(shingle_sets(b.column(1)))
            one, two, minima = _digest(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _fixed(minima), _fixed(_fine(sets))],
                names=["doc_id", "n", "f1", "f2", "sig", "fine"],
            )


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, MINIMA)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            sig = _signatures(b.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                key = _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            # The band itself rides in a key's low bits.
            key = (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key.ravel().view(np.int64))], names=["rep", "key"])


def least_share(places: np.ndarray | int, union: np.ndarray | float = np.inf) -> np.ndarray:
    """The share of equal ones among so many places, drawn from a union of known size, below which a pair of similarity 0.75 is ruled out."""
    unseen = 1.0 if np.isscalar(union) and np.isinf(union) else np.clip((union - places) / np.maximum(union - 1, 1), 0, 1)
    return PERCENT / 100 - DEVIATIONS * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / np.maximum(places, 1) * unseen)


def near_sketches(fine: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets may have similarity 0.75 with one, by fine sketches and sizes; and their estimated similarity.

    In up to ``FEW`` filled bins the bound is certain: a shared element is missed by the equal
    bins only if another one of either set has its bin, and these are counted.
    """
    full = (fine | one) > 0
    places, equal = full.sum(axis=1), ((fine == one) & full).sum(axis=1)
    est = equal / np.maximum(places, 1)
    most = equal + (sizes - (fine > 0).sum(axis=1)) + (size - (one > 0).sum())
    certain = 100 * most >= PERCENT * (sizes + size - most)
    # At similarity 0.75 the sizes add up to 1.75 times the union's.
    likely = est >= least_share(places, (sizes + size) / (1 + PERCENT / 100))
    return np.where(places <= FEW, certain, likely), est


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for b in batches:
        if b.num_rows:
            same = (_signatures(b.column(2)) == _signatures(b.column(3))).mean(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(same >= least_share(MINIMA)))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lead, salt, role): a leader's texts (role 0), then those of its partners (role 1)."""
    group, leaders = None, []
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            lead, salt, role, doc = (b.column(i).to_pylist() for i in range(4))
            a, c = [], []
            for i, s in enumerate(shingle_sets(b.column(4))):
                if group != (lead[i], salt[i]):
                    group, leaders = (lead[i], salt[i]), []
                if role[i] == 0:
                    leaders.append(s)
                    continue
                for x in leaders:
                    if 100 * min(len(x), len(s)) < PERCENT * max(len(x), len(s)):
                        continue
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(x) + len(s) - both):
                        a.append(doc[i])
                        c.append(lead[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["u", "v"])


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets, as (u, v).  Texts are sent once for each a and for each ``CHUNK`` partners of a b."""
    spark = docs.sparkSession
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    partners = pairs.join(counts, "b").select(F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("doc"))
    leads = counts.select(F.col("b").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("b").alias("doc"))
    work = partners.union(leads)
    sent = docs.select("doc_id", "text").join(checked(work, 40 * 2 * pairs.count()), F.col("doc_id") == F.col("doc"))
    sent = sent.select("lead", "salt", "role", "doc", "text").repartition(tasks(spark), "lead", "salt").sortWithinPartitions("lead", "salt", "role")
    return sent.mapInArrow(lean(_confirm), "u long, v long")


def _reopened(k: int):
    """For an open bucket: the k most similar members of other components for each class."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy())
        table = table.take(pa.array(order))
        reps, comps, sizes = (table.column(c).to_numpy() for c in ("rep", "component", "n"))
        bands = _signatures(table.column("sig")).reshape(-1, BANDS, ROWS)
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, BINS)
        band = table.column("band")[0].as_py()
        a, b, cut = [], [], False
        for x in range(len(reps)):
            other = np.flatnonzero(comps != comps[x])
            near, est = near_sketches(fine[other], sizes[other], fine[x], sizes[x])
            other, est = other[near], est[near]
            if band > 0:  # a pair is tried in the first band that both share
                earlier = (bands[other, :band] == bands[x, :band]).all(axis=2).any(axis=1)
                other, est = other[~earlier], est[~earlier]
            best = other[np.lexsort((reps[other], -est))]
            cut |= len(best) > k
            a.append(np.maximum(reps[best[:k]], reps[x]))
            b.append(np.minimum(reps[best[:k]], reps[x]))
        pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])], axis=1), axis=0)
        ends = ([-1], [None]) if cut else ([], [])
        return pa.table({"a": pa.array([*pairs[:, 0].tolist(), *ends[0]], pa.int64()), "b": pa.array([*pairs[:, 1].tolist(), *ends[1]], pa.int64())})

    return run


def _with_key(rows: DataFrame, per_key: DataFrame, size: str, scratch: Scratch, how: str = "inner") -> DataFrame:
    """``rows`` (key, rep, ..) joined to the one row of the written ``per_key`` (key, ..) for their key; ``size`` names its number of rows.

    Beyond the bound of a broadcast, a key with more than ``BLOCK`` rows is dealt out over as many places as it has blocks, so that a hot one doesn't meet in one task.
    """
    n = per_key.count()
    if 32 * n <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_key), "key", how)
    hot = scratch.write(per_key.where(F.col(size) > BLOCK).select("key", F.ceil(F.col(size) / BLOCK).cast("int").alias("_parts")), "hot")
    spread = rows.join(checked(hot, 16 * hot.count()), "key", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    parts = F.sequence(F.lit(0), F.ceil(F.col(size) / BLOCK).cast("int") - 1)
    return spread.join(per_key.withColumn("_part", F.explode(parts)), ["key", "_part"], how).drop("_part")


def _open_buckets(buckets: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, band, rep, component, m) of the buckets (rep, key, band) in which components still meet; m is the bucket's size."""
    placed = buckets.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    still = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    still = scratch.write(still.select("key", "m"), "still")
    return scratch.write(_with_key(placed, still, "m", scratch).select("key", "band", "rep", "component", "m"), "open")


def _stars(docs: DataFrame, classes: DataFrame, bands: DataFrame, tried: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every class of a bucket (rep, key) is tied to the bucket's least one: (buckets of two or more, pairs tried, links)."""
    leads = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("m")).where("lead <> hi").drop("hi")
    shared = scratch.write(_with_key(bands, scratch.write(leads, "leads"), "m", scratch).select("rep", "key", "lead"), "shared")
    met = shared.where("rep <> lead").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("rep").agg(F.max(F.struct("n", (-F.col("lead")).alias("m"))).alias("x")).select(F.col("rep").alias("a"), (-F.col("x.m")).alias("b"))
    best = scratch.write(best if tried is None else best.join(tried, ["a", "b"], "left_anti"), "best")
    named = best.select(F.col("a").alias("rep")).union(best.select("b")).distinct()
    sigs = scratch.write(classes.select("rep", "sig").join(checked(named, 32 * best.count()), "rep", "left_semi"), "signatures")
    sig_of = lambda c: sigs.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    similar = best.join(sig_of("a"), "a").join(sig_of("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lean(_similar), "a long, b long")
    near = scratch.write(similar.distinct(), "stars")
    scratch.drop(best, sigs)
    return shared, near, scratch.write(confirmed(docs, near), "links")


def _finer(rows: int):
    """(rep, keys, text) to (rep, key) of finer buckets: a key with a band of so many minima under further hash functions."""
    bands = int(np.ceil(np.log(MISS) / np.log1p(-((PERCENT / 100) ** rows))))
    rng = np.random.Generator(np.random.PCG64(1000 + rows))
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**64 - 1, bands * rows, dtype=np.uint64)

    def minima(s: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 18) // len(s))
        return np.concatenate([(s[None, :] * a[i : i + step, None] + b[i : i + step, None]).min(axis=1) for i in range(0, len(a), step)]).reshape(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                part = whole.slice(at, 1)
                rep, keys = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                least = minima(next(shingle_sets(part.column(2))))
                h = np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
                for key in keys:
                    out = _text.mix(h ^ np.uint64(key & (2**64 - 1))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(bands, rep)), pa.array(out)], names=["rep", "key"])

    return run


def _finer_buckets(docs: DataFrame, large: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Finer buckets (rep, key) of buckets (rep, key)."""
    keys = scratch.write(large.groupBy("rep").agg(F.collect_set("key").alias("keys")), "split")  # a class has as many keys as bands, at most
    texts = docs.join(checked(keys, 16 * keys.count() + 8 * large.count()), F.col("doc_id") == F.col("rep")).select("rep", "keys", "text")
    return scratch.write(texts.repartition(tasks(docs.sparkSession)).mapInArrow(lean(_finer(rows)), "rep long, key long").distinct(), "finer")


def _open_pairs(open_: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Candidate pairs (a, b) of open buckets; a row with null b says that k cut something off."""
    ids = open_.select("rep").distinct()
    sketches = classes.select("rep", "n", "sig", "fine").join(checked(ids, 16 * ids.count()), "rep", "left_semi")
    return open_.join(sketches, "rep").groupBy("key").applyInArrow(_reopened(k), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.write(docs.mapInArrow(lean(_sketches), "doc_id long, n long, f1 long, f2 long, sig binary, fine binary"), "sketch")
    live = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # Only sets that several rows have need a meeting; a key of many rows is an exact copy of a text.
    keyed = sketch.select("doc_id", "n", F.when(live, F.struct("f1", "f2")).alias("key"), F.col("doc_id").alias("rep"))
    least = keyed.where("key is not null").groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    named = _with_key(keyed, scratch.write(least, "least"), "m", scratch, "left")
    members = scratch.write(named.select("doc_id", "n", F.when(F.col("key").isNotNull(), F.coalesce("least", "doc_id")).alias("rep")), "members")
    # An id with several texts belongs to all their classes and ties them together.
    tied = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("hi")).where("v <> hi")
    tied = scratch.write(members.join(tied.select("doc_id", "v"), "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct(), "tied")
    # Sketches stay where they were written; only ids move to pick out those of classes.
    reps = scratch.write(members.where("doc_id = rep").select("rep").distinct(), "reps")
    classes = sketch.where(live).withColumnRenamed("doc_id", "rep").join(checked(reps, 16 * reps.count()), "rep", "left_semi")
    bands = classes.select("rep", "sig").mapInArrow(lean(_bands), "rep long, key long")
    shared, tried, links = _stars(docs, classes, bands, None, scratch)
    links = links.union(tied)
    comps = scratch.write(connected_components(links, scratch), "components")
    buckets = shared.select("rep", "key", F.col("key").bitwiseAND(BANDS - 1).cast("int").alias("band"))
    k, rows = 4, FINER_ROWS
    while True:
        open_ = _open_buckets(buckets, comps, scratch)
        large, small = open_.where(F.col("m") > BLOCK), open_.where(F.col("m") <= BLOCK)
        found = scratch.write(_open_pairs(small, classes, k), "pairs")
        more = scratch.write(found.where("b is not null").join(tried, ["a", "b"], "left_anti"), "more")
        cut, split = bool(found.where("b is null").limit(1).count()), bool(large.limit(1).count())
        new = []
        if more.limit(1).count():
            tried = tried.union(more)
            new.append(scratch.write(confirmed(docs, more), "links"))
        buckets = small.select("rep", "key", "band") if cut else small.select("rep", "key", "band").limit(0)
        if split:
            finer, near, tied = _stars(docs, classes, _finer_buckets(docs, large.select("rep", "key"), rows, scratch), tried, scratch)
            tried = tried.union(near)
            new.append(tied)
            buckets = buckets.union(finer.select("rep", "key", F.lit(-1).alias("band")))
            rows += MORE_ROWS
        for x in new:
            links = links.union(x)
        if new:
            comps = scratch.write(connected_components(links, scratch), "components")
        if not cut and not split:
            break
        k *= 16 if cut else 1
    scratch.drop(sketch, shared)
    named = members.select("doc_id", "n", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group."""
    found = near_duplicates(docs)
    scratch = Scratch(docs.sparkSession, "minhash-kept")
    gone = scratch.write(found.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(checked(gone, 16 * gone.count()), "doc_id", "left_anti").select(docs.columns)
