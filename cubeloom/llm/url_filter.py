"""URL filters over a sorted digest array.

Rules (host, path, verdict) are kept as one file image: 64-bit xxhash keys in ascending
order, then the rules' strings, their places and verdicts.  Each worker process memory-maps
the image once, probes it with a vectorised binary search for every (host suffix, path prefix)
a url could fall under, and compares the stored strings in full, so equal digests of different
strings never decide.  The longest fitting rule wins (of equal lengths the longer host).  Only
suffixes and prefixes of lengths that some rule has are tried, so a url costs no more than the
number of such pairs of lengths, however long it is.

The image is broadcast only up to ``MOST_IMAGE_BYTES``; larger rule sets are joined on the
digest instead (``judge_by_join``), with the same full comparison and the same results: rules
that repeat a (host, path) count as one with the greatest of their verdicts, and a verdict may
be any string.

Null urls and urls without ``://`` have an empty host and path, which no rule fits; they get
the default verdict.  Null and repeated ids are kept, one result per row; columns beside the id
and the url are passed over.  An empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import lean

MOST_IMAGE_BYTES = 256 << 20
_HEAD = struct.Struct("<8sQQQ")
_MAGIC = b"URLDIG02"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())
#: The rules of the registered query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"


def _split(pages: DataFrame, id_col: str) -> DataFrame:
    """(id, host, path): host with A-Z lower-cased; both empty if the url is null or has no ``://``."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    base = pages.select(F.col(id_col), after.alias("_rest"))
    host = F.translate(F.coalesce(F.regexp_extract("_rest", "(?s)^([^/?#]*+)", 1), F.lit("")), _UPPER, _UPPER.lower())
    return base.select(id_col, host.alias("host"), F.coalesce(F.regexp_extract("_rest", "(?s)^[^/?#]*+([^?#]*+)", 1), F.lit("")).alias("path"))


def image(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file image of a rule set; of rules that repeat a (host, path) the greatest verdict holds."""
    most: dict[tuple[str, str], str] = {}
    for h, p, v in rules:
        key = (h.translate(_ASCII_LOWER), p)
        most[key] = max(v, most.get(key, v))
    keyed = sorted((xxhash.xxh64_intdigest((h + p).encode()), h + p, len(h), v) for (h, p), v in most.items())
    blobs, names = [k.encode() for _, k, _, _ in keyed], sorted(set(most.values()))
    pairs = sorted({(n, len(k) - n) for _, k, n, _ in keyed})
    verdicts = "\n".join(v.encode("unicode_escape").decode() for v in names).encode()
    body = (
        np.array([d for d, *_ in keyed], np.uint64).tobytes()
        + np.cumsum([0, *map(len, blobs)], dtype=np.uint64).tobytes()
        + np.array(pairs, np.uint64).tobytes()
        + np.array([n for *_, n, _ in keyed], np.uint32).tobytes()
        + np.array([names.index(v) for *_, v in keyed], np.uint32).tobytes()
        + verdicts
        + b"".join(blobs)
    )
    return _HEAD.pack(_MAGIC, len(keyed), len(pairs), len(verdicts)) + body


class DigestArray:
    """A memory-mapped image."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: the mapping keeps it, and nothing is left behind
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        _, n, k, v = _HEAD.unpack_from(self.map)
        at = _HEAD.size
        self.digests = np.frombuffer(self.map, np.uint64, n, at)
        self.places = np.frombuffer(self.map, np.uint64, n + 1, at := at + 8 * n)
        lengths = np.frombuffer(self.map, np.uint64, 2 * k, at := at + 8 * (n + 1)).reshape(-1, 2)
        self.pairs = [(int(h), int(p)) for h, p in lengths]
        self.hosts = np.frombuffer(self.map, np.uint32, n, at := at + 16 * k)
        self.verdict = np.frombuffer(self.map, np.uint32, n, at := at + 4 * n)
        at += 4 * n
        self.verdicts = [x.encode().decode("unicode_escape") for x in self.map[at : at + v].decode().split("\n")]
        self.text = at + v

    def string(self, i: int) -> bytes:
        return self.map[self.text + int(self.places[i]) : self.text + int(self.places[i + 1])]

    def probe(self, keys: list[str], hosts: list[int]) -> np.ndarray:
        """For each key (its first ``hosts[i]`` characters are the host) the rule's place, -1 for none."""
        raw = [k.encode() for k in keys]
        want = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        at = np.searchsorted(self.digests, want)
        out = np.full(len(raw), -1, np.int64)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, max(0, len(self.digests) - 1))] == want) if len(self.digests) else np.zeros(len(raw), bool)):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == want[i]:
                if self.hosts[j] == hosts[i] and self.string(j) == raw[i]:
                    out[i] = j
                    break
                j += 1
        return out


#: The image that this worker process has mapped, by its digest: tasks and operators that follow use it again.
_mapped: dict[int, DigestArray] = {}


def _mapped_once(data: bytes) -> DigestArray:
    key = xxhash.xxh64_intdigest(data)
    if key not in _mapped:
        _mapped.clear()
        _mapped[key] = DigestArray(data)
    return _mapped[key]


def candidates(host: str, path: str, pairs: list[tuple[int, int]]) -> Iterator[tuple[str, int]]:
    """All keys under which a rule that fits could be stored, with the host's part of each; pairs: lengths of the rules' hosts and paths."""
    n = len(host)
    for h, p in pairs:
        if 0 < h <= n and p <= len(path) and (h == n or host[n - h - 1] == "."):
            yield host[n - h :] + path[:p], h


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``."""
    spark = pages.sparkSession
    rules = list(rules)
    data = image(rules)
    if len(data) > MOST_IMAGE_BYTES:
        return judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default, id_col)
    shared = spark.sparkContext.broadcast(data)
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped_once(shared.value)
        for b in batches:
            keys, hosts, owner = [], [], []
            for i, (host, path) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for key, n in candidates(host, path, index.pairs):
                    keys.append(key)
                    hosts.append(n)
                    owner.append(i)
            found = index.probe(keys, hosts)
            best: list[tuple[int, int, int]] = [(-1, -1, -1)] * b.num_rows
            for j in np.flatnonzero(found >= 0):
                i = owner[j]
                best[i] = max(best[i], (len(keys[j]), hosts[j], int(found[j])))
            hit = [r for _, _, r in best]
            rule = pa.array([index.string(r).decode() if r >= 0 else None for r in hit], pa.string())
            verdict = pa.array([default if r < 0 else index.verdicts[index.verdict[r]] for r in hit], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[id_col, "host", "path", "rule", "verdict"])

    return _split(pages, id_col).mapInArrow(lean(run), f"{id_col} {id_type}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id") -> DataFrame:
    """The same for a rule set of any size (host, path, verdict): a join on digests, compared in full.

    The driver holds the pairs of lengths that hosts and paths of rules have, never the rules.
    """
    keyed = rules.groupBy(F.translate("host", _UPPER, _UPPER.lower()).alias("rh"), F.col("path").alias("rp")).agg(F.max("verdict").alias("v"))
    pairs = [(r[0], r[1]) for r in keyed.select(F.char_length("rh"), F.char_length("rp")).distinct().collect()]
    if not pairs:
        return _split(pages, id_col).select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    base = _split(pages, id_col).withColumn("_row", F.monotonically_increasing_id())
    n = F.char_length("host")
    lengths = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in pairs])
    fits = lambda x: (x["h"] > 0) & (x["h"] <= n) & (x["p"] <= F.char_length("path")) & ((x["h"] == n) | (F.substring("host", n - x["h"], F.lit(1)) == "."))
    cand = base.select("_row", "host", "path", F.explode(F.filter(lengths, fits)).alias("x"))
    cand = cand.select("_row", F.substring("host", n - F.col("x.h") + 1, F.col("x.h")).alias("h"), F.substring("path", F.lit(1), F.col("x.p")).alias("p"))
    on = (F.xxhash64("h", "p") == F.xxhash64("rh", "rp")) & (F.col("h") == F.col("rh")) & (F.col("p") == F.col("rp"))
    rule = F.struct((F.char_length("rh") + F.char_length("rp")).alias("n"), F.char_length("rh").alias("nh"), F.concat("rh", "rp").alias("rule"), F.col("v").alias("verdict"))
    best = cand.join(keyed, on).groupBy("_row").agg(F.max(rule).alias("best"))
    out = base.join(best, "_row", "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
