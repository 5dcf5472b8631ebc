"""Secret scans by a trigram inverted index (built-in functions only).

Each rule's regular expression yields a Boolean trigram query (``trigrams.query``).  The
index holds, for blocks of documents, the posting list of every trigram that some query
names; queries are answered by intersecting and uniting posting lists block by block; only
the candidates are verified with the expression itself.  Rules whose expression has no
mandatory trigram (hex runs) scan every text.

Null text counts as empty: no spans.  Null or repeated ids are kept, one result per row.
An empty table gives an empty result.  Other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spans, trigrams
from ._spark import Scratch, checked, let, packed, text_or_empty, unpacked


@dataclass(frozen=True)
class Rule:
    """A secret's kind, its expression (group ``value`` is measured, 0: the whole match) and least length."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    #: For the scan itself, where an equal but tighter expression exists (a maximal run's least length).
    scan: str | None = None
    #: The Boolean query is derived from this when the pattern spells letter cases out.
    plain: str | None = None


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = ("password", "passwd", "secret", "token", "api_?key")
_AFTER_KEY = "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The base kinds, in the order in which their spans are listed.
BASE = (
    Rule("assign", f"({'|'.join(map(_either_case, _KEYS))}){_AFTER_KEY}", value=2, least=6, plain=f"({'|'.join(_KEYS)}){_AFTER_KEY}"),
    Rule("access", "AKIA[A-Z0-9]+", least=20, scan="AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]+", least=24, scan="[0-9a-f]{24,}"),
)
#: Further kinds: public token formats with a fixed lead.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE
#: Documents in a block of posting lists, about.
BLOCK = 4096


def _key() -> Column:
    """The number a row has in posting lists.  Two rows may share one: that only adds candidates."""
    return F.xxhash64(F.col("doc_id"), text_or_empty())


def posting_lists(docs: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """The inverted index: (block, gram, posting: sorted distinct keys)."""
    low = docs.select(_key().alias("key"), F.lower(text_or_empty()).alias("low"))
    # The text is looked through once per gram within one generated loop; only hits become rows with their gram's name.
    hits = low.select("key", F.posexplode(F.array(*[F.contains("low", F.lit(g)) for g in grams])).alias("at", "hit")).where("hit")
    found = hits.select("key", F.element_at(F.array(*map(F.lit, grams)), F.col("at") + 1).alias("gram"))
    found = found.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    return found.groupBy("block", "gram").agg(F.array_sort(F.collect_set("key")).alias("posting"))


def _answer(q, lists: Column) -> Column:
    """Keys in all posting lists of some way to satisfy the query."""
    none = F.array().cast("array<bigint>")
    each = F.array(*[F.array(*map(F.lit, w)) for w in trigrams.ways(q)])

    def all_of(way: Column) -> Column:
        of = lambda gram: F.coalesce(F.element_at(lists, gram), none)
        return F.aggregate(F.slice(way, 2, F.size(way)), of(way[0]), lambda keys, gram: F.array_intersect(keys, of(gram)))

    return F.array_distinct(F.flatten(F.transform(each, all_of)))


def candidates(docs: DataFrame, rules: dict[str, object], blocks: int) -> DataFrame:
    """(key, kinds): the rules of each document whose trigram query it satisfies."""
    grams = list(dict.fromkeys(t for q in rules.values() for t in trigrams.trigrams(q)))
    lists = posting_lists(docs, grams, blocks).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "posting"))).alias("lists"))
    hits = lists.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _answer(q, F.col("lists")).alias("keys")) for k, q in rules.items()])).alias("hit"))
    return hits.select("hit.kind", F.explode("hit.keys").alias("key")).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block: int = BLOCK) -> DataFrame:
    """``docs`` with a column ``secrets``: array<struct<start,rank,end,kind>> sorted by start, then rule order.

    Offsets are code points, end exclusive.  Matches are leftmost and non-overlapping per rule;
    those shorter than the rule's least length are dropped without a retry.
    """
    spark = docs.sparkSession
    queries = {r.kind: trigrams.query(r.plain or r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    marked = packed(docs, "doc_id", "text").withColumn("_key", _key()).withColumn("_text", text_or_empty())
    if indexed:
        scratch = Scratch(spark, "secrets")
        found = scratch.write(candidates(docs, indexed, max(1, -(-docs.count() // block))), "candidates")
        found = found.select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds"))
        marked = marked.join(checked(found, 64 * found.count()), "_key", "left")

    wanted = [F.coalesce(F.array_contains(F.col("_kinds"), r.kind), F.lit(False)) if r.kind in indexed else F.lit(True) for r in rules]

    def verified(found: Column) -> Column:
        long_enough = lambda rank, r: F.filter(F.get(found, rank), lambda m: F.char_length(m["value"]) >= r.least)
        return F.array_sort(F.concat(*[_spans.named(long_enough(rank, r), rank, r.kind) for rank, r in enumerate(rules)]))

    spans = let(_spans.matches(F.col("_text"), [(r.scan or r.pattern, r.value) for r in rules], wanted), verified)
    others = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() != "secrets"])
    return marked.select(*unpacked(others), spans.alias("secrets"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[_spans.count_of(F.col("secrets"), r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_spans.joined(base), 256).alias("base_sha256"),
        _spans.joined(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; n_chars, where there is one, follows the text.

    Null texts stay null; texts without secrets stay as they are.
    """
    found = find_secrets(packed(docs, "doc_id", "text"))
    dirty = F.size("secrets") > 0
    text = F.when(dirty, _spans.redacted(F.col("text"), F.col("secrets"), mark)).otherwise(F.col("text"))
    out = found.select("_row", "text", "secrets", text.alias("_clean"))
    n_chars = F.when(dirty, F.char_length("_clean").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else F.lit(None)
    return out.select(unpacked(docs, text=F.col("_clean"), n_chars=n_chars))
