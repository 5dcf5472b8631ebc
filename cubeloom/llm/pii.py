"""Personal data by bootstrapped contextual extraction (built-in functions only).

Base entities (email, ip, card, phone) are found by expressions and checked (address parts,
Luhn digits, digit counts).  They seed the bootstrap:

1. Every identifier-like word (one with digits or ``@``) is an instance; the two words before
   it, over any white space, are its pattern, and where its line begins within them, the line's
   start and the words on either side of it are another.  Identifiers count as one mark, as does
   the start of the text.  Instances that meet base spans are seeds, known by the whole span (or
   run of overlapping ones); its later words are no instances of their own.
2. On the bipartite graph of patterns and instances, weighted by how often they occur
   together, patterns are scored by the mean score of what they precede, and instances by
   the noisy-or of their patterns; seeds keep score 1.  ``ROUNDS`` rounds are run.
3. A pattern is trusted if its score is at least ``LEAST_SCORE`` and it precedes at least
   ``LEAST_SEEDS`` different seeds.  What trusted patterns precede counts as seeds from then
   on, with its score as the least, and 2 and 3 are run again until no further pattern is
   trusted.  Unseen instances right after a trusted pattern become
   spans of kind ``learned``; base spans stay as they are.

Null text counts as empty.  Null and repeated ids are kept, one result per row.  An empty
table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spans
from ._spark import Scratch, let, text_or_empty

_LOCAL = "[A-Za-z0-9._%+-]"
#: Equal to the plain expressions, but possessive and tried only where a match can begin, so that long runs cost no more than their length.
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
ROUNDS = 3
LEAST_SCORE = 0.6
LEAST_SEEDS = 5
#: Added to a pattern's occurrences, so that few of them don't make a high score.
SMOOTHING = 2.0
LEAST_DIGITS = 4
INSTANCE = "(?:(?<![^\\x20\\x09-\\x0D])|\\G)[^\\x20\\x09-\\x0D0-9@]*+[0-9@][^\\x20\\x09-\\x0D]*+"
#: Words of patterns that stand for an identifier and for the start of a line or text.
ID, START = "\x01", "\x02"
_ENTRY = "array<struct<start:int,end:int,pattern:string,instance:string,seed:boolean>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":

        def too_large(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+(?=.)", "")
            return F.when(F.char_length(bare) > 3, F.lit(True)).otherwise(bare.cast("int") > 255)

        return ~F.exists(F.split(hit, "\\."), too_large)
    n = F.char_length(_digits(hit))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All checked base spans of a text by start, then kind."""

    def checked_of(found: Column) -> Column:
        one = lambda rank, kind: _spans.named(F.filter(F.get(found, rank), lambda m: _valid(kind, m["hit"])), rank, kind)
        return F.array_sort(F.concat(*[one(rank, kind) for rank, kind in enumerate(KINDS)]))

    return let(_spans.matches(text, [(PATTERNS[k], 0) for k in KINDS]), checked_of)


def _with_spans(found: Column, base: Column) -> Column:
    """Words (by start) with the run of overlapping base spans [lo, hi) that begins last before each one's end, found in one walk over both."""
    event = lambda at, kind, end: F.struct(at.alias("at"), F.lit(kind).alias("kind"), end.alias("end"))
    begins = F.transform(base, lambda b: event(b["start"], 1, b["end"]))
    events = F.array_sort(F.concat(begins, F.transform(found, lambda m: event(m["end"], 0, m["end"]))))

    def walk(s: Column, e: Column) -> Column:
        joins = e["at"] < s["hi"]
        lo, hi = F.when(joins, s["lo"]).otherwise(e["at"]), F.when(joins, F.greatest(s["hi"], e["end"])).otherwise(e["end"])
        return F.when(e["kind"] == 0, s).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))

    def joined(ev: Column) -> Column:
        states = _spans.scan(ev, F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi")), "struct<lo:int,hi:int>", walk)
        return F.array_compact(F.zip_with(ev, states, lambda e, s: F.when(e["kind"] == 0, s)))

    return F.zip_with(found, let(events, joined), lambda m, s: F.struct(*[m[c].alias(c) for c in ("at", "start", "end", "hit", "words", "lines")], s["lo"].alias("lo"), s["hi"].alias("hi")))


def entries(text: Column, base: Column) -> Column:
    """The text's instances, once for each of their patterns."""

    def last_two(words: Column) -> Column:
        return F.substring_index(F.btrim(F.regexp_replace(words, "[\\x20\\x09-\\x0D]+", " ")), " ", -2)

    def shaped(m: Column) -> Column:
        lines = F.regexp_replace(m["gap"], "[\\n\\r][\\x20\\x09-\\x0D]*+", f" {START} ")
        bare = F.regexp_extract(m["hit"], "^([(\\[{\"'<]*)(.*?)[.,;:!?)\\]}\"'>]*$", 2)
        start = m["start"] + F.char_length(F.regexp_extract(m["hit"], "^([(\\[{\"'<]*)", 1))
        end = start + F.char_length(bare)
        return F.struct(m["start"].alias("at"), start.alias("start"), end.alias("end"), bare.alias("hit"), last_two(m["gap"]).alias("words"), last_two(lines).alias("lines"))

    def all_of(found: Column, paged: Column) -> Column:
        def entry(m: Column, i: Column) -> Column:
            before, first = F.get(found, i - 1), F.when(i < 2, START).otherwise(ID)

            def pattern(kind: str) -> Column:
                ahead = F.when(i == 0, F.lit(START)).otherwise(F.concat_ws(" ", first, before[kind], F.lit(ID)))
                return F.lower(last_two(F.concat_ws(" ", ahead, m[kind])))

            seed = m["hi"] > m["start"]
            instance = F.when(seed, _spans.cut(paged, m["lo"], m["hi"])).otherwise(m["hit"])
            patterns = F.array_distinct(F.array(pattern("words"), pattern("lines")))
            return F.transform(patterns, lambda p: F.struct(m["start"].alias("start"), m["end"].alias("end"), p.alias("pattern"), instance.alias("instance"), seed.alias("seed")))

        return F.flatten(F.transform(found, entry))

    found = F.transform(_spans.matches(text, [(INSTANCE, 0)])[0], shaped)
    # A word that begins within a span that began before it is a later part of that span.
    kept = F.filter(let(found, lambda f: _with_spans(f, base)), lambda m: (m["lo"] >= m["at"]) | (m["hi"] <= m["at"]))
    paged = _spans.pages(F.when(F.size(base) > 0, text).otherwise(F.lit("")))
    held = lambda e: e["seed"] | (F.char_length(F.regexp_replace(e["instance"], "[^0-9]", "")) >= LEAST_DIGITS) | e["instance"].contains("@")
    both = let(F.struct(kept.alias("kept"), paged.alias("paged")), lambda x: all_of(x["kept"], x["paged"]))
    return F.filter(both, held).cast(_ENTRY)


def trusted_patterns(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, score) of trusted patterns of a graph (pattern, instance, n, seed)."""
    graph = scratch.write(graph, "graph")
    base = graph.where("seed").groupBy("instance").agg(F.lit(1.0).alias("known"))
    known, trusted, n_trusted = base, None, 0
    noisy_or = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))
    while True:
        held = scratch.write(graph.join(known, "instance", "left").withColumn("known", F.coalesce("known", F.lit(0.0))), "held")
        scored = held.withColumn("score", F.col("known"))
        for _ in range(ROUNDS):
            patterns = scored.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + SMOOTHING)).alias("p"), F.count_if(F.col("known") >= LEAST_SCORE).alias("support"))
            patterns = scratch.write(patterns.where((F.col("support") >= LEAST_SEEDS) & (F.col("p") > 0.05)), "patterns")
            scores = held.join(patterns, "pattern").groupBy("instance").agg(noisy_or.alias("found"))
            scored = held.join(scores, "instance", "left").withColumn("score", F.greatest("known", F.coalesce("found", F.lit(0.0))))
        found = patterns.where(F.col("p") >= LEAST_SCORE).select("pattern", "p")
        found = found if trusted is None else trusted.unionByName(found).groupBy("pattern").agg(F.max("p").alias("p"))
        trusted = scratch.write(found, "trusted")
        n = trusted.count()
        if n == n_trusted:
            return trusted.select("pattern", F.col("p").alias("score"))
        n_trusted = n
        learned = graph.join(trusted, "pattern").groupBy("instance").agg(noisy_or.alias("known"))
        known = base.unionByName(learned).groupBy("instance").agg(F.max("known").alias("known"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, learned) of every row of ``docs``: spans by start, then kind."""
    scratch = Scratch(docs.sparkSession, "pii")
    read = docs.select("doc_id", text_or_empty().alias("text")).withColumn("base", base_spans(F.col("text")))
    read = read.withColumn("entries", entries(F.col("text"), F.col("base"))).select("doc_id", "base", "entries", F.monotonically_increasing_id().alias("row"))
    read = scratch.write(read, "read")
    each = read.where(F.size("entries") > 0).select("row", F.explode("entries").alias("e")).select("row", "e.*")
    graph = each.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    trusted = trusted_patterns(graph, scratch)
    fresh = each.where("not seed").join(trusted, "pattern").groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("learned").alias("kind"))).alias("learned"))
    out = read.join(fresh, "row", "left")
    return out.select("doc_id", "base", F.coalesce(F.col("learned").cast(_spans.SPAN), F.array().cast(_spans.SPAN)).alias("learned"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    found = find_personal_data(docs).withColumn("all", F.array_sort(F.concat("base", "learned")))
    return found.select(
        "doc_id",
        *[_spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_spans.joined(F.col("base")), 256).alias("base_sha256"),
        _spans.joined(F.col("all")).alias("spans"),
    )
