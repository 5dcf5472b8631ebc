"""Spans of regular expressions in whole texts with built-in functions only.

The parts of a text between matches and the matches themselves come as two arrays; their
lengths add up to code-point offsets.  Work is in proportion to the text and the number of
matches: a fold that grows an array copies it at every step, so such folds run over blocks of
``BLOCK`` elements, and places in a text are looked up in its pages of ``PAGE`` code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._spark import let

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
BLOCK = 256
PAGE = 4096


def scan(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array the state a fold from the left has before it; ``kind`` is the state's type."""
    none = F.array().cast(f"array<{kind}>")
    after = lambda s, x: step(s, x).cast(kind)

    def fold(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("s"), none.alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(after(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")))["out"]

    def over_blocks(parts: Column) -> Column:
        start = F.struct(zero.cast(kind).alias("s"), none.alias("out"))
        firsts = F.aggregate(parts, start, lambda acc, p: F.struct(F.aggregate(p, acc["s"], after).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")))["out"]
        return let(firsts, lambda f: F.flatten(F.transform(parts, lambda p, i: fold(p, F.get(f, i)))))

    def whole(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / F.lit(BLOCK)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))
        return F.when(F.size(xs) <= BLOCK, fold(xs, zero.cast(kind))).otherwise(let(parts, over_blocks))

    return let(items, whole)


def matches(text: Column, patterns: list[tuple[str, int]], wanted: list[Column] | None = None) -> Column:
    """For each (pattern, value group) an array<struct<start,end,hit,value,gap>> of its leftmost non-overlapping matches.

    No pattern matches an empty string.  Only ``wanted`` patterns are looked for, if given; the others find nothing.
    """
    kind = "array<struct<start:int,end:int,hit:string,value:string,gap:string>>"

    def parts(pattern: str, group: int) -> Column:
        all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
        return F.struct(F.split(text, pattern, -1).alias("gaps"), all_of(0).alias("hits"), all_of(group).alias("values"))

    def placed(f: Column) -> Column:
        lengths = F.zip_with(f["hits"], F.slice(f["gaps"], 1, F.size(f["hits"])), lambda h, g: F.char_length(h) + F.char_length(g))

        def at(before: Column, i: Column) -> Column:
            start = before + F.char_length(F.get(f["gaps"], i))
            hit = F.get(f["hits"], i)
            return F.struct(start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("hit"), F.get(f["values"], i).alias("value"), F.get(f["gaps"], i).alias("gap"))

        return F.when(f.isNull(), F.array().cast(kind)).otherwise(F.transform(scan(lengths, F.lit(0), "int", lambda s, n: s + n), at).cast(kind))

    found = [F.when((F.lit(True) if wanted is None else wanted[i]) & text.rlike(p), parts(p, g)) for i, (p, g) in enumerate(patterns)]
    return F.transform(F.array(*found), placed)


def named(found: Column, rank: int, kind: str) -> Column:
    """The spans of ``matches`` under a kind's name and rank."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans already sorted, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pages(text: Column) -> Column:
    """A text as an array of ``PAGE`` code points each; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(paged: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text given as its pages."""
    first, last = F.floor(start / F.lit(PAGE)).cast("int"), F.floor((end - 1) / F.lit(PAGE)).cast("int")
    near = F.array_join(F.slice(paged, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(near, start - first * PAGE + 1, end - start)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span (sorted by start, may overlap) replaced by ``mark``."""
    ends = scan(spans, F.lit(0), "int", lambda at, s: F.greatest(at, s["end"]))

    def rest(paged: Column) -> Column:
        def with_ends(before: Column) -> Column:
            return F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(cut(paged, F.get(before, i), s["start"]), F.lit(mark))).otherwise(F.lit("")))

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(let(ends, with_ends), ""), cut(paged, last, F.char_length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(pages(text), rest))
