"""Mixing sources to target weights by pivotal dependent rounding (built-in functions only).

A source's target is its weight's share of all words, at most ``MOST_COPIES`` times its
own words, the excess reshared by weight.  Every document of the source is due the same
real number of copies, target / source words; the whole part is certain, the fraction is
rounded by pivots: two documents with fractional parts are paired and one takes from the
other, by a random draw that keeps each one's expectation and the pair's expected words
fixed to the last, until one is integral.  The one left over meets the next, long documents
first, so that what is left in the end is mostly short.  Pairs are
folded within small buckets first; the buckets' leftovers fall into fewer buckets, level by
level, until one is left per source and is rounded by itself.

Rows equal in source, id and text are one item due as many times the copies, which its rows
share as evenly as they can, so that no number of them, nor of null ids, makes a bucket large.
Draws hash (seed, level, item): reruns agree whatever the partitioning.  Null text has
size 0; null sources are one source, the last; rows that repeat an id with another text are
documents of their own; documents of size 0 take part but count no words.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch, checked, packed, tasks, text_or_empty, unpacked, words_of

MOST_COPIES = 3
SEED = 17
#: Documents in a bucket of one level, about, and equal rows handled at once.
BUCKET = 64
ROWS = 4096
_EPS = 1e-9


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """``rows`` with, for each new name, the sum of a column over all rows before in an order.

    Rows are dealt out by ranges; sums run within a range, and ranges are added up by their totals, one row for each.
    """
    spark = rows.sparkSession
    placed = scratch.write(rows.repartitionByRange(tasks(spark), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("_range").orderBy(*order))
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_o_{k}") for k, c in sums.items()])
    first = totals.select("_range", *[F.coalesce(F.sum(f"_o_{k}").over(before(Window.orderBy("_range"))), F.lit(0)).alias(f"_o_{k}") for k in sums])
    out = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{k}") for k, c in sums.items()]).join(F.broadcast(first), "_range")
    return out.select(*rows.columns, *[(F.col(f"_i_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, n, source_size, target) of rows (source, size).

    Capped sources are those with the smallest room per weight: with sources in that order, the
    first k are capped if k is the least number after which the common rate fits all others.
    """
    scratch = Scratch(sized.sparkSession, "targets")
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    per = _running(per.withColumn("one", F.lit(1)), [by_name], {"at": "one"}, scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights)).cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(most)).withColumn("per_weight", F.col("room") / F.col("weight"))
    per = scratch.write(_running(per, [F.col("per_weight").asc(), by_name], {"room_before": "room", "weight_before": "weight"}, scratch), "rooms")
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rate = (F.lit(whole["size"] or 0) - F.col("room_before")) / (F.lit(whole["weight"] or 0) - F.col("weight_before"))
    free = per.withColumn("rate", rate).where("per_weight >= rate").agg(F.min(F.struct("per_weight", "rate")).alias("x")).select("x.rate").first()
    target = F.least(F.col("room").cast("double"), F.col("weight") * F.lit(float(free["rate"] or 0.0) if free else 0.0))
    return per.select("source", "n", "source_size", target.alias("target"))


def _draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _fold(items: Column, level: int, seed: int) -> Column:
    """Pivots through a bucket: struct(left: the last fractional one or null, done: those settled with up = 0 or 1)."""
    item = "struct<row:bigint,ord:bigint,size:bigint,p:double>"
    settled = "array<struct<row:bigint,up:int>>"
    one = lambda x, up: F.array(F.struct(x["row"].alias("row"), up.cast("int").alias("up"))).cast(settled)
    with_p = lambda x, p: F.struct(x["row"].alias("row"), x["ord"].alias("ord"), x["size"].alias("size"), p.alias("p")).cast(item)

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]
        # Mass moves in words: a gives x of its probability, b gains x * size_a / size_b.
        sa, sb = F.greatest(a["size"], F.lit(1)).cast("double"), F.greatest(b["size"], F.lit(1)).cast("double")
        to_b = F.least(a["p"] * sa, (1 - b["p"]) * sb)
        to_a = F.least((1 - a["p"]) * sa, b["p"] * sb)
        gives = _draw(F.lit(seed), F.lit(level), a["ord"], b["ord"]) * (to_a + to_b) < to_a
        pa = F.when(gives, a["p"] - to_b / sa).otherwise(a["p"] + to_a / sa)
        pb = F.when(gives, b["p"] + to_b / sb).otherwise(b["p"] - to_a / sb)
        whole = lambda p: (p < _EPS) | (p > 1 - _EPS)
        done = F.concat(acc["done"], F.when(whole(pa), one(a, F.round(pa))).otherwise(F.array().cast(settled)), F.when(whole(pb), one(b, F.round(pb))).otherwise(F.array().cast(settled)))
        left = F.when(~whole(pa), with_p(a, pa)).when(~whole(pb), with_p(b, pb))
        return F.when(a.isNull(), F.struct(b.cast(item).alias("left"), acc["done"].alias("done"))).otherwise(F.struct(left.cast(item).alias("left"), done.alias("done")))

    first = F.struct(F.lit(None).cast(item).alias("left"), F.array().cast(settled).alias("done"))
    return F.aggregate(items, first, step)


def _items(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, scratch: Scratch) -> DataFrame:
    """(doc_id, th, size, source_size, target, rows, copies): the rows equal in source, id and text (its digest th), and the copies they take together."""
    size = F.size(words_of(text_or_empty())).cast("long")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text_or_empty()).alias("th"))
    items = sized.groupBy("source", "doc_id", "th", "size").agg(F.count(F.lit(1)).alias("rows"))
    items = scratch.write(items.withColumn("row", F.monotonically_increasing_id()), "items")
    plan = scratch.write(targets(items.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most), "targets")
    due = items.join(plan, items["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    whole = F.floor(ratio * F.col("rows") + _EPS)
    due = scratch.write(due.withColumn("base", whole).withColumn("p", F.greatest(ratio * F.col("rows") - whole, F.lit(0.0))), "due")
    # The order of items within a source: by hash of what tells them apart, so that reruns agree.
    live = due.where(F.col("p") > _EPS).select("source", F.struct(F.col("row"), F.xxhash64(F.lit(seed), "doc_id", "size", "th").alias("ord"), "size", "p").alias("item"), "n")
    settled, level = [], 0
    largest = plan.agg(F.max("n")).first()[0] or 0
    while True:
        buckets = F.ceil(F.col("n") / F.lit(BUCKET)).cast("int")
        live = live.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "item.ord"), F.greatest(buckets, F.lit(1))))
        by_order = F.array_sort(F.collect_list(F.struct((-F.col("item.size")).alias("s"), F.col("item.ord").alias("o"), "item")))
        folded = live.groupBy("source", "bucket").agg(by_order.alias("items"), F.first("n").alias("n"))
        folded = folded.select("source", F.ceil(F.col("n") / F.lit(BUCKET)).alias("n"), _fold(F.transform("items", lambda x: x["item"]), level, seed).alias("f"))
        folded = scratch.write(folded, f"level{level}")
        settled.append(folded.select(F.explode("f.done").alias("d")).select("d.row", "d.up"))
        live = folded.where("f.left is not null").select("source", F.col("f.left").alias("item"), "n")
        if largest <= BUCKET:
            break
        largest, level = -(-largest // BUCKET), level + 1
    settled.append(live.select("item.row", (_draw(F.lit(seed), F.lit(-1), "item.ord") < F.col("item.p")).cast("int").alias("up")))
    ups = settled[0]
    for s in settled[1:]:
        ups = ups.union(s)
    out = due.join(ups, "row", "left")
    return out.select("row", "doc_id", "th", "size", "source_size", "target", "rows", (F.col("base") + F.coalesce("up", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, th (the text's digest), size, source_size, target and copies of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    items = _items(docs, weights, most, seed, scratch)
    names = ("doc_id", "th", "size", "source_size", "target")
    one = items.where("rows = 1").select(*names, F.col("copies").cast("int").alias("copies"))
    # Rows that are equal are listed from their number, in blocks, so that many of them don't come from one task.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / F.lit(ROWS))))
    many = items.where("rows > 1").withColumn("block", first).repartition(tasks(docs.sparkSession), "row", "block")
    many = many.withColumn("i", F.explode(F.sequence(F.col("block") * ROWS + 1, F.least("rows", (F.col("block") + 1) * ROWS))))
    each = F.floor(F.col("copies") / F.col("rows")) + (F.col("i") <= F.col("copies") % F.col("rows")).cast("int")
    return one.union(many.select(*names, each.cast("int").alias("copies")))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mixed")
    taken = _items(docs, weights, most, seed, scratch).groupBy("doc_id", "th").agg(F.sum("copies").alias("_c"), F.sum("rows").alias("_m"))
    taken = scratch.write(taken, "taken")
    side = checked(taken.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "_c", "_m"), 48 * taken.count())
    rows = packed(docs, "doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(text_or_empty()) == F.col("_t")))
    both = rows.where("_m = 1").select("_row", F.col("_c").alias("_n"))
    if taken.where("_m > 1").limit(1).count():
        # Rows equal in id and text share their copies by rank; a large group is ranked in blocks.
        equal = rows.where("_m > 1").withColumn("_b", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_m") / ROWS)))
        equal = scratch.write(equal.select("_row", "_d", "_t", "_b", "_c", "_m"), "equal")
        before = F.sum("n").over(Window.partitionBy("d", "t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        per = equal.groupBy(F.col("_d").alias("d"), F.col("_t").alias("t"), F.col("_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        per = per.select("d", "t", "b", F.coalesce(before, F.lit(0)).alias("before"))
        rank = F.row_number().over(Window.partitionBy("_d", "_t", "_b").orderBy(F.lit(0)))
        ranked = equal.withColumn("_r", rank).join(per, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t")) & (F.col("_b") == F.col("b")))
        shared = F.floor(F.col("_c") / F.col("_m")) + (F.col("before") + F.col("_r") <= F.col("_c") % F.col("_m")).cast("int")
        both = both.union(ranked.select("_row", shared.alias("_n")))
    both = both.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return both.select(unpacked(docs))
