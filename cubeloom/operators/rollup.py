"""Weighted consolidation: facts joined to the closures of the requested members, one grouped sum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube, closure_frame, edge_frame, member_frame, small
from ..dimension import LEAF, Dimension
from ..functions import fixed
from ..local import local_frame, written

#: What can go wrong in a cell, in the order in which it is told.
ERRORS = ("cycle", "division by zero", "overflow")
#: Rows per fact that closures may add before sums are taken in between.
MOST_FANOUT = 8
#: Closures of dimensions with more members are found by Spark instead of the driver.
DRIVER_MEMBERS = 1_000_000


def consolidate(leaves: DataFrame, dimensions: Sequence[Dimension], region: Sequence[Sequence[int]]) -> DataFrame:
    """(d0.., v, err) of every requested coordinate with contributions.

    ``leaves`` holds (d0.., v[, err]) at leaf coordinates.  Each dimension's requested members
    become a closure (ancestor, leaf, weight), a small frame that is broadcast; the fact scan is
    cut down to contributing leaves by these joins.  Dimensions that shrink the facts come
    first.  Where all closures together would multiply the facts, sums are taken between the
    joins, which is exact: weights multiply across dimensions.
    """
    spark = leaves.sparkSession
    keys = [f"d{i}" for i in range(len(dimensions))]
    has_err = "err" in leaves.columns
    # Errors travel as numbers: sums of numbers hash, a least text would be sorted for.
    code = F.array_position(F.array(*map(F.lit, ERRORS)), F.coalesce("err", F.lit(""))).cast("int") if has_err else None
    now = leaves.select(*keys, F.col("v").cast(fixed.WIDE).alias("v"), *([F.when(code > 0, code).alias("err")] if has_err else []))
    closures = []
    for i, (d, members) in enumerate(zip(dimensions, region)):
        frame, n = _closure(spark, d, members)
        closures.append((n / max(1, len(d.leaves())), i, frame, n))
    closures.sort(key=lambda c: c[0])
    fanout = 1.0
    for step, (ratio, i, frame, n) in enumerate(closures):
        side = frame.select(F.col("ancestor").alias("_a"), F.col("leaf").alias("_l"), F.col("weight").alias("_w"))
        now = now.join(small(side, n), F.col(f"d{i}") == F.col("_l")).withColumn("v", (F.col("v") * F.col("_w")).cast(fixed.WIDE))
        now = now.withColumn(f"d{i}", F.col("_a")).drop("_a", "_l", "_w")
        fanout *= max(1.0, ratio)
        if fanout > MOST_FANOUT and step < len(closures) - 1:
            now, fanout = _summed(now, keys, has_err), 1.0
    out = _summed(now, keys, has_err)
    told = F.get(F.array(*map(F.lit, ERRORS)), F.col("err") - 1) if has_err else None
    err = F.coalesce(told, F.when(~fixed.fits(F.col("v")), F.lit("overflow"))) if has_err else F.when(~fixed.fits(F.col("v")), F.lit("overflow"))
    return out.select(*keys, fixed.narrowed(F.col("v")).alias("v"), err.alias("err"))


def _closure(spark: SparkSession, d: Dimension, members: Sequence[int]) -> tuple[DataFrame, int]:
    """(ancestor, leaf, weight) of the requested members, and its row count; found by Spark for large dimensions."""
    if len(d) <= DRIVER_MEMBERS:
        return closure_frame(spark, d, members)
    known = member_frame(spark, d)
    asked = local_frame(spark, [(m,) for m in members], "id int")
    out = written(large_closure(spark, edge_frame(spark, d), known.where(F.col("kind") == LEAF).select("id"), asked), "closure")
    return out, out.count()


def _summed(rows: DataFrame, keys: list[str], has_err: bool) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("v").cast(fixed.WIDE).alias("v"), *([F.min("err").alias("err")] if has_err else []))


def get(cube: Cube, coordinate: Sequence[int]) -> int:
    """One consolidated value."""
    rows = consolidate(cube.cells, cube.dimensions, [[m] for m in coordinate]).collect()
    if not rows:
        return 0
    if rows[0]["err"]:
        raise OverflowError(rows[0]["err"])
    return rows[0]["v"]


def consolidate_fed(cube: Cube, fed: DataFrame, values: DataFrame, region: Sequence[Sequence[int]]) -> DataFrame:
    """The sum over stored and fed coordinates, each once, with values from a resolver frame (d0.., v)."""
    support = cube.cells.select(cube.keys).union(fed.select(cube.keys)).distinct()
    return consolidate(support.join(values, cube.keys), cube.dimensions, region)


def large_closure(spark, edges: DataFrame, leaves: DataFrame, ancestors: DataFrame, checkpoint=written) -> DataFrame:
    """(ancestor, leaf, weight) for dimensions too large for the driver: breadth first by levels.

    edges (parent, child, weight, edge_ord), leaves (id), ancestors (id).  A node reached twice on
    a level keeps the path first in order of arrival, as the driver's search does.  ``checkpoint``
    writes a frame and reads it back; it cuts the lineage once a level.
    """
    front = ancestors.select(F.col("id").alias("ancestor"), F.col("id").alias("node"), F.lit(1).cast("bigint").alias("weight"), F.array().cast("array<int>").alias("path"))
    seen = checkpoint(front)
    front = seen
    while front.limit(1).count():
        low, high = F.lit(str(fixed.LOWEST)).cast(fixed.WIDE), F.lit(str(fixed.HIGHEST)).cast(fixed.WIDE)
        wide = F.col("f.weight").cast("decimal(19,0)") * F.col("e.weight").cast("decimal(19,0)")
        step = front.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.parent"))
        step = step.select("f.ancestor", F.col("e.child").alias("node"), F.least(F.greatest(wide.cast(fixed.WIDE), low), high).cast("bigint").alias("weight"), F.concat("f.path", F.array("e.edge_ord")).alias("path"))
        step = step.groupBy("ancestor", "node").agg(F.min_by("weight", "path").alias("weight"), F.min("path").alias("path"))
        front = checkpoint(step.join(seen.select("ancestor", "node"), ["ancestor", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen.join(leaves.select(F.col("id").alias("node")), "node").where("weight <> 0").select("ancestor", F.col("node").alias("leaf"), "weight")
