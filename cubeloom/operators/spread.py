"""Write-back spreading: one entry at a consolidated coordinate to its leaves, exact to the unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, cell_schema
from ..errors import CubeError, LimitExceeded
from ..functions import fixed
from ..local import local_frame

MOST_LEAVES = 200_000
METHODS = ("equal", "proportional", "repeat", "clear")


def spread_leaves(cube: Cube, target: Sequence[int], most: int = MOST_LEAVES) -> DataFrame:
    """(d0.., ord) of the contributing leaves, the last dimension fastest.

    The ordinal is a mixed radix number of each dimension's rank, so no global sort is needed.
    Weights other than 1 are refused, and more leaves than ``most``.
    """
    slices, size = [], 1
    for d, m in zip(cube.dimensions, target):
        weights = d.leaf_weights(m)
        if any(w != 1 for w in weights.values()):
            raise CubeError(f"{d.members[m].name} has weights other than 1")
        slices.append(list(weights))
        size *= len(weights)
    if size > most:
        raise LimitExceeded(f"{size} leaves, at most {most}")
    if not size:
        return local_frame(cube.spark, [], cell_schema(cube.rank, "ord bigint"))
    out = None
    for i, leaves in enumerate(slices):
        one = local_frame(cube.spark, [(m, n) for n, m in enumerate(leaves)], f"d{i} int, o{i} bigint")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    order = F.lit(0).cast("bigint")
    for i, leaves in enumerate(slices):
        order = order * len(leaves) + F.col(f"o{i}")
    return out.select(*cube.keys, order.alias("ord"))


def spread(cube: Cube, target: Sequence[int], value: int, method: str, basis: DataFrame | None = None) -> DataFrame:
    """A batch (d0.., v, ord) that spreads a scaled value; ``basis`` (d0.., v) weighs the proportional method (stored cells by default)."""
    if method not in METHODS:
        raise CubeError(f"no spread method {method}")
    leaves = spread_leaves(cube, target)
    if method in ("repeat", "clear"):
        return leaves.select(*cube.keys, F.lit(value if method == "repeat" else 0).cast("bigint").alias("v"), "ord")
    if method == "proportional":
        weighed = leaves.join((basis if basis is not None else cube.cells).select(*cube.keys, F.col("v").alias("w")), cube.keys, "left")
        weighed = weighed.withColumn("w", F.coalesce("w", F.lit(0).cast("bigint")))
        whole = weighed.agg(F.sum(F.col("w").cast(fixed.WIDE)).alias("t"), F.count(F.lit(1)).alias("n")).first()
        if whole["t"]:
            num = F.lit(value).cast("decimal(19,0)") * F.col("w").cast("decimal(19,0)")
            share = F.call_function("div", num.cast(fixed.WIDE), F.lit(whole["t"]).cast(fixed.WIDE)).cast("bigint")
            given = weighed.withColumn("v", share)
            rest = value - int(given.agg(F.sum(F.col("v").cast(fixed.WIDE))).first()[0])
            return _remainder(given, rest, whole["n"]).select(*cube.keys, "v", "ord")
        leaves = weighed.drop("w")
    n = leaves.count()
    base = int(abs(value) // n) * (-1 if value < 0 else 1) if n else 0
    return _remainder(leaves.withColumn("v", F.lit(base).cast("bigint")), value - base * n, n).select(*cube.keys, "v", "ord")


def _remainder(given: DataFrame, rest: int, n: int) -> DataFrame:
    """One unit more (or less) for the leading leaves, around again if more units than leaves are left."""
    sign, left = (-1 if rest < 0 else 1), abs(rest)
    each, extra = divmod(left, n) if n else (0, 0)
    return given.withColumn("v", F.col("v") + sign * each + F.when(F.col("ord") < extra, sign).otherwise(0))

