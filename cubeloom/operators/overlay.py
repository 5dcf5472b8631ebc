"""What-if overlays: sparse leaf overrides over a base, zero included."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, cell_schema
from ..errors import UnknownName
from ..local import local_frame
from .writes import last_writes, write_cells


def create(cube: Cube, name: str) -> Cube:
    return cube if name in cube.sandboxes else replace(cube, sandboxes={**cube.sandboxes, name: local_frame(cube.spark, [], cell_schema(cube.rank))})


def overrides(cube: Cube, name: str) -> DataFrame:
    if name not in cube.sandboxes:
        raise UnknownName(f"{cube.name} has no sandbox {name}")
    return cube.sandboxes[name]


def overlaid(cube: Cube, name: str | None) -> DataFrame:
    """Base cells with a sandbox's overrides on top: an override wins, and one of zero hides the base.  A union and one grouped pick, no join."""
    if name is None:
        return cube.cells
    both = cube.cells.withColumn("_o", F.lit(0)).unionByName(overrides(cube, name).withColumn("_o", F.lit(1)))
    return both.groupBy(*cube.keys).agg(F.max_by("v", "_o").alias("v")).where("v <> 0")


def write(cube: Cube, name: str, cells: Iterable[tuple[Sequence[int], int]]) -> Cube:
    """Record overrides as given; strings are refused."""
    cells = [(tuple(c), v) for c, v in cells]
    for c, _ in cells:
        cube.check_write(c)
    fresh = local_frame(cube.spark, [(*c, v, i) for i, (c, v) in enumerate(cells)], cell_schema(cube.rank, "v bigint, ord int"))
    kept = overrides(create(cube, name), name).withColumn("ord", F.lit(-1))
    return replace(cube, sandboxes={**create(cube, name).sandboxes, name: last_writes(kept.unionByName(fresh), cube.keys)})


def flags(cube: Cube, name: str, coordinates: DataFrame) -> DataFrame:
    """Coordinates with ``overlaid``: whether the exact leaf has an override."""
    marks = overrides(cube, name).select(*cube.keys, F.lit(True).alias("_m"))
    return coordinates.join(marks, cube.keys, "left").withColumn("overlaid", F.coalesce("_m", F.lit(False))).drop("_m")


def commit(cube: Cube, name: str) -> Cube:
    """Merge the overrides into the base and empty the sandbox."""
    out = write_cells(cube, overrides(cube, name).withColumn("ord", F.lit(0)))
    return replace(out, sandboxes={**cube.sandboxes, name: local_frame(cube.spark, [], cell_schema(cube.rank))})


def discard(cube: Cube, name: str) -> Cube:
    overrides(cube, name)
    return replace(cube, sandboxes={k: v for k, v in cube.sandboxes.items() if k != name})
