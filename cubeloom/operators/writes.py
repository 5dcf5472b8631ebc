"""Write-back: batches as frames, copy on write."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import MOST_LITERALS, Cube, cell_schema, small, within
from ..dimension import LEAF
from ..errors import Conflict, InvalidWrite
from ..local import local_frame


def last_writes(writes: DataFrame, keys: Sequence[str], value: str = "v", order: str = "ord") -> DataFrame:
    """One row per coordinate: the write with the highest ordinal.  A partial aggregate, so hot coordinates don't gather."""
    return writes.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def check_kinds(cube: Cube, writes: DataFrame) -> None:
    """All coordinates of a batch at numeric leaves, else the batch is refused as a whole."""
    marked, bad = writes, F.lit(False)
    for i, d in enumerate(cube.dimensions):
        leaves = [m.id for m in d if m.kind == LEAF]
        if len(leaves) <= MOST_LITERALS:
            fits = F.col(f"d{i}").isin(leaves)
        else:
            frame = local_frame(cube.spark, [(m, True) for m in leaves], f"d{i} int, _k{i} boolean")
            marked, fits = marked.join(small(frame, len(leaves)), f"d{i}", "left"), F.col(f"_k{i}")
        bad = bad | ~F.coalesce(fits, F.lit(False))
    if marked.where(bad).limit(1).count():
        raise InvalidWrite("a numeric cell needs numeric leaf members")


def write_cells(cube: Cube, writes: DataFrame, base: int | None = None, check: bool = True) -> Cube:
    """A new version with a batch (d0.., v, ord) applied: last write wins, zeros delete.

    ``base`` is the version the writer saw; another current version is a conflict and nothing is
    written.  Old and new rows are united and one is picked per coordinate, so the cost is one
    shuffle of both.
    """
    if base is not None and base != cube.version:
        raise Conflict(f"{cube.name} is at version {cube.version}, not {base}")
    if check:
        check_kinds(cube, writes)
    both = cube.cells.withColumn("ord", F.lit(-1).cast("bigint")).unionByName(writes.select(*cube.keys, "v", F.col("ord").cast("bigint")))
    return replace(cube, cells=last_writes(both, cube.keys).where("v <> 0"), version=cube.version + 1)


def batch(cube: Cube, cells: Iterable[tuple[Sequence[int], int]]) -> DataFrame:
    """A batch frame of listed writes in order."""
    return local_frame(cube.spark, [(*c, v, i) for i, (c, v) in enumerate(cells)], cell_schema(cube.rank, "v bigint, ord int"))


def set_leaf(cube: Cube, coordinate: Sequence[int], value: int) -> Cube:
    cube.check_write(coordinate)
    return write_cells(cube, batch(cube, [(coordinate, value)]), check=False)


def set_string(cube: Cube, coordinate: Sequence[int], text: str) -> Cube:
    """Write a string cell; an empty text deletes it."""
    cube.check_write(coordinate, text=True)
    fresh = local_frame(cube.spark, [(*coordinate, text)], cell_schema(cube.rank, "s string"))
    kept = cube.strings.join(fresh.select(cube.keys), cube.keys, "left_anti")
    return replace(cube, strings=kept.unionByName(fresh).where("s <> ''"), version=cube.version + 1)


def drop_members(cube: Cube, dimension: str, members: set[int]) -> Cube:
    """Remove all cells, strings and overrides at some members of a dimension (after a structural edit)."""
    if not members:
        return replace(cube, version=cube.version + 1)
    stay = lambda rows: within(rows, f"d{cube.position(dimension)}", members, False)
    return replace(cube, cells=stay(cube.cells).select(*cube.keys, "v"), strings=stay(cube.strings).select(*cube.keys, "s"), sandboxes={k: stay(v).select(*cube.keys, "v") for k, v in cube.sandboxes.items()}, version=cube.version + 1)


def edited(cube: Cube, dimension: str, edit: str, *args, **kw) -> Cube:
    """A structural edit of one dimension (a method name of Dimension) with its effect on cells."""
    at = cube.position(dimension)
    d = cube.dimensions[at].copy()
    gone = getattr(d, edit)(*args, **kw)
    out = replace(cube, dimensions=(*cube.dimensions[:at], d, *cube.dimensions[at + 1 :]))
    return drop_members(out, dimension, gone if isinstance(gone, set) else set())


def bulk_read(cube: Cube, names: Iterable[dict[str, str]], values: DataFrame | None = None, sandbox: str | None = None) -> DataFrame:
    """(ord, d0.., v, s, kind, editable, overlaid) for listed coordinates, in one join.

    ``values`` (d0.., v) are resolved values; stored cells by default.
    """
    rows = []
    for n, one in enumerate(names):
        at = cube.coordinate(one)
        kinds = [d.kind(m) for d, m in zip(cube.dimensions, at)]
        kind = "consolidated" if "consolidated" in kinds else "string" if "string" in kinds else "numeric"
        rows.append((n, *at, kind, kind != "consolidated"))
    asked = local_frame(cube.spark, rows, "ord int, " + cell_schema(cube.rank, "kind string, editable boolean"))
    out = asked.join((values if values is not None else cube.cells).select(*cube.keys, "v"), cube.keys, "left").join(cube.strings, cube.keys, "left")
    if sandbox is not None:
        marks = cube.sandboxes[sandbox].select(*cube.keys, F.lit(True).alias("_m"))
        out = out.join(marks, cube.keys, "left")
    mark = F.coalesce("_m", F.lit(False)) if sandbox is not None else F.lit(False)
    return out.select("ord", *cube.keys, F.coalesce("v", F.lit(0).cast("bigint")).alias("v"), "s", "kind", "editable", mark.alias("overlaid"))
