"""Views: members on two axes and in context, planned as one region, shown as a dense grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, small
from ..errors import CellError, CubeError, Denied
from ..functions import fixed
from ..local import local_frame
from ..mdx import language as mdx
from ..mdx import sets
from ..operators.masks import Mask
from .regions import Evaluator


@dataclass(frozen=True)
class Axis:
    """One dimension's members on an axis, by name or alias; later axes of a side vary fastest."""

    dimension: str
    members: tuple[str, ...]


@dataclass(frozen=True)
class View:
    rows: tuple[Axis, ...] = ()
    columns: tuple[Axis, ...] = ()
    context: tuple[tuple[str, str], ...] = ()
    suppress_rows: bool = False
    suppress_columns: bool = False


@dataclass
class Cellset:
    """``rows`` and ``columns`` are the visible tuples of names; ``cells`` is a frame (r, c, v) of every visible cell."""

    rows: list[tuple[str, ...]]
    columns: list[tuple[str, ...]]
    cells: DataFrame
    suppressed_rows: int = 0
    suppressed_columns: int = 0

    def values(self) -> list[list[int]]:
        """The grid, row by row."""
        out = [[0] * len(self.columns) for _ in self.rows]
        for x in self.cells.collect():
            out[x["r"]][x["c"]] = x["v"]
        return out

    def texts(self) -> list[list[str]]:
        return [[fixed.format(v) for v in row] for row in self.values()]


def _placed(cube: Cube, view: View, mask: Mask) -> tuple[list[tuple[int, list[int]]], list[tuple[int, list[int]]], list[tuple[int, int]]]:
    """Positions with their member ids for rows, columns and context; denied axis members are dropped."""
    used = [a.dimension for a in (*view.rows, *view.columns)] + [d for d, _ in view.context]
    if sorted(used) != sorted(d.name for d in cube.dimensions):
        raise CubeError("a view places every dimension once on rows, columns or in the context")

    def side(axes: Sequence[Axis]) -> list[tuple[int, list[int]]]:
        out = []
        for a in axes:
            at = cube.position(a.dimension)
            d = cube.dimensions[at]
            found = list(dict.fromkeys(d.resolve(n) for n in a.members))
            out.append((at, [m for m in found if not mask.taints(at, d, m)]))
        return out

    context = []
    for name, m in view.context:
        at = cube.position(name)
        one = cube.dimensions[at].resolve(m)
        if mask.taints(at, cube.dimensions[at], one):
            raise Denied(f"{m} of {name}")
        context.append((at, one))
    return side(view.rows), side(view.columns), context


def _axis_frame(cube: Cube, side: list[tuple[int, list[int]]], ordinal: str) -> tuple[DataFrame, int]:
    """(d.., ordinal) of an axis's tuples, the first dimension slowest; ordinals are mixed radix numbers."""
    spark, n = cube.spark, 1
    out, order = None, F.lit(0).cast("bigint")
    for at, ids in side:
        one = local_frame(spark, list(zip(ids, range(len(ids)))), f"d{at} int, _o{at} bigint")
        out = one if out is None else out.crossJoin(small(one, len(ids)))
        order, n = order * len(ids) + F.col(f"_o{at}"), n * len(ids)
    if out is None:
        return spark.range(1).select(F.lit(0).cast("bigint").alias(ordinal)), 1
    return out.select(*[f"d{at}" for at, _ in side], order.alias(ordinal)), n


def _tuples(cube: Cube, side: list[tuple[int, list[int]]]) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for at, ids in side:
        names = [cube.dimensions[at].members[m].name for m in ids]
        out = [(*t, n) for t in out for n in names]
    return out


def grid(cube: Cube, view: View, evaluator: Evaluator) -> DataFrame:
    """(r, c, v, err) of every cell of a view, dense, before suppression."""
    rows, columns, context = _placed(cube, view, evaluator.mask)
    region: list[list[int]] = [[] for _ in cube.dimensions]
    for at, ids in (*rows, *columns):
        region[at] = ids
    for at, m in context:
        region[at] = [m]
    left, n = _axis_frame(cube, rows, "r")
    right, m = _axis_frame(cube, columns, "c")
    if not n * m:
        return local_frame(cube.spark, [], "r bigint, c bigint, v bigint, err string")
    values = evaluator.values(cube.name, region)
    on = [f"d{at}" for at, _ in (*rows, *columns)]
    dense = left.crossJoin(small(right, m))
    out = dense.join(values.select(*on, "v", "err"), on, "left") if on else dense.crossJoin(F.broadcast(values.agg(F.max("v").alias("v"), F.max("err").alias("err"))))
    return out.select("r", "c", F.when(F.col("err").isNull(), F.coalesce("v", F.lit(0).cast("bigint"))).alias("v"), "err")


def suppressed(cells: DataFrame, rows: bool, columns: bool) -> DataFrame:
    """Cells (r, c, v) without all-zero rows, then without columns that are zero in the rows left."""
    out = cells
    if rows:
        out = out.join(out.where("v <> 0").select("r").distinct(), "r", "left_semi")
    if columns:
        out = out.join(out.where("v <> 0").select("c").distinct(), "c", "left_semi")
    return out


def execute(cubes: Mapping[str, Cube], name: str, view: View, sandbox: str | None = None, mask: Mask | None = None, strict: bool = False) -> Cellset:
    """Evaluate a view.  Any failing cell fails it; the error told is the first in row order."""
    cube = cubes[name]
    evaluator = Evaluator(cubes, sandbox, mask, strict, name)
    rows, columns, _ = _placed(cube, view, evaluator.mask)
    cells = grid(cube, view, evaluator).persist()
    bad = cells.where("err is not null").orderBy("r", "c").limit(1).collect()
    if bad:
        cells.unpersist()
        raise CellError(bad[0]["err"])
    row_names, column_names = _tuples(cube, rows), _tuples(cube, columns)
    if not row_names or not column_names:
        return Cellset(row_names, column_names, cells.select("r", "c", "v"))
    live_r, live_c = range(len(row_names)), range(len(column_names))
    if view.suppress_rows:
        live_r = sorted(x[0] for x in cells.where("v <> 0").select("r").distinct().collect())
    if view.suppress_columns and len(live_r):
        live_c = sorted(x[0] for x in cells.where("v <> 0").select("c").distinct().collect())
    spark = cube.spark
    out = cells
    for axis, live, n in (("r", live_r, len(row_names)), ("c", live_c, len(column_names))):
        if len(live) < n:
            new = local_frame(spark, list(zip(live, range(len(live)))), f"{axis} bigint, _n bigint")
            out = out.join(small(new, len(live)), axis).withColumn(axis, F.col("_n")).drop("_n")
    return Cellset([row_names[i] for i in live_r], [column_names[i] for i in live_c], out.select("r", "c", "v"), len(row_names) - len(live_r), len(column_names) - len(live_c))


def view_of(cube: Cube, query: mdx.Query, suppress_rows: bool = False, suppress_columns: bool = False) -> View:
    """An MDX query lowered to a view with explicit members."""
    if query.cube.segments != (cube.name,):
        raise CubeError(f"the query is about {query.cube.segments[-1]}, not {cube.name}")
    sides: dict[int, tuple[Axis, ...]] = {}
    for x, axis in query.axes:
        if axis > 1:
            raise CubeError("a view has columns and rows only")
        specs = []
        for part in sets.flattened(x):
            d = cube.dimension(sets.dimension_of(part))
            specs.append(Axis(d.name, tuple(d.members[m].name for m in sets.members(d, part))))
        sides[axis] = tuple(specs)
    context = []
    for p in query.where:
        if len(p.segments) < 2:
            raise CubeError("members in WHERE name their dimension")
        d = cube.dimension(p.segments[0])
        context.append((d.name, d.members[sets.member(d, p)].name))
    return View(sides.get(1, ()), sides.get(0, ()), tuple(context), suppress_rows, suppress_columns)


def select(cubes: Mapping[str, Cube], text: str, **kw) -> Cellset:
    """Run an MDX query."""
    query = mdx.parse_query(text)
    name = query.cube.segments[-1]
    if name not in cubes:
        raise CubeError(f"no cube {name}")
    return execute(cubes, name, view_of(cubes[name], query), **kw)


def long_form(cube: Cube, view: View, cells: DataFrame) -> DataFrame:
    """Cells (r, c, v) with the members' names as columns, one per dimension on an axis."""
    rows, columns, _ = _placed(cube, view, Mask())
    (left, n), (right, m) = _axis_frame(cube, rows, "r"), _axis_frame(cube, columns, "c")
    out = cells.join(small(left, n), "r").join(small(right, m), "c")
    for at, _ in (*rows, *columns):
        d = cube.dimensions[at]
        names = local_frame(cube.spark, [(m.id, m.name) for m in d], f"d{at} int, `{d.name}` string")
        out = out.join(small(names, len(d)), f"d{at}")
    return out.select("r", "c", *[cube.dimensions[at].name for at, _ in (*rows, *columns)], "v")


def query_text(cube: str, rows: Sequence[Axis], columns: Sequence[Axis], context: Sequence[tuple[str, str]] = ()) -> str:
    """MDX text of a pivot layout."""

    def side(axes: Sequence[Axis]) -> str:
        each = ["{" + ", ".join(f"{mdx.bracketed(a.dimension)}.{mdx.bracketed(m)}" for m in a.members) + "}" for a in axes]
        return reduce(lambda a, b: f"{a} * {b}", each)

    parts = [f"{side(s)} ON {n}" for s, n in ((columns, "COLUMNS"), (rows, "ROWS")) if s]
    where = f" WHERE ({', '.join(f'{mdx.bracketed(d)}.{mdx.bracketed(m)}' for d, m in context)})" if context else ""
    return f"SELECT {', '.join(parts)} FROM {mdx.bracketed(cube)}{where}"
