"""Flows: Python callables that read rows and stage changes; nothing is written until all stages ran.

A flow is an object with any of ``init``, ``schema``, ``rows`` and ``finalize``, each taking a
context.  Given the same inputs, parameters and clock it stages the same changes: use
``ctx.now`` instead of the wall clock and no random functions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cube import Cube, member_frame, small
from .dimension import CONSOLIDATED, LEAF, STRING
from .errors import CubeError, LimitExceeded, UnknownName
from .functions import fixed
from .operators import writes

if TYPE_CHECKING:
    from .engine import Engine
    from .security import Policy

STAGES = ("init", "schema", "rows", "finalize")
MOST_STAGED = 5_000_000
#: The clock of flow tests: 2020-01-01.
TEST_NOW = 1_577_836_800_000


@dataclass
class CubeHandle:
    """Stages members, edges and cells of one cube; reads see the version the run began with."""

    cube: Cube
    members: list[tuple[str, str, str]] = field(default_factory=list)
    edges: list[tuple[str, str, str, int]] = field(default_factory=list)
    cells: list[tuple[dict[str, str], str]] = field(default_factory=list)
    frames: list[tuple[DataFrame, dict[str, str], str]] = field(default_factory=list)

    def ensure_element(self, dimension: str, name: str, kind: str = LEAF) -> None:
        self.members.append((dimension, name, kind))

    def ensure_elements(self, dimension: str, names: Sequence[str], kind: str = LEAF) -> None:
        self.members.extend((dimension, n, kind) for n in names)

    def ensure_consolidated(self, dimension: str, name: str) -> None:
        self.members.append((dimension, name, CONSOLIDATED))

    def add_child(self, dimension: str, parent: str, child: str, weight: int = 1) -> None:
        self.edges.append((dimension, parent, child, weight))

    def write_cell(self, at: dict[str, str], value: object) -> None:
        self.cells.append((at, str(value)))

    def write_cells(self, frame: DataFrame, dimensions: Mapping[str, str], value: str) -> None:
        """Stage a frame of any size: a column of member names per dimension, and one of decimal texts."""
        self.frames.append((frame, dict(dimensions), value))

    def read_cell(self, at: dict[str, str]) -> str:
        return fixed.format(self.cube.get_leaf(self.cube.coordinate(at)))

    def read_text(self, at: dict[str, str]) -> str | None:
        return self.cube.get_string(self.cube.coordinate(at))

    def list_members(self, dimension: str) -> list[str]:
        return [m.name for m in self.cube.dimension(dimension)]

    def property(self, name: str) -> str:
        if name != "rules":
            raise UnknownName(f"a cube has no property {name}")
        return self.cube.rules


@dataclass
class Context:
    inputs: Mapping[str, DataFrame]
    parameters: Mapping[str, str]
    now: int
    engine: Engine
    lines: list[str] = field(default_factory=list)
    handles: dict[str, CubeHandle] = field(default_factory=dict)
    #: Members and edges for shared dimensions: (dimension, name, kind) and (dimension, parent, child, weight).
    grown: list[tuple[str, str, str]] = field(default_factory=list)
    grown_edges: list[tuple[str, str, str, int]] = field(default_factory=list)

    def input(self, name: str | None = None) -> DataFrame:
        """A named input; the only one if no name is given."""
        if name is None:
            if len(self.inputs) != 1:
                raise CubeError("name one of the inputs")
            return next(iter(self.inputs.values()))
        for key in (name, f"local.{name}"):
            if key in self.inputs:
                return self.inputs[key]
        raise UnknownName(f"no input {name}")

    def sources(self) -> list[str]:
        return sorted(self.inputs)

    def param(self, name: str, default: str = "") -> str:
        return self.parameters.get(name, default)

    def cube(self, name: str) -> CubeHandle:
        if name not in self.handles:
            self.handles[name] = CubeHandle(self.engine.cube(name))
        return self.handles[name]

    def grow(self, dimension: str, name: str, kind: str = LEAF) -> None:
        self.grown.append((dimension, name, kind))

    def grow_edge(self, dimension: str, parent: str, child: str, weight: int = 1) -> None:
        self.grown_edges.append((dimension, parent, child, weight))

    def log(self, text: object) -> None:
        self.lines.append(str(text))

    def staged(self) -> int:
        return len(self.grown) + len(self.grown_edges) + sum(len(h.members) + len(h.edges) + len(h.cells) for h in self.handles.values())


def run(engine: Engine, flow: object, inputs: Mapping[str, DataFrame] | None = None, parameters: Mapping[str, str] | None = None, now: int = 0) -> Context:
    """Run all stages; the result holds what was staged and nothing has changed yet."""
    ctx = Context(inputs or {}, parameters or {}, now, engine)
    for stage in STAGES:
        step: Callable[[Context], None] | None = getattr(flow, stage, None)
        if step:
            step(ctx)
            if ctx.staged() > MOST_STAGED:
                raise LimitExceeded(f"more than {MOST_STAGED} staged items")
    return ctx


def authorize(policy: Policy, user: str | None, ctx: Context) -> None:
    """Check all staged effects as a user (a scheduled run: the flow's owner; without one it fails)."""
    if user is None:
        raise CubeError("the flow has no owner")
    for name in ctx.handles:
        policy.require(user, name, "write")
    for dimension, *_ in (*ctx.grown, *ctx.grown_edges):
        policy.require(user, ("dimension", dimension), "write")


def _grow(cube: Cube, members: Sequence[tuple[str, str, str]], edges: Sequence[tuple[str, str, str, int]]) -> Cube:
    """Append members and edges to copies of the dimensions, all or nothing."""
    dims = {d.name: d.copy() for d in cube.dimensions}
    for dimension, name, kind in members:
        dims[dimension].add(name, kind)
    for dimension, parent, child, weight in edges:
        d = dims[dimension]
        d.add_child(d.exact(parent), d.exact(child), weight)
    return replace(cube, dimensions=tuple(dims[d.name] for d in cube.dimensions))


def named_writes(cube: Cube, frame: DataFrame, dimensions: Mapping[str, str], value: str, ordinal: str | None = None) -> DataFrame:
    """(d0.., v, ord) of a frame with member names and decimal texts.  Unknown names or bad numbers fail the batch."""
    out = frame.withColumn("ord", F.col(ordinal) if ordinal else F.monotonically_increasing_id())
    for i, d in enumerate(cube.dimensions):
        ids = member_frame(cube.spark, d).select(F.col("name").alias(f"_n{i}"), F.col("id").alias(f"d{i}"))
        out = out.join(small(ids, len(d)), F.col(dimensions[d.name]) == F.col(f"_n{i}"), "left")
        out = out.withColumn(f"d{i}", F.when(F.col(f"d{i}").isNull(), F.raise_error(F.concat(F.lit(f"no member of {d.name}: "), F.col(dimensions[d.name])))).otherwise(F.col(f"d{i}")))
    number = fixed.parsed(F.col(value))
    number = F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.col(value)))).otherwise(number)
    return out.select(*cube.keys, number.cast("bigint").alias("v"), F.col("ord").cast("bigint").alias("ord"))


def apply(ctx: Context) -> list[Cube]:
    """Make staged changes: shared dimensions first, then each cube as one commit."""
    engine = ctx.engine
    for dimension, name, kind in ctx.grown:
        if dimension not in engine.shared:
            raise UnknownName(f"no shared dimension {dimension}")
        engine.edit_dimension(dimension, "add", name, kind)
    for dimension, parent, child, weight in ctx.grown_edges:
        d = engine.shared[dimension].dimension
        engine.edit_dimension(dimension, "add_child", d.exact(parent), d.exact(child), weight)
    out = []
    for name, h in ctx.handles.items():
        cube = _grow(engine.cube(name), h.members, h.edges)
        numbers, texts = [], []
        for at, v in h.cells:
            coordinate = cube.coordinate(at)
            text = STRING in [d.kind(m) for d, m in zip(cube.dimensions, coordinate)]
            cube.check_write(coordinate, text)
            (texts if text else numbers).append((coordinate, v if text else fixed.parse(v)))
        batch = writes.batch(cube, numbers)
        for n, (frame, dimensions, value) in enumerate(h.frames):
            one = named_writes(cube, frame, dimensions, value)
            batch = batch.unionByName(one.withColumn("ord", F.col("ord") + (n + 1) * (1 << 52)))
        cube = writes.write_cells(cube, batch)
        for coordinate, v in texts:
            cube = writes.set_string(cube, coordinate, v)
        out.append(engine.publish(cube, "flow"))
    return out


def import_rows(engine: Engine, cube: str, rows: DataFrame, columns: Mapping[str, str], value: str | None, fixed_members: Mapping[str, str] | None = None, ordinal: str | None = None) -> Cube:
    """Guided import: a column per dimension or a fixed member, and one value column.

    Members that are missing become leaves; a blank value makes the member only.  Duplicate
    coordinates don't add up: the last row wins.
    """
    fixed_members = fixed_members or {}
    c = engine.cube(cube)
    if set(columns) & set(fixed_members) or set(columns) | set(fixed_members) != {d.name for d in c.dimensions}:
        raise CubeError("every dimension takes one column or one fixed member")
    members = [(d, m, LEAF) for d, m in fixed_members.items() if m not in c.dimension(d)._by_name]
    for dimension, column in columns.items():
        known = member_frame(engine.spark, c.dimension(dimension)).select(F.col("name").alias(column))
        fresh = rows.select(column).where(F.col(column) != "").distinct().join(known, column, "left_anti")
        members += [(dimension, r[0], LEAF) for r in fresh.orderBy(column).collect()]
    grown = _grow(c, members, [])
    if value is None:
        return engine.publish(grown, "import")
    filled = rows
    names = {}
    for d in grown.dimensions:
        names[d.name] = columns.get(d.name, f"_fixed_{d.name}")
        if d.name in fixed_members:
            filled = filled.withColumn(names[d.name], F.lit(fixed_members[d.name]))
    filled = filled.where(F.trim(value) != "")
    return engine.publish(writes.write_cells(grown, named_writes(grown, filled, names, value, ordinal)), "import")


@dataclass(frozen=True)
class FlowTest:
    flow: object
    inputs: Mapping[str, DataFrame]
    parameters: Mapping[str, str]
    #: (cube, coordinate, decimal text)
    expectations: tuple[tuple[str, dict[str, str], str], ...]


def run_test(engine: Engine, test: FlowTest) -> list[tuple[str, dict[str, str], str, str]]:
    """Run a flow on a copy of the engine with a fixed clock; the expectations that fail, with actual values."""
    from .engine import Engine as Copy

    twin = Copy(engine.spark)
    twin.models = {n: replace(m) for n, m in engine.models.items()}
    twin.shared = {n: replace(s, dimension=s.dimension.copy()) for n, s in engine.shared.items()}
    apply(run(twin, test.flow, test.inputs, test.parameters, TEST_NOW))
    out = []
    for cube, at, expected in test.expectations:
        row = twin.read_cells(cube, [at]).first()
        if row["v"] != fixed.parse(expected):
            out.append((cube, at, expected, fixed.format(row["v"])))
    return out
