"""Cubes: dimensions plus two fact frames, numeric cells and string cells."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimension import LEAF, STRING, Dimension
from .errors import CubeError, InvalidWrite, UnknownName
from .functions import fixed
from .local import local_frame


def columns(n: int) -> list[str]:
    return [f"d{i}" for i in range(n)]


def cell_schema(n: int, value: str = "v bigint") -> str:
    return ", ".join([*(f"{c} int" for c in columns(n)), value])


@dataclass(frozen=True)
class Cube:
    """An immutable version of a cube.  ``cells`` holds (d0.., v) with unique coordinates and no zeros; ``strings`` (d0.., s) no empty texts."""

    name: str
    dimensions: tuple[Dimension, ...]
    cells: DataFrame
    strings: DataFrame
    rules: str = ""
    version: int = 0
    sandboxes: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def empty(cls, spark: SparkSession, name: str, dimensions: Sequence[Dimension]) -> Cube:
        names = [d.name for d in dimensions]
        if not names or len(set(names)) < len(names):
            raise CubeError("a cube needs dimensions with different names")
        n = len(names)
        return cls(name, tuple(dimensions), local_frame(spark, [], cell_schema(n)), local_frame(spark, [], cell_schema(n, "s string")))

    @classmethod
    def load(cls, spark: SparkSession, name: str, dimensions: Sequence[Dimension], facts: DataFrame, members: Sequence[str], value: str = "v") -> Cube:
        """A cube from facts with member names in columns and a scaled BIGINT value, already one row per coordinate.

        Names are turned into ids by joins with the dimensions' members, broadcast when few.
        """
        out = facts
        for i, (d, col) in enumerate(zip(dimensions, members)):
            ids = member_frame(spark, d).select(F.col("name").alias(f"_n{i}"), F.col("id").alias(f"d{i}"))
            out = out.join(small(ids, len(d)), F.col(col) == F.col(f"_n{i}"))
        cells = out.select(*columns(len(dimensions)), F.col(value).alias("v")).where("v <> 0")
        return replace(cls.empty(spark, name, dimensions), cells=cells)

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @property
    def rank(self) -> int:
        return len(self.dimensions)

    @property
    def keys(self) -> list[str]:
        return columns(self.rank)

    def position(self, dimension: str) -> int:
        for i, d in enumerate(self.dimensions):
            if d.name == dimension:
                return i
        raise UnknownName(f"{self.name} has no dimension {dimension}")

    def dimension(self, name: str) -> Dimension:
        return self.dimensions[self.position(name)]

    def coordinate(self, names: dict[str, str]) -> tuple[int, ...]:
        """Member ids of a full coordinate given by exact member names."""
        if set(names) != {d.name for d in self.dimensions}:
            raise CubeError("a coordinate names every dimension once")
        return tuple(d.exact(names[d.name]) for d in self.dimensions)

    def check_write(self, coordinate: Sequence[int], text: bool = False) -> None:
        kinds = [d.kind(m) for d, m in zip(self.dimensions, coordinate)]
        if text and (STRING not in kinds or any(k not in (LEAF, STRING) for k in kinds)):
            raise InvalidWrite("a string cell needs leaf members, one of them a string member")
        if not text and any(k != LEAF for k in kinds):
            raise InvalidWrite("a numeric cell needs numeric leaf members")

    def at(self, coordinate: Sequence[int], frame: DataFrame | None = None) -> DataFrame:
        """The cells (or another frame by coordinate) at one coordinate: an equality filter that reaches the scan."""
        out = self.cells if frame is None else frame
        for c, m in zip(self.keys, coordinate):
            out = out.where(F.col(c) == m)
        return out

    def get_leaf(self, coordinate: Sequence[int]) -> int:
        row = self.at(coordinate).select("v").first()
        return row[0] if row else 0

    def get_string(self, coordinate: Sequence[int]) -> str | None:
        row = self.at(coordinate, self.strings).select("s").first()
        return row[0] if row else None


#: Members whose frame is broadcast; larger dimensions are joined by shuffle.
BROADCAST_MEMBERS = 2_000_000


def small(frame: DataFrame, rows: int) -> DataFrame:
    """A frame of known row count, marked for broadcast if small."""
    return F.broadcast(frame) if rows <= BROADCAST_MEMBERS else frame


#: Members that a filter lists as literals; longer sets are joined.
MOST_LITERALS = 500


def within(rows: DataFrame, column: str, members: Collection[int], inside: bool = True) -> DataFrame:
    """Rows whose member is in a set (or isn't): a pushed filter if the set is short, else a join with a small frame."""
    if len(members) <= MOST_LITERALS:
        fits = F.col(column).isin(sorted(members))
        return rows.where(fits if inside else ~fits)
    frame = local_frame(rows.sparkSession, [(m,) for m in sorted(members)], f"{column} int")
    return rows.join(small(frame, len(members)), column, "left_semi" if inside else "left_anti")


def member_frame(spark: SparkSession, d: Dimension) -> DataFrame:
    """(idx, id, name, kind, pinned) in visible order."""
    return local_frame(spark, [(i, m.id, m.name, m.kind, m.pinned) for i, m in enumerate(d)], "idx int, id int, name string, kind string, pinned boolean")


def edge_frame(spark: SparkSession, d: Dimension) -> DataFrame:
    """(parent, child, weight, edge_ord), by parent and child."""
    rows = [(p, c, w, n) for n, ((p, c), w) in enumerate(d.edges.items())]
    rows.sort(key=lambda r: (d.place(r[0]), d.place(r[1])))
    return local_frame(spark, rows, "parent int, child int, weight bigint, edge_ord int")


def attribute_frame(spark: SparkSession, d: Dimension) -> DataFrame:
    """(id, attr, s, n), by member and attribute."""
    order = list(d.attributes)
    rows = sorted(((m, a, None if isinstance(v, int) else v, v if isinstance(v, int) else None) for (m, a), v in d.values.items()), key=lambda r: (d.place(r[0]), order.index(r[1])))
    return local_frame(spark, rows, "id int, attr string, s string, n bigint")


def closure_frame(spark: SparkSession, d: Dimension, ancestors: Sequence[int]) -> tuple[DataFrame, int]:
    """(ancestor, leaf, weight) of the requested members, and its row count."""
    rows = d.closure(ancestors)
    return local_frame(spark, rows, "ancestor int, leaf int, weight bigint"), len(rows)


def with_names(cube: Cube, frame: DataFrame) -> DataFrame:
    """Coordinate columns replaced by member names, named after the dimensions."""
    out = frame
    for i, d in enumerate(cube.dimensions):
        names = member_frame(cube.spark, d).select(F.col("id").alias(f"d{i}"), F.col("name").alias(d.name))
        out = out.join(small(names, len(d)), f"d{i}")
    return out.select(*(d.name for d in cube.dimensions), *(c for c in frame.columns if c not in cube.keys))


def scaled(amount: str | int) -> int:
    return fixed.parse(amount) if isinstance(amount, str) else amount * fixed.SCALE
