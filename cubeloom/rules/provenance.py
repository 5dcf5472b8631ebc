"""Explanations: where a cell's value comes from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, cell_schema, small
from ..dimension import LEAF
from ..functions import fixed
from ..local import local_frame
from ..plans.regions import Evaluator
from .compiled import Cell, cells_of

#: Depth of a full explanation, at most.
MOST_DEPTH = 32


@dataclass
class Trace:
    """``source`` is stored, rule or consolidated; inputs of a rule are those its formula's values read, conditions left out."""

    cube: str
    coordinate: tuple[str, ...]
    value: int
    source: str
    rule: int | None = None
    weight: int | None = None
    inputs: list[Trace] = field(default_factory=list)

    def rows(self, parent: int = -1, depth: int = 0, out: list | None = None) -> list[tuple]:
        """Flattened: (node, parent, depth, cube, coordinate, value, source)."""
        out = [] if out is None else out
        node = len(out)
        out.append((node, parent, depth, self.cube, ", ".join(self.coordinate), fixed.format(self.value), self.source))
        for x in self.inputs:
            x.rows(node, depth + 1, out)
        return out


def _values(e: Evaluator, cube: str, coordinates: Sequence[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """Values of listed coordinates, read as one region."""
    c = e.cubes[cube]
    if not coordinates:
        return {}
    region = [frozenset(x[i] for x in coordinates) for i in range(c.rank)]
    asked = local_frame(c.spark, coordinates, cell_schema(c.rank, "").rstrip(", "))
    found = e.values(cube, region).join(small(asked, len(coordinates)), c.keys, "left_semi").collect()
    at = {tuple(x[k] for k in c.keys): x["v"] or 0 for x in found}
    return {x: at.get(x, 0) for x in coordinates}


def explain(e: Evaluator, cube: str, coordinate: Sequence[int], depth: int = 1) -> Trace:
    """A tree of ``depth`` levels below a cell (MOST_DEPTH for all)."""
    return _explain(e, cube, tuple(coordinate), _values(e, cube, [tuple(coordinate)])[tuple(coordinate)], min(depth, MOST_DEPTH))


def _explain(e: Evaluator, cube: str, at: tuple[int, ...], value: int, depth: int) -> Trace:
    c = e.cubes[cube]
    names = tuple(d.members[m].name for d, m in zip(c.dimensions, at))
    rule = e.rules(cube).first_match(at)
    if rule is not None:
        out = Trace(cube, names, value, "rule", rule)
        if depth:
            for cell in dict.fromkeys(cells_of(e.rules(cube).rules[rule].formula, conditions=False)):
                target = _target(cell, at)
                v = _values(e, cell.cube, [target])[target]
                out.inputs.append(_explain(e, cell.cube, target, v, depth - 1))
        return out
    if all(d.kind(m) == LEAF for d, m in zip(c.dimensions, at)):
        return Trace(cube, names, value, "stored")
    out = Trace(cube, names, value, "consolidated")
    if depth:
        for x in contributions(e, cube, at).orderBy(*c.keys).collect():
            leaf = tuple(x[k] for k in c.keys)
            one = _explain(e, cube, leaf, x["v"], depth - 1)
            one.weight = x["weight"]
            out.inputs.append(one)
    return out


def _target(cell: Cell, at: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(at[i] if p is None else p for i, p in enumerate(cell.pins))


def contributions(e: Evaluator, cube: str, at: Sequence[int]) -> DataFrame:
    """(d0.., v, weight) of the non-zero leaves below a coordinate, as one plan."""
    c = e.cubes[cube]
    below = [d.leaf_weights(m) for d, m in zip(c.dimensions, at)]
    out = e.values(cube, [list(w) for w in below]).where("v <> 0")
    weight = F.lit(1).cast("bigint")
    for i, w in enumerate(below):
        frame = local_frame(c.spark, list(w.items()), f"d{i} int, _w{i} bigint")
        out = out.join(small(frame, len(w)), f"d{i}")
        weight = weight * F.col(f"_w{i}")
    return out.select(*c.keys, "v", weight.alias("weight"))
