"""Model tests: fixtures written to a copy of a cube, expectations compared exactly."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from ..cube import Cube
from ..functions import fixed
from ..operators.writes import batch, write_cells
from ..plans.regions import Evaluator


@dataclass(frozen=True)
class RuleTest:
    """Names of members by dimension (aliases allowed) with decimal texts."""

    name: str
    fixtures: tuple[tuple[dict[str, str], str], ...]
    expectations: tuple[tuple[dict[str, str], str], ...]


@dataclass(frozen=True)
class Failure:
    coordinate: dict[str, str]
    expected: str
    actual: str


def _at(cube: Cube, names: dict[str, str]) -> tuple[int, ...]:
    return tuple(d.resolve(names[d.name]) for d in cube.dimensions)


def run(cube: Cube, test: RuleTest) -> list[Failure]:
    """The expectations that fail.  Only the cube itself is known, so rules that read others don't compile here."""
    fresh = replace(cube, cells=cube.cells.limit(0))
    cells = [(_at(cube, c), fixed.parse(v)) for c, v in test.fixtures]
    for c, _ in cells:
        cube.check_write(c)
    fresh = write_cells(fresh, batch(fresh, cells), check=False) if cells else fresh
    e = Evaluator({cube.name: fresh})
    out = []
    for names, expected in test.expectations:
        at = _at(cube, names)
        rows = e.values(cube.name, [[m] for m in at]).collect()
        err = rows[0]["err"] if rows else None
        actual = err or fixed.format(rows[0]["v"] if rows else 0)
        if err or fixed.parse(actual) != fixed.parse(expected):
            out.append(Failure(names, expected, actual))
    return out


def run_all(cube: Cube, tests: Sequence[RuleTest]) -> dict[str, list[Failure]]:
    return {t.name: run(cube, t) for t in tests}
