"""Feeders: which rule-targeted leaves can be non-zero, inferred as frames to a fixpoint."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, cell_schema, small
from ..dimension import LEAF
from ..local import local_frame, written
from ..plans.regions import Evaluator
from .compiled import Cell, CompiledRule, base_potent, cells_of, compile_rules

#: A consolidated input with more leaves than this is taken to be non-zero.
MOST_LEAVES = 4096
#: Bytes that one needlessly fed cell costs, in the report.
BYTES_PER_CELL = 20


@dataclass
class Inference:
    fed: DataFrame
    #: (rule, reason) of rules whose feeders can't be found in the cube's own cells.
    opaque: list[tuple[int, str]]


def _leaf_targets(cube: Cube, rule: CompiledRule) -> list[list[int]] | None:
    out = [[m for m in sorted(area) if d.members[m].is_leaf] for d, area in zip(cube.dimensions, rule.area)]
    return out if all(out) else None


def _product(cube: Cube, sets: list[list[int]]) -> DataFrame:
    out = None
    for i, s in enumerate(sets):
        one = local_frame(cube.spark, [(m,) for m in s], f"d{i} int")
        out = one if out is None else out.crossJoin(small(one, len(s)))
    return out


def _fed_by(cube: Cube, cell: Cell, targets: list[list[int]], potent: DataFrame) -> DataFrame:
    """Targets of one reference that some potent leaf below the referenced cell feeds."""
    rows = potent
    keep: list[str] = []
    for i, (d, pin) in enumerate(zip(cube.dimensions, cell.pins)):
        asked = targets[i] if pin is None else [pin]
        pairs = [(a, leaf) for a in asked for leaf in (d.leaf_weights(a) if d.kind(a) != LEAF else {a: 1})]
        frame = local_frame(cube.spark, pairs, f"_t{i} int, d{i} int")
        rows = rows.join(small(frame, len(pairs)), f"d{i}")
        if pin is None:
            keep.append(f"_t{i}")
    found = rows.select(*keep).distinct() if keep else rows.limit(1).select(F.lit(1).alias("_any"))
    out = found
    for i, pin in enumerate(cell.pins):
        if pin is not None:
            free = local_frame(cube.spark, [(m,) for m in targets[i]], f"_t{i} int")
            out = out.crossJoin(small(free, len(targets[i])))
    return out.select(*[F.col(f"_t{i}").alias(f"d{i}") for i in range(cube.rank)])


def infer(cubes: Mapping[str, Cube], name: str, checkpoint=written) -> Inference:
    """All leaf targets that are fed: everywhere for rules with a base term, else where an input may be non-zero.

    Newly fed leaves feed on, so rules that read rules are covered; each round adds cells and the
    loop ends when none is added.  ``checkpoint`` writes a frame and reads it back.
    """
    cube = cubes[name]
    opaque, rounds, whole = [], [], []
    for n, rule in enumerate(compile_rules(cube, cubes).rules):
        targets = _leaf_targets(cube, rule)
        if targets is None:
            continue
        cells = cells_of(rule.formula)
        own = [c for c in cells if c.cube == name]
        if base_potent(rule.formula) or any(_assumed(cube, c, targets) for c in own):
            whole.append(_product(cube, targets))
        elif own:
            rounds.append((targets, list(dict.fromkeys(own))))
        elif cells:
            opaque.append((n, "reads other cubes only"))
    fed = local_frame(cube.spark, [], cell_schema(cube.rank, "").rstrip(", "))
    for w in whole:
        fed = fed.unionByName(w)
    fed = checkpoint(fed.distinct())
    count = fed.count()
    while rounds:
        potent = cube.cells.select(cube.keys).unionByName(fed).distinct()
        more = fed
        for targets, cells in rounds:
            for c in cells:
                more = more.unionByName(_fed_by(cube, c, targets, potent))
        fed = checkpoint(more.distinct())
        now = fed.count()
        if now == count:
            break
        count = now
    return Inference(fed, opaque)


def _assumed(cube: Cube, cell: Cell, targets: list[list[int]]) -> bool:
    """Whether an input is consolidated over so many leaves that it is taken to be non-zero."""
    n = 1
    for d, pin in zip(cube.dimensions, cell.pins):
        n *= 1 if pin is None or d.kind(pin) == LEAF else max(1, len(d.leaf_weights(pin)))
    return n > MOST_LEAVES


@dataclass
class Validation:
    under: DataFrame
    over: DataFrame
    fed: DataFrame

    def counts(self) -> dict[str, int]:
        over = self.over.count()
        return {"fed": self.fed.count(), "under_fed": self.under.count(), "over_fed": over, "over_fed_bytes": BYTES_PER_CELL * over}


def validate(cubes: Mapping[str, Cube], name: str, inference: Inference | None = None) -> Validation:
    """Leaf targets that are non-zero but not fed, and fed ones that are zero."""
    inference = inference or infer(cubes, name)
    cube, e = cubes[name], Evaluator(cubes)
    true = None
    for rule in e.rules(name).rules:
        targets = _leaf_targets(cube, rule)
        if targets is not None:
            one = e.values(name, targets).where("v <> 0").select(cube.keys)
            true = one if true is None else true.unionByName(one)
    true = inference.fed.limit(0) if true is None else true.distinct()
    return Validation(true.join(inference.fed, cube.keys, "left_anti"), inference.fed.join(true, cube.keys, "left_anti"), inference.fed)
