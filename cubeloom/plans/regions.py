"""Rule-aware evaluation of whole regions.

A region is a product of member sets, one per dimension.  References pin dimensions or copy
the target's, so a region of targets reads a region of inputs.  ``Evaluator.values`` splits
a region by first-matching rules and plans each part once:

* a rule's part: its formula over the joined values of the regions it reads;
* the rest, all leaf members: stored cells under the overlay;
* the rest with consolidated members: the leaf region below it, weighted and summed, so that
  rule-derived leaves are rolled up and overridden totals aren't.

Frames are sparse: (d0.., v, err); a missing coordinate is zero.  Errors travel as values and
are raised only for cells that were asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, cell_schema, small, within
from ..dimension import LEAF
from ..errors import LimitExceeded
from ..functions import fixed
from ..local import local_frame
from ..operators import overlay, rollup
from ..operators.masks import Mask
from ..rules import language as lang
from ..rules.compiled import AttributeNumber, Cell, CompiledRules, Constant, base_potent, cells_of, compile_rules, may_fail

Region = tuple[frozenset[int], ...]
#: Coordinates of a rule's part that are made densely, at most.
MOST_DENSE = 200_000_000


def size(region: Region) -> int:
    out = 1
    for s in region:
        out *= len(s)
    return out


def subtract(region: Region, area: Sequence[frozenset[int]]) -> Iterator[Region]:
    """What an area leaves of a region, as disjoint regions."""
    inside = list(region)
    for i, (s, a) in enumerate(zip(region, area)):
        outside = s - a
        if outside:
            yield (*inside[:i], outside, *region[i + 1 :])
        inside[i] = s & a
        if not inside[i]:
            return


class Evaluator:
    """Values of the regions of some cubes, each region planned once."""

    def __init__(self, cubes: Mapping[str, Cube], sandbox: str | None = None, mask: Mask | None = None, strict: bool = False, target: str | None = None):
        self.cubes, self.sandbox, self.mask, self.strict, self.target = cubes, sandbox, mask or Mask(), strict, target
        self._rules: dict[str, CompiledRules] = {}
        self._memo: dict[tuple[str, Region], DataFrame] = {}

    def rules(self, cube: str) -> CompiledRules:
        if cube not in self._rules:
            self._rules[cube] = compile_rules(self.cubes[cube], self.cubes)
        return self._rules[cube]

    def base(self, cube: str) -> DataFrame:
        c = self.cubes[cube]
        return overlay.overlaid(c, self.sandbox if cube == self.target and self.sandbox in c.sandboxes else None)

    def values(self, cube: str, region: Sequence[Sequence[int]], above: tuple = ()) -> DataFrame:
        """(d0.., v, err) of the coordinates of a region that are not zero."""
        region = tuple(map(frozenset, region))
        key = (cube, region)
        if not above and key in self._memo:
            return self._memo[key]
        parts = [self._rule(cube, rule, part, above) if rule is not None else self._plain(cube, part, above) for rule, part in self._split(cube, region)]
        out = parts[0] if parts else self._nothing(cube)
        for p in parts[1:]:
            out = out.unionByName(p)
        if not above:
            self._memo[key] = out
        return out

    def _nothing(self, cube: str) -> DataFrame:
        c = self.cubes[cube]
        return local_frame(c.spark, [], cell_schema(c.rank, "v bigint, err string"))

    def _split(self, cube: str, region: Region) -> Iterator[tuple[int | None, Region]]:
        """Disjoint parts with the first rule that matches them, None for no rule; denied parts are left out."""
        c = self.cubes[cube]
        rest = [region]
        if cube == self.target and self.mask:
            allowed = [s - (self.mask.tainted(i, d) if self.strict else self.mask.denied.get(i, frozenset())) for i, (s, d) in enumerate(zip(region, c.dimensions))]
            rest = [tuple(allowed)] if all(allowed) else []
        for n, rule in enumerate(self.rules(cube).rules):
            left = []
            for r in rest:
                hit = tuple(s & a for s, a in zip(r, rule.area))
                if all(hit):
                    yield n, hit
                    left.extend(subtract(r, rule.area))
                else:
                    left.append(r)
            rest = left
        yield from ((None, r) for r in rest if all(r))

    def _plain(self, cube: str, region: Region, above: tuple) -> DataFrame:
        """A region without rules."""
        c = self.cubes[cube]
        if all(d.kind(m) == LEAF for d, s in zip(c.dimensions, region) for m in s):
            rows = self.base(cube)
            for i, (d, s) in enumerate(zip(c.dimensions, region)):
                if len(s) < sum(m.kind == LEAF for m in d):
                    rows = within(rows, f"d{i}", s)
            return rows.select(*c.keys, "v", F.lit(None).cast("string").alias("err"))
        below = [{leaf for m in s for leaf in d.leaf_weights(m)} for d, s in zip(c.dimensions, region)]
        if not all(below):
            return self._nothing(cube)
        return rollup.consolidate(self.values(cube, below, above), c.dimensions, [sorted(s) for s in region])

    def _rule(self, cube: str, number: int, region: Region, above: tuple) -> DataFrame:
        """A region owned by one rule."""
        c = self.cubes[cube]
        formula = self.rules(cube).rules[number].formula
        mark = (cube, number, region)
        if mark in above:
            return self._dense(c, region).select(*c.keys, F.lit(None).cast("bigint").alias("v"), F.lit("cycle").alias("err"))
        above = (*above, mark)
        cells = list(dict.fromkeys(cells_of(formula)))
        reads = {}
        for n, cell in enumerate(cells):
            asked = tuple(frozenset([p]) if p is not None else region[i] for i, p in enumerate(cell.pins))
            reads[cell] = self.values(cell.cube, asked, above).withColumnsRenamed({"v": f"v{n}", "err": f"e{n}"})
        if base_potent(formula) or may_fail(formula):
            rows = self._dense(c, region)
        else:
            rows = self._support(c, region, reads)
        for n, cell in enumerate(cells):
            free = [f"d{i}" for i, p in enumerate(cell.pins) if p is None]
            if cell.cube == cube and free:
                rows = rows.join(reads[cell].select(*free, f"v{n}", f"e{n}"), free, "left")
            else:  # one cell: a row of aggregates, also where there is none
                one = reads[cell].agg(F.max(f"v{n}").alias(f"v{n}"), F.max(f"e{n}").alias(f"e{n}"))
                rows = rows.crossJoin(F.broadcast(one))
        names = {cell: n for n, cell in enumerate(cells)}
        attributes: dict[AttributeNumber, str] = {}
        for a in _attributes(formula):
            d = c.dimensions[a.position]
            held = [(m, v) for m in region[a.position] if isinstance(v := d.attribute(m, a.attribute), int)]
            name = attributes[a] = f"a{len(attributes)}"
            frame = local_frame(c.spark, held, f"d{a.position} int, {name} bigint")
            rows = rows.join(small(frame, len(held)), f"d{a.position}", "left")
        stage = _Stage(rows)
        v, err = _formula(formula, names, attributes, stage.let)
        out = stage.rows.select(*c.keys, F.when(err.isNull(), v).alias("v"), err.alias("err"))
        return out.where("v <> 0 or err is not null")

    def _dense(self, c: Cube, region: Region) -> DataFrame:
        if size(region) > MOST_DENSE:
            raise LimitExceeded(f"{size(region)} rule cells, at most {MOST_DENSE}")
        out = None
        for i, s in enumerate(region):
            one = local_frame(c.spark, [(m,) for m in sorted(s)], f"d{i} int")
            out = one if out is None else out.crossJoin(small(one, len(s)))
        return out

    def _support(self, c: Cube, region: Region, reads: dict[Cell, DataFrame]) -> DataFrame:
        """Coordinates of a region where some reference may be non-zero: enough for formulas that are zero elsewhere."""
        out = None
        for cell, frame in reads.items():
            if cell.cube != c.name:
                return self._dense(c, region)  # a cell of another cube may be non-zero for all targets
            one = frame.select(*[f"d{i}" for i, p in enumerate(cell.pins) if p is None])
            for i, p in enumerate(cell.pins):
                if p is not None:
                    one = one.crossJoin(small(local_frame(c.spark, [(m,) for m in sorted(region[i])], f"d{i} int"), len(region[i])))
            one = one.select(c.keys)
            out = one if out is None else out.unionByName(one)
        return out.distinct() if out is not None else local_frame(c.spark, [], cell_schema(c.rank, "v bigint")).select(c.keys)


def _attributes(x: object) -> list[AttributeNumber]:
    if isinstance(x, AttributeNumber):
        return [x]
    if isinstance(x, lang.Negative):
        return _attributes(x.of)
    if isinstance(x, (lang.Arithmetic, lang.Compare)):
        return list(dict.fromkeys(_attributes(x.left) + _attributes(x.right)))
    if isinstance(x, lang.Logic):
        return list(dict.fromkeys(a for p in x.parts for a in _attributes(p)))
    if isinstance(x, lang.Choice):
        return list(dict.fromkeys(_attributes(x.condition) + _attributes(x.then) + ([] if x.otherwise is None else _attributes(x.otherwise))))
    return []


Let = Callable[[Column], Column]


class _Stage:
    """Rows that take on values a formula names more than once as columns."""

    def __init__(self, rows: DataFrame):
        self.rows, self.n = rows, 0

    def let(self, value: Column) -> Column:
        name = f"_t{self.n}"
        self.n += 1
        self.rows = self.rows.withColumn(name, value)
        return F.col(name)


def _formula(x: object, names: dict[Cell, int], attributes: dict[AttributeNumber, str], let: Let) -> tuple[Column, Column]:
    """(value, error) columns of a formula: value is trusted only where the error is NULL."""
    zero, fine = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    again = lambda y: _formula(y, names, attributes, let)
    if isinstance(x, Constant):
        return F.lit(x.value).cast("bigint"), fine
    if isinstance(x, Cell):
        n = names[x]
        return F.coalesce(F.col(f"v{n}"), zero), F.col(f"e{n}")
    if isinstance(x, AttributeNumber):
        return F.coalesce(F.col(attributes[x]), zero), fine
    if isinstance(x, lang.Negative):
        v, e = again(x.of)
        wide = -v.cast(fixed.WIDE)
        return fixed.narrowed(wide), F.coalesce(e, F.when(~fixed.fits(wide), F.lit("overflow")))
    if isinstance(x, lang.Arithmetic):
        (a, ea), (b, eb) = again(x.left), again(x.right)
        before = F.coalesce(ea, eb)
        if x.op in "+-":
            wide = a.cast(fixed.WIDE) + b.cast(fixed.WIDE) if x.op == "+" else a.cast(fixed.WIDE) - b.cast(fixed.WIDE)
            out = fixed.narrowed(wide)
        else:
            out = let(fixed.product(a, b, let) if x.op == "*" else fixed.quotient(a, b, let))
        zero_by = F.when(b == 0, F.lit("division by zero")) if x.op == "/" else fine
        return out, F.coalesce(before, zero_by, F.when(out.isNull(), F.lit("overflow")))
    if isinstance(x, lang.Choice):
        c, ec = _condition(x.condition, names, attributes, let)
        (a, ea), (b, eb) = again(x.then), again(x.otherwise) if x.otherwise is not None else (zero, fine)
        return F.when(c, a).otherwise(b), F.coalesce(ec, F.when(c, ea).otherwise(eb))
    raise TypeError(type(x))


def _condition(x: object, names: dict[Cell, int], attributes: dict[AttributeNumber, str], let: Let) -> tuple[Column, Column]:
    """(truth, error) of a condition; AND and OR look at the right side only if the left doesn't decide."""
    if isinstance(x, lang.Compare):
        (a, ea), (b, eb) = _formula(x.left, names, attributes, let), _formula(x.right, names, attributes, let)
        out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op]
        return F.coalesce(out, F.lit(False)), F.coalesce(ea, eb)
    parts = [_condition(p, names, attributes, let) for p in x.parts]
    if x.op == "NOT":
        return ~parts[0][0], parts[0][1]
    (a, ea), (b, eb) = parts
    if x.op == "AND":
        return a & b, F.coalesce(ea, F.when(a, eb))
    return a | b, F.coalesce(ea, F.when(~a, eb))
