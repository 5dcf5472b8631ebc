"""Set expressions over a dimension.

``members`` gives the ordered, distinct member ids; ``frame`` the same as a DataFrame.  The
predicate of a Filter is two-valued: a comparison with a missing attribute is false, so NOT of
it is true.  Both sides of AND and OR are looked at, so a type error is never hidden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cube import attribute_frame, member_frame
from ..dimension import NUMERIC, Dimension
from ..errors import CubeError, TypeMismatch, UnknownName, Unsupported
from ..functions import fixed
from ..local import local_frame
from ..rules.compiled import compare
from . import language as lang


def member(d: Dimension, path: lang.Path) -> int:
    if len(path.segments) > 1 and path.segments[0] != d.name:
        raise UnknownName(f"{path.segments[0]} is not the dimension {d.name}")
    return d.resolve(path.segments[-1])


def members(d: Dimension, x: object) -> list[int]:
    """The distinct members of a set in order."""
    return list(dict.fromkeys(_members(d, x)))


def _members(d: Dimension, x: object) -> list[int]:
    if isinstance(x, lang.Path):
        return [member(d, x)]
    if isinstance(x, lang.Family):
        if x.kind == "members":
            if x.path.segments != (d.name,):
                raise UnknownName(f"{x.path.segments[-1]} is not the dimension {d.name}")
            return list(d.order)
        at = member(d, x.path)
        return d.children(at) if x.kind == "children" else d.descendants(at)
    if isinstance(x, lang.Literal):
        return [m for p in x.parts for m in members(d, p)]
    if isinstance(x, lang.Filtered):
        return [m for m in members(d, x.of) if _holds(d, m, x.predicate)]
    if isinstance(x, lang.Ordered):
        _known(d, x.attribute)
        found = members(d, x.of)
        # Missing before numbers before texts, all of it turned round when descending; ties keep their order.
        key = lambda m: (0, 0) if (v := d.attribute(m, x.attribute)) is None else (1, v) if isinstance(v, int) else (2, v)
        return sorted(found, key=key, reverse=False) if not x.descending else [m for m in reversed(sorted(reversed(found), key=key))]
    if isinstance(x, lang.Crossed):
        raise Unsupported("a crossjoin within one dimension")
    raise TypeError(type(x))


def _known(d: Dimension, attribute: str) -> None:
    if attribute not in d.attributes:
        raise UnknownName(f"{d.name} has no attribute {attribute}")


def _holds(d: Dimension, m: int, p: object) -> bool:
    if isinstance(p, lang.Logic):
        parts = [_holds(d, m, q) for q in p.parts]
        return not parts[0] if p.op == "NOT" else all(parts) if p.op == "AND" else any(parts)
    a, b = _operand(d, m, p.left), _operand(d, m, p.right)
    if a is None or b is None:
        return False
    if isinstance(a, int) != isinstance(b, int):
        raise TypeMismatch("a text is compared with a number")
    return compare(p.op, a, b)


def _operand(d: Dimension, m: int, x: object) -> str | int | None:
    if isinstance(x, lang.Property):
        _known(d, x.attribute)
        return d.attribute(m, x.attribute)
    return x[1] if x[0] == "text" else fixed.parse(x[1])


def frame(spark: SparkSession, d: Dimension, x: object) -> DataFrame:
    """A set as (pos, id, name, kind), planned on the dimension's frames where the set has a relational form.

    Filter and Order over all members are a filter and a sort of the joined attributes; other
    sets are listed by the driver.
    """
    every = member_frame(spark, d)
    base = x
    steps = []
    while isinstance(base, (lang.Filtered, lang.Ordered)):
        steps.append(base)
        base = base.of
    if isinstance(base, lang.Family) and base.kind == "members":
        members(d, base)
        out = every.select(F.col("idx").cast("bigint").alias("pos"), "id", "name", "kind")
    else:
        listed = local_frame(spark, list(enumerate(members(d, base))), "pos bigint, id int")
        out = listed.join(F.broadcast(every.drop("idx", "pinned")), "id").select("pos", "id", "name", "kind")
    held = attribute_frame(spark, d)
    for step in reversed(steps):
        for a in _named(step):
            _known(d, a)
            one = held.where(F.col("attr") == a).select("id", F.coalesce("s", F.col("n").cast("string")).alias("_s"), F.col("n").alias("_n"))
            out = out.join(one.withColumnsRenamed({"_s": f"_s_{a}", "_n": f"_n_{a}"}), "id", "left")
        if isinstance(step, lang.Filtered):
            out = out.where(_column(d, step.predicate))
        else:
            c = F.col(f"_n_{step.attribute}" if d.attributes[step.attribute] == NUMERIC else f"_s_{step.attribute}")
            order = Window.orderBy(c.desc_nulls_last() if step.descending else c.asc_nulls_first(), F.col("pos"))
            out = out.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
        out = out.select("pos", "id", "name", "kind")
    return out


def _named(x: object) -> list[str]:
    if isinstance(x, lang.Ordered):
        return [x.attribute]
    if isinstance(x, lang.Filtered):
        return list(dict.fromkeys(_named(x.predicate)))
    if isinstance(x, lang.Logic):
        return [a for p in x.parts for a in _named(p)]
    if isinstance(x, lang.Comparison):
        return [y.attribute for y in (x.left, x.right) if isinstance(y, lang.Property)]
    return []


def _column(d: Dimension, p: object) -> Column:
    """A predicate as a column; each comparison is made false where a side is missing, before any NOT."""
    if isinstance(p, lang.Logic):
        parts = [_column(d, q) for q in p.parts]
        return ~parts[0] if p.op == "NOT" else parts[0] & parts[1] if p.op == "AND" else parts[0] | parts[1]

    def side(x: object) -> tuple[bool, Column]:
        if isinstance(x, lang.Property):
            number = d.attributes[x.attribute] == NUMERIC
            return number, F.col(f"_n_{x.attribute}" if number else f"_s_{x.attribute}")
        return (False, F.lit(x[1])) if x[0] == "text" else (True, F.lit(fixed.parse(x[1])))

    (na, a), (nb, b) = side(p.left), side(p.right)
    if na != nb:
        raise TypeMismatch("a text is compared with a number")
    return F.coalesce({"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op], F.lit(False))


def flattened(x: object) -> list[object]:
    """The factors of an axis's crossjoin, left to right."""
    return [y for p in x.parts for y in flattened(p)] if isinstance(x, lang.Crossed) else [x]


def dimension_of(x: object) -> str:
    """The dimension an axis set is over: that of its first qualified member."""
    if isinstance(x, lang.Path):
        if len(x.segments) > 1:
            return x.segments[0]
    elif isinstance(x, lang.Family):
        if x.kind == "members" or len(x.path.segments) > 1:
            return x.path.segments[0]
    elif isinstance(x, lang.Literal):
        for p in x.parts:
            try:
                return dimension_of(p)
            except CubeError:
                continue
    elif isinstance(x, (lang.Filtered, lang.Ordered)):
        return dimension_of(x.of)
    raise CubeError("an axis set names its dimension")
