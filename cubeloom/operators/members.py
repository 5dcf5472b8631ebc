"""Member tables: search, column filters, selections, sorting, and the drill-down forest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dimension import Dimension
from ..local import local_frame


def matcher(pattern: str) -> str:
    """A regular expression for a search text: any letter case, ``*`` and ``?`` as wildcards, anywhere in the text."""
    return "(?is)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def _fits(column: Column, pattern: str) -> Column:
    return F.coalesce(column, F.lit("")).rlike(matcher(pattern))


def search(members: DataFrame, pattern: str, labels: DataFrame | None = None) -> DataFrame:
    """Members whose name, or label (id, label), fits."""
    if labels is None:
        return members.where(_fits(F.col("name"), pattern))
    joined = members.join(labels, "id", "left")
    return joined.where(_fits(F.col("name"), pattern) | _fits(F.col("label"), pattern)).select(members.columns)


def filtered(members: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Members that fit a search text in every named column; missing values count as empty."""
    out = members
    for column, pattern in columns.items():
        out = out.where(_fits(F.col(column).cast("string"), pattern))
    return out


def selection(members: DataFrame, ids: Iterable[int], keep: bool = True) -> DataFrame:
    """Only, or all but, some members."""
    chosen = local_frame(members.sparkSession, [(i,) for i in ids], "id int")
    return members.join(F.broadcast(chosen), "id", "left_semi" if keep else "left_anti")


def without_children(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with no child, whatever their kind."""
    return members.join(edges.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")


def ordered(members: DataFrame, by: str = "idx", descending: bool = False) -> DataFrame:
    """By model order, name, kind or an attribute: as numbers where all values are, else as texts."""
    if by == "idx":
        return members.orderBy("idx")
    column = F.col(by).cast("string")
    texts = members.where(column.isNotNull() & column.try_cast("double").isNull()).limit(1).count()
    key = column if texts else column.cast("double")
    return members.orderBy(key.desc() if descending else key.asc(), "idx")


def forest(d: Dimension, expanded: Iterable[str] = ()) -> list[tuple[str, int, str]]:
    """The drill-down tree as (key, depth, name): roots are members without parents, keys are paths; only expanded keys are opened."""
    opened, out = set(expanded), []

    def walk(m: int, path: str, depth: int, above: tuple[int, ...]) -> None:
        key = f"{path}/{d.members[m].name}" if path else d.members[m].name
        out.append((key, depth, d.members[m].name))
        if key in opened:
            for c in d.children(m):
                if c not in above:
                    walk(c, key, depth + 1, (*above, m))

    for m in d:
        if not d.parents(m.id):
            walk(m.id, "", 0, ())
    return out


def expandable(d: Dimension) -> list[str]:
    """Every key that can be opened."""
    keys: list[str] = []

    def walk(m: int, path: str, above: tuple[int, ...]) -> None:
        key = f"{path}/{d.members[m].name}" if path else d.members[m].name
        below = [c for c in d.children(m) if c not in above]
        if below:
            keys.append(key)
            for c in below:
                walk(c, key, (*above, m))

    for m in d:
        if not d.parents(m.id):
            walk(m.id, "", ())
    return keys


def slug(name: str) -> str:
    """A safe file name: lower case, runs of other characters as one dash."""
    return re.sub(r"[^a-z0-9_]+", "-", name.lower()).strip("-") or "unnamed"


def slugged(name: Column) -> Column:
    """``slug`` as a column."""
    bare = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "-"), F.lit("-"))
    return F.when(bare == "", "unnamed").otherwise(bare)
