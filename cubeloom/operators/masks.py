"""Member-level access: denied members, and coordinates tainted by them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from ..cube import Cube, within
from ..dimension import Dimension


class Mask:
    """Denied member ids by dimension position."""

    def __init__(self, denied: Mapping[int, Iterable[int]] | None = None):
        self.denied = {i: frozenset(m) for i, m in (denied or {}).items() if m}

    def __bool__(self) -> bool:
        return bool(self.denied)

    def __hash__(self) -> int:
        return hash(tuple(sorted((i, tuple(sorted(m))) for i, m in self.denied.items())))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Mask) and self.denied == other.denied

    def denies(self, position: int, member: int) -> bool:
        return member in self.denied.get(position, ())

    def taints(self, position: int, d: Dimension, member: int) -> bool:
        """A member that is denied or rolls up a denied leaf."""
        gone = self.denied.get(position, frozenset())
        return member in gone or bool(gone & d.leaf_weights(member).keys())

    def tainted(self, position: int, d: Dimension) -> set[int]:
        return {m.id for m in d if self.taints(position, d, m.id)} if position in self.denied else set()

    @classmethod
    def union(cls, masks: Iterable[Mask]) -> Mask:
        out: dict[int, set[int]] = {}
        for m in masks:
            for i, gone in m.denied.items():
                out.setdefault(i, set()).update(gone)
        return cls(out)


def allowed(cube: Cube, mask: Mask, frame: DataFrame, strict: bool = True) -> DataFrame:
    """Rows by coordinate that touch no tainted (``strict``) or no denied member."""
    out = frame
    for i, d in enumerate(cube.dimensions):
        gone = mask.tainted(i, d) if strict else mask.denied.get(i, frozenset())
        if gone:
            out = within(out, f"d{i}", gone, False).select(frame.columns)
    return out
