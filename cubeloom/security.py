"""Grants, member access lists, masks, and the audit log."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import Cube
from .errors import Denied
from .local import local_frame
from .operators.masks import Mask

LEVELS = ("none", "read", "write", "admin")


@dataclass
class Policy:
    """Grants by principal (user or group) and object; member lists by (cube, dimension, member)."""

    admins: set[str] = field(default_factory=set)
    groups: dict[str, set[str]] = field(default_factory=dict)
    #: (principal, object) -> level; objects are cube names and (kind, name) of catalog objects.
    grants: dict[tuple[str, object], str] = field(default_factory=dict)
    #: (cube, dimension, member) -> principal -> level; members without a list are open.
    members: dict[tuple[str, str, str], dict[str, str]] = field(default_factory=dict)

    def principals(self, user: str) -> set[str]:
        return {user} | {g for g, who in self.groups.items() if user in who}

    def level(self, user: str, obj: object, scopes: Iterable[object] = ()) -> str:
        """The highest of the user's own, the groups' and the scopes' grants."""
        if user in self.admins:
            return "admin"
        found = [self.grants.get((p, o), "none") for p in self.principals(user) for o in (obj, *scopes)]
        return max(found, key=LEVELS.index)

    def require(self, user: str, obj: object, level: str, scopes: Iterable[object] = ()) -> None:
        if LEVELS.index(self.level(user, obj, scopes)) < LEVELS.index(level):
            raise Denied(f"{user} lacks {level} on {obj}")

    def can_read(self, user: str, public: bool, owner: str | None) -> bool:
        """Catalog objects: public ones, one's own, all for admins."""
        return public or owner == user or user in self.admins

    def member_level(self, user: str, cube: str, dimension: str, member: str) -> str:
        if user in self.admins:
            return "admin"
        listed = self.members.get((cube, dimension, member))
        if listed is None:
            return "admin"
        return max((listed.get(p, "none") for p in self.principals(user)), key=LEVELS.index)

    def mask(self, user: str, cube: Cube) -> Mask:
        """Members a user may not read; none for admins and unknown users, who are stopped elsewhere."""
        known = user in self.admins or any(p in self.principals(user) for p, _ in self.grants) or any(user in who for who in self.groups.values())
        if user in self.admins or not known:
            return Mask()
        denied: dict[int, list[int]] = {}
        for (c, dimension, member), _ in self.members.items():
            if c == cube.name and self.member_level(user, c, dimension, member) == "none":
                at = cube.position(dimension)
                denied.setdefault(at, []).append(cube.dimensions[at].exact(member))
        return Mask(denied)

    def check_writes(self, user: str, cube: Cube, writes: DataFrame) -> None:
        """Refuse a batch that touches a member the user can't write; a failing check refuses as well."""
        self.require(user, cube.name, "write")
        for at, d in enumerate(cube.dimensions):
            closed = [d.exact(m) for (c, dim, m) in self.members if c == cube.name and dim == d.name and LEVELS.index(self.member_level(user, c, dim, m)) < LEVELS.index("write")]
            if closed and writes.where(F.col(f"d{at}").isin(closed)).limit(1).count():
                raise Denied(f"{user} can't write some members of {d.name}")


def shared_denials(policy: Policy, user: str, cubes: Sequence[Cube], dimension: str) -> set[str]:
    """Members of a shared dimension that are denied in any cube that holds it."""
    out: set[str] = set()
    for c in cubes:
        if any(d.name == dimension for d in c.dimensions):
            at = c.position(dimension)
            out |= {c.dimensions[at].members[m].name for m in policy.mask(user, c).denied.get(at, ())}
    return out


AUDIT = "seq bigint, at_ms bigint, actor string, action string, object string, outcome string"


class Audit:
    """An append-only table of actions; ``path`` holds one Parquet file set, or rows stay in the session."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self._rows = spark, path, []

    def append(self, at_ms: int, actor: str, action: str, obj: str, outcome: str = "ok") -> None:
        self._rows.append((len(self._rows), at_ms, actor, action, obj, outcome))
        if self.path:
            local_frame(self.spark, self._rows[-1:], AUDIT).write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(AUDIT).parquet(self.path) if self.path and self._rows else local_frame(self.spark, self._rows, AUDIT)

    def query(self, wanted: Mapping[str, str] | None = None, since: int | None = None, until: int | None = None, limit: int = 100) -> DataFrame:
        return audit_query(self.frame(), wanted or {}, since, until, limit)


def audit_query(log: DataFrame, wanted: Mapping[str, str], since: int | None = None, until: int | None = None, limit: int = 100) -> DataFrame:
    """Newest entries that fit: equal actor, action or outcome, and a time range."""
    out = log
    for column, value in wanted.items():
        out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(F.col("at_ms") >= since)
    if until is not None:
        out = out.where(F.col("at_ms") < until)
    return out.orderBy(F.desc("at_ms"), F.desc("seq")).limit(limit)


def retained(log: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """Entries young enough to keep."""
    return log.where(F.col("at_ms") >= now_ms - keep_ms)
