"""Dimensions: ordered members, weighted edges, attributes.

Members have stable ids; their visible order is a separate list, so reordering and inserting
never touch cells.  Dimensions are metadata: planning runs on them in the driver, and what a
query needs of them (a closure of the requested members) goes to Spark as a small frame.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from .errors import InvalidEdit, UnknownName
from .functions import fixed

LEAF, STRING, CONSOLIDATED = "leaf", "string", "consolidated"
TEXT, NUMERIC, ALIAS = "text", "numeric", "alias"


@dataclass(frozen=True)
class Member:
    id: int
    name: str
    kind: str = LEAF
    pinned: bool = False

    @property
    def is_leaf(self) -> bool:
        """Numeric and string leaves."""
        return self.kind != CONSOLIDATED


@dataclass
class Dimension:
    name: str
    members: dict[int, Member] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    #: (parent, child) -> weight, in order of declaration.
    edges: dict[tuple[int, int], int] = field(default_factory=dict)
    #: attribute name -> text, numeric or alias.
    attributes: dict[str, str] = field(default_factory=dict)
    #: (member, attribute) -> text, or scaled number for numeric ones.
    values: dict[tuple[int, str], str | int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._reindex()

    def _reindex(self) -> None:
        self._next = max(self.members, default=-1) + 1
        self._by_name = {m.name: i for i, m in self.members.items()}
        self._by_alias = {v: i for (i, a), v in self.values.items() if self.attributes.get(a) == ALIAS}
        self._place = {i: n for n, i in enumerate(self.order)}
        self._below: dict[int, list[tuple[int, int]]] = {}
        self._above: dict[int, list[int]] = {}
        for (p, c), w in self.edges.items():
            self._below.setdefault(p, []).append((c, w))
            self._above.setdefault(c, []).append(p)

    def copy(self) -> Dimension:
        return Dimension(self.name, dict(self.members), list(self.order), dict(self.edges), dict(self.attributes), dict(self.values))

    # Building

    def add(self, name: str, kind: str = LEAF, at: int | None = None) -> int:
        """A new member, or the id of an equal one; a name in use with another kind is refused."""
        if not name:
            raise InvalidEdit("a member needs a name")
        if name in self._by_name:
            old = self.members[self._by_name[name]]
            if old.kind != kind:
                raise InvalidEdit(f"{name} is already a {old.kind} member of {self.name}")
            return old.id
        new = self._next
        self._next += 1
        self.members[new] = Member(new, name, kind)
        self.order.insert(len(self.order) if at is None else at, new)
        self._by_name[name] = new
        if at is None:
            self._place[new] = len(self.order) - 1
        else:
            self._reindex()
        return new

    def add_child(self, parent: int, child: int, weight: int = 1) -> None:
        if self.members[parent].kind != CONSOLIDATED:
            raise InvalidEdit(f"{self.members[parent].name} can't have children")
        if (parent, child) in self.edges:
            if self.edges[parent, child] != weight:
                raise InvalidEdit("the edge exists with another weight")
            return
        if parent == child or parent in self.reachable(child):
            raise InvalidEdit("the edge would close a cycle")
        self.edges[parent, child] = weight
        self._below.setdefault(parent, []).append((child, weight))
        self._above.setdefault(child, []).append(parent)

    def define_attribute(self, name: str, kind: str = TEXT) -> None:
        if self.attributes.setdefault(name, kind) != kind:
            raise InvalidEdit(f"attribute {name} is {self.attributes[name]}")

    def set_attribute(self, member: int, attribute: str, value: str | int) -> None:
        kind = self.attributes.get(attribute)
        if kind is None:
            raise UnknownName(f"{self.name} has no attribute {attribute}")
        if isinstance(value, int) != (kind == NUMERIC):
            raise InvalidEdit(f"{attribute} takes {kind} values")
        if kind == ALIAS:
            if self._by_alias.get(value, member) != member or self._by_name.get(value, member) != member:
                raise InvalidEdit(f"{value} already names another member")
        self.values[member, attribute] = value
        if kind == ALIAS:
            self._reindex()

    # Looking up

    def __len__(self) -> int:
        return len(self.order)

    def __iter__(self) -> Iterator[Member]:
        return (self.members[i] for i in self.order)

    def place(self, member: int) -> int:
        return self._place[member]

    def by_place(self, ids: Iterable[int]) -> list[int]:
        return sorted(set(ids), key=self._place.__getitem__)

    def exact(self, name: str) -> int:
        """By member name only."""
        if name not in self._by_name:
            raise UnknownName(f"{self.name} has no member {name}")
        return self._by_name[name]

    def resolve(self, name: str) -> int:
        """By member name, else by alias."""
        found = self._by_name.get(name, self._by_alias.get(name))
        if found is None:
            raise UnknownName(f"{self.name} has no member {name}")
        return found

    def kind(self, member: int) -> str:
        return self.members[member].kind

    def attribute(self, member: int, name: str) -> str | int | None:
        return self.values.get((member, name))

    def children(self, member: int) -> list[int]:
        return self.by_place(c for c, _ in self._below.get(member, ()))

    def parents(self, member: int) -> list[int]:
        return self.by_place(self._above.get(member, ()))

    def reachable(self, member: int) -> set[int]:
        """The member and all below it."""
        seen, todo = {member}, [member]
        while todo:
            for c, _ in self._below.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    def descendants(self, member: int) -> list[int]:
        """The member first, then depth first by place; each once."""
        out: dict[int, None] = {}
        todo = [member]
        while todo:
            m = todo.pop()
            if m not in out:
                out[m] = None
                todo.extend(reversed(self.children(m)))
        return list(out)

    def leaf_weights(self, member: int) -> dict[int, int]:
        """Each numeric leaf below once, with the weight of its path of fewest edges (ties by declaration); no zero weights."""
        out: dict[int, int] = {}
        seen = {member}
        todo = deque([(member, 1)])
        while todo:
            m, w = todo.popleft()
            if self.members[m].kind == LEAF:
                out[m] = w
            for c, cw in self._below.get(m, ()):
                if c not in seen:
                    seen.add(c)
                    todo.append((c, max(fixed.LOWEST, min(fixed.HIGHEST, w * cw))))
        return {m: out[m] for m in self.by_place(out) if out[m]}

    def closure(self, ancestors: Iterable[int]) -> list[tuple[int, int, int]]:
        """(ancestor, leaf, weight) of some members; a numeric leaf is its own."""
        return [(a, leaf, w) for a in ancestors for leaf, w in self.leaf_weights(a).items()]

    def leaves(self) -> list[int]:
        return [m.id for m in self if m.is_leaf]

    # Structural edits.  Each returns the members whose cells must go.

    def reorder(self, names: list[str]) -> set[int]:
        ids = [self.exact(n) for n in names]
        if sorted(ids) != sorted(self.order):
            raise InvalidEdit("a new order names every member once")
        self.order = ids
        self._reindex()
        return set()

    def _adopt(self, parent: int) -> set[int]:
        """A leaf that gets a child becomes a consolidation and loses its cells."""
        if self.members[parent].kind == CONSOLIDATED:
            return set()
        self.members[parent] = replace(self.members[parent], kind=CONSOLIDATED)
        return {parent}

    def reparent(self, child: int, parent: int | None, weight: int = 1) -> set[int]:
        """Detach from all parents, then attach to one (or to none)."""
        if parent is not None and parent in self.reachable(child):
            raise InvalidEdit("the edge would close a cycle")
        self.edges = {e: w for e, w in self.edges.items() if e[1] != child}
        self._reindex()
        return set() if parent is None else self.attach(child, parent, weight)

    def attach(self, child: int, parent: int, weight: int = 1) -> set[int]:
        if parent in self.reachable(child):
            raise InvalidEdit("the edge would close a cycle")
        gone = self._adopt(parent)
        self.edges[parent, child] = weight
        self._reindex()
        return gone

    def detach(self, child: int, parent: int) -> set[int]:
        self.edges.pop((parent, child), None)
        self._reindex()
        return set()

    def pin(self, member: int, pinned: bool = True) -> set[int]:
        self.members[member] = replace(self.members[member], pinned=pinned)
        return set()

    def set_kind(self, member: int, kind: str) -> set[int]:
        old = self.members[member]
        if old.kind == kind:
            return set()
        if old.kind == CONSOLIDATED and self._below.get(member):
            raise InvalidEdit(f"{old.name} has children")
        self.members[member] = replace(old, kind=kind)
        return {member}

    def delete(self, member: int) -> set[int]:
        if self._below.get(member):
            raise InvalidEdit(f"{self.members[member].name} has children")
        del self.members[member]
        self.order.remove(member)
        self.edges = {e: w for e, w in self.edges.items() if member not in e}
        self.values = {k: v for k, v in self.values.items() if k[0] != member}
        self._reindex()
        return {member}
