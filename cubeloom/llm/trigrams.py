"""Boolean trigram queries derived from regular expressions.

A query is ``True`` (no mandatory trigram: scan fully), a trigram string, or
``("and"|"or", (queries...))``.  A text that matches the expression satisfies its query when
both are taken in lower case.
"""

from __future__ import annotations

import re
from itertools import product

_parse = re._parser.parse
_c = re._constants
#: Exact alternatives are multiplied out up to this many strings.
MOST_STRINGS = 48
MOST_CLASS = 6


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    flat = tuple(dict.fromkeys(q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(parts: list):
    if not parts or any(p is True for p in parts):
        return True
    flat = tuple(dict.fromkeys(q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "or" else [p])))
    return flat[0] if len(flat) == 1 else ("or", flat)


def _grams(s: str):
    return _all([s[i : i + 3] for i in range(len(s) - 2)])


class _Walk:
    """Concatenation keeps a set of exact strings of the current stretch; what can't be kept exact closes the stretch."""

    def __init__(self) -> None:
        self.parts: list = []
        self.strings = [""]

    def close(self) -> None:
        self.parts.append(_any([_grams(s) for s in self.strings]))
        self.strings = [""]

    def times(self, options: list[str]) -> None:
        if len(self.strings) * len(options) > MOST_STRINGS:
            self.close()
        if len(options) <= MOST_STRINGS:
            self.strings = ["".join(p) for p in product(self.strings, options)]
        else:
            self.close()


def _exact(items) -> list[str] | None:
    """All strings a sub-expression matches, if they are few."""
    out = [""]
    for op, arg in items:
        if op is _c.LITERAL:
            more = [chr(arg).lower()]
        elif op is _c.IN:
            more = _members(arg)
        elif op is _c.SUBPATTERN:
            more = _exact(arg[3])
        elif op is _c.BRANCH:
            each = [_exact(x) for x in arg[1]]
            more = None if any(x is None for x in each) else [s for x in each for s in x]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 2:
            one = _exact(arg[2])
            more = None if one is None else [s for n in range(arg[0], int(arg[1]) + 1) for s in map("".join, product(one, repeat=n))]
        elif op is _c.AT:
            more = [""]
        else:
            more = None
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = list(dict.fromkeys("".join(p) for p in product(out, more)))
    return out


def _members(arg) -> list[str] | None:
    out: list[str] = []
    for op, x in arg:
        if op is _c.LITERAL:
            out.append(chr(x).lower())
        elif op is _c.RANGE and x[1] - x[0] < MOST_CLASS:
            out += [chr(i).lower() for i in range(x[0], x[1] + 1)]
        else:
            return None
    out = list(dict.fromkeys(out))
    return out if len(out) <= MOST_CLASS else None


def _walk(items) -> object:
    w = _Walk()
    for op, arg in items:
        few = _exact([(op, arg)])
        if few is not None:
            w.times(few)
        elif op is _c.SUBPATTERN:
            w.close()
            w.parts.append(_walk(arg[3]))
        elif op is _c.BRANCH:
            w.close()
            w.parts.append(_any([_walk(x) for x in arg[1]]))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            if arg[0] >= 1 and (few := _exact(arg[2])) is not None:
                w.times(few)
                w.close()
            else:
                w.close()
                if arg[0] >= 1:
                    w.parts.append(_walk(arg[2]))
        else:
            w.close()
    w.close()
    return _all(w.parts)


def query(pattern: str):
    """The Boolean trigram query of a regular expression (Python's dialect without flags)."""
    return _walk(_parse(pattern))


def trigrams(q) -> list[str]:
    """All trigrams a query names."""
    if q is True:
        return []
    if isinstance(q, str):
        return [q]
    return list(dict.fromkeys(t for x in q[1] for t in trigrams(x)))


def holds(q, text: str) -> bool:
    """Whether a text satisfies a query."""
    if q is True:
        return True
    if isinstance(q, str):
        return q in text.lower()
    return (all if q[0] == "and" else any)(holds(x, text) for x in q[1])


def ways(q) -> list[list[str]]:
    """The query as alternatives of trigrams that must all be there; alternatives that ask more than another are left out."""
    if isinstance(q, str):
        return [[q]]
    parts = [ways(x) for x in q[1]]
    found = [frozenset(w) for p in parts for w in p] if q[0] == "or" else [frozenset(t for w in p for t in w) for p in product(*parts)]
    found = list(dict.fromkeys(found))
    return [sorted(w) for w in found if not any(o < w for o in found)]
