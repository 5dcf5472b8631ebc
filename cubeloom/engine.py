"""The engine: cubes, shared dimensions, catalog, automation and the view cache behind one object.

Method names follow the operations of a planning server; every write publishes a new version
of one cube and readers keep the version they hold.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .cube import Cube
from .dimension import Dimension
from .errors import Conflict, CubeError, InvalidEdit, UnknownName
from .functions import fixed
from .local import written
from .mdx import language as mdx
from .mdx import sets
from .operators import overlay, spread, writes
from .operators.masks import Mask
from .plans import view as views
from .plans.regions import Evaluator
from .rules import feeders, provenance
from .rules import testing as rule_tests
from .rules.compiled import compile_rules, dependencies
from .sources.modeltext import Model
from .store import Store

MOST_CACHED_CELLS = 1 << 20
SAVED_POOL, ADHOC_POOL = 256, 64
#: Without a store, every so many versions a cube's cells are written out, so that plans don't grow.
MOST_NESTED = 16


class ViewCache:
    """Recently used cellsets.  The key holds the version of every cube that the view's rules reach."""

    def __init__(self, most: int):
        self.most, self.kept = most, OrderedDict()

    def get(self, key, compute):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        out = compute()
        if len(out.rows) * len(out.columns) <= MOST_CACHED_CELLS:
            self.kept[key] = out
            while len(self.kept) > self.most:
                self.kept.popitem(last=False)[1].cells.unpersist()
        return out


@dataclass
class Shared:
    dimension: Dimension
    generation: int = 1
    cubes: set[str] = field(default_factory=set)


class Engine:
    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store
        self.models: dict[str, Model] = {}
        self.shared: dict[str, Shared] = {}
        self.automation: dict[str, dict[str, object]] = {"flow": {}, "flow_test": {}, "connection": {}, "job": {}}
        self.events: list[tuple[int, str, str, int]] = []
        #: (cube, stream) -> the last batch of a stream that was committed.
        self.batches: dict[tuple[str, str], int] = {}
        self._saved, self._adhoc = ViewCache(SAVED_POOL), ViewCache(ADHOC_POOL)

    # Cubes

    @property
    def cubes(self) -> Mapping[str, Cube]:
        return {n: m.cube for n, m in self.models.items()}

    def cube(self, name: str) -> Cube:
        if name not in self.models:
            raise UnknownName(f"no cube {name}")
        return self.models[name].cube

    def publish(self, cube: Cube, kind: str = "cells", base: int | None = None) -> Cube:
        """Make a cube the current version, stored first if there is a store."""
        if self.store:
            cube = self.store.commit(cube, base)
        elif cube.version % MOST_NESTED == MOST_NESTED - 1:
            cube = replace(cube, cells=written(cube.cells, "cells"))
        return self._current(cube, kind)

    def _current(self, cube: Cube, kind: str) -> Cube:
        if cube.name in self.models:
            self.models[cube.name].cube = cube
        else:
            self.models[cube.name] = Model(cube)
        self.events.append((len(self.events), cube.name, kind, cube.version))
        return cube

    def create_cube(self, name: str, dimensions: Sequence[Dimension | str]) -> Cube:
        """Dimensions, or names of shared ones, of which the cube holds copies."""
        if name in self.models:
            raise CubeError(f"cube {name} exists")
        made = [self.shared[d].dimension.copy() if isinstance(d, str) else d for d in dimensions]
        out = self.publish(Cube.empty(self.spark, name, made), "created")
        for d in dimensions:
            if isinstance(d, str):
                self.shared[d].cubes.add(name)
        return out

    def delete_cube(self, name: str) -> None:
        self.cube(name)
        del self.models[name]
        for s in self.shared.values():
            s.cubes.discard(name)

    # Shared dimensions

    def create_dimension(self, dimension: Dimension) -> None:
        if dimension.name in self.shared:
            raise CubeError(f"dimension {dimension.name} exists")
        self.shared[dimension.name] = Shared(dimension)

    def promote(self, cube: str, dimension: str) -> None:
        """Make a cube's own dimension a shared one."""
        self.create_dimension(self.cube(cube).dimension(dimension).copy())
        self.shared[dimension].cubes.add(cube)

    def delete_dimension(self, name: str) -> None:
        if self.shared[name].cubes:
            raise InvalidEdit(f"{name} is in use by {sorted(self.shared[name].cubes)}")
        del self.shared[name]

    def edit_dimension(self, name: str, edit: str, *args, **kw) -> list[str]:
        """An edit (a method of Dimension; members by id) of a shared dimension and all cubes that hold it; cubes that refuse it are returned."""
        s = self.shared[name]
        changed = s.dimension.copy()
        getattr(changed, edit)(*args, **kw)
        failed = []
        for c in sorted(s.cubes):
            try:
                self.publish(writes.edited(self.cube(c), name, edit, *args, **kw), "dimension")
            except CubeError:
                failed.append(c)
        s.dimension, s.generation = changed, s.generation + 1
        return failed

    # Cells

    def read_cells(self, cube: str, coordinates: Iterable[dict[str, str]], sandbox: str | None = None, mask: Mask | None = None) -> DataFrame:
        """(ord, d0.., v, s, kind, editable, overlaid) of listed coordinates, rules included, read as one region."""
        listed = list(coordinates)
        c = self.cube(cube)
        at = [c.coordinate(x) for x in listed]
        region = [{x[i] for x in at} for i in range(c.rank)]
        found = Evaluator(self.cubes, sandbox, mask, target=cube).values(cube, region) if at else c.cells.limit(0)
        return writes.bulk_read(c, listed, found, sandbox)

    def write_cells(self, cube: str, cells: Iterable[tuple[dict[str, str], str]], base: int | None = None, sandbox: str | None = None) -> Cube:
        """One atomic batch of decimal texts; the last write to a coordinate wins."""
        c = self.cube(cube)
        listed = [(c.coordinate(names), fixed.parse(v)) for names, v in cells]
        if sandbox:
            return self.publish(overlay.write(c, sandbox, listed), "sandbox")
        for at, _ in listed:
            c.check_write(at)
        return self._write(c, writes.batch(c, listed), base)

    def _write(self, c: Cube, frame: DataFrame, base: int | None, note: dict | None = None) -> Cube:
        """A checked batch as the next version: a delta where there is a store."""
        if base is not None and base != c.version:
            raise Conflict(f"{c.name} is at version {c.version}, not {base}")
        if self.store:
            return self._current(self.store.append(c, frame, base, note), "cells")
        return self.publish(writes.write_cells(c, frame, base, check=False))

    def write_frame(self, cube: str, frame: DataFrame, base: int | None = None, note: dict | None = None) -> Cube:
        """One atomic batch of any size: (d0.., v, ord); ``note`` is stored with the version."""
        writes.check_kinds(self.cube(cube), frame)
        return self._write(self.cube(cube), frame, base, note)

    def write_string(self, cube: str, at: dict[str, str], text: str) -> Cube:
        c = self.cube(cube)
        return self.publish(writes.set_string(c, c.coordinate(at), text))

    def read(self, cube: str, *tokens: str) -> str:
        """One value as text, its coordinate given as ``Dimension=Member`` tokens in any order."""
        at = {}
        for t in tokens:
            dimension, sign, member = t.partition("=")
            if not sign or dimension.strip() in at:
                raise CubeError(f"not a Dimension=Member token, or a dimension named twice: {t}")
            at[dimension.strip()] = member.strip()
        row = self.read_cells(cube, [at]).first()
        return row["s"] if row["s"] is not None else fixed.format(row["v"])

    def write_grid(self, cube: str, grid: Sequence[Sequence[str]], base: int | None = None) -> Cube:
        """One batch from a table: a header of all dimensions and ``Value``, then rows of names; blank rows are skipped."""
        head = [h.strip() for h in grid[0]]
        if "Value" not in head or set(head) - {"Value"} != {d.name for d in self.cube(cube).dimensions}:
            raise CubeError("the header names every dimension and Value")
        rows = [dict(zip(head, map(str.strip, r))) for r in grid[1:] if any(c.strip() for c in r)]
        return self.write_cells(cube, [({k: v for k, v in r.items() if k != "Value"}, r["Value"]) for r in rows], base)

    def spread(self, cube: str, at: dict[str, str], value: str, method: str = "equal", sandbox: str | None = None) -> Cube:
        c = self.cube(cube)
        target = c.coordinate(at)
        basis = None
        if method == "proportional":
            region = [list(d.leaf_weights(m)) for d, m in zip(c.dimensions, target)]
            basis = Evaluator(self.cubes, sandbox, target=cube).values(cube, region)
        rows = spread.spread(c, target, fixed.parse(value), method, basis)
        if sandbox:
            return self.publish(overlay.write(c, sandbox, [(tuple(r[k] for k in c.keys), r["v"]) for r in rows.collect()]), "sandbox")
        return self.write_frame(cube, rows)

    def edit(self, cube: str, dimension: str, edit: str, *args, **kw) -> Cube:
        if dimension in self.shared and cube in self.shared[dimension].cubes:
            raise InvalidEdit(f"{dimension} is shared")
        return self.publish(writes.edited(self.cube(cube), dimension, edit, *args, **kw), "model")

    # Sandboxes

    def create_sandbox(self, cube: str, name: str) -> Cube:
        return self.publish(overlay.create(self.cube(cube), name), "sandbox")

    def commit_sandbox(self, cube: str, name: str) -> Cube:
        return self.publish(overlay.commit(self.cube(cube), name))

    def discard_sandbox(self, cube: str, name: str) -> Cube:
        return self.publish(overlay.discard(self.cube(cube), name), "sandbox")

    # Subsets, views and queries

    def define_subset(self, cube: str, name: str, dimension: str, body: Sequence[str] | str) -> None:
        """A static list of names, or MDX text."""
        d = self.cube(cube).dimension(dimension)
        if isinstance(body, str):
            sets.members(d, mdx.parse_set(body))
        self.models[cube].subsets[name] = (dimension, body if isinstance(body, str) else tuple(body))

    def subset(self, cube: str, name: str) -> list[str]:
        """A subset's members by name, distinct and in order."""
        try:
            dimension, body = self.models[cube].subsets[name]
        except KeyError:
            raise UnknownName(f"no subset {name}") from None
        d = self.cube(cube).dimension(dimension)
        ids = sets.members(d, mdx.parse_set(body)) if isinstance(body, str) else list(dict.fromkeys(map(d.resolve, body)))
        return [d.members[i].name for i in ids]

    def preview_set(self, cube: str, dimension: str, text: str, mask: Mask | None = None) -> list[str]:
        c = self.cube(cube)
        at = c.position(dimension)
        d = c.dimensions[at]
        return [d.members[i].name for i in sets.members(d, mdx.parse_set(text)) if not (mask or Mask()).taints(at, d, i)]

    def define_view(self, cube: str, name: str, view: views.View) -> None:
        views._placed(self.cube(cube), view, Mask())
        self.models[cube].views[name] = view

    def delete(self, cube: str, kind: str, name: str) -> None:
        """Remove a subset, view or test; a missing one is an error."""
        held = getattr(self.models[cube], {"subset": "subsets", "view": "views", "test": "tests"}[kind])
        if name not in held:
            raise UnknownName(f"no {kind} {name}")
        del held[name]

    def _key(self, cube: str, view: views.View, sandbox: str | None, mask: Mask | None):
        versions = tuple((n, self.models[n].cube.version, id(self.models[n].cube)) for n in dependencies(self.cubes, cube))
        return cube, view, sandbox, mask or Mask(), versions

    def execute_view(self, cube: str, name: str, sandbox: str | None = None, mask: Mask | None = None) -> views.Cellset:
        view = self.models[cube].views.get(name)
        if view is None:
            raise UnknownName(f"no view {name}")
        return self._saved.get(self._key(cube, view, sandbox, mask), lambda: views.execute(self.cubes, cube, view, sandbox, mask))

    def execute(self, cube: str, view: views.View, sandbox: str | None = None, mask: Mask | None = None) -> views.Cellset:
        self.cube(cube)
        return self._adhoc.get(self._key(cube, view, sandbox, mask), lambda: views.execute(self.cubes, cube, view, sandbox, mask))

    def mdx(self, text: str, sandbox: str | None = None, mask: Mask | None = None) -> views.Cellset:
        query = mdx.parse_query(text)
        name = query.cube.segments[-1]
        return self.execute(name, views.view_of(self.cube(name), query), sandbox, mask)

    # Rules

    def define_rules(self, cube: str, source: str) -> Cube:
        """Set a cube's rules; a text that doesn't compile is refused and nothing changes."""
        c = self.cube(cube)
        compile_rules(c, self.cubes, source)
        return self.publish(replace(c, rules=source, version=c.version + 1), "rules")

    def preview_rules(self, cube: str, source: str) -> str | None:
        """What is wrong with a rules text, None if nothing."""
        try:
            compile_rules(self.cube(cube), self.cubes, source)
        except CubeError as e:
            return str(e)
        return None

    def explain(self, cube: str, at: dict[str, str], depth: int = 1, sandbox: str | None = None) -> provenance.Trace:
        return provenance.explain(Evaluator(self.cubes, sandbox, target=cube), cube, self.cube(cube).coordinate(at), depth)

    def feeders(self, cube: str) -> feeders.Validation:
        return feeders.validate(self.cubes, cube)

    def define_test(self, cube: str, test: rule_tests.RuleTest) -> None:
        self.models[cube].tests[test.name] = test

    def run_tests(self, cube: str) -> dict[str, list[rule_tests.Failure]]:
        return rule_tests.run_all(self.cube(cube), list(self.models[cube].tests.values()))

    # Automation

    def define(self, kind: str, name: str, value: object) -> None:
        """A flow, flow test, connection or job; these belong to no cube."""
        self.automation[kind][name] = value

    def undefine(self, kind: str, name: str) -> None:
        if name not in self.automation[kind]:
            raise UnknownName(f"no {kind} {name}")
        del self.automation[kind][name]
