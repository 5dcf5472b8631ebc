"""Versioned storage: every commit writes a new immutable directory and then names it current.

    <root>/<cube>/v00000007/{cells,strings,sandbox-<name>,meta.json}   a whole cube
    <root>/<cube>/v00000008/{delta,meta.json}                          cells written since

Batches of cells are appended as deltas, which cost what they hold; a reader takes the newest
value of each coordinate over the last whole version and the deltas since, of which there are
at most ``MOST_DELTAS``: the next batch then writes the cube as a whole.

A version becomes visible when its ``meta.json`` exists; it is created last and never
rewritten, so a commit that breaks off leaves nothing that a reader would take up.  Paths go
through Hadoop's file systems, so the root can be any store that Spark writes.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import Cube, cell_schema
from .errors import Conflict, UnknownName
from .operators.writes import last_writes, write_cells
from .sources.modeltext import dimension_document, dimension_from


#: Deltas after a whole version, at most.
MOST_DELTAS = 32


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._hadoop), p

    def _read(self, path: str) -> str | None:
        fs, p = self._path(path)
        if not fs.exists(p):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())

    def _create(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet: the atomic step of a commit."""
        fs, p = self._path(path)
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def versions(self, cube: str) -> list[int]:
        fs, p = self._path(f"{self.root}/{cube}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._path(f"{self.root}/{cube}/{n}/meta.json")[0].exists(self._path(f"{self.root}/{cube}/{n}/meta.json")[1]))

    def _at(self, cube: str, version: int) -> str:
        return f"{self.root}/{cube}/v{version:08d}"

    def commit(self, cube: Cube, base: int | None = None, partition_by: str | None = None, note: dict | None = None) -> Cube:
        """Write a cube as the next version and return it as read back.

        ``base`` is the version it was derived from; another current version is a conflict.
        ``partition_by`` names a dimension of few members (a measure, a version) to partition cells by.
        """
        current = (self.versions(cube.name) or [0])[-1]
        if base is not None and base != current:
            raise Conflict(f"{cube.name} is at version {current}, not {base}")
        version = current + 1
        at = self._at(cube.name, version)
        writer = cube.cells.write.mode("overwrite")
        (writer.partitionBy(f"d{cube.position(partition_by)}") if partition_by else writer).parquet(f"{at}/cells")
        cube.strings.write.mode("overwrite").parquet(f"{at}/strings")
        for name, frame in cube.sandboxes.items():
            frame.write.mode("overwrite").parquet(f"{at}/sandbox-{name}")
        # Ids of members and the order of edges are kept, so cells of older versions stay readable.
        ids = {d.name: [[m.id, m.name] for m in d] for d in cube.dimensions}
        edges = {d.name: [[p, c, w] for (p, c), w in d.edges.items()] for d in cube.dimensions}
        meta = {"name": cube.name, "rules": cube.rules, "sandboxes": sorted(cube.sandboxes), "dimensions": [dimension_document(d) for d in cube.dimensions], "ids": ids, "edges": edges, "note": note}
        if not self._create(f"{at}/meta.json", json.dumps(meta)):
            raise Conflict(f"version {version} of {cube.name} was committed meanwhile")
        return self.load(cube.name, version)

    def _meta(self, cube: str, version: int) -> dict:
        return json.loads(self._read(f"{self._at(cube, version)}/meta.json") or "")

    def _whole(self, cube: str, version: int) -> int:
        """The whole version that a version is read from."""
        return self._meta(cube, version).get("whole", version)

    def append(self, cube: Cube, batch: DataFrame, base: int | None = None, note: dict | None = None) -> Cube:
        """The next version: the current one with a batch (d0.., v, ord) of checked cells, last write wins, zeros delete.

        ``note`` is kept with the version (the batch of a stream, say).
        """
        current = (self.versions(cube.name) or [0])[-1]
        if base is not None and base != current:
            raise Conflict(f"{cube.name} is at version {current}, not {base}")
        if not current:
            return self.commit(write_cells(cube, batch, check=False), note=note)
        whole = self._whole(cube.name, current)
        version = current + 1
        if version - whole > MOST_DELTAS:
            return self.commit(write_cells(self.load(cube.name, current), batch, check=False), current, note=note)
        at = self._at(cube.name, version)
        last_writes(batch, cube.keys).withColumn("ord", F.lit(version)).write.mode("overwrite").parquet(f"{at}/delta")
        if not self._create(f"{at}/meta.json", json.dumps({"whole": whole, "note": note})):
            raise Conflict(f"version {version} of {cube.name} was committed meanwhile")
        return self.load(cube.name, version)

    def noted(self, cube: str, key: str) -> object | None:
        """The last value noted under a key, None if there is none."""
        for v in reversed(self.versions(cube)):
            note = self._meta(cube, v).get("note") or {}
            if key in note:
                return note[key]
        return None

    def load(self, cube: str, version: int | None = None) -> Cube:
        """A version (the last by default)."""
        known = self.versions(cube)
        version = version if version is not None else (known or [0])[-1]
        if version not in known:
            raise UnknownName(f"no version {version} of {cube}")
        whole = self._whole(cube, version)
        at, meta = self._at(cube, whole), self._meta(cube, whole)
        dims = []
        for doc in meta["dimensions"]:
            d = dimension_from(doc)
            new = {d.exact(name): i for i, name in meta["ids"][d.name]}
            d = replace(d, members={new[i]: replace(m, id=new[i]) for i, m in d.members.items()}, order=[new[i] for i in d.order], edges={(p, c): w for p, c, w in meta["edges"][d.name]}, values={(new[i], a): v for (i, a), v in d.values.items()})
            dims.append(d)
        n = len(dims)
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{at}/{name}")
        keys = [f"d{i}" for i in range(n)]
        boxes = {s: read(f"sandbox-{s}", cell_schema(n)) for s in meta["sandboxes"]}
        cells = read("cells", cell_schema(n)).select(*keys, "v")
        if version > whole:
            deltas = self.spark.read.schema(cell_schema(n, "v bigint, ord int")).parquet(*[f"{self._at(cube, v)}/delta" for v in range(whole + 1, version + 1)])
            cells = last_writes(cells.withColumn("ord", F.lit(0)).unionByName(deltas), keys).where("v <> 0")
        return Cube(cube, tuple(dims), cells, read("strings", cell_schema(n, "s string")), meta["rules"], version, boxes)

    def compact(self, cube: str, keep: int = 1) -> None:
        """Delete all but the last versions, and those that these are read from."""
        known = self.versions(cube)
        first = min((self._whole(cube, v) for v in known[-keep:]), default=0)
        for v in (v for v in known if v < first):
            fs, p = self._path(self._at(cube, v))
            fs.delete(p, True)

    def changes(self, cube: str, old: int, new: int):
        """Cells that differ between two versions: (d0.., before, after)."""
        a, b = self.load(cube, old), self.load(cube, new)
        both = a.cells.withColumnRenamed("v", "before").join(b.cells.withColumnRenamed("v", "after"), a.keys, "full_outer")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
        return both.select(*a.keys, zero("before"), zero("after")).where("before <> after")
