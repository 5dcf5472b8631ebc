"""Connections: named sources of rows, their binding to flow inputs, and their text form."""

from __future__ import annotations

import base64
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import CubeError, UnknownName
from . import readers
from .modeltext import _table

FORMAT = "cubeloom-automation/1"
KINDS = ("command", "http", "postgresql", "mysql", "csv", "json", "inline")


@dataclass(frozen=True)
class Connection:
    """``kind`` and what it takes: argv of a command, a url (http, sql) or path (files), a query, a format and a dotted JSON path.

    Secrets are named, never stored: ``auth`` is basic or bearer, ``secret`` a name.
    """

    kind: str
    argv: tuple[str, ...] = ()
    url: str = ""
    query: str = ""
    text: str = ""
    format: str = "csv"
    json_path: str = ""
    auth: str = ""
    user: str = ""
    secret: str = ""
    timeout: int = readers.TIMEOUT_SECONDS


@dataclass(frozen=True)
class Permissions:
    """What connections may reach; nothing unless said."""

    commands: bool = False
    hosts: tuple[str, ...] = ()
    secrets: Mapping[str, str] = field(default_factory=dict)


def authorization(c: Connection, secrets: Mapping[str, str]) -> dict[str, str]:
    """The header of a request that needs one."""
    if not c.auth:
        return {}
    if c.secret not in secrets:
        raise UnknownName(f"no secret {c.secret}")
    if c.auth == "bearer":
        return {"Authorization": f"Bearer {secrets[c.secret]}"}
    if c.auth == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{c.user}:{secrets[c.secret]}".encode()).decode()}
    raise CubeError(f"no authorization {c.auth}")


def rows(spark: SparkSession, c: Connection, may: Permissions = Permissions()) -> DataFrame:
    """All rows of a connection, every column STRING."""
    if c.kind == "command":
        return readers.parse_output(spark, readers.run_command(c.argv, may.commands, c.timeout), c.format, c.json_path)
    if c.kind == "http":
        return readers.parse_output(spark, readers.fetch(c.url, may.hosts, authorization(c, may.secrets), c.timeout), c.format, c.json_path)
    if c.kind in ("postgresql", "mysql"):
        login = {"user": c.user, "password": may.secrets[c.secret]} if c.secret else {}
        return readers.read_sql(spark, f"jdbc:{c.kind}:{c.url}", c.query, login)
    if c.kind == "csv":
        return readers.read_csv(spark, c.url)
    if c.kind == "json":
        return readers.as_text(spark.read.option("multiLine", True).option("primitivesAsString", True).json(c.url))
    if c.kind == "inline":
        return readers.parse_output(spark, c.text, c.format, c.json_path)
    raise CubeError(f"no kind of connection {c.kind}")


def inputs(spark: SparkSession, names: Sequence[str], known: Mapping[str, Connection], local: Mapping[str, Connection] | None = None, csv: str | None = None, may: Permissions = Permissions()) -> dict[str, DataFrame]:
    """Frames for a flow's inputs: global names, ``local.<name>`` for its own connections; ``csv`` stands in for a single input."""
    if csv is not None:
        if len(names) > 1:
            raise CubeError("an inline text stands for one input only")
        return {names[0] if names else "input": readers.read_csv_text(spark, csv)}
    out = {}
    for n in names:
        table = {f"local.{k}": c for k, c in (local or {}).items()} | dict(known)
        if n not in table:
            raise UnknownName(f"no connection {n}")
        out[n] = rows(spark, table[n], may)
    return out


def write_text(connections: Mapping[str, Connection], jobs: Mapping[str, tuple[str, int, bool]]) -> str:
    """Canonical text of connections and jobs (owner, interval in ms, enabled); flows are code and live in modules."""
    plain = Connection("")
    out = [f'format = "{FORMAT}"\n']
    for n, c in sorted(connections.items()):
        out.append(_table("connection", {"name": n} | {k: v for k, v in asdict(c).items() if k == "kind" or v != getattr(plain, k)}))
    for n, (owner, interval, enabled) in sorted(jobs.items()):
        out.append(_table("job", {"name": n, "owner": owner, "interval_ms": interval, "enabled": enabled}))
    return "\n".join(out)


def read_text(text: str) -> tuple[dict[str, Connection], dict[str, tuple[str, int, bool]]]:
    doc = tomllib.loads(text)
    if doc.get("format") != FORMAT:
        raise CubeError(f"unknown format {doc.get('format')!r}")
    connections = {}
    for c in doc.get("connection", ()):
        name = c.pop("name")
        if c.get("kind") not in KINDS:
            raise CubeError(f"no kind of connection {c.get('kind')}")
        connections[name] = Connection(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()})
    return connections, {j["name"]: (j["owner"], j["interval_ms"], j["enabled"]) for j in doc.get("job", ())}
