"""Sources of text rows: CSV, JSON, commands, HTTP and SQL.  All columns are STRING, missing values empty."""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Mapping, Sequence
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CubeError, Denied, LimitExceeded
from ..local import local_frame

MOST_ROWS = 1_000_000
MOST_BYTES = 16 << 20
PREVIEW_ROWS = 20
TIMEOUT_SECONDS = 30


def csv_records(text: str) -> list[list[str]]:
    """Records of a CSV text: quotes may hold commas, line ends and doubled quotes; a quote in mid-field toggles quoting."""
    out: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    quoted, i = False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            else:
                quoted = not quoted
        elif quoted:
            field.append(c)
        elif c == ",":
            row.append("".join(field))
            field = []
        elif c == "\n":
            row.append("".join(field))
            out.append(row)
            row, field = [], []
        elif c != "\r":
            field.append(c)
        i += 1
    if field or row:
        out.append([*row, "".join(field)])
    return [r for r in out if r != [""]]


def read_csv_text(spark: SparkSession, text: str, most: int = MOST_ROWS) -> DataFrame:
    """A CSV text as rows: the header names the columns; short records are filled with empty texts, extra fields dropped."""
    records = csv_records(text)
    if not records:
        return local_frame(spark, [], "value string")
    head, body = records[0], records[1:]
    if len(body) > most:
        raise LimitExceeded(f"{len(body)} rows, at most {most}")
    rows = [tuple((r + [""] * len(head))[: len(head)]) for r in body]
    return local_frame(spark, rows, ", ".join(f"`{h}` string" for h in head))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of any size, read in parallel by Spark."""
    frame = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False, nullValue=None, emptyValue="")
    return frame.na.fill("")


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def read_json_text(spark: SparkSession, text: str, path: str = "", most: int = MOST_ROWS) -> DataFrame:
    """An array of objects, below a dotted path if given; scalars become texts, null empty, nested values compact JSON."""
    if not text.strip():
        return local_frame(spark, [], "value string")
    value = json.loads(text)
    for step in filter(None, path.split(".")):
        if not isinstance(value, dict) or step not in value:
            raise CubeError(f"no {step} in the JSON text")
        value = value[step]
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise CubeError("the JSON value is not an array of objects")
    if len(value) > most:
        raise LimitExceeded(f"{len(value)} rows, at most {most}")
    names = list(dict.fromkeys(k for x in value for k in x))
    if not names:
        return local_frame(spark, [], "value string")
    return local_frame(spark, [tuple(_text(x.get(n)) for n in names) for x in value], ", ".join(f"`{n}` string" for n in names))


def read_json_column(frame: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """Fields of a JSON text column as STRING columns, parsed by the engine in parallel."""
    parsed = F.from_json(column, "map<string,string>")
    return frame.select("*", *[F.coalesce(parsed[f], F.lit("")).alias(f) for f in fields])


def parse_output(spark: SparkSession, text: str, kind: str, path: str = "") -> DataFrame:
    """Rows of a text in format csv or json; an empty text has none."""
    if kind == "csv":
        return read_csv_text(spark, text)
    if kind == "json":
        return read_json_text(spark, text, path)
    raise CubeError(f"no format {kind}")


def run_command(argv: Sequence[str], allowed: bool = False, timeout: float = TIMEOUT_SECONDS, most: int = MOST_BYTES) -> str:
    """Output of a fixed command line without a shell; must be allowed explicitly."""
    if not allowed:
        raise Denied("commands are not enabled")
    try:
        done = subprocess.run(list(argv), capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired as e:
        raise CubeError(f"the command took more than {timeout} s") from e
    if done.returncode:
        raise CubeError(f"the command failed with {done.returncode}")
    if len(done.stdout) > most:
        raise LimitExceeded(f"more than {most} bytes")
    return done.stdout.decode()


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *a, **k):
        raise CubeError("the server redirects")


def fetch(url: str, hosts: Sequence[str], headers: Mapping[str, str] | None = None, timeout: float = TIMEOUT_SECONDS, most: int = MOST_BYTES) -> str:
    """Body of a GET from an allowed host, without redirects."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or parts.hostname not in hosts:
        raise Denied(f"{parts.hostname} is not an allowed host")
    opener = urllib.request.build_opener(_NoRedirect)
    with opener.open(urllib.request.Request(url, headers=dict(headers or {})), timeout=timeout) as r:
        body = r.read(most + 1)
    if len(body) > most:
        raise LimitExceeded(f"more than {most} bytes")
    return body.decode()


_PLAIN = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string"}


def as_text(frame: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """All columns as STRING with empty texts for NULL; types other than numbers, booleans and texts must be named in ``more``."""
    for name, kind in frame.dtypes:
        if kind not in _PLAIN and kind.split("(")[0] not in more:
            raise CubeError(f"column {name} has type {kind}")
    return frame.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in frame.columns])


def read_sql(spark: SparkSession, url: str, query: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A fixed query over JDBC: PostgreSQL's plain types; MySQL's dates, times and decimals too."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return as_text(reader.load(), ("date", "timestamp", "timestamp_ntz", "decimal") if ":mysql:" in url else ())


def preview(frame: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return frame.limit(rows)
