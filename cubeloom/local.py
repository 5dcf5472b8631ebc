"""Small frames from Python rows as local relations.

They go to the optimizer as literals with known sizes: empty ones vanish from a plan, small ones
are broadcast, and no task is started to read them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    kind = StructType.fromDDL(schema)
    rows = list(rows)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, kind)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a local one on a local master, else one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = "file://" + tempfile.mkdtemp(prefix="shared-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(frame: DataFrame, name: str = "table") -> DataFrame:
    """A frame written to the shared folder and read back: cuts the lineage and outlives lost executors."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
