"""Streams: a cube's change log as a stream, and events folded into a cube batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..local import local_frame, written
from ..operators.writes import last_writes

CHANGES = "seq bigint, cube string, kind string, version bigint"


def change_log(engine: Engine) -> DataFrame:
    """All changes so far; private kinds (sandboxes) are told to owners only."""
    return local_frame(engine.spark, engine.events, CHANGES)


def append_changes(engine: Engine, path: str, since: int = 0) -> int:
    """Append changes from a position on to a Parquet log that streams can follow; the next position."""
    fresh = [e for e in engine.events if e[0] >= since]
    if fresh:
        local_frame(engine.spark, fresh, CHANGES).coalesce(1).write.mode("append").parquet(path)
    return since + len(fresh)


def follow(spark: SparkSession, path: str, cube: str | None = None, private: bool = False) -> DataFrame:
    """The change log as a stream."""
    out = spark.readStream.schema(CHANGES).parquet(path)
    if cube is not None:
        out = out.where(F.col("cube") == cube)
    return out if private else out.where(F.col("kind") != "sandbox")


def fold(cube_cells: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with a batch of increments (keys, v) added: sums, not overwrites."""
    added = cube_cells.unionByName(batch.select(*keys, "v")).groupBy(*keys).agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("bigint").alias("v"))
    return added.where("v <> 0")


def ingest(stream: DataFrame, engine: Engine, cube: str, to_cells: Callable[[DataFrame], DataFrame], checkpoint: str, additive: bool = True):
    """Start a query that commits each micro-batch of a stream to a cube once.

    ``to_cells`` makes (d0.., v) of a batch.  With a store, the number of a batch is kept with the
    version that it made, in one step, so a batch that is delivered again is not counted twice,
    not even by a later process.  Without one, numbers are remembered as long as the engine.
    """
    done = engine.batches.setdefault((cube, checkpoint), -1)
    if engine.store:
        found = engine.store.noted(cube, checkpoint)
        engine.batches[cube, checkpoint] = done if found is None else max(done, int(found))

    def commit(batch: DataFrame, number: int) -> None:
        if number <= engine.batches[cube, checkpoint]:
            return
        c = engine.cube(cube)
        cells = to_cells(batch)
        if additive:
            mine = cells.groupBy(*c.keys).agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("bigint").alias("d"))
            now = mine.join(c.cells, c.keys, "left").select(*c.keys, (F.coalesce("v", F.lit(0).cast("bigint")) + F.col("d")).alias("v"))
        else:
            now = last_writes(cells, c.keys)
        now = now.withColumn("ord", F.lit(0).cast("bigint"))
        # The batch's frame ends with the batch: without a store it is written out.
        engine.write_frame(cube, now if engine.store else written(now, "batch"), note={checkpoint: number})
        engine.batches[cube, checkpoint] = number

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and exact sums by event type in event-time windows, with a watermark for late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 10000).cast("bigint")).alias("v4")).select(F.col("window.start").alias("start"), "event_type", "n", "v4")
