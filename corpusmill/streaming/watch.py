"""Change events of watched trees as a stream: gathered per path and second, removals before changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# Bits of change events.
CREATE, WRITE, REMOVE, RENAME = 1, 2, 4, 8


def gathered(events: DataFrame, seconds: int = 1) -> DataFrame:
    """(tick, path, ops) of events (ts, path, op): the bits of each path within each tick."""
    ticks = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "path").agg(F.bit_or("op").alias("ops"))
    return ticks.select(F.col("w.start").alias("tick"), "path", "ops")


def actions(ticks: DataFrame) -> DataFrame:
    """With `action`: remove if the path went at all, otherwise change; events without either bit are none."""
    gone = F.col("ops").bitwiseAND(F.lit(REMOVE | RENAME)) != 0
    changed = F.col("ops").bitwiseAND(F.lit(CREATE | WRITE)) != 0
    return ticks.withColumn("action", F.when(gone, "remove").when(changed, "change")).where("action is not null")


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second", once: bool = False) -> StreamingQuery:
    """Apply each micro-batch's actions; offsets are kept in `checkpoint`, so a restart continues where it stopped."""

    def batch(df: DataFrame, number: int) -> None:
        per_path = df.groupBy("path").agg(F.bit_or("op").alias("ops"))
        apply(actions(per_path), number)

    w = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def windowed(events: DataFrame, late: str = "10 seconds", seconds: int = 1) -> DataFrame:
    """Streaming form of `gathered`: state of a tick is dropped once events may no longer come."""
    return gathered(events.withWatermark("ts", late), seconds)


class Progress(StreamingQueryListener):
    """Counters of running streams, for the progress report."""

    def __init__(self) -> None:
        self.rows = 0
        self.batches = 0
        self.rate = 0.0
        self.phase = "idle"

    def onQueryStarted(self, event) -> None:
        self.phase = "starting"

    def onQueryProgress(self, event) -> None:
        self.phase = "indexing"
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.rate = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        self.phase = "idle"

    def onQueryTerminated(self, event) -> None:
        self.phase = "idle"
