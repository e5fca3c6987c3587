"""Streaming forms of the playback and stateful operators, over a stream of index events.

events: event_id, ts, user_id, event_type, value. The stream's time is ts; late rows beyond the
watermark are dropped by the windowed forms, as the engine does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drop_frame(stream: DataFrame, slot: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Of each clip's frames in one display slot the last is shown, the others count as dropped."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", slot).alias("w"), "user_id")
    out = g.agg(F.max("event_id").alias("frame"), (F.count(F.lit(1)) - 1).alias("dropped"))
    return out.select(F.col("w.start").alias("start"), F.col("user_id").alias("clip"), "frame", "dropped")


def tumbling(stream: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, length: str = "3 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_average(stream: DataFrame) -> DataFrame:
    """Accumulator carried across calls: sum and count per kind, half-up mean."""
    g = stream.groupBy("event_type").agg(F.sum(F.floor("value")).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "n", F.expr("(s + n div 2) div n").alias("mean"))


class FirstFrame(StatefulProcessor):
    """Keeps a clip's first value (by time, then id) and gives every later value relative to it.

    State is one row per clip. Rows of one trigger are ordered by time and id, so results do not
    depend on the order of arrival within a trigger.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        if not self.first.exists():
            self.first.update((float(d["value"].iloc[0]),))
        base = self.first.get()[0]
        yield pd.DataFrame({"user_id": [key[0]] * len(d), "event_id": d["event_id"].to_numpy(), "relative": d["value"].to_numpy() - base})

    def close(self) -> None:
        pass


def relative_to_first(stream: DataFrame) -> DataFrame:
    """Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""
    return stream.groupBy("user_id").transformWithStateInPandas(FirstFrame(), "user_id long, event_id long, relative double", "Append", "None")


def start(df: DataFrame, name: str, mode: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run into a memory table: all that is available, or at a fixed pace."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
