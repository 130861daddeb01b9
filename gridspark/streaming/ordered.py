"""Streams whose state follows the order of events: filtered levels by key, sessions, and sliding quotas with late rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

#: State stores that transformWithState needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Backwards(ValueError):
    """A row that is not later than its key's state."""


class LevelProcessor(StatefulProcessor):
    """A local level a key: a random walk seen with noise.  The state is (time, level, variance, n) and only goes forward.

    Rows of one batch are put in order first.  One at or before the state's time is refused: strict fails the batch, so
    nothing of it is committed; else the row is given out with refused set and the state as it is.
    """

    def __init__(self, prior: float, step: float, noise: float, strict: bool) -> None:
        self.prior, self.step, self.noise, self.strict = prior, step, noise, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("level", "at double, level double, variance double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values("at", kind="stable")
        held = self.state.get() if self.state.exists() else None
        at, level, variance, n = held if held is not None else (None, 0.0, self.prior, 0)
        out = []
        for now, value in zip(batch["at"], batch["value"]):
            refused = at is not None and now <= at
            if refused and self.strict:
                raise Backwards(f"{key[0]}: a row at {now} after the state of {at}")
            if not refused:
                if value is not None and not math.isnan(value):
                    variance += self.step * (now - at) if at is not None else 0.0
                    gain = variance / (variance + self.noise)
                    level, variance, n, at = level + gain * (value - level), variance * (1 - gain), n + 1, now
            out.append((key[0], now, value, level, variance, n, refused))
        if at is not None:
            self.state.update((float(at), float(level), float(variance), int(n)))
        yield pd.DataFrame(out, columns=["key", "at", "value", "level", "variance", "n", "refused"])

    def close(self) -> None:
        pass


def stream_levels(stream: DataFrame, key: str, at: Column, value: str, prior: float = 100.0, step: float = 1.0, noise: float = 50.0, strict: bool = False) -> DataFrame:
    """key, at, value, level, variance, n, refused for each row of a stream, in append mode; NULL values move nothing, rows
    without key or time are left out.  The session needs the settings of STORE."""
    ship_package(stream.sparkSession)
    rows = stream.select(F.col(key).alias("key"), at.cast("double").alias("at"), F.col(value).cast("double").alias("value")).where("key IS NOT NULL AND at IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(
        LevelProcessor(prior, step, noise, strict), outputStructType=f"key {kind}, at double, value double, level double, variance double, n long, refused boolean", outputMode="Append", timeMode="None")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """key, start, end, n (and total of a value): a key's events with no more than a gap between them.

    On a stream a session is given out once the watermark, late behind the newest event, has passed its end; rows later
    than that are left out.  On a table, which has no watermark, all sessions are given.

    start and end come from the events, not from the window: as grouping columns, filters on them would be pushed below
    the merging of sessions and cut these apart.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    more = [F.sum(value).alias("total")] if value else []
    out = timed.groupBy(key, F.session_window("__t", gap).alias("w")).agg(
        F.min("__t").alias("start"), (F.max("__t") + F.expr(f"INTERVAL {gap}")).alias("end"), F.count("*").alias("n"), *more)
    return out.drop("w")


def quota_windows(events: DataFrame, key: str, time: str, most: int, length: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of the sliding windows in which a key has more than `most` events; late rows count while the
    watermark allows, as each window is given out only when it is closed."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(key, F.window("__t", length, slide).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Everything that is there now goes through a stream into Parquet files, once, whatever restarts lie between runs."""
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
