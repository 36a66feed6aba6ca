"""Tiles and measurements that arrive over time, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesselon.sources.store import KEY


def arrivals(spark: SparkSession, folder: str, schema: str, pattern: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files below ``folder`` as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def windowed(events: DataFrame, time: str, width: str, late: str, keys: tuple[str, ...], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of each window and key; rows later than ``late`` behind the newest are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    found = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    """Runs of a key's events that are no more than ``gap`` apart."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run over all that is there now into Parquet; a rerun with the same checkpoint only adds what is new."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_into(stream: DataFrame, target: str, checkpoint: str, key: tuple[str, ...] = KEY) -> None:
    """Keep the newest version of each tile: every batch is written to a folder of its own named by its
    number, so a repeated batch replaces itself, and readers take the highest number.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(list(key)).write.mode("overwrite").parquet(f"{target}/version={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """The newest version of each tile written by ``upsert_into``."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*key, "r.*")


#: The state store that keeps maps and timers of keys.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FINISHED = "slide_id {kind}, tiles long, expected long, complete boolean, first_at timestamp, last_at timestamp"


class _Slide(StatefulProcessor):
    """The tiles of one slide that have come, until all have or none has come for too long."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getMapState("places", "tile_i int, tile_j int", "at long")
        self.about = handle.getValueState("about", "tiles long, expected long, first_at long, last_at long, timer long")
        # Kept after a slide is done, so that tiles that come again later do not open it once more.
        self.done = handle.getValueState("done", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        tiles, expected, first, last, timer = self.about.get() if self.about.exists() else (0, None, None, None, None)
        # Each question to the state is a round trip, so a place is asked about once, however often it comes.
        asked: set[tuple[int, int]] = set()
        for part in rows:
            if part.empty:
                continue
            times = part["at"].astype("datetime64[us]").astype("int64") // 1000
            once = ~part.duplicated(["tile_i", "tile_j"])
            for i, j, at in zip(part["tile_i"][once], part["tile_j"][once], times[once], strict=True):
                place = (int(i), int(j))
                if place not in asked and not self.places.containsKey(place):
                    self.places.updateValue(place, (int(at),))
                    tiles += 1
                asked.add(place)
            if not pd.isna(n := part["expected"].max()):
                expected = int(n) if expected is None else max(expected, int(n))
            low, high = int(times.min()), int(times.max())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        if expected is not None and tiles >= expected:
            yield self._close(key, tiles, expected, True, first, last, timer)
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(last, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.about.update((tiles, expected, first, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists():
            tiles, expected, first, last, _ = self.about.get()
            yield self._close(key, tiles, expected, False, first, last, None)

    def _close(self, key, tiles: int, expected: int | None, complete: bool, first: int, last: int, timer: int | None) -> pd.DataFrame:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.places.clear()
        self.about.clear()
        self.done.update((last,))
        row: dict[str, Any] = {"slide_id": [key[0]], "tiles": [tiles], "expected": [expected], "complete": [complete]}
        times = {c: pd.to_datetime([t], unit="ms") for c, t in (("first_at", first), ("last_at", last))}
        return pd.DataFrame({**row, **times}).astype({"expected": "Int64"})

    def close(self) -> None:
        pass


def finished(tiles: DataFrame, patience: str = "10 minutes") -> DataFrame:
    """(slide_id, tiles, expected, complete, first_at, last_at): one row for each slide of a stream once it is finished.

    ``tiles`` are (slide_id, tile_i, tile_j, expected, at): ``expected`` is how many tiles the slide has
    in all, or null where that is not known yet. A slide is complete when so many different tiles have
    come, whatever their order and however often each. If some never come, it is given out as incomplete
    once the stream's times have passed its last tile's by ``patience``. What comes for a slide after
    that changes nothing, and tiles that are older than that when they come are not seen. Needs the state store ``STORE`` in ``spark.sql.streaming.stateStore.providerClass``.
    """
    kind = tiles.schema["slide_id"].dataType.simpleString()
    wanted = tiles.select("slide_id", F.col("tile_i").cast("int").alias("tile_i"), F.col("tile_j").cast("int").alias("tile_j"), F.col("expected").cast("long").alias("expected"), F.col("at").cast("timestamp").alias("at"))
    late = wanted.filter("slide_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", patience)
    return late.groupBy("slide_id").transformWithStateInPandas(_Slide(), _FINISHED.format(kind=kind), "Append", "EventTime")
