"""Structured Streaming forms: log visits, message de-duplication, and windowed counts with late data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import logs
from ..storage import shared_dir


def as_stream(spark: SparkSession, rows: DataFrame, files_each: int = 8) -> DataFrame:
    """Rows written as files and read back as a stream of micro-batches of so many files."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_each).parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up and give what it wrote.

    Every micro-batch is written under its number, so that a batch that is run again after a failure replaces itself.
    In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{base}/out/{n}" for n in ([max(seen)] if mode == "complete" else seen)]
    return spark.read.schema(stream.schema).parquet(*paths)


def log_visits_stream(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return drain(logs.visits(logs.page_views(logs.parse_lines(as_stream(spark, lines)))), "complete")


def dedup_stream(spark: SparkSession, rows: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """Rows with a key not met before; keys of `seen` (those that stood there at the start) are left out."""
    stream = as_stream(spark, rows)
    if seen is not None:
        stream = stream.join(seen.select(key).distinct(), key, "left_anti")
    return drain(stream.dropDuplicates([key]))


#: How many keys are remembered, and how many of the oldest go when there are more.
REMEMBERED, FORGOTTEN = 1000, 200


class RecentKeys(StatefulProcessor):
    """Per group, rows with a key that is not among those remembered. When more than `most` are, the `drop` oldest are
    forgotten, and may come again.

    The state is the list of keys in the order of their coming, so that it never holds more than `most`.
    """

    def __init__(self, key: str, key_type: str, order: str, most: int, drop: int):
        self.key, self.key_type, self.order, self.most, self.drop = key, key_type, order, most, drop

    def init(self, handle) -> None:
        self.held = handle.getListState("held", f"k {self.key_type}")

    def _admit(self, known: dict, keys: list) -> list[bool]:
        new = []
        for k in keys:
            new.append(k not in known)
            if new[-1]:
                known[k] = None
                if len(known) > self.most:
                    for old in list(known)[: self.drop]:
                        del known[old]
        return new

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        known = dict.fromkeys(x[0] for x in self.held.get())
        new = self._admit(known, batch[self.key].tolist())
        self.held.put([(k,) for k in known])
        yield batch[new]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        known: dict = {}
        self._admit(known, initialState.sort_values(self.order, kind="stable")[self.key].tolist())
        self.held.put([(k,) for k in known])

    def close(self) -> None:
        pass


def dedup_recent(stream: DataFrame, group: str, key: str, order: str, *, seen: DataFrame | None = None, most: int = REMEMBERED, drop: int = FORGOTTEN) -> DataFrame:
    """Rows of each group whose key is not among the last ones remembered; rows of a micro-batch go by order.

    `seen` (group, key, order) is what was there before the stream began. Keys and order must not be null.
    """
    processor = RecentKeys(key, stream.schema[key].dataType.simpleString(), order, most, drop)
    before = None if seen is None else seen.select(group, key, order).groupBy(group)
    return stream.groupBy(group).transformWithStateInPandas(processor, stream.schema, "Append", "None", before)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State that is kept by column family, as stateful processors need it, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dedup_within(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """De-duplication whose state is bounded in time: a key is forgotten after `delay`."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Rows per time window and keys; a window closes when the watermark has passed it."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
