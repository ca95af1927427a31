"""Streams of events: tailing logs, windows, late and repeated rows, and replays with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.sessions import THRESHOLD


def tail_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of JSON-lines files as they appear in a folder; lines that cannot be read are left out."""
    reader = spark.readStream.schema(f"{schema}, _torn string").option("columnNameOfCorruptRecord", "_torn")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).where(F.col("_torn").isNull()).drop("_torn")


def first_only(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row of each key; repeats that come within the delay are dropped, and keys are forgotten after it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, at: str, delay: str, length: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Rows by tumbling window, or by sliding window if `slide` is given; rows later than the delay are dropped."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, delay).groupBy(span, *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


def session_counts(stream: DataFrame, key: str, at: str, delay: str, gap: str) -> DataFrame:
    """Rows of a key's sessions: a pause longer than the gap ends one."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", key, "n")


def running_totals(stream: DataFrame, key: str, amount: str, cap: float) -> DataFrame:
    """(key, total, over) as they stand; use with complete or update output."""
    return stream.groupBy(key).agg(F.sum(amount).alias("total")).withColumn("over", F.col("total") > cap)


REPLAY_SCHEMA = "session string, turn bigint, item string, since_progress bigint, suppressed boolean"


def replay(stream: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Retrievals of a session with their count since the last turn with progress, suppressed from the `threshold`-th on unless exempt.

    stream: session, turn, item, progress, exempt. State is a map from item to count and epoch, one entry an item, and the session's epoch; a turn
    with progress begins the next epoch. Turns of a session must arrive in order from batch to batch; within a batch they are sorted. A turn must not
    span batches.
    """

    class Replay(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.counts = handle.getMapState("counts", "item string", "epoch bigint, n bigint")
            self.epoch = handle.getValueState("epoch", "epoch bigint")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
            got = pd.concat(list(rows)).sort_values(["turn", "item"], kind="stable").reset_index(drop=True)
            first = self.epoch.get()[0] if self.epoch.exists() else 0
            progress = got.groupby("turn")["progress"].any()
            epoch = got["turn"].map(first + progress.cumsum() - progress)
            before = {}
            for item in got["item"].unique():
                held = self.counts.getValue((item,)) if self.counts.containsKey((item,)) else None
                before[item] = held[1] if held and held[0] == first else 0
            n = got.groupby(["item", epoch.rename("epoch")]).cumcount() + 1 + got["item"].map(before).where(epoch == first, 0)
            last = pd.DataFrame({"item": got["item"], "epoch": epoch, "n": n}).groupby("item").last()
            for item, e, k in last.itertuples():
                self.counts.updateValue((item,), (int(e), int(k)))
            self.epoch.update((int(first + progress.sum()),))
            yield pd.DataFrame({"session": key[0], "turn": got["turn"], "item": got["item"], "since_progress": n.astype("int64"), "suppressed": (n >= threshold) & ~got["exempt"].fillna(False).astype(bool)})

        def close(self) -> None:
            pass

    return stream.groupBy("session").transformWithStateInPandas(Replay(), REPLAY_SCHEMA, "Append", "None")


def append_files(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's rows as JSON files, each row once, and ends when what is there has been read."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def last_wins(stream: DataFrame, key: list[str], at: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps, in folders by batch, the last row of each key of the batch; `read_last` gives the last of all."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        best = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_b")).select(*key, "_b.*")
        best.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_last(spark: SparkSession, folder: str, key: list[str], at: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, "batch")).alias("_b")).select(*key, "_b.*").drop("batch")
