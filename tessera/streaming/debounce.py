"""Evidence that marks a namespace dirty, folded once nothing came for a quiet time; again when new evidence comes.

`bursts` tells, by event-time timers, when a namespace has become quiet; `refold` folds, for each micro-batch, the namespaces that became quiet in it. What is folded is
what the evidence holds up to the time at which the namespace became quiet, and it is written to a folder of the batch's number: a batch that is run again writes
the same rows over its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

BURSTS = "start timestamp, n bigint, last timestamp, ready timestamp"


def bursts(stream: DataFrame, namespace: str, at: str, quiet: str, delay: str) -> DataFrame:
    """(namespace, start, n, last, ready): bursts of evidence, each once, when the watermark (`delay` behind) has passed `ready`, the quiet time after its last row.

    State of a namespace: its open bursts, as (start, last, n), and a timer for each. A row joins the bursts that it is within the quiet time of, which may make
    one of two, so rows may come in any order within the delay; a timer set for an earlier end finds its burst grown and waits on. A burst that is out leaves no state
    behind: every open burst has its timer (a time to live is for processing time only). Rows without a namespace are a namespace; rows without a time are left out.
    """
    span = pd.Timedelta(quiet)

    class Debounce(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", "start timestamp, last timestamp, n bigint")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            times = pd.concat([r[at] for r in rows]).dropna().sort_values()
            was = [tuple(x) for x in self.open.get()] if self.open.exists() else []
            merged: list[list] = []
            for start, last, n in sorted([(pd.Timestamp(a), pd.Timestamp(b), n) for a, b, n in was] + [(t, t, 1) for t in times]):
                if merged and start - merged[-1][1] <= span:
                    merged[-1][1:] = [max(merged[-1][1], last), merged[-1][2] + n]
                else:
                    merged.append([start, last, n])
            if merged:
                self.open.put([(a.to_pydatetime(), b.to_pydatetime(), int(n)) for a, b, n in merged])
            had = {end(pd.Timestamp(b)) for _, b, _ in was}
            has = {end(b) for _, b, _ in merged}
            for t in had - has:
                self.handle.deleteTimer(t)
            for t in has - had:
                self.handle.registerTimer(t)
            yield from ()

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            held = [(pd.Timestamp(a), pd.Timestamp(b), n) for a, b, n in self.open.get()] if self.open.exists() else []
            out = [x for x in held if end(x[1]) <= now]
            left = [(a.to_pydatetime(), b.to_pydatetime(), int(n)) for a, b, n in held if end(b) > now]
            if left:
                self.open.put(left)
            else:
                self.open.clear()
            if out:
                yield pd.DataFrame({namespace: [key[0]] * len(out), "start": [a for a, _, _ in out], "n": [n for _, _, n in out], "last": [b for _, b, _ in out], "ready": [b + span for _, b, _ in out]})

        def close(self) -> None:
            pass

    def end(last: pd.Timestamp) -> int:
        """Time of the timer in milliseconds: just after the last moment at which a row would still join."""
        return int((last + span).timestamp() * 1000) + 1

    kind = dict(stream.dtypes)[namespace]
    rows = stream.where(F.col(at).isNotNull()).withWatermark(at, delay)
    return rows.groupBy(namespace).transformWithStateInPandas(Debounce(), f"{namespace} {kind}, {BURSTS}", "Append", "EventTime")


def refold(quiet: DataFrame, evidence: Callable[[], DataFrame], namespace: str, at: str, fold: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Folds the namespaces of `bursts` as they become quiet. fold(rows) gives rows that hold the namespace; read them by `views`."""

    def write(batch: DataFrame, number: int) -> None:
        ready = batch.groupBy(F.col(namespace).alias("_ns")).agg(F.max("ready").alias("_ready"))
        known = evidence().join(ready, F.col(namespace).eqNullSafe(F.col("_ns"))).where(F.col(at) <= F.col("_ready"))
        folded = fold(known.drop("_ns", "_ready"))
        out = folded.join(ready.withColumnRenamed("_ns", "_n"), folded[namespace].eqNullSafe(F.col("_n"))).drop("_n").withColumnRenamed("_ready", "folded_at")
        out.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return quiet.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def views(spark: SparkSession, folder: str, namespace: str) -> DataFrame:
    """The rows of each namespace's last fold."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy(F.col(namespace).alias("_ns")).agg(F.max("batch").alias("_batch"))
    return rows.join(last, rows[namespace].eqNullSafe(F.col("_ns")) & (F.col("batch") == F.col("_batch"))).drop("_ns", "_batch", "batch")


def status(evidence: DataFrame, folded: DataFrame, namespace: str, at: str) -> DataFrame:
    """(namespace, evidence, dirty): rows of each namespace, and whether some are later than its last fold. folded: the views."""
    last = folded.groupBy(F.col(namespace).alias("_ns")).agg(F.max("folded_at").alias("_at"))
    n = evidence.groupBy(namespace).agg(F.count(F.lit(1)).alias("evidence"), F.max(at).alias("_last"))
    dirty = F.col("_at").isNull() | (F.col("_last") > F.col("_at"))
    return n.join(last, n[namespace].eqNullSafe(F.col("_ns")), "left").select(namespace, "evidence", dirty.alias("dirty"))
