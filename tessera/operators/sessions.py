"""Replays of ordered turns: repeats, streaks, exhaustion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import MOST, Running, running

#: Retrievals without progress after which an item is held back.
THRESHOLD = 4


def replay(turns: DataFrame, session: str, order: list[str], item: str, progress: str, threshold: int = THRESHOLD, exempt: Column | None = None, most: int = MOST) -> DataFrame:
    """Adds epoch, since_progress, total and suppressed to a session's retrievals.

    Counters of all items start anew after a turn with progress; the turn itself still counts in the old epoch. A retrieval counts
    first and is then suppressed if its item has been retrieved `threshold` times or more in the epoch, unless it is exempt.
    """
    one = F.lit(1)
    rows = running(turns, [session], order, Running("epoch", "sum", F.col(progress).cast("int"), inclusive=False), most=most)
    rows = rows.withColumn("epoch", F.coalesce("epoch", F.lit(0)))
    rows = running(rows, [session, item, "epoch"], order, Running("since_progress", "count", one), most=most)
    rows = running(rows, [session, item], order, Running("total", "count", one), most=most)
    over = F.col("since_progress") >= threshold
    return rows.withColumn("suppressed", over if exempt is None else over & ~exempt)


def loop_measures(replayed: DataFrame, group: str, trap: Column, exempt: Column, threshold: int = THRESHOLD, penalty: bool = True) -> DataFrame:
    """(group, loop_rate, productive_kept, exempt_kept) of a replay: traps let through in a loop, and the shares of other and of exempt retrievals let through.

    Without penalty all are let through. Without a trap the rate is 0; without others or exempt ones the shares are 1.
    """
    let = ~F.col("suppressed") if penalty else F.lit(True)
    share = lambda hit, of, none: F.round(F.when(F.count_if(of) == 0, none).otherwise(F.count_if(hit & of) / F.count_if(of)), 6)
    return replayed.groupBy(group).agg(
        share(let & (F.col("since_progress") >= threshold), trap & ~exempt, 0.0).alias("loop_rate"),
        share(let, ~trap & ~exempt, 1.0).alias("productive_kept"),
        share(let, exempt, 1.0).alias("exempt_kept"),
    )


def exhaustion_gate(replayed: DataFrame, group: str, trap: Column, exempt: Column, threshold: int = THRESHOLD) -> DataFrame:
    """(group, base_loop_rate, loop_rate, cut, productive_kept, exempt_kept, graduates): the replay with the penalty against the one without.

    The penalty graduates if it cuts the rate of loops and keeps all productive and all exempt retrievals.
    """
    base = loop_measures(replayed, group, trap, exempt, threshold, penalty=False).select(group, F.col("loop_rate").alias("base_loop_rate"))
    both = base.join(loop_measures(replayed, group, trap, exempt, threshold), group).withColumn("cut", F.round(F.col("base_loop_rate") - F.col("loop_rate"), 6))
    return both.withColumn("graduates", (F.col("cut") > 0) & (F.col("productive_kept") >= 1) & (F.col("exempt_kept") >= 1))


def streaks(rows: DataFrame, session: str, order: list[str], outcome: str, neutral: list[str], most: int = MOST) -> DataFrame:
    """(session, streak, outcome, length): runs of equal outcomes in order; neutral rows neither lengthen nor end a run."""
    told = running(rows.where(~F.col(outcome).isin(neutral)), [session], order, Running("_last", "lasts", F.col(outcome), inclusive=False), most=most)
    change = F.coalesce((F.col(outcome) != F.try_element_at("_last", F.lit(1))).cast("int"), F.lit(1))
    marked = running(told.withColumn("_c", change), [session], order, Running("streak", "sum", F.col("_c")), most=most)
    return marked.groupBy(session, "streak", outcome).agg(F.count(F.lit(1)).alias("length"))


def occurrence(rows: DataFrame, key: list[str], order: list[str], most: int = MOST) -> DataFrame:
    """Adds nth (from 1) and repeat."""
    return running(rows, key, order, Running("nth", "count", F.lit(1)), most=most).withColumn("repeat", F.col("nth") > 1)


def preceding(rows: DataFrame, session: str, order: str, text: str, keep: Column, n: int, most: int = MOST) -> DataFrame:
    """Adds before (the last n texts of the session's earlier rows for which `keep` holds, the last first) and n_before (how many there are)."""
    kept = F.when(keep, F.col(text))
    return running(rows, [session], [order], Running("n_before", "count", kept, inclusive=False), Running("before", "lasts", kept, inclusive=False, n=n), most=most)


def breaches(rows: DataFrame, key: str, order: list[str], amount: str, cap: float, most: int = MOST) -> DataFrame:
    """Rows at which, and after which, a key's running total is over a cap, with the total as spent."""
    return running(rows, [key], order, Running("spent", "sum", F.col(amount)), most=most).where(F.round("spent", 6) > cap)
