"""Counter views corrected one after another: a correction binds where exactly one view has the old value, and what it changes is what later ones meet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .sizes import checkpointed


def corrected(views: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The views (namespace, counter, value) after all corrections, and the corrections (namespace, seq, bound) with the counter that each was applied to, or null.

    views: namespace, counter, value, seq; the last of a counter is its view. corrections: namespace, seq, old, new, applied in order of seq. Rows with a null namespace or value
    are left out of the fold (a view keeps its null).

    Corrections meet only views whose values they, or corrections linked with them by a value, name: the values of a namespace fall into connected components, and each is
    folded by itself, in order. So a namespace is not one group, and views that no correction can reach are not folded at all.
    """
    key = ["namespace", "counter"]
    last = checkpointed(views.groupBy(*key).agg(F.max_by("value", "seq").alias("value")))
    fixes = checkpointed(corrections.where("namespace IS NOT NULL AND old IS NOT NULL AND new IS NOT NULL"))
    at = lambda v: F.struct("namespace", F.col(v).alias("value"))
    linked = components(fixes.select(at("old").alias("src"), at("new").alias("dst")))
    alone = fixes.where("old = new").select(at("old").alias("node")).distinct().join(linked.select("node"), "node", "left_anti")
    part = linked.unionByName(alone.select("node", F.col("node").alias("component"))).select(F.col("node.namespace").alias("_ns"), F.col("node.value").alias("_v"), F.xxhash64("component").alias("part"))
    held = last.join(part, (F.col("namespace") == F.col("_ns")) & (F.col("value") == F.col("_v")), "left").drop("_ns", "_v")
    named = fixes.join(part, (F.col("namespace") == F.col("_ns")) & (F.col("old") == F.col("_v"))).drop("_ns", "_v")
    kinds = dict(last.dtypes)
    steps = held.where("part IS NOT NULL").select("namespace", "part", F.lit(0).alias("kind"), F.lit(None).cast(dict(fixes.dtypes)["seq"]).alias("seq"), "counter", F.col("value").alias("old"), F.col("value").alias("new"))
    steps = steps.unionByName(named.select("namespace", "part", F.lit(1).alias("kind"), "seq", F.lit(None).cast(kinds["counter"]).alias("counter"), F.col("old").cast(kinds["value"]), F.col("new").cast(kinds["value"])))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        holders: dict = {}
        for counter, value in rows.loc[rows["kind"] == 0, ["counter", "old"]].itertuples(index=False):
            holders.setdefault(value, set()).add(counter)
        out = []
        for seq, old, new in rows[rows["kind"] == 1].sort_values("seq")[["seq", "old", "new"]].itertuples(index=False):
            found = holders.get(old, set())
            bound = next(iter(found)) if len(found) == 1 else None
            if bound is not None:
                holders[old] = set()
                holders.setdefault(new, set()).add(bound)
            out.append((1, seq, bound, None))
        out += [(0, None, c, value) for value, cs in holders.items() for c in cs]
        done = pd.DataFrame(out, columns=["kind", "seq", "counter", "value"], dtype=object)
        return done.assign(namespace=rows["namespace"].iloc[0])[["namespace", "kind", "seq", "counter", "value"]]

    folded = checkpointed(steps.groupBy("namespace", "part").applyInPandas(fold, f"namespace {kinds['namespace']}, kind int, seq {dict(fixes.dtypes)['seq']}, counter {kinds['counter']}, value {kinds['value']}"))
    out = folded.where("kind = 0").select(*key, "value").unionByName(held.where("part IS NULL").select(*key, "value"))
    return out, folded.where("kind = 1").select("namespace", "seq", F.col("counter").alias("bound"))
