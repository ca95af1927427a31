"""Join sides of a checked size, and tables written down."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows and bytes of a side that is marked for broadcast.
SMALL, SMALL_BYTES = 100_000, 16 << 20


def small_side(df: DataFrame, most_rows: int = SMALL, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """Marks a join side for broadcast if it has at most `most_rows` rows and `most_bytes` bytes; beyond that Spark shuffles both sides."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        size = F.octet_length(F.col(name)) if kind in ("string", "binary") else 8 * F.size(name) if kind.startswith("array") else F.lit(8)
        width = width + F.greatest(F.lit(8), F.coalesce(size, F.lit(0)))
    rows, held = df.select(width.alias("width")).limit(most_rows + 1).agg(F.count(F.lit(1)), F.sum("width")).first()
    return F.broadcast(df) if rows <= most_rows and (held or 0) <= most_bytes else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes a table that several later steps read to the shared checkpoint folder, and cuts its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
