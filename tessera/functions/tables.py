"""Table functions for SQL: the values, and the changes of counts, that sentences state.

    register(spark)
    SELECT n.*, v.* FROM notes n JOIN stated_values(TABLE(SELECT DISTINCT sentence FROM notes)) v ON v.sentence = n.sentence

A function takes a table whose first column is text and gives a row for each value with the text beside it; null texts state nothing. Rows come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators import typed_values as tv

VALUES = "sentence string, found int, kind string, start int, stop int, display string, value string, low double, high double, unit string"
CHANGES = "sentence string, found int, amount int, noun string, phrase string"


def _table(batch: pa.RecordBatch, find, ddl: str) -> pa.Table:
    rows = [(t, n, *v) for t in batch.column(0).to_pylist() if t for n, v in enumerate(find(t))]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


@arrow_udtf(returnType=VALUES)
class StatedValues:
    """(sentence, found, kind, start, stop, display, value, low, high, unit) of a table of sentences."""

    def __init__(self) -> None:
        self.patterns = tv._patterns()

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _table(rows, lambda t: tv.values_in(t, self.patterns), VALUES)


@arrow_udtf(returnType=CHANGES)
class CountChanges:
    """(sentence, found, amount, noun, phrase) of a table of sentences."""

    def __init__(self) -> None:
        self.patterns = tv._change_patterns()

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        yield _table(rows, lambda t: tv.changes_in(t, self.patterns), CHANGES)


def register(spark: SparkSession) -> None:
    """Makes stated_values and count_changes known to SQL."""
    spark.udtf.register("stated_values", StatedValues)
    spark.udtf.register("count_changes", CountChanges)
