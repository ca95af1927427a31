"""Helpers that the training-data operators share."""

from __future__ import annotations

import io
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task: bounds the memory of a Python worker whatever the row sizes.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, with A-Z in lower case (bytes.lower and bytes.split know ASCII alone)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batch: pa.RecordBatch, column: str, most_chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts a batch into runs of rows whose texts hold about `most_chars` characters; a longer text gets a run of its own."""
    texts = batch.column(column).to_pylist()
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and held + n > most_chars:
            yield batch.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield batch.slice(start), texts[start:]


def map_texts(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch, list], Iterable]], most_chars: int = SLICE_CHARS) -> DataFrame:
    """Runs a batch function over all rows. make() is called once a task and returns fn(rows, texts), which gives the columns' arrays in order, for any number of rows."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for rows, texts in slices(batch, column, most_chars):
                columns = fn(rows, texts)
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, column: str, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """Keeps the rows for which make()(texts) is true; columns, names and order stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for rows, texts in slices(batch, column):
                yield rows.filter(pa.array(fn(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def drawn(share: float, *columns: str) -> Column:
    """Whether a row is in a sample of a share of all rows: by a hash of its columns, fine enough for any number of rows."""
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 52)) < int((1 << 52) * min(1.0, share))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """About `most` labelled training texts as (doc_id, text, y): those whose id has crc32 mod `modulus` other than `held`.

    An id labelled more than once counts once, with its largest label. Rows are taken by the hash of the id, so the same
    rows are taken on every run and each row costs nothing but its own hash; the sample's size follows from the count, so
    the side that is broadcast holds about `most` rows (the binomial spread adds a few hundredths).
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", modulus) != held))
        .groupBy(F.col("doc_id").alias("known_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    n = known.count()
    if n > most:
        known = known.where(drawn(most / n, "known_id"))
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(known), texts["doc_id"] == known["known_id"]).select("doc_id", "text", "y")


def fit_in_task(features: DataFrame, fit: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Brings a bounded feature table into one task, fits there and returns the model's arrays to the driver.

    The features come in the order of their rows' ids, so a task that is run again after a lost executor fits the same model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        model = fit(pa.Table.from_batches(got) if got else None)
        out = io.BytesIO()
        np.savez(out, **model)
        yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    # one partition even for an empty input, so that a model always comes back
    rows = features.repartition(1).mapInArrow(run, "model binary").collect()
    with np.load(io.BytesIO(rows[0][0])) as kept:
        return {k: kept[k] for k in kept.files}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """Marks a join side for broadcast if it has at most `most_rows` rows and `most_bytes` bytes; else Spark joins it by a shuffle."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        size = F.octet_length(F.col(name)) if kind in ("string", "binary") else 8 * F.size(name) if kind.startswith("array") else F.lit(8)
        width = width + F.greatest(F.lit(8), F.coalesce(size, F.lit(0)))
    rows, held = df.select(width.alias("width")).limit(most_rows + 1).agg(F.count(F.lit(1)), F.sum("width")).first()
    return F.broadcast(df) if rows <= most_rows and (held or 0) <= most_bytes else df


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
