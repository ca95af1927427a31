"""Writers: JSON artifacts, append-only logs and Markdown tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def json_artifact(df: DataFrame, path: str) -> None:
    """Replaces the folder at path: the rows are written beside it first, so that a failed write leaves the old files, and then take its place by two renames."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old, own = hadoop(f"{path}.new"), hadoop(f"{path}.old"), hadoop(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").json(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(own):
        fs.rename(own, old)
    fs.rename(new, own)
    fs.delete(old, True)


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes the rows to a folder of their own below path, then points to it; returns the folder's name. Readers (`published`) see the old rows or the new ones at any moment.

    The pointer is a small file that an atomic rename puts in the place of the old one. The last `keep` folders stay, so that a reader that has begun ends on its own.
    """
    spark = df.sparkSession
    fs, hadoop = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Path
    name = f"rows-{uuid.uuid4().hex}"
    df.write.json(f"{path}/{name}")
    conf = spark._jsc.hadoopConfiguration()
    store, pointer, fresh = hadoop(path).getFileSystem(conf), hadoop(f"{path}/current.txt"), hadoop(f"{path}/current.{name}.txt")
    out = store.create(fresh, True)
    out.write(name.encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(store.getUri(), conf).rename(fresh, pointer, over)
    folders = sorted((s for s in store.listStatus(hadoop(path)) if s.getPath().getName().startswith("rows-") and s.getPath().getName() != name), key=lambda s: -s.getModificationTime())
    for old in folders[keep - 1 :]:
        store.delete(old.getPath(), True)
    return name


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows that path points to."""
    name = spark.read.text(f"{path}/current.txt").first()[0]
    return spark.read.json(f"{path}/{name}")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table for a report, of at most `most` rows."""
    rows = [[str(v) for v in r] for r in df.limit(most).collect()]
    head = [df.columns, ["---"] * len(df.columns)]
    return "\n".join("| " + " | ".join(r) + " |" for r in head + rows)
