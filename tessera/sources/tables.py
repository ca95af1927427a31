"""Readers: Parquet tables, JSON fixtures, checkpoint logs, text corpora, Markdown tables and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, path: str, rows: str, schema: str | None = None) -> DataFrame:
    """Rows of one array of a JSON file that holds a single object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).select(F.inline(rows))


def checkpoint_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log: torn lines are left out, and of the rows of an (arm, task_id) the one with the latest ts stays."""
    read = spark.read.schema(f"{schema}, _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    whole = read.where(F.col("_torn").isNull() & F.col("arm").isNotNull() & F.col("task_id").isNotNull()).drop("_torn")
    last = Window.partitionBy("arm", "task_id").orderBy(F.desc_nulls_last("ts"))
    return whole.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def strict_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that cannot be read fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def logs_below(spark: SparkSession, folder: str, pattern: str, schema: str, after: str | None = None) -> DataFrame:
    """All files of a name pattern at any depth, newer than a time if given, with the benchmark, variant and model from names like .checkpoint_<benchmark>_<variant>_<model>.jsonl."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if after:
        reader = reader.option("modifiedAfter", after)
    name = F.regexp_extract("_metadata.file_name", r"^\.?checkpoint_([^_]+)_([^_]+)_(.+)\.jsonl$", 0)
    read = reader.json(folder).select("*", F.col("_metadata.file_name").alias("file"), name.alias("_n"))
    part = lambda k: F.nullif(F.regexp_extract("file", r"^\.?checkpoint_([^_]+)_([^_]+)_(.+)\.jsonl$", k), F.lit(""))
    return read.drop("_n").withColumns({"benchmark": part(1), "variant": part(2), "model": part(3)})


def corpus(spark: SparkSession, glob: str) -> DataFrame:
    """name, category (the name up to its last underscore and number) and whole text of each file."""
    read = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    return read.select(name.alias("name"), F.regexp_replace(name, r"[_-]?\d+$", "").alias("category"), "text")


def markdown_rows(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """file, n (line) and cells of the table rows under a heading, header and rule left out, file by file."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = read.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    order = Window.partitionBy("file").orderBy("n")
    at = F.last(F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", "^#+", ""))), True).over(order)
    rows = lines.withColumn("under", at).where((F.col("under") == heading) & F.trim("line").startswith("|") & ~F.regexp_like("line", F.lit(r"^\s*\|[\s:|-]+\|\s*$")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k > 1").select("file", "n", cells.alias("cells"))


def database(spark: SparkSession, url: str, query: str) -> DataFrame:
    """A read-only query of a database over JDBC."""
    return spark.read.format("jdbc").option("url", url).option("query", query).load()


def schema_gaps(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Columns of the expected schema that are missing or of another type."""
    have = dict(df.dtypes)
    return [f"{c}: expected {t}, found {have.get(c, 'nothing')}" for c, t in expected.items() if have.get(c) != t]


def dataset(spark: SparkSession, path: str, subset: list[str] | None = None, key: str = "question_type") -> DataFrame:
    """A benchmark's items from a JSON array or JSON lines, all or those of a subset."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.where(F.col(key).isin(subset)) if subset else rows


def harness_summary(spark: SparkSession, path: str, totals: list[str], passed: list[str]) -> DataFrame:
    """file, total, passed and score of harness summaries whose fields have several names (the first that is there); 0 without a total."""
    rows = spark.read.option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    first = lambda names: F.coalesce(*(F.col(n).cast("double") for n in names if n in rows.columns), F.lit(0.0))
    return rows.select("file", first(totals).alias("total"), first(passed).alias("passed")).withColumn("score", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """scenario, n, turn and probes of scenario files; a turn is its text, or the JSON text of a tool-loop turn."""
    schema = "name string, system string, turns array<string>, probes array<struct<question: string, keywords: array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.col("name").alias("scenario"), "system", "probes", F.posexplode("turns").alias("n", "turn"))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """model, rate and output_rate from a JSON file of an object by model."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<input: double, output: double>>").alias("m"))
    return rows.select(F.explode("m").alias("model", "p")).select("model", F.col("p.input").alias("rate"), F.col("p.output").alias("output_rate"))


def source_tree(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """path (below the folder), folder, stem, extension, length of the files of some extensions at any depth. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("_p"), "length")
    path = F.substring_index("_p", folder.rstrip("/") + "/", -1)
    name = F.element_at(F.split(path, "/"), -1)
    rows = files.select(path.alias("path"), F.regexp_replace(path, "/?[^/]*$", "").alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"), "length")
    return rows.where(F.col("extension").isin(extensions))


def session_turns(items: DataFrame, key: str, sessions: str, dates: str | None = None) -> DataFrame:
    """(key, session, date, turn, role, content): the turns of an item's sessions (array of arrays of role and content), sessions in order of date, then place."""
    rows = items.select(key, *([dates] if dates else []), F.posexplode(sessions).alias("_s", "_t"))
    rows = rows.withColumn("date", F.get(dates, F.col("_s")) if dates else F.lit(None).cast("string"))
    order = Window.partitionBy(key).orderBy(F.coalesce("date", F.lit("")), "_s")
    placed = rows.withColumn("session", F.row_number().over(order).cast("bigint"))
    return placed.select(key, "session", "date", F.posexplode("_t").alias("turn", "_x")).select(key, "session", "date", "turn", "_x.role", "_x.content")


def flattened(items: DataFrame, key: str, sessions: str) -> DataFrame:
    """(key, n, role, content): all sessions' turns as one conversation."""
    return items.select(key, F.posexplode(F.flatten(sessions)).alias("n", "_x")).select(key, "n", "_x.role", "_x.content")
