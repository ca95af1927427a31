"""Queries of typed values: events as notes that users write, whose values are known from the events themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import typed_values as tv
from ..sources.tables import table
from .catalog import many, query

#: The note of an event of each type; {n} is made from its id.
NOTES = {
    "signup": "I have watched {n} films so far.",
    "view": "I used to wake at {h}:15 am.",
    "click": "My gym costs ${n} and I go {m} times a week now.",
    "purchase": "I bought a new bike. It took {m}-{p} hours.",
    "error": "Do you have a spare key? No, I don't have a spare one on Monday.",
}


def _numbers() -> dict[str, tuple]:
    i = F.col("event_id")
    return {"{n}": i % 40 + 2, "{h}": i % 9 + 1, "{m}": i % 5 + 2, "{p}": i % 5 + 4}


SQL_NUMBERS = {"{n}": "(event_id % 40 + 2)", "{h}": "(event_id % 9 + 1)", "{m}": "(event_id % 5 + 2)", "{p}": "(event_id % 5 + 4)"}


def _sql_note(note: str) -> str:
    out = "'" + note.replace("'", "''") + "'"
    for k, v in SQL_NUMBERS.items():
        out = f"replace({out}, '{k}', {v}::VARCHAR)"
    return out


NOTE_SQL = "nt AS (SELECT event_id, user_id, event_type, CASE event_type " + " ".join(f"WHEN '{t}' THEN {_sql_note(n)}" for t, n in NOTES.items()) + " END AS note FROM events)"
#: What each note states: sentence number, kind, display, value, unit, past, present, noun; {..} as above.
STATED = [
    ("signup", 0, "count", "{n} films", "{n}", "films", False, True, "film"),
    ("view", 0, "clock_time", "{h}:15 am", "0{h}:15", "local_time", True, False, ""),
    ("click", 0, "money", "${n}", "{n}", "USD", False, False, ""),
    ("click", 0, "frequency", "{m} times a week", "{m}/week", "week", False, True, "week"),
    ("purchase", 1, "duration", "{m}-{p} hours", "{m}-{p}", "hours", False, False, "hour"),
    ("error", 1, "boolean", "don't have", "false", "", False, False, ""),
    ("error", 1, "weekday", "Monday", "monday", "weekday", False, False, ""),
]
STATED_SQL = "st AS (" + " UNION ALL ".join(f"SELECT event_id, user_id, {k} AS n, {j} AS found, '{kind}' AS kind, {_sql_note(d)} AS display, {_sql_note(v)} AS value, '{u}' AS unit, {past} AS past, {now} AS present, '{noun}' AS noun, '{t}' AS event_type FROM events WHERE event_type = '{t}'" for j, (t, k, kind, d, v, u, past, now, noun) in enumerate(STATED)) + ")"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    note = F.lit(None).cast("string")
    for t, text in NOTES.items():
        filled = F.lit(text)
        for k, v in _numbers().items():
            filled = F.replace(filled, F.lit(k), v.cast("string"))
        note = F.when(F.col("event_type") == t, filled).otherwise(note)
    return e.select("user_id", "event_id", F.to_date("ts").alias("day"), "event_type", note.alias("note"))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assertions of the notes; a session is a day, a turn an event."""
    return tv.assertions(notes(spark, sf_dir), "user_id", "day", "event_id", "note")


@query(f"WITH {STATED_SQL} SELECT event_id, n AS sentence, kind, display, value, unit FROM st")
def typed_value_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stated(spark, sf_dir)
    return rows.select(F.col("turn").alias("event_id"), F.col("n").alias("sentence"), "kind", "display", "value", F.coalesce("unit", F.lit("")).alias("unit"))


@query(f"WITH {STATED_SQL} SELECT event_id, found_ AS kind, lead(event_id) OVER (PARTITION BY user_id, event_type, found_ ORDER BY event_id) IS NULL AS current FROM (SELECT *, kind AS found_ FROM st)")
def value_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions that hold in their slots: later ones of one subject, kind and unit take over. Subjects have all but the value, so here only notes of one value repeat a subject."""
    rows = stated(spark, sf_dir)
    # a sentence with two values keeps the other one in its subject: slots are by template here
    by_template = rows.withColumn("subject_id", F.regexp_replace("subject", "[0-9]+", "#"))
    return tv.superseded(by_template).select(F.col("turn").alias("event_id"), "kind", "current")


CLUSTERS = STATED_SQL + """,
cl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, n, found) AS ordinal FROM st)"""


@query(f"WITH {CLUSTERS}, c AS (SELECT user_id, event_type, kind, count(*) AS members, count(DISTINCT display) AS displays, arg_max(event_id, ordinal) AS picked FROM cl GROUP BY ALL) SELECT * FROM c")
def value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by reported state, content words, kind and unit, and the assertion that holds now in each."""
    rows = tv.chosen(tv.marked(tv.clustered(stated(spark, sf_dir))))
    kinds = notes(spark, sf_dir).select(F.col("event_id").alias("turn"), "event_type")
    c = rows.join(kinds, "turn").groupBy(F.col("namespace").alias("user_id"), "cluster", "event_type", "kind").agg(many().alias("members"), F.count_distinct("display").alias("displays"), F.max(F.when(F.col("picked"), F.col("turn"))).alias("picked"))
    return c.drop("cluster")


@query(f"WITH {STATED_SQL} SELECT kind, past, present, count(*) AS n FROM st GROUP BY ALL")
def correction_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tv.marked(stated(spark, sf_dir)).groupBy("kind", "past", "present").agg(many().alias("n"))


@query(f"WITH {STATED_SQL}, c AS (SELECT user_id, kind, count(DISTINCT display) AS d, bool_or(past) AS r, count(DISTINCT CASE WHEN NOT past THEN display END) AS l FROM st GROUP BY ALL) SELECT event_id, st.kind, CASE WHEN d <= 1 THEN 'none' WHEN r AND l = 1 THEN CASE WHEN past THEN 'superseded' ELSE 'current' END ELSE 'candidate' END AS label FROM st JOIN c ON c.user_id = st.user_id AND c.kind = st.kind")
def advisory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of values that compete within a user's kind."""
    rows = tv.marked(stated(spark, sf_dir)).withColumn("cluster", F.col("kind"))
    return tv.labelled(rows).select(F.col("turn").alias("event_id"), "kind", F.coalesce("label", F.lit("none")).alias("label"))


@query(f"WITH {CLUSTERS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, kind ORDER BY ordinal DESC) = 1 AS picked FROM cl) SELECT DISTINCT user_id, kind, lower(display) AS display FROM p WHERE NOT picked AND (user_id, lower(display)) NOT IN (SELECT (user_id, lower(display)) FROM p WHERE picked)")
def stale_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displays of values that were replaced and that no current value shows."""
    rows = tv.chosen(tv.marked(tv.clustered(stated(spark, sf_dir))))
    return tv.stale_displays(rows).select(F.col("namespace").alias("user_id"), "kind", "display")


@query("SELECT user_id, 'bike' AS noun, count(*) AS amount FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def count_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of counts that notes tell, by user and noun."""
    d = notes(spark, sf_dir).select("user_id", F.inline(tv.deltas(F.col("note"))))
    return d.groupBy("user_id", "noun").agg(F.sum("amount").alias("amount"))


@query("""WITH s AS (SELECT user_id, min(event_id) AS since, 1.0 * (user_id % 4 + 1) AS anchor FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id, min(ts::DATE) AS d FROM events GROUP BY 1), c AS (SELECT e.user_id, count(*) AS change FROM events e JOIN s USING (user_id) WHERE event_type = 'purchase' AND (ts::DATE, event_id) >= (SELECT min((x.ts::DATE, x.event_id)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup') GROUP BY 1)
SELECT user_id, 'bike' AS noun, anchor::BIGINT AS anchor, change, (anchor + change)::BIGINT AS total FROM s JOIN c USING (user_id)""")
def derived_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who state at signup how many bikes they have and tell of more later."""
    n = notes(spark, sf_dir)
    said = F.when(F.col("event_type") == "signup", F.concat(F.lit("We have "), (F.col("user_id") % 4 + 1).cast("string"), F.lit(" bikes."))).when(F.col("event_type") == "purchase", F.lit("I bought a new bike."))
    told = n.select("user_id", "day", "event_id", said.alias("note")).where("note IS NOT NULL")
    rows = tv.clustered(tv.assertions(told, "user_id", "day", "event_id", "note"))
    changes = told.select(F.col("user_id").alias("namespace"), F.col("day").alias("session"), F.col("event_id").alias("turn"), F.col("note").alias("sentence"), F.inline(tv.deltas(F.col("note"))))
    out = tv.counts_folded(rows, changes)
    return out.select(F.col("namespace").alias("user_id"), "noun", F.col("anchor").cast("bigint").alias("anchor"), "change", F.col("total").cast("bigint").alias("total"))


@query(f"WITH {CLUSTERS}, x AS (SELECT user_id, event_id, 20 + (kind = 'count')::INT * 8 + (lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL)::INT * 2 + ordinal / 1e6 AS score, display FROM cl WHERE event_type = 'signup'), b AS (SELECT user_id, display, max(score) AS score FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC) AS rank FROM b) SELECT user_id AS query_id, 'I have watched ' || display || ' so far.' AS sentence, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def typed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's notes say to "How many films have I watched?"."""
    rows = stated(spark, sf_dir)
    rows = tv.superseded(rows.withColumn("subject_id", F.regexp_replace("subject", "[0-9]+", "#")))
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("namespace")).distinct().select("namespace", F.col("namespace").alias("query_id"), F.array(F.lit("film"), F.lit("watched")).alias("words"), F.array(F.lit("count")).alias("kinds"))
    films = rows.where(F.contains("sentence", F.lit("films")))
    return tv.recalled(films, asked, 3)


@query(f"WITH {CLUSTERS}, t AS (SELECT user_id, display AS snippet, row_number() OVER (PARTITION BY user_id ORDER BY ordinal) AS rank FROM (SELECT user_id, display, min(ordinal) AS ordinal FROM cl WHERE kind = 'money' GROUP BY ALL)), r AS (SELECT user_id, 'about ' || display AS snippet, row_number() OVER (PARTITION BY user_id ORDER BY ordinal) AS rank FROM (SELECT user_id, display, min(ordinal) AS ordinal FROM cl WHERE kind = 'clock_time' GROUP BY ALL) WHERE display NOT IN ('1:15 am', '2:15 am')), u AS (SELECT user_id, snippet, 0 AS l, rank FROM t UNION ALL SELECT user_id, snippet, 1, rank FROM r), o AS (SELECT user_id AS query_id, snippet, row_number() OVER (PARTITION BY user_id ORDER BY l, rank) AS rank FROM u) SELECT * FROM o WHERE rank <= 6")
def value_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed snippets first, then recalled ones without stale displays, six at most."""
    rows = stated(spark, sf_dir)
    first = rows.groupBy(F.col("namespace").alias("query_id"), "kind", "display").agg(F.min("ordinal").alias("rank"))
    typed = first.where("kind = 'money'").select("query_id", F.col("display").alias("snippet"), "rank")
    found = first.where("kind = 'clock_time'").select("query_id", F.concat(F.lit("about "), "display").alias("snippet"), "rank")
    stale = first.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("1:15 am"), F.lit("2:15 am"))).alias("display"))
    return tv.with_values(found, typed, stale, 6)


@query(f"WITH {STATED_SQL} SELECT CASE WHEN event_type = 'signup' THEN 'films' WHEN event_type = 'click' THEN 'gym' ELSE 'other' END AS label, count(*) AS n FROM st GROUP BY 1")
def grouping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by stated rules in place of the derived keys."""
    rules = spark.createDataFrame([("films", "films"), ("my gym", "gym")], "pattern string, label string")
    rows = tv.regrouped(stated(spark, sf_dir).withColumn("cluster", F.lit("other")), rules)
    return rows.groupBy(F.col("cluster").alias("label")).agg(many().alias("n"))
