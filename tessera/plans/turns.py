"""Queries of messages: how they are taken in, what they claim, what they mention again. Messages are made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import claims
from ..operators import claim_scan, segments
from ..sources.tables import table
from .catalog import many, query

LONG = "Lisbon was warm. Anna moved to Porto in May. Bruno sold the old boat in Faro. Carla joined the choir. " + "The rest of the day went by with talk of the weather. " * 4
#: Message, speaker and what becomes of it, by event type.
MESSAGES = {
    "signup": ("I moved to Lisbon in May.", "user", "EXTRACT_WHOLE"),
    "view": ("What do you think about it?", "user", "CONTEXT_ONLY"),
    "click": ("Thanks again for your help!", "user", "CONTEXT_ONLY"),
    "error": ("I've booked the table.", "assistant", "EXTRACT_WHOLE"),
    "purchase": (LONG.strip(), "user", "SEGMENT_CLAIMS"),
}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    pick = lambda k: F.coalesce(*(F.when(t == n, F.lit(m[k])) for n, m in MESSAGES.items()))
    quiet = F.col("event_id") % 10 == 0
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(quiet, "  ").otherwise(pick(0)).alias("text"), pick(1).alias("role"))


MODES = "CASE WHEN event_id % 10 = 0 THEN 'SKIP' " + " ".join(f"WHEN event_type = '{t}' THEN '{m[2]}'" for t, m in MESSAGES.items()) + " END"


@query(f"SELECT event_type, {MODES} AS mode, count(*) AS n FROM events GROUP BY ALL")
def intake_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.groupBy("event_type", segments.mode(F.col("role"), F.col("text")).alias("mode")).agg(many().alias("n"))


@query("SELECT event_type, event_type IN ('click') AS corrections, event_type IN ('signup', 'purchase') AS changes, event_type = 'purchase' AS several, event_type = 'purchase' AS shift, event_type = 'purchase' AS buried, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL")
def claim_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where("event_id % 10 <> 0").withColumn("s", segments.signals(F.col("text")))
    return m.groupBy("event_type", *(F.col(f"s.{c}").alias(c) for c in ("corrections", "changes", "several", "shift", "buried"))).agg(many().alias("n"))


#: What a document's author goes on to say, by its id.
TOLD = ["Anna moved to Porto in May. It was warm there.", "My sister Carla joined us. Actually, she left early!", "Nothing new here. Thanks again for all.", "we stopped. Bruno no longer sings? He Quit", "It turns out that Dora retired.\\n\\nShe was glad. Dora retired.", "No one knows."]


def tales(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.lit(TOLD), (F.col("doc_id") % len(TOLD) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said).alias("text"))


@query(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || ([{", ".join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in TOLD)}])[doc_id % {len(TOLD)} + 1] AS text FROM documents),
l AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+([A-Z])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS parts FROM t), s AS (SELECT doc_id, text, i - 1 AS n, regexp_replace(parts[i], '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS claim FROM l, range(1, 100000) r(i) WHERE i <= len(parts))
SELECT doc_id, n, claim, CASE WHEN regexp_matches(claim, '{segments.CORRECTION}') THEN 'state_update' ELSE 'new_fact' END AS kind, regexp_extract(claim, '{segments.SUBJECTS}', 1) AS subject, instr(text, claim) - 1 AS start, instr(text, claim) - 1 + length(claim) AS stop
FROM s WHERE claim <> '' AND (regexp_matches(claim, '{segments.CORRECTION}') OR regexp_matches(claim, '{segments.STATE}'))"""
)
def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the documents and of what their authors go on to say, with their kinds, subjects and places."""
    c = segments.claims(tales(spark, sf_dir), ["doc_id"], "text")
    return c.select("doc_id", "claim", "kind", "subject", *(F.col(x).cast("bigint").alias(x) for x in ("n", "start", "stop")))


@query("SELECT 'adaptive' AS arm, count(*) * 1 AS turns, sum(CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_type = 'purchase' THEN 8 ELSE 1 END)::BIGINT AS pieces FROM events UNION ALL SELECT 'none', count(*), count(*) FROM events UNION ALL SELECT 'sentence', count(*), sum(CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_type = 'purchase' THEN 8 ELSE 1 END)::BIGINT FROM events UNION ALL SELECT 'user_sentence', count(*), sum(CASE WHEN event_type <> 'error' AND event_id % 10 = 0 THEN 0 WHEN event_type = 'purchase' THEN 8 ELSE 1 END)::BIGINT FROM events")
def segmentation_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    rows = None
    for name in ("none", "sentence", "user_sentence", "adaptive"):
        row = segments.arm(m, name, "role", "text").agg(F.lit(name).alias("arm"), many().alias("turns"), F.sum(F.size("pieces")).alias("pieces"))
        rows = row if rows is None else rows.unionByName(row)
    return rows.select("arm", "turns", "pieces")


#: Lines by event type: markers, claims, mentions.
LINES = {"signup": "<!-- claim-scan: ignore-start -->", "error": "<!-- claim-scan: ignore-end -->", "view": "<!-- claim-scan: ignore-next-line -->", "click": "It beats 40% on mmlu, accuracy of 0.82", "purchase": "see src/app.py and run git status"}
LINE_SQL = "ln AS (SELECT event_id, user_id, event_type FROM events), sp AS (SELECT *, coalesce(last_value(CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS open_ FROM ln), sk AS (SELECT *, coalesce(lag(event_type = 'view' AND NOT open_) OVER (PARTITION BY user_id ORDER BY event_id), false) AS skip FROM sp), rd AS (SELECT * FROM sk WHERE NOT open_ AND NOT skip AND event_type NOT IN ('error', 'view'))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(x)) for t, x in LINES.items()))
    return table(spark, sf_dir, "events").select("event_id", "user_id", line.alias("line"))


@query(f"WITH {LINE_SQL} SELECT event_id, unnest(['40%', 'accuracy of 0.82', 'beats 40%', '40% on mmlu']) AS claim FROM rd WHERE event_type = 'click'")
def public_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the lines that markers do not exclude."""
    return claims.read_lines(lines(spark, sf_dir), ["user_id"], "event_id", "line").select("event_id", F.explode(claims.claims(F.col("line"))).alias("claim"))


@query("WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase') SELECT user_id, 'src/app.py' AS path, 'git status' AS command, count(*) - 1 AS repeats FROM m GROUP BY user_id")
def continuity_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and commands that come up again in a user's lines."""
    m = lines(spark, sf_dir).select("user_id", "event_id", claims.paths(F.col("line")).alias("p"), claims.commands(F.col("line")).alias("c")).where("event_id IS NOT NULL")
    seen = m.where(F.size("c") > 0).select("user_id", F.explode("p").alias("path"), F.get("c", F.lit(0)).alias("command"))
    return seen.groupBy("user_id", "path", "command").agg((many() - 1).alias("repeats"))


@query("WITH p AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1), f AS (SELECT e.user_id, count(*) AS total, count(*) FILTER (e.event_type = 'purchase' AND e.event_id > first) AS continued FROM events e LEFT JOIN p USING (user_id) GROUP BY 1) SELECT user_id, round(CASE WHEN total = 0 THEN 0 ELSE continued / total END, 6) AS continuity FROM f")
def verification_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a user's lines that mention a path seen before and wish to read nothing again."""
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(spark, sf_dir).withColumn("p", claims.paths(F.col("line"))).withColumn("first", F.first(F.when(F.size("p") > 0, F.get("p", F.lit(0))), True).over(by))
    ok = F.coalesce(F.contains(F.lower("line"), F.lower("first")), F.lit(False)) & ~F.regexp_like("line", F.lit(claims.READ_AGAIN))
    return rows.groupBy("user_id").agg(F.round(F.count_if(ok) / many(), 6).alias("continuity"))


@query("SELECT p_partkey, sha256('{\"a\":' || p_partkey || ',\"b\":\"' || p_name || '\"}') AS digest FROM part")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", claims.canonical({"b": F.col("p_name"), "a": F.col("p_partkey")}).alias("digest"))


@query("SELECT event_id, event_type IN ('click', 'view') AS leaks FROM events")
def question_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that give away the identifier they ask for."""
    q = F.when(F.col("event_type").isin("click", "view"), "where is loadAll_items defined?").otherwise("where are items loaded?")
    return table(spark, sf_dir, "events").select("event_id", claims.leaks(q, F.array(F.lit("loadAll_items"), F.lit("items"))).alias("leaks"))


#: Lines that stand after a document's own, by its id, and the headlines that may back them.
CLAIMED = [
    ["Widget beats 40% of others", "and about 12% more"], ["<!-- claim-scan: ignore-start -->", "accuracy of 0.82", "<!-- claim-scan: ignore-end -->", "cuts 5 here"], ["<!-- claim-scan: ignore-next-line -->", "a gain 7% over all", "mmlu: 61.5"],
    ["nothing"], ["The indexer has", "accuracy 0.82", "on gsm8k 70%"], ["score of 3"],
]
HEADLINES = [("Widget-Pro", "beats 40%", "40%"), ("Indexer", "best accuracy", "0.82 accuracy"), ("_none_", "any", "12%")]


def claimed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.lit(CLAIMED), (F.col("doc_id") % len(CLAIMED) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), extra)).alias("n", "line"))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), "line")


def _patterns() -> str:
    return ", ".join(f"regexp_extract_all(line, '{p}')" for p in (claims.PERCENT, claims.SCORE, claims.COMPARED, claims.NAMED))


@query(
    f"""WITH x AS (SELECT doc_id, list_concat(string_split(coalesce(text, ''), chr(10)), ([{", ".join("[" + ", ".join("'" + y + "'" for y in xs) + "]" for xs in CLAIMED)}])[doc_id % {len(CLAIMED)} + 1]) AS ls FROM documents),
l AS (SELECT doc_id, i AS n, ls[i] AS line FROM x, range(1, 100000) r(i) WHERE i <= len(ls)), k AS (SELECT *, regexp_matches(line, '<!--\\s*claim-scan:\\s*ignore-start\\s*-->') AS st, regexp_matches(line, '<!--\\s*claim-scan:\\s*ignore-end\\s*-->') AS en, regexp_matches(line, '<!--\\s*claim-scan:\\s*ignore-next-line\\s*-->') AS nx FROM l),
o AS (SELECT *, coalesce(last_value(CASE WHEN st THEN true WHEN en THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS open_, lower(string_agg(line, ' ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS around FROM k),
q AS (SELECT *, NOT open_ AND NOT st AND NOT en AS rd FROM o), p AS (SELECT *, coalesce(lag(rd AND nx) OVER (PARTITION BY doc_id ORDER BY n), false) AS bf FROM q),
c AS (SELECT doc_id, n, around, trim(unnest(list_concat({_patterns()}))) AS claim FROM p WHERE rd AND NOT nx), h(product, phrase, val) AS (VALUES ('widget-pro', 'beats 40%', '40%'), ('indexer', 'best accuracy', '0.82 accuracy')),
j AS (SELECT doc_id, EXISTS (SELECT 1 FROM h WHERE (contains(lower(claim), val) OR contains(val, lower(claim)) OR len(list_intersect([t FOR t IN string_split_regex(lower(claim), '\\s+') IF regexp_matches(t, '\\d')], [t FOR t IN string_split(val, ' ') IF regexp_matches(t, '\\d')])) > 0) AND (contains(around, product) OR contains(around, split_part(product, '-', 1)) OR contains(around, phrase))) AS ok FROM c),
s AS (SELECT doc_id, count(*) AS detected, count(*) FILTER (NOT ok) AS unapproved FROM j GROUP BY 1), g AS (SELECT doc_id, count(*) AS ignored FROM p WHERE bf GROUP BY 1)
SELECT doc_id, coalesce(detected, 0) + coalesce(ignored, 0) AS detected, coalesce(ignored, 0) AS ignored, coalesce(unapproved, 0) AS unapproved, coalesce(unapproved, 0) = 0 AS ok FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)"""
)
def claim_scan_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in the lines of documents, and how many no headline backs."""
    lines_ = claimed_lines(spark, sf_dir)
    heads = spark.createDataFrame(HEADLINES, "product string, claim string, value string")
    return claim_scan.by_file(claim_scan.judged(claim_scan.found(lines_, "doc_id", "n", "line"), heads, "doc_id", "n"), lines_, "doc_id")
