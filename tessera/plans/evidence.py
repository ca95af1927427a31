"""Facet, evidence and intent rankings of documents for benchmark texts.

Documents take the part of memories: source and language are their scope, long tokens their symbols, a length class their operation,
labels their belief and evidence, and a day made from the id their times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import evidence as ev
from ..operators import facets, intent, ranking
from ..operators.sizes import checkpointed, small_side
from ..sources.tables import table
from .catalog import query


FACETS = ["repo", "project", "operation", "symbol", "evidence_type"]


def _long_tokens(text: str):
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 14)))


def _size_class(text: str):
    return F.when(F.length(text) < 1000, "short").when(F.length(text) < 4000, "medium").otherwise("long")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    of_text = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", _size_class("text").alias("operation"), _long_tokens("text").alias("symbol"))
    docs = of_text.join(labels, "doc_id", "left")  # no text travels
    bucket = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "historical").when(F.col("quality") == 1, "current")
    kinds = F.when(F.col("quality") == 1, F.array(F.lit("test"))).when(F.col("quality") == 0, F.array(F.lit("agent_inference"))).otherwise(F.array().cast("array<string>"))
    day = F.format_string("2024-01-%02d", (F.col("doc_id") % 28 + 1).cast("int"))
    return docs.select("doc_id", F.col("source").alias("repo"), F.col("lang").alias("project"), "operation", "symbol", bucket.alias("bucket"), kinds.alias("evidence_type"), day.alias("valid_time"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries."""
    q = table(spark, sf_dir, "benchmark")
    is_english = F.array_contains(tokens("text"), "the")
    goal = F.when(F.col("item_id") % 3 == 2, "historical").otherwise("current")
    return q.select(F.col("item_id").alias("query_id"), F.when(is_english, "en").alias("project"), F.lit("short").alias("operation"), _long_tokens("text").alias("symbol"), F.array(F.lit("test")).alias("evidence_type"), goal.alias("intent"), F.lit("2024-01-15").alias("valid_time"))


def tops(m: DataFrame, q: DataFrame, qf: DataFrame, k: int, *conditions: str) -> DataFrame:
    """The first k documents of each query by all facets, for each condition of `facets.CONDITIONS` named."""
    docs = facets.listed(m, "doc_id", FACETS, "bucket", "valid_time")
    return facets.tops(docs, qf, q.select("query_id", "intent", "valid_time"), {"all": tuple(FACETS)}, k, conditions).drop("mode")


def _facets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    m, q = memories(spark, sf_dir), questions(spark, sf_dir)
    m, q = checkpointed(m), checkpointed(q)
    return m, q, facets.unpivot(m, "doc_id", FACETS), facets.unpivot(q, "query_id", ["project", "operation", "symbol", "evidence_type"])


MEMORIES = """
lb AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, source AS repo, lang AS project, CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 4000 THEN 'medium' ELSE 'long' END AS operation,
  list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 14))) AS symbol,
  CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 0 THEN 'historical' WHEN quality = 1 THEN 'current' END AS bucket,
  CASE WHEN quality = 1 THEN ['test'] WHEN quality = 0 THEN ['agent_inference'] ELSE []::VARCHAR[] END AS kinds,
  '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS valid_time FROM documents LEFT JOIN lb USING (doc_id)),
q AS (SELECT item_id AS query_id, CASE WHEN list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'the') THEN 'en' END AS project, 'short' AS operation,
  list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 14))) AS symbol, ['test'] AS kinds,
  CASE WHEN item_id % 3 = 2 THEN 'historical' ELSE 'current' END AS intent, '2024-01-15' AS valid_time FROM benchmark),
df AS (SELECT doc_id, 'repo' AS facet, repo AS value FROM m WHERE trim(repo) <> '' UNION ALL SELECT doc_id, 'project', project FROM m WHERE trim(project) <> '' UNION ALL SELECT doc_id, 'operation', operation FROM m
  UNION ALL SELECT doc_id, 'symbol', unnest(symbol) FROM m UNION ALL SELECT doc_id, 'evidence_type', unnest(kinds) FROM m),
qf AS (SELECT query_id, 'project' AS facet, project AS value FROM q WHERE project IS NOT NULL UNION ALL SELECT query_id, 'operation', operation FROM q UNION ALL SELECT query_id, 'symbol', unnest(symbol) FROM q UNION ALL SELECT query_id, 'evidence_type', unnest(kinds) FROM q),
sh AS (SELECT query_id, doc_id, facet, value FROM df JOIN qf USING (facet, value)),
ca AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM sh GROUP BY ALL),
car AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ca),
cf AS (SELECT query_id, doc_id, count(*) FILTER (df.value <> qf.value) AS conflicts, count(*) AS compared FROM df JOIN qf USING (facet) WHERE facet IN ('repo', 'branch', 'project', 'namespace') GROUP BY ALL)"""
MEETING = (
    MEMORIES
    + """,
met AS (SELECT query_id, doc_id, count(DISTINCT facet) FILTER (facet IN ('repo', 'project', 'namespace', 'operation', 'object', 'symbol')) AS required, count(*) FILTER (facet IN ('file', 'symbol', 'test')) AS vals, count(*) FILTER (facet = 'evidence_type') AS kinds FROM sh GROUP BY ALL),
mp AS (SELECT query_id, doc_id, 2.0::DOUBLE * required + 1.5 * vals + 1.0 * met.kinds + CASE WHEN m.valid_time <= q.valid_time THEN 1.0 ELSE 0.0 END - CASE WHEN q.intent = 'current' AND bucket IN ('historical', 'anergic', 'blocked') THEN 4.0 ELSE 0.0 END - 5.0 * coalesce(conflicts, 0) AS score
  FROM met JOIN m USING (doc_id) JOIN q USING (query_id) LEFT JOIN cf USING (query_id, doc_id)),
mpr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM mp)"""
)
PAIRS = (
    MEMORIES
    + """,
pa AS (SELECT query_id, doc_id, q.intent, '2024-01-15' AS as_of, car.score / 4 AS similarity,
  CASE WHEN least(len(q.symbol), len(m.symbol)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(q.symbol, m.symbol)) / least(len(q.symbol), len(m.symbol)) END AS structure,
  coalesce(compared, 0) AS compared, coalesce(conflicts, 0) AS conflicts, bucket, m.valid_time AS valid, m.kinds AS kinds
  FROM car JOIN q USING (query_id) JOIN m USING (doc_id) LEFT JOIN cf USING (query_id, doc_id) WHERE rank <= 20),
st AS (SELECT *, CASE WHEN bucket IN ('historical', 'anergic', 'blocked') THEN 'superseded' WHEN valid > as_of THEN 'not_yet_valid' ELSE 'current' END AS status FROM pa),
evi AS (
  SELECT query_id, doc_id, intent, 'semantic' AS source, CASE WHEN similarity > 0 THEN 'support' ELSE 'neutral' END AS polarity, 'relevance' AS target, greatest(0, least(1, similarity))::DOUBLE AS prob, 1.0::DOUBLE AS conf, 1.0::DOUBLE AS direct FROM st
  UNION ALL SELECT query_id, doc_id, intent, 'structure', CASE WHEN structure > 0 THEN 'support' ELSE 'missing' END, 'relevance', structure, 1, 1 FROM st
  UNION ALL SELECT query_id, doc_id, intent, 'scope', CASE WHEN compared = 0 THEN 'missing' WHEN conflicts > 0 THEN 'contradict' ELSE 'support' END, 'scope', CASE WHEN compared = 0 THEN 0 WHEN conflicts > 0 THEN conflicts / compared ELSE 1 END, CASE WHEN compared = 0 THEN 0.5 ELSE 1 END, 1 FROM st
  UNION ALL SELECT query_id, doc_id, intent, 'temporal',
    CASE WHEN status = 'not_yet_valid' THEN 'contradict' WHEN status = 'superseded' THEN CASE WHEN intent = 'historical' THEN 'support' ELSE 'contradict' END ELSE CASE WHEN intent = 'historical' THEN 'neutral' ELSE 'support' END END,
    CASE WHEN status <> 'not_yet_valid' AND intent = 'historical' THEN 'historicality' ELSE 'currentness' END,
    CASE WHEN status = 'not_yet_valid' THEN 0.9 WHEN status = 'superseded' THEN 1.0 WHEN intent = 'historical' THEN 0.3 ELSE 0.8 END,
    CASE WHEN status = 'not_yet_valid' THEN 0.9 WHEN status = 'superseded' THEN 0.9 WHEN intent = 'historical' THEN 0.6 ELSE 0.8 END,
    CASE WHEN status = 'superseded' THEN 0.6 ELSE 1.0 END FROM st
  UNION ALL SELECT query_id, doc_id, intent, 'evidence', CASE WHEN len(kinds) = 0 THEN 'missing' ELSE 'support' END, 'relevance', CASE WHEN len(kinds) = 0 THEN 0 WHEN kinds = ['test'] THEN 1 ELSE 0.5 END, CASE WHEN len(kinds) = 0 THEN 0.3 WHEN kinds = ['test'] THEN 1 ELSE 0.5 END, CASE WHEN len(kinds) = 0 THEN 0.3 WHEN kinds = ['test'] THEN 1 ELSE 0.4 END FROM st),
ew AS (SELECT *, CASE source WHEN 'semantic' THEN 0.8 WHEN 'scope' THEN 0.6 WHEN 'evidence' THEN 1.2 ELSE 1.0 END AS w, prob * conf * direct AS s FROM evi),
we AS (SELECT query_id, doc_id, sum(CASE polarity WHEN 'support' THEN w * s WHEN 'contradict' THEN -w * s ELSE 0 END) AS score, count(*) FILTER (polarity = 'missing') / count(*) AS uncertainty FROM ew GROUP BY ALL)"""
)


def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty facet candidates of each query with what the sources of evidence look at."""
    m, q, df, qf = _facets(spark, sf_dir)
    top = checkpointed(tops(m, q, qf, 20, "index").drop("condition"))
    df = df.join(small_side(top.select("doc_id").distinct()), "doc_id", "left_semi")
    pairs = top.join(q.select("query_id", "intent", F.col("symbol").alias("asked")), "query_id").join(m.select("doc_id", "symbol", "bucket", F.col("valid_time").alias("valid"), F.col("evidence_type").alias("kinds")), "doc_id")
    pairs = facets.conflicts(pairs, df, qf)
    least = F.least(F.size("asked"), F.size("symbol"))
    structure = F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect("asked", "symbol")) / F.greatest(least, F.lit(1)))
    no_text = F.lit(None).cast("string")
    return pairs.select(
        "query_id", "doc_id", "intent", F.lit("2024-01-15").alias("as_of"), (F.col("score") / 4).alias("similarity"), structure.alias("structure"), F.coalesce("compared", F.lit(0)).alias("compared"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"),
        no_text.alias("created"), "valid", no_text.alias("invalid"), F.lit(False).alias("superseded"), "bucket", "kinds",
    )


@query(f"WITH {MEMORIES} SELECT query_id, doc_id, score, rank FROM car WHERE rank <= 10")
def facet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, q, _, qf = _facets(spark, sf_dir)
    return tops(m, q, qf, 10, "index").drop("condition")


@query(f"WITH {MEETING} SELECT query_id, doc_id, score, rank FROM mpr WHERE rank <= 10")
def meetpoint_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, q, _, qf = _facets(spark, sf_dir)
    return tops(m, q, qf, 10, "meeting_point").drop("condition")


@query(f"WITH {MEETING}, u AS (SELECT 'index' AS condition, query_id, doc_id, rank FROM car UNION ALL SELECT 'meeting_point', query_id, doc_id, rank FROM mpr) SELECT condition, count(DISTINCT query_id) AS n_queries, round(avg(CASE WHEN bucket IN ('historical', 'blocked') THEN 1.0 ELSE 0.0 END), 6) AS stale_share, round(avg(CASE WHEN coalesce(conflicts, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS conflict_share FROM u JOIN m USING (doc_id) LEFT JOIN cf USING (query_id, doc_id) WHERE rank <= 5 GROUP BY condition")
def facet_ladder_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the first five candidates are stale or out of scope, by facet index and by meeting point."""
    m, q, df, qf = _facets(spark, sf_dir)
    rows = checkpointed(tops(m, q, qf, 5, "index", "meeting_point").select("condition", "query_id", "doc_id"))
    df = df.join(small_side(rows.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = facets.conflicts(rows.join(m.select("doc_id", "bucket"), "doc_id"), df, qf)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("condition").agg(F.count_distinct("query_id").alias("n_queries"), share(F.col("bucket").isin("historical", "blocked")).alias("stale_share"), share(F.coalesce("conflicts", F.lit(0)) > 0).alias("conflict_share"))


@query(f"WITH {PAIRS} SELECT query_id, doc_id, source, polarity, target, round(prob, 6) AS prob, conf, direct FROM evi")
def oracle_evidence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.collect(evidence_pairs(spark, sf_dir)).drop("intent").withColumn("prob", F.round("prob", 6))


@query(f"WITH {PAIRS} SELECT query_id, doc_id, round(score, 6) AS score, round(uncertainty, 6) AS uncertainty, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM we")
def oracle_weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(ev.weighted(ev.collect(evidence_pairs(spark, sf_dir)))).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round("uncertainty", 6).alias("uncertainty"), "rank")


LOG_SPACE = (
    PAIRS
    + """,
lz AS (SELECT query_id, doc_id, intent, polarity, target, s, CASE WHEN polarity = 'support' THEN least(3.0, w * s * CASE target WHEN 'scope' THEN 0.25 ELSE 1 END) ELSE 0 END AS gain, CASE target WHEN 'currentness' THEN 2.5 WHEN 'scope' THEN 2.0 ELSE 2.0 END * pow(s, 1.5) AS loss FROM ew),
z AS (SELECT query_id, doc_id, intent, coalesce(sum(gain) FILTER (target IN ('relevance', 'scope')), 0) - coalesce(sum(loss) FILTER (polarity = 'contradict' AND target IN ('relevance', 'scope')), 0) AS relevant,
  coalesce(sum(gain) FILTER (target = 'currentness'), 0) - coalesce(sum(loss) FILTER (polarity = 'contradict' AND target = 'currentness'), 0) AS current_,
  coalesce(sum(gain) FILTER (target = 'historicality'), 0) + coalesce(sum(0.5 * s) FILTER (polarity = 'contradict' AND target = 'currentness'), 0) AS historical,
  coalesce(sum(loss) FILTER (polarity = 'contradict' AND target = 'scope'), 0) AS blocked FROM lz GROUP BY ALL),
zs AS (SELECT *, CASE WHEN intent = 'historical' THEN relevant + historical - blocked ELSE relevant + current_ - blocked END AS score FROM z)"""
)


@query(f"WITH {LOG_SPACE} SELECT query_id, doc_id, round(relevant, 6) AS relevant, round(current_, 6) AS current, round(historical, 6) AS historical, round(blocked, 6) AS blocked, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM zs")
def oracle_combined_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.ranked(ev.log_space(ev.collect(evidence_pairs(spark, sf_dir))))
    return out.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("relevant", "current", "historical", "blocked", "score")), "rank")


@query(
    f"""WITH {PAIRS}, sub AS (SELECT unnest([{{'name': 'semantic', 'k': ['semantic']}}, {{'name': 'plus_structure', 'k': ['semantic', 'structure']}}, {{'name': 'plus_scope', 'k': ['semantic', 'structure', 'scope']}}, {{'name': 'plus_temporal', 'k': ['semantic', 'structure', 'scope', 'temporal']}}, {{'name': 'all', 'k': ['semantic', 'structure', 'scope', 'temporal', 'evidence']}}]) AS s),
a AS (SELECT sub.s.name AS subset, query_id, doc_id, sum(CASE polarity WHEN 'support' THEN w * ew.s WHEN 'contradict' THEN -w * ew.s ELSE 0 END) AS score FROM ew JOIN sub ON list_contains(sub.s.k, source) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subset, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a)
SELECT subset, count(*) AS shown, round(avg(CASE WHEN bucket IN ('historical', 'blocked') THEN 1.0 ELSE 0.0 END), 6) AS stale_share FROM r JOIN m USING (doc_id) WHERE rank <= 3 GROUP BY subset"""
)
def oracle_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale share of the first three with more and more sources of evidence."""
    rows = ev.collect(evidence_pairs(spark, sf_dir))
    names = ["semantic", "plus_structure", "plus_scope", "plus_temporal", "all"]
    at = F.array_position(F.lit(ev.SOURCES), F.col("source")).cast("int")
    spread = rows.withColumn("subset", F.explode(F.slice(F.lit(names), at, len(names))))
    keyed = spread.withColumn("query_id", F.struct("subset", "query_id"))
    top = ranking.ranked(ev.weighted(keyed), 3).join(memories(spark, sf_dir).select("doc_id", "bucket"), "doc_id")
    return top.groupBy(F.col("query_id.subset").alias("subset")).agg(F.count(F.lit(1)).alias("shown"), F.round(F.avg(F.when(F.col("bucket").isin("historical", "blocked"), 1.0).otherwise(0.0)), 6).alias("stale_share"))


def _cue_sql(column: str) -> str:
    named = [f"CASE WHEN {' OR '.join(f'''contains({column}, '{c}')''' for c in cues)} THEN '{name}' END" for name, cues in intent.CUES.items()]
    return f"list_filter([{', '.join(named)}], lambda x: x IS NOT NULL)"


INTENTS = f"""
tx AS (SELECT event_id, 'what is ' || event_type || ' for ' || user_id || CASE WHEN value > 50 THEN ', still valid' ELSE '' END AS text FROM events),
hi AS (SELECT event_id, {_cue_sql('lower(text)')} AS h FROM tx)"""


def _event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.concat(F.lit("what is "), "event_type", F.lit(" for "), F.col("user_id").cast("string"), F.when(F.col("value") > 50, ", still valid").otherwise("")).alias("text"))


@query(f"WITH {INTENTS} SELECT event_id, CASE WHEN len(h) = 0 THEN 'understand_system' ELSE h[1] END AS \"primary\", CASE WHEN len(h) = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN list_contains(h, 'avoid_repeat') THEN 'historical' WHEN list_contains(h, 'verify_currentness') THEN 'any' ELSE 'current' END AS lens, len(h) AS n_hits FROM hi")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intent.classify(_event_texts(spark, sf_dir), "text")
    return out.select("event_id", "primary", "confidence", "lens", F.when(F.col("confidence") == "low", 0).otherwise(F.size("intents")).cast("bigint").alias("n_hits"))


FIT_ROWS = ", ".join(f"('{i}', '{r}', {intent.WEIGHT[f]}::DOUBLE)" for i, fits in intent.FIT.items() for f, roles in fits.items() for r in roles)


@query(
    f"""WITH {INTENTS}, fit(intent, role, weight) AS (VALUES {FIT_ROWS}),
c AS (SELECT event_type, unnest(CASE event_type WHEN 'error' THEN ['failure', 'test'] WHEN 'purchase' THEN ['decision'] WHEN 'view' THEN ['reference'] WHEN 'signup' THEN ['plan'] ELSE ['benchmark'] END) AS role FROM (SELECT DISTINCT event_type FROM events)),
i AS (SELECT event_id, event_type, unnest(CASE WHEN len(h) = 0 THEN ['understand_system'] ELSE h END) AS intent FROM hi JOIN events USING (event_id)),
b AS (SELECT event_id, i.event_type, max(weight) AS weight FROM i JOIN c ON c.event_type = i.event_type JOIN fit USING (intent, role) GROUP BY ALL)
SELECT event_type, weight, count(*) AS n FROM b GROUP BY ALL"""
)
def intent_affinity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the role of each event's type fits the intents of its text."""
    asked = intent.classify(_event_texts(spark, sf_dir), "text")
    c = F.col("event_type")
    artifact = F.when(c == "error", "failure").when(c == "purchase", "decision").when(c == "view", "doc").when(c == "signup", "plan").otherwise("")
    anchors = F.when(c == "click", F.array(F.lit("bench/run.md"))).otherwise(F.array().cast("array<string>"))
    kinds = F.when(c == "error", F.array(F.lit("test"))).otherwise(F.array().cast("array<string>"))
    pairs = asked.select(F.col("event_id").alias("query_id"), c.alias("doc_id"), "intents", intent.roles(artifact, anchors, kinds).alias("roles"))
    return intent.affinity(pairs).groupBy(F.col("doc_id").alias("event_type"), "weight").agg(F.count(F.lit(1)).alias("n"))
