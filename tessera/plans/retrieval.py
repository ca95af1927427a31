"""Retrieval of documents for benchmark texts: rankings, their measures and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, metrics, ranking, texts
from ..operators.sizes import checkpointed, small_side
from ..sources.tables import table
from .catalog import query

ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return docs, asked


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text: four fifths or more of its distinct runs of five tokens (of all its tokens, if fewer). Written down, since all texts are read for it."""
    docs, asked = corpus(spark, sf_dir)
    return checkpointed(texts.holding(docs, "doc_id", asked, "query_id").select("query_id", "doc_id"))


def indexed(spark: SparkSession, sf_dir: str) -> ranking.Index:
    return ranking.index(*corpus(spark, sf_dir))


def both_rankings(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """BM25 and count-cosine rankings from one index, written down since fusing reads them again."""
    at = indexed(spark, sf_dir)
    return tuple(checkpointed(f(at, k)) for f in (ranking.bm25_top, ranking.tf_cosine_top))


def conditions(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """(condition, query_id, doc_id, rank) of three rankings, `k` deep."""
    lexical, counts = both_rankings(spark, sf_dir, k)
    both = ranking.ranked(ranking.fuse(lexical, counts), k)
    named = [r.select(F.lit(n).alias("condition"), "query_id", "doc_id", "rank") for n, r in (("bm25", lexical), ("cosine", counts), ("rrf", both))]
    return named[0].unionByName(named[1]).unionByName(named[2])


TERMS = """
qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
dl AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
dt AS (SELECT doc_id, term, count(*) AS tf, max(length) AS length FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM dl) GROUP BY doc_id, term),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dl)"""
BM25 = (
    TERMS
    + """,
wt AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM dt, corpus GROUP BY term, n),
bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM qt JOIN dt USING (term) JOIN wt USING (term), corpus GROUP BY query_id, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE score > 0)"""
)
COSINE = """,
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM dt GROUP BY doc_id),
qn AS (SELECT query_id, sqrt(sum(times * times)) AS qn FROM qt GROUP BY query_id),
co AS (SELECT query_id, doc_id, sum(tf * times) / max(dn * qn) AS score FROM qt JOIN dt USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id),
cor AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM co)"""
FUSED = """,
fu AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM bmr WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM cor WHERE rank <= 50) GROUP BY query_id, doc_id),
fur AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fu)"""
GOLD = """
iw AS (SELECT item_id AS query_id, w, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT DISTINCT query_id, k, unnest([array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM iw),
dg AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM dl, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
gold AS (SELECT query_id, doc_id FROM ig JOIN dg USING (k, g) JOIN (SELECT query_id, count(*) AS n FROM ig GROUP BY 1) USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) / n >= 0.8 - 1e-9),
"""
CONDITIONS = (
    BM25
    + COSINE
    + FUSED
    + """,
conditions AS (SELECT 'bm25' AS condition, query_id, doc_id, rank FROM bmr WHERE rank <= 50 UNION ALL SELECT 'cosine', query_id, doc_id, rank FROM cor WHERE rank <= 50 UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM fur WHERE rank <= 50),
"""
    + GOLD
    + """ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
judged AS (SELECT c.*, g.doc_id IS NOT NULL AS hit, coalesce(n_gold, 0) AS n_gold FROM conditions c LEFT JOIN gold g USING (query_id, doc_id) LEFT JOIN ng USING (query_id))"""
)
PER_QUERY = (
    CONDITIONS
    + """,
pq0 AS (SELECT condition, query_id, max(n_gold) AS n_gold, count(*) FILTER (hit AND rank <= 5) AS hits, count(*) FILTER (rank <= 5) AS shown, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1.0)) FILTER (hit AND rank <= 10), 0) AS gain FROM judged GROUP BY ALL),
pq AS (SELECT condition, query_id, n_gold, CASE WHEN n_gold = 0 THEN 0 ELSE hits / n_gold END AS recall, CASE WHEN shown = 0 THEN 0 ELSE hits / shown END AS precision, coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank,
  CASE WHEN n_gold = 0 THEN 0 ELSE gain / list_sum(list_transform(generate_series(1, least(n_gold, 10)), lambda i: 1 / log2(i + 1.0))) END AS ndcg, CASE WHEN n_gold > 0 AND hits = n_gold THEN 1 ELSE 0 END AS sufficient FROM pq0),
means AS (SELECT condition, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg), 6) AS ndcg, round(avg(sufficient), 6) AS sufficient FROM pq GROUP BY condition)"""
)


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25_top(indexed(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {TERMS}{COSINE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM cor WHERE rank <= 10")
def tf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tf_cosine_top(indexed(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {BM25}{COSINE}{FUSED} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fur WHERE rank <= 10")
def rrf_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(ranking.fuse(*both_rankings(spark, sf_dir, 50)), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {PER_QUERY} SELECT * FROM means")
def retrieval_metrics_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.means(metrics.per_query(metrics.judged(conditions(spark, sf_dir), gold(spark, sf_dir))))


KNOWN = CONDITIONS + """,
known AS (SELECT condition, query_id, coalesce(min(rank) FILTER (hit AND rank <= 20), 21) AS known_rank FROM judged WHERE n_gold > 0 GROUP BY ALL)"""


@query(f"WITH {KNOWN} SELECT condition, count(*) AS n, round(avg(1.0::DOUBLE / known_rank), 6) AS mrr, count(*) FILTER (known_rank <= 5) AS within_5, round(median(known_rank), 6) AS median_rank FROM known GROUP BY condition")
def known_item_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = metrics.known_item(metrics.judged(conditions(spark, sf_dir), gold(spark, sf_dir)), 20)
    return known.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / F.col("known_rank")), 6).alias("mrr"), F.count_if(F.col("known_rank") <= 5).alias("within_5"), F.round(F.median("known_rank"), 6).alias("median_rank")
    )


@query(f"WITH {KNOWN} SELECT k.condition, count(*) AS compared, count(*) FILTER (k.known_rank > b.known_rank) AS worse, count(*) FILTER (k.known_rank < b.known_rank) AS better FROM known k JOIN known b ON b.query_id = k.query_id AND b.condition = 'bm25' WHERE k.condition <> 'bm25' GROUP BY k.condition")
def rank_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regressions(metrics.known_item(metrics.judged(conditions(spark, sf_dir), gold(spark, sf_dir)), 20), "bm25")


@query(
    f"""WITH {PER_QUERY}, x AS (SELECT m.*, b.recall AS br, b.reciprocal_rank AS bm, b.precision AS bp FROM means m, means b WHERE b.condition = 'cosine' AND m.condition <> 'cosine'),
g AS (SELECT condition, ((br < 1 AND recall - br > 0) OR (bm < 1 AND reciprocal_rank - bm > 0)) AND recall - br >= 0 AND reciprocal_rank - bm >= 0 AND precision - bp >= 0 AS passes, round(recall + reciprocal_rank, 6) AS primary_sum, round(greatest(0, bp - precision), 6) AS guard_loss FROM x)
SELECT condition, passes, primary_sum, guard_loss, coalesce(condition = (SELECT condition FROM g WHERE passes ORDER BY primary_sum DESC, guard_loss, condition LIMIT 1), false) AS wins FROM g"""
)
def win_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.means(metrics.per_query(metrics.judged(conditions(spark, sf_dir), gold(spark, sf_dir))))
    return gates.win_gate(wide, "cosine", ["recall", "reciprocal_rank"], ["precision"])


ALPHA = (
    TERMS
    + """,
qs AS (SELECT query_id, count(*) AS qs, max_by(term, (length(term), term)) AS exact FROM qt GROUP BY query_id),
ds AS (SELECT doc_id, count(*) AS ds FROM dt GROUP BY doc_id),
both_ AS (SELECT query_id, doc_id, count(*) AS b, bool_or(term = exact) AS has_exact FROM qt JOIN dt USING (term) JOIN qs USING (query_id) GROUP BY ALL),
blend AS (SELECT alpha, query_id, doc_id, has_exact, alpha * b / (ds + qs - b) + (1 - alpha) * b / qs AS s FROM both_ JOIN qs USING (query_id) JOIN ds USING (doc_id), (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS alpha)),
al AS (SELECT alpha, query_id, doc_id, CASE WHEN has_exact AND alpha < 1 THEN greatest(s, 0.05) ELSE s END AS score FROM blend),
alr AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM al WHERE score > 0)"""
)


@query(f"WITH {ALPHA} SELECT alpha, query_id, doc_id, round(score, 6) AS score FROM alr WHERE rank = 1")
def alpha_sweep_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.alpha_tops(indexed(spark, sf_dir), ALPHAS, 1).select("alpha", "query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {ALPHA},{GOLD}j AS (SELECT alpha, query_id, min(rank) FILTER (g.doc_id IS NOT NULL) AS first, count(g.doc_id) FILTER (rank <= 5) AS hits FROM alr LEFT JOIN gold g USING (query_id, doc_id) GROUP BY ALL)
SELECT alpha, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(hits / n), 6) AS recall_at_5 FROM j JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id) USING (query_id) GROUP BY alpha"""
)
def alpha_sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first gold documents need a rank."""
    answers = gold(spark, sf_dir)
    n = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ranks = ranking.alpha_ranks(indexed(spark, sf_dir), ALPHAS, answers, 5)
    per = ranks.groupBy("alpha", "query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("hits"))
    grid = n.crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in ALPHAS], "alpha double"))).join(per, ["alpha", "query_id"], "left")
    return grid.groupBy("alpha").agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")), 6).alias("recall_at_5"))


COSINES = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, CASE WHEN q.norm * d.norm = 0 THEN 0 ELSE greatest(0, least(1, list_dot_product(q.e, d.e) / (d.norm * q.norm))) END AS score FROM n q JOIN n d ON d.vec_id <> q.vec_id"""
NEAR = """),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""
VECTORS = COSINES + " WHERE q.vec_id % 50 = 0" + NEAR


def _neighbours(spark: SparkSession, sf_dir: str, asked: str = "true") -> DataFrame:
    """Ten nearest vectors of each vector, or of those for which `asked` holds of their doc_id."""
    vectors = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return ranking.nearest(vectors, vectors.where(asked).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), 10)


@query(f"WITH {VECTORS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of the query set: every vector whose id is divisible by 50."""
    return _neighbours(spark, sf_dir, "doc_id % 50 = 0").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {COSINES}{NEAR}, c AS (SELECT label, count(*) - 1 AS others FROM embeddings GROUP BY label),
g AS (SELECT query_id, ql, sum(CASE WHEN ql = dl THEN 1 / log2(rank + 1.0) ELSE 0 END) AS gain FROM r WHERE rank <= 10 GROUP BY ALL)
SELECT label::BIGINT AS label, round(avg(CASE WHEN others = 0 THEN 0 ELSE gain / list_sum(list_transform(generate_series(1, least(others, 10)), lambda i: 1 / log2(i + 1.0))) END), 6) AS ndcg FROM g JOIN c ON ql = label GROUP BY label"""
)
def vector_ndcg_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every vector as a query."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _neighbours(spark, sf_dir).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(labels.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    others = labels.groupBy(F.col("label").alias("own")).agg((F.count(F.lit(1)) - 1).alias("others"))
    gain = near.groupBy("query_id", "own").agg(F.sum(F.when(F.col("own") == F.col("label"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain")).join(others, "own")
    ndcg = F.when(F.col("others") == 0, 0.0).otherwise(F.col("gain") / metrics.ideal_gain(F.col("others"), 10))
    return gain.groupBy(F.col("own").cast("bigint").alias("label")).agg(F.round(F.avg(ndcg), 6).alias("ndcg"))


@query(f"WITH {BM25}{COSINE}, u AS (SELECT query_id, doc_id, 2 * rank AS pos FROM bmr WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 2 * rank + 1 FROM cor WHERE rank <= 10), m AS (SELECT query_id, doc_id, min(pos) AS pos FROM u GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM m")
def interleaved_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.interleave(*both_rankings(spark, sf_dir, 10))


@query(f"WITH {BM25}, u AS (SELECT query_id, b.doc_id, rank, sum(len(w)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM bmr b JOIN dl USING (doc_id)) SELECT query_id, doc_id, rank, used::BIGINT AS used FROM u WHERE used <= 1500")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in BM25 order until 1500 tokens are used, be they ever so many."""
    return ranking.bm25_within(indexed(spark, sf_dir), 1500).select("query_id", "doc_id", "rank", "used")


@query(f"WITH {BM25}, e AS (SELECT query_id, doc_id, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM bmr WHERE rank <= 10) SELECT query_id, doc_id, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS p FROM e")
def softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.softmax(ranking.bm25_top(indexed(spark, sf_dir), 10)).select("query_id", "doc_id", F.round("p", 6).alias("p"))


@query(f"WITH {CONDITIONS}, t AS (SELECT condition, query_id, list(doc_id) AS top FROM conditions WHERE rank <= 5 GROUP BY ALL), q AS (SELECT *, query_id % 10 AS grp FROM t) SELECT a.condition, count(*) AS pairs, round(avg(len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top)))), 6) AS stability FROM q a JOIN q b ON a.condition = b.condition AND a.grp = b.grp AND a.query_id < b.query_id GROUP BY a.condition")
def group_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of the first five documents within groups of queries (last digit of the id)."""
    _, asked = corpus(spark, sf_dir)
    return metrics.stability(conditions(spark, sf_dir), asked.select("query_id", (F.col("query_id") % 10).alias("grp")), 5)


@query(f"WITH {CONDITIONS}, s AS (SELECT condition, query_id, avg(CASE WHEN toxic = 1 OR quality = 0 THEN 1.0 ELSE 0.0 END) AS share FROM conditions LEFT JOIN labels USING (doc_id) WHERE rank <= 5 GROUP BY ALL) SELECT condition, round(avg(share), 6) AS stale_hit_rate FROM s GROUP BY condition")
def stale_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first five documents that are labelled toxic or of low quality."""
    flags = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("stale"))
    return metrics.share_of_top(conditions(spark, sf_dir).join(flags, "doc_id", "left"), F.coalesce("stale", F.lit(False)), 5, "stale_hit_rate")


@query(f"WITH {CONDITIONS}, scope AS (SELECT query_id, min_by(source, doc_id) AS qs, min_by(lang, doc_id) AS ql FROM gold JOIN documents USING (doc_id) GROUP BY query_id), s AS (SELECT condition, query_id, avg(CASE WHEN lang <> ql THEN 1.0 ELSE 0.0 END) AS share FROM conditions JOIN scope USING (query_id) JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY ALL) SELECT condition, round(avg(share), 6) AS wrong_scope_rate FROM s GROUP BY condition")
def wrong_scope_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first five documents in another language than the query's first gold document."""
    scopes = table(spark, sf_dir, "documents").select("doc_id", "lang")
    asked = gold(spark, sf_dir).join(scopes, "doc_id").groupBy("query_id").agg(F.min_by("lang", "doc_id").alias("ql"))
    return metrics.share_of_top(conditions(spark, sf_dir).join(asked, "query_id").join(scopes, "doc_id"), F.coalesce(F.col("lang") != F.col("ql"), F.lit(False)), 5, "wrong_scope_rate")


@query(f"WITH {CONDITIONS}, c AS (SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 0) AS n), t AS (SELECT condition, query_id, count(DISTINCT l.doc_id) AS shown FROM conditions LEFT JOIN (SELECT * FROM labels WHERE quality = 0) l USING (doc_id) WHERE rank <= 5 GROUP BY ALL) SELECT condition, round(avg(CASE WHEN n = 0 THEN 1 ELSE 1 - shown / n END), 6) AS suppression FROM t, c GROUP BY condition")
def stale_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all poor documents that a query's first five leave out; 1 if there are none."""
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    n = poor.agg(F.count(F.lit(1)).alias("n"))
    shown = conditions(spark, sf_dir).where("rank <= 5").join(poor.withColumn("p", F.lit(1)), "doc_id", "left").groupBy("condition", "query_id").agg(F.countDistinct(F.when(F.col("p") == 1, F.col("doc_id"))).alias("shown"))
    return shown.crossJoin(F.broadcast(n)).groupBy("condition").agg(F.round(F.avg(F.when(F.col("n") == 0, 1.0).otherwise(1 - F.col("shown") / F.col("n"))), 6).alias("suppression"))
