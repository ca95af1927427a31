"""Graphs as edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import checkpointed


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at either end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_node: int = 5, hub: int = 25, most: int = 20) -> DataFrame:
    """(seed, node, distance): bounded breadth-first search from (seed, node) rows.

    A node with `hub` neighbours or more is not gone through or reached; a node passes to its `per_node` smallest neighbours; a
    seed keeps the `most` nearest (then smallest) nodes. One join a level.
    """
    edges = checkpointed(edges.distinct())  # read for degrees, for both ends of hubs and for each level
    out_degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    hubs = out_degree.where(F.col("d") >= hub).select(F.col("src").alias("node"))
    kept = edges.join(hubs.withColumnRenamed("node", "dst"), "dst", "left_anti").join(hubs.withColumnRenamed("node", "src"), "src", "left_anti")
    narrow = kept.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("n") <= per_node).select("src", "dst")
    front = seeds.select("seed", "node", F.lit(0).cast("bigint").alias("distance"))
    found = front
    for level in range(1, depth + 1):
        front = front.join(narrow, front["node"] == narrow["src"]).select("seed", F.col("dst").alias("node"), F.lit(level).cast("bigint").alias("distance")).distinct()
        found = found.unionByName(front)
    nearest = found.groupBy("seed", "node").agg(F.min("distance").alias("distance")).where("distance > 0")
    order = Window.partitionBy("seed").orderBy("distance", "node")
    return nearest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, digest): a digest that does not depend on the order of rows, the sum of the first 60 bits of each row's MD5 (a decimal, as text); null differs from every text."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)).cast("binary"))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bits).cast("decimal(38,0)").cast("string").alias("digest"))


def chain(links: DataFrame, depth: int) -> DataFrame:
    """(id, root, steps): follows each id's predecessor (id, before) until there is none, doubling the reach each round; links that come back to themselves end at `depth`.

    Each round joins every pointer to its pointer's pointer, so a chain of n links takes log2 n rounds.
    """
    at = links.select("id", F.col("before").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("steps"))
    for _ in range(max(1, (depth - 1).bit_length())):
        nxt = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        at = at.join(nxt, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.when(F.col("_to").isNotNull(), F.coalesce("_steps", F.lit(0))).otherwise(0)).alias("steps"))
    return at.select("id", F.coalesce("to", "id").alias("root"), "steps")


def tree_faults(tokens: DataFrame, group: str, depth: int = 64) -> DataFrame:
    """(group, roots, loose, cyclic): roots of each group's tokens (id, head), heads that are no token of it, and tokens that reach no root."""
    key = [group, "id"]
    heads = tokens.select(group, F.col("id").alias("head"), F.lit(True).alias("_known"))
    known = tokens.join(heads, [group, "head"], "left").select(*key, "head", F.coalesce("_known", F.lit(False)).alias("known"))
    ids = known.select(F.struct(group, "id").alias("id"), F.when(F.col("head").isNotNull() & F.col("known"), F.struct(group, F.col("head").alias("id"))).alias("before"))
    ends = chain(ids, depth).select(F.col("id.*"), F.col("root.id").alias("root"))
    rootless = ends.join(known.where("head IS NULL OR NOT known").select(group, F.col("id").alias("root"), F.lit(True).alias("_end")), [group, "root"], "left")
    faults = known.groupBy(group).agg(F.count_if(F.col("head").isNull()).alias("roots"), F.count_if(F.col("head").isNotNull() & ~F.col("known")).alias("loose"))
    return faults.join(rootless.groupBy(group).agg(F.count_if(F.col("_end").isNull()).alias("cyclic")), group)


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, src_name, relation, dst, dst_name): edges between known nodes (id, name)."""
    left = nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    right = nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(left, "src").join(right, "dst").select("src", "src_name", "relation", "dst", "dst_name")


def census(edges: DataFrame) -> DataFrame:
    """(node, links, neighbours): edges at either end, and distinct nodes at the other."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("other").alias("neighbours"))


def in_exactly(names: DataFrame, name: str, group: str, groups: int = 1) -> DataFrame:
    """Names that occur once in each of exactly `groups` groups."""
    return names.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g")).where((F.col("n") == groups) & (F.col("g") == groups)).select(name)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (src, dst); a component is named by its smallest node.

    Each round every node takes its neighbours to the smallest node around it, first those above it, then those below; the number of rounds grows with the
    logarithm of a component's size, and no step brings a component together in one task.
    """
    edges = checkpointed(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())

    def towards(pairs: DataFrame, keep: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
        met = pairs.join(least, "u")
        if keep:
            return least.select("u", F.col("_m").alias("v")).union(met.where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))).distinct()
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()

    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = checkpointed(towards(towards(both, False), True))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    named = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = named.select(F.col("component").alias("node"), "component").distinct()
    return named.select(F.col("u").alias("node"), "component").union(roots)


def along_heads(tokens: DataFrame, group: str, low: Column, high: Column, flag: Column, depth: int = 1 << 16) -> DataFrame:
    """(group, id, low, high, flag): least `low` and greatest `high` over the tokens below each token (itself included), and whether `flag` holds for it or one above it.

    Tokens have an id and a head (null, their own id or unknown: a root). Pointers are doubled: after k rounds a token has what stands less than 2 ** k steps below and
    above it, so a tree of depth n takes log2 n rounds; heads in a loop end at `depth`.
    """
    key = [group, "id"]
    heads = tokens.select(group, F.col("id").alias("head"), F.lit(True).alias("_known")).distinct()
    at = tokens.join(heads, [group, "head"], "left").select(*key, F.when(F.col("_known") & (F.col("head") != F.col("id")), F.col("head")).alias("_up"), low.alias("low"), high.alias("high"), flag.alias("flag"))
    at = checkpointed(at)
    for _ in range(max(1, depth.bit_length())):
        if not at.where(F.col("_up").isNotNull()).take(1):
            break
        below = at.where(F.col("_up").isNotNull()).groupBy(group, F.col("_up").alias("id")).agg(F.min("low").alias("_l"), F.max("high").alias("_h"))
        above = at.select(group, F.col("id").alias("_up"), F.col("_up").alias("_next"), F.col("flag").alias("_f"))
        rows = at.join(above, [group, "_up"], "left").join(below, key, "left")
        at = checkpointed(rows.select(*key, F.col("_next").alias("_up"), F.least("low", "_l").alias("low"), F.greatest("high", "_h").alias("high"), (F.col("flag") | F.coalesce("_f", F.lit(False))).alias("flag")))
    return at.drop("_up")


#: Relations of clauses within clauses, and of tokens that a clause does not begin with.
EMBEDDED = ("ccomp", "xcomp", "advcl", "acl", "relcl")
LEADING = ("cc", "punct")


def clause_spans(tokens: DataFrame, group: str) -> DataFrame:
    """(group, id, start, stop, embedded): the clause of each token taken as a predicate, and whether it stands within another clause.

    tokens: group, id (in order), head, dep, start, stop. A conjunct's clause is its subtree without leading conjunctions and marks (no clause if nothing is left), any other's is the sentence.
    A predicate is embedded if it or a token above it has one of the relations EMBEDDED.
    """
    begins = F.when(~F.col("dep").isin(*LEADING), F.struct("id", F.col("start").alias("at")))
    seen = along_heads(tokens, group, begins, F.struct("id", F.col("stop").alias("at")), F.col("dep").isin(*EMBEDDED))
    whole = tokens.groupBy(group).agg(F.min("start").alias("_s"), F.max("stop").alias("_e"))
    rows = tokens.select(group, "id", "dep").join(seen, [group, "id"]).join(whole, group)
    own = F.col("dep") == "conj"
    start, stop = F.when(own, F.col("low.at")).otherwise(F.col("_s")), F.when(own & F.col("low").isNull(), F.lit(None)).when(own, F.col("high.at")).otherwise(F.col("_e"))
    return rows.select(group, "id", start.alias("start"), stop.alias("stop"), F.col("flag").alias("embedded"))
