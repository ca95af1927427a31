"""Components, trees and folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import counters, graph, samples


def plain_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7), (300, 301), (301, 300)]
    found = graph.components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()
    assert {r.node: r.component for r in found} == plain_components([p for p in pairs if p[0] != p[1]]) and len(found) == len({r.node for r in found})
    assert graph.components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def trees(seed=3, groups=6):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        n = rng.randrange(1, 40)
        for i in range(n):
            head = None if i == 0 else rng.randrange(i) if g else i - 1  # group 0 is one long chain
            rows.append((g, i, head, rng.choice(["conj", "relcl", "cc", "punct", "obj", "nsubj"]), 3 * i, 3 * i + 2))
    return rows + [(90, 0, 0, "conj", 0, 2), (91, 0, 5, "conj", 0, 2), (92, 0, 1, "cc", 0, 1), (92, 1, None, "obj", 2, 3), (93, 0, None, "conj", 0, 1)]


def plain_spans(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == g}
        up = {i: r[2] if r[2] in own and r[2] != i else None for i, r in own.items()}
        chain = {}
        for i in own:
            at, seen = i, []
            while at is not None:
                seen.append(at)
                at = up[at]
            chain[i] = seen
        for i, r in own.items():
            below = sorted(j for j in own if i in chain[j])
            first = [j for j in below if own[j][3] not in ("cc", "punct")]
            conj = r[3] == "conj"
            span = (own[first[0]][4], own[below[-1]][5]) if conj and first else (None, None) if conj else (min(x[4] for x in own.values()), max(x[5] for x in own.values()))
            out[g, i] = (*span, any(own[j][3] in graph.EMBEDDED for j in chain[i]))
    return out


def test_clause_spans(spark):
    rows = trees()
    found = graph.clause_spans(spark.createDataFrame(rows, "s int, id int, head int, dep string, start int, stop int"), "s").collect()
    assert {(r.s, r.id): (r.start, r.stop, r.embedded) for r in found} == plain_spans(rows) and len(found) == len(rows)


def test_heads_in_a_loop_end(spark):
    rows = [("x", 0, 1, 5), ("x", 1, 0, 7), ("x", 2, None, 9)]
    t = spark.createDataFrame(rows, "g string, id int, head int, v int")
    found = {r.id: (r.low, r.high) for r in graph.along_heads(t, "g", F.col("v"), F.col("v"), F.lit(False), depth=8).collect()}
    assert found == {0: (5, 7), 1: (5, 7), 2: (9, 9)}


def test_no_link_crosses_a_split(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(30)] for _ in range(12)]
    rows = []
    for i in range(120):
        items = list(base[i % 12])
        items[rng.randrange(30)] = f"n{rng.randrange(4)}"
        rows.append((i, items))
    rows += [(500, []), (501, None), (502, ["alone"])]
    out = {r.id: r for r in samples.without_leaks(spark.createDataFrame(rows, "id bigint, items array<string>"), 0.8, 0.4).collect()}
    sets = {i: set(x) for i, x in rows if x}
    assert out.keys() == sets.keys()
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert links and all(out[a].split == out[b].split and out[a].cluster == out[b].cluster for a, b in links)
    of = plain_components(links)
    assert all(out[i].cluster == of.get(i, i) for i in sets)
    sizes = {c: sum(r.cluster == c for r in out.values()) for c in {r.cluster for r in out.values()}}
    assert all(r.size == sizes[r.cluster] for r in out.values()) and {r.split for r in out.values()} == {"test", "train"}


def plain_fold(views, fixes):
    out, bound = {}, {}
    for ns in {v[0] for v in views} | {f[0] for f in fixes}:
        held = {}
        for _, c, value, _ in sorted((v for v in views if v[0] == ns), key=lambda v: v[3]):
            held[c] = value
        for _, seq, old, new in sorted((f for f in fixes if f[0] == ns), key=lambda f: f[1]):
            found = [c for c, v in held.items() if v == old]
            bound[ns, seq] = found[0] if len(found) == 1 else None
            if len(found) == 1:
                held[found[0]] = new
        out |= {(ns, c): v for c, v in held.items()}
    return out, bound


@pytest.mark.parametrize("seed", [1, 2])
def test_corrections_one_after_another(spark, seed):
    rng = random.Random(seed)
    views = [(rng.choice("ab"), f"c{rng.randrange(9)}", rng.randrange(12), i) for i in range(40)]
    fixes = [(rng.choice("abz"), i, rng.randrange(12), rng.randrange(12)) for i in range(60)]
    v, f = spark.createDataFrame(views, "namespace string, counter string, value bigint, seq bigint"), spark.createDataFrame(fixes, "namespace string, seq bigint, old bigint, new bigint")
    out, bound = counters.corrected(v, f)
    want, want_bound = plain_fold(views, fixes)
    assert {(r.namespace, r.counter): r.value for r in out.collect()} == want
    assert {(r.namespace, r.seq): r.bound for r in bound.collect()} == want_bound
    none, _ = counters.corrected(v, f.limit(0))
    assert {(r.namespace, r.counter): r.value for r in none.collect()} == plain_fold(views, [])[0]
