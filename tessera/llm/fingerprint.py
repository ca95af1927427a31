"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

Paragraphs end with a line or with a sentence (CUT), in texts of any length. A paragraph's key is the XXH64 of its
digest and of how often the digest stood before, so the keys of a text are a set; they are found by sorting and binary search, so the cost of a text grows with n log n of its paragraphs. A sketch has three parts of `size` cells; a key
is added to one cell of each, which holds the number of keys, their exclusive or, and that of their check sums.

Two sketches are subtracted cell by cell, which leaves the keys in one of them alone. Peeling takes the key of every cell
that holds one, takes that key out of its other cells, and goes on until all cells are empty: the keys taken are the
difference. If cells stay, the difference is too large for the sketch and a larger one is tried: the keys are dealt, by their upper bits, into
about one bucket for LOAD of them, each with a small sketch of its own (four times as wide where that fails again). A bucket that no
sketch resolves is compared key by key. Likeness is the keys in both over the keys in either; two texts without
keys have likeness 1.

Null texts count as empty; they have no keys. Equal texts have equal fingerprints. Rows are ordered by doc_id, descending, then
by the XXH64 of their texts, descending (so that rows of one id, or without one, spread like others); rows without a doc_id come
last; the row after the last is the first, so a row alone is its own next. Repeated rows stay. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn

#: Fixed value: what stands between paragraphs.
CUT = r"\n|(?<=[.!?])\s+"
CELLS = 8
ROUNDS = 8
#: Keys a bucket of a larger sketch is meant for, and cells in each part of its first try.
LOAD = 3
SMALL_CELLS = 4
#: Ranges of rows for each partition of a shuffle; a task sorts some of them. Where the cuts fall changes no result.
RANGES = 8
#: Rows drawn for each cut, and cuts of a block: a row's range is found among the blocks, then in its block.
DRAWN = 20
BLOCK = 64


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once for all its uses in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _check(key: str) -> str:
    return f"(xxhash64({key}) & 4294967295L)"


def _places(size: int, shift: int) -> str:
    """SQL for the cells of a sketch in order: a key is in the cell if its bits under mask m are v."""
    bits = size.bit_length() - 1
    low = [shift + bits * part for part in range(3) for _ in range(size)]
    return "array(" + ", ".join(f"named_struct('m', {(size - 1) << k}L, 'v', {(n % size) << k}L)" for n, k in enumerate(low)) + ")"


def _steps(array: str) -> str:
    """SQL for the powers of two up to an array's size, falling."""
    return f"IF(size({array}) = 0, array(), transform(sequence(cast(floor(log2(size({array}))) AS int), 0), e -> shiftleft(1, e)))"


def _below(array: str, value: str, steps: str) -> str:
    """SQL for how many elements of a sorted array are less than a value: a binary search."""
    return f"aggregate({steps}, 0, (p, s) -> IF(get({array}, p + s - 1) < {value}, p + s, p))"


def paragraph_keys(text: str) -> str:
    """SQL for the sorted keys of a text column."""
    cut = CUT.replace("\\", "\\\\")
    digests = f"sort_array(transform(split({text}, '{cut}'), l -> xxhash64(l)))"
    repeated = _let(_steps("ds"), "st", f"transform(ds, (d, i) -> xxhash64(d, i - {_below('ds', 'd', 'st')}))")
    keys = _let(digests, "ds", f"IF(size(array_distinct(ds)) = size(ds), transform(ds, d -> xxhash64(d, 0)), {repeated})")
    return f"IF({text} = '', array(), sort_array({keys}))"


def sketch(keys: str, size: int = CELLS, shift: int = 0) -> str:
    """SQL for the cells of a sketch."""
    cell = f"named_struct('n', size(m), 'k', aggregate(m, 0L, (a, x) -> a ^ x), 'c', aggregate(m, 0L, (a, x) -> a ^ {_check('x')}))"
    return f"transform({_places(size, shift)}, j -> {_let(f'filter({keys}, x -> (x & j.m) = j.v)', 'm', cell)})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'c', p.c ^ q.c))"


def peel(cells: str, size: int = CELLS, shift: int = 0, rounds: int = ROUNDS) -> str:
    """SQL for the keys in a difference of sketches, as structs of key k and sign n; NULL if cells stay."""
    pure = f"array_distinct(transform(filter(z.cells, c -> abs(c.n) = 1 AND c.c = {_check('c.k')}), c -> named_struct('k', c.k, 'n', c.n)))"
    out = f"aggregate(filter(ks, x -> (x.k & j.m) = j.v), c, (a, x) -> named_struct('n', a.n - x.n, 'k', a.k ^ x.k, 'c', a.c ^ {_check('x.k')}))"
    step = f"IF(size(ks) = 0, named_struct('cells', z.cells, 'keys', z.keys, 'live', false), named_struct('cells', zip_with(z.cells, {_places(size, shift)}, (c, j) -> {out}), 'keys', concat(z.keys, ks), 'live', true))"
    none = "cast(array() AS array<struct<k: bigint, n: int>>)"
    return f"aggregate(sequence(1, {rounds}), named_struct('cells', {cells}, 'keys', {none}, 'live', true), (z, r) -> IF(z.live, {_let(pure, 'ks', step)}, z), z -> IF(forall(z.cells, c -> c.n = 0 AND c.k = 0 AND c.c = 0), z.keys, NULL))"


def difference(a: str, b: str, cells_a: str, cells_b: str, compare: bool = True) -> str:
    """SQL for the number of keys in one of two key arrays alone, whose first sketches are given. Without `compare`, NULL where a bucket is resolved by no sketch."""

    def attempt(size: int, shift: int) -> str:
        return f"size({peel(subtract(sketch('t.a', size, shift), sketch('t.b', size, shift)), size, shift)})"

    by_key = "size(array_except(t.a, t.b)) + size(array_except(t.b, t.a))" if compare else "NULL"
    tries = [attempt(SMALL_CELLS, 0), attempt(4 * SMALL_CELLS, 9)]
    bucket = f"CASE WHEN size(t.a) = 0 OR size(t.b) = 0 THEN size(t.a) + size(t.b) ELSE coalesce({', '.join(f'nullif({x}, -1)' for x in tries)}, {by_key}) END"
    # w buckets of equal ranges of keys; the first places of all, and the size, say where each stands in the sorted keys
    cuts = lambda keys: _let(_steps(keys), "st", f"concat(transform(sequence(0, w - 1), i -> {_below(keys, 'shiftleft(cast(i AS bigint) - (w div 2), 64 - bits)', 'st')}), array(size({keys})))")
    part = lambda keys, at: f"slice({keys}, get({at}, i) + 1, get({at}, i + 1) - get({at}, i))"
    summed = f"aggregate(sequence(0, w - 1), 0, (s, i) -> s + {_let(f"named_struct('a', {part(a, 'at.a')}, 'b', {part(b, 'at.b')})", 't', bucket)})"
    dealt = _let(f"named_struct('a', {cuts(a)}, 'b', {cuts(b)})", "at", summed)
    larger = _let(f"greatest(1, cast(ceil(log2((size({a}) + size({b})) / {LOAD}.0)) AS int))", "bits", _let("shiftleft(1, bits)", "w", dealt))
    return f"coalesce(nullif(size({peel(subtract(cells_a, cells_b))}), -1), {larger})"


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: with n keys in all and d in one alone, (n - d) / 2 are in both."""
    total = f"(size({a}) + size({b}))"
    return _let(difference(a, b, cells_a, cells_b), "d", f"IF({total} = 0, 1.0D, ({total} - d) / cast({total} + d AS double))")


def text_of(cells: str) -> str:
    """SQL for the fingerprint of a sketch: its cells in hexadecimal."""
    return f"lower(concat_ws('', transform({cells}, c -> concat(lpad(hex(c.n), 6, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 8, '0')))))"


def _sortable(number: Column) -> Column:
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _range_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted cuts are the key or less."""
    if not cuts:
        return F.lit(0)
    block = F.size(F.filter(F.lit(cuts[::BLOCK]), lambda c: c <= key)) - 1
    within = F.size(F.filter(F.slice(F.lit(cuts), block * BLOCK + 1, F.lit(BLOCK)), lambda c: c <= key))
    return F.when(key < cuts[0], 0).otherwise(block * BLOCK + within)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys and cells of each row, and those of the next one in order.

    Rows are cut into ranges at quantiles of a sample of their keys. A task sorts a range; the first row of the next range comes along as a guest, so that
    the last row finds its next one there. Equal rows (id and text) share a range.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = base.count()
    ranges = max(1, min(n, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise("1"), _sortable(F.coalesce("doc_id", F.lit(0).cast("bigint"))), _sortable(F.col("h")))
    keyed = base.select("doc_id", "text", key.alias("key"))
    some = sorted({r[0] for r in keyed.where(drawn(DRAWN * ranges / max(1, n), "key")).select("key").collect()})
    cuts = sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []
    ranged = keyed.withColumn("range", _range_of(F.col("key"), cuts))
    heads = sorted((r[0], r[1]) for r in ranged.groupBy("range").agg(F.max("key")).collect())
    tops, hosts = [""] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for (own, top), (above, _) in zip(heads, heads[1:] + heads[:1], strict=True):
        tops[own], hosts[own] = top, above
    own = F.struct("range", F.lit(False).alias("guest"))
    host = F.struct(F.element_at(F.lit(hosts), F.col("range") + 1).alias("range"), F.lit(True).alias("guest"))
    places = F.when(F.col("key") == F.element_at(F.lit(tops), F.col("range") + 1), F.array(own, host)).otherwise(F.array(own))
    marked = ranged.withColumn("keys", F.expr(paragraph_keys("text"))).withColumn("cells", F.expr(sketch("keys")))
    placed = marked.select("doc_id", "text", "key", "keys", "cells", F.inline(places).alias("at", "guest"))
    order = Window.partitionBy("at").orderBy("guest", F.desc("key"), "text")
    here = F.struct("text", "keys", "cells")
    following = F.lead(here).over(order)
    return placed.withColumn("next", following).where(~F.col("guest")).select("doc_id", "text", "keys", "cells", *(F.col(f"next.{c}").alias(f"next_{c}") for c in ("text", "keys", "cells")))


def _pairs(docs: DataFrame) -> DataFrame:
    """with_next, n_chars, and the edited text's digest, keys and cells."""
    half = "cast(floor(length(text) / 2) AS int)"
    rows = with_next(docs).withColumn("edited", F.expr(f"concat(left(text, length(text) - {half}), left(next_text, {half}))"))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "keys", "cells", "next_keys", "next_cells", F.expr(paragraph_keys("edited")).alias("edited_keys"))
    return rows.withColumn("edited_cells", F.expr(sketch("edited_keys")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    return _pairs(docs).select(
        "doc_id", "n_chars", "edited_sha256",
        F.expr(text_of("cells")).alias("fingerprint"),
        F.expr(text_of("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "edited_keys", "cells", "edited_cells")).alias("near_edited"),
        F.expr(likeness("keys", "next_keys", "cells", "next_cells")).alias("near_next"),
    )


def routes(docs: DataFrame) -> DataFrame:
    """(pair, route, n): how many comparisons with the edited and with the next text were settled by the first sketch, by larger ones, or needed keys compared in some bucket."""
    found = []
    for pair, other in (("edited", "edited_"), ("next", "next_")):
        first = F.expr(peel(subtract("cells", f"{other}cells"))).isNotNull()
        larger = F.expr(difference("keys", f"{other}keys", "cells", f"{other}cells", compare=False)).isNotNull()
        found.append(F.struct(F.lit(pair).alias("pair"), F.when(first, "first sketch").when(larger, "larger sketches").otherwise("keys compared").alias("route")))
    return _pairs(docs).select(F.inline(F.array(*found))).groupBy("pair", "route").agg(F.count(F.lit(1)).alias("n"))
