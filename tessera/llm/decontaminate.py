"""Benchmark passages in documents, by SimHash of item-sized windows and multi-index Hamming blocks. DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are SHINGLE words in a row (an item with fewer is one
shingle), counted with repeats. A window is as many words of a document as the item has (or the whole, shorter document).

1. Windows. A window that shares no shingle with an item has similarity 0 with it, and one of similarity s shares at least
   s / (1 + s) of the shingles of both together (a document shorter than the item has fewer). So only windows that hold so
   many positions of shared shingles, in whatever order, can count; they are laid at all such starts, of which each run of
   that many positions in a row gives a few, so the work is in proportion to the positions.
2. SimHash of the window's shingles (64 bits, weighted by their counts) is cut into BLOCKS blocks. Fingerprints within RADIUS
   bits agree in one block but for at most RADIUS // BLOCKS bits: items are indexed under every such variant of each block,
   windows look up their blocks, and equality joins find all pairs within the radius.
3. Candidates are verified by the distance of the whole fingerprints, then exactly: sum of the smaller over sum of the
   larger counts of the shingles of window and item, SIMILARITY or more.

At the least similarity of 0.8 the distance is 8 bits on average; the radius of 20 leaves out 6 in 100,000 of such windows
(measured for items of 9 to 60 words, see the tests), and fewer of those that are more alike.

Null and empty texts have no window; items without a word match nothing. Rows with a null doc_id, and different texts of
one doc_id, are told apart by the hash of the text. Equal rows give one row. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_side

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 7
BITS = 64


def _words(column: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: str, k: str) -> str:
    """SQL for the hashes of the shingles of `words` (array) of k words each; an array shorter than k gives one shingle."""
    return f"transform(sequence(1, greatest(1, size({words}) - {k} + 1)), i -> xxhash64(slice({words}, i, {k})))"


def _simhash(hashes: str) -> str:
    """SQL for a fingerprint: a bit is 1 if more than half of the hashes have it."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1 AS int))"
    return f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> IF(2 * {ones} > size({hashes}), f | shiftleft(1L, b), f))"


def _blocks(blocks: int) -> list[tuple[int, int]]:
    return [(k * BITS // blocks, (k + 1) * BITS // blocks - k * BITS // blocks) for k in range(blocks)]


def _flips(width: int, most: int) -> list[int]:
    """Masks of `width` bits with at most `most` ones: ten or so bits and two ones make some fifty."""
    return [m for m in range(1 << width) if m.bit_count() <= most]


def items_of(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item_id, n (words), k (words of a shingle), item_hashes and item_fp of the items with a word."""
    base = benchmark.select("item_id", _words("text").alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w")).withColumn("k", F.least(F.lit(shingle), F.col("n")))
    return base.withColumn("item_hashes", F.expr(_hashes("w", "k"))).withColumn("item_fp", F.expr(_simhash("item_hashes"))).drop("w").distinct()


def _windows(docs: DataFrame, items: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """Where windows of documents can be like items: doc_id, text_hash, n, k, start (first word, from 0)."""
    places = items.select("item_id", "n", "k", F.explode(F.array_distinct("item_hashes")).alias("h"))
    known = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words("text").alias("w"))
    found = []
    for k in sizes:
        row = F.arrays_zip(*(F.slice("w", j + 1, F.greatest(F.size("w") - (k - 1), F.lit(0))).alias(f"w{j}") for j in range(k)))
        each = known.select("doc_id", "text_hash", F.size("w").alias("len"), F.posexplode(row).alias("p", "s"))
        # the same hash as that of an array of the words: each word's hash seeds the next
        each = each.select("doc_id", "text_hash", "len", "p", F.xxhash64(*(F.col(f"s.w{j}") for j in range(k))).alias("h"))
        found.append(each.join(small_side(places.where(F.col("k") == k)), "h"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    own = F.col("n") - F.col("k") + 1  # shingles of the item, and those of a window of the document
    least = F.ceil(similarity / (1 + similarity) * (own + F.least(own, F.col("len") - F.col("k") + 1)) - 1e-9).cast("int")
    by_item = hits.groupBy("doc_id", "text_hash", "item_id", "n", "k", "len").agg(F.sort_array(F.collect_set("p")).alias("at")).withColumn("least", least)
    # a window holds `least` positions or more if it begins at or before the first of so many in a row and reaches the last
    low, high = "greatest(0, at[i + least - 1] - (n - k))", "least(at[i], greatest(0, len - n))"
    starts = f"flatten(transform(sequence(0, size(at) - least), i -> IF({low} <= {high}, sequence({low}, {high}), array())))"
    enough = by_item.where(F.size("at") >= F.col("least")).select("doc_id", "text_hash", "n", "k", F.explode(F.array_distinct(F.expr(starts))).alias("start"))
    return enough.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, text_hash, item_id, start_word, n_words, similarity: the most similar (then first) window for each document and item that match."""
    items = checkpointed(items_of(benchmark, shingle))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect()) or [shingle]
    at = checkpointed(_windows(docs, items, sizes, similarity))

    # the documents that have windows, once more, for the words of these
    text = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    placed = text.join(small_side(at), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    window = F.slice(_words("text"), F.col("start") + 1, F.col("n"))
    windows = placed.select("doc_id", "text_hash", "start", "n", "k", window.alias("w")).withColumn("hashes", F.expr(_hashes("w", "k"))).drop("w")
    windows = checkpointed(windows.withColumn("fp", F.expr(_simhash("hashes"))))

    cut = [(k, f"(shiftrightunsigned({{}}, {low}) & {(1 << width) - 1})", _flips(width, radius // blocks)) for k, (low, width) in enumerate(_blocks(blocks))]
    probes = ", ".join(f"named_struct('block', {k}, 'value', {part.format('fp')})" for k, part, _ in cut)
    signs = ", ".join(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> named_struct('block', {k}, 'value', {part.format('item_fp')} ^ m))" for k, part, masks in cut)
    probed = windows.select("doc_id", "text_hash", "start", "n", "fp", F.expr(f"inline(array({probes}))"))
    index = items.select("item_id", "n", "item_fp", F.expr(f"inline(concat({signs}))"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    pairs = probed.join(small_side(index), ["n", "block", "value"]).where(near).select("doc_id", "text_hash", "start", "n", "item_id").distinct()

    shared = "aggregate(array_distinct(hashes), 0, (t, h) -> t + least(size(filter(hashes, x -> x = h)), size(filter(item_hashes, x -> x = h))))"
    full = (
        pairs.withColumnsRenamed({"doc_id": "d", "text_hash": "t", "start": "s", "n": "m"})
        .join(windows, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash")) & (F.col("s") == F.col("start")) & (F.col("m") == F.col("n")))
        .select("doc_id", "text_hash", "item_id", "start", "n", "hashes")
        .join(small_side(items.select("item_id", "n", "item_hashes")), ["item_id", "n"])
        .withColumn("shared", F.expr(shared))
        .withColumn("similarity", F.col("shared") / (F.size("hashes") + F.size("item_hashes") - F.col("shared")))
    )
    best = F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    found = full.where(F.col("similarity") >= similarity).groupBy("doc_id", "text_hash", "item_id").agg(best)
    return found.select("doc_id", "text_hash", "item_id", F.col("best.start").alias("start_word"), F.col("best.n").alias("n_words"), F.col("best.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item was found."""
    gone = leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
