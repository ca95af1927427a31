"""Near-duplicates by SimHash with deletion-variant signatures.

Fingerprint: texts get A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, shingles of SHINGLE words joined by spaces (repeats
count; fewer words: all of them as one shingle). A bit is 1 if more than half of the shingles' XXH64 (seed 42) have it.
Null texts, and texts without a word, have fingerprint 0, which links like any other.

Links: two fingerprints within `radius` bits agree in one of s = radius // 2 + 1 segments but for at most one bit (s
segments with two or more each would need 2 s > radius bits). Every distinct fingerprint is indexed under each segment as
it is, and under its variants with one bit left out. Equal keys bring together: the plain segments pair those that agree,
and a variant pairs fingerprints that have 0 and 1 at the bit left out, so that no pair is met twice in one segment.
The whole fingerprints then verify the distance.

Classes: documents of equal fingerprints are one node, represented by their smallest doc_id; the linked nodes' connected
components come from alternating star joins, checkpointed each round. No step gathers a class in one task.

Rows with a null doc_id are fingerprinted but belong to no class (null).
Repeated rows get equal results; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, words

SHINGLE = 3
RADIUS = 2
BITS = 64
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    ws = words(text)
    if not ws:
        return []
    if len(ws) < size:
        return [xxhash.xxh64_intdigest(b" ".join(ws), 42)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), 42) for s in zip(*(ws[k:] for k in range(size)), strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes (counts: lengths of the runs).

    Eight bits at a time are added in the bytes of a 64-bit word, over stretches of at most 255 hashes, so no byte overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts[full])
    starts = ends - counts[full]
    stretches = (counts[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), stretches)
    first = np.cumsum(stretches) - stretches
    begin = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    ones = np.empty((len(full), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & ONES, begin)
        by_byte = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)  # byte j counts bit 8 j + k
        ones[:, k::8] = np.add.reduceat(by_byte, first, axis=0)
    bits = (2 * ones > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(texts: list, size: int = SHINGLE) -> np.ndarray:
    found = [np.array(shingle_hashes(t, size), np.uint64) for t in texts]
    return majority(np.concatenate(found) if found else np.zeros(0, np.uint64), np.array([len(x) for x in found], np.int64))


def with_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits in a signed long) for every row."""
    return map_texts(docs.select("doc_id", "text"), "text", "doc_id bigint, fp bigint", lambda: lambda b, texts: [b.column("doc_id"), fingerprints(texts, size).view(np.int64)])


def segments(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    s = radius // 2 + 1
    return [(k * BITS // s, (k + 1) * BITS // s - k * BITS // s) for k in range(s)]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of the ids of nodes (id, fp) whose fingerprints differ in at most `radius` bits. fp is distinct."""
    keys = []
    for k, (low, width) in enumerate(segments(radius)):
        part = f"(shiftrightunsigned(fp, {low}) & {(1 << width) - 1})" if width < BITS else "fp"
        keys.append(f"array(named_struct('variant', {k * 65}, 'rest', {part}, 'bit', 0))")
        if radius:
            # a signature leaves one bit out: it is set to 0 in the key, and its value tells the pair's sides apart
            keys.append(f"transform(sequence(0, {width - 1}), i -> named_struct('variant', i + {k * 65 + 1}, 'rest', {part} & ~shiftleft(1L, i), 'bit', cast(shiftrightunsigned({part}, i) & 1 AS int)))")
    signed = nodes.select("id", "fp", F.expr(f"inline(concat({', '.join(keys)}))"))
    plain = F.col("variant") % 65 == 0
    left = signed.where(F.col("bit") == 0).select(F.col("id").alias("a"), F.col("fp").alias("fa"), "variant", "rest")
    right = signed.where(plain | (F.col("bit") == 1)).select(F.col("id").alias("b"), F.col("fp").alias("fb"), "variant", "rest")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius
    # a node has some 66 signatures, which Spark's estimate of the sides' sizes does not know: it would broadcast them
    pairs = left.hint("merge").join(right, ["variant", "rest"]).where(near & (~plain | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for every id in pairs (a, b) but the roots: root is the smallest id of the connected component.

    Large and small stars in turn (each node links its neighbours to the smallest id around it), until nothing changes;
    the number of rounds grows with the logarithm of a component's size.
    """
    edges = checkpointed(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, small: bool) -> DataFrame:
        """Large star: neighbours above a node join the least of its neighbourhood. Small star: those below it, and itself, do."""
        both = e if small else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = both.join(least, "u")
        if small:
            own = least.select("u", F.col("m").alias("v"))
            moved = out.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            return own.union(moved).distinct()
        return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())

    before = state(edges)
    while True:
        edges = checkpointed(star(star(edges, False), True))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))


def classes(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    marked = checkpointed(with_fingerprints(docs, size))
    nodes = marked.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("id"))
    roots = components(links(nodes, radius))
    placed = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = marked.join(placed, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its class, and the rows without one. A doc_id that is repeated stays repeated."""
    found = classes(docs, size, radius)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
