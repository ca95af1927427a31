"""Phrases of two to five words by Apriori passes, scored by their cuts.

Texts get A-Z in lower case, are split at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. Everything is counted per lang (null: `und`).

Passes: the first counts words, the k-th counts phrases of k words. Phrases that stand LEAST times or more are frequent. Before each further pass the frequent
phrases of the last one are broadcast as a bitmap of their hashes; a phrase of k words is emitted only where both phrases of k - 1 words in it are in
the bitmap. It has some SPARSE bits for a phrase and at most 2 ** FILTER bits (32 MB) whatever the corpus: where there are more frequent phrases than that suits, more
phrases pass that are not frequent, and are counted in vain. A pass counts hashes: a task counts each slice of its texts and sends, packed, what falls to each segment of the hashes.
What passes is thus a superset of the frequent phrases; a last pass over the texts emits these as text, with counts added up in each task, and sums them exactly by lang and phrase.
A phrase that is frequent has frequent parts only, so the counts of all parts of a cut stand in the same table.

Score: a candidate with count a, cut after its first k words into parts with counts l and r, scores floor(1000 a n / (l r)), n words in all, in decimals of 38 digits;
its lowest cut counts, the first of equal ones. Candidates inside a longer one that stands as often are dropped. The first MOST of each lang come out, by score, count and phrase.

Null texts count as empty. Repeated rows count as often as they stand. Empty tables, and langs without a candidate, give no rows. Very long texts are sliced only between
texts, each is read whole. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices, small_side
from .ngram import mix

LEAST = 100
LONGEST = 5
MOST = 2000
UNKNOWN = "und"
#: Bits of the bitmap for a phrase, and the binary logarithm of its most bits.
SPARSE, FILTER = 16, 28
#: Characters for a segment, characters counted at once.
SEGMENT_CHARS = 1 << 22
SLICE = 6_000_000
POWER = np.uint64(0x9E3779B97F4A7C15)
#: Groups in which a bitmap is put together, and those in which the first of a lang are sought.
GROUPS = 256
#: Rows of counts that a task keeps before it adds them up.
PENDING = 1 << 20
LETTERS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")  # fixed values: what ends a piece, and a word


class Tokens:
    """The words of a slice of texts in a row, each with its number (and text) in the slice, its hash with its lang, and its piece."""

    def __init__(self, texts: list, langs: list):
        self.langs = sorted({UNKNOWN if x is None else x for x in langs})
        number = {x: i for i, x in enumerate(self.langs)}
        encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join(encoded).translate(LETTERS), np.uint8)
        gap = (data == 32) | (data == 10)
        starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        sizes = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1 - starts
        self.piece = np.cumsum(data == 10, dtype=np.int32)[starts]
        firsts = np.cumsum([0] + [len(e) + 1 for e in encoded[:-1]])
        self.lang = np.array([number[UNKNOWN if x is None else x] for x in langs])[np.searchsorted(firsts, starts, "right") - 1]
        ends = np.cumsum(np.r_[0, sizes]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[~gap])]).dictionary_encode()
        self.ids, self.words = words.indices.to_numpy().astype(np.int64), words.dictionary
        seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) for x in self.langs], np.uint64)
        self.hashes = mix(word_hashes(self.words)[self.ids] + seeds[self.lang])

    def levels(self, bitmaps: list[np.ndarray], last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, hashes) of the phrases of 1, 2, ... `last` words whose parts, shorter by one, are all in the bitmaps."""
        places, hashes = np.arange(len(self.ids)), self.hashes
        for words in range(1, last + 1):
            yield places, hashes
            if words == last:
                break
            known = within(bitmaps[words - 1], hashes)
            places, hashes = places[known], hashes[known]
            stands = np.zeros(len(self.ids) + 1, bool)
            stands[places] = True
            goes_on = stands[places + 1]
            goes_on[goes_on] = self.piece[places[goes_on] + words] == self.piece[places[goes_on]]
            places = places[goes_on]
            hashes = mix(hashes[goes_on] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[places + words])


def within(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bitmap) * 8 - 1).bit_length())
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) > 0


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty words: polynomials of their bytes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(sizes.max() - 1, POWER)])
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, sizes)]
    return mix(np.add.reduceat(terms, starts) + sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        for rows, texts in slices(batch, "text", SLICE):
            yield Tokens(texts, rows.column("lang").to_pylist())


def frequent_hashes(docs: DataFrame, bitmaps, words: int, bits: int, least: int) -> DataFrame:
    """(seg, keys): packed hashes of the phrases of `words` words that stand `least` times or more. Checkpointed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in token_slices(batches):
            for _, hashes in tokens.levels(bitmaps.value, words):
                found = hashes
            key, n = np.unique(found, return_counts=True)
            seg, first = np.unique(key >> np.uint64(64 - bits), return_index=True)
            packed = [[x.tobytes() for x in np.split(of, first[1:])] if len(seg) else [] for of in (key, n.astype(np.uint32))]
            yield pa.RecordBatch.from_pydict({"seg": pa.array(seg.astype(np.int64)), "keys": pa.array(packed[0], pa.binary()), "counts": pa.array(packed[1], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        key, of = np.unique(keys, return_inverse=True)
        n = np.bincount(of, weights=np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32))
        return pa.table({"seg": group.column("seg").slice(0, 1), "keys": pa.array([key[n >= least].tobytes()], pa.binary())})

    counted = docs.mapInArrow(count, "seg bigint, keys binary, counts binary")
    return checkpointed(counted.groupBy("seg").applyInArrow(add, "seg bigint, keys binary"))


def bitmap_of(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the hashes: bit h >> (64 - m) for each hash h. Put together in GROUPS parts, of a bounded size in all."""
    n = (frequent.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    m = min(FILTER, max(16, (SPARSE * n).bit_length()))
    groups = GROUPS.bit_length() - 1

    def build(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        part = np.zeros(1 << (m - groups), np.uint8)
        part[(keys >> np.uint64(64 - m)) & np.uint64(len(part) - 1)] = 1
        return pa.table({"g": group.column("g").slice(0, 1), "bits": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    grouped = frequent.withColumn("g", F.shiftright("seg", bits - groups)) if bits > groups else frequent.withColumn("g", F.col("seg"))
    out = np.zeros(1 << (m - 3), np.uint8)
    each = len(out) >> groups
    for r in grouped.groupBy("g").applyInArrow(build, "g bigint, bits binary").collect():
        out[r.g * each : (r.g + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return out


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, f) of all frequent phrases of up to `longest` words, and of each lang's words in all (words 0, phrase empty). Checkpointed."""
    spark = docs.sparkSession
    base = docs.select("text", "lang")
    chars = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(FILTER - 3, max(GROUPS.bit_length() - 1, (chars // SEGMENT_CHARS).bit_length()))
    bitmaps: list[np.ndarray] = []
    for words in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(bitmaps)
        bitmaps = [*bitmaps, bitmap_of(frequent_hashes(base, shared, words, bits, least), bits)]
        shared.destroy()
    shared = spark.sparkContext.broadcast(bitmaps)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for tokens in token_slices(batches):
            own, ids = max(1, len(tokens.words)), tokens.ids
            langs = pa.array(tokens.langs, pa.string())
            texts = tokens.words.cast(pa.string())
            total = np.bincount(tokens.lang, minlength=len(langs))
            found.append(pa.table({"lang": langs, "words": pa.array([0] * len(langs), pa.int32()), "phrase": pa.array([""] * len(langs)), "n": pa.array(total, pa.int64())}))
            code = np.zeros(len(ids), np.int64)
            for words, (places, hashes) in enumerate(tokens.levels(shared.value, longest), 1):
                known = within(shared.value[words - 1], hashes)
                places = places[known]
                # phrases by number: of the lang or of the phrase shorter by one, and of the last word
                before = tokens.lang[places] if words == 1 else code[places]
                _, first, code[places], n = np.unique(before * own + ids[places + words - 1], return_index=True, return_inverse=True, return_counts=True)
                at = places[first]
                parts = [texts.take(pa.array(ids[at + i])) for i in range(words)]
                phrase = pc.binary_join_element_wise(*parts, " ") if words > 1 else parts[0]
                found.append(pa.table({"lang": langs.take(pa.array(tokens.lang[at])), "words": pa.array(np.full(len(at), words, np.int32)), "phrase": phrase, "n": pa.array(n, pa.int64())}))
            if sum(t.num_rows for t in found) > PENDING:
                found = [summed(found)]
                if found[0].num_rows > PENDING // 2:
                    yield from found.pop().to_batches()
        if found:
            yield from summed(found).to_batches()

    rows = base.mapInArrow(emit, "lang string, words int, phrase string, n bigint")
    return checkpointed(rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)))


def summed(tables: list[pa.Table]) -> pa.Table:
    """Counts of slices of one task as one table."""
    out = pa.concat_tables(tables).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(["lang", "words", "phrase", "n"])


def scored(table: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of all phrases of two words or more, by their lowest cut."""
    many = table.where(F.col("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = "inline(transform(sequence(1, words - 1), k -> named_struct('k', k, 'left', substring_index(phrase, ' ', k), 'right', substring_index(phrase, ' ', k - words))))"
    cuts = many.select("lang", "phrase", "words", "a", F.expr(cut))
    part = table.where(F.col("words") > 0).select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), "f")
    for side, name in (("left", "l"), ("right", "r")):
        own = part.withColumnRenamed("f", name)
        cuts = cuts.join(own, (cuts["lang"] == own["part_lang"]) & (cuts[side] == own["part"])).drop("part_lang", "part")
    totals = small_side(table.where(F.col("words") == 0).select("lang", F.col("f").alias("n")))
    score = F.expr("(cast(a AS decimal(16, 0)) * cast(n AS decimal(18, 0)) * 1000BD) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
    lowest = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def within_longer(table: DataFrame) -> DataFrame:
    """lang, phrase, longer: the count of the most frequent longer phrase that a phrase of two words or more stands in."""
    inside = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    return table.where(F.col("words") > 2).select("lang", "f", F.explode(F.expr(inside)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each lang."""
    table = counted(docs, least, longest)
    found = scored(table).join(within_longer(table), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a lang may hold nearly all phrases: the first of parts of a lang, then the first of these
    parted = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    first = parted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
