"""Language-model scoring with a log-frequency Bloom filter.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end a text. Words are told apart by 64-bit hashes.
The training texts' unigrams and bigrams (the end of the text before stands before a first word) are counted in full by one
shuffle. A count c is held as its level 1 + floor(log_BASE c): the n-gram is put into a Bloom filter once for each level up
to its own, and a reader probes level after level until one is missing.

The filter is cut into segments by the upper bits of the keys, one for about SEGMENT_CHARS characters of training text. Each
is as many pages of PAGE_BITS bits as its levels need, so that no page is more than half full: every n-gram is
entered, and the filter grows with the corpus. Tasks count a slice of the texts and send one packed row for each segment; what is
gathered for a segment is bounded by its share of the n-grams. A filter of up to BROADCAST bytes is sent
to all tasks. A larger one stays dealt out by segment: slices of the texts send their distinct words and word pairs
to the segments once, which count them, look them up and answer the slice (see score_apart).

score = sum of log10(WEIGHT c(v w) / c(v) + (1 - WEIGHT) (c(w) + 0.1) / (N + 0.1 (V + 1))), with counts as the filter has them.
base_score uses exact counts: those of the HOT most frequent words are broadcast (a bounded table), the rarer words
of each text meet theirs in a join.

Null texts count as empty: one end. Without training texts all counts are 0. Repeated rows get equal scores (and count as often
as they stand). Null ids count as the empty text for the hold-out. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, map_texts, slices, words

HELD_OUT = (10, 0)
BASE = 1.5
PAGE_BITS = 1 << 16
PROBES = 5
#: Characters of training text for a segment, and the least number of upper bits that name one.
SEGMENT_CHARS = 1 << 21
LEAST_BITS = 8
#: Most bytes of a filter that is broadcast.
BROADCAST = 96 << 20
#: Characters of training text for a byte of the filter, nearly: beyond BROADCAST times as many it is not built in one piece.
CHARS_A_BYTE = 8
WEIGHT = 0.3
PRIOR = 0.1
#: Most words in the table of exact counts that is broadcast.
HOT = 1 << 19
END = np.int64(-2)
CACHE = 200_000
#: Characters counted or scored at once.
SLICE = 2_000_000
#: Characters of a slice that asks the segments.
APART = 6_000_000
#: Keys probed at a time.
BLOCK = 1 << 15
DEPTH = 64
SINGLE = (1 << np.arange(8)).astype(np.uint8)


#: Levels that fill half of a page.
ROOM = int(PAGE_BITS * np.log(2) / PROBES)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordKeys(dict):
    """Keys of words, which are even, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) & ~1
        key = self[word] = h - (1 << 64) if h >> 63 else h
        return key


def hasher() -> Callable[[str | None], np.ndarray]:
    """fn(text) -> the tokens' keys, the end last."""
    cache = WordKeys()

    def keys(text: str | None) -> np.ndarray:
        ws = words(text)
        if len(cache) > CACHE:
            cache.clear()
        return np.append(np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws)), END)

    return keys


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Odd keys of bigrams."""
    x = mix(left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(right.view(np.uint64)))
    return (x | np.uint64(1)).view(np.int64)


def before(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate([[END], tokens[:-1]])


def page_of(keys: np.ndarray, pages: np.ndarray | int) -> np.ndarray:
    """Page of each key in its segment of `pages` pages."""
    spread = mix(keys.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return ((spread * np.asarray(pages).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def positions(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Bits (within the page) of a key at a level: PROBES columns."""
    x = mix(keys.view(np.uint64) + np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(PAGE_BITS - 1)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(DEPTH, 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)).astype(np.int64)


#: Count that a level stands for: the middle of its counts; level 0: none.
MEANING = np.array([0.0] + [max(1.0, (np.ceil(BASE ** (j - 1) - 1e-9) + max(np.ceil(BASE**j - 1e-9) - 1, np.ceil(BASE ** (j - 1) - 1e-9))) / 2) for j in range(1, DEPTH + 1)])


def fill(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Bits of a segment: all its n-grams, in pages enough to have room for every level."""
    level = levels(counts)
    pages = max(1, -(-int(level.sum()) // ROOM))
    while np.bincount(page_of(keys, pages), weights=level, minlength=pages).max(initial=0) > ROOM:
        pages += 1 + pages // 16
    bits = np.zeros(pages * PAGE_BITS, np.uint8)
    base = page_of(keys, pages) * PAGE_BITS
    for rung in range(1, int(level.max(initial=0)) + 1):
        has = level >= rung
        bits[(base[has][:, None] + positions(keys[has], rung)).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def look_up(bits: bytes | bytearray, pages: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Level of each key: as many levels as are found one after another. bits: those of the segments in a row; pages: of each segment.

    Keys are probed in the order of segments, BLOCK at a time, so that the bytes and the arrays probed stay in the processor's cache.
    """
    own = np.frombuffer(bits, np.uint8)
    level = np.zeros(len(keys), np.int64)
    first = np.cumsum(pages) - pages
    order = np.argsort(keys.view(np.uint64), kind="stable")
    for start in range(0, len(order), BLOCK):
        some = order[start : start + BLOCK]
        seg = segment_of(keys[some], len(pages))
        held = pages[seg] > 0
        some, seg = some[held], seg[held]
        level[some] = _look_up(own, keys[some].view(np.uint64), (first[seg] + page_of(keys[some], pages[seg])) * PAGE_BITS)
    return level


def _look_up(own: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
    level = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))

    def found(base: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = base + (x & np.uint64(PAGE_BITS - 1)).view(np.int64)
        return (own[at >> 3] & SINGLE[at & 7]) > 0

    for rung in range(1, DEPTH + 1):
        x = mix(keys + np.uint64(rung * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        step = (x >> np.uint64(32)) | np.uint64(1)
        hit = found(base, x)
        if rung == 1:  # most absent keys end here
            left = np.flatnonzero(hit)
            alive, keys, base, x, step, hit = alive[left], keys[left], base[left], x[left], step[left], hit[left]
        for _ in range(PROBES - 1):
            x = x + step
            hit &= found(base, x)
        left = np.flatnonzero(hit)
        if len(left) < len(alive):
            alive, keys, base = alive[left], keys[left], base[left]
        if not len(alive):
            break
        level[alive] = rung
    return level


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def training(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", HELD_OUT[0]) != HELD_OUT[1]).select("text")


def count_grams(docs: DataFrame, segments: int) -> DataFrame:
    """A row for each segment that has n-grams: seg, keys and counts of its words (packed 64-bit numbers) and the bits of the filter. Checkpointed."""
    train = training(docs)

    def pieces(batches):
        keys_of = hasher()
        for batch in batches:
            for _, texts in slices(batch, "text", SLICE):
                tokens = [keys_of(t) for t in texts]
                one = np.concatenate(tokens)
                two = pair_keys(np.concatenate([before(t) for t in tokens]), one)
                key, n = np.unique(np.concatenate([one, two]).view(np.uint64), return_counts=True)
                seg, first = np.unique(segment_of(key, segments), return_index=True)
                packed = [[x.tobytes() for x in np.split(of, first[1:])] for of in (key, n.astype(np.uint32))]
                yield pa.RecordBatch.from_pydict({"seg": pa.array(seg), "keys": pa.array(packed[0], pa.binary()), "counts": pa.array(packed[1], pa.binary())})

    def summed(group: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32)
        key, of = np.unique(keys, return_inverse=True)
        n = np.bincount(of, weights=counts).astype(np.int64)
        word = (key & np.uint64(1)) == 0
        bits = fill(key.view(np.int64), n)
        return pa.table({"seg": group.column("seg").slice(0, 1), "keys": pa.array([key[word].tobytes()], pa.binary()), "counts": pa.array([n[word].tobytes()], pa.binary()), "bits": pa.array([bits], pa.binary())})

    spread = train.mapInArrow(pieces, "seg bigint, keys binary, counts binary")
    return checkpointed(spread.groupBy("seg").applyInArrow(summed, "seg bigint, keys binary, counts binary, bits binary"))


def unpacked(built: DataFrame) -> DataFrame:
    """(key, n) of all words."""

    def rows(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.frombuffer(keys, np.int64)), "n": pa.array(np.frombuffer(counts, np.int64))})

    return built.select("keys", "counts").mapInArrow(rows, "key bigint, n bigint")


def fit(docs: DataFrame, n_segments: int) -> tuple[dict, DataFrame] | None:
    """The model (filter by segment, totals, exact counts of frequent words) and the table (key, n) of all words' counts; None if the filter is too large to broadcast."""
    built = count_grams(docs, n_segments)
    segments = built.select("seg", "bits")
    if (segments.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) > BROADCAST:
        return None
    counts = checkpointed(unpacked(built))
    pages = np.zeros(n_segments, np.int64)
    for r in segments.select("seg", F.octet_length("bits").alias("n")).collect():  # a number for each segment: at most one for a page of BROADCAST
        pages[r.seg] = r.n * 8 // PAGE_BITS
    ends = np.cumsum(pages) * (PAGE_BITS // 8)
    bits = bytearray(int(ends[-1]))
    for r in segments.toLocalIterator():
        bits[ends[r.seg] - len(r.bits) : ends[r.seg]] = r.bits
    # Words by eighths of powers of two of their counts: some hundred rows say how many words are as frequent.
    scale = F.floor(F.log2("n") * 8)
    by_scale = counts.groupBy(scale.alias("s")).agg(F.count(F.lit(1)).alias("w"), F.sum("n").alias("t")).collect()
    total, distinct = sum(r.t for r in by_scale), sum(r.w for r in by_scale)
    least, held = 10**6, 0
    for r in sorted(by_scale, key=lambda r: -r.s):
        held += r.w
        if held > HOT:
            break
        least = r.s
    hot = counts.where(scale >= least).toPandas()
    order = np.argsort(hot["key"].to_numpy())
    model = {"bits": bits, "pages": pages, "total": np.array([total]), "distinct": np.array([distinct]), "keys": hot["key"].to_numpy()[order].astype(np.int64), "counts": hot["n"].to_numpy()[order].astype(np.int64)}
    return model, counts


def log_probabilities(model: dict, units: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 probability of each token, from probes of the filter. units: the distinct tokens; these and the distinct pairs are probed once each; at: which one a token is; starts: first token of each text."""
    count = MEANING[look_up(model["bits"], model["pages"], units)]
    before = np.concatenate([[0], at[:-1]])
    before[starts] = np.searchsorted(units, END)
    pairs, of = np.unique(pair_keys(units[before], units[at]), return_inverse=True)
    both = MEANING[look_up(model["bits"], model["pages"], pairs)][of]
    norm = max(1e-300, float(model["total"][0]) + PRIOR * (float(model["distinct"][0]) + 1))
    return blended(count, both, before, at, norm)


def blended(count: np.ndarray, both: np.ndarray, before: np.ndarray, at: np.ndarray, norm: float) -> np.ndarray:
    """log10 probability of each token. count: of the distinct tokens; both: of each token's pair; before, at: the distinct token before a token, and its own."""
    p = (1 - WEIGHT) * (count[at] + PRIOR) / norm + WEIGHT * both / np.maximum(np.maximum(count[before], both), 1)
    return np.log10(np.minimum(p, 1))


def packed(numbers: np.ndarray) -> bytes:
    """Differences of 64-bit numbers, their highest bytes last together, which compress well where the numbers are sorted."""
    return np.diff(numbers.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(held: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers with their bytes sorted by place, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(held: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    whole = np.frombuffer(pa.decompress(held, decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(whole.reshape(size, n).T).view(kind).ravel()


def asked_keys(units: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: its distinct keys (sorted, unsigned; words are even), where in them each token's pair stands, the token before each one (of units), and the first token of each text. units: distinct tokens, sorted as unsigned; the end is the last."""
    starts = np.cumsum(lengths) - lengths
    left = np.concatenate([[0], at[:-1]])
    left[starts] = len(units) - 1
    pairs, of = np.unique(pair_keys(units.view(np.int64)[left], units.view(np.int64)[at]).view(np.uint64), return_inverse=True)
    keys = np.sort(np.concatenate([units, pairs]))
    return keys, np.searchsorted(keys, pairs)[of], left, starts


def score_apart(docs: DataFrame, segments: int) -> DataFrame:
    """The columns of score_documents by a filter that stays dealt out by segment.

    Slices of the texts are written down as numbers of their words. A slice sends its keys, and how often they stand in training texts, to the segments once; a segment
    adds up, fills its part of the filter and answers each slice with the keys' levels and the words' counts. So each distinct key of a slice travels there and back once.
    """

    def cut(batches):
        keys_of, part, n = hasher(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some, texts in slices(batch, "text", APART):
                tokens = [keys_of(t) for t in texts]
                units, at = np.unique(np.concatenate(tokens).view(np.uint64), return_inverse=True)
                held = [squeezed(np.diff(units, prepend=np.uint64(0))), squeezed(at.astype(np.uint32))]
                one = {"slice": [(part << 32) + n], "ids": [some.column("doc_id")], "held": [some.column("held_out")], "lengths": [[len(t) for t in tokens]], "n_units": [len(units)], "units": [held[0]], "at": [held[1]]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(one.items(), kinds, strict=True)})
                n += 1

    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]

    def read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array(row["lengths"], np.int64)
        units = np.cumsum(unsqueeze(row["units"], row["n_units"], np.uint64), dtype=np.uint64)
        return units, unsqueeze(row["at"], int(lengths.sum()), np.uint32).astype(np.int64), lengths

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                units, at, lengths = read(row)
                keys, pair, _, _ = asked_keys(units, at, lengths)
                learnt = np.repeat(~np.array(row["held"], bool), lengths)
                n = (np.bincount(np.searchsorted(keys, units)[at], weights=learnt, minlength=len(keys)) + np.bincount(pair, weights=learnt, minlength=len(keys))).astype(np.uint32)
                seg, first = np.unique(segment_of(keys, segments), return_index=True)
                yield pa.RecordBatch.from_pydict({
                    "seg": pa.array(seg), "slice": pa.array(np.full(len(seg), row["slice"])),
                    "keys": pa.array([packed(x) for x in np.split(keys, first[1:])], pa.binary()), "counts": pa.array([x.tobytes() for x in np.split(n, first[1:])], pa.binary()),
                })

    def answer(group: pa.Table) -> pa.Table:
        sent = [unpack(x) for x in group.column("keys").to_pylist()]
        key, of = np.unique(np.concatenate(sent), return_inverse=True)
        n = np.bincount(of, weights=np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint32), minlength=len(key)).astype(np.int64)
        word, known = (key & np.uint64(1)) == 0, n > 0
        level = np.zeros(len(key), np.uint8)
        if known.any():
            bits = fill(key[known].view(np.int64), n[known])
            pages = len(bits) * 8 // PAGE_BITS
            level = _look_up(np.frombuffer(bits, np.uint8), key, page_of(key, pages) * PAGE_BITS).astype(np.uint8)
        each = np.split(of, np.cumsum([len(x) for x in sent])[:-1])
        seg, rows = group.column("seg")[0].as_py(), len(sent) + 1
        return pa.table({
            "seg": pa.array([seg] * rows, pa.int64()), "slice": pa.array([*group.column("slice").to_pylist(), None], pa.int64()),
            "n_keys": pa.array([*map(len, sent), 0], pa.int64()), "n_words": pa.array([*(int(word[x].sum()) for x in each), 0], pa.int64()),
            "levels": pa.array([*(squeezed(level[x]) for x in each), b""], pa.binary()), "counts": pa.array([*(squeezed(n[x[word[x]]]) for x in each), b""], pa.binary()),
            "tokens": pa.array([0] * len(sent) + [int(n[word].sum())], pa.int64()), "words": pa.array([0] * len(sent) + [int((word & known).sum())], pa.int64()),
        })

    base = docs.select("doc_id", "text", (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    cuts = checkpointed(base.mapInArrow(cut, "slice bigint, ids array<bigint>, held array<boolean>, lengths array<bigint>, n_units bigint, units binary, at binary"))
    sent = cuts.mapInArrow(ask, "seg bigint, slice bigint, keys binary, counts binary")
    answers = checkpointed(sent.groupBy("seg").applyInArrow(answer, "seg bigint, slice bigint, n_keys bigint, n_words bigint, levels binary, counts binary, tokens bigint, words bigint"))
    total, distinct = (int(x or 0) for x in answers.where(F.col("slice").isNull()).agg(F.sum("tokens"), F.sum("words")).first())
    norm = max(1e-300, total + PRIOR * (distinct + 1))

    def score(held: pa.Table, got: pa.Table) -> pa.Table:
        (row,) = held.to_pylist()
        units, at, lengths = read(row)
        keys, pair, left, starts = asked_keys(units, at, lengths)
        got = got.sort_by("seg")
        joined = lambda name, size, kind: np.concatenate([unsqueeze(x, n, kind) for x, n in zip(got.column(name).to_pylist(), got.column(size).to_pylist(), strict=True)])
        count, exact = MEANING[joined("levels", "n_keys", np.uint8)], joined("counts", "n_words", np.int64)
        logs = blended(count[np.searchsorted(keys, units)], count[pair], left, at, norm)
        add = lambda x: np.add.reduceat(x, starts)
        own = [row["ids"], row["held"], lengths, add((exact > 0).astype(np.int64)[at]), add(np.log10(exact + PRIOR)[at]) - lengths * np.log10(norm), add(logs)]
        return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), (pa.array(x, t) for x, t in zip(own, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)), strict=True)))

    answers = answers.where(F.col("slice").isNotNull()).drop("tokens", "words")
    out = cuts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    chars = training(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 << max(LEAST_BITS, (chars // SEGMENT_CHARS).bit_length())
    fitted = fit(docs, segments) if chars <= BROADCAST * CHARS_A_BYTE else None
    if fitted is None:
        return score_apart(docs, segments)
    model, counts = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)
    total, norm = int(model["total"][0]), float(model["total"][0]) + PRIOR * (float(model["distinct"][0]) + 1)

    def make():
        m, keys_of = shared.value, hasher()

        def rows(batch, texts):
            tokens = [keys_of(t) for t in texts]
            n = np.array([len(t) for t in tokens], np.int64)
            starts = np.cumsum(n) - n
            units, at = np.unique(np.concatenate(tokens), return_inverse=True)
            score = np.add.reduceat(log_probabilities(m, units, at, starts), starts)
            # exact counts of the words in the table; the others are listed once a text
            place = np.minimum(np.searchsorted(m["keys"], units), max(0, len(m["keys"]) - 1))
            hot = m["keys"][place] == units if len(m["keys"]) else np.zeros(len(units), bool)
            logs = np.zeros(len(units))
            logs[hot] = np.log10(m["counts"][place[hot]] + PRIOR)
            known, base = np.add.reduceat(hot[at].astype(np.int64), starts), np.add.reduceat(logs[at], starts)
            rare = np.flatnonzero(~hot[at])
            owner = np.repeat(np.arange(len(n)), n)[rare]
            pair, times = np.unique(owner * len(units) + at[rare], return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(n) + 1) * len(units)).astype(np.int32)
            cold = pa.StructArray.from_arrays([pa.array(units[pair % len(units)]), pa.array(times.astype(np.int32))], ["key", "times"])
            return [batch.column("doc_id"), batch.column("held_out"), n, known, base, score, pa.ListArray.from_arrays(pa.array(ends), cold)]

        return rows

    base = docs.select("doc_id", "text", (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"))
    scored = map_texts(base, "text", "doc_id bigint, held_out boolean, n_tokens bigint, hot_known bigint, hot_base double, score double, cold array<struct<key: bigint, times: int>>", make, SLICE)
    scored = checkpointed(scored).withColumn("row", F.monotonically_increasing_id())  # the files of the checkpoint fix the order

    rare = scored.select("row", F.inline("cold")).join(counts, "key", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(n + F.lit(PRIOR))).alias("part"))
    out = scored.drop("cold").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("part", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(norm)))).alias("base_score"),
        "score",
    )
