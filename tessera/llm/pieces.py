"""SentencePiece encoding and decoding with a batched Viterbi pass in numpy.

Texts are cut at blanks (a piece of this vocabulary has its blanks, written U+2581, in front only, which is checked when it
is loaded). Distinct words of equal length form a matrix of characters and advance together: at each position the hashes
of the substrings that end there probe the sorted piece keys, every piece found is a step from its start, and the best step's
length is stored as the back pointer; the back pointers from the end give the pieces.

The vocabulary is a byte-pair model: its segmentation is the outcome of merges by rank, not the one with the largest sum of
scores. So a step's weight is 0 if the merges would leave the two pieces side by side, else minus infinity, which a pair
of pieces decides by itself: undoing the merges of both pieces around the border, latest first, none of the pairs that
meet there may have merged earlier. One step into each position has weight 0, and the path of these steps is exactly
what the merges give. Characters without a piece become byte pieces.

Null and empty texts have no tokens. decode(encode(text)) is text, but that U+2581 in a text comes back as a blank. Repeated
rows get equal tokens. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Words whose tokens a worker keeps, of LONGEST characters at most each.
CACHE, LONGEST = 250_000, 64
#: Characters of the words that advance together.
BATCH = 200_000
NONE, UNKNOWN = -1, -2
FILTER_BITS = 20
NEVER = np.iinfo(np.int64).max


def load(model: str = MODEL) -> dict[str, np.ndarray]:
    """Arrays of the vocabulary. Pieces are renumbered: single characters first, then by rank of their merge."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    surface = {i: sp.id_to_piece(i) for i in ids}
    if any(BLANK in p.lstrip(BLANK) for p in surface.values()):
        raise ValueError("pieces hold blanks after other characters")
    single = [i for i in ids if len(surface[i]) == 1]
    order = single + sorted((i for i in ids if len(surface[i]) > 1), key=lambda i: (-sp.get_score(i), i))
    rank = {surface[i]: k for k, i in enumerate(order)}
    left, right = np.arange(len(order)), np.arange(len(order))
    reached = np.ones(len(order), bool)
    pairs = {}
    for k, i in enumerate(order):
        p = surface[i]
        for cut in range(1, len(p)):
            if p[:cut] in rank and p[cut:] in rank:
                pairs[rank[p[:cut]], rank[p[cut:]]] = k
        if k >= len(single):
            parts = list(p)
            while len(parts) > 1:
                best = min(((rank.get(a + b, len(order)), n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(len(order), 0))
                if best[0] == len(order):
                    break
                last = parts[best[1] : best[1] + 2]
                parts[best[1] : best[1] + 2] = ["".join(last)]
            if len(parts) == 1:
                left[k], right[k] = rank[last[0]], rank[last[1]]
            else:
                reached[k] = False
    pair_keys = np.array([a << 20 | b for a, b in pairs], np.int64)
    by = np.argsort(pair_keys)
    text = [surface[i] for i in order]
    hashes = np.array([_hash_of(p) for p in text], np.uint64)
    usable = np.flatnonzero(reached)
    key_order = usable[np.argsort(hashes[usable], kind="stable")]
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces share a hash")
    table = [b""] * sp.get_piece_size()
    for i in range(sp.get_piece_size()):
        table[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else surface.get(i, "").replace(BLANK, " ").encode()
    first_byte = next(i for i in range(sp.get_piece_size()) if sp.is_byte(i))
    return {
        "ids": np.array(order, np.int32), "left": left, "right": right, "pair_keys": pair_keys[by], "pair_to": np.array(list(pairs.values()), np.int64)[by],
        "keys": hashes[key_order], "of_key": key_order, "longest": np.array([max(map(len, text))]), "first_byte": np.array([first_byte]),
        "bytes": np.array(table, dtype=object), "key_filter": _filter(hashes[key_order]), "pair_filter": _filter(_spread(pair_keys)),
    }


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(FACTOR) + ord(c) + 1) & ((1 << 64) - 1)
    return h


def _spread(pairs: np.ndarray) -> np.ndarray:
    return pairs.view(np.uint64) * FACTOR


def _filter(keys: np.ndarray) -> np.ndarray:
    """Which values of the upper FILTER_BITS bits some key has: most probes end here and need no search."""
    out = np.zeros(1 << FILTER_BITS, bool)
    out[keys >> np.uint64(64 - FILTER_BITS)] = True
    return out


def _search(keys: np.ndarray, to: np.ndarray, wanted: np.ndarray, none: int) -> np.ndarray:
    """Values of `wanted` in a sorted key table, `none` for the absent."""
    pos = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[pos] == wanted, to[pos], none)


def stay_apart(v: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves pieces a and b side by side, for arrays of pairs."""
    result = np.ones(len(a), bool)
    at = np.flatnonzero((a >= 0) & (b >= 0))
    a, b, limit = a[at].copy(), b[at].copy(), np.full(len(at), NEVER)
    while len(at):
        k = a << 20 | b
        merged = v["pair_filter"][_spread(k) >> np.uint64(64 - FILTER_BITS)]
        some = np.flatnonzero(merged)
        merged[some] = _search(v["pair_keys"], v["pair_to"], k[some], NEVER) < limit[some]
        result[at[merged]] = False
        # undo the later of both merges; where that piece is a character, the other one
        inner_a, inner_b = v["right"][a], v["left"][b]
        whole_a, whole_b = inner_a == a, inner_b == b
        undo_a = np.where(a > b, ~whole_a, whole_b & ~whole_a)
        limit = np.where(undo_a, a, b + 1)
        go = ~merged & ~(whole_a & whole_b)
        a, b = np.where(undo_a, inner_a, a), np.where(undo_a, b, inner_b)
        at, a, b, limit = at[go], a[go], b[go], limit[go]
    return result


def viterbi(v: dict[str, np.ndarray], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and back pointers (lengths) by end position, for words of equal length (rows of chars)."""
    n, length = chars.shape
    longest = int(v["longest"][0])
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest, FACTOR), dtype=np.uint64)])
    prefix = np.zeros((n, length + 1), np.uint64)
    for j in range(length):
        prefix[:, j + 1] = prefix[:, j] * FACTOR + chars[:, j] + np.uint64(1)
    piece = np.full((n, length + 1), NONE, np.int64)
    back = np.zeros((n, length + 1), np.int64)
    for j in range(1, length + 1):
        sizes = np.arange(1, min(j, longest) + 1)
        hashes = prefix[:, j, None] - prefix[:, j - sizes] * power[sizes]
        before = piece[:, j - sizes]
        step = v["key_filter"][hashes >> np.uint64(64 - FILTER_BITS)] & ((before != NONE) | (j - sizes == 0))
        row, col = np.nonzero(step)
        found = np.full(hashes.shape, NONE, np.int64)
        found[row, col] = _search(v["keys"], v["of_key"], hashes[row, col], NONE)
        found[:, 0] = np.where(found[:, 0] == NONE, UNKNOWN, found[:, 0])
        step[row, col] = found[row, col] != NONE
        step[:, 0] = (before[:, 0] != NONE) | (j == 1)
        row, col = np.nonzero(step & (j - sizes > 0))
        step[row, col] = stay_apart(v, before[row, col], found[row, col])
        weight = np.where(step, 0.0, -np.inf)
        best = weight.argmax(1)
        rows = np.arange(n)
        piece[:, j] = np.where(step[rows, best], found[rows, best], NONE)
        back[:, j] = sizes[best]
    return piece, back


def encode_words(v: dict[str, np.ndarray], words: list[str]) -> list[bytes]:
    """Token ids of each word as bytes of 32-bit numbers."""
    out = [b""] * len(words)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, members in by_length.items():
        for start in range(0, len(members), max(1, BATCH // length)):
            some = members[start : start + max(1, BATCH // length)]
            chars = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(some), length)
            piece, back = viterbi(v, chars)
            rows, end = np.arange(len(some)), np.full(len(some), length)
            steps = []
            while len(rows):
                steps.append((rows, end, piece[rows, end]))
                end = end - back[rows, end]
                rows, end = rows[end > 0], end[end > 0]
            row, at, p = (np.concatenate(x) for x in zip(*steps, strict=True))
            order = np.lexsort((at, row))
            row, at, p = row[order], at[order], p[order]
            ids = np.where(p >= 0, v["ids"][p], UNKNOWN).astype(np.int32)
            cuts = np.searchsorted(row, np.arange(len(some) + 1))
            odd = set(row[p == UNKNOWN].tolist())
            for r, k in enumerate(some):
                mine = ids[cuts[r] : cuts[r + 1]]
                if r in odd:
                    whole: list[int] = []
                    for t, e in zip(mine.tolist(), at[cuts[r] : cuts[r + 1]].tolist(), strict=True):
                        whole += [t] if t >= 0 else [int(v["first_byte"][0]) + b for b in words[k][e - 1].encode("utf-8", "surrogatepass")]
                    mine = np.array(whole, np.int32)
                out[k] = mine.tobytes()
    return out


#: Tokens of words by model; a worker process keeps them from task to task.
KNOWN: dict[str, dict[str, bytes]] = {}


def encoder(v: dict[str, np.ndarray], model: str = MODEL) -> Callable[[list], list[np.ndarray]]:
    """fn(texts) -> token ids of each."""
    cache = KNOWN.setdefault(model, {})

    def encode(texts: list) -> list[np.ndarray]:
        parts = [WORD.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts]
        seen = {w for p in parts for w in p}
        known = {w: cache[w] for w in seen if w in cache}
        new = [w for w in seen if w not in known]
        known.update(zip(new, encode_words(v, new), strict=True))
        if len(cache) + len(new) > CACHE:
            cache.clear()
        cache.update((w, known[w]) for w in islice(known, CACHE) if len(w) <= LONGEST)
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]

    return encode


def decode_ids(v: dict[str, np.ndarray], ids: np.ndarray) -> str:
    """Text of token ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(v["bytes"][ids]).decode("utf-8", "replace").removeprefix(" ")


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def make():
        encode = encoder(shared.value, model)

        def rows(batch, texts):
            ids = encode(texts)
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [batch.column("doc_id"), np.diff(ends).astype(np.int64), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return rows

    return map_texts(docs.select("doc_id", "text"), "text", "doc_id bigint, n_tokens bigint, token_ids array<int>", make)


def decode_documents(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text for every row of (doc_id, token_ids); null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        v = shared.value
        for b in batches:
            texts = [decode_ids(v, np.array(x, np.int64)) if x else "" for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and whether decoding gives the text back, for every row of docs."""
    from hashlib import sha256

    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def make():
        v = shared.value
        encode = encoder(v, model)

        def rows(batch, texts):
            ids = encode(texts)
            same = [decode_ids(v, x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            return [batch.column("doc_id"), [len(x) for x in ids], [sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], same]

        return rows

    return map_texts(docs.select("doc_id", "text"), "text", "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean", make)
