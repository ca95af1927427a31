"""Token counts of whole texts as the tokenizers library gives them, with huge texts encoded in overlapping chunks.

Every text is cut into chunks of CHUNK characters that overlap; a text that is no longer than that is one chunk. The library encodes
the chunks, and two neighbouring chunks are spliced at a boundary that is proven stable: after white space, both encodings
begin a token at the same character, and on both sides of it they have the same tokens at the same characters, AGREE of them or as
many as the overlap holds. Where no such boundary lies in the overlap, the right chunk begins earlier, twice as
far each time, and is encoded anew; if that reaches the chunk's own beginning, both are encoded as one, so the splice never guesses.

Inside a text of one chunk, words between ASCII white space are encoded once and their counts kept, where the vocabulary is proven to
count words alone (words_alone: its pre-tokenizer drops white space and never joins what stands on both sides of it); for another one the library encodes
the text. A pre-tokenizer that joins white space to words begins no token after white space either, so that its long texts are encoded as one, still right.
Special strings inside a text are handled as the library does by default.

Texts repeated in a batch are encoded once. Null and empty texts have 0 tokens. Repeated rows get equal counts. Further columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a chunk, and the first overlap of two chunks.
CHUNK = 16_384
OVERLAP = 256
#: Tokens that must agree on each side of a splice (or up to the ends of the overlap).
AGREE = 4
#: Characters that the library encodes in one call: bounds the memory of its encodings.
CALL = 400_000
#: Words whose counts a worker keeps, of LONGEST bytes at most each.
CACHE, LONGEST = 250_000, 64
BLANKS = " \t\n\r\v\f"


def load(vocabulary: str = VOCABULARY):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    t.no_truncation()
    t.no_padding()
    return t


class Chunk:
    """An encoded stretch of a text from character `start` to `end`."""

    def __init__(self, encoding, start: int, end: int):
        self.ids, self.start, self.end = encoding.ids, start, end
        self._at, self._span = encoding.char_to_token, encoding.token_to_chars

    def token_at(self, p: int) -> int | None:
        """Number of the token that begins at character p of the whole text."""
        k = self._at(p - self.start)
        return k if k is not None and self._span(k)[0] == p - self.start else None

    def near(self, k: int, before: int, after: int) -> list[tuple[int, int, int]]:
        """Tokens around token k, with their characters in the whole text."""
        spans = ((self.ids[i], *self._span(i)) for i in range(k - before, k + after))
        return [(t, a + self.start, b + self.start) for t, a, b in spans]


def splice(left: Chunk, right: Chunk, text: str, agree: int = AGREE) -> tuple[int, int] | None:
    """Numbers of tokens to keep of `left` and to drop of `right`; None without a stable boundary in their overlap."""
    for p in range(left.end - 1, right.start, -1):
        if not text[p - 1].isspace() or text[p].isspace():
            continue
        i, k = left.token_at(p), right.token_at(p)
        if not i or not k:
            continue
        before, after = min(agree, i, k), min(agree, len(left.ids) - i, len(right.ids) - k)
        whole = (before == agree or i == before) and (after == agree or len(right.ids) - k == after)
        if whole and left.near(i, before, after) == right.near(k, before, after):
            return i, k
    return None


def count_overlapping(text: str, encode: Callable, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a text from overlapping chunks, and how many splices joined them."""

    def chunk(start: int, end: int) -> Chunk:
        return Chunk(encode(text[start:end]), start, end)

    current, total, dropped, splices = chunk(0, min(size, len(text))), 0, 0, 0
    while current.end < len(text):
        at, width = None, overlap
        while at is None and (start := current.end - width) > current.start:
            following = chunk(start, min(len(text), current.end + size))
            at = splice(current, following, text)
            at = None if at is None or at[0] < dropped else at
            width *= 2
        if at is not None:
            total += at[0] - dropped
            current, dropped, splices = following, at[1], splices + 1
            continue
        # no stable boundary since the chunk's beginning: a chunk twice as long
        longer = chunk(current.start, min(len(text), current.end + max(size, current.end - current.start)))
        if dropped > len(longer.ids) or longer.near(0, 0, dropped) != current.near(0, 0, dropped):  # its beginning was not final
            return len(encode(text).ids), 0
        current = longer
    return total + len(current.ids) - dropped, splices


def words_alone(tokenizer) -> bool:
    """Whether a text has as many tokens as its words between ASCII white space have alone: no added token holds or eats white space, the normaliser keeps
    words apart, and no pre-token covers white space, whatever stands around it."""
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added) or tokenizer.pre_tokenizer is None:
        return False
    sides = ["a", "B", "1", "!", "'s", "'", "\u0301", "é", "中", "_", "<|", "\u200d", "\u1100", "\u1161"]
    for blank in [*BLANKS, "  ", "\r\n"]:
        for left in sides:
            for right in sides:
                text = tokenizer.normalizer.normalize_str(left + blank + right) if tokenizer.normalizer else left + blank + right
                if not any(c.isspace() for c in text) or any(any(c.isspace() for c in text[a:b]) for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)):
                    return False
                if tokenizer.encode(left + blank + right, add_special_tokens=False).ids != [t for x in (left, right) for t in tokenizer.encode(x, add_special_tokens=False).ids]:
                    return False
    return True


@lru_cache(2)
def _loaded(vocabulary: str) -> tuple:
    """Tokenizer, whether its words count alone, and counts of words: kept by a worker from task to task."""
    tokenizer = load(vocabulary)
    return tokenizer, words_alone(tokenizer), {}


def counter(vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> Callable[[list], np.ndarray]:
    """fn(texts) -> tokens of each."""
    tokenizer, alone, cache = _loaded(vocabulary)

    def encode(text: str):
        return tokenizer.encode(text, add_special_tokens=False)

    def lengths(some: list[str], step: int) -> Iterator[int]:
        for start in range(0, len(some), step):
            yield from map(len, tokenizer.encode_batch_fast(some[start : start + step], add_special_tokens=False))

    def by_words(texts: list[str]) -> Iterator[int]:
        parts = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        seen = dict.fromkeys(chain.from_iterable(parts))
        known = {w: cache[w] for w in seen if w in cache}
        fresh = [w for w in seen if w not in known]
        known.update(zip(fresh, lengths([w.decode("utf-8", "surrogatepass") for w in fresh], 20_000), strict=True))
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
        cache.update((w, known[w]) for w in islice(known, CACHE) if len(w) <= LONGEST)
        for p in parts:
            yield sum(map(known.__getitem__, p))

    def count(texts: list) -> np.ndarray:
        known = {"": 0}
        short: list[str] = []
        for text in dict.fromkeys(t for t in texts if t):
            if len(text) > size:
                known[text] = count_overlapping(text, encode, size, overlap)[0]
            else:
                short.append(text)
        known.update(zip(short, by_words(short) if alone else lengths(short, max(1, CALL // size)), strict=True))
        return np.array([known[t or ""] for t in texts], np.int64)

    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""

    def make():
        count = counter(vocabulary)

        def rows(batch, texts):
            n = count(texts)
            return [batch.column("doc_id"), batch.column("n_bytes"), n, n > limit]

        return rows

    base = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return map_texts(base, "text", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
