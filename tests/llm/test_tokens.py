import random

import pytest

pytest.importorskip("public_tokenizers")

from tessera.llm import pieces, tokens  # noqa: E402
from tests.llm import data  # noqa: E402

ODD = ["́", "\xa0", "　", "<|endoftext|>", "'s", "İ", "ẞ", "１", " ", "\x85", "\x1c", "é", "가", "ᄀ", "ᅡ", "!!", "Σ", "a", "b", " ", "the", "\n", "ing"]


@pytest.fixture(scope="module")
def library():
    t = tokens.load()
    return lambda text: t.encode(text, add_special_tokens=False)


def test_overlapping_chunks_count_as_the_whole(library):
    rng = random.Random(1)
    splices = 0
    for _ in range(300):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 150)))
        n, joined = tokens.count_overlapping(text, library, rng.choice([8, 20, 40]), rng.choice([1, 4, 9]))
        assert n == len(library(text).ids)
        splices += joined
    assert splices > 300


def test_documents_are_spliced(library):
    """Every document by small chunks: nearly all chunks are joined by a splice, and counts are those of the whole."""
    rows = data.corpus()
    joined = chunks = 0
    for _, text, *_ in rows:
        n, splices = tokens.count_overlapping(text or "", library, 60, 20)
        assert n == len(library(text or "").ids)
        joined += splices
        chunks += max(0, -(-len(text or "") // 60) - 1)
    assert joined >= 0.8 * chunks > 100


def test_full_cache_counts_right(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 30)
    rng = random.Random(6)
    count = tokens.counter()
    for _ in range(5):
        texts = [data.sentence(rng, rng.randint(1, 40), "abcd") for _ in range(20)]
        assert count(texts).tolist() == [len(library(t).ids) for t in texts]


def test_no_boundary_widens_to_the_whole(library):
    for text in ("abc" * 200, "a" * 100_000, " " * 5000 + "a b " + " " * 5000):
        assert tokens.count_overlapping(text, library, 50, 5)[0] == len(library(text).ids)


def test_vocabulary_that_joins_blanks_to_words_counts_right(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.words_alone(tokens.load()) and not tokens.words_alone(t)
    text = "Some words, and\n\n more of  them. " * 30
    assert tokens.counter("byte_bpe_50k.json", 50, 8)([text, None]).tolist() == [len(t.encode(text, add_special_tokens=False).ids), 0]


def test_counts_are_the_library_s(spark, library, monkeypatch):
    rows = data.corpus() + data.edge_rows()
    got = tokens.count_tokens(data.docs(spark, rows, clash=True), limit=20).collect()
    expected = sorted(((i, len((t or "").encode()), len(library(t or "").ids)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == expected
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert tokens.count_tokens(data.empty(spark)).count() == 0


def test_odd_texts_count_as_the_library_s(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 90))) for _ in range(300)] + [None, "", "x " * 40_000]
    assert tokens.counter()(texts).tolist() == [len(library(t or "").ids) for t in texts]


@pytest.fixture(scope="module")
def sentencepiece():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_pieces_are_the_library_s(sentencepiece):
    rng = random.Random(3)
    odd = [*ODD, "①", "😀", "  ", "\t", "▁", "er", "tion", "<s>", "<0x0A>", "中", "....", "=="]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdefghinorstuELT ") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["x" * 500, "", " "]
    got = pieces.encoder(pieces.load())(texts)
    assert [list(map(int, g)) for g in got] == sentencepiece.encode(texts, num_threads=1)


def test_encode_decode_round_trip(spark):
    rows = data.corpus() + data.edge_rows()
    encoded = pieces.encode_documents(data.docs(spark, rows, clash=True))
    assert encoded.columns == ["doc_id", "n_tokens", "token_ids"]
    back = sorted(((r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect()), key=str)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t, *_ in rows), key=str)
    digests = {r.doc_id: r for r in pieces.digests(data.docs(spark, rows)).collect()}
    assert not digests[7].round_trip and all(r.round_trip for i, r in digests.items() if i != 7)
    assert digests[1].n_tokens == 0 and pieces.encode_documents(data.empty(spark)).count() == 0


def test_long_text_without_blanks(sentencepiece):
    """Ten thousand characters in one word, and in a word of one repeated character."""
    rng = random.Random(9)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(10_000)), "a" * 5_000):
        assert pieces.encoder(pieces.load())([text])[0].tolist() == sentencepiece.encode(text)
