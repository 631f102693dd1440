import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from allotau.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def count():
    return T.Counter(T.read_vocabulary(PATH))


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_character_in_context(library, count):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}  {c}.{c}" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    assert count(texts).tolist() == expected(library, texts)


def test_random_texts(library, count):
    rng = random.Random(5)
    alphabets = ["'srevlmdtx ", "ab \n\t 1.", "aA", "的 á中ß'", "=-_ ", "0123456789abcdef", "".join(map(chr, range(32, 500)))]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(0, 80))) for _ in range(6000)]
    texts += ["", None, " ", "'", "'r", "'re", "it's we'll'd I'VE", "a<|endoftext|>  b<|endoftext|>", "<|endoftext|>" * 3, "<|endof text|>", "x \n\n y", "  "]
    assert count(texts).tolist() == expected(library, texts)
    assert [int(count([t])[0]) for t in texts[:500]] == expected(library, texts[:500])


def test_long_pretokens_and_long_texts(library, count):
    rng = random.Random(6)
    texts = ["a" * 100_001, "".join(rng.choices("ab", k=50_000)), "=" * 77_777, " " * 30_000 + "x", "é" * 20_000, "word " * 60_000, "".join(rng.choices("abcdefghij", k=60_000))]
    assert count(texts).tolist() == expected(library, texts)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(T, "MOST_STEPS", 50)
    monkeypatch.setattr(T, "MOST_KEPT", 3)
    texts = ["The quick brown fox jumps over the lazy dog, unbelievably often. " * 3, "Straßenbahnhaltestelle und Übermut"]
    assert T.Counter(T.read_vocabulary(PATH))(texts).tolist() == expected(library, texts)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 128])
def test_chunks_may_be_cut_anywhere(chunk):
    rng = np.random.default_rng(chunk)
    classes = np.append(rng.integers(0, 12, 3000), T.END).astype(np.uint8)
    assert T.pretoken_starts(classes, chunk).tolist() == T.pretoken_starts(classes, 4096).tolist()


def test_composition_of_maps():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, T.STATES, (37, T.STATES)).astype(np.uint8)
    got, state = T.composed(maps), np.arange(T.STATES)
    for k in range(37):
        state = maps[k][state]
        assert (got[k] == state).all()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        T.Counter(T.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))


def test_op12(spark, library):
    got = {r["doc_id"]: r for r in T.op12_token_counts(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = dict(zip([d for d, _ in docs], expected(library, [t for _, t in docs]), strict=True))
    assert {i: r["n_tokens"] for i, r in got.items()} == want
    assert {i: r["n_bytes"] for i, r in got.items()} == {d: len((t or "").encode()) for d, t in docs}
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got.values())


def test_nulls_repeats_and_clashing_names(spark, library):
    rows = [(None, None, "x"), (1, "a b", "y"), (1, "a b", "y"), (2, "", None), (2**60 + 1, "long " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    vocabulary = T.read_vocabulary(PATH)
    got = T.token_counts(docs.select("doc_id", "text"), "text", vocabulary).collect()
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((i, n) for (i, _, _), n in zip(rows, expected(library, [t for _, t, _ in rows]), strict=True)), key=key)
    assert T.token_counts(docs, "text", vocabulary, "n").columns == ["doc_id", "n_tokens", "n"]
    assert T.token_counts(docs.limit(0).select("doc_id", "text"), "text", vocabulary).collect() == []
