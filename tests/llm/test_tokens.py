"""Ids from the table of chunks against the library's, text by text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from roamer.llm import common, jaccard, tokens

TEXTS = ["", "  ", "a", "Ab aB AB ab", "é É É x", "naïve, co-op; don't 12,345 #x\x0b\x0cy\x1cz", " nb sp q", "日本語 テスト", "<s> <|endoftext|> [PAD]", "x" * 300 + " y"]


def corpus(seed, n=400):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice("aAbBé ,.'1\n\t-Éß日") for _ in range(rng.randrange(90))) for _ in range(n)]


@pytest.mark.parametrize("segment,entries", [(1 << 21, 10**6), (50, 10**6), (50, 60), (1 << 21, 60)])
def test_ids_equal_the_library_s(monkeypatch, segment, entries):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    monkeypatch.setattr(tokens, "TABLE_ENTRIES", entries)
    monkeypatch.setattr(tokens, "KEPT_PARTS", 40)
    enc = tokens.ChunkEncoder(tokens.tokenizer_path())
    for texts in (corpus(1), corpus(2) + [" ".join(corpus(3))], []):
        raw = [t.encode() for t in texts]
        ids, sizes = enc.encode_many(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        want = [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    """A batch, and a table, in which different chunks share a hash."""
    monkeypatch.setattr(tokens, "span_hash", lambda p, a, b: np.full(len(a), 7, np.uint64))
    enc = tokens.ChunkEncoder(tokens.tokenizer_path())
    for text in ("one two three", "one", "eno", "two"):
        assert enc.encode(text.encode()).tolist() == enc.lib.encode(text, add_special_tokens=False).ids


def test_other_stages_drop_the_encoder():
    """Workers live on, and each would keep its table of chunks while later stages run."""
    path = tokens.tokenizer_path()
    enc = tokens.encoder(path)
    common.give_back("encoder")
    assert tokens.encoder(path) is enc
    list(jaccard._sets(iter([pa.record_batch([pa.array(["some words", None])], names=["text"])])))
    assert tokens.encoder.cache_info().currsize == 0 and tokens.encoder(path) is not enc
