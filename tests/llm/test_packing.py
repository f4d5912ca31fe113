import zlib

import numpy as np
import pytest

from roamer.llm import packing
from roamer.llm.tokens import encoder, tokenizer_path

EDGES = ["", None, " ", "It's DON'T we'll", "a<|endoftext|>b <|startoftext|>", "Σas ΑΣ İx ŉ ǅ", "é à. ́x",
         "x\x1cy 　 z\xa0q", "漢字 123 a1b2 ...'s!!", "ÀÖØß÷×é,", "a" * 300 + " " + "b." * 200, "abc<| abc|> <",
         "\U0001f600😀a", "A.B", "x'' 's", "ﬁ ﬀ", "K Å Ω"]


@pytest.mark.parametrize("text", [t for t in EDGES if t is not None])
def test_chunk_ids_equal_whole_text_ids(text):
    e = encoder(tokenizer_path())
    assert e.encode(text.encode()).tolist() == e.lib.encode(text, add_special_tokens=False).ids


def test_pack_lengths_reaches_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.integers(1, 101, 200)
        bins = packing.pack_lengths(x, 100)
        fill = np.bincount(bins, weights=x)
        assert fill.max() <= 100 and fill.min() > 0
        assert len(fill) <= len(np.unique(packing.best_fit_decreasing(x, 100)))


def test_search_empties_bins_that_best_fit_leaves():
    # Best fit decreasing needs three bins; 6+4 and 5+3+2 fill two.
    x = np.array([6, 5, 4, 3, 2])
    s = packing._Search(x, np.array([0, 1, 1, 0, 2]), 10)
    s.run(100)
    assert len(np.unique(s.bin)) == 2
    assert s.squares == sorted(s.squares)


def test_search_ends_only_where_no_exchange_raises():
    """No two bins are left with an exchange of up to two pieces for up to two that raises the sum of squared fills."""
    rng = np.random.default_rng(4)
    for median in (18, 25, 40):
        x = np.clip(rng.lognormal(np.log(median), 0.4, 700).astype(int), 1, 99)
        s = packing._Search(x, packing.best_fit_decreasing(x, 100), 100)
        bins = s.run()
        fill = np.bincount(bins, weights=x).astype(int)
        assert (s.squares == sorted(set(s.squares))) and fill.max() <= 100
        if np.count_nonzero(fill) == -(-x.sum() // 100):
            continue
        open_bins = [b for b in np.flatnonzero((fill > 0) & (fill < 100))]
        sums = {b: {0} | {a for a in x[bins == b]} | {a + c for i, a in enumerate(x[bins == b]) for c in x[bins == b][:i]} for b in open_bins}
        for a in open_bins:
            for b in open_bins:
                gains = [g - t for g in sums[a] for t in sums[b]] if a != b else []
                assert not any(n > 0 and fill[b] + n <= 100 and fill[b] + n > fill[a] for n in gains)


def test_search_reaches_the_bound_on_mid_length_pieces():
    rng = np.random.default_rng(1)
    x = np.clip(rng.lognormal(np.log(1000), 0.4, 2000).astype(int), 1, 4095)
    bins = packing.pack_lengths(x)
    assert bins.max() + 1 <= -(-x.sum() // 4096) + 1


@pytest.mark.parametrize("groups", [1, 7])
def test_places_are_whole_and_gapless(docs_of, groups):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(99, "word " * 9000), (99, "word " * 9000), (None, "x y")]
    n = 1 if groups == 1 else 4
    got = packing.pack_documents(docs_of(rows), tokenizer_path(), 64 if groups > 1 else 4096, group_pieces=n if groups > 1 else 50_000).toPandas()
    size = 64 if groups > 1 else 4096
    e, want = encoder(tokenizer_path()), []
    for i, t in rows:
        ids = np.append(e.lib.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4")
        want += [(i, p, a, len(ids[a:a + size]), zlib.crc32(ids[a:a + size].tobytes())) for p, a in enumerate(range(0, len(ids), size))]
    have = [(None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(str, have)) == sorted(map(str, want))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= size
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()


def test_empty_table_and_sequences(docs_of):
    assert packing.pack_documents(docs_of([]), tokenizer_path()).count() == 0
    docs = docs_of([(1, "a b c"), (2, "d e"), (3, "word " * 50)])
    packed = packing.pack_documents(docs, tokenizer_path(), 16)
    seqs = packing.sequences(docs, packed, tokenizer_path(), 16).toPandas()
    assert sum(len(x) // 4 for x in seqs["ids"]) == packed.toPandas()["length"].sum()
