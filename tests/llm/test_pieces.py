import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamer.llm import pieces

ALPHA = 0.5


@pytest.fixture(scope="module")
def lat():
    return pieces.lattice(pieces.model_path(), ALPHA)


def draw(lat, text, n, seed=0):
    return lat.sample([text.encode()] * n, pieces.mix64(np.arange(seed, seed + n).astype(np.uint64) + np.uint64(1)))


def paths(lat, s, at=0):
    """All segmentations with their log weights, by plain recursion."""
    if at == len(s):
        return {(): 0.0}
    out = {}
    for k in range(1, len(s) - at + 1):
        p = lat.piece.get(s[at:at + k])
        if p is not None:
            for rest, w in paths(lat, s, at + k).items():
                out[(p, *rest)] = lat.log_weight[p] + w
    return out


@pytest.mark.parametrize("text", ["the", "a bc", "  in on"])
def test_draws_follow_the_lattice(lat, text):
    want = paths(lat, b" " + text.encode())
    total = sum(map(math.exp, want.values()))
    n = 40_000
    got = Counter(tuple(x.tolist()) for x in draw(lat, text, n))
    assert set(got) <= set(want)
    for p, w in want.items():
        share = math.exp(w) / total
        assert abs(got[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="ab ▁\n\té漢𠮷", max_size=60))
def test_lossless(text):
    lat = pieces.lattice(pieces.model_path(), ALPHA)
    (ids,) = draw(lat, text, 1)
    assert lat.decode(ids).decode() == text
    if "▁" not in text and text:
        assert lat.model.decode(ids.tolist()) == text


def test_long_units_match_short_ones(lat, monkeypatch):
    text = "abcab" * 6
    short = draw(lat, text, 300)
    monkeypatch.setattr(pieces, "CACHED_BYTES", 4)
    lat.clear()
    long = draw(lat, text, 300)
    lat.clear()
    assert np.mean([a.tolist() == b.tolist() for a, b in zip(short, long)]) > 0.99  # but for float rounding
    assert lat.decode(draw(lat, "x" * 5000, 1)[0]) == b"x" * 5000


def test_rows_do_not_depend_on_partitions(docs_of):
    rows = [(i, f"Some text, {i} of many.\n" * (i % 7)) for i in range(60)] + [(5, None), (None, "no key"), (7, ""), (8, "é▁ x"), (9, "w" * 500)]
    a = sorted(map(str, pieces.sampled_digest(docs_of(rows).repartition(5), pieces.model_path()).collect()))
    b = sorted(map(str, pieces.sampled_digest(docs_of(rows[::-1]).coalesce(1), pieces.model_path()).collect()))
    assert a == b and len(a) == len(rows) and all("lossless=True" in r for r in a)
    other = sorted(map(str, pieces.sampled_digest(docs_of(rows), pieces.model_path(), seed=1).collect()))
    assert other != a
    enc = pieces.encode_sampled(docs_of(rows), pieces.model_path())
    back = sorted(str(tuple(r)) for r in pieces.decode(enc, pieces.model_path()).collect())
    assert back == sorted(str((i, t or "")) for i, t in rows)
    assert pieces.sampled_digest(docs_of([]), pieces.model_path()).count() == 0
