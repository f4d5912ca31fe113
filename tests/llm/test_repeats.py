import hashlib
import random

import pytest

from roamer.llm import repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    places = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            places.setdefault(t[s:s + length], []).append((d, s))
    gone = [bytearray(len(t)) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for d, s in where:
                gone[d][s:s + length] = b"\1" * length
    out = []
    for (i, _), t, g in zip(rows, texts, gone):
        runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((i, len(t), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest()))
    return sorted(map(str, out))


def corpus(seed, n=120):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("ab éc\n", k=k))
    passages = [text(k) for k in (10, 25, 39, 40, 41, 60, 90, 300)]
    rows = [(0, None), (1, ""), (2, "a" * 39), (3, "a" * 40), (4, "b" * 400), (5, "xyz" * 60), (6, "xyz" * 50 + "q")]
    for i in range(7, n):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p if rng.random() < 0.5 else p[a:a + rng.randint(1, 80)], text(rng.randint(0, 50))]
        rows.append((i, "".join(parts)))
    return rows + [rows[20], rows[21], rows[21], (22, "other text under a used id " * 3), (None, rows[23][1]), (None, text(100))]


@pytest.mark.parametrize("seed,group", [(1, 1024), (2, 1024), (3, 2)])
def test_against_brute_force(docs_of, seed, group):
    rows = corpus(seed)
    got = repeats.repeat_digest(docs_of(rows).repartition(4), 40, 9, group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 40)


def groups_of(docs, max_group):
    got = {}
    for r in repeats.repeated_spans(repeats.marked(docs), 40, 9, max_group, groups=True).collect():
        got.setdefault((r["key"], r["whole"], r["repeat"]), []).append((r["doc_id"], r["mark"], r["first"], r["stop"]))
    return got


@pytest.mark.parametrize("seed", [1, 4])
def test_groups_do_not_depend_on_crowding(docs_of, seed):
    rows = [r for r in corpus(seed) if r[0] is not None]
    docs = docs_of(rows)
    text = {(r["doc_id"], r["mark"]): (r["text"] or "").encode() for r in repeats.marked(docs).collect()}
    few, many = (groups_of(docs, n) for n in (1024, 2))
    assert sorted(map(sorted, few.values())) == sorted(map(sorted, many.values())) and len(many) > 20
    for found in many.values():
        strings = {text[d, m][a:b] for d, m, a, b in found}
        assert len(found) > 1 and len(strings) == 1 and len(strings.pop()) >= 40


def test_equal_spans_of_one_anchor_are_groups_of_their_own(docs_of):
    rng = random.Random(9)
    text = lambda k: "".join(rng.choices("abcdefgh", k=k))
    line, x, y = text(20), text(30), text(30)
    # The same line with x five times and with y seven times; 20 bytes alone do not repeat.
    rows = [(i, x + line + x) for i in range(5)] + [(i, y + line + y) for i in range(5, 12)]
    for max_group in (1, 1024):
        got = groups_of(docs_of(rows), max_group)
        assert {len({o[0] for o in found}) for found in got.values()} == {5, 7}
        assert len({key for key, _, _ in got}) < len(got)


def test_long_texts_in_segments(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    rng = random.Random(7)
    text = lambda k: "".join(rng.choices("abcd", k=k))
    p = text(900)
    rows = [(1, text(1300) + p + text(700)), (2, p[100:800]), (3, text(490) + p + text(20)), (4, text(3000))]
    got = repeats.repeat_digest(docs_of(rows), 40, 9).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 40)


def test_interval_tree_gives_maximal_repeats_with_all_occurrences():
    rng = random.Random(3)
    for _ in range(200):
        anchor = b"##"
        spans = {}
        for _ in range(rng.randint(2, 9)):
            a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))).encode() for _ in range(2))
            spans[a + anchor + b] = len(a)
        spans = list(spans.items())
        if len(spans) < 2:
            continue
        want = {}
        for i, (s, a) in enumerate(spans):
            for left in range(a + 1):
                for right in range(2, len(s) - a + 1):
                    want.setdefault((left, right, s[a - left:a + right]), set()).add(i)
        many = {k: v for k, v in want.items() if len(v) > 1 and k[0] + k[1] >= 4}
        best = {frozenset(v): max((k for k, w in many.items() if w == v), key=lambda k: k[0] + k[1]) for v in many.values()}
        # Maximal: no longer string has the same occurrences on either side.
        wanted = {(k[0], k[1], frozenset(v)) for k, v in many.items()
                  if not any(w == v and x[0] >= k[0] and x[1] >= k[1] and x[:2] != k[:2] for x, w in many.items())}
        got = {(a, b, frozenset(f)) for a, b, f in repeats.maximal_repeats(spans, 4)}
        assert got == wanted and {v for _, _, v in got} == set(best)


def test_texts_and_columns(docs_of):
    p = "é" * 30 + "pq" * 30
    docs = docs_of([(1, "start " + p + " end"), (2, p), (3, "alone"), (4, None)])
    out = {r["doc_id"]: r for r in repeats.remove_repeats(docs, 40, 9).collect()}
    assert docs.columns == list(out[1].asDict())
    assert {k: r["text"] for k, r in out.items()} == {1: "start  end", 2: "", 3: "alone", 4: None}
    assert {k: r["n_chars"] for k, r in out.items()} == {1: 10, 2: 0, 3: -1, 4: -1}
    assert repeats.repeat_digest(docs_of([])).count() == 0
