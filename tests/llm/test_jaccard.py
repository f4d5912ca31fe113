import random
import re

import numpy as np

from roamer.llm import jaccard
from roamer.llm.shingles import shingle_sets


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            r = find(a)
            least[r] = min(i, least.get(r, i))
    return sorted(map(str, [(i, len(sets[a]), least.get(find(a))) for a, (i, _) in enumerate(rows)]))


def corpus(seed, n=260, vocab=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(vocab)]
    line = " ".join(rng.choices(words, k=25))
    base = [rng.choices(words, k=rng.randint(1, 120)) for _ in range(n // 5)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "a b c d e"), (None, "a b c d"), (9, "a\x1cb")]
    for i in range(10, n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            at = rng.randrange(len(t) + 1)
            t[at:at + rng.choice([0, 1])] = [rng.choice(words)] if rng.random() < 0.7 else []
        s = " ".join(t)
        rows.append((i, s.upper() if rng.random() < 0.1 else s + "\n" + line if rng.random() < 0.3 else s))
    return rows + [rows[20], rows[20], (21, "different text under a used id"), (None, rows[30][1])]


def got(docs):
    return sorted(map(str, [tuple(r) for r in jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()]))


def test_against_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL_HITS", 2)
    rows = corpus(1)
    assert got(docs_of(rows).repartition(3)) == brute(rows)


def test_chains_of_near_copies(docs_of, monkeypatch):
    """A path of ever changing copies: its ends are unlike, but all are one component."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 8)
    rng = random.Random(4)
    t, rows = [f"w{k}" for k in range(150)], []
    for i in range(120):
        rows.append((1000 - i, " ".join(t)))
        t = list(t)
        t[rng.randrange(150)] = f"n{i}"
        t[rng.randrange(150)] = f"m{i}"
    assert got(docs_of(rows)) == brute(rows)


def test_empty_tables(docs_of):
    assert jaccard.jaccard_components(docs_of([])).count() == 0
    assert got(docs_of([(1, None), (2, "")])) == brute([(1, None), (2, "")])


def test_derived_answers_equal_direct_ones():
    rng = np.random.default_rng(0)
    x = rng.choice(10**6, 300, replace=False)
    sets = [np.unique(x.astype(np.uint64))]
    for i in range(60):
        keep = rng.random(300) > rng.choice([.05, .1, .15])
        sets.append(np.unique(np.concatenate([x[keep], rng.choice(10**6, rng.integers(1, 40))]).astype(np.uint64)))
    names = [b"%016d" % i for i in range(len(sets))]
    root = {k: k for k in names}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in jaccard._answers(names[0], names, sets):
        root[find(a)] = find(b)
    have = {frozenset(k for k in names if find(k) == find(j)) for j in names}
    root = {k: k for k in names}
    for i, s in enumerate(sets):
        for j in range(i):
            if 9 * len(np.intersect1d(s, sets[j])) >= 4 * (len(s) + len(sets[j])):
                root[find(names[i])] = find(names[j])
    assert have == {frozenset(k for k in names if find(k) == find(j)) for j in names}


def test_blocks_skip_nothing_that_could_link(monkeypatch):
    rng = np.random.default_rng(2)
    for block in (1, 3, 64):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        n = rng.integers(5, 60, 80)
        p = np.sort(rng.integers(0, 5, 80))
        ok = jaccard._could_link(n[:, None], p[:, None], n[None], p[None])
        np.fill_diagonal(ok, False)
        assert (jaccard._alive(n, p) == ok.any(1)).all()


def test_shingles_ignore_spacing_and_neighbours():
    texts = ["A b\tC d  e\nf", "a B c D E f", "", "x y", "x y z"]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    s = shingle_sets(np.frombuffer(raw, np.uint8), off)
    assert s[0].tolist() == s[1].tolist() and [len(x) for x in s] == [2, 2, 0, 1, 1] and s[3] != s[4]


def test_lists_of_rare_tokens_stay_short(docs_of, monkeypatch):
    """A passage in many documents, of which each task has only a few: its tokens must not be taken for rare."""
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(40)]
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(100)] + passage)) for i in range(80)]
    found, index = [], jaccard._index
    monkeypatch.setattr(jaccard, "_index", lambda packed: found.append(index(packed)) or found[0])
    assert got(docs_of(rows).repartition(20)) == brute(rows)
    longest = found[0].filter("bucket >= 0").groupBy("token").count().agg({"count": "max"}).first()[0]
    assert (longest or 0) < jaccard.LOCAL_HITS


def test_more_frequent_tokens_than_the_list_holds(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL_HITS", 2)
    rows = corpus(3)
    docs = jaccard.marked(docs_of(rows))
    whole, counts, _ = jaccard._frequent(docs, 1000)
    for room in (len(whole) // 2, 1):
        monkeypatch.setattr(jaccard, "MAX_FREQUENT", room)
        codes, hits, _ = jaccard._frequent(docs, 1000)
        assert len(codes) <= room and set(codes) <= set(whole) and min(hits, default=counts.max()) >= np.sort(counts)[-room]
    assert got(docs_of(rows)) == brute(rows)
