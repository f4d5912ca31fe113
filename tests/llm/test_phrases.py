import random
import re
from collections import Counter

import numpy as np
import pytest

from roamer.llm import phrases as ph


def brute(rows, support, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = []
    for (lang, p), a in c.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(l == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a for (l, q), b in c.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    seen, ranked = Counter(), []
    for lang, s, a, p, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, l, r, n[lang], -s))
    return ranked


def run(spark, rows, support=6, shards=3, top=40, bits=1 << 17):
    df = spark.createDataFrame([(i, t, l, 1, "z") for i, t, l in rows], "doc_id long, text string, lang string, rank int, phrase string")
    return sorted(tuple(r) for r in ph.mine(df, support, shards, top, bits).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "state", "of", "the", "art", "é́tat", "ÀB", "x", "München", "in", "a", "b2", "日本"]
    fixed = ["new York state of", "state of the art", "in München", "日本 x"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice([i, i, 3, None]), "".join(p + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", "\r\x0b", "!?"]) for p in parts), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("seed,bits", [(1, 1 << 17), (2, 1 << 15)])
def test_against_brute_force(spark, seed, bits):
    rows = corpus(seed, 120) + [(900, None, "en"), (901, "", "fr"), (902, " \t ", "en"), (903, ".,;", None), (904, "one two three four", "fr")]
    rows += [(7, "hot line of words here", "en")] * 60
    want = brute(rows, 6, 40)
    assert len(want) > 20 and {w[0] for w in want} == {"en", "de", "und"}
    assert run(spark, rows, bits=bits) == sorted(want)


@pytest.mark.parametrize("limit", [40, 700])
def test_very_long_text_in_one_row(spark, monkeypatch, limit):
    monkeypatch.setattr(ph, "BATCH_BYTES", limit)
    rows = [(1, " ".join(t for _, t, _ in corpus(5, 60)) + " no piece ends here for long" * 40, "en"), *corpus(6, 40)]
    raw = np.frombuffer(rows[0][1].encode(), np.uint8)
    cuts = [tuple(o) for o, _ in ph.parts_of(raw, np.array([0, len(raw)]), limit)]
    assert len(cuts) > 3 and cuts[0][0] == 0 and cuts[-1][1] == len(raw) and all(a[1] == b[0] and ph._BREAK[raw[a[1] - 1]] for a, b in zip(cuts, cuts[1:]))
    assert run(spark, rows) == sorted(brute(rows, 6, 40))


def test_one_document_holds_all_of_a_phrase(spark):
    rows = [(i, "nothing here repeats much %d" % i, "en") for i in range(30)] + [(99, "rare pair. " * 6, "en")]
    assert ("en", "rare pair") in {(r[0], r[2]) for r in run(spark, rows)}


def test_a_shard_mines_all_that_reaches_its_share(spark):
    df = spark.createDataFrame(corpus(8, 200), "doc_id long, text string, lang string")
    short = ph.shard_frequent(ph.prepared(df, 4).mapInArrow(ph.short_counts(4), ph._schema(4)), 20, 4, True)
    got = {(s, r["hash"]) for r in short.collect() for s in range(4) if r[f"n{s}"] >= 5}
    want = Counter()
    for r in ph.prepared(df, 4).collect():
        b = r["text"].encode()
        w = ph.Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        for n in (1, 2):
            want.update((r["shard"], int(h)) for h in w.phrases(n, ph.lang_hashes([r["lang"]]))[w.together(n)].view(np.int64))
    total = Counter()
    for (_, h), c in want.items():
        total[h] += c
    assert got == {k for k, c in want.items() if c >= 5 and total[k[1]] >= 20}


def test_empty_table(spark):
    assert run(spark, []) == []
