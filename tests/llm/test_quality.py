import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from roamer.llm import quality


def brute(t):
    t = t or ""
    words = re.findall("[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)),
            len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)}))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t#|>\x1c\x0b\xa0", max_size=60))
def test_signals(t):
    assert quality.text_signals(t.encode()) == brute(t)


def test_buckets_are_monotone_and_tight(spark):
    rows = spark.range(0, 70000, 1).selectExpr(f"id as v", f"{quality._bucket('id')} as bucket").selectExpr("v", "bucket", f"{quality._bucket_low('bucket')} as low").collect()
    rows.sort()
    assert all(a["bucket"] <= b["bucket"] for a, b in zip(rows, rows[1:]))
    assert all(r["low"] <= r["v"] <= r["low"] * 33 // 32 + 1 for r in rows)


def test_verdicts_null_groups_and_columns(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    clean = [(i, " ".join(word() for _ in range(80)), rng.choice(["en", None]), f"s{i % 3}") for i in range(900)]
    bad = [(1000, "a", "en", "s0"), (1001, None, "en", "s0"), (1002, "", None, None), (1003, "x y z " * 40, "en", "s1"),
           (1004, " ".join(word() + "###" for _ in range(80)), "en", "s1"), (1005, " ".join(word() * 9 for _ in range(90)), None, "s2"),
           (1005, " ".join(word() * 9 for _ in range(90)), None, "s2")]
    docs = spark.createDataFrame([(*r, 0, 7, True) for r in clean + bad],
                                 "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean")
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(clean) + len(bad)
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(1000, 1006))
    assert {r["doc_id"] for r in got if r["base_failed"]} == {1000, 1001, 1002, 1003}
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(*r, 0, 7, True) for r in clean], key=str)
    assert quality.quality_rules(docs.limit(0)).count() == 0
