import random

from roamer.llm import chat


def brute(rows):
    convs = {}
    low = lambda v: (v is not None, v)
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((low(t), low(r), low(x)))
    seqs = {c: tuple((r[1], x[1]) for _, r, x in sorted(v, key=lambda k: tuple((a, b if a else 0) for a, b in k))) for c, v in convs.items()}
    out = []
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()):
            continue
        if any(o == s and low(d) < low(c) for d, o in seqs.items() if d != c and d is not None and c is not None) or (c is not None and seqs.get(None) == s):
            continue
        at = 0
        for i, (r, x) in enumerate(s):
            seg = f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n"
            out.append((c, i, len(s), r, seg, at))
            at += len(seg.encode())
    return sorted(map(str, out))


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, rendered string")


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "b\nc"])) for _ in range(9)] for _ in range(6)]
    rows = []
    for c in range(80):
        b = list(rng.choice(base)[:rng.randint(1, 9)])
        if rng.random() < 0.3:
            b[rng.randrange(len(b))] = ("user", f"own {c}")
        rows += [(c, i, r, x) for i, (r, x) in enumerate(b)]
    rows += [(500, 0, "user", f"t{i}") for i in range(40)] + [(501, i, "user", "same") for i in range(300)] + [(502, i, "user", "same") for i in range(299)]
    rows += [(503, None, "user", "q"), (503, 1, "user", "z"), (503, 1, "user", "z"), (None, 0, "user", "lone"), (504, 0, "user", "lone")]
    rng.shuffle(rows)
    got = sorted(str((r["conv_id"], r["position"], r["n_turns"], r["role"], r["rendered"], r["start"])) for r in chat.format_chats(make(spark, rows).repartition(7)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert chat.format_chats(make(spark, [])).count() == 0
