import zlib

import numpy as np

from roamer.llm import tokenfiles
from roamer.llm.tokens import encoder, tokenizer_path


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(-2**62, 2**62, n))
        mph = tokenfiles.PerfectHash.build(keys)
        assert sorted(mph.slots(keys)) == list(range(len(keys))) and len(mph) == len(keys)


def test_round_trip_and_lookup(spark, docs_of, tmp_path):
    rows = [(i, f"word{i} " * (i % 40)) for i in range(0, 400, 3)] + [(9, None), (9, "word9 " * 9), (9, ""), (None, "a b"), (None, None), (10**12, "é" * 9000)]
    m = tokenfiles.cut(tokenfiles.write_token_shards(docs_of(rows).repartition(4), str(tmp_path / "x"), tokenizer_path(), shard_size=2000))
    got = sorted((tuple(r) for r in tokenfiles.read_documents(m).collect()), key=lambda r: r[1])
    e = encoder(tokenizer_path())
    ids = [(i, np.append(e.lib.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4")) for i, t in rows]
    assert sorted(map(str, [(i, len(x), zlib.crc32(x.tobytes())) for i, x in ids])) == sorted(map(str, [(r[0], r[2], r[3]) for r in got]))
    assert [r[0] for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    starts = np.cumsum([0] + [r[2] for r in got])
    assert [r[1] for r in got] == starts[:-1].tolist()
    assert m.count() > 3
    asked = spark.createDataFrame([(9,), (27,), (28,), (None,), (10**12,), (9,)], "k long")
    found = {}
    for r in tokenfiles.lookup(m, asked, "k").collect():
        found.setdefault(r[0], []).append(r[1])
    assert {k: len(v) for k, v in found.items()} == {9: 4, 27: 1, 10**12: 1}
    assert found[27][0] == next(x.tolist() for i, x in ids if i == 27)


def test_empty_table(docs_of, tmp_path):
    m = tokenfiles.write_token_shards(docs_of([]), str(tmp_path / "x"), tokenizer_path())
    assert m.count() == 0 and tokenfiles.read_documents(m).count() == 0
