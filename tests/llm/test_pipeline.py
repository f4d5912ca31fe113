"""The pipeline, stage by stage, against brute force over the whole sf0.001 documents."""

import numpy as np

import corpus_pipeline
from roamer.llm import jaccard, queries
from roamer.llm.tokens import encoder, tokenizer_path
from tests.conftest import SF
from tests.llm import test_jaccard


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    places = {}
    for d, t in enumerate(raw):
        for s in range(len(t) - length + 1):
            places.setdefault(t[s:s + length], []).append((d, s))
    gone = [bytearray(len(t)) for t in raw]
    for where in places.values():
        if len(where) > 1:
            for d, s in where:
                gone[d][s:s + length] = b"\1" * length
    out = []
    for t, g in zip(raw, gone):
        parts, run = [], bytearray()
        for b, x in zip(t, g):
            if x:
                parts.append(bytes(run))
                run = bytearray()
            else:
                run.append(b)
        out.append("".join(p.decode(errors="ignore") for p in [*parts, bytes(run)]))
    return out


def test_stages(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], SF).write.parquet(str(tmp_path / name))
        held.append(spark.read.parquet(str(tmp_path / name)))
    for df in held[:-1]:
        assert df.columns == docs.columns
    first, clean, single, cut, packed = (df.toPandas() for df in held)

    sql = queries.oracle_sql()["op2_quality_rules"]
    assert sorted(clean["doc_id"]) == sorted(duck.execute(f"SELECT doc_id FROM ({sql}) WHERE kept").df()["doc_id"])
    assert clean.set_index("doc_id")["text"].to_dict() == {k: v for k, v in first.set_index("doc_id")["text"].items() if k in set(clean["doc_id"])}

    rows = [(int(i), t) for i, t in zip(clean["doc_id"], clean["text"])]
    parts = [eval(x) for x in test_jaccard.brute(rows)]
    assert sorted(single["doc_id"]) == sorted(i for i, n, c in parts if i == c)

    want = dict(zip(single["doc_id"], brute_repeats(single["text"], 400)))
    assert dict(zip(cut["doc_id"], cut["text"])) == want
    same = dict(zip(single["doc_id"], single["text"]))
    assert all(n == (len(t) if t != same[i] else first.set_index("doc_id")["n_chars"][i]) for i, t, n in zip(cut["doc_id"], cut["text"], cut["n_chars"]))

    lib = encoder(tokenizer_path()).lib
    sizes = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == sizes
    fill = packed.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 4096 and len(fill) <= -(-sum(sizes.values()) // 4096) + 1
    assert (packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"].cumsum()
            - packed.sort_values(["sequence_id", "offset"])["length"] == packed.sort_values(["sequence_id", "offset"])["offset"]).all()


def test_keep_one(docs_of):
    a = " ".join(f"w{i}" for i in range(80))
    rows = [(5, a), (3, a), (3, a), (None, a), (9, a + " tail"), (3, "another text under the id"), (7, ""), (8, None), (None, "lone words here")]
    docs = docs_of(rows).repartition(3)
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(map(str, [(3, a), (3, "another text under the id"), (7, ""), (8, None), (None, "lone words here")]))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and (out["length"] <= 4096).all() and np.isin(["doc_id", "piece", "sequence_id", "offset"], out.columns).all()
