"""Op 2: quality rules whose thresholds come from mergeable quantile sketches per language and source.

Signals are counted over whole texts. Four ratios (in ten-thousandths; mean word length in hundredths)
go into sketches: counts in buckets whose width is 1/32 of their value, so sketches merge by adding
counts and a quantile is right to about 3 %. A (language, source) with few documents borrows its
language's sketch, a small language the whole table's; both are sums of the finer sketches. A
threshold is a fence beyond the middle half of the group: upper quartile plus a multiple of its
distance from the median, never tighter than a stated margin, so that a quarter of bad documents does
not move it, clean documents of any language or source stay, and what lies far outside its own group goes. The thresholds (a row a group) are joined
to the documents, salted by document, and filter them.

Defined results: null text has no words and fails the base rule; null language or source is a group of
its own; repeated rows count each; ties fall on the kept side (a document goes only beyond the
threshold); an empty table gives no rows; other columns pass through ``filter_documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import give_back, cut, register, small_arrow_batches, small_batches, table, utf8_views

MIN_WORDS = 50
REPEAT_PERCENT = 50
MIN_GROUP = 200
FENCE = 3
#: metric -> (least margin above the upper quartile, below the lower one; 0 where there is no lower fence)
MARGINS = {"symbols": (500, 0), "dup_lines": (3500, 0), "repeats": (4000, 0), "word_length": (250, 250)}
SALTS = 16

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if len(number) == n:
        return 0
    pairs = w[:-1] * len(number) + w[1:]
    if len(number) >= 1 << 20:  # three numbers would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + w[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            hit[at + k] = True
    return int(hit.sum())


def text_signals(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80)) - int(np.count_nonzero(_SPACE[raw]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), chars, int(np.count_nonzero(_SYMBOLS[raw])), len(lines), len(lines) - len(set(lines)),
            repeated_words(words))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def document_signals(docs: DataFrame, *keep: str) -> DataFrame:
    """The given columns and the six counts of every row's text."""
    names = [f"__k{i}" for i in range(len(keep))]
    text = names[keep.index("text")] if "text" in keep else "text"  # sent once
    chosen = small_arrow_batches(docs).select(*[(F.col(f"`{k}`").cast("string") if k == "text" else F.col(f"`{k}`")).alias(n) for k, n in zip(keep, names)],
                                              *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for big in batches:
            for batch in small_batches(big, text):
                data, off, _ = utf8_views(batch.column(text))
                got = [text_signals(bytes(data[off[i]:off[i + 1]])) for i in range(batch.num_rows)]
                yield pa.record_batch([batch.column(n) for n in names] + [pa.array(c, pa.int64()) for c in zip(*got)], names=[*names, *_COUNTS])
        give_back()

    ddl = ", ".join([f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names] + [f"{c} long" for c in _COUNTS])
    return chosen.mapInArrow(run, ddl).select(*[F.col(n).alias(k) for n, k in zip(names, keep)], *_COUNTS)


def _ratios() -> dict[str, Column]:
    part = lambda scale, a, b: F.expr(f"{scale} * {a} div greatest({b}, 1)")
    return {"symbols": part(10000, "n_symbols", "word_chars"), "dup_lines": part(10000, "n_dup_lines", "n_lines"),
            "repeats": part(10000, "n_repeat_words", "n_words"), "word_length": part(100, "word_chars", "n_words")}


def _bucket(v: str) -> str:
    """Bucket of a count: itself below 64; above, the power of two and the next five bits."""
    e = f"(length(bin({v})) - 6)"
    return f"CASE WHEN {v} < 64 THEN {v} ELSE 32 * {e} + shiftright({v}, {e}) END"


def _bucket_low(b: str) -> str:
    """The least value of a bucket."""
    e = f"cast(({b} - 32) div 32 as int)"
    return f"CASE WHEN {b} < 64 THEN {b} ELSE shiftleft({b} - 32 * {e}, {e}) END"


def sketches(signals: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch a group and metric."""
    rows = signals.filter(f"n_words >= {MIN_WORDS}").select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("long").alias("v")) for m, v in _ratios().items()])).alias("m"))
    return (rows.select("lang", "source", "m.metric", F.expr(_bucket("m.v")).cast("long").alias("bucket"))
            .groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")))


def _quantiles(sketch: DataFrame, *group: str) -> DataFrame:
    """Documents and quartiles of each merged sketch."""
    merged = sketch.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))
    part = ", ".join([*group, "metric"])
    run = merged.select(*group, "metric", F.expr(_bucket_low("bucket")).alias("low"), "n",
                        F.expr(f"sum(n) over (partition by {part} order by bucket)").alias("upto"),
                        F.expr(f"sum(n) over (partition by {part})").alias("total"))
    at = lambda p: F.min(F.expr(f"CASE WHEN upto * 100 >= total * {p} THEN low END"))
    return run.groupBy(*group, "metric").agg(F.max("total").alias("total"), at(25).alias("p25"), at(50).alias("p50"), at(75).alias("p75"))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """A row a (lang, source): ``max_<metric>`` and, for mean word length, ``min_word_length``."""
    fine = _quantiles(sketch, "lang", "source")
    lang, whole = (_quantiles(sketch, *g).select(*g, "metric", *[F.col(c).alias(f"{c}_{k}") for c in ("total", "p25", "p50", "p75")])
                   for g, k in ((["lang"], "l"), ([], "a")))
    x, y = fine.alias("f"), lang.alias("l")
    joined = x.join(y, F.expr("f.lang <=> l.lang and f.metric = l.metric"), "left").select("f.*", "total_l", "p25_l", "p50_l", "p75_l").join(F.broadcast(whole), "metric", "left")
    pick = lambda c: F.expr(f"CASE WHEN total >= {min_group} THEN {c} WHEN total_l >= {min_group} THEN {c}_l ELSE {c}_a END")
    q = joined.select("lang", "source", "metric", pick("p25").alias("p25"), pick("p50").alias("p50"), pick("p75").alias("p75"))
    bound = []
    for m, (above, below) in MARGINS.items():
        bound.append(F.max(F.expr(f"CASE WHEN metric = '{m}' THEN p75 + greatest({above}, {fence} * (p75 - p50)) END")).alias(f"max_{m}"))
        if below:
            bound.append(F.max(F.expr(f"CASE WHEN metric = '{m}' THEN p25 - greatest({below}, {fence} * (p50 - p25)) END")).alias(f"min_{m}"))
    return q.groupBy("lang", "source").agg(*bound)


def judge(signals: DataFrame, bounds: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add base_failed and kept. The small side is repeated for every salt, so that a source with a
    third of the rows is dealt over ``salts`` partitions."""
    base = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    rows = signals.withColumns({"base_failed": base, "__salt": F.pmod(F.xxhash64(*_COUNTS), F.lit(salts)), **{f"__{m}": v for m, v in _ratios().items()}})
    sides = bounds.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("__salt").cast("long").alias("__s"),
        *[c for c in bounds.columns if c not in ("lang", "source")])
    match = (F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__s")))
    good = F.lit(True)
    for c in bounds.columns[2:]:
        m = c[4:]
        good &= F.coalesce(F.col(f"__{m}") <= F.col(c) if c.startswith("max_") else F.col(f"__{m}") >= F.col(c), F.lit(True))
    judged = rows.join(sides, match, "left").withColumn("kept", ~F.col("base_failed") & good)
    return judged.drop("__lang", "__source", "__salt", "__s", *[f"__{m}" for m in MARGINS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Signals, thresholds and verdict of every document."""
    signals = cut(document_signals(docs, "doc_id", "lang", "source"))
    return judge(signals, thresholds(sketches(signals)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    The thresholds come from one pass over the texts, the verdicts from a second beside the
    documents' own columns, so that neither texts nor ids are joined.
    """
    bounds = cut(thresholds(sketches(document_signals(docs, "lang", "source"))))
    # Under names of their own, the documents' columns cannot clash with counts; text, lang and source keep theirs.
    own = [c if c in ("text", "lang", "source") else f"__own{i}" for i, c in enumerate(docs.columns)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)])
    judged = judge(document_signals(renamed, *own), bounds).filter("kept")
    return judged.select(*[F.col(o).cast(docs.schema[c].dataType).alias(c) for c, o in zip(docs.columns, own)])


def _sql() -> str:
    """The same rules as DuckDB SQL: counts by lists, sketches and fences by grouping."""
    e = "(len(bin(v)) - 6)"
    low_e = "((bucket - 32) // 32)"
    metrics = {"symbols": "10000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "10000 * n_dup_lines // greatest(n_lines, 1)",
               "repeats": "10000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)"}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, cast({x} AS BIGINT) AS v FROM signals WHERE n_words >= {MIN_WORDS}" for m, x in metrics.items())

    def quantiles(*group: str) -> str:
        part = ", ".join([*group, "metric"])
        at = ", ".join(f"min(CASE WHEN upto * 100 >= total * {p} THEN low END) AS p{p}" for p in (25, 50, 75))
        return f"""SELECT {part}, max(total) AS total, {at} FROM (
            SELECT {part}, CASE WHEN bucket < 64 THEN bucket ELSE (bucket - 32 * {low_e}) << {low_e} END AS low,
                   sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS total
            FROM (SELECT {part}, bucket, sum(n) AS n FROM sketch GROUP BY {part}, bucket)) GROUP BY {part}"""

    bounds, tests = [], []
    for m, (above, below) in MARGINS.items():
        bounds.append(f"max(CASE WHEN metric = '{m}' THEN p75 + greatest({above}, {FENCE} * (p75 - p50)) END) AS max_{m}")
        tests.append(f"coalesce({metrics[m]} <= max_{m}, true)")
        if below:
            bounds.append(f"max(CASE WHEN metric = '{m}' THEN p25 - greatest({below}, {FENCE} * (p50 - p25)) END) AS min_{m}")
            tests.append(f"coalesce({metrics[m]} >= min_{m}, true)")
    pick = lambda c: f"CASE WHEN f.total >= {MIN_GROUP} THEN f.{c} WHEN l.total >= {MIN_GROUP} THEN l.{c} ELSE a.{c} END AS {c}"
    space = r"[\x20\x09-\x0D]"
    return rf"""
    WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    parts AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
    windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
    signals AS (SELECT p.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
                       length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
                       len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
                FROM parts p LEFT JOIN repeated r USING (doc_id)),
    sketch AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE 32 * {e} + (v >> {e}) END AS bucket, count(*) AS n
               FROM ({rows}) GROUP BY ALL),
    q AS (SELECT f.lang, f.source, f.metric, {pick("p25")}, {pick("p50")}, {pick("p75")}
          FROM ({quantiles("lang", "source")}) f LEFT JOIN ({quantiles("lang")}) l ON f.lang IS NOT DISTINCT FROM l.lang AND f.metric = l.metric
          LEFT JOIN ({quantiles()}) a ON f.metric = a.metric),
    bounds AS (SELECT lang, source, {", ".join(bounds)} FROM q GROUP BY lang, source)
    SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
           NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND {" AND ".join(tests)} AS kept,
           s.lang, s.source, n_lines, max_symbols, max_dup_lines, max_repeats, max_word_length, min_word_length
    FROM signals s LEFT JOIN bounds b ON s.lang IS NOT DISTINCT FROM b.lang AND s.source IS NOT DISTINCT FROM b.source"""


@register("op2_quality_rules", _sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "lang", "source", "n_lines", "max_symbols", "max_dup_lines", "max_repeats", "max_word_length", "min_word_length")
