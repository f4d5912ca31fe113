"""Op 12: phrase collocations by SON partitioning.

Documents are dealt evenly to ``SHARDS`` shards by a hash of their id. A phrase with a global count of ``SUPPORT``
has at least SUPPORT / SHARDS in one of them, so every shard is mined completely at that lowered support:

1. Words and word pairs are counted by shard; those that reach the lowered support are the shard's frequent ones.
2. Phrases of three and four words all of whose pairs are frequent in their shard (a shorter phrase is found
   wherever a longer one is) are counted by shard in the same way.
3. The union of all shards' frequent phrases are the candidates, but for those that the shards' counts rule out: a
   shard that did not count a phrase has fewer of it than the lowered support, so the counts and that bound for the
   other shards must reach the global support. One more pass counts every candidate in all documents, as text;
   phrases below the global support go.

Texts are cut into words with numpy, some MB at a time; steps 1 and 2 count 56-bit hashes of (language, words), a column a
shard, added up by Spark's groupBy with its own combining and spilling. Two phrases with one hash only make a shard's
count too large, so a candidate may be false but none is lost; the last pass counts text. Sets of hashes travel as bit
sets of fixed size (``FILTER_BITS``): what they let through wrongly is counted for nothing and then dropped, by the shard's
support or the global one. Scores, the inside-a-longer-phrase rule and the ranks are joins and windows over the
frequent phrases.

Defined results: a null text is empty; a null language is ``und``; blank texts and pieces have no words; repeated rows
and documents with one id count each; a null id is dealt like any other; languages without candidates give no rows;
an empty table gives no rows; ties go by count, then by the phrase's bytes; a very long text is counted part by part, cut
where a piece ends; other columns are ignored. Within one batch of about ``BATCH_BYTES``, phrases with equal hashes (56 bits) count
as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roamer.llm.common import cut, give_back, register, shared_folder, slices, small_arrow_batches, table, utf8_views
from roamer.llm.shingles import _LOWER, mix64, prefix_hash, span_hash

SUPPORT = 30
LONGEST = 4
SHARDS = 4
TOP = 2000
#: Of a candidate's count, what a longer one must have to drop it: 80 / 100.
INSIDE = (80, 100)
#: The lowest bits of a hash give way to the shard's number while counting (so there are 256 shards at most).
_UNUSED = 8
_LOW = np.uint64((1 << _UNUSED) - 1)
SCORE = 2_000_000
FILTER_BITS = 1 << 27
BATCH_BYTES = 4 << 20
NO_LANG = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32
_TURN = mix64(np.arange(2001, 2001 + LONGEST, dtype=np.uint64)) | np.uint64(1)


class Words:
    """Words of some texts: bytes (lower-cased), starts and stops, 64-bit hashes, the piece and the text each lies in."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = raw[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        word = ~_GAP[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], word[:-1]]) & ~edge[:-1] if len(raw) else word
        after = np.concatenate([word[1:], [False]]) & ~edge[1:] if len(raw) else word
        self.raw = raw
        self.start, self.stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.hash = span_hash(prefix_hash(raw, _LOWER), self.start, self.stop) if len(raw) else np.empty(0, np.uint64)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        breaks = np.cumsum(_BREAK[raw], dtype=np.int32) if len(raw) else np.empty(0, np.int32)
        self.piece = breaks[self.start] + self.text

    def together(self, n: int) -> np.ndarray:
        """Whether each word and the n - 1 behind it lie in one piece."""
        return self.piece[n - 1:] == self.piece[:len(self.piece) - n + 1] if len(self.piece) >= n else np.empty(0, bool)

    def phrases(self, n: int, lang: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the n words from each word (or each of ``at``) on; ``lang``: a hash for each text."""
        m = max(0, len(self.hash) - n + 1)
        total = lang[self.text[:m] if at is None else self.text[at]] + np.uint64(n)
        for i in range(n):
            total += (self.hash[i:i + m] if at is None else self.hash[at + i]) * _TURN[i]
        return mix64(total) & ~_LOW

    def spelled(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each of ``at`` on, joined by spaces."""
        first, last = self.start[at[:, None] + np.arange(n)], self.stop[at[:, None] + np.arange(n)]
        size = last - first
        offsets = np.concatenate([[0], np.cumsum(size.sum(axis=1) + n - 1)])
        to = offsets[:-1, None] + np.cumsum(size + 1, axis=1) - size - 1
        size, out = size.ravel(), np.full(offsets[-1], 0x20, np.uint8)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to.ravel(), size) + within] = _LOWER_BYTES[self.raw[np.repeat(first.ravel(), size) + within]]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def lang_hashes(langs: list[str]) -> np.ndarray:
    """A 64-bit hash for each language name."""
    raw = "".join(langs).encode()
    offsets = np.concatenate([[0], np.cumsum([len(s.encode()) for s in langs])]).astype(np.int64)
    if not raw:
        return np.zeros(len(langs), np.uint64)
    return span_hash(prefix_hash(np.frombuffer(raw, np.uint8)), offsets[:-1], offsets[1:]) * np.uint64(0x9E3779B97F4A7C15)


def sharded(hashes: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
    """Hashes that tell shards apart as well."""
    return mix64(hashes + (np.asarray(shard).astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(_UNUSED) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def parts_of(raw: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(offsets of some texts, their numbers) of ``limit`` bytes or less; a longer text comes in parts that
    end with a piece, so only a piece beyond the limit makes a part longer."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        if j > i:
            yield offsets[i:j + 1], np.arange(i, j)
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            to = min(at + limit, end)
            if to < end:
                breaks = np.flatnonzero(_BREAK[raw[at:to]])
                while not len(breaks) and to < end:
                    breaks = np.flatnonzero(_BREAK[raw[to:to + limit]])[:1] + (to - at)
                    to = min(to + limit, end)
                if len(breaks):
                    to = at + int(breaks[-1]) + 1
            yield np.array([at, to]), np.array([i])
            at = to
        i += 1


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """(words, language and shard of each text) of about ``BATCH_BYTES`` of text at once."""

    def cut_up(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held)
        raw, offsets, _ = utf8_views(whole.column("text"))
        raw, langs, shard = np.frombuffer(raw, np.uint8), whole.column("lang").to_pylist(), whole.column("shard").to_numpy()
        for some, numbers in parts_of(raw, offsets, BATCH_BYTES):
            yield Words(raw, some), [langs[i] for i in numbers], shard[numbers]

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield from cut_up(held)
            held, size = [], 0
            give_back()
    if held:
        yield from cut_up(held)
    give_back()


def prepared(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return small_arrow_batches(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                                            F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))


def _columns(shards: int) -> list[str]:
    return [f"n{s}" for s in range(shards)]


def _schema(shards: int) -> str:
    return "hash long, " + ", ".join(f"{c} long" for c in _columns(shards))


def _counted(found: list[tuple[np.ndarray, np.ndarray]], shards: int) -> pa.RecordBatch:
    """(hash, a count for each shard) of hashes and the shards of their texts."""
    both = np.concatenate([h | s.astype(np.uint64) for s, h in found])
    both, times = np.unique(both, return_counts=True)
    hashes, shard = both & ~_LOW, (both & _LOW).astype(np.int64)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    counts = np.zeros((shards, int(new.sum())), np.int64)
    counts[shard, np.cumsum(new) - 1] = times
    return pa.record_batch([pa.array(hashes[new].view(np.int64)), *(pa.array(c) for c in counts)], names=["hash", *_columns(shards)])


def short_counts(shards: int) -> Callable:
    """Words and pairs of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, shard in batches_of(batches):
            lang = lang_hashes(langs)
            found = []
            for n in (1, 2):
                ok = words.together(n)
                found.append((shard[words.text[:len(ok)][ok]], words.phrases(n, lang)[ok]))
            yield from slices(_counted(found, shards))

    return count


def long_counts(bits, shards: int) -> Callable:
    """Phrases of three words and more all of whose pairs are frequent in their shard; ``bits``: a broadcast set of these pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(bits.value, np.uint8)
        for words, langs, shard in batches_of(batches):
            lang = lang_hashes(langs)
            ok = words.together(2)
            pair = ok.copy()
            pair[ok] = in_bits(pairs, sharded(words.phrases(2, lang)[ok], shard[words.text[:len(ok)][ok]]))
            found, run = [], pair
            for n in range(3, LONGEST + 1):
                run = run[:-1] & pair[n - 2:] if len(run) else run
                at = np.flatnonzero(run)
                found.append((shard[words.text[at]], words.phrases(n, lang, at)))
            yield from slices(_counted(found, shards))

    return count


def exact_counts(bits) -> Callable:
    """(lang, phrase, words, n) of phrases that may be candidates; of no words: all words of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits.value, np.uint8)
        for words, langs, _ in batches_of(batches):
            lang = lang_hashes(langs)
            names = pa.array(langs, pa.string())
            totals = pa.table([names, pa.array(np.bincount(words.text, minlength=len(langs)))], names=["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
            out = [(totals.column("lang").combine_chunks(), pa.array([""] * totals.num_rows), 0, totals.column("n_sum").combine_chunks())]
            for n in range(1, LONGEST + 1):
                ok = words.together(n)
                h = words.phrases(n, lang)
                at = np.flatnonzero(ok)
                at = at[in_bits(wanted, h[at])]
                _, first, times = np.unique(h[at], return_index=True, return_counts=True)
                at = at[first]
                out.append((names.take(pa.array(words.text[at])), words.spelled(at, n), n, pa.array(times.astype(np.int64))))
            for l, p, n, c in out:
                if len(p):
                    yield from slices(pa.record_batch([l, p, pa.array(np.full(len(p), n, np.int32)), c.cast(pa.int64())], names=["lang", "phrase", "words", "n"]))

    return count


def bit_set(hashes: DataFrame, column, bits: int):
    """A broadcast bit set (``bits`` / 8 bytes, whatever the rows) of 64-bit integers."""
    spot = hashes.select((F.shiftrightunsigned(column, _UNUSED).bitwiseAND(F.lit(bits - 1)) + 1).alias("p"))  # Spark numbers bits from 1, in buckets from 1
    rows = spot.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(bits // 8)
    for r in rows.toLocalIterator():
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = r["bits"]
    return hashes.sparkSession.sparkContext.broadcast(bytes(out))


def shard_frequent(counted: DataFrame, support: int, shards: int, complete: bool) -> DataFrame:
    """(hash, n0, n1, ...) of what reaches its share of the support in a shard, and may reach the support in all.

    ``complete``: every shard counted everything, else a shard without a count may have missed less than its share."""
    names = _columns(shards)
    total = counted.groupBy("hash").agg(*[F.sum(c).alias(c) for c in names])
    missed = 0 if complete else -(-support // shards) - 1
    most = sum(F.when(F.col(c) > 0, F.col(c)).otherwise(missed) for c in names)
    return total.filter((F.greatest(*names) * shards >= support) & (most >= support))


def _sharded_bits(spark: SparkSession, frequent: DataFrame, support: int, shards: int, bits: int):
    """Bit set of ``sharded`` hashes of what is frequent in each shard."""

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("hash").to_numpy().view(np.uint64)
            for s, c in enumerate(_columns(shards)):
                mine = sharded(h[b.column(c).to_numpy() * shards >= support], s)
                yield pa.record_batch([pa.array(mine.view(np.int64))], names=["hash"])

    return bit_set(frequent.mapInArrow(mix, "hash long"), F.col("hash"), bits)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of up to four words with f >= support, (lang, n))."""
    spark, texts, counts = docs.sparkSession, prepared(docs, shards), _schema(shards)
    short = cut(shard_frequent(texts.mapInArrow(short_counts(shards), counts), support, shards, True))
    pairs = _sharded_bits(spark, short, support, shards, bits)
    long = cut(shard_frequent(texts.mapInArrow(long_counts(pairs, shards), counts), support, shards, False))
    union = bit_set(short.select("hash").union(long.select("hash")), F.col("hash"), bits)
    counted = texts.mapInArrow(exact_counts(union), "lang string, phrase string, words int, n long")
    path = shared_folder(spark, "phrases")
    total = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).filter((F.col("f") >= support) | (F.col("words") == 0))
    total.write.parquet(path)
    pairs.unpersist()
    union.unpersist()
    known = spark.read.schema("lang string, phrase string, words int, f long").parquet(path)
    return known.filter("words > 0"), known.filter("words = 0").select("lang", F.col("f").alias("n"))


def collocations(frequent: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top`` candidates."""
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    known = frequent.select("lang", F.col("phrase").alias("part"), F.col("f"))
    candidates = frequent.filter("words >= 2").withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("lr", wide("l") + wide("r")).withColumn("up", (F.lit(SCORE).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("up div lr"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    # Of every longer candidate, the shorter ones (two words and more) that lie inside it.
    inner = candidates.filter("words >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inner = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * INSIDE[1] < F.col("a").cast("decimal(38,0)") * INSIDE[0]))
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def mine(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    return collocations(*frequent_phrases(docs, support, shards, bits), top)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, p, k, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, p, k, f AS a FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.p, c.a, t.i, l.f AS l, r.f AS r, cast(({SCORE}::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM c JOIN range(1, {LONGEST}) t(i) ON t.i < c.k JOIN f l ON l.lang = c.lang AND l.p = c.p[:t.i] JOIN f r ON r.lang = c.lang AND r.p = c.p[t.i + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, i) = 1),
longer AS (SELECT lang, s, max(a) AS m FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: p[i:i + m - 1])))) AS s FROM c WHERE k >= 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.s = best.p WHERE longer.m IS NULL OR {INSIDE[1]} * longer.m < {INSIDE[0]} * best.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= {TOP}"""


@register("op12_phrase_collocations", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))
