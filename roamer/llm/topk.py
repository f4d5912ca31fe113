"""Op 3: exact top-k inner products through a bit-sliced index.

Vectors are stored in blocks. A block holds, for every dimension, the components less their least
value, cut to a few leading bits, as bit slices: bitmap s of a dimension has bit r set where row r has
bit s set. A query is cut to a few leading bits too; for a negative weight the slices are inverted, so
that all terms are sums. The terms are added for all rows and all queries of a block pair at once with
carry-save adders: and, or, exclusive or of whole bitmaps. The result is a sliced sum; the top rows
are selected from its most significant slice downward. What was cut off bounds the error of a sum, so
every row whose sum reaches the k-th one less the bound (a comparison of bitmaps with a constant) is
resolved exactly with the full integers, ties going to the smaller id.

Query blocks meet index blocks by a join on block numbers; a pair of blocks is one task's work, its
result k rows a query, and one ranked window merges them. The queries are a stated set (ids divisible
by 100), never a sample.

Block pairs whose sums of products could leave 64 bits are bounded in floating point instead, and what
may be among the best is scored with Python's integers.

Defined results: components are floor(1024 * x) of x as a double; null vectors and vectors with null
or non-finite components take no part, nor do rows without an id or with a component that is no 64-bit
integer; a score among the k best that is none raises an error; only vectors of a query's own
length answer it; a query's own row is no answer, other rows with its id neither; repeated rows answer
each; fewer than k candidates give all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, register, table

SCALE = 1024
TOP = 10
QUERY_STEP = 100
BLOCK_ROWS = 8192
BLOCK_QUERIES = 64
SLICES = 7
#: Leading bits of the query's weights; what is cut off here widens the bound by the largest component.
WEIGHT_BITS = 10
FULL = np.uint64(2**64 - 1)


def leading(values: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Non-negative integers without their lowest bits, so that ``bits`` are left; how many went."""
    shift = max(0, int(values.max(initial=0)).bit_length() - bits)
    return values >> shift, shift


def bitmaps(rows: np.ndarray, bits: int) -> np.ndarray:
    """(dimension, slice, word) bitmaps of an integer matrix (row, dimension)."""
    n, d = rows.shape
    words = -(-n // 64)
    out = np.zeros((d, bits, words), "<u8")
    for s in range(bits):
        flags = np.zeros((d, words * 64), bool)
        flags[:, :n] = ((rows >> s) & 1).T
        out[:, s] = np.packbits(flags, axis=1, bitorder="little").view("<u8")
    return out


class Adder:
    """Sums of bitmaps by weight. Three bitmaps of one weight become one of it and a carry."""

    def __init__(self):
        self.waiting: dict[int, list[np.ndarray]] = {}

    def add(self, weight: int, bitmap: np.ndarray) -> None:
        held = self.waiting.setdefault(weight, [])
        held.append(bitmap)
        if len(held) == 3:
            a, b, c = held
            half = a ^ b
            self.waiting[weight] = [half ^ c]
            self.add(weight + 1, (a & b) | (half & c))

    def slices(self, shape: tuple) -> list[np.ndarray]:
        """The sum, least significant slice first."""
        w, out = 0, []
        while any(k >= w and v for k, v in self.waiting.items()):
            held = self.waiting.get(w, [])
            if len(held) == 2:
                a, b = held
                self.waiting[w] = [a ^ b]
                self.add(w + 1, a & b)
            out.append(self.waiting[w][0] if self.waiting.get(w) else np.zeros(shape, np.uint64))
            w += 1
        return out


def sliced_sums(index: np.ndarray, weights: np.ndarray, negative: np.ndarray) -> list[np.ndarray]:
    """Slices, (query, word) each, of sum over dimensions of weight * component (inverted where the
    weight is negative)."""
    d, bits, words = index.shape
    adder, shape = Adder(), (len(weights), words)
    turn = np.where(negative, FULL, np.uint64(0))
    for j in range(d):
        w = weights[:, j]
        for b in range(int(w.max(initial=0)).bit_length()):
            mask = np.where((w >> b) & 1 == 1, FULL, np.uint64(0))[:, None]
            for s in range(bits):
                adder.add(b + s, (index[j, s][None, :] ^ turn[:, j][:, None]) & mask)
    return adder.slices(shape)


def _count(bitmap: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)


def kth_sum(slices: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest sum of each query among ``rows`` (bitmaps), most significant slice downward."""
    sure, maybe = np.zeros_like(rows), rows.copy()
    out = np.zeros(len(rows), np.int64)
    for w in range(len(slices) - 1, -1, -1):
        high = maybe & slices[w]
        enough = (_count(sure) + _count(high) >= k)[:, None]
        # Enough rows have the bit: the k-th is among them. Else they are all in, and the rest goes on.
        sure = np.where(enough, sure, sure | high)
        maybe = np.where(enough, high, maybe & ~slices[w])
        out += enough[:, 0].astype(np.int64) << w
    return out


def at_least(slices: list[np.ndarray], rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose sum is ``bound`` or more, for each query."""
    greater, equal = np.zeros_like(rows), rows.copy()
    over = bound >> len(slices) > 0
    for w in range(len(slices) - 1, -1, -1):
        bit = ((bound >> w) & 1 == 1)[:, None]
        greater = np.where(bit, greater, greater | (equal & slices[w]))
        equal = np.where(bit, equal & slices[w], equal & ~slices[w])
    out = greater | equal
    out[over] = 0
    return out


def fits(rows: np.ndarray, queries: np.ndarray) -> bool:
    """Whether scores, and the bounds of what is cut off them, stay in 64 bits."""
    most = lambda a: max(1, int(a.max(initial=0)), -int(a.min(initial=0)))
    return 4 * most(rows) * most(queries) * rows.shape[1] < 1 << 63


def search_large(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """``search_block`` for components whose products may leave 64 bits; scores are Python's integers."""
    d = rows.shape[1]
    x, y = rows.astype(np.float64), queries.astype(np.float64)
    about, error = y @ x.T, (np.abs(y) @ np.abs(x).T) * ((d + 4) * 2.0 ** -52)
    out = []
    for i, asked in enumerate(queries.tolist()):
        others = np.flatnonzero(ids != query_ids[i])
        least = (about[i] - error[i])[others]
        if len(others) > k:
            others = others[(about[i] + error[i])[others] >= np.partition(least, len(least) - k)[len(least) - k]]
        scored = [(sum(a * b for a, b in zip(asked, rows[r].tolist())), r) for r in others.tolist()]
        out += [(i, r, s) for s, r in sorted(scored, key=lambda t: (-t[0], ids[t[1]]))[:k]]
    return tuple(map(list, zip(*out))) if out else ([], [], [])


def search_block(ids: np.ndarray, rows: np.ndarray, index: np.ndarray, shift: int, low: np.ndarray,
                 query_ids: np.ndarray, queries: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of what may be among each query's k best of the block."""
    n, d = rows.shape
    words = index.shape[2]
    weights, cut_off = leading(np.abs(queries), WEIGHT_BITS)
    negative = queries < 0
    # x = low + 2**shift * u + r with 0 <= r < 2**shift, |q| = 2**cut * w + e with 0 <= e < 2**cut; an
    # inverted slice stands for top - u. Exact scores differ from base + 2**(shift + cut) * sum by less
    # than the width: what r adds for |q|, and what e adds for the largest component.
    top = (1 << bits) - 1
    width = (np.abs(queries) * ((1 << shift) - 1)).sum(1) + ((np.abs(queries) - (weights << cut_off)) * (top << shift)).sum(1)
    sums = sliced_sums(index, weights, negative)
    every = np.zeros((len(queries), words), np.uint64)
    all_rows = np.packbits(np.arange(words * 64) < n, bitorder="little").view("<u8")
    every[:] = all_rows
    own_rows = {}
    for r, i in enumerate(ids.tolist()):
        own_rows.setdefault(i, []).append(r)
    for q, i in enumerate(query_ids.tolist()):
        for r in own_rows.get(i, ()):
            every[q, r >> 6] &= ~np.uint64(1 << (r & 63))
    kth = kth_sum(sums, every, min(k, n)) if sums else np.zeros(len(queries), np.int64)
    bound = np.maximum(0, kth - (width >> (shift + cut_off)) - 2)
    hit = at_least(sums, every, bound) if sums else every
    q, r = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
    score = np.einsum("ij,ij->i", queries[q], rows[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], r[keep], score[keep]


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): integer components of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    is_long = f"{SCALE} * v >= -{2**63}D and {SCALE} * v < {2**63}D"
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(
        f"id is not null and x is not null and not exists(x, v -> v is null or not ({is_long}))")
    return whole.select("id", F.expr(f"transform(x, v -> cast(floor({SCALE} * v) as bigint))").alias("x"))


def _matrix(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("id").to_numpy()
    flat = batch.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def build_index(vectors: DataFrame, rows: int = BLOCK_ROWS, bits: int = SLICES) -> DataFrame:
    """Blocks (dim, block, n, ids, raw, slices, shift, low) of ``quantised`` vectors."""

    def block(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = _matrix(t)
        low = x.min(axis=0) if len(x) else np.empty(0, np.int64)
        u, shift = leading(x - low, bits)
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([len(ids)], pa.int32()),
                         "ids": [ids.tobytes()], "raw": [x.astype("<i8").tobytes()], "slices": [bitmaps(u, bits).tobytes()],
                         "shift": pa.array([shift], pa.int32()), "low": [low.astype("<i8").tobytes()]})

    sized = vectors.withColumn("dim", F.size("x"))
    blocks = -(-vectors.count() // rows) or 1
    return (sized.withColumn("block", F.pmod(F.xxhash64("id", F.col("x")), F.lit(blocks)))
            .groupBy("dim", "block").applyInArrow(block, "dim int, block long, n int, ids binary, raw binary, slices binary, shift int, low binary"))


def top_k(queries: DataFrame, index: DataFrame, k: int = TOP, per_block: int = BLOCK_QUERIES, bits: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every query (``quantised`` rows)."""

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = _matrix(t)
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "q_ids": [ids.tobytes()], "q_raw": [x.astype("<i8").tobytes()]})

    n = -(-queries.count() // per_block) or 1
    asked = (queries.distinct().withColumn("dim", F.size("x")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n)))
             .groupBy("dim", "qb").applyInArrow(gather, "dim int, q_ids binary, q_raw binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                get = lambda c: np.frombuffer(row[c], "<i8")
                d, ids, q_ids = row["dim"], get("ids"), get("q_ids")
                slices = np.frombuffer(row["slices"], "<u8").reshape(d, bits, -1) if d else np.zeros((0, bits, -(-len(ids) // 64)), "<u8")
                raw, q_raw = get("raw").reshape(len(ids), d), get("q_raw").reshape(len(q_ids), d)
                if fits(raw, q_raw):
                    q, r, score = search_block(ids, raw, slices, row["shift"], get("low"), q_ids, q_raw, k, bits)
                else:
                    q, r, score = search_large(ids, raw, q_ids, q_raw, k)
                    if max(score, default=0) >= 1 << 63:
                        raise OverflowError("a score among the best is no 64-bit integer")
                    # Below 64 bits: null, ranked last, and an error only where it is among the best.
                    q, r = np.array(q, np.int64), np.array(r, np.int64)
                    score = [s if s >= -1 << 63 else None for s in score]
                yield pa.record_batch([pa.array(q_ids[q]), pa.array(ids[r]), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    # A row is a block pair; each gets a task of its own.
    pairs = asked.join(index, "dim")
    parts = max(1, n * index.count())
    found = pairs.withColumn("pair", F.xxhash64("q_ids", "block")).repartition(min(parts, 10_000), "pair").drop("pair").mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int"))
    score = F.coalesce("score", F.raise_error(F.lit("a score among the best is no 64-bit integer")).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _sql() -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(sum(q.x * c.x) AS BIGINT) AS score
          FROM c q JOIN c ON q.j = c.j AND q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0 GROUP BY ALL)
    SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= {TOP}"""


@register("op3_exact_top_k", _sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = cut(build_index(vectors))
    return top_k(vectors.filter(F.col("id") % QUERY_STEP == 0), index)
