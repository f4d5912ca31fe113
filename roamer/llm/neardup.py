"""Op 13: embedding near-duplicates through int8 tile products with per-vector error bounds.

Equal vectors form a class and are compared once. A class's unit vector u is kept as s * q + e: q has
8-bit integers, s is a vector's own scale, and eps >= |e| its own error. For two of them the cosine differs from
s * s' * (q . q') by at most eps + (1 + eps) * eps'. Classes are dealt into tiles by a hash; every pair of tiles
is one group of Spark's, and in it the integer products of all rows are one matrix product (exact, as
all sums stay below 2**24). Pairs whose upper bound misses the threshold end there, pairs whose lower bound reaches it are links,
and only those between are worked out in double precision from the full vectors that lie in the same tiles.

Links are not listed. A pair of tiles returns, for each class that has some, how many vectors it is linked with there,
and the edges of a spanning forest: a group of g near copies costs g rows a pair of tiles, not g * g. Counts are added up by class;
components are found over the forests.

Work grows with the square of the number of different vectors, as all pairs are to be bounded by tile products; tiles of
``TILE_ROWS`` keep a task's memory fixed, and each tile is sent to as many tasks as there are tiles.

Defined results: vectors that are null, empty or zero or hold null or non-finite components are linked with
nothing; vectors of different lengths are not compared; equal vectors are linked (their cosine is 1); a null id is never the
smallest unless alone, and its row is kept only then; rows with one id count each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, register, table
from roamer.llm.components import components

THRESHOLD = 0.95
TILE_ROWS = 8192
#: Rows of a tile that are multiplied with the other tile at once.
STRIP_ROWS = 512
#: Products of 8-bit integers are exact in 32-bit floats for so many components.
EXACT_DIMS = (1 << 24) // (127 * 127)

_TILE = "dims int, tile int, nodes binary, sizes binary, q binary, scale binary, eps binary, units binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, 8-bit integers, scales, error bounds) of finite vectors that are not zero."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    e = u - q * scale[:, None]
    return u, q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", e, e)) * (1 + 1e-9) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int8 matrices."""
    out = None
    for at in range(0, max(1, a.shape[1]), EXACT_DIMS):
        part = a[:, at:at + EXACT_DIMS].astype(np.float32) @ b[:, at:at + EXACT_DIMS].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


class Forest:
    """Labels of connected numbers; links come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (up := self.label[self.label])).any():
                self.label = up


class Tile:
    def __init__(self, row: dict):
        d = row["dims"]
        self.number = row["tile"]
        self.nodes = np.frombuffer(row["nodes"], "V16")
        self.sizes, self.scale, self.eps = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["scale"], "<f8"), np.frombuffer(row["eps"], "<f8")
        n = len(self.nodes)
        self.q = np.frombuffer(row["q"], np.int8).reshape(n, d)
        self.units = np.frombuffer(row["units"], "<f8").reshape(n, d)


def compare(a: Tile, b: Tile, same: bool, threshold: float, strip: int = STRIP_ROWS) -> tuple[np.ndarray, np.ndarray, Forest, int]:
    """(linked vectors of each row of a, of each row of b, forest over both, pairs worked out in full)."""
    na, nb = len(a.nodes), len(b.nodes)
    count_a, count_b, forest, full = np.zeros(na), np.zeros(nb), Forest(na if same else na + nb), 0
    eps_b, scale_b = b.eps.max(initial=0), b.scale.max(initial=0)
    for at in range(0, na, strip):
        rows = slice(at, at + strip)
        first = at if same else 0
        p = products(a.q[rows], b.q[first:])
        # A bound for all of b first; it keeps the matrix to one comparison.
        least = (threshold - a.eps[rows] - (1 + a.eps[rows]) * eps_b) / a.scale[rows]
        least = np.where(least > 0, least / scale_b, -np.inf) * (1 - 1e-6)
        i, j = np.nonzero(p >= least[:, None].astype(p.dtype))
        about = p[i, j].astype(np.float64)
        i, j = i + at, j + first
        if same:
            i, j, about = (v[i < j] for v in (i, j, about))
        about *= a.scale[i] * b.scale[j]
        error = a.eps[i] + (1 + a.eps[i]) * b.eps[j] + 1e-12
        linked = about - error >= threshold
        maybe = np.flatnonzero(~linked & (about + error >= threshold))
        for part in np.array_split(maybe, -(-len(maybe) // 65536) or 1):
            linked[part] = np.einsum("ij,ij->i", a.units[i[part]], b.units[j[part]]) >= threshold
        full += len(maybe)
        i, j = i[linked], j[linked]
        count_a += np.bincount(i, b.sizes[j], na)
        count_b += np.bincount(j, a.sizes[i], nb)
        forest.link(i, j if same else j + na)
    return count_a, count_b, forest, full


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) and classes (node, least, size, x). A node is the MD5 of the vector; null: linked with nothing."""
    x = F.col(vector_col).cast("array<double>")
    usable = "x is not null and exists(x, v -> v <> 0) and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.withColumn("x", F.expr(f"case when {usable} then transform(x, v -> v + 0D) end"))  # -0.0 is 0.0
    rows = rows.withColumn("node", F.unhex(F.md5(F.col("x").cast("string"))))
    by = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.any_value("x").alias("x"))
    return rows.select("vec_id", "node"), by


def tiles(by: DataFrame, count: int, rows: int = TILE_ROWS) -> tuple[DataFrame, int]:
    """Tiles (see ``_TILE``) of the classes, and how many numbers they may have."""
    n = -(-count // rows) or 1

    def build(key: tuple, t: pa.Table) -> pa.Table:
        d, m = key[0].as_py(), t.num_rows
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(m, d)
        u, q, scale, eps = quantise(x)
        cells = [b"".join(t.column("node").to_pylist()), t.column("size").to_numpy().astype("<i8").tobytes(), q.tobytes(),
                 scale.astype("<f8").tobytes(), eps.astype("<f8").tobytes(), u.astype("<f8").tobytes()]
        return pa.table([pa.array([d], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)],
                        names=[f.split()[0] for f in _TILE.split(", ")])

    dealt = by.withColumn("dims", F.size("x")).withColumn("tile", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))
    return dealt.select("dims", "tile", "node", "size", "x").groupBy("dims", "tile").applyInArrow(build, _TILE), n


def tile_links(tiled: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links, full): with b an edge of a forest, else how many vectors a is linked with in one pair of tiles."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        held = sorted((Tile(r) for r in t.to_pylist()), key=lambda x: x.number)
        same = key[1].as_py() == key[2].as_py()
        nodes = [bytes(v) for x in held for v in x.nodes.tolist()]
        a, b, links, full = [], [], [], 0
        if same or len(held) == 2:
            count_a, count_b, forest, full = compare(held[0], held[-1], same, threshold)
            counts = count_a + count_b if same else np.concatenate([count_a, count_b])
            some, far = np.flatnonzero(counts), np.flatnonzero(forest.label != np.arange(len(forest.label)))
            a = [nodes[v] for v in some] + [nodes[v] for v in far]
            b = [None] * len(some) + [nodes[v] for v in forest.label[far]]
            links = counts[some].astype(np.int64).tolist() + [0] * len(far)
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64()), pa.array([full] * len(a), pa.int64())], names=["a", "b", "links", "full"])

    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = pairs.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    parts = min(10_000, n * (n + 1) // 2)  # a pair is a task's work, whatever the bytes
    return pairs.repartition(parts, "dims", "low", "high").groupBy("dims", "low", "high").applyInArrow(work, "a binary, b binary, links long, full long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept, class (hex, null where linked with nothing) of every row."""
    each, by = classes(vectors, id_col, vector_col)
    by = cut(by)
    tiled, n = tiles(by, by.count(), rows)
    found = cut(tile_links(cut(tiled), n, threshold))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.filter("b is not null").select("a", "b"))
    reached = by.join(labels, "node", "left").select("node", "least", "size", F.coalesce("label", "node").alias("label"))
    smallest = reached.groupBy("label").agg(F.min("least").alias("component_id"))
    known = cut(reached.join(smallest, "label").join(counts, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    alone = each.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("class"))
    linked = each.filter("node is not null").join(known, "node")
    return linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lower(F.hex("node")).alias("class")).unionByName(alone)


_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, cast(embedding AS DOUBLE[]) AS e,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
    WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.s),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least.component_id, v.vec_id IS NOT DISTINCT FROM least.component_id AS kept
FROM v JOIN least ON least.r = v.r LEFT JOIN n ON n.a = v.r"""


@register("op13_embedding_near_dedup", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).drop("class")
