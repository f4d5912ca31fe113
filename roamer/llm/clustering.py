"""Op 11: exact integer k-means with geometric drift tightening.

Every vector carries an upper bound of the distance to its centroid and one lower bound of the distance
to all others. When the centroids move, the upper bound grows by its own centroid's move. The lower bound
does not shrink by the largest move: for a cluster's sphere (its centroid, the largest upper bound of its
members as radius) and another centroid's move, the plane through the three points bounds what any member
can lose. With e the direction from the new to the old place of the other centroid and p the length of the
move, a member's distance falls by the integral of p * cos(angle of e and the way from the member to a point of
the move). Seen from that point, the sphere fills a cone of half angle asin(radius / distance) about the way
from the sphere's centre; the angle is least at the old place, so the loss is at most
p * cos(max(0, angle - half angle)), which may be negative: then the bound grows. Vectors whose upper bound
is below the lower bound, or below half the way to the next centroid, keep their centroid. For the others the
distance to their own centroid is worked out exactly, and if that does not settle it, all distances are.

Vectors are packed into blocks where they are read, without a shuffle. A round reads the checkpointed blocks
and writes them again with their new state; sums move by the vectors that change their cluster, and meet in one aggregate
of a row for each centroid and component. Only these sums, radii and centroids come to the driver: their number
is set by the number of centroids and components, not by the vectors. Sums are exact in
two halves; distances are exact in doubles where every term stays below 2**52, else in Python's integers.

Defined results: kept are vectors of exactly ``dims`` components, none null or non-finite; a component that
is no 64-bit integer, or a final distance that is none, raises an error. Repeated rows count each; rows with a null id
are clustered, but start no centroid; rows that tie for a start come in the order of their components; with fewer vectors than
centroids there are fewer centroids; ties go to the smaller number; empty clusters keep their centroid; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, register, table

SCALE = 1024
DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
BLOCK_ROWS = 4096

_BLOCK = "ids array<long>, x binary, width int, a binary, u binary, l binary, d binary, sums array<long>, radius array<double>, scanned long"
#: Outward rounding of bounds kept as 32-bit floats.
_OUT = 2.0 ** -22


def lattice(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS) -> DataFrame:
    """(id, x): the kept vectors as integers floor(1024 * component)."""
    x = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(
        f"x is not null and size(x) = {int(dims)} and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))")
    whole = f"case when {SCALE} * v >= -{2**63}D and {SCALE} * v < {2**63}D then cast(floor({SCALE} * v) as bigint) else raise_error('a component is no 64-bit integer') end"
    return kept.select("id", F.expr(f"transform(x, v -> {whole})").alias("x"))


def first_centroids(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = points.filter("id is not null").select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()
    return [list(r["x"]) for r in rows]


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances (vector, centroid): doubles where they hold all terms, else Python's integers."""
    most = max([1, *(abs(v) for c in centroids for v in c)]) + max(1, int(x.max(initial=0)), -int(x.min(initial=0)))
    if x.shape[1] * most * most < 1 << 52:
        c, y = np.array(centroids, np.float64).reshape(-1, x.shape[1]), x.astype(np.float64)
        return np.einsum("ij,ij->i", y, y)[:, None] - 2 * (y @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
    y = x.astype(object)
    return np.stack([((y - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance, the next smallest one)."""
    d = squared(x, centroids)
    a = np.argmin(d, axis=1)
    own = d[np.arange(len(d)), a]
    if d.shape[1] == 1:
        return a, own, np.full(len(d), np.inf)
    d[np.arange(len(d)), a] = d.max(initial=0) + 1 if d.dtype != object else 1 << 200
    return a, own, d.min(axis=1)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    r = np.array([math.isqrt(v) if isinstance(v, int) else math.sqrt(v) for v in d], float) if d.dtype == object else np.sqrt(d)
    return (r + (d.dtype == object)) * (1 + _OUT) if up else r * (1 - _OUT)


def loss(centre: np.ndarray, radius: float, move: np.ndarray) -> float:
    """How much nearer a moved centroid can come to any point of a sphere. ``centre``: from the sphere's
    centre to the centroid's old place; ``move``: from its new to its old place."""
    p = float(np.linalg.norm(move))
    if p == 0:
        return 0.0
    far, along, r = float(np.linalg.norm(centre)), float(centre @ move) / p, radius * (1 + 1e-6)
    aside = math.sqrt(max(0.0, far * far - along * along))
    if far <= r or (aside <= r and along > 0):
        return p * (1 + 1e-9)
    angle = math.atan2(aside, along) - math.asin(min(1.0, r / far)) - 1e-6
    return p * (math.cos(max(0.0, angle)) + 1e-9)


class Drift:
    """What one move of the centroids does to the bounds of each cluster's members."""

    def __init__(self, old: list[list[int]], new: list[list[int]], radius: list[float]):
        k = len(new)
        apart = lambda a, b: np.array([v - w for v, w in zip(a, b)], float)
        self.move = np.array([float(np.linalg.norm(apart(old[i], new[i]))) * (1 + 1e-9) for i in range(k)])
        self.loss = np.array([max([loss(apart(old[j], old[i]), radius[i], apart(old[j], new[j])) for j in range(k) if j != i], default=0.0) for i in range(k)])
        self.half = np.array([min([float(np.linalg.norm(apart(new[i], new[j]))) for j in range(k) if j != i], default=math.inf) for i in range(k)]) * (0.5 - 1e-9)


def assign(x: np.ndarray, centroids: list[list[int]], state: tuple | None, drift: Drift | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper bound, lower bound, vectors of which all distances were worked out)."""
    n = len(x)
    if state is None:
        a, own, other = nearest(x, centroids)
        return a.astype(np.int32), _root(own, True), _root(other, False), n
    a, u, l = state[0].copy(), state[1].astype(float) + drift.move[state[0]], state[2].astype(float) - drift.loss[state[0]]
    u, l = u * (1 + _OUT), l - np.abs(l) * _OUT
    safe = np.maximum(l, drift.half[a])
    open_ = np.flatnonzero(u >= safe)
    if len(open_):
        own = np.empty(len(open_))
        for c in np.unique(a[open_]):
            of = a[open_] == c
            own[of] = _root(squared(x[open_[of]], [centroids[c]])[:, 0], True)
        u[open_] = own
        open_ = open_[own >= safe[open_]]
    if len(open_):
        to, d, other = nearest(x[open_], centroids)
        a[open_], u[open_], l[open_] = to, _root(d, True), _root(other, False)
    return a, u, l, len(open_)


def _limbs(total: list[int]) -> list[int]:
    """Two 64-bit halves of each integer; halves can be added up apart."""
    return [v >> 32 for v in total] + [v & 0xFFFFFFFF for v in total]


def _whole(rows: list, n: int) -> list[int]:
    """The integers whose halves were added up."""
    by = {r["pos"]: int(r["total"]) for r in rows}
    return [(by.get(i, 0) << 32) + by.get(n + i, 0) for i in range(n)]


def _exact_sum(x: np.ndarray) -> list[int]:
    """Sums of the columns."""
    if not len(x):
        return [0] * x.shape[1]
    if max(int(x.max()), -int(x.min())) < 1 << 40:
        return x.sum(axis=0, dtype=np.int64).tolist()
    return x.astype(object).sum(axis=0).tolist()


def pack(points: DataFrame, dims: int = DIMS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of up to ``rows`` vectors, in the smallest integers that hold them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("width", pa.int32())])
        held, n = [], 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            width = next(w for w in (2, 4, 8) if w == 8 or (x >= -(1 << 8 * w - 1)).all() and (x < 1 << 8 * w - 1).all())
            return pa.record_batch([pa.array([t.column("ids").to_pylist()], schema.field(0).type), pa.array([x.astype(f"<i{width}").tobytes()]), pa.array([width], pa.int32())], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                held.append(part)
                n += part.num_rows
                if n >= rows:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return points.select(F.col("id").alias("ids"), "x").mapInArrow(build, "ids array<long>, x binary, width int")


def _round(blocks: DataFrame, centroids: list[list[int]], drift: Drift | None, dims: int, last: bool) -> DataFrame:
    """Blocks in their next state."""
    k = len(centroids)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                x = np.frombuffer(row["x"].as_buffer(), f"<i{row['width'].as_py()}").reshape(-1, dims).astype(np.int64)
                state = None if drift is None else tuple(np.frombuffer(row[c].as_buffer(), t) for c, t in (("a", "<i4"), ("u", "<f4"), ("l", "<f4")))
                a, u, l, scanned = assign(x, centroids, state, drift)
                was = np.full(len(a), -1, np.int32) if state is None else state[0]
                sums = []
                for c in range(k):
                    came, went = (a == c) & (was != c), (was == c) & (a != c)
                    sums += [int(came.sum()) - int(went.sum()), *(v - w for v, w in zip(_exact_sum(x[came]), _exact_sum(x[went])))]
                d = np.empty(0, np.int64)
                if last:
                    own = np.empty(len(a), object)
                    for c in range(k):
                        own[a == c] = [int(v) for v in squared(x[a == c], [centroids[c]])[:, 0]]
                    if max(own, default=0) >= 1 << 63:
                        raise OverflowError("a distance is no 64-bit integer")
                    d = own.astype(np.int64)
                    sums += [sum(own[a == c].tolist()) for c in range(k)]
                radius = [float(u[a == c].max(initial=0)) * (1 + _OUT) for c in range(k)]
                yield pa.record_batch([
                    pa.array([row["ids"].as_py()], pa.list_(pa.int64())), pa.array([row["x"].as_py()], pa.binary()), pa.array([row["width"].as_py()], pa.int32()),
                    pa.array([a.astype("<i4").tobytes()], pa.binary()), pa.array([(u * (1 + _OUT)).astype("<f4").tobytes()], pa.binary()),
                    pa.array([(l - np.abs(l) * _OUT).astype("<f4").tobytes()], pa.binary()), pa.array([d.astype("<i8").tobytes()], pa.binary()),
                    pa.array([_limbs(sums)], pa.list_(pa.int64())), pa.array([radius], pa.list_(pa.float64())), pa.array([scanned], pa.int64())],
                    names=[f.split()[0] for f in _BLOCK.split(", ")])

    return blocks.mapInArrow(step, _BLOCK)


def _totals(blocks: DataFrame, n: int) -> list[int]:
    rows = blocks.select(F.posexplode("sums").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("total")).collect()
    return _whole(rows, n)


def cluster(points: DataFrame, start: list[list[int]], rounds: int = ROUNDS, dims: int = DIMS, rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scanned_share (of all
    assignments, those for which all distances were worked out) of every ``lattice`` vector."""
    schema = "vec_id long, cluster int, distance long"
    k, centroids, drift, passes = len(start), start, None, 0
    blocks = cut(pack(points, dims, rows)) if k else None
    total, scanned, n = [0] * (k * (dims + 1)), 0, 0
    for at in range(rounds + 1 if k else 0):
        last = at == rounds
        blocks = cut(_round(blocks, centroids, drift, dims, last))
        sums = _totals(blocks, k * (dims + 1) + k * last)
        passes += 1
        total = [v + w for v, w in zip(total, sums)]
        scanned += blocks.agg(F.sum("scanned")).first()[0] or 0
        if last:
            inertia = sums[-k:]
            break
        by = {r["pos"]: r["r"] for r in blocks.select(F.posexplode("radius").alias("pos", "r")).groupBy("pos").agg(F.max("r").alias("r")).collect()}
        counts = [total[c * (dims + 1)] for c in range(k)]
        moved = [[v // counts[c] for v in total[c * (dims + 1) + 1:(c + 1) * (dims + 1)]] if counts[c] else centroids[c] for c in range(k)]
        drift = Drift(centroids, moved, [by.get(c, 0.0) for c in range(k)])
        centroids = moved
    if not k:
        return points.filter("false").select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.col("id").alias("distance"), F.col("id").alias("cluster_inertia"),
                                             F.col("id").alias("inertia"), F.lit("").alias("centroid_sha256"), F.lit(0.0).alias("scanned_share"))
    n = sum(total[c * (dims + 1)] for c in range(k))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    if sum(inertia) >= 1 << 63:
        raise OverflowError("the inertia is no 64-bit integer")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, d = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("a", "<i4"), ("d", "<i8")))
                yield pa.record_batch([batch.column("ids")[r].values, pa.array(a), pa.array(d)], names=["vec_id", "cluster", "distance"])

    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return blocks.select("ids", "a", "d").mapInArrow(unpack, schema).select(
        "vec_id", "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"),
        of(digests).alias("centroid_sha256"), F.lit(scanned / max(1, n * passes)).alias("scanned_share"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds one after another, each as a table of centroids (c, x) and one of assignments."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
      SELECT v.r, v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{t} c) GROUP BY r)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.x, c.x) AS x FROM c{t} c LEFT JOIN (
      SELECT c, list(m ORDER BY j) AS x FROM (SELECT c, j, cast((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (
        SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{t}) GROUP BY c, j) GROUP BY c) n ON n.c = c.c)""")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT vec_id, cast(a.c AS INTEGER) AS cluster, d AS distance, cast(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
           cast(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


@register("op11_centroid_clustering", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lattice(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return cluster(points, first_centroids(points)).drop("scanned_share")
