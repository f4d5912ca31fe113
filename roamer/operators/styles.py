"""Travel styles: k-means over the scaled interests of a catalogue (R11), and the nearest of given centres."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamer.functions.numeric import half_even
from roamer.operators.catalog import INTEREST_COLUMNS, stored

STYLES = 4
SEED = 42


def scaled_interests(items: DataFrame) -> DataFrame:
    """All columns, and ``scaled``: the interests as 0..1 over the whole table; a constant or missing one is 0.

    One aggregate of a row finds the ranges; the rest is a projection.
    """
    span = items.agg(*[f(c).alias(f"{n}_{c}") for c in INTEREST_COLUMNS for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def one(c: str):
        lo, hi = span[f"lo_{c}"], span[f"hi_{c}"]
        if lo is None or lo == hi:
            return F.lit(0.0)
        return F.coalesce((F.col(c) - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0))

    return items.withColumn("scaled", F.array(*[one(c) for c in INTEREST_COLUMNS]))


def travel_style_clusters(items: DataFrame, k: int = STYLES, seed: int = SEED) -> tuple[DataFrame, list[list[float]]]:
    """Items with ``travel_style_cluster``, and the centres; min(k, different points) styles. Without items, no centres."""
    points = stored(scaled_interests(items))
    n = points.select("scaled").distinct().limit(k).count()
    if n == 0:
        return points.withColumn("travel_style_cluster", F.lit(0)), []
    model = KMeans(k=n, seed=seed, featuresCol="features", predictionCol="travel_style_cluster", maxIter=50, tol=1e-6).setInitSteps(5).fit(
        points.select(array_to_vector("scaled").alias("features"))) if n > 1 else None
    if model is None:
        centre = points.select(*[F.avg(F.get("scaled", F.lit(i))) for i in range(len(INTEREST_COLUMNS))]).first()
        return points.withColumn("travel_style_cluster", F.lit(0)), [list(centre)]
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    return assign_style(points, centres), centres


def assign_style(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """The nearest of the centres (a handful, given by the caller), by squared distance to 9 decimals; ties go to the
    smaller number. Adds ``travel_style_cluster`` and ``style_distance``."""
    far = [sum((F.get("scaled", F.lit(i)) - F.lit(float(v))) * (F.get("scaled", F.lit(i)) - F.lit(float(v))) for i, v in enumerate(c)) for c in centres]
    best = F.array_min(F.array(*[F.struct(half_even(d, 9).alias("d"), F.lit(j).alias("j")) for j, d in enumerate(far)]))
    return points.withColumn("__b", best).select(*points.columns, F.col("__b.j").alias("travel_style_cluster"), F.col("__b.d").alias("style_distance"))
