"""A keyed table in Parquet that is replaced or merged a version at a time.

Rows lie in folders by a hash of their key (``buckets`` of them). A change writes the buckets that it touches
to a new folder and then adds one small manifest row: version, the folder of every bucket, and the last batch
taken from each source. Readers follow the newest manifest row only, so they see the table before or after a change,
never between; a change that fails leaves the table as it was. Buckets that a merge does not touch keep their files.
One writer at a time is assumed. What comes to the driver is the manifest: one row of at most ``buckets`` folders.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version long, places map<string,string>, taken map<string,long>"


class KeyedTable:
    """``order``: the column that decides between rows of one key; the largest wins, on equal ones the later change."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def state(self) -> tuple[int, dict[str, str], dict[str, int]]:
        """(version, folder of each bucket, last batch of each source); version 0 is the empty table."""
        try:
            row = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            row = None
        return (row["version"], dict(row["places"] or {}), dict(row["taken"] or {})) if row else (0, {}, {})

    def _rows(self, places: dict[str, str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*[f"{place}/part={b}" for b, place in sorted(places.items())])

    def read(self) -> DataFrame:
        return self._rows(self.state()[1])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key; an aggregate, so a key with many rows is combined before the shuffle."""
        rest = [c for c in self.schema.names if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(F.col(self.order), F.col("__late"))).alias("r")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, "r.*").select(*self.schema.names)

    def _commit(self, rows: DataFrame, version: int, kept: dict[str, str], taken: dict[str, int]) -> int:
        """Write ``rows`` as a new folder, then the manifest row that leads to it."""
        place = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        rows.withColumn("part", self._bucket()).repartition("part").write.partitionBy("part").parquet(place)
        try:
            parts = self.spark.read.parquet(place).select(F.col("part").cast("string").alias("part")).distinct().collect()
        except AnalysisException as empty:  # no row, so no file to infer columns from
            if "UNABLE_TO_INFER_SCHEMA" not in str(empty):
                raise
            parts = []
        places = {**kept, **{r["part"]: place for r in parts}}
        row = self.spark.createDataFrame([(version, places, taken)], _MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return version

    def replace(self, rows: DataFrame) -> int:
        """All rows anew; the new version's number."""
        version, _, taken = self.state()
        return self._commit(self._latest(rows.select(*self.schema.names, F.lit(0).alias("__late"))), version + 1, {}, taken)

    def merge(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Insert new keys, replace known ones. A batch of ``source`` that was taken before changes nothing."""
        version, places, taken = self.state()
        if source is not None and taken.get(source, -1) >= batch:
            return version
        new = rows.select(*self.schema.names, F.lit(1).alias("__late"))
        touched = {r[0] for r in new.select(self._bucket()).distinct().collect()}
        taken = {**taken, source: batch} if source is not None else taken
        old = self._rows({b: p for b, p in places.items() if b in touched}).withColumn("__late", F.lit(0))
        return self._commit(self._latest(old.unionByName(new)), version + 1, {b: p for b, p in places.items() if b not in touched}, taken)
