"""The catalogue as files: read from CSV or Parquet (S1), written as one table.

CSV cells that stand for a missing value become nulls where they are read, and a row that does not fit the header
is kept aside in ``_bad`` instead of shifting its cells.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.operators.catalog import DESTINATION_COLUMNS, STRING_COLUMNS, missing_to_null
from roamer.functions.numeric import to_double

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\x00"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list the path, on whatever store it lies."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).limit(0).collect()
        return True
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return False


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table: all columns as text, missing tokens as nulls; ``_bad`` holds the text of rows that do not fit."""
    header = spark.read.options(**_CSV).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in header) + ", `_bad` string"
    rows = spark.read.options(**_CSV).schema(schema).option("columnNameOfCorruptRecord", "_bad").csv(path)
    return rows.select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in header], "_bad")


def choose_path(spark: SparkSession, explicit: str | None, processed: str, sample: str) -> str:
    """A named path wins; else the processed table if it is there; else the sample."""
    if explicit is not None:
        return explicit
    return processed if exists(spark, processed) else sample


def load_catalog(spark: SparkSession, explicit: str | None, processed: str, sample: str) -> DataFrame:
    """The catalogue with numbers as doubles, whatever the format; columns that are not the catalogue's stay as they are."""
    path = choose_path(spark, explicit, processed, sample)
    rows = read_csv(spark, path).drop("_bad") if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    numbers = set(DESTINATION_COLUMNS) - set(STRING_COLUMNS)
    return rows.select(*[to_double(c).alias(c) if c in numbers else F.col(c) for c in rows.columns])


def write_catalog(catalog: DataFrame, path: str) -> None:
    """The whole table anew; CSV if the path says so, else Parquet. Missing parents are made."""
    if path.rstrip("/").endswith(".csv"):
        catalog.write.mode("overwrite").options(header="true", quote='"', escape='"', emptyValue="", nullValue="").csv(path)
    else:
        catalog.write.mode("overwrite").parquet(path)
