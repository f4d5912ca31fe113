"""Op 8: Hilbert-curve ordering of rows by several metadata dimensions, cut into even runs.

Every row gets a cell in a grid of quantised dimensions (language, source, size, id); the cell's
index on the Hilbert curve orders the rows, so that a run of neighbours is compact in *every*
dimension and a shard's minima and maxima prune filters on any of them. The law is ``rows``: the
order is cut by rank into shards whose row counts differ by one at most.

The rank needs no single task: only (index, id, size, crc) rows are range-partitioned and sorted,
materialised, and numbered by partition offsets; ties within a cell are ordered by id, crc and size,
so a cell, source or group of equal texts that holds a third of all rows is split like any other.

Defined results: null text has size 1 and the crc of no bytes; null language and source have cells of
their own; null ids come first; equal rows take neighbouring places in any order; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamer.llm.common import cut, register, table

SHARDS = 16
BITS = 6


def hilbert_steps(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Add ``out``: the Hilbert index of integer columns ``dims`` (each in 0 .. 2**bits - 1).

    The coordinates are turned level by level (highest bit first: exchange or invert the lower
    bits), Gray-coded across dimensions, and their bits interleaved. Each level is a projection of
    its own, so expressions stay small.
    """
    n = len(dims)
    x = [f"__h{i}" for i in range(n)]
    df = df.withColumns({c: F.col(d).cast("long") for c, d in zip(x, dims)})
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            hit = F.col(x[i]).bitwiseAND(F.lit(q)) != 0
            if i == 0:
                df = df.withColumns({x[0]: F.when(hit, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]))})
                continue
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(low))
            df = df.withColumns({x[0]: F.when(hit, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap)),
                                 x[i]: F.when(hit, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))})
    for i in range(1, n):
        df = df.withColumns({x[i]: F.col(x[i]).bitwiseXOR(F.col(x[i - 1]))})
    flip: Column = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumns({"__flip": flip})
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("__flip")) for c in x})
    index: Column = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for c in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(c), level).bitwiseAND(F.lit(1)))
    return df.withColumns({out: index}).drop(*x, "__flip")


def grid_cells(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, lang, source and the quantised dimensions of every row.

    Names are hashed to cells, ids go to equal ranges between the table's own least and greatest id,
    and sizes to cells of about equal counts: one aggregate counts the rows a quarter power of two
    (at most 124 counts, whatever the input), which the cells share out.
    """
    top = (1 << bits) - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).cast("long").alias("text_crc32"))
    quarter = F.floor(4 * F.log2(F.col("size").cast("double"))).cast("int")
    seen = sorted(rows.groupBy(quarter.alias("q")).agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect())
    ids = [x for r in seen for x in (r["a"], r["b"]) if x is not None]
    low, span = float(min(ids, default=0)), float(max(ids, default=0) - min(ids, default=0) + 1)
    total, before, cells = sum(r["n"] for r in seen), 0, []
    for r in seen:
        cells += [F.lit(r["q"]), F.lit(min(top, before * (top + 1) // total))]
        before += r["n"]
    by_size = F.coalesce(F.element_at(F.create_map(*cells), quarter), F.lit(top)) if cells else F.lit(0)
    place = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(low)) / F.lit(span) * (top + 1)).cast("long"), F.lit(0))
    name = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(top)) + 1, F.lit(0)).cast("long")
    return rows.withColumns({"d_lang": name("lang"), "d_source": name("source"),
                             "d_size": by_size.cast("long"),
                             "d_id": F.least(F.greatest(place, F.lit(0)), F.lit(top))})


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, lang, source of every row."""
    cells = hilbert_steps(grid_cells(docs, bits), ["d_lang", "d_source", "d_size", "d_id"], bits, "hilbert")
    keys = ["hilbert", "doc_id", "text_crc32", "size"]
    ordered = cut(cells.select(*keys, "lang", "source").repartitionByRange(*keys).sortWithinPartitions(*keys))
    # The id of a materialised row is (partition, place in it).
    numbered = ordered.withColumn("__at", F.monotonically_increasing_id())
    part = numbered.select("*", F.shiftright("__at", 33).alias("__p"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__i"))
    counts = part.groupBy("__p").agg(F.count("*").alias("__n"))
    # One row a partition: the running sum over them is small whatever the number of rows.
    bases = counts.select("__p", F.expr("sum(__n) over (order by __p) - __n").alias("__base"), F.expr("sum(__n) over ()").alias("__all"))
    ranked = part.join(F.broadcast(bases), "__p").withColumn("rank", F.col("__base") + F.col("__i"))
    shard = F.expr(f"rank * {shards} div __all")
    first = F.expr(f"(shard * __all + {shards - 1}) div {shards}")
    return (ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "hilbert", "lang", "source"))


def shard_ranges(placed: DataFrame) -> DataFrame:
    """What a reader prunes by: each shard's rows, bytes, and least and greatest value a dimension."""
    dims = ["doc_id", "size", "lang", "source", "hilbert"]
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"),
                                       *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))],
                                       F.collect_set("lang").alias("langs"))


def shards_for(ranges: DataFrame, **bounds: tuple) -> DataFrame:
    """Shards whose ranges meet all given inclusive bounds, e.g. ``size=(1, 100)``."""
    for dim, (low, high) in bounds.items():
        ranges = ranges.filter((F.col(f"max_{dim}") >= F.lit(low)) & (F.col(f"min_{dim}") <= F.lit(high)))
    return ranges.select("shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Write the rows as Parquet, a folder a shard, sorted along the curve; returns the ranges.

    Rows find their shard by (doc_id, crc): needs ids that are unique and not null.
    """
    placed = cut(hilbert_shards(docs, shards, bits))
    where = placed.select("doc_id", "shard", "slot")
    out = docs.join(where, "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    out.write.mode("errorifexists").partitionBy("shard").parquet(path)
    return shard_ranges(placed)


@register("op8_hilbert_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
