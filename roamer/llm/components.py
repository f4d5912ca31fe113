"""Connected components of a link table by large-star and small-star rounds.

Before every round each part of the links, of a bounded number, is contracted to a forest in its task;
links that fit one part are done then, so small tables need no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamer.llm.common import cut

#: Links that one task contracts.
PART_LINKS = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or smaller) neighbours and itself to its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.filter("b < a").join(least, "a")
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(out.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of the nodes 0 to n - 1 reaches over the links a, b."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _contract(edges: DataFrame) -> DataFrame:
    """In every partition, each linked node with the least node it reaches there (roots with themselves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        ends = [pa.concat_arrays([x.column(c) for x in held]) for c in ("a", "b")]
        coded = pa.concat_arrays(ends).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        at = rank[coded.indices.to_numpy()]
        root = _roots(at[:len(ends[0])], at[len(ends[0]):], len(order))
        names = coded.dictionary.take(order)
        yield pa.record_batch([names, names.take(pa.array(root))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: label is the least node it can reach.

    ``links`` has columns a and b of one orderable type. Rounds go on until nothing changes; their
    number grows with the logarithm of the longest path, and every round is materialised.
    """
    edges = cut(links.select("a", "b").filter("a <> b"))
    seen = None
    while True:
        parts = edges.count() // PART_LINKS + 1
        edges = cut(_contract(edges.coalesce(parts)))
        if parts == 1:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        edges = cut(_star(_star(edges.filter("a <> b"), True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
