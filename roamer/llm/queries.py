"""All queries and DuckDB SQL of this subpackage; importing the modules registers them."""

from roamer.llm import chat, clustering, jaccard, neardup, packing, phrases, pieces, quality, repeats, sharding, tokenfiles, topk, warc  # noqa: F401
from roamer.llm.common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
