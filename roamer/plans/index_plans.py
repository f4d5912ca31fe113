"""Destination documents, index and answers (V1, V2, V7-V9, V13, V15-V17, S6) with DuckDB oracles.

Destinations are the built catalogue; questions are ``benchmark`` texts. Two corpora: ``main`` (curated rows
left out, indexed) and ``curated`` (not indexed); a question asks one of them by the parity of its number.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from roamer.functions.numeric import boundary
from roamer.operators import index as ix
from roamer.operators.catalog import INTEREST_COLUMNS
from roamer.plans import matching_plans as mp
from roamer.plans import retrieval_plans as rp
from roamer.plans.registry import register
from roamer.plans.sqlgen import r6
from roamer.session import fresh_folder
from roamer.sources import tables as tb

FIRST, SECOND = datetime(2026, 6, 1), datetime(2026, 6, 2)


def _fix(c: str, d: int) -> str:
    scale = f"{10 ** d}.0"
    return f"format('{{:.{d}f}}', round_even(coalesce({c}, 0) * {scale}, 0) / {scale})"


_LIST = "[" + ", ".join(f"{{'low': -coalesce({c}, 0.0), 'at': {i}, 'text': '{c} ' || {_fix(c, 0)} || '/10'}}" for i, c in enumerate(INTEREST_COLUMNS)) + "]"
_DOC = (f"city || ', ' || country || ' is in ' || replace(region, '_', ' ') || '. ' || coalesce(description, '') || ' Typical annual temperature: ' || {_fix('avg_temp_c', 1)}"
        f" || ' C. Estimated base daily cost: ' || {_fix('cost_per_day_usd', 0)} || ' USD. Strongest travel qualities: '"
        f" || array_to_string(list_transform(list_sort({_LIST})[1:3], lambda s: s.text), ', ') || '. Safety rating: ' || {_fix('safety', 0)} || '/10. Popularity rating: ' || {_fix('popularity', 0)} || '/10.'")
CTES = {**mp.CTES, **{k: v for k, v in rp.CTES.items()}}
# Later rows: every third city name's length has a new price; copies under another name are new.
CTES["updates"] = """SELECT * REPLACE (cost_per_day_usd + 10 AS cost_per_day_usd) FROM built WHERE length(city) % 3 = 0
  UNION ALL SELECT * REPLACE (city || ' Nova' AS city) FROM built WHERE length(city) % 4 = 1"""
CTES["upserted"] = """SELECT * FROM updates UNION ALL SELECT * FROM built b WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.city = b.city AND u.country = b.country)"""
CTES["dest"] = f"SELECT *, city || ', ' || country AS doc_id, CASE WHEN source_dataset IS NULL THEN 'curated' ELSE 'main' END AS corpus, {_DOC} AS content FROM built"
CTES["asked"] = "SELECT item_id AS qid, text AS question, CASE WHEN item_id % 2 = 0 THEN 'main' ELSE 'curated' END AS corpus FROM benchmark"
_TOKENS = rp._KEEP
CTES["dest_grams"] = f"SELECT doc_id, corpus, unnest({rp._GRAMS}) AS g FROM (SELECT doc_id, corpus, {_TOKENS.replace('(text)', '(content)')} AS k FROM dest)"
CTES["dest_hv"] = f"SELECT doc_id, corpus, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, corpus, {rp._BUCKET} AS bucket, count(*) AS n FROM dest_grams GROUP BY ALL)"
CTES["asked_hv"] = f"""SELECT qid, corpus, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY qid)) AS weight FROM (SELECT qid, corpus, {rp._BUCKET} AS bucket, count(*) AS n
  FROM (SELECT qid, corpus, unnest({rp._GRAMS}) AS g FROM (SELECT qid, corpus, {_TOKENS.replace('(text)', '(question)')} AS k FROM asked)) GROUP BY ALL)"""
CTES["vec_sims"] = """SELECT a.qid, d.doc_id, coalesce(s.similarity, 0.0) AS similarity FROM asked a JOIN dest d ON d.corpus = a.corpus LEFT JOIN (
  SELECT q.qid, h.doc_id, sum(q.weight * h.weight) AS similarity FROM asked_hv q JOIN dest_hv h ON h.corpus = q.corpus AND h.bucket = q.bucket GROUP BY ALL) s ON s.qid = a.qid AND s.doc_id = d.doc_id
  WHERE a.corpus = 'main'"""
CTES["c_post"] = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.replace('(text)', '(content)')}) AS term FROM dest WHERE corpus = 'curated') GROUP BY ALL"
CTES["c_asked"] = f"SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_TOKENS.replace('(text)', '(question)')}) AS term FROM asked WHERE corpus = 'curated') GROUP BY ALL"
# Every (question, term) of the fitted texts with its idf: documents that hold it, and the question itself.
CTES["c_idf"] = """SELECT q.qid, t.term, ln((1 + n.n) / (1 + t.df + CASE WHEN a.term IS NULL THEN 0 ELSE 1 END)) + 1 AS idf
  FROM (SELECT qid FROM asked WHERE corpus = 'curated') q CROSS JOIN (SELECT term, count(*) AS df FROM c_post GROUP BY term UNION ALL SELECT DISTINCT term, 0 FROM c_asked WHERE term NOT IN (SELECT term FROM c_post)) t
  CROSS JOIN (SELECT count(*) + 1 AS n FROM dest WHERE corpus = 'curated') n LEFT JOIN c_asked a ON a.qid = q.qid AND a.term = t.term"""
CTES["tf_sims"] = """SELECT a.qid, d.doc_id, coalesce(x.dot / nullif(dn.v * qn.v, 0), 0.0) AS similarity FROM asked a JOIN dest d ON d.corpus = a.corpus
  LEFT JOIN (SELECT q.qid, p.doc_id, sum(q.tf * p.tf * i.idf * i.idf) AS dot FROM c_asked q JOIN c_post p ON p.term = q.term JOIN c_idf i ON i.qid = q.qid AND i.term = q.term GROUP BY ALL) x ON x.qid = a.qid AND x.doc_id = d.doc_id
  LEFT JOIN (SELECT i.qid, p.doc_id, sqrt(sum(power(p.tf * i.idf, 2))) AS v FROM c_post p JOIN c_idf i ON i.term = p.term GROUP BY ALL) dn ON dn.qid = a.qid AND dn.doc_id = d.doc_id
  LEFT JOIN (SELECT q.qid, sqrt(sum(power(q.tf * i.idf, 2))) AS v FROM c_asked q JOIN c_idf i ON i.qid = q.qid AND i.term = q.term GROUP BY q.qid) qn ON qn.qid = a.qid
  WHERE a.corpus = 'curated'"""
CTES["routed"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round_even(similarity * 1000000000.0, 0) / 1000000000.0 DESC, doc_id) AS rank FROM (
  SELECT *, '{ix.ROUTE_VECTOR}' AS retrieval_mode FROM vec_sims UNION ALL SELECT *, '{ix.ROUTE_TFIDF}' FROM tf_sims)) WHERE rank <= 5"""
CTES["hits"] = "SELECT r.*, d.* EXCLUDE (doc_id) FROM routed r JOIN dest d ON d.doc_id = r.doc_id"
_LINE = (f"'- **' || city || ', ' || country || '**: ' || {_fix('avg_temp_c', 1)} || ' C on average, around $' || {_fix('cost_per_day_usd', 0)} || ' a day; culture ' || {_fix('culture', 0)}"
         f" || '/10, nature ' || {_fix('nature', 0)} || '/10, beach ' || {_fix('beach', 0)} || '/10'")
CTES["answers"] = f"""SELECT a.qid, 'The destinations that fit best:' || chr(10) || chr(10) || coalesce(l.lines, '') || chr(10) || chr(10) || 'Found by search alone, for the question: ' || a.question AS answer
  FROM asked a LEFT JOIN (SELECT qid, string_agg({_LINE}, chr(10) ORDER BY rank) AS lines FROM hits WHERE rank <= 3 GROUP BY qid) l ON l.qid = a.qid"""


def reg(key, oracle=None):
    return register(key, oracle, CTES)


def _stored(spark, sf, rows):
    """A new stored index with ``rows``."""
    table = ix.index_table(spark, fresh_folder(spark, "index"))
    table.replace(rows)
    return table


def _updates(built):
    dearer = built.where(F.length("city") % 3 == 0).withColumn("cost_per_day_usd", F.col("cost_per_day_usd") + 10)
    return dearer.unionByName(built.where(F.length("city") % 4 == 1).withColumn("city", F.concat("city", F.lit(" Nova"))))


_INDEX_SQL = f"SELECT city, country, md5({_DOC}) AS content_md5, '{ix.LOCAL_MODEL}' AS embedding_model"


def _index_out(index):
    return index.select("city", "country", F.md5("content").alias("content_md5"), "embedding_model")


@reg("destination_document", f"SELECT city, country, {_DOC} AS content FROM built")
def q_destination_document(spark, sf):
    return mp.catalog(spark, sf).select("city", "country", ix.destination_document().alias("content"))


_META = " || ',' || ".join(f"""'"{c}":' || CASE WHEN {c} IS NULL THEN 'null' ELSE '"' || {c} || '"' END""" if c in ("city", "country", "region") else
                           f"""'"{c}":' || coalesce(format('{{:.1f}}', floor({c})), 'null')""" for c in ix.METADATA)


@reg("document_metadata", f"SELECT city, country, '{{' || {_META} || '}}' AS metadata_json FROM built")
def q_document_metadata(spark, sf):
    """V2; numbers are cut to whole ones first, so that both engines write them alike."""
    whole = mp.catalog(spark, sf).select("city", "country", "region", *[F.floor(c).cast("double").alias(c) for c in ix.METADATA[3:]])
    return whole.select("city", "country", ix.document_metadata().alias("metadata_json"))


@reg("build_index", f"""SELECT city, country, md5(content) AS content_md5, '{ix.LOCAL_MODEL}' AS embedding_model, CAST(count(h.bucket) AS INTEGER) AS n_buckets, {r6('max(h.weight)')} AS top_weight
FROM dest d LEFT JOIN dest_hv h ON h.doc_id = d.doc_id GROUP BY ALL""")
def q_build_index(spark, sf):
    """V7: the index of the whole catalogue, written and read back."""
    index = _stored(spark, sf, ix.index_rows(mp.catalog(spark, sf), FIRST)).read()
    return index.select(
        "city", "country", F.md5("content").alias("content_md5"), "embedding_model", F.size("buckets").alias("n_buckets"), boundary(F.array_max("weights")).alias("top_weight"))


@reg("index_replace_load", f"{_INDEX_SQL} FROM upserted")
def q_index_replace_load(spark, sf):
    """A stored index is replaced by rows that hold some keys twice; the last write of a key wins."""
    built = mp.catalog(spark, sf)
    table = _stored(spark, sf, ix.index_rows(built.where(F.length("city") % 2 == 0), FIRST))
    twice = built.withColumn("n", F.lit(1)).unionByName(_updates(built).withColumn("n", F.lit(2)))
    table.replace(ix.index_rows(twice, SECOND, "n"))
    return _index_out(table.read())


@reg("index_upsert", f"{_INDEX_SQL} FROM upserted")
def q_index_upsert(spark, sf):
    """V8: later rows are merged into a stored index."""
    built = mp.catalog(spark, sf)
    table = _stored(spark, sf, ix.index_rows(built, FIRST))
    table.merge(ix.index_rows(_updates(built), SECOND))
    return _index_out(table.read())


@reg("index_stats", f"""SELECT count(*) AS n_rows, '{ix.LOCAL_MODEL}' AS model, '{ix.LABEL_LOCAL}' AS label, 'all' AS of FROM built
UNION ALL SELECT 0, NULL, '{ix.LABEL_NONE}', 'none'""")
def q_index_stats(spark, sf):
    """V9 of the whole index, and of one that holds nothing."""
    index = ix.index_rows(mp.catalog(spark, sf), FIRST)
    return ix.index_stats(index).withColumn("of", F.lit("all")).unionByName(ix.index_stats(index.where("false")).withColumn("of", F.lit("none")))


def _questions(spark, sf):
    b = tb.read_table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "main").otherwise("curated").alias("corpus"))


def _documents(spark, sf):
    corpus = F.when(F.col("source_dataset").isNull(), "curated").otherwise("main")
    return mp.catalog(spark, sf).select("*", F.concat_ws(", ", "city", "country").alias("doc_id"), corpus.alias("corpus"), ix.destination_document().alias("content"))


def hits(spark, sf):
    docs = _documents(spark, sf)
    index = ix.rv.hashed_rows(docs.where(F.col("corpus") == "main").select("corpus", "doc_id", "content"), "content")
    found = ix.retrieve(_questions(spark, sf), docs.select("corpus", "doc_id", "content"), index)
    return found.join(docs.drop("corpus"), "doc_id")


@reg("retrieve_route", f"SELECT qid, doc_id, rank, {r6('similarity')} AS similarity, retrieval_mode FROM routed")
def q_retrieve_route(spark, sf):
    return hits(spark, sf).select("qid", "doc_id", "rank", boundary("similarity").alias("similarity"), "retrieval_mode")


@reg("grounded_answer", "SELECT qid, answer FROM answers")
def q_grounded_answer(spark, sf):
    return ix.grounded_answer(_questions(spark, sf), hits(spark, sf)).select("qid", "answer")


@reg("cited_context", "SELECT qid, string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY qid")
def q_cited_context(spark, sf):
    return ix.cited_context(hits(spark, sf))


@reg("answer_with_sources", f"""SELECT a.qid, a.answer, CAST(count(*) AS INTEGER) AS n_sources, string_agg(h.city || '/' || h.country, '|' ORDER BY h.rank) AS sources,
  any_value(h.retrieval_mode) AS retrieval_mode, '{ix.ANSWER_MODE}' AS generation_mode FROM answers a JOIN hits h ON h.qid = a.qid GROUP BY a.qid, a.answer""")
def q_answer_with_sources(spark, sf):
    """V17; the nested sources are shown as their number and their names in order."""
    a = ix.answer_with_sources(_questions(spark, sf), hits(spark, sf))
    names = F.array_join(F.transform("sources", lambda s: F.concat_ws("/", s["city"], s["country"])), "|")
    return a.select("qid", "answer", F.size("sources").alias("n_sources"), names.alias("sources"), "retrieval_mode", "generation_mode")
