"""Text vector and retrieval keys (V) with DuckDB oracles.

Corpus = ``documents(doc_id, text)``; questions = ``benchmark(item_id, text)``;
dense vectors = ``embeddings`` (queries: ids divisible by 50, themselves included).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roamer.functions import text as T
from roamer.functions.numeric import boundary
from roamer.operators import retrieval as rv
from roamer.plans.registry import register
from roamer.plans.sqlgen import r6
from roamer.sources import tables as tb

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOK = f"regexp_extract_all(lower(text), '{T.TOKEN_PATTERN_RE2}')"
_KEEP = f"list_filter({_TOK}, lambda x: NOT list_contains({_STOP}, x))"
_GRAMS = "list_concat(k, list_transform(list_zip(k[:-2], k[2:], true), lambda p: p[1] || ' ' || p[2]))"
_BUCKET = "(('0x' || substr(md5(g), 1, 8))::BIGINT % 1536)"

#: The stated query set of the dense search.
QUERY_STEP = 50

CTES = {
    "doc_grams": f"SELECT doc_id AS id, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {_KEEP} AS k FROM documents)",
    "q_grams": f"SELECT item_id AS id, unnest({_GRAMS}) AS g FROM (SELECT item_id, {_KEEP} AS k FROM benchmark)",
    "doc_hv": f"""SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight
                  FROM (SELECT id, {_BUCKET} AS bucket, count(*) AS n FROM doc_grams GROUP BY ALL)""",
    "q_hv": f"""SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight
                FROM (SELECT id, {_BUCKET} AS bucket, count(*) AS n FROM q_grams GROUP BY ALL)""",
    "d_post": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_KEEP}) AS term FROM documents) GROUP BY ALL",
    "q_post": f"SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_KEEP}) AS term FROM benchmark) GROUP BY ALL",
    "d_df": "SELECT term, count(*) AS df FROM d_post GROUP BY term",
    "n_fit": "SELECT count(*) + 1 AS n FROM documents",
    # document norm under each question's fit: every term of the document, idf with the question counted
    "d_norm": """
      SELECT q.qid, p.doc_id,
             sqrt(sum(power(p.tf * (ln((1 + nf.n) / (1 + f.df + CASE WHEN qp.term IS NULL THEN 0 ELSE 1 END)) + 1), 2))) AS dnorm
      FROM (SELECT DISTINCT item_id AS qid FROM benchmark) q
      CROSS JOIN d_post p JOIN d_df f ON f.term = p.term CROSS JOIN n_fit nf
      LEFT JOIN q_post qp ON qp.qid = q.qid AND qp.term = p.term
      GROUP BY ALL""",
    "q_norm": """
      SELECT qp.qid, sqrt(sum(power(qp.qtf * (ln((1 + nf.n) / (2 + coalesce(f.df, 0))) + 1), 2))) AS qnorm
      FROM q_post qp LEFT JOIN d_df f ON f.term = qp.term CROSS JOIN n_fit nf GROUP BY ALL""",
    "qd_dot": """
      SELECT qp.qid, p.doc_id, sum(qp.qtf * p.tf * power(ln((1 + nf.n) / (2 + f.df)) + 1, 2)) AS dot
      FROM q_post qp JOIN d_post p ON p.term = qp.term JOIN d_df f ON f.term = qp.term CROSS JOIN n_fit nf
      GROUP BY ALL""",
    "tfidf_all": """
      SELECT q.qid, d.doc_id,
             coalesce(x.dot / nullif(qn.qnorm * dn.dnorm, 0), 0.0) AS similarity
      FROM (SELECT DISTINCT item_id AS qid FROM benchmark) q CROSS JOIN documents d
      LEFT JOIN qd_dot x ON x.qid = q.qid AND x.doc_id = d.doc_id
      LEFT JOIN q_norm qn ON qn.qid = q.qid
      LEFT JOIN d_norm dn ON dn.qid = q.qid AND dn.doc_id = d.doc_id""",
}


def reg(key, oracle=None):
    return register(key, oracle, CTES)


def _ranked_sql(src: str) -> str:
    return f"""
SELECT qid, doc_id, {r6('similarity')} AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round_even(similarity * 1000000000.0, 0) / 1000000000.0 DESC, doc_id) AS rank
  FROM {src}) WHERE rank <= 5"""


def _hits_out(df):
    return df.select("qid", "doc_id", boundary("similarity").alias("similarity"), "rank")


def _docs(spark, sf):
    return tb.read_table(spark, sf, "documents").select("doc_id", "text")


def _questions(spark, sf):
    return tb.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@reg("tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOK} AS t FROM documents)")
def q_tokenize(spark, sf):
    t = T.tokens("text")
    return _docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@reg("drop_stop_words", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_KEEP} AS t FROM documents)")
def q_drop_stop_words(spark, sf):
    t = T.drop_stop_words(T.tokens("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@reg("ngrams_1_2", f"SELECT doc_id, len(g) AS n_grams, md5(array_to_string(g, '|')) AS digest FROM (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, {_KEEP} AS k FROM documents))")
def q_ngrams(spark, sf):
    staged = _docs(spark, sf).select("doc_id", T.drop_stop_words(T.tokens("text")).alias("toks"))
    g = staged.select("doc_id", T.ngrams_1_2("toks").alias("g"))
    return g.select("doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("digest"))


@reg("hash_vector", f"SELECT id AS doc_id, bucket, {r6('weight')} AS weight FROM doc_hv")
def q_hash_vector(spark, sf):
    hv = rv.hashed_vectors(_docs(spark, sf), "doc_id", "text")
    return hv.select(F.col("id").alias("doc_id"), "bucket", boundary("weight").alias("weight"))


@reg("sparse_topk", _ranked_sql("""(SELECT q.id AS qid, d.id AS doc_id, sum(q.weight * d.weight) AS similarity
   FROM q_hv q JOIN doc_hv d ON d.bucket = q.bucket GROUP BY ALL)"""))
def q_sparse_topk(spark, sf):
    rows = lambda df, key, text: rv.hashed_rows(df.select(F.col(key).alias("id"), text), text)
    return _hits_out(rv.sparse_topk(rows(_questions(spark, sf), "qid", "question"), rows(_docs(spark, sf), "doc_id", "text")))


@reg("tfidf_topk", _ranked_sql("tfidf_all"))
def q_tfidf_topk(spark, sf):
    return _hits_out(rv.tfidf_topk(_questions(spark, sf), _docs(spark, sf)))


@reg("vector_topk", _ranked_sql("""(SELECT q.vec_id AS qid, d.vec_id AS doc_id,
     coalesce(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])
       / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
              * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])), 0), 0.0) AS similarity
   FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 50 = 0)"""))
def q_vector_topk(spark, sf):
    emb = tb.read_table(spark, sf, "embeddings")
    queries = emb.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    corpus = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return _hits_out(rv.dense_topk(queries, corpus))


@reg("clean_questions", """
SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question FROM conversations
WHERE role = 'user' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def q_clean_questions(spark, sf):
    from roamer.operators.catalog import strip_ws
    conv = tb.read_table(spark, sf, "conversations").where(F.col("role") == "user")
    q = strip_ws(F.col("text"))
    return conv.select("conv_id", "turn", q.alias("question")).where(F.col("question") != "")
