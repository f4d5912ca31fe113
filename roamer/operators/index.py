"""Destination documents, their index, and answers from it.

A destination's document is one text; its vector is hashed in the row (see ``retrieval.hashed_rows``), so building an
index is a projection without a shuffle. The index is a ``KeyedTable`` by (city, country): it is replaced whole, or
merged, and readers see one version or the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roamer.functions.numeric import col_of, half_even
from roamer.operators import retrieval as rv
from roamer.operators.catalog import INTEREST_COLUMNS
from roamer.sources.versioned import KeyedTable

# Name of the built-in vectors, labels of the routes, fields of the metadata in their order.
LOCAL_MODEL = "local-hashing-vectorizer-v1"
LABEL_NONE, LABEL_LOCAL, LABEL_EXTERNAL = "not indexed", "local text vectors", "external embeddings"
ROUTE_VECTOR, ROUTE_TFIDF = "local text vectors + vector table", "local TF-IDF fallback"
ANSWER_MODE = "grounded template fallback"
METADATA = ["city", "country", "region", "cost_per_day_usd", "avg_temp_c", "beach", "culture", "nature", "nightlife", "food", "adventure", "relaxation", "popularity", "safety"]

INDEX = "city string, country string, content string, metadata_json string, buckets array<int>, weights array<double>, embedding_model string, updated_at timestamp, stamp struct<at: timestamp, n: long>"


def fixed(c, digits: int) -> Column:
    """A number as text with so many decimals, rounded half to even; missing reads 0."""
    return F.format_string(f"%.{digits}f", half_even(F.coalesce(col_of(c), F.lit(0.0)), digits))


def strongest(n: int = 3) -> Column:
    """The n highest interests with their values, ties in the order of the list."""
    each = F.array(*[F.struct((-F.coalesce(F.col(c), F.lit(0.0))).alias("low"), F.lit(i).alias("at"), F.concat(F.lit(f"{c} "), fixed(c, 0), F.lit("/10")).alias("text"))
                     for i, c in enumerate(INTEREST_COLUMNS)])
    return F.array_join(F.transform(F.slice(F.array_sort(each), 1, n), lambda s: s["text"]), ", ")


def destination_document() -> Column:
    """V1: the text of a destination. The wording around the values is fixed."""
    parts = [F.col("city"), ", ", F.col("country"), " is in ", F.regexp_replace("region", "_", " "), ". ", F.coalesce("description", F.lit("")),
             " Typical annual temperature: ", fixed("avg_temp_c", 1), " C. Estimated base daily cost: ", fixed("cost_per_day_usd", 0),
             " USD. Strongest travel qualities: ", strongest(), ". Safety rating: ", fixed("safety", 0), "/10. Popularity rating: ", fixed("popularity", 0), "/10."]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def document_metadata() -> Column:
    """V2: the metadata fields as JSON text, missing ones as nulls."""
    return F.to_json(F.struct(*METADATA), {"ignoreNullFields": "false"})


def index_rows(destinations: DataFrame, updated_at, ordinal=None, vectors: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """V7: index rows of destinations. ``vectors`` (city, country, buckets, weights) of an outside ``model`` are taken
    if every destination has one, else all are hashed here."""
    order = F.lit(0).cast("long") if ordinal is None else F.col(ordinal).cast("long")
    rows = destinations.select("city", "country", destination_document().alias("content"), document_metadata().alias("metadata_json"),
                               F.lit(updated_at).cast("timestamp").alias("updated_at"), order.alias("n"))
    outside = vectors is not None and rows.join(vectors, ["city", "country"], "left_anti").isEmpty()
    if outside:
        rows = rows.join(vectors.select("city", "country", "buckets", "weights"), ["city", "country"])
    else:
        rows = rv.hashed_rows(rows, "content")
    return rows.select("city", "country", "content", "metadata_json", "buckets", "weights", F.lit(model if outside else LOCAL_MODEL).alias("embedding_model"),
                       "updated_at", F.struct(F.col("updated_at").alias("at"), "n").alias("stamp"))


def index_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """The stored index; the later ``updated_at``, then the larger ordinal, wins a key."""
    return KeyedTable(spark, path, INDEX, ["city", "country"], "stamp", buckets)


def index_stats(index: DataFrame) -> DataFrame:
    """V9: number of rows, the stored model (the first by name) and its label; one row, also of an empty index."""
    s = index.agg(F.count(F.lit(1)).alias("n_rows"), F.min("embedding_model").alias("model"))
    label = F.when(F.col("model").isNull(), LABEL_NONE).when(F.col("model") == LOCAL_MODEL, LABEL_LOCAL).otherwise(LABEL_EXTERNAL)
    return s.select("n_rows", "model", label.alias("label"))


# ------------------------------------------------------------------ routes

def vector_hits(questions: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, corpus, doc_id, similarity, rank) by cosine of hashed vectors within a question's corpus.

    Only documents that share a bucket are scored; the k first of a corpus by name fill up with 0.
    """
    q = rv.hashed_rows(questions, "question").select("qid", "corpus", F.explode(F.arrays_zip("buckets", "weights")).alias("e")).select(
        "qid", "corpus", F.col("e.buckets").alias("bucket"), F.col("e.weights").alias("qw"))
    d = index.select("corpus", "doc_id", F.explode(F.arrays_zip("buckets", "weights")).alias("e")).select(
        "corpus", "doc_id", F.col("e.buckets").alias("bucket"), F.col("e.weights").alias("dw"))
    sims = q.join(d, ["corpus", "bucket"]).groupBy("qid", "corpus", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("similarity"))
    return rv.rank_hits(_filled(sims, questions, index, k), "qid", k)


def _filled(sims: DataFrame, questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Hits and, with similarity 0, the k first documents of the question's corpus by id."""
    w = Window.partitionBy("corpus").orderBy("doc_id")
    first = docs.select("corpus", "doc_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    fill = questions.select("qid", "corpus").join(first, "corpus").withColumn("similarity", F.lit(0.0))
    both = sims.select("qid", "corpus", "doc_id", "similarity").unionByName(fill.select("qid", "corpus", "doc_id", "similarity"))
    return both.groupBy("qid", "corpus", "doc_id").agg(F.max("similarity").alias("similarity"))


def tfidf_hits(questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, corpus, doc_id, similarity, rank): ``retrieval.tfidf_topk`` with each question in a corpus of its own kind.

    docs: corpus, doc_id, content. Document frequencies, sizes and norms are by corpus.
    """
    count = F.count(F.lit(1))
    terms = lambda df, keys, text: df.select(*keys, F.explode(rv.T.drop_stop_words(rv.T.tokens(text))).alias("term")).groupBy(*keys, "term").agg(count.alias("tf"))
    post = terms(docs, ["corpus", "doc_id"], "content")
    sizes = docs.groupBy("corpus").agg((count + 1).alias("n"))  # the question is one of the fitted texts
    df = post.groupBy("corpus", "term").agg(count.alias("df")).join(sizes, "corpus")
    idf = lambda more: F.log((1 + F.col("n")) / (1 + F.col("df") + more)) + 1
    df = df.withColumn("idf0", idf(0)).withColumn("idf1", idf(1))
    base = post.join(df, ["corpus", "term"]).groupBy("corpus", "doc_id").agg(F.sum(F.pow(F.col("tf") * F.col("idf0"), 2)).alias("base"))
    asked = terms(questions, ["corpus", "qid"], "question").withColumnRenamed("tf", "qtf").join(sizes, "corpus")
    asked = asked.join(df.drop("n"), ["corpus", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    asked = asked.withColumn("idf1", F.coalesce("idf1", idf(1)))
    norm = asked.groupBy("qid").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf1"), 2))).alias("qnorm"))
    met = asked.join(post, ["corpus", "term"])
    pairs = met.groupBy("qid", "corpus", "doc_id").agg(
        F.sum(F.col("qtf") * F.col("tf") * F.pow("idf1", F.lit(2))).alias("dot"),
        F.sum(F.pow("tf", F.lit(2)) * (F.pow("idf1", F.lit(2)) - F.pow("idf0", F.lit(2)))).alias("more"))
    sims = pairs.join(base, ["corpus", "doc_id"]).join(norm, "qid").withColumn("similarity", F.col("dot") / (F.col("qnorm") * F.sqrt(F.col("base") + F.col("more"))))
    return rv.rank_hits(_filled(sims, questions, docs, k), "qid", k)


def retrieve(questions: DataFrame, docs: DataFrame, index: DataFrame, k: int = rv.TOP_K) -> DataFrame:
    """Questions (qid, corpus, question) answered by vectors where their corpus has index rows, else by TF-IDF
    over its documents. docs: corpus, doc_id, content; index: corpus, doc_id, buckets, weights."""
    indexed = index.select("corpus").distinct()
    by_vector = vector_hits(questions.join(indexed, "corpus", "left_semi"), index, k).withColumn("retrieval_mode", F.lit(ROUTE_VECTOR))
    rest = questions.join(indexed, "corpus", "left_anti")
    by_terms = tfidf_hits(rest, docs.join(indexed, "corpus", "left_anti"), k).withColumn("retrieval_mode", F.lit(ROUTE_TFIDF))
    return by_vector.unionByName(by_terms)


# ------------------------------------------------------------------ answers

def _ordered(hits: DataFrame, text: Column, sep: str, name: str, first: int | None = None) -> DataFrame:
    """The hits' texts of each question in rank order, joined."""
    rows = hits if first is None else hits.where(F.col("rank") <= first)
    lines = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("l"))
    return lines.select("qid", F.array_join(F.transform("l", lambda x: x["t"]), sep).alias(name))


def cited_context(hits: DataFrame) -> DataFrame:
    """Numbered contents of a question's hits (qid, rank, content)."""
    return _ordered(hits, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("content")), "\n\n", "context")


def grounded_answer(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """An answer from the first three hits (qid, rank and metadata columns), in our own words."""
    out_of = lambda c: F.concat(fixed(c, 0), F.lit("/10"))
    line = F.concat(F.lit("- **"), "city", F.lit(", "), "country", F.lit("**: "), fixed("avg_temp_c", 1), F.lit(" C on average, around $"), fixed("cost_per_day_usd", 0),
                    F.lit(" a day; culture "), out_of("culture"), F.lit(", nature "), out_of("nature"), F.lit(", beach "), out_of("beach"))
    lines = _ordered(hits, line, "\n", "lines", 3)
    text = F.concat(F.lit("The destinations that fit best:\n\n"), F.coalesce("lines", F.lit("")), F.lit("\n\nFound by search alone, for the question: "), F.col("question"))
    return questions.join(lines, "qid", "left").select("qid", "question", text.alias("answer"))


def answer_with_sources(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """A question's answer, its sources in rank order (nested) and how they were found and worded."""
    source = F.struct("rank", "city", "country", "content", "similarity")
    found = hits.groupBy("qid").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.first("retrieval_mode").alias("retrieval_mode"))
    return grounded_answer(questions, hits).join(found, "qid", "left").withColumn("generation_mode", F.lit(ANSWER_MODE))
