"""Batch retrieval: the best documents for every row of a table of questions.

Text search is BM25 over several boosted fields (best field wins) from stored postings, vector search is exact cosine,
hybrid search is their weighted sum, with the vector part counting only for a question's own best
``size`` documents by vector. Scores are rounded to six decimals and ties go to the smaller id.

Text search joins postings (``text_index``). For vectors, documents are read once and never shuffled: each task scores its
batches against the questions and keeps the best ``size`` per question, and only those reach the final ranking. The
questions are shipped to the tasks in blocks of at most ``MAX_QUESTIONS``, each a pass over the vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import fixed_values as fv
from ..functions.text import terms
from ..session import small_tasks, stored
from . import text_index
from .block_scoring import QuestionBlock, best_documents

# Questions that are shipped to every task at once.
MAX_QUESTIONS = 4096


def _word_rows(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, dl: every distinct word per document and field, and one row with '' for it all."""
    per_field = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("tokens")) for f in fields])
    )
    rows = docs.select(per_field.alias("x")).select("x.field", "x.tokens")
    return rows.filter(F.size("tokens") > 0).select(
        "field",
        F.explode(F.concat(F.array(F.lit("")), F.array_distinct("tokens"))).alias("term"),
        F.size("tokens").alias("dl"),
    )


def term_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, df, total: document frequencies; the row with term '' counts the field itself.

    For that row ``df`` is the number of documents with the field and ``total`` its words.
    """
    rows = _word_rows(docs, fields)
    return rows.groupBy("field", "term").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("total")
    )


def postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, doc_id, tf."""
    return text_index.postings(docs, fields).filter(F.col("term") != "").select("field", "term", "doc_id", "tf")


def _by_vector(docs: DataFrame, questions: DataFrame, size: int, repeated: bool = False) -> DataFrame:
    """qid, doc_id, vector_score: the best ``size`` documents of every question, and others.

    With ``repeated`` a document has several rows, of which the best counts.
    """
    schema = T.StructType(
        [
            T.StructField("qid", questions.schema["qid"].dataType),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("vector_score", T.DoubleType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    scored = docs.select("doc_id", "embedding").filter(F.col("embedding").isNotNull())

    def against(rows: list) -> DataFrame:
        block = QuestionBlock(rows)

        # The block travels with the function; Spark broadcasts large functions by itself.
        def score(batches):
            yield best_documents(batches, block, size, arrow_schema, repeated)

        return scored.mapInArrow(score, schema)

    found, rows = None, []
    for row in questions.select("qid", "embedding").toLocalIterator():
        rows.append(row.asDict())
        if len(rows) == MAX_QUESTIONS:
            found, rows = against(rows) if found is None else found.unionByName(against(rows)), []
    if found is None or rows:
        found = against(rows) if found is None else found.unionByName(against(rows))
    # A document that is among the best by all its rows is so in the task that has its best row.
    return found.groupBy("qid", "doc_id").agg(F.max("vector_score").alias("vector_score")) if repeated else found


def search(
    docs: DataFrame,
    questions: DataFrame,
    *,
    fields: dict[str, float] | None = None,
    use_vector: bool = False,
    size: int = fv.SEARCH_SIZE,
    alpha: float = fv.HYBRID_ALPHA,
    index: text_index.TextIndex | None = None,
    normalize: str | None = None,
    vectors: DataFrame | None = None,
    attach: list[str] | None = None,
) -> DataFrame:
    """qid, rank, doc_id, score, text_score, vector_score and the attached document columns.

    ``docs``: doc_id, the text ``fields`` (name -> boost) and ``embedding``.
    ``questions``: qid (unique), question for text search, embedding for vector search.
    ``index``: the stored text index of the same documents; without it one is written to the shared folder.
    ``normalize='minmax'``: hybrid search brings the scores of both lists of a question (its best ``size`` by text and by
    vector) to 0 to 1 before their sum; a list of equal scores counts 1, what is in one list alone counts 0 in the other.
    ``vectors``: doc_id, embedding, any number of rows for each of ``docs``, of which the best counts, instead of their own.
    """
    hybrid = bool(fields) and use_vector
    none = F.lit(None).cast("double")
    by_vector = None
    if use_vector:
        near_by = _by_vector(docs if vectors is None else vectors, questions, size, vectors is not None)
        # Found at once, not with what is made of it: so the rows that go to Python are few at a time.
        with small_tasks(docs.sparkSession, text_index.LOAD_SPLIT):
            by_vector = stored(best_first(near_by, "vector_score", size), "nearest")
    if fields:
        index = index or text_index.write(docs, list(fields))
        # Of the documents without a vector hit the best ``size`` by text are among the best 2 * size of all.
        near = 1e-6 / max(1 - alpha, 1e-12) if hybrid else 1e-6
        found = text_index.best_by_text(index, questions, fields, 2 * size if hybrid else size, by_vector if hybrid else None, near)
    if not hybrid:
        found = found.withColumn("vector_score", none) if fields else by_vector.withColumn("text_score", none)
        score = F.col("text_score") if fields else F.col("vector_score")
    elif normalize == "minmax":
        found = _scaled(best_first(found, "text_score", size), "text_score").join(_scaled(by_vector, "vector_score"), ["qid", "doc_id"], "full")
        score = (1 - alpha) * F.coalesce("text_unit", F.lit(0.0)) + alpha * F.coalesce("vector_unit", F.lit(0.0))
    else:
        found = found.join(by_vector, ["qid", "doc_id"], "full")
        score = (1 - alpha) * F.coalesce("text_score", F.lit(0.0)) + alpha * F.coalesce("vector_score", F.lit(0.0))
    ranking = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    hits = (
        found.withColumn("score", F.round(score, 6))
        .withColumn("rank", F.row_number().over(ranking).cast("long"))
        .filter(F.col("rank") <= size)
        .select(
            "qid",
            "rank",
            "doc_id",
            "score",
            F.round(F.coalesce("text_score", F.lit(0.0)), 6).alias("text_score"),
            F.round("vector_score", 6).alias("vector_score"),
        )
    )
    # At most ``size`` hits per question; Spark ships them if they are few.
    return docs.select("doc_id", *attach).join(hits, "doc_id") if attach else hits


def best_first(found: DataFrame, score: str, size: int) -> DataFrame:
    """The best ``size`` rows per question by rounded score, then by id."""
    order = W.partitionBy("qid").orderBy(F.desc_nulls_last(F.round(score, 6)), "doc_id")
    return found.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= size).drop("_place")


def _scaled(found: DataFrame, score: str) -> DataFrame:
    """Add text_unit or vector_unit: the rounded score between the least and the largest of its question's list."""
    of = W.partitionBy("qid")
    value = F.round(score, 6)
    least, most = F.min(value).over(of), F.max(value).over(of)
    unit = F.when(most == least, F.lit(1.0)).otherwise((value - least) / (most - least))
    return found.withColumn(score.replace("_score", "_unit"), unit)


def text_search(docs, questions, fields=None, **options) -> DataFrame:
    return search(docs, questions, fields=fields or fv.FIELD_BOOSTS, **options).drop("vector_score")


def vector_search(
    docs: DataFrame,
    questions: DataFrame,
    size: int = fv.SEARCH_SIZE,
    filters: dict | None = None,
    mode: str = "pre",
    scale: str = "raw",
    vectors: DataFrame | None = None,
    attach: list[str] | None = None,
) -> DataFrame:
    """Nearest documents by cosine.

    ``filters`` (column -> allowed values) restrict the searched documents (``mode='pre'``) or the
    hits (``'post'``, which can leave fewer than ``size``). ``scale='half'`` reports (1+cos)/2.
    """
    if mode == "pre" and filters:
        docs = docs.filter(allowed(docs, filters))
    wanted = list(dict.fromkeys((attach or []) + (list(filters) if filters and mode == "post" else [])))
    hits = search(docs, questions, use_vector=True, size=size, vectors=vectors, attach=wanted).drop(
        "text_score", "vector_score"
    )
    if mode == "post" and filters:
        hits = hits.filter(allowed(hits, filters)).drop(*[c for c in wanted if c not in (attach or [])])
    if scale == "half":
        hits = hits.withColumn("score", F.round((1 + F.col("score")) / 2, 6))
    return hits


def hybrid_search(docs, questions, fields=None, **options) -> DataFrame:
    return search(docs, questions, fields=fields or fv.FIELD_BOOSTS, use_vector=True, **options)


def allowed(df: DataFrame, filters: dict) -> Column:
    condition = F.lit(True)
    for name, values in filters.items():
        if df.schema[name].dataType.typeName() == "array":
            condition &= F.arrays_overlap(name, F.array(*[F.lit(v) for v in values]))
        else:
            condition &= F.col(name).isin(list(values))
    return condition


def above_threshold(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Hits with at least the given score; all hits if there is no threshold."""
    return hits if threshold is None else hits.filter(F.col("score") >= threshold)


def citations(hits: DataFrame) -> DataFrame:
    """qid, citations: the hits of each question by rank, with empty values for missing ones."""
    text = {n: F.coalesce(n, F.lit("")) for n in (
        "sql_query", "notebook_path", "context_before", "context_after", "query_type")}
    entry = F.struct(
        "rank",
        text["sql_query"].alias("sql_query"),
        F.col("score").alias("similarity_score"),
        text["notebook_path"].alias("notebook_path"),
        text["context_before"].alias("context_before"),
        text["context_after"].alias("context_after"),
        F.coalesce("tables_used", F.array().cast("array<string>")).alias("tables_used"),
        text["query_type"].alias("query_type"),
    )
    return hits.groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("citations"))
