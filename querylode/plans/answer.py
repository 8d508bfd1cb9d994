"""Answering a table of questions: retrieve, assemble prompts, take replies, parse and check them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.replies import check_sql, parse_reply
from ..functions.text import question_text
from ..functions.vectors import embed
from ..operators import prompts, render, search
from ..operators.store import KnowledgeBase
from ..session import checkpointed, stored

HIT_COLUMNS = [
    "sql_query", "notebook_path", "context_before", "context_after", "tables_used", "query_type",
]


def embedded(questions: DataFrame, embedder=None) -> DataFrame:
    """qid, question, embedding; a vector column that is already there is kept."""
    if "embedding" in questions.columns:
        return questions
    return questions.withColumn("embedding", (embedder or embed)(question_text(F.col("question"))))


def retrieve(kb: KnowledgeBase, questions: DataFrame, size: int = fv.ANSWER_SIZE, hybrid: bool = True, *,
             filters: dict | None = None, threshold: float | None = None, normalize: str | None = None,
             by_chunks: bool = False) -> DataFrame:
    """The best documents per question (qid, question, embedding).

    ``filters`` (column -> allowed values) restrict the searched documents; the weights of words stay those of the whole
    base. Hits below ``threshold`` are left out. ``normalize='minmax'`` scales both lists of a hybrid search. With
    ``by_chunks`` a document counts with the best of the vectors that ``build(..., chunk_size=...)`` made of its pieces; a
    document loaded without them has no vector then.
    """
    usable = questions.filter(F.col("embedding").isNotNull())
    docs, vectors = kb.documents(), kb.chunks() if by_chunks else None
    if filters:
        docs = docs.filter(search.allowed(docs, filters))
        vectors = vectors.join(docs, ["doc_id", "version"], "left_semi") if by_chunks else None
    if not hybrid:
        hits = search.vector_search(docs, usable, size=size, vectors=vectors, attach=HIT_COLUMNS)
    else:
        index = kb.text_index().among(docs) if filters else kb.text_index()
        hits = search.hybrid_search(
            docs, usable, size=size, index=index, vectors=vectors, normalize=normalize, attach=HIT_COLUMNS
        )
    return search.above_threshold(hits, threshold)


def schemas_for(kb: KnowledgeBase, hits: DataFrame) -> DataFrame:
    """qid, schema_text: the catalog's description of the tables that a question's hits use."""
    return render.schema_of(hits, kb.meta_lines(fv.SCHEMA_DOC[0]))


def prompts_for(kb: KnowledgeBase, questions: DataFrame, hits: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """qid, question, system_prompt, prompt for every question with hits."""
    schemas = schemas_for(kb, hits) if schemas is None else schemas
    patterns = render.patterns_of(hits, kb.meta_lines(fv.PATTERNS_DOC[0]))
    # Merged: schema texts that many questions share take few bytes in files, and would be shipped by way of the driver.
    found = prompts.examples(hits).join(schemas.hint("merge"), "qid", "left").join(patterns, "qid", "left")
    context = prompts.rag_context(found, F.col("schema_text"), F.col("patterns_text"))
    return questions.select("qid", "question").join(context, "qid").select(
        "qid",
        "question",
        F.lit(fv.SYSTEM_PROMPT).alias("system_prompt"),
        prompts.user_prompt(F.col("rag_context"), F.col("question")).alias("prompt"),
    )


def results(questions: DataFrame, hits: DataFrame, replies: DataFrame, schemas: DataFrame | None = None,
            started: float | None = None) -> DataFrame:
    """One row per question: parsed and checked SQL with citations, or the reason why there is none.

    ``questions``: qid, question, embedding. ``replies``: qid, reply. ``schemas``: qid, schema_text, which becomes
    ``schema_context``, empty where there is none. ``execution_time``: seconds from ``started`` (Unix time) to the start of
    the Spark job that reads the row, the same for the whole batch; 0 without ``started``.
    """
    if schemas is None:
        schemas = questions.select("qid", F.lit(None).cast("string").alias("schema_text"))
    now = F.unix_micros(F.current_timestamp()) / 1e6
    took = F.lit(0.0) if started is None else F.greatest(now - F.lit(started), F.lit(0.0))
    joined = (
        questions.select("qid", "question", F.col("embedding").isNotNull().alias("embedded"))
        .join(search.citations(hits), "qid", "left")
        .join(schemas.select("qid", "schema_text").hint("merge"), "qid", "left")
        .join(replies.select("qid", parse_reply(F.col("reply")).alias("r")), "qid", "left")
    )
    stated = F.coalesce("r.sql_query", F.lit(""))
    error = (
        F.when(~F.col("embedded"), fv.MSG_NO_EMBEDDING)
        .when(F.col("citations").isNull(), fv.MSG_NO_HITS)
        .when(stated == "", fv.MSG_NO_SQL)
    )
    good = F.col("error").isNull()
    none_cited = F.array().cast(joined.schema["citations"].dataType)
    checked = check_sql(F.col("sql_query"))
    return (
        joined.withColumn("error", error)
        .select(
            "qid",
            "question",
            F.when(good, stated).otherwise("").alias("sql_query"),
            F.when(good, F.col("r.confidence")).otherwise(0.0).alias("confidence"),
            F.coalesce("error", "r.explanation").alias("explanation"),
            F.when(good, F.col("citations")).otherwise(none_cited).alias("citations"),
            F.coalesce("schema_text", F.lit("")).alias("schema_context"),
            took.alias("execution_time"),
        )
        .withColumn("validation", checked)
    )


def answer(kb: KnowledgeBase, questions: DataFrame, reply, size: int = fv.ANSWER_SIZE,
           hybrid: bool = True, embedder=None, **options) -> DataFrame:
    """``results`` for every question (qid, question); ``options`` are those of ``retrieve``.

    ``reply`` maps the table of prompts (qid, question, system_prompt, prompt) to a table of
    replies (qid, reply), for example a join with stored replies or a pandas UDF on ``prompt``.
    """
    started = time.time()
    asked = embedded(questions, embedder)
    # At most ``size`` rows per question, needed for the prompts and for the citations: found once.
    hits = checkpointed(retrieve(kb, asked, size, hybrid, **options))
    schemas = stored(schemas_for(kb, hits), "schemas")
    return results(asked, hits, reply(prompts_for(kb, asked, hits, schemas)), schemas, started)
