"""Retrieval context and prompts, one per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def examples(hits: DataFrame, top: int = fv.PROMPT_EXAMPLES) -> DataFrame:
    """qid, examples: the best hits of each question as one text."""

    def line(label, text):
        return F.when(F.length(text) > 0, F.concat(F.lit(label), text))

    number = F.col("rank").cast("string")
    one = F.concat_ws(
        "\n",
        F.concat(
            F.lit("\n### Example "),
            number,
            F.format_string(" (similarity: %.3f)", "score"),
        ),
        line("Context: ", F.col("context_before")),
        F.concat(F.lit("SQL: "), "sql_query"),
        line("Description: ", F.col("context_after")),
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", one.alias("text"))))
    return (
        hits.filter(F.col("rank") <= top)
        .groupBy("qid")
        .agg(
            F.concat_ws(
                "\n",
                F.lit(fv.HEAD_EXAMPLES),
                F.array_join(F.transform(ordered, lambda e: e["text"]), "\n"),
            ).alias("examples")
        )
    )


def rag_context(
    examples: DataFrame, schema_text: Column | None = None, patterns_text: Column | None = None
) -> DataFrame:
    """qid, rag_context: schema, patterns and examples of each question.

    The two texts are columns of ``examples``, or, where all questions have the same, literals or scalar subqueries.
    """

    def headed(heading, text):
        if text is None:
            return F.lit(None).cast("string")
        return F.when(F.length(text) > 0, F.concat_ws("\n", F.lit(heading), text))

    return examples.select(
        "qid",
        F.concat_ws(
            "\n",
            headed(fv.HEAD_SCHEMAS, schema_text),
            headed(fv.HEAD_PATTERNS, patterns_text),
            "examples",
        ).alias("rag_context"),
    )


def user_prompt(rag_context: Column, question: Column) -> Column:
    return F.concat(
        F.lit(fv.PROMPT_CONTEXT),
        rag_context,
        F.lit(fv.PROMPT_QUESTION),
        question,
        F.lit(fv.PROMPT_REQUEST),
    )


def newest(log: DataFrame, size: int = fv.HISTORY_SIZE) -> DataFrame:
    """The newest entries of a query log."""
    return log.orderBy(F.desc("asked_at"), *[c for c in log.columns if c != "asked_at"]).limit(size)
