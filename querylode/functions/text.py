"""Column helpers for cell text: SQL detection, clean-up, tokens and the texts that get embedded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# Flags: U makes \s and \w Unicode-aware, d makes "\n" the only line end.
_LINE_COMMENT = r"(?md)--.*$"
_BLOCK_COMMENT = r"(?s)/\*.*?\*/"
_STATEMENT_START = (
    r"(?imdU)^\s*(?:" + "|".join(fv.STATEMENT_KEYWORDS) + r")\s+|%sql\s+|%%sql"
)
_MAGIC = r"(?imdU)^\s*%{1,2}sql\s*"


def let(value: Column, body):
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Drop all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def drop_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, _LINE_COMMENT, ""), _BLOCK_COMMENT, "")


def contains_sql(text: Column) -> Column:
    """True where a statement starts on some line or a SQL magic occurs, comments aside."""
    return F.coalesce(drop_comments(text).rlike(_STATEMENT_START), F.lit(False))


def cell_kind(cell_type: Column, source: Column) -> Column:
    """'sql' for code cells with SQL, 'markdown' for markdown cells, else null."""
    return F.when((cell_type == "code") & contains_sql(source), "sql").when(
        cell_type == "markdown", "markdown"
    )


def clean_sql(sql: Column) -> Column:
    """SQL on one line, without notebook magics and comments."""
    return collapse_spaces(drop_comments(F.regexp_replace(sql, _MAGIC, "")))


def clean_sql_for_embedding(sql: Column) -> Column:
    """``clean_sql`` with very long literals replaced by a mark."""
    out = clean_sql(sql)
    for quote in ("'", '"'):
        long_literal = f"{quote}[^{quote}]{{{fv.LONG_LITERAL},}}{quote}"
        out = F.regexp_replace(out, long_literal, f"{quote}{fv.LONG_LITERAL_MARK}{quote}")
    return out


def _labelled(label: str, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(label), text))


def embedding_text(
    sql_query: Column, context_before: Column, context_after: Column, notebook_path: Column
) -> Column:
    """The text embedded for one extract; empty parts are left out."""
    parts = F.split(notebook_path, "/")
    source = F.when(
        F.size(parts) > 1,
        F.concat(F.lit("Source: "), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)),
    )
    query = F.when(
        F.length(strip(sql_query)) > 0,
        F.concat(F.lit("Query: "), clean_sql_for_embedding(sql_query)),
    )
    return F.concat_ws(
        " | ",
        _labelled("Context: ", strip(context_before)),
        query,
        _labelled("Description: ", strip(context_after)),
        source,
    )


def question_text(question: Column) -> Column:
    """The text embedded for one question."""
    lowered = F.lower(question)
    phrases = F.concat_ws(
        ", ", *[F.when(lowered.contains(p), F.lit(p)) for p in fv.SEARCH_PHRASES]
    )
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Question: "), strip(question)),
        _labelled("SQL concepts: ", phrases),
    )


def embeddable(text: Column) -> Column:
    """Null for blank text, else the text."""
    return F.when(F.length(strip(text)) > 0, text)


def terms(text: Column) -> Column:
    """Lower-cased words of a text, in order, with repeats; never null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(words, "")


def chunks(text: Column, size: int) -> Column:
    """The text cut into consecutive pieces of at most ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
