"""Column helpers for model replies and generated SQL: parse, tidy and check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import collapse_spaces, drop_comments, strip


def tidy_sql(sql: Column) -> Column:
    """SQL on one line without fences and comments, with exactly one ``;``; '' stays ''."""
    bare = F.replace(F.replace(sql, F.lit("```sql"), F.lit("")), F.lit("```"), F.lit(""))
    flat = collapse_spaces(drop_comments(bare))
    return F.when(F.length(sql) > 0, F.concat(F.regexp_replace(flat, ";+$", ""), F.lit(";"))).otherwise(
        ""
    )


def parse_reply(reply: Column) -> Column:
    """Struct of sql_query, confidence and explanation stated in a reply."""
    stated = [
        F.nullif(F.regexp_extract(reply, p, 1), F.lit("")) for p in fv.REPLY_SQL_PATTERNS
    ]
    sql = strip(F.coalesce(*stated, F.lit("")))
    number = F.regexp_replace(
        F.regexp_extract(reply, fv.REPLY_CONFIDENCE_PATTERN, 1), r"\.+$", ""
    )
    explained = F.when(
        reply.rlike(fv.REPLY_EXPLANATION_PATTERN),
        strip(F.regexp_extract(reply, fv.REPLY_EXPLANATION_PATTERN, 1)),
    ).otherwise(reply)
    return F.struct(
        tidy_sql(sql).alias("sql_query"),
        F.coalesce(number.try_cast("double"), F.lit(fv.DEFAULT_CONFIDENCE)).alias("confidence"),
        explained.alias("explanation"),
    )


def check_sql(sql: Column, mode: str = "word") -> Column:
    """Struct of is_valid and message.

    ``mode='word'`` looks for dangerous operations as whole words, ``'substring'`` anywhere.
    """
    upper = F.upper(sql)

    def occurs(name):
        return upper.rlike(rf"\b{name}\b") if mode == "word" else upper.contains(name)

    danger = F.coalesce(
        *[F.when(occurs(n), F.lit(fv.MSG_DANGEROUS + n)) for n in fv.DANGEROUS_OPERATIONS]
    )
    empty = F.coalesce(F.length(sql) == 0, F.lit(True))
    message = F.when(empty, fv.MSG_INVALID).otherwise(F.coalesce(danger, F.lit(fv.MSG_VALID)))
    return F.struct((~empty & danger.isNull()).alias("is_valid"), message.alias("message"))
