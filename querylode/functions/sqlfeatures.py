"""Structural features of one SQL text as column expressions over its cleaned form.

All inputs named ``clean`` are the output of ``text.clean_sql`` held in a column, so that the
clean-up runs once per row. Nothing here parses SQL: features are regular-expression matches, and what depends on
parentheses comes from one walk over the tokens with a running depth (``functions.depth``), linear in the length of
the text. Tokens are cut once per row where they are given as a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from . import depth, scopes
from .text import clean_sql, strip

_LITERAL = r"'[^']*'"
_TOKEN = r"(?sU)'[^']*'|\"[^\"]*\"|\w+|\s+|."
_RELATION = r"(?iU)\b(?:FROM|JOIN|INTO|UPDATE)\s+([\w.]+)"
_SUFFIXED = r"(?iU)\b(\w+(?:" + "|".join(fv.TABLE_SUFFIXES) + r"))\b"
_NEXT_CTE = r"(?iU),\s*(\w+)\s*(?:\(\)\s*)?AS\s*(?:NOT\s+)?(?:MATERIALIZED\s*)?\(\)"
_AGGREGATION_CALL = r"(?U)\b(" + "|".join(fv.AGGREGATIONS) + r")\s*\("
_CALLED_DATE = [n for n in fv.DATE_FUNCTIONS if n not in fv.BARE_DATE_FUNCTIONS]
_DATE_FUNCTION = (
    r"(?U)\b(" + "|".join(fv.BARE_DATE_FUNCTIONS)
    + "|(?:" + "|".join(_CALLED_DATE) + r")(?=\s*\())\b"
)
_STEP = (
    r"(?iU)'[^']*'|\(|\)|\b(?:(FROM)|(?:(INNER|LEFT|RIGHT|FULL|CROSS)\s+)?(?:OUTER\s+)?JOIN)"
    r"\s+([\w.]+)"
)

JOIN_TYPE = "array<struct<left_table:string,right_table:string,join_type:string>>"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _sorted_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def _words(values) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def query_type(clean: Column) -> Column:
    found = F.upper(
        F.regexp_extract(clean, r"(?i)^(" + "|".join(fv.STATEMENT_KEYWORDS) + r")\b", 1)
    )
    return F.when(found == "", "UNKNOWN").otherwise(found)


def tokens(clean: Column) -> Column:
    """Literals, words, runs of blanks and single other characters, in order."""
    return _all(clean, _TOKEN, 0)


def outline(clean: Column, toks: Column | None = None) -> Column:
    """The text outside all parentheses; every parenthesised part becomes ``()``."""
    return depth.outline(tokens(clean) if toks is None else toks)


def cte_names_first(clean: Column) -> Column:
    """Names that directly follow WITH."""
    return _sorted_set(_all(clean, fv.FIRST_CTE))


def cte_names(clean: Column, toks: Column | None = None) -> Column:
    """Names that follow WITH anywhere, and the further names of a leading WITH list."""
    named = clean.rlike(r"(?iU)\bWITH\s")
    outside = depth.outline(F.when(named, tokens(clean) if toks is None else toks))
    later = F.when(outside.rlike(r"(?iU)^WITH\b"), _all(outside, _NEXT_CTE)).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(
        named, _sorted_set(F.concat(_all(clean, fv.FIRST_CTE), later))
    ).otherwise(F.array().cast("array<string>"))


def suffix_tables(clean: Column) -> Column:
    return _sorted_set(_all(clean, _SUFFIXED))


def tables(clean: Column, ctes: Column) -> Column:
    """Targets of FROM, JOIN, INTO and UPDATE and names with a table suffix, less the CTE names."""
    return _sorted_set(
        F.array_except(F.concat(_all(clean, _RELATION), _all(clean, _SUFFIXED)), ctes)
    )


def columns(clean: Column, table_names: Column, ctes: Column) -> Column:
    """Identifiers that are neither SQL words, nor called, nor tables, nor CTEs."""
    bare = F.regexp_replace(clean, _LITERAL, " ")
    bare = F.regexp_replace(bare, r"(?U)\b\w+\s*\(", "(")
    bare = F.regexp_replace(bare, r"(?U)\b\w+\.", "")
    names = _all(bare, r"(?U)\b([\p{L}_]\w*)\b")
    table_ends = F.transform(table_names, lambda t: F.element_at(F.split(t, r"\."), -1))
    kept = F.array_except(names, F.concat(table_ends, ctes))
    sql_words = _words(fv.SQL_WORDS)
    return _sorted_set(F.filter(kept, lambda n: ~F.array_contains(sql_words, F.upper(n))))


def qualified_columns(clean: Column, ctes: Column, toks: Column | None = None) -> Column:
    """(table_name, column_name) of the columns written with a qualifier, whose alias is resolved (``scopes``).

    ``table_name`` is null for columns of derived tables, of CTEs and of what the text does not declare.
    """
    dotted = clean.contains(".")  # else there is no qualifier, and nothing to walk over
    found = scopes.qualified(F.when(dotted, tokens(clean) if toks is None else toks))
    stored = F.transform(
        F.when(dotted, found).otherwise(F.array().cast(scopes.QUALIFIED)),
        lambda c: F.struct(
            F.when(~F.array_contains(ctes, c["table_name"]), c["table_name"]).alias("table_name"),
            c["column_name"].alias("column_name"),
        ),
    )
    return F.array_sort(F.array_distinct(stored))


def joins_raw(clean: Column) -> Column:
    """(left, right, type) of four overlapping patterns on the upper-cased text, pattern by pattern."""
    upper = F.upper(clean)

    def one(pattern):
        zipped = F.arrays_zip(
            _all(upper, pattern, 0).alias("text"),
            _all(upper, pattern, 1).alias("l"),
            _all(upper, pattern, 2).alias("r"),
        )
        return F.transform(
            zipped,
            lambda m: F.struct(
                m["l"].alias("left_table"),
                m["r"].alias("right_table"),
                F.when(m["text"].contains("LEFT"), "LEFT")
                .when(m["text"].contains("RIGHT"), "RIGHT")
                .when(m["text"].contains("FULL"), "FULL")
                .otherwise("INNER")
                .alias("join_type"),
            ),
        )

    return F.concat(*[one(p) for p in fv.JOIN_RAW])


def joins(clean: Column) -> Column:
    """One (left, right, type) per JOIN; left is the relation before it at its own nesting level."""
    joining = clean.rlike(r"(?iU)\bJOIN\s")
    found = depth.joins(*[F.when(joining, _all(clean, _STEP, group)) for group in range(4)])
    return F.when(joining, found).otherwise(F.array().cast(JOIN_TYPE))


def filters(clean: Column, toks: Column | None = None) -> Column:
    """Conditions of the outermost WHERE clauses, in order, cut at AND and OR outside parentheses.

    The AND of a BETWEEN does not cut.
    """
    texts = F.transform(depth.conditions(tokens(clean) if toks is None else toks), strip)
    return F.when(
        clean.rlike(r"(?iU)\bWHERE\b"), F.filter(texts, lambda t: F.length(t) > 0)
    ).otherwise(F.array().cast("array<string>"))


def aggregations(clean: Column) -> Column:
    """Aggregation functions called."""
    return _sorted_set(_all(F.upper(clean), _AGGREGATION_CALL))


def date_functions(clean: Column) -> Column:
    """Date functions called, and those that need no parentheses."""
    return _sorted_set(_all(F.upper(clean), _DATE_FUNCTION))


def functions(clean: Column, dates: Column) -> Column:
    """Every word before an opening parenthesis, upper-cased, and the date functions."""
    return _sorted_set(F.concat(_all(F.upper(clean), fv.CALL), dates))


def subqueries_raw(clean: Column) -> Column:
    """From each ``(SELECT`` to the next closing parenthesis."""
    return _all(clean, fv.SUBQUERY_RAW, 0)


def subqueries(clean: Column, toks: Column | None = None) -> Column:
    """Each parenthesised SELECT with balanced parentheses, in order of its end."""
    nested = clean.rlike(r"(?iU)\(\s*SELECT\b")
    found = depth.selects(F.when(nested, tokens(clean) if toks is None else toks))
    return F.when(nested, found).otherwise(F.array().cast("array<string>"))


def is_business_calculation(sql: Column) -> Column:
    return F.lower(sql).rlike("|".join(fv.BUSINESS_KEYWORDS))


def is_date_filter(condition: Column) -> Column:
    return F.lower(condition).rlike("|".join(fv.DATE_WORDS))


def with_features(extracts, sql_column: str = "sql_query"):
    """Add query_type, tables, columns, qualified_columns, joins, filters, aggregations, functions, subqueries, ctes."""
    c, toks = F.col("clean_sql"), F.col("_tokens")
    return (
        extracts.withColumn("clean_sql", F.coalesce(clean_sql(F.col(sql_column)), F.lit("")))
        .withColumn("_tokens", tokens(c))
        .withColumns(
            {
                "query_type": query_type(c),
                "cte_names": cte_names(c, toks),
                "joins": joins(c),
                "filters": filters(c, toks),
                "aggregations": aggregations(c),
                "date_functions": date_functions(c),
                "subqueries": subqueries(c, toks),
            }
        )
        .withColumn("qualified_columns", qualified_columns(c, F.col("cte_names"), toks))
        .drop("_tokens")
        .withColumn("tables", tables(c, F.col("cte_names")))
        .withColumns(
            {
                "columns": columns(c, F.col("tables"), F.col("cte_names")),
                "functions": functions(c, F.col("date_functions")),
            }
        )
    )

