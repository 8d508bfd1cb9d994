"""Rendered descriptions of the catalog and of the mined patterns.

A description is a table of lines with a sort key, however large it is. A prompt gets the lines of the tables that its
own hits use (``schema_of``, ``patterns_of``); ``as_text`` makes one string of few lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..session import shipped, stored
from .schema_match import name_lookup


def schema_lines(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """table_key, ord, line: a heading, the description, the columns and the partition keys.

    ``tables``: table_key, description. ``columns``: table_key, pos, name, type, comment,
    is_partition. ``ord`` orders the lines of one table; tables are ordered by key.
    """
    column_line = F.concat(
        F.lit("  - "),
        "name",
        F.lit(" ("),
        "type",
        F.lit(")"),
        F.when(F.length("comment") > 0, F.concat(F.lit(" - "), "comment")).otherwise(""),
    )
    partition = F.col("is_partition")

    def ordinal(section, pos=0):
        return F.struct(F.lit(section).alias("section"), F.lit(pos).cast("long").alias("pos"))

    heads = tables.select(
        "table_key",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(
                        ordinal(0).alias("ord"),
                        F.concat(F.lit("\n## Table: "), "table_key").alias("line"),
                    ),
                    F.when(
                        F.length("description") > 0,
                        F.struct(
                            ordinal(1).alias("ord"),
                            F.concat(F.lit("Description: "), "description").alias("line"),
                        ),
                    ),
                    F.struct(ordinal(2).alias("ord"), F.lit("Columns:").alias("line")),
                )
            )
        ).alias("l"),
    ).select("table_key", "l.ord", "l.line")
    body = columns.select(
        "table_key",
        F.struct(
            F.when(partition, 5).otherwise(3).alias("section"), F.col("pos").cast("long").alias("pos")
        ).alias("ord"),
        column_line.alias("line"),
    )
    partition_heads = (
        columns.filter(partition)
        .select("table_key")
        .distinct()
        .select("table_key", ordinal(4).alias("ord"), F.lit("Partition Keys:").alias("line"))
    )
    return heads.unionByName(body).unionByName(partition_heads)


def _section(rows: DataFrame, number: int, key: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(number).alias("section"), key.alias("key"), line.alias("line"))


def _listing(rows: DataFrame, item: str, top: int) -> DataFrame:
    """table_name and its first ``top`` items by rank, joined."""
    ranked = F.sort_array(F.collect_list(F.struct("rk", item)))
    names = F.transform(ranked, lambda r: r[item])
    return (
        rows.filter(F.col("rk") <= top)
        .groupBy("table_name")
        .agg(F.array_join(names, ", ").alias("items"))
    )


def pattern_lines(
    relationships: DataFrame, filters: DataFrame, aggregations: DataFrame, dates: DataFrame
) -> DataFrame:
    """section, key, line: the four sections of the pattern description, ordered by (section, key).

    A heading has the empty key. A section without lines has no heading.
    """
    related = relationships.groupBy("left_table").agg(
        F.array_join(F.sort_array(F.collect_set("right_table")), ", ").alias("items")
    )
    first_dates = (
        dates.orderBy("notebook_path", "cell_index", "pos")
        .limit(fv.RENDERED_DATE_FILTERS)
        .select("filter")
        .distinct()
    )
    table, dash = F.col("table_name"), F.lit("- ")
    named = F.concat(dash, table, F.lit(": "), "items")
    joined = F.concat(dash, "left_table", F.lit(" commonly joined with: "), "items")
    body = (
        _section(related, 1, F.col("left_table"), joined)
        .unionByName(_section(_listing(filters, "filter", fv.RENDERED_PATTERNS), 2, table, named))
        .unionByName(_section(_listing(aggregations, "agg", fv.RENDERED_PATTERNS), 3, table, named))
        .unionByName(_section(first_dates, 4, F.col("filter"), F.concat(dash, "filter")))
    )
    heading = F.element_at(
        F.array(
            F.lit(fv.HEAD_RELATIONSHIPS),
            F.lit(fv.HEAD_FILTERS),
            F.lit(fv.HEAD_AGGREGATIONS),
            F.lit(fv.HEAD_DATE_FILTERS),
        ),
        F.col("section"),
    )
    # Every line brings its heading along; the copies are dropped on the map side.
    lines = F.array(
        F.struct("section", F.lit("").alias("key"), heading.alias("line")),
        F.struct("section", "key", "line"),
    )
    return body.select(F.inline(lines)).distinct()


def schema_of(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """qid, schema_text: the description of the tables that a question's hits use.

    ``hits``: qid, tables_used. ``lines``: ord (table key, place) and line of the stored description.
    """
    used = hits.select("qid", F.explode("tables_used").alias("table_name")).distinct()
    keyed = lines.select(F.col("ord")[0].alias("table_key"), "ord", "line")
    keys = keyed.select("table_key").distinct().withColumn("n_columns", F.lit(0))
    found = used.withColumn("wanted", F.lower("table_name")).join(name_lookup(used, keys), "wanted")
    meant = stored(found.select("qid", "table_key").distinct(), "meant-tables")
    own = keyed.join(shipped(meant), "table_key").select("qid", "table_key", "ord", "line")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "line")))
    return own.groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("schema_text")
    )


def patterns_of(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """qid, patterns_text: the pattern lines of the tables that a question's hits use, and the date filters.

    ``hits``: qid, tables_used. ``lines``: ord (section, key) and line of the stored description. A section without such
    lines has no heading. The date filters belong to no table; there are at most ``RENDERED_DATE_FILTERS``.
    """
    keyed = lines.select(F.col("ord")[0].cast("int").alias("section"), F.col("ord")[1].alias("key"), "line")
    of_tables, dated = keyed.filter("section < 4"), keyed.filter("section = 4")
    used = stored(hits.select("qid", F.explode("tables_used").alias("key")).distinct().filter("key <> ''"), "used-tables")
    own = of_tables.join(shipped(used), "key").select("qid", "section", "key", "line")
    heads = own.select("qid", "section").distinct().join(of_tables.filter("key = ''"), "section")
    ordered = F.sort_array(F.collect_list(F.struct("section", "key", "line")))
    texts = own.unionByName(heads).groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("of_tables")
    )
    dates = as_text(dated, ["key"]).scalar()
    both = F.concat_ws("\n", "of_tables", F.when(F.length("dates") > 0, F.col("dates")))
    asked = hits.select("qid").distinct().join(texts, "qid", "left").withColumn("dates", dates)
    return asked.select("qid", both.alias("patterns_text"))


def as_text(lines: DataFrame, order: list[str]) -> DataFrame:
    """One row ``content`` with all lines in order."""
    keyed = F.sort_array(F.collect_list(F.struct(*order, "line")))
    return lines.agg(
        F.array_join(F.transform(keyed, lambda r: r["line"]), "\n").alias("content")
    )


def join_names(joins: Column) -> Column:
    """Joins as ``left-right`` texts."""
    return F.transform(joins, lambda j: F.concat(j["left_table"], F.lit("-"), j["right_table"]))


def table_pattern(tables: Column, joins: Column, aggregations: Column) -> Column:
    """One line that describes the tables, joins and aggregations of a query."""
    described = F.transform(
        joins,
        lambda j: F.concat_ws(
            " ", j["left_table"], j["join_type"], F.lit("JOIN"), j["right_table"]
        ),
    )

    def part(label, items, separator):
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, separator)))

    return F.concat_ws(
        " | ",
        part("Tables: ", tables, ", "),
        part("Joins: ", described, "; "),
        part("Aggregations: ", aggregations, ", "),
    )
