"""Corpus-wide usage patterns, mined from the feature columns of all extracts.

``usage_counts`` counts everything in one pass, combined on the map side. The top lists use
``row_number() <= n``, which Spark prunes per task before the shuffle, so one very popular table
does not gather its rows in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.sqlfeatures import is_business_calculation, is_date_filter


def usage_counts(features: DataFrame) -> DataFrame:
    """kind, key, item, n of all extracts, in one pass and one shuffle.

    kind 'join': left and right table; 'filter': table and a filter that names it; 'agg': table and
    aggregation.
    """

    def entry(kind, key, item):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), item.alias("item"))

    def per_table(kind, items, keep=None):
        def of(t):
            found = F.filter(items, lambda i: keep(t, i)) if keep else items
            return F.transform(found, lambda i: entry(kind, t, i))

        return F.flatten(F.transform("tables", of))

    named = per_table(
        "filter", F.col("filters"), lambda t, f: F.lower(f).contains(F.lower(t))
    )
    joined = F.transform("joins", lambda j: entry("join", j["left_table"], j["right_table"]))
    found = F.concat(joined, named, per_table("agg", F.col("aggregations")))
    return (
        features.select(F.explode(found).alias("u"))
        .groupBy("u.kind", "u.key", "u.item")
        .agg(F.count("*").alias("n"))
    )


def relationships(counts: DataFrame) -> DataFrame:
    """left_table, right_table and how often they are joined."""
    return counts.filter(F.col("kind") == "join").select(
        F.col("key").alias("left_table"), F.col("item").alias("right_table"), "n"
    )


def join_counts(counts: DataFrame) -> DataFrame:
    """The same counts under the key ``left-right``."""
    return relationships(counts).select(
        F.concat("left_table", F.lit("-"), "right_table").alias("relationship"), "n"
    )


def _top(counts: DataFrame, kind: str, name: str, top: int) -> DataFrame:
    w = W.partitionBy("key").orderBy(F.desc("n"), "item")
    return (
        counts.filter(F.col("kind") == kind)
        .withColumn("rk", F.row_number().over(w).cast("long"))
        .filter(F.col("rk") <= top)
        .select(F.col("key").alias("table_name"), F.col("item").alias(name), "n", "rk")
    )


def common_filters(counts: DataFrame, top: int = fv.TOP_PATTERNS) -> DataFrame:
    """Per table its most frequent filters among those that name it."""
    return _top(counts, "filter", "filter", top)


def common_aggregations(counts: DataFrame, top: int = fv.TOP_PATTERNS) -> DataFrame:
    """Per table its most frequent aggregations."""
    return _top(counts, "agg", "agg", top)


def business_calculations(features: DataFrame) -> DataFrame:
    """Queries that mention a business measure."""
    return features.filter(is_business_calculation(F.col("sql_query"))).select(
        "notebook_path", "cell_index", "sql_query"
    )


def date_filters(features: DataFrame, *kept: str) -> DataFrame:
    """Date-like filters of the queries that use a date function, with the ``kept`` columns."""
    return (
        features.filter(F.size("date_functions") > 0)
        # The outer form keeps Spark from testing (and so computing) the array twice.
        .select(*kept, "notebook_path", "cell_index", F.posexplode_outer("filters").alias("pos", "filter"))
        .filter(F.col("pos").isNotNull() & is_date_filter(F.col("filter")))
    )
