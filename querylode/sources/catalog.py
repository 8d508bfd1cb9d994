"""Catalog metadata as tables: from the session's metastore or from a metadata export.

``catalog_tables``: database, name, table_key, description, location, table_type, parameters.
``catalog_columns``: table_key, pos, name, type, comment, is_partition.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES_SCHEMA = (
    "database string, name string, table_key string, description string, location string, "
    "input_format string, output_format string, table_type string, "
    "parameters map<string,string>, created string, last_access string"
)
COLUMNS_SCHEMA = (
    "table_key string, pos int, name string, type string, comment string, is_partition boolean"
)


def table_key(database: Column, name: Column) -> Column:
    return F.concat_ws(".", database, name)


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def tables_of(spark: SparkSession, database: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]


def targets(specs: DataFrame, available: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (database, name) to describe.

    ``specs``: column ``spec`` with ``database.table``; a spec without a dot is dropped.
    ``available``: database, name of all tables. ``listed``: ``database`` of wholly wanted databases.
    """
    cut = F.split("spec", r"\.", 2)
    explicit = specs.filter(F.col("spec").contains(".")).select(
        cut[0].alias("database"), cut[1].alias("name")
    )
    whole = available.join(listed.select("database").distinct(), "database", "left_semi")
    return explicit.unionByName(whole.select("database", "name")).distinct()


def bad_specs(specs: DataFrame) -> DataFrame:
    """Specs that do not have the form ``database.table``."""
    return specs.filter(~F.col("spec").contains("."))


def select_targets(metadata: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a metadata export that describe a target; unknown targets have none."""
    return metadata.join(wanted.select("database", "name").distinct(), ["database", "name"], "left_semi")


def describe(spark: SparkSession, database: str, name: str):
    """(table row, column rows) of one metastore table, or None if there is no such table."""
    quoted = f"`{database}`.`{name}`"
    try:
        found = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted} AS JSON").first()[0]
    except AnalysisException as error:
        if error.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND"):
            return None
        raise
    doc = json.loads(found)
    key = f"{database}.{name}"
    row = (
        database,
        name,
        key,
        doc.get("comment"),
        doc.get("location"),
        doc.get("inputformat"),
        doc.get("outputformat"),
        doc.get("type"),
        {k: str(v) for k, v in (doc.get("table_properties") or {}).items()},
        doc.get("created_time"),
        doc.get("last_access"),
    )
    columns = [
        (key, i, c.name, c.dataType, c.description, c.isPartition)
        for i, c in enumerate(spark.catalog.listColumns(quoted))
    ]
    return row, columns


def from_metastore(spark: SparkSession, wanted: list[tuple[str, str]]):
    """(catalog_tables, catalog_columns) of the given metastore tables.

    One metastore call per table; for very large catalogs read a metadata export with
    ``select_targets`` instead. Missing tables are left out.
    """
    found = [d for d in (describe(spark, db, name) for db, name in wanted) if d]
    tables = spark.createDataFrame([t for t, _ in found], TABLES_SCHEMA)
    columns = spark.createDataFrame([c for _, cs in found for c in cs], COLUMNS_SCHEMA)
    return tables, columns
