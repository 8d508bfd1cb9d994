"""Schemas of the stored tables; every write is cast to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOIN = "struct<left_table:string,right_table:string,join_type:string>"
COLUMN = "struct<table_name:string,column_name:string>"

DOCS = (
    "doc_id string, notebook_path string, notebook_type string, cell_index int, "
    "execution_count int, sql_query string, context_before string, context_after string, "
    "business_context string, table_pattern string, query_type string, "
    f"tables_used array<string>, columns array<string>, qualified_columns array<{COLUMN}>, joins array<{JOIN}>, "
    "join_names array<string>, filters array<string>, aggregations array<string>, "
    "functions array<string>, date_functions array<string>, subqueries array<string>, "
    "cte_names array<string>, cell_metadata string, embedding array<float>, updated_at timestamp"
)
STALE = "doc_id string, doc_version bigint"
COUNTS = "field string, term string, df bigint, total bigint"
POSTINGS = "field string, term string, level int, doc_id string, tf bigint, dl bigint"
BLOCKS = "field string, term string, level int, n bigint, max_tf bigint, min_dl bigint"
META = "id string, document_type string, ord array<string>, line string, updated_at timestamp"
USAGE = "kind string, key string, item string, n bigint"
SCHEMA_CONTEXT = "doc_id string, schema_context string"
FILES = "notebook_path string, modified timestamp"
COMMITS = (
    "source string, resets boolean, documents bigint, modified timestamp, described array<string>, model string, "
    "chunk_size int, compacts boolean"
)
CHUNKS = "doc_id string, chunk int, embedding array<float>"
DATE_FILTERS = "doc_id string, notebook_path string, cell_index int, pos int, filter string"
DIGESTS = "doc_id string, digest string"
# What a document is made of when it comes from a notebook; all else follows from it.
CONTENT = [
    "notebook_path", "notebook_type", "cell_index", "execution_count", "sql_query", "context_before", "context_after",
    "cell_metadata",
]
QUERY_LOG = "asked_at timestamp, question string, sql_query string, confidence double"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the declared columns, in order, with the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(ddl).fields])
