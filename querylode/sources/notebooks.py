"""Notebook files as tables: raw files, parsed notebooks, cells, rejects and extracts.

Reading, sniffing and parsing are one narrow pass: a notebook stays in one row until its cells (or
its SQL extracts, with their context) are exploded, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import cell_kind, let, strip
from ..operators.context import extract_id

RAW_SCHEMA = "notebook_path string, value string, modified timestamp"
FILE_GLOB = "*.{ipynb,json}"


def _options(reader, skip_unreadable: bool):
    return (
        reader.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", FILE_GLOB)
        .option("ignoreCorruptFiles", skip_unreadable)
    )


def _raw(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_metadata.file_path").alias("notebook_path"),
        "value",
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def _loaded(reader, path) -> DataFrame | None:
    """What is below a path, or below those paths of a list that are there; None if there is none."""
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    if isinstance(path, str):
        return None
    there = [p for p in path if _loaded(reader, p) is not None]
    return reader.load(there) if there else None


def read_files(
    spark: SparkSession, path, skip_unreadable: bool = False, modified_after: str | None = None
) -> DataFrame:
    """One row per ``.ipynb`` or ``.json`` file below ``path``, or each path of a list (any Hadoop URI).

    A missing path or an empty file gives no rows. Unreadable files fail the job unless ``skip_unreadable``.
    ``modified_after`` (``yyyy-MM-ddTHH:mm:ss``, session time zone) leaves out older files unread.
    """
    reader = _options(spark.read, skip_unreadable)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    found = _loaded(reader, path) if path else None
    return spark.createDataFrame([], RAW_SCHEMA) if found is None else _raw(found)


def list_files(spark: SparkSession, path) -> DataFrame:
    """notebook_path, modified and path (to read it by) of the same files, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = _loaded(reader.option("pathGlobFilter", FILE_GLOB), path)
    if found is None:
        return spark.createDataFrame([], "notebook_path string, modified timestamp, path string")
    return found.select(
        F.col("_metadata.file_path").alias("notebook_path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        "path",
    )


def stream_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same rows as a stream of new files."""
    reader = _options(spark.readStream, False)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _raw(reader.load(path))


def _variant(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _jupyter_cell(c: Column) -> Column:
    lines = _variant(c, "$.source", "array<string>")
    return F.struct(
        F.coalesce(_variant(c, "$.cell_type", "string"), F.lit("code")).alias("cell_type"),
        F.coalesce(
            F.array_join(lines, ""), _variant(c, "$.source", "string"), F.lit("")
        ).alias("source"),
        _variant(c, "$.metadata", "variant").alias("metadata"),
        _variant(c, "$.execution_count", "int").alias("execution_count"),
        _variant(c, "$.outputs", "variant").alias("outputs"),
    )


def _zeppelin_cell(p: Column) -> Column:
    text = F.coalesce(_variant(p, "$.text", "string"), F.lit(""))
    prose = text.startswith("%md")
    empty = F.parse_json(F.lit("{}"))
    metadata = F.to_variant_object(
        F.struct(
            F.coalesce(_variant(p, "$.config", "variant"), empty).alias("config"),
            F.coalesce(_variant(p, "$.settings", "variant"), empty).alias("settings"),
            F.coalesce(_variant(p, "$.title", "string"), F.lit("")).alias("title"),
        )
    )
    return F.struct(
        F.when(prose, "markdown").otherwise("code").alias("cell_type"),
        F.when(prose, strip(F.substring(text, 4, 2147483647))).otherwise(text).alias("source"),
        metadata.alias("metadata"),
        F.lit(None).cast("int").alias("execution_count"),
        F.lit(None).cast("variant").alias("outputs"),
    )


def _classified(raw: DataFrame) -> DataFrame:
    doc = F.col("doc")
    is_jupyter = F.col("notebook_path").endswith(".ipynb")
    has_paragraphs = F.coalesce(
        F.try_variant_get(doc, "$.paragraphs", "variant").isNotNull(), F.lit(False)
    )
    return raw.withColumn(
        "doc", F.when(F.is_valid_utf8("value"), F.try_parse_json("value"))
    ).withColumn(
        "notebook_type",
        F.when(doc.isNull(), None)
        .when(is_jupyter, "jupyter")
        .when(has_paragraphs, "zeppelin"),
    )


def parse(raw: DataFrame) -> DataFrame:
    """One row per notebook: path, type, modified, metadata and its cells as an array of structs."""
    doc = F.col("doc")
    jupyter = F.col("notebook_type") == "jupyter"
    jupyter_cells = F.transform(_variant(doc, "$.cells", "array<variant>"), _jupyter_cell)
    zeppelin_cells = F.transform(_variant(doc, "$.paragraphs", "array<variant>"), _zeppelin_cell)
    return (
        _classified(raw)
        .filter(F.col("notebook_type").isNotNull())
        .select(
            "notebook_path",
            "notebook_type",
            "modified",
            F.when(jupyter, _variant(doc, "$.metadata", "variant"))
            .otherwise(_variant(doc, "$.info", "variant"))
            .alias("metadata"),
            F.when(jupyter, jupyter_cells).otherwise(zeppelin_cells).alias("cells"),
        )
    )


def rejects(raw: DataFrame) -> DataFrame:
    """Files that are no notebook, with the reason."""
    return (
        _classified(raw)
        .filter(F.col("notebook_type").isNull())
        .select(
            "notebook_path",
            F.when(F.col("doc").isNull(), "not JSON").otherwise("no paragraphs").alias("reason"),
        )
    )


def cells(notebooks: DataFrame) -> DataFrame:
    """One row per cell, numbered from 0 within its notebook."""
    # The outer form keeps Spark from testing (and so parsing) the cells twice.
    exploded = notebooks.select(
        "notebook_path",
        "notebook_type",
        "modified",
        F.posexplode_outer("cells").alias("cell_index", "cell"),
    )
    return exploded.filter(F.col("cell_index").isNotNull()).select("notebook_path", "notebook_type", "modified", "cell_index", "cell.*")


def extracts(notebooks: DataFrame, span: int = fv.CONTEXT_SPAN) -> DataFrame:
    """One row per SQL cell with its context, taken from the notebook's own row: no shuffle."""

    def prose(kinds, first, count):
        near = F.slice(kinds, first, count)
        return F.array_join(
            F.transform(F.filter(near, lambda c: c["kind"] == "markdown"), lambda c: c["source"]),
            " ",
        )

    def classify(c):
        return F.struct(
            cell_kind(c["cell_type"], c["source"]).alias("kind"),
            c["source"].alias("source"),
            c["metadata"].alias("metadata"),
            c["execution_count"].alias("execution_count"),
        )

    def in_context(kinds):
        def one(c, i):
            before = F.least(i, F.lit(span))
            return F.struct(
                i.alias("cell_index"),
                c["kind"].alias("kind"),
                c["source"].alias("sql_query"),
                F.when(c["kind"] == "sql", prose(kinds, i - before + 1, before)).alias(
                    "context_before"
                ),
                F.when(c["kind"] == "sql", prose(kinds, i + 2, F.lit(span))).alias(
                    "context_after"
                ),
                c["metadata"].alias("cell_metadata"),
                c["execution_count"].alias("execution_count"),
            )

        return F.filter(F.transform(kinds, one), lambda c: c["kind"] == "sql")

    found = let(F.transform("cells", classify), in_context)
    return (
        notebooks.select(
            "notebook_path", "notebook_type", "modified", F.explode(found).alias("c")
        )
        .select("notebook_path", "notebook_type", "modified", "c.*")
        .drop("kind")
        .withColumn("extract_id", extract_id(F.col("notebook_path"), F.col("cell_index")))
    )
