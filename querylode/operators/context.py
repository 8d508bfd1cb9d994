"""SQL extracts: every SQL cell with the markdown of its neighbouring cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import cell_kind

# Cells of one notebook that one task sorts together; a longer notebook is cut into blocks.
BLOCK = 4096


def extract_id(notebook_path: Column, cell_index: Column) -> Column:
    """Stable id of one cell, whatever the order of processing."""
    return F.sha2(F.concat_ws("\u0001", notebook_path, cell_index.cast("string")), 256)


def with_context(cells: DataFrame, span: int = fv.CONTEXT_SPAN, block: int = BLOCK) -> DataFrame:
    """Add kind, context_before and context_after to every cell.

    ``cell_index`` counts the cells of a notebook without gaps. The window runs per block of a
    notebook, and cells within ``span`` of a block's edge are copied to the neighbour block, so no
    notebook, however long, is sorted by a single task. Sources of other code cells are not needed
    by the neighbours and stay out of the window.
    """
    i = F.col("cell_index")
    home = F.floor(i / block)
    blocks = F.array_distinct(
        F.array(F.floor(F.greatest(i - span, F.lit(0)) / block), home, F.floor((i + span) / block))
    )
    w = W.partitionBy("notebook_path", "_block").orderBy("cell_index")
    prose = F.when(F.col("kind") == "markdown", F.col("source"))

    def joined(first, last):
        return F.concat_ws(" ", F.collect_list(prose).over(w.rowsBetween(first, last)))

    return (
        cells.withColumn("kind", cell_kind(F.col("cell_type"), F.col("source")))
        .withColumn("_block", F.explode(blocks))
        .withColumn("context_before", joined(-span, -1))
        .withColumn("context_after", joined(1, span))
        .filter(F.col("_block") == home)
        .drop("_block")
    )


def extracts(cells: DataFrame, span: int = fv.CONTEXT_SPAN, block: int = BLOCK) -> DataFrame:
    """One row per SQL cell of a ``cells`` table."""
    return (
        with_context(cells, span, block)
        .filter(F.col("kind") == "sql")
        .drop("kind", "cell_type")
        .withColumnRenamed("source", "sql_query")
        .withColumn("extract_id", extract_id(F.col("notebook_path"), F.col("cell_index")))
    )


def sql_notebooks(cells: DataFrame) -> DataFrame:
    """One row per notebook that has at least one SQL cell, with its cell counts."""
    kind = F.col("kind")
    return (
        cells.select(
            "notebook_path", cell_kind(F.col("cell_type"), F.col("source")).alias("kind")
        )
        .groupBy("notebook_path")
        .agg(
            F.count("*").alias("n_cells"),
            F.count_if(kind == "sql").alias("n_sql"),
            F.count_if(kind == "markdown").alias("n_markdown"),
        )
        .filter(F.col("n_sql") > 0)
    )
