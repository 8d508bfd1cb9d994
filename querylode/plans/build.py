"""Building the knowledge base from notebook files and catalog metadata."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import tables
from ..functions.sqlfeatures import with_features
from ..functions.text import chunks, embedding_text
from ..functions.vectors import embed
from ..operators import patterns, render, schema_match
from ..operators.store import KnowledgeBase, usage_of
from ..session import stored
from ..sources import notebooks as nb


@dataclass
class BuildReport:
    ok: bool
    message: str
    notebooks: int = 0
    extracts: int = 0
    indexed: int = 0
    tables: int = 0
    modified: datetime | None = None
    kept: int = 0


def documents(extracts: DataFrame, embedder=None) -> DataFrame:
    """Extracts with features, descriptions and vector; ``embedder`` maps a text column to vectors."""
    context = embedding_text(
        *[F.col(c) for c in ("sql_query", "context_before", "context_after", "notebook_path")]
    )
    return (
        with_features(extracts)
        .withColumn("business_context", context)
        .withColumns(
            {
                "doc_id": F.col("extract_id"),
                "table_pattern": render.table_pattern(
                    F.col("tables"), F.col("joins"), F.col("aggregations")
                ),
                "join_names": render.join_names(F.col("joins")),
                "embedding": (embedder or embed)(F.col("business_context")),
                "updated_at": F.current_timestamp(),
            }
        )
        .withColumnRenamed("tables", "tables_used")
    )


def load(kb: KnowledgeBase, raw: DataFrame, version: int, embedder=None, made_by: str | None = None):
    """Write the documents of raw notebook files; (notebooks, extracts, indexed, newest change, ids that stay).

    One pass over the files without a shuffle; the counts are taken along the way. Extracts without
    a vector are counted but not indexed. With ``made_by`` extracts are compared by digest with the current documents,
    and those that are there as they are, made by the same, are neither embedded nor written.
    """
    parsed, found = Observation(f"notebooks-{version}"), Observation(f"extracts-{version}")
    notebooks = nb.parse(raw).observe(
        parsed, F.count(F.lit(1)).alias("n"), F.max("modified").alias("modified")
    )
    extracts = nb.extracts(notebooks).withColumn("cell_metadata", F.to_json("cell_metadata"))
    kept = None
    if made_by is None:
        docs = documents(extracts, embedder).observe(found, F.count(F.lit(1)).alias("n"))
    else:
        counted = extracts.withColumn("doc_id", F.col("extract_id")).observe(found, F.count(F.lit(1)).alias("n"))
        extracts = stored(counted, "extracts")  # read twice, parsed once
        kept = stored(kb.compared(extracts, tables.CONTENT, made_by, "left_semi").select("doc_id"), "kept")
        docs = documents(extracts.join(kept, "doc_id", "left_anti").drop("doc_id"), embedder)
    indexed = kb.write_documents(docs.filter(F.col("embedding").isNotNull()), version)
    return parsed.get["n"], found.get["n"], indexed, parsed.get["modified"], kept


def chunk_vectors(docs: DataFrame, size: int, embedder=None) -> DataFrame:
    """doc_id, chunk, embedding: a vector for each piece of ``size`` characters of a document's described text.

    A piece without words has no vector. The pieces of one document are spread over tasks only by its file split: they
    are made where the document is read.
    """
    pieces = docs.select("doc_id", F.posexplode(chunks(F.col("business_context"), size)).alias("chunk", "piece"))
    vector = (embedder or embed)(F.col("piece"))
    # The outer form keeps Spark from making the vector twice, once to test it.
    vectors = pieces.select("doc_id", "chunk", F.explode_outer(F.array(vector)).alias("embedding"))
    return vectors.filter(F.col("embedding").isNotNull())


def pattern_lines(counts: DataFrame, dates: DataFrame) -> DataFrame:
    """The lines of the pattern description, from usage counts and date filters."""
    return render.pattern_lines(
        patterns.relationships(counts),
        patterns.common_filters(counts),
        patterns.common_aggregations(counts),
        dates,
    )


def describe(kb: KnowledgeBase, version: int, catalog=None, resets: bool = False) -> int:
    """Store the pattern and schema descriptions as of load ``version``; returns the number of tables.

    Usage counts and date filters change by what the load adds and replaces: of the documents only those are read.
    """
    kb.write_usage(usage_of(kb.written(version)), usage_of(kb.replaced(version)), version)
    kb.write_date_filters(version)
    lines = pattern_lines(kb.usage(version, resets), kb.date_filters(version, resets))
    kb.write_meta(fv.PATTERNS_DOC, lines, ["section", "key"], version)
    if catalog is None:
        return 0
    catalog_tables, catalog_columns = catalog
    schema_lines = render.schema_lines(catalog_tables, catalog_columns).select(
        "table_key",
        F.format_string("%d-%08d", "ord.section", "ord.pos").alias("place"),
        "line",
    )
    kb.write_meta(fv.SCHEMA_DOC, schema_lines, ["table_key", "place"], version)
    sized = catalog_tables.select("table_key").join(
        catalog_columns.filter(~F.col("is_partition"))
        .groupBy("table_key")
        .agg(F.count("*").alias("n_columns")),
        "table_key",
        "left",
    ).fillna(0, ["n_columns"])
    fresh = kb.written(version).select(
        F.col("doc_id").alias("extract_id"), F.col("tables_used").alias("tables")
    )
    context = schema_match.schema_context(fresh, sized).withColumnRenamed("extract_id", "doc_id")
    kb.write_schema_context(context, version)
    return catalog_tables.count()


def build(kb: KnowledgeBase, raw: DataFrame, catalog=None, force: bool = False, embedder=None,
          source: str = "build", empty: bool = False, chunk_size: int | None = None,
          model: str | None = None, skip_unchanged: bool = False) -> BuildReport:
    """Build the base from raw notebook files (``notebooks.read_files``).

    ``catalog``: (catalog_tables, catalog_columns). With ``force`` the load replaces everything,
    else the documents of the notebooks it contains. Nothing becomes visible unless something was
    indexed or, with ``empty``, any notebook was read: then its earlier documents go.
    With ``chunk_size`` every piece of so many characters of a document has a vector as well, for
    ``answer.retrieve(..., by_chunks=True)``. ``model`` names the embedder in the base's statistics. With
    ``skip_unchanged`` extracts that the base holds as they are, with their context, and that the same model made, stay:
    they are neither embedded nor written again, and keep the schema context of the load that wrote them.
    """
    if chunk_size is not None and chunk_size < 1:
        raise ValueError(f"chunk_size must be at least 1, not {chunk_size}")
    kb.create()
    version = kb.next_version()
    model = model or (fv.EMBED_MODEL if embedder is None else getattr(embedder, "__name__", "given"))
    made_by = f"{model}/{chunk_size}"
    compare = made_by if skip_unchanged and not force else None
    n_notebooks, n_extracts, indexed, modified, kept = load(kb, raw, version, embedder, compare)
    n_kept = 0 if kept is None else kept.count()
    report = BuildReport(False, "", n_notebooks, n_extracts, indexed, 0, modified, n_kept)
    if not n_notebooks:
        report.message = "No notebooks found"
    elif not n_extracts:
        report.message = "No SQL extracts found"
    elif not indexed and not n_kept:
        report.message = "No documents with embeddings"
    if report.message and not (empty and n_notebooks):
        return report
    if force:
        kb.mark_none_stale(version)
    else:
        kb.mark_stale(version, raw.select("notebook_path"), kept)
    kb.write_postings(version, list(fv.FIELD_BOOSTS))
    kb.write_counts(version)
    if chunk_size is not None:
        kb.write_chunks(chunk_vectors(kb.written(version), chunk_size, embedder), version)
    report.tables = describe(kb, version, catalog, resets=force)
    kb.write_digests(version, tables.CONTENT, made_by)
    kb.write_files(raw, version)
    described = [fv.PATTERNS_DOC[0], *[fv.SCHEMA_DOC[0]] * (catalog is not None)]
    kb.commit(version, source, indexed, force, modified, described, model, chunk_size)
    report.ok, report.message = True, "built" if indexed or n_kept else "nothing to index"
    return report


def rebuild(kb: KnowledgeBase, raw: DataFrame, catalog=None, embedder=None) -> BuildReport:
    """Build from scratch."""
    return build(kb, raw, catalog, force=True, embedder=embedder)
