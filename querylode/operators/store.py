"""The stored knowledge base: versioned Parquet tables below one root folder.

Every load writes its own ``version=n`` folder of each table and becomes visible by a last, tiny
write to ``commits``. A load that died half-way is invisible and is overwritten by its repetition.
Documents replaced by a load are listed in ``stale`` and are left out when reading, so nothing that
may be in use is ever rewritten. A load that resets the base hides all older versions; so does a compaction, which
writes the current rows of all tables once more.
"""

from __future__ import annotations

import random
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import tables
from ..session import ADVISED, ADVISED_WORK, LEAST_WORK, enough_partitions, small_tasks
from . import patterns, text_index


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version per key.

    ``row_number() <= 1`` keeps one row per key and task before the shuffle, so a key with very many
    versions is no hot spot.
    """
    w = W.partitionBy(key).orderBy(F.desc(version))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1).drop("_rn")


def digest(columns: list[str], made_by: str) -> Column:
    """A digest of the named columns of a document and of what made the rest of it."""
    return F.sha2(F.to_json(F.struct(F.lit(made_by).alias("made_by"), *columns)), 256)


def all_columns() -> list[str]:
    """What tells two documents apart that are stored as they come."""
    return [f.name for f in tables.schema(tables.DOCS).fields if f.name != "updated_at"]


def usage_of(docs: DataFrame) -> DataFrame:
    """The usage counts of stored documents."""
    return patterns.usage_counts(docs.withColumnRenamed("tables_used", "tables"))


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Versions and raw access.

    def _read(self, name: str, ddl: str) -> DataFrame:
        """All rows of a table with their ``version``; no rows if nothing was written yet."""
        schema = tables.schema(ddl + ", version bigint")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, ddl: str, version: int, **options: str) -> None:
        # Documents are made as they are written: texts are parsed and cut into words, vectors filled.
        sized = (ADVISED_WORK, LEAST_WORK) if name == "docs" else (ADVISED,)
        with small_tasks(self.spark, text_index.LOAD_SPLIT, *sized):
            tables.conform(df, ddl).write.mode("overwrite").options(**options).parquet(
                f"{self.root}/{name}/version={version}"
            )

    def _since_reset(self) -> list:
        rows = sorted(self._read("commits", tables.COMMITS).collect(), key=lambda r: r["version"])
        last_reset = max((r["version"] for r in rows if r["resets"]), default=0)
        return [r for r in rows if r["version"] >= last_reset]

    def commits(self) -> list:
        """Committed loads by version, from the last reset or compaction on; one row per load."""
        rows = self._since_reset()
        start = max((r["version"] for r in rows if r["compacts"]), default=0)
        return [r for r in rows if r["version"] >= start]

    def next_version(self) -> int:
        """A number that no other load takes, above all committed ones: its start in microseconds, and chance."""
        newest = self._read("commits", tables.COMMITS).agg(F.max("version")).first()[0] or 0
        return max(newest + 1, (time.time_ns() // 1_000 << 10) + random.getrandbits(10))

    def _visible(self, name: str, ddl: str, versions: list | None = None) -> DataFrame:
        if versions is None:
            versions = [r["version"] for r in self.commits()]
        return self._read(name, ddl).filter(F.col("version").isin(versions))

    def is_committed(self, source: str) -> bool:
        return any(r["source"] == source for r in self._since_reset())

    def commit(self, version: int, source: str, documents: int, resets: bool = False,
               modified=None, described: list[str] | None = None, model: str | None = None,
               chunk_size: int | None = None, compacts: bool = False) -> None:
        """Make load ``version`` visible. ``modified``: when the newest file in it was written;
        ``described``: the descriptions that it wrote, with or without lines; ``model``: what made its vectors;
        ``chunk_size``: the length of the pieces that have vectors of their own, if any; ``compacts``: it holds all
        that was current, and takes the place of the loads before it."""
        values = [(source, resets, documents, modified, described or [], model, chunk_size, compacts)]
        row = self.spark.createDataFrame(values, tables.COMMITS)
        self._write(row.coalesce(1), "commits", tables.COMMITS, version)

    # The index as a whole.

    def exists(self) -> bool:
        return bool(self.commits())

    def create(self, force: bool = False) -> None:
        """Make the base usable; an existing one is kept unless ``force`` empties it."""
        if force or not self.exists():
            self.commit(self.next_version(), "create", 0, resets=True)

    def drop(self) -> None:
        """Hide everything; repeating it changes nothing."""
        if self.exists():
            self.commit(self.next_version(), "drop", 0, resets=True)

    def compact(self) -> None:
        """Write the current rows of all tables as one load that takes the place of those before it.

        Sources stay known, so no stream applies a batch twice. Not to be run beside a load, which it would hide.
        """
        commits = self.commits()
        if len(commits) < 2:
            return
        version, docs = self.next_version(), self.documents()
        context = self.schema_context().join(docs.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        for name, rows, ddl in (
            ("digests", self.digests(), tables.DIGESTS),
            ("date_filters", self.date_filters(), tables.DATE_FILTERS),
            ("chunks", self.chunks(), tables.CHUNKS),
            ("term_counts", self.counts(), tables.COUNTS),
            ("usage", self.usage(), tables.USAGE),
            ("files", self.files(), tables.FILES),
            ("schema_context", context, tables.SCHEMA_CONTEXT),
        ):
            self._write(rows, name, ddl, version)
        self._write(self._current("postings", tables.POSTINGS), "postings", tables.POSTINGS, version, **text_index.LAYOUT)
        self._write_blocks(version)
        described = sorted({ident for r in commits for ident in r["described"] or []})
        for ident in described:
            self._write(self._meta(ident), f"meta_{ident}", tables.META, version)
        n = self.write_documents(docs, version)
        newest = next((r for r in reversed(commits) if r["documents"]), commits[-1])
        modified = max((r["modified"] for r in commits if r["modified"]), default=None)
        self.commit(version, newest["source"], n, False, modified, described, newest["model"], newest["chunk_size"], True)

    # Documents.

    def documents(self) -> DataFrame:
        """The current documents, with the ``version`` that wrote them."""
        return self._current("docs", tables.DOCS)

    def _current(self, name: str, ddl: str) -> DataFrame:
        """The rows of a table with a doc_id that belong to current documents."""
        versions = [r["version"] for r in self.commits()]
        rows = self._visible(name, ddl, versions)
        if len(versions) < 2:
            return rows
        stale = self._visible("stale", tables.STALE, versions).select(
            "doc_id", F.col("doc_version").alias("version")
        )
        return rows.join(stale, ["doc_id", "version"], "left_anti")

    def get(self, doc_id: str) -> DataFrame:
        """The document with this id without its vector, or no row."""
        return self.documents().filter(F.col("doc_id") == doc_id).drop("embedding")

    def get_all(self, ids: DataFrame) -> DataFrame:
        """The documents without their vectors for a table with a column doc_id, whose other columns are added."""
        return self.documents().drop("embedding").join(ids, "doc_id")

    def write_documents(self, docs: DataFrame, version: int) -> int:
        """Write the documents of one load; returns how many."""
        seen = Observation(f"documents-{version}")
        self._write(docs.observe(seen, F.count(F.lit(1)).alias("n")), "docs", tables.DOCS, version)
        return seen.get["n"]

    def written(self, version: int) -> DataFrame:
        """The documents that one load wrote, committed or not."""
        return self._read("docs", tables.DOCS).filter(F.col("version") == version)

    def write_digests(self, version: int, columns: list[str], made_by: str) -> None:
        """Store a digest of each of the load's documents."""
        rows = self.written(version).select("doc_id", digest(columns, made_by).alias("digest"))
        self._write(rows, "digests", tables.DIGESTS, version)

    def digests(self) -> DataFrame:
        """doc_id, digest, version of the current documents."""
        return self._current("digests", tables.DIGESTS)

    def compared(self, docs: DataFrame, columns: list[str], made_by: str, how: str) -> DataFrame:
        """The rows of ``docs`` that are stored as they are (``how`` 'left_semi'), or that aren't ('left_anti')."""
        known = self.digests().select("doc_id", F.col("digest").alias("__digest"))
        return docs.withColumn("__digest", digest(columns, made_by)).join(known, ["doc_id", "__digest"], how).drop("__digest")

    def mark_stale(self, version: int, notebooks: DataFrame | None = None, kept: DataFrame | None = None) -> None:
        """List the current documents that load ``version`` replaces.

        These are the older documents of the given notebooks but for those with an id in ``kept``, or, without
        ``notebooks``, those with the ids that the load wrote.
        """
        old = self.documents().select("doc_id", "version", "notebook_path")
        if notebooks is None:
            fresh = self.written(version).select("doc_id")
            replaced = old.join(fresh, "doc_id", "left_semi")
        else:
            named = notebooks.select("notebook_path").distinct()
            replaced = old.join(named, "notebook_path", "left_semi")
            if kept is not None:
                replaced = replaced.join(kept, "doc_id", "left_anti")
        rows = replaced.select("doc_id", F.col("version").alias("doc_version"))
        self._write(rows, "stale", tables.STALE, version)

    def mark_none_stale(self, version: int) -> None:
        """Load ``version`` replaces nothing one by one; forgets what a failed attempt listed."""
        nothing = self.spark.createDataFrame([], tables.schema(tables.STALE))
        self._write(nothing, "stale", tables.STALE, version)

    def _gone(self, version: int) -> tuple[DataFrame, list]:
        """doc_id, version of the documents that load ``version`` replaces, and the loads that wrote them: what others wrote
        need not be read to find them."""
        stale = self._read("stale", tables.STALE).filter(F.col("version") == version)
        gone = stale.select("doc_id", F.col("doc_version").alias("version"))
        return gone, [r["version"] for r in gone.select("version").distinct().collect()]

    def upcoming(self, version: int) -> DataFrame:
        """The documents that will be current once load ``version`` is committed."""
        stale = self._read("stale", tables.STALE).filter(F.col("version") == version)
        gone = stale.select("doc_id", F.col("doc_version").alias("version"))
        kept = self.documents().join(gone, ["doc_id", "version"], "left_anti")
        return kept.unionByName(self.written(version))

    # Date filters, and vectors of pieces.

    def write_date_filters(self, version: int) -> None:
        """Store the date filters of the load's documents."""
        found = patterns.date_filters(self.written(version), "doc_id")
        self._write(found, "date_filters", tables.DATE_FILTERS, version)

    def date_filters(self, version: int | None = None, resets: bool = False) -> DataFrame:
        """doc_id, notebook_path, cell_index, pos, filter of the current documents; with ``version`` as they will be once
        that load is committed, which ``resets`` the base or not. Reads no documents."""
        if version is None:
            return self._current("date_filters", tables.DATE_FILTERS)
        stored = self._read("date_filters", tables.DATE_FILTERS)
        fresh = stored.filter(F.col("version") == version)
        if resets:
            return fresh
        stale = self._read("stale", tables.STALE).filter(F.col("version") == version)
        gone = stale.select("doc_id", F.col("doc_version").alias("version"))
        kept = self._current("date_filters", tables.DATE_FILTERS).join(gone, ["doc_id", "version"], "left_anti")
        return kept.unionByName(fresh)

    def write_chunks(self, rows: DataFrame, version: int) -> None:
        """Store vectors of pieces of the load's documents (doc_id, chunk, embedding)."""
        self._write(rows, "chunks", tables.CHUNKS, version)

    def chunks(self) -> DataFrame:
        """doc_id, chunk, embedding of the current documents that were loaded with a ``chunk_size``."""
        return self._current("chunks", tables.CHUNKS)

    def write_counts(self, version: int) -> None:
        """Term counts of the load's documents less those of the documents it replaces, from stored postings: no text is cut
        into words again. The load's own postings are there by then."""
        total = F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("total")
        postings = self._read("postings", tables.POSTINGS)
        own = self._read("posting_blocks", tables.BLOCKS).filter(F.col("version") == version)
        words = postings.filter((F.col("version") == version) & (F.col("term") == "")).groupBy("field", "term").agg(total)
        delta = own.select("field", "term", F.col("n").alias("df"), F.lit(None).cast("long").alias("total"))
        delta = delta.unionByName(words.withColumn("df", F.lit(0).cast("long")))
        gone, loads = self._gone(version)
        if loads:
            found = postings.filter(F.col("version").isin(loads)).join(gone, ["doc_id", "version"], "left_semi")
            removed = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), total)
            delta = delta.unionByName(removed.select("field", "term", -F.col("df"), -F.col("total")).toDF("field", "term", "df", "total"))
        delta = delta.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        changed = (F.col("df") != 0) | (F.coalesce("total", F.lit(0)) != 0)
        self._write(delta.filter(changed), "term_counts", tables.COUNTS, version)

    def counts(self) -> DataFrame:
        """Term counts of the current documents, for text search."""
        return (
            self._visible("term_counts", tables.COUNTS)
            .groupBy("field", "term")
            .agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
            .filter(F.col("df") > 0)
        )

    def write_postings(self, version: int, fields: list[str]) -> None:
        """Store the load's postings, and the bounds of their blocks."""
        found = text_index.postings(self.written(version), fields)
        self._write(found, "postings", tables.POSTINGS, version, **text_index.LAYOUT)
        self._write_blocks(version)

    def _write_blocks(self, version: int) -> None:
        written = self._read("postings", tables.POSTINGS).filter(F.col("version") == version)
        with enough_partitions(self.spark, written.count()):
            self._write(text_index.blocks(written), "posting_blocks", tables.BLOCKS, version)

    def text_index(self) -> text_index.TextIndex:
        """The postings of the current documents. Blocks may still count replaced ones: their bounds hold all the same."""
        versions = [r["version"] for r in self.commits()]
        found = self._current("postings", tables.POSTINGS)
        loads = self._visible("posting_blocks", tables.BLOCKS, versions)
        blocks = loads.groupBy("field", "term", "level").agg(
            F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")
        )
        return text_index.TextIndex(found.drop("version"), blocks, self.counts(), stored_blocks=loads.count())

    def index(self, docs: DataFrame, source: str = "index", skip_unchanged: bool = False) -> int:
        """Insert or replace documents by id; returns how many were written.

        With ``skip_unchanged`` documents that are stored as they are, but for ``updated_at``, aren't written again.
        """
        version = self.next_version()
        if skip_unchanged:
            docs = self.compared(tables.conform(docs, tables.DOCS), all_columns(), "index", "left_anti")
        written = self.write_documents(docs, version)
        self.mark_stale(version)
        self.write_postings(version, list(fv.FIELD_BOOSTS))
        self.write_counts(version)
        self.write_usage(usage_of(self.written(version)), usage_of(self.replaced(version)), version)
        self.write_date_filters(version)
        self.write_digests(version, all_columns(), "index")
        self.commit(version, source, written)
        return written

    # Descriptions of the whole corpus.

    def write_meta(self, doc: tuple[str, str], lines: DataFrame, order: list[str], version: int):
        """Store a description as its lines; the newest version of an id counts."""
        ident, kind = doc
        rows = lines.select(
            F.lit(ident).alias("id"),
            F.lit(kind).alias("document_type"),
            F.array(*[F.col(c).cast("string") for c in order]).alias("ord"),
            "line",
            F.current_timestamp().alias("updated_at"),
        )
        self._write(rows, f"meta_{ident}", tables.META, version)

    def meta_lines(self, ident: str) -> DataFrame:
        """ord, line of the newest stored description, which may be empty."""
        return self._meta(ident).select("ord", "line")

    def _meta(self, ident: str) -> DataFrame:
        wrote = [r["version"] for r in self.commits() if ident in (r["described"] or [])]
        newest = F.lit(max(wrote, default=None)).cast("long")
        rows = self._read(f"meta_{ident}", tables.META)
        return rows.filter(F.col("version") == newest)

    def replaced(self, version: int) -> DataFrame:
        """The documents that load ``version`` replaces."""
        gone, loads = self._gone(version)
        return self._read("docs", tables.DOCS).filter(F.col("version").isin(loads)).join(gone, ["doc_id", "version"], "left_semi")

    def write_usage(self, added: DataFrame, removed: DataFrame, version: int) -> None:
        """Store what load ``version`` changes in the usage counts (kind, key, item, n)."""
        gone = removed.withColumn("n", -F.col("n"))
        delta = added.unionByName(gone).groupBy("kind", "key", "item").agg(F.sum("n").alias("n"))
        self._write(delta.filter(F.col("n") != 0), "usage", tables.USAGE, version)

    def usage(self, version: int | None = None, resets: bool = False) -> DataFrame:
        """kind, key, item, n of all current documents; with ``version`` as they will be once that load is
        committed, which ``resets`` the base or not."""
        versions = [] if resets else [r["version"] for r in self.commits()]
        changes = self._visible("usage", tables.USAGE, versions + [version] * (version is not None))
        return changes.groupBy("kind", "key", "item").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)

    # Files.

    def write_files(self, raw: DataFrame, version: int) -> None:
        """Remember which files, of which time, load ``version`` has read."""
        self._write(raw, "files", tables.FILES, version)

    def files(self) -> DataFrame:
        """notebook_path, modified: every file as it was last read."""
        newest = F.max(F.struct("version", "modified"))["modified"]
        return self._visible("files", tables.FILES).groupBy("notebook_path").agg(newest.alias("modified"))

    def write_schema_context(self, rows: DataFrame, version: int) -> None:
        self._write(rows, "schema_context", tables.SCHEMA_CONTEXT, version)

    def schema_context(self) -> DataFrame:
        """doc_id, version, schema_context of the documents whose tables are in the catalog."""
        return self._visible("schema_context", tables.SCHEMA_CONTEXT)

    def log(self, answers: DataFrame) -> None:
        """Add answered questions (question, sql_query, confidence) to the query log, with the time of this call.

        The log is no part of the index: neither a reset nor a compaction touches it.
        """
        rows = answers.withColumn("asked_at", F.current_timestamp())
        tables.conform(rows, tables.QUERY_LOG).write.mode("append").parquet(f"{self.root}/query_log")

    def query_log(self) -> DataFrame:
        """asked_at, question, sql_query, confidence of all that was logged."""
        return self._read("query_log", tables.QUERY_LOG).drop("version")

    def stats(self) -> DataFrame:
        """One row about the base: documents, stored bytes, descriptions, catalog, newest load.

        ``n_databases`` and ``n_tables`` count what the stored catalog description describes; ``source`` and ``model`` are
        those of the newest load with documents; ``status`` is 'healthy' if all rows that the loads report are stored,
        else 'incomplete'.
        """
        commits = self.commits()
        loads = [r for r in commits if r["documents"]]
        kept = [r["version"] for r in commits]
        rows = self._visible("docs", tables.DOCS, kept)
        stored = rows.agg(F.count("*").alias("n"))
        size = F.lit(0).cast("long")
        if loads:  # without any, there is no file that could tell its size
            files = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
            size = files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).scalar()
        described = sum(
            1
            for ident, _ in (fv.SCHEMA_DOC, fv.PATTERNS_DOC)
            if not self._visible(f"meta_{ident}", tables.META, kept).isEmpty()
        )
        keys = self.meta_lines(fv.SCHEMA_DOC[0]).select(F.col("ord")[0].alias("table_key")).distinct()
        catalog = keys.agg(
            F.count_distinct(F.substring_index("table_key", ".", 1)).alias("n_databases"), F.count("*").alias("n_tables")
        )
        complete = stored.scalar() == sum(r["documents"] for r in commits)
        newest = loads[-1] if loads else None
        return self.documents().agg(F.count("*").alias("document_count")).select(
            "document_count",
            size.alias("index_size"),
            F.lit(described).cast("long").alias("meta_count"),
            catalog.select("n_databases").scalar().alias("n_databases"),
            catalog.select("n_tables").scalar().alias("n_tables"),
            F.lit(newest and newest["source"]).cast("string").alias("source"),
            F.lit(newest and newest["model"]).cast("string").alias("model"),
            F.lit(self.root.rsplit("/", 1)[-1]).alias("index_name"),
            F.when(complete, "healthy").otherwise("incomplete").alias("status"),
        )
