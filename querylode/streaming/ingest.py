"""Incremental ingest: new and changed notebook files, batch by batch, into the knowledge base."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import KnowledgeBase
from ..plans.build import BuildReport, build
from ..session import stored
from ..sources.notebooks import list_files, read_files, stream_files


# Files whose paths are in the driver at once, about.
FILES_PER_BATCH = 10_000


def apply_batch(kb: KnowledgeBase, raw: DataFrame, source: str, catalog=None,
                embedder=None, skip_unchanged: bool = False) -> BuildReport | None:
    """Replace the documents of the notebooks in ``raw``, once per ``source``.

    A batch that was applied before is skipped, so a restarted stream repeats nothing. A batch
    without any SQL still removes what its notebooks contributed earlier.
    """
    kb.create()
    if kb.is_committed(source):
        return None
    return build(kb, raw, catalog, embedder=embedder, source=source, empty=True, skip_unchanged=skip_unchanged)


def start(kb: KnowledgeBase, path: str, checkpoint: str, name: str = "ingest", catalog=None,
          embedder=None, files_per_batch: int | None = None, **trigger):
    """Start a stream that ingests the new files below ``path``; by default it stops when caught up.

    The stream's own checkpoint remembers the files it has seen, by path; a file rewritten in place
    is picked up by ``catch_up``. Pass ``processingTime='1 minute'`` to keep the stream running.
    """
    files = stream_files(kb.spark, path, files_per_batch)

    def each(batch, batch_id):
        apply_batch(kb, batch, f"{name}:{batch_id}", catalog, embedder)

    return (
        files.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def catch_up(kb: KnowledgeBase, path: str, catalog=None, embedder=None,
             files_per_batch: int = FILES_PER_BATCH) -> BuildReport:
    """Ingest every file that was not read before, or not as it is now, whenever it was written.

    Paths and times of the files are compared to those of the files that were read. The changed files are dealt by a hash
    of their path into batches of about ``files_per_batch``, each a load of its own, so the driver knows the paths of one
    batch at a time; a catch-up that breaks off goes on with the rest when it is repeated. Cells that are as they were, in a
    file that changed, are neither embedded nor written again. Reports the sums of all batches.
    """
    kb.create()
    listed = list_files(kb.spark, path)
    fresh = listed.join(kb.files(), ["notebook_path", "modified"], "left_anti")
    paths = stored(fresh.select("path").distinct(), "changed-files")
    batches = max(1, -(-paths.count() // files_per_batch))
    reports = []
    for i in range(batches):
        some = paths.filter(F.pmod(F.xxhash64("path"), F.lit(batches)) == i).collect()
        raw = read_files(kb.spark, [r["path"] for r in some])
        source = f"catch-up:{kb.next_version()}"
        reports.append(apply_batch(kb, raw, source, catalog, embedder, skip_unchanged=True))
    return total(reports)


def total(reports: list[BuildReport]) -> BuildReport:
    """One report of several loads: their sums, and the verdict of the best of them."""
    best = max(reports, key=lambda r: (r.ok, r.indexed > 0, r.tables))
    sums = {k: sum(getattr(r, k) for r in reports) for k in ("notebooks", "extracts", "indexed", "kept")}
    return replace(best, **sums, modified=max((r.modified for r in reports if r.modified), default=None))
