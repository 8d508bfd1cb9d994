"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, with A-Z lower-cased; keys of at least ``min_chars`` code
points found in at least ``min_docs`` documents lose all their lines except in the largest doc_id that holds them.

The documents come in batches of descending doc_id. A batch's distinct keys are merge-anti-joined to the runs of all
earlier batches: keys that no run holds are first held here, by the largest doc_id of all, which is recorded; the
others add their count. Then the batch becomes a run of its own. Runs are tables bucketed and sorted by hash, so the
joins shuffle the new batch alone; ``fanout`` runs of a level are compacted into one of the next by a full outer merge
join, bucket by bucket, which leaves one row for each key. The last merge holds, for each key, the number of documents and
the document that keeps it. Batches grow with the input, and so does their number, by the square root of its size.

Defined cases: null and empty texts have one empty line; a null doc_id comes before all others; rows that share a
doc_id are one document for the count and lose the same keys; of equal lines of one document all stay or all go; a text of
any length is worked through whole; an empty table gives no rows; line hashes have 128 bits (MD5). Other columns stay,
except those named n_lines or n_dropped.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylode.llm import common
from querylode.session import new_dir

STRIPPED = b" \t\n\x0b\x0c\r"
FANOUT = 2
# Bytes of text of the only batch of a small input; n times n as much makes n batches.
BATCH_BYTES = 64_000_000


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None if the key is too short to count."""
    key = line.strip(STRIPPED).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, batch, h1, h2: the distinct keys of every row's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                at, keys = [], []
                for i, text in enumerate(common.texts(batch.column("text"))):
                    own = {key_of(line, min_chars) for line in text.split(b"\n")} - {None}
                    at += [i] * len(own)
                    keys += own
                halves = [struct.unpack("<qq", k) for k in keys]
                taken = batch.select(["doc_id", "batch"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64())],
                    ["doc_id", "batch", "h1", "h2"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "batch", "text").mapInArrow(run, f"doc_id {id_type}, batch int, h1 bigint, h2 bigint")


class Runs:
    """Levels of sorted runs: (h1, h2, n documents, last holder), bucketed by hash in the shared folder."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", new_dir(self.spark, "line-run"))
            .saveAsTable(name)
        )
        return name

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def rows(self, tables: list[str]) -> DataFrame:
        """The keys of some runs, merged: one row for each key. A union of them would not bring equal keys together."""
        out = self.spark.table(tables[0])
        for t in tables[1:]:
            other = self.spark.table(t).select("h1", "h2", F.col("n").alias("more"), F.col("last").alias("other"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
            # Only the first run that held a key names its holder.
            out = out.join(other, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), F.greatest("last", "other").alias("last"))
        return out

    def add(self, batch: DataFrame) -> None:
        """Add a batch's (h1, h2, n, last): a key that a run holds keeps that run's holder."""
        new = batch
        held = self.tables()
        if held:
            marked = batch
            for i, t in enumerate(held):  # merge joins of sorted runs; the last is the batch's only shuffle
                run = self.spark.table(t).select("h1", "h2", F.lit(True).alias(f"held{i}"))
                marked = marked.join(run, ["h1", "h2"], "left")
            seen = F.coalesce(*[F.col(f"held{i}") for i in range(len(held))], F.lit(False))
            new = marked.select("h1", "h2", "n", F.when(~seen, F.col("last")).alias("last"))
        table, level = self.write(new), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(table)
            if len(self.levels[level]) < self.fanout:
                return
            table, level = self.compact(level), level + 1

    def compact(self, level: int) -> str:
        """Merge a level's runs into one and forget them; their files stay, as running jobs may read them."""
        merged = self.write(self.rows(self.levels[level]))
        self.forget(level)
        return merged

    def forget(self, level: int) -> None:
        for t in self.levels[level]:
            self.spark.sql(f"DROP TABLE {t}")
        self.levels[level] = []

    def close(self) -> None:
        """Take all runs out of the catalog."""
        for level in range(len(self.levels)):
            self.forget(level)


def with_batches(docs: DataFrame, batches: int) -> DataFrame:
    """Add ``batch``: 0 for the largest ids, by quantiles of doc_id."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", shares, 0.01) if shares else []
    later = [F.coalesce((F.col("doc_id").cast("double") <= c).cast("int"), F.lit(1)) for c in cuts]
    return docs.withColumn("batch", sum(later, F.lit(0)).cast("int"))


def batches_of(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(math.sqrt(size / BATCH_BYTES)))


def decisions(docs: DataFrame, min_chars: int, min_docs: int, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, __keys: the line hashes that each document loses."""
    spark = docs.sparkSession
    batches = batches or batches_of(docs)
    lines = line_keys(with_batches(docs.select("doc_id", "text"), batches), min_chars).dropDuplicates()
    path = new_dir(spark, "line-keys")
    schema = lines.schema
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(schema).parquet(path)
    runs = Runs(spark, fanout)
    for b in range(batches):
        own = lines.where(F.col("batch") == b).groupBy("h1", "h2")
        runs.add(own.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")))
    common_keys = runs.rows(runs.tables()).where(F.col("n") >= min_docs).select("h1", "h2", "last")
    # Written first: a join of two plain exchanges can be split where very many documents hold one line.
    common_keys = common.stored(common_keys, "shared-lines")
    runs.close()
    lost = F.coalesce(F.col("doc_id") < F.col("last"), F.col("last").isNotNull())
    return (
        lines.join(common_keys, ["h1", "h2"])
        .where(lost)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("__keys"))
    )


def dedup(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, digest: bool = False, fanout: int = FANOUT
) -> DataFrame:
    """Every row with its kept text, n_lines and n_dropped (with ``digest``: doc_id, the counts and kept_sha256)."""
    lost = decisions(docs, min_chars, min_docs, batches, fanout).withColumnRenamed("doc_id", "__lost_id")
    inputs = docs.select("doc_id", "text") if digest else docs.drop("n_lines", "n_dropped")
    joined = inputs.join(lost, F.col("doc_id").eqNullSafe(F.col("__lost_id")), "left").drop("__lost_id")
    names = [c for c in inputs.columns if not (digest and c == "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                kept, n_lines, n_dropped = [], [], []
                keys = batch.column("__keys").to_pylist()
                for text, own in zip(common.texts(batch.column("text")), keys, strict=True):
                    lines = text.split(b"\n")
                    n_lines.append(len(lines))
                    if own:
                        drop = {struct.pack("<qq", k["h1"], k["h2"]) for k in own}
                        lines = [line for line in lines if key_of(line, min_chars) not in drop]
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append(b"\n".join(lines))
                counts = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                if digest:
                    columns = [batch.column("doc_id"), *counts, pa.array([common.sha(k) for k in kept], pa.string())]
                else:
                    new_text = pa.array([k.decode() for k in kept], pa.string())
                    columns = [new_text if c == "text" else batch.column(c) for c in names] + counts
                yield pa.RecordBatch.from_arrays(columns, out_names)

    out_names = [*names, "n_lines", "n_dropped", *["kept_sha256"] * digest]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema if f.name in names]
    schema = ", ".join([*fields, "n_lines bigint", "n_dropped bigint", *["kept_sha256 string"] * digest])
    return joined.select(*inputs.columns, "__keys").mapInArrow(run, schema)
