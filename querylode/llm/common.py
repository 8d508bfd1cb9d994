"""What several operators share: reading tables, bounded slices of a batch, whitespace and shared folders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.session import new_dir, write_once

# The six ASCII white-space characters, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
# A task works through a batch in slices of at most this many bytes of text (a longer text is a slice of its own).
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: a bounded lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    schema = df.schema
    write_once(df, path)
    return spark.read.schema(schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut so that each part holds at most ``limit`` bytes of text or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
