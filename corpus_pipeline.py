"""The stages of a training-data pipeline over ``documents``, each writing Parquet that the next one reads.

Quality classifier (rejected documents go), line dedup (lines that many documents share stay in one), n-gram Jaccard
join (one document of each group of near duplicates stays), mixing of the sources to target weights (texts are taken
as often as the mix says), and SentencePiece encoding. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylode.llm import common, jaccard_join, line_dedup, mixing, quality_classifier, sentencepiece_codec
from querylode.llm import queries as q

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    return df.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good, unchanged."""
    model = q.quality_model(spark, docs, sf_dir)
    return quality_classifier.score(docs.select(*COLUMNS), model).where(F.col("score") >= q.GOOD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that it loses; the text may become empty."""
    return _documents(line_dedup.dedup(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without a word and those without an id stay.

    Rows that share an id with words are one document: the one whose text is last in order stays.
    """
    groups = common.stored(jaccard_join.near_duplicates(docs), "groups").where("doc_id IS NOT NULL")
    others = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__id")).distinct()
    often = groups.where("n_shingles > 0").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id")
    # Both lists of ids in one join: the texts are shuffled once.
    marks = others.withColumn("__goes", F.lit(True)).union(often.withColumn("__goes", F.lit(False)))
    marks = common.stored(marks.groupBy("__id").agg(F.max("__goes").alias("__goes")), "marked-ids")
    marked = docs.select(*COLUMNS).join(marks, F.col("doc_id") == F.col("__id"), "left")
    if marks.where("NOT __goes").isEmpty():
        return marked.where("__goes IS NULL").select(*COLUMNS)
    # A row of its own for each one whose id isn't marked: only rows of marked ids are ranked.
    alone = F.when(F.col("__goes").isNull(), F.monotonically_increasing_id())
    first = Window.partitionBy("doc_id", "__row").orderBy(F.desc("text"))
    kept = marked.where("NOT coalesce(__goes, false)").withColumn("__row", alone).withColumn("__n", F.row_number().over(first))
    return kept.where("__n = 1").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: whole texts as often as it says, and parts of texts on top."""
    return _documents(mixing.take(docs.select(*COLUMNS), q.WEIGHTS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of ids of every text, and digests of its ids and of the text decoded from them."""
    return sentencepiece_codec.encode(docs, q.vocabulary("piece_bpe_32k.model"), digest=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
# Trained models and seeded choices have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder before the next stage reads it."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
