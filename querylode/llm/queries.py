"""The registered query of each operator: ``QUERIES`` by name, ``ORACLES`` where SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm import (
    byte_bpe, common, fingerprints, hmm_scoring, jaccard_join, language_id, line_dedup, mixing, periodic_runs, quality_classifier,
    quality_rules, sentencepiece_codec, spelling_variants, suffix_dedup,
)

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn=None, *, oracle: str | None = None):
    if fn is None:
        return lambda f: query(f, oracle=oracle)
    QUERIES[fn.__name__] = fn
    if oracle is not None:
        ORACLES[fn.__name__] = oracle
    return fn


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.remainder("doc_id", 3) == 1
    net = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs, net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS u(i)),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM keyed k LEFT JOIN held h ON k.key = h.key AND length(k.key) >= 20
GROUP BY k.doc_id"""


@query(oracle=LINE_DEDUP_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(common.read(spark, sf_dir, "documents"), digest=True)


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return hmm_scoring.score(docs.withColumn("held_out", common.remainder("doc_id", 10) == 0))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(common.read(spark, sf_dir, "documents"))


QUALITY_RULES_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(i - before, 5))) AS n
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, string_split(t, chr(10))[p] AS line
  FROM (SELECT doc_id, source, t, unnest(generate_series(1, len(string_split(t, chr(10))))) AS p FROM d)),
keyed AS (
  SELECT *, regexp_replace(lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g') AS k
  FROM lines),
over AS (SELECT source, k FROM keyed WHERE k <> '' GROUP BY source, k HAVING count(DISTINCT doc_id) >= 5),
removed AS (
  SELECT doc_id, sum(length(line)) AS n FROM keyed SEMI JOIN over USING (source, k) GROUP BY doc_id),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed.n, 0) AS BIGINT) AS removed_chars,
         length(replace(t, chr(10), '')) AS line_chars
  FROM d JOIN w USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)
  LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_chars,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (removed_chars > 0 AND line_chars - removed_chars < 0.3 * line_chars) AS kept
FROM counts"""


@query(oracle=QUALITY_RULES_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(common.read(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Trees:
    """Learned from the labels outside the held-out fold."""
    labels = common.read(spark, sf_dir, "labels").where(common.remainder("doc_id", 5) != 0)
    return quality_classifier.train(docs, labels.select("doc_id", F.col("quality").alias("label")))


# A text with a score of at least this is good.
GOOD = 0.3


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_model(spark, docs, sf_dir))
    held_out = (common.remainder("doc_id", 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


# Weights of the sources in order, repeating.
WEIGHTS = [5, 2, 1]


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.read(spark, sf_dir, "documents"), WEIGHTS, share=1.5, repeats=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shard", "quota")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(common.read(spark, sf_dir, "documents"), length=200, digest=True)


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return sentencepiece_codec.encode(docs, vocabulary("piece_bpe_32k.model"), digest=True)


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(common.read(spark, sf_dir, "documents"))


# One letter of every run whose key's crc32 this divides is deleted before words are counted.
DROP_EVERY = 199


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.vocabulary(common.read(spark, sf_dir, "documents"), drop_every=DROP_EVERY)
    return spelling_variants.variants(words)


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, vocabulary("byte_bpe_50k.json"), digest=True)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts, every tenth of them (by crc32 of its id) repeating a block of its words from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("bigint"), F.floor(h / 10)
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        both = F.struct(start.alias("a"), period.alias("p"))
        place = lambda i, c: F.when(i < c["a"], i).otherwise(c["a"] + (i - c["a"]) % c["p"]).cast("int")
        new = quality_rules.let(both, lambda c: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, place(i, c))))
        return F.when(n > 0, F.array_join(new, " ")).otherwise(F.lit(""))

    changed = quality_rules.let(quality_rules.words(F.coalesce("text", F.lit(""))), repeated)
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(with_repeats(common.read(spark, sf_dir, "documents")))
    higher = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    none = F.lit(None).cast(periodic_runs.RUN)
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | higher(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
