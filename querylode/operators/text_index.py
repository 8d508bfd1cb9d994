"""Stored postings with score bounds, and exact BM25 lists of the best documents for a table of questions, by joins alone.

A posting (field, term, document, tf, length) lies in a block: those of one term whose frequency and whose document's length
have the same powers of two. A block keeps its number of postings, largest frequency and smallest length; with the corpus
numbers of the moment they bound the score of all its postings, so blocks stay true when other loads change these numbers.

The best ``size`` documents of every question are found in two passes. A few small blocks with high bounds name
promising documents for each question, and the whole scores of these set a bar that its best documents reach. Then the
terms that could not reach the bar even all together name no candidates, nor do blocks that could not with the best of all
other terms, unless reading them costs less than looking up what the candidates have in them. Blocks and candidates go to
where postings are read; only sums of a question and document are shuffled. Nothing is left out that could be among the
best, however many questions or documents there are; no text is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import let, terms
from ..session import SHIPPED, enough_partitions, new_dir, shipped, small_tasks, stored

# Postings of the blocks that set a question's bar, as a multiple of the documents wanted. Any number gives the same hits.
SEEDS = 200
# Documents whose whole scores set the bar, as a multiple of those wanted: the best by their seeds.
PROMISING = 8
# Postings that a question reads rather than looks up one: to read one costs a step of a pass that is made anyway, a lookup
# is one more pass, and a shuffle if those of all questions are many. Any number gives the same hits.
LOOK_UP = 32
# Bytes of texts in a task that cuts them into words or counts blocks.
LOAD_SPLIT = 16 << 20
# Bytes of postings in a row group, and in a task that scores them: it holds a row for each of its documents and question.
SPLIT = 2 << 20
# How postings are written. They lie as their documents do, not by term: nothing is sorted, and all that a question gets from
# a document is summed where it is read.
LAYOUT = {"parquet.block.size": str(SPLIT)}


def _counted(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, doc_id, tf, dl, counted in each document's own row: the runs of its sorted words."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(words, i - 1) != F.get(words, i)))
        entry = lambda term, tf: F.struct(term.alias("term"), tf.cast("long").alias("tf"))
        own = lambda e: F.transform(
            e, lambda end, i: entry(F.get(words, end - 1), end - F.when(i > 0, F.get(e, i - 1)).otherwise(0))
        )
        return F.concat(F.array(entry(F.lit(""), F.lit(1))), let(ends, own))

    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.sort_array(terms(F.col(f))).alias("tokens")) for f in fields]))
    rows = docs.select("doc_id", per_field.alias("x")).select("doc_id", "x.field", "x.tokens").filter(F.size("tokens") > 0)
    counted = rows.select("doc_id", "field", F.size("tokens").cast("long").alias("dl"), F.explode(runs(F.col("tokens"))).alias("w"))
    return counted.select("field", "w.term", "doc_id", "w.tf", "dl")


def postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, level, doc_id, tf, dl; one row with the term '' for each document that has words in a field.

    Nothing but ids is shuffled, so a task holds the words of its own piece of the input. Only the rows of an id that comes
    more than once are brought together: their words count as one document's.
    """
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    again = stored(again.select(F.col("doc_id").alias("again")), "repeated-ids")
    repeated = F.col("doc_id").eqNullSafe(F.col("again"))
    counted = _counted(docs.join(again, repeated, "left_anti"), fields)
    if not again.isEmpty():
        shared = _counted(docs.join(again, repeated, "left_semi"), fields).groupBy("field", "term", "doc_id")
        counted = counted.unionByName(shared.agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")))
    power = lambda c: F.length(F.bin(c))
    return counted.select("field", "term", (64 * power("tf") + 64 - power("dl")).alias("level"), "doc_id", "tf", "dl")


def blocks(found: DataFrame) -> DataFrame:
    """field, term, level, n, max_tf, min_dl, total (words of the field, in rows of the term '')."""
    total = F.sum(F.when(F.col("term") == "", F.col("dl")))
    return found.groupBy("field", "term", "level").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), total.alias("total")
    )


@dataclass
class TextIndex:
    """``postings``, their ``blocks``, and ``counts`` (field, term, df, total); only the documents of ``ids`` are found.

    The weights of words stay those of all documents, as do the bounds of blocks, which hold for fewer documents as well.
    """

    postings: DataFrame
    blocks: DataFrame
    counts: DataFrame
    ids: DataFrame | None = None
    # Rows that ``blocks`` and ``counts`` are summed from, if they are.
    stored_blocks: int = 0

    def among(self, ids: DataFrame) -> TextIndex:
        """The index restricted to the documents of ``ids`` (doc_id)."""
        return replace(self, ids=stored(ids.select("doc_id"), "allowed-documents"))

    def allowed(self) -> DataFrame:
        """The postings of the documents that may be found."""
        return self.postings if self.ids is None else self.postings.join(_shipped(self.ids), "doc_id", "left_semi")


def write(docs: DataFrame, fields: list[str], path: str | None = None) -> TextIndex:
    """Write the index of ``docs`` below ``path`` or in the shared folder."""
    spark = docs.sparkSession
    path = path or new_dir(spark, "text-index")
    with small_tasks(spark, LOAD_SPLIT):
        postings(docs, fields).write.mode("overwrite").options(**LAYOUT).parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        with enough_partitions(spark, written.count()):
            blocks(written).write.mode("overwrite").parquet(f"{path}/blocks")
    return read(spark, path)


def read(spark, path: str) -> TextIndex:
    own = spark.read.parquet(f"{path}/blocks")
    counts = own.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))
    return TextIndex(spark.read.parquet(f"{path}/postings"), own, counts, stored_blocks=own.count())


def _shipped(rows: DataFrame) -> DataFrame:
    """Stored rows, for a join with postings: they go to all tasks unless they are too many."""
    return shipped(rows, SHIPPED)


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(terms(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _by_field(values: dict[str, float]) -> Column:
    chosen = F.lit(None).cast("double")
    for field, value in values.items():
        chosen = F.when(F.col("field") == field, F.lit(float(value))).otherwise(chosen)
    return chosen


def best_by_text(index: TextIndex, questions: DataFrame, boosts: dict[str, float], size: int, also: DataFrame | None = None, near: float = 1e-6) -> DataFrame:
    """qid, doc_id, text_score: at least the best ``size`` documents of every question and all whose score is within ``near``
    of theirs, so that rounded scores can be ranked, and the documents of ``also`` (qid, doc_id) that have a word of the
    question. The best boosted field counts."""
    with small_tasks(questions.sparkSession, SPLIT):
        return _best_by_text(index, questions, boosts, size, also, near)


def _read_by(blocks: DataFrame) -> int:
    """Postings in some blocks, counted for each of their questions: the rows that a join with them makes."""
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _best_by_text(index: TextIndex, questions: DataFrame, boosts: dict[str, float], size: int, also: DataFrame | None, near: float) -> DataFrame:
    spark, fields = questions.sparkSession, list(boosts)
    # One row for each field.
    totals = {r["field"]: (r["df"], r["total"] / r["df"]) for r in index.counts.filter("term = ''").collect() if r["df"]}
    n_docs, average = ({f: totals.get(f, (0, 1.0))[i] for f in fields} for i in (0, 1))
    df = F.col("df").cast("double")
    idf = F.log(1.0 + (_by_field(n_docs) - df + 0.5) / (df + 0.5))
    weight = _by_field(boosts) * F.col("qtf") * idf * (fv.BM25_K1 + 1)

    def part(tf: Column, dl: Column) -> Column:
        """What a posting adds to the boosted score of its field."""
        norm = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * dl / _by_field(average))
        return F.col("weight") * tf / (tf + norm)

    known = index.counts.filter(F.col("field").isin(fields) & (F.col("term") != ""))
    asked = question_terms(questions).join(known, "term").select("qid", "field", "term", weight.alias("weight"))
    with enough_partitions(spark, index.stored_blocks):
        asked = stored(asked, "question-terms")
    bound = part(F.col("max_tf"), F.col("min_dl"))
    held = asked.join(index.blocks, ["field", "term"]).select("qid", "field", "term", "level", "n", "weight", bound.alias("bound"))
    most = held.groupBy("qid", "field", "term").agg(F.max("bound").alias("most"))
    # Terms with the least bounds first: ``upto`` is what they reach together.
    by_bound = W.partitionBy("qid", "field").orderBy("most", "term")
    all_of = W.partitionBy("qid", "field")
    most = most.select("qid", "field", "term", "most", F.sum("most").over(by_bound).alias("upto"), F.sum("most").over(all_of).alias("all"))
    with enough_partitions(spark, index.stored_blocks):
        held = stored(held.join(most, ["qid", "field", "term"]), "question-blocks")

    key = ["field", "term", "level"]
    seeds = SEEDS * size
    small = W.partitionBy("qid", "field").orderBy(F.desc("bound"), "term", "level").rowsBetween(W.unboundedPreceding, -1)
    first = held.filter(F.col("n") <= seeds).withColumn("_before", F.coalesce(F.sum("n").over(small), F.lit(0))).filter(F.col("_before") < seeds)
    first = stored(first.select("qid", *key, "n", "weight"), "seed-blocks")
    reached = index.allowed().join(_shipped(first.drop("n")), key).select("qid", "field", "doc_id", part(F.col("tf"), F.col("dl")).alias("s"))
    reached = reached.groupBy("qid", "doc_id", "field").agg(F.sum("s").alias("s")).groupBy("qid", "doc_id").agg(F.max("s").alias("s"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("s"), "doc_id"))

    def whole(pairs: DataFrame) -> DataFrame:
        """The scores of some documents (stored rows), from their own postings."""
        own = index.postings.join(_shipped(pairs), "doc_id")
        scored = own.join(_shipped(asked), ["qid", "field", "term"]).select("qid", "doc_id", "field", part(F.col("tf"), F.col("dl")).alias("s"))
        return scored.groupBy("qid", "doc_id", "field").agg(F.sum("s").alias("s")).groupBy("qid", "doc_id").agg(F.max("s").alias("s"))

    def bars(found: DataFrame) -> DataFrame:
        """qid, bar: the score of the last of the best ``size`` documents, for questions that have so many."""
        ranked = found.withColumn("_place", place).filter(F.col("_place") <= size)
        return ranked.filter(F.col("_place") == size).select("qid", F.col("s").alias("bar"))

    promising = reached.withColumn("_place", place).filter(F.col("_place") <= PROMISING * size).select("qid", "doc_id")
    with enough_partitions(spark, _read_by(first)):
        promising = stored(promising, "promising")
    with enough_partitions(spark, promising.count() * len(fields)):
        set_by_promising = stored(bars(whole(promising)), "bars")

    bar = F.coalesce("bar", F.lit(0.0)) - 4 * near
    may = (F.col("upto") >= bar) & (F.col("bound") + F.col("all") - F.col("most") >= bar)
    barred = held.join(set_by_promising, "qid", "left").withColumn("names", may).withColumn("bar", bar)
    # Reading the other blocks as well costs a question their postings; looking them up costs each candidate its terms, and
    # a shuffle if the candidates of all questions are many.
    passed_terms = F.size(F.collect_set(F.when(~F.col("names"), F.col("term"))))
    look_up = F.least(F.sum(F.when(F.col("names"), F.col("n")).otherwise(0)).cast("double"), F.first(_by_field(n_docs))) * passed_terms * LOOK_UP
    cheap = barred.groupBy("qid", "field").agg((F.sum(F.when(~F.col("names"), F.col("n")).otherwise(0)) <= look_up).alias("cheap"))
    barred = barred.join(cheap, ["qid", "field"]).withColumn("names", F.col("names") | F.col("cheap"))
    # What a term can still add to a document without a posting in its naming blocks.
    rest = barred.groupBy("qid", "field", "term").agg(F.max(F.when(~F.col("names"), F.col("bound"))).alias("rest"))
    rest = rest.select("qid", "field", "term", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    rest = rest.withColumn("all_rest", F.sum("rest").over(all_of))
    with enough_partitions(spark, held.count()):
        held = stored(barred.select("qid", *key, "n", "weight", "names", "bar").join(rest, ["qid", "field", "term"]), "barred-blocks")
    # A document's postings lie together, so that a task sums most of them before the shuffle.
    pairs = asked.select("qid").distinct().count() * sum(n_docs.values())
    names = _shipped(held.filter("names").select("qid", *key, "weight", "rest"))
    met = index.allowed().join(names, key).withColumn("s", part(F.col("tf"), F.col("dl")))
    # What a document has so far; it has at most the rests of its other terms besides.
    limits = held.groupBy("qid", "field").agg(F.max("all_rest").alias("all_rest"), F.max("bar").alias("bar"))
    met = met.groupBy("qid", "doc_id", "field").agg(F.sum("s").alias("s"), F.sum("rest").alias("rest"))
    at_most = F.col("s") + F.col("all_rest") - F.col("rest")
    hopeful = met.join(_shipped(stored(limits, "limits")), ["qid", "field"]).filter(at_most >= F.col("bar"))
    with enough_partitions(spark, min(_read_by(held.filter("names")), pairs)):
        hopeful = stored(hopeful.select("qid", "doc_id", "field", "s", at_most.alias("at_most")), "hopeful")
    if (rows := hopeful.count()) > SHIPPED:
        # What they have so far sets a higher bar: what is looked up and ranked grows less than the documents.
        with enough_partitions(spark, rows):
            higher = stored(bars(hopeful.groupBy("qid", "doc_id").agg(F.max("s").alias("s"))), "higher-bars")
            hopeful = stored(hopeful.join(_shipped(higher), "qid", "left").filter(F.col("at_most") >= bar).drop("bar"), "most-hopeful")
    hopeful = hopeful.drop("at_most")
    passed = stored(held.filter(~F.col("names")).select("qid", *key, "n", "weight"), "passed-blocks")
    found, rows = hopeful, hopeful.count()
    if not passed.isEmpty():
        wanted = stored(hopeful.select("qid", "doc_id", "field").join(passed.select("qid", "field").distinct(), ["qid", "field"], "left_semi"), "wanted")
        own = index.postings.join(_shipped(wanted), ["doc_id", "field"])
        added = own.join(_shipped(passed.drop("n")), ["qid", *key])
        rows += min(_read_by(passed), pairs)
        found = hopeful.unionByName(added.select("qid", "doc_id", "field", part(F.col("tf"), F.col("dl")).alias("s")))
    found = found.groupBy("qid", "doc_id", "field").agg(F.sum("s").alias("s"))
    found = found.groupBy("qid", "doc_id").agg(F.max("s").alias("s"))
    if also is not None:
        also = stored(also.select("qid", "doc_id").distinct(), "vector-hits")
        found = found.unionByName(whole(also)).groupBy("qid", "doc_id").agg(F.max("s").alias("s"))
        rows += also.count() * len(fields)
    with enough_partitions(spark, rows):
        return stored(found.withColumnRenamed("s", "text_score"), "text-hits")
