"""Mixing sources to target weights: block quotas by Sainte-Lague, then seeded selection of blocks.

Sizes are words. A source's target is its weight's share of the mix; targets stop at ``repeats`` times the source's
size and what is over is shared again by weight. The mix is cut into blocks of equally many words. Blocks go to the
sources by the highest quotients target / (2 s + 1), and a source's blocks go to its shards in the same way by the
shards' sizes. A shard is about ``shard_docs`` documents, dealt by a seeded hash, so a source of any size has shards
of bounded size. In a shard the documents stand on a line in seeded order; the line, repeated, is cut into blocks,
and the shard's quota takes blocks in seeded order, all of one round before the next. The last block of a shard is
shorter where its line ends. All is DataFrame work, and reruns give the same rows.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in the order of
weights; an empty table gives no rows; rows that repeat are rows of their own; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylode.llm import common

SHARD_DOCS = 2048
# Blocks of the whole mix for each document: a block is a part of a usual document at any scale.
BLOCKS_PER_DOC = 4.0


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (the number of words) and a hash of the text."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD))
    return docs.select("doc_id", "source", words.cast("bigint").alias("size"), F.xxhash64("text").alias("key"))


def targets(sources: DataFrame, weights: list[int], share: float, repeats: float) -> DataFrame:
    """Add weight and target to (source, source_size): each target is at most ``repeats`` times the source's size.

    Sharing the excess again and again ends where the sources with the smallest cap per weight are full and the rest
    share by weight. With the sources in that order, running sums give the last full one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # by code point: binary order
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    levelled = (
        ranked.withColumn("goal", share * F.sum("source_size").over(all_rows))
        .withColumn("rest", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.sum("weight").over(onward))
        # Full while the level that is left for it and those after it reaches its cap.
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("last_level", F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(all_rows))
    )
    level = F.col("last_level.level")
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def apportion(rows: DataFrame, groups: list[str], votes: str, seats: Column, key: str, out: str) -> DataFrame:
    """Add ``out``: each group's seats, dealt by the highest quotients votes / (2 s + 1); ties go to the smaller key.

    Seats that any divisor near the exact one must give are given at once; of each row only the few seats around
    them are ranked, at most two rows for each row on average.
    """
    one = Window.partitionBy(*groups)
    total, n = F.sum(F.col(votes).cast("double")).over(one), F.count(F.lit(1)).over(one)
    q = F.col(votes).cast("double")
    spread = F.col("__n") / 2 + 1

    def at_divisor(more: Column) -> Column:
        # The seats with quotient of at least total / (seats + more), as votes / (s + 1/2) >= divisor.
        wanted = F.greatest(F.col("__seats") + more, F.lit(0.0))
        return F.when(F.col("__total") > 0, F.floor(q * wanted / F.col("__total") + 0.5)).otherwise(0)

    based = (
        rows.withColumn("__seats", seats.cast("double")).withColumn("__total", total).withColumn("__n", n)
        .withColumn("__low", at_divisor(-spread)).withColumn("__high", F.greatest(at_divisor(spread), F.col("__low")))
        .withColumn("__left", F.col("__seats") - F.sum("__low").over(one))
    )
    seat = F.explode_outer(F.expr("CASE WHEN __high > __low THEN sequence(__low, __high - 1) END"))
    by_quotient = one.orderBy((q / (2 * F.col("__s") + 1)).desc_nulls_last(), F.col("__s"), F.col(key).asc_nulls_last())
    dealt = based.withColumn("__s", seat).withColumn("__rank", F.row_number().over(by_quotient))
    won = F.col("__s").isNotNull() & (F.col("__rank") <= F.col("__left"))
    names = rows.columns
    same = [F.first(c).alias(c) for c in names if c not in (*groups, key)]
    given = (F.first("__low") + F.sum(won.cast("bigint"))).cast("bigint").alias(out)
    return dealt.groupBy(*groups, key).agg(*same, given).select(*names, out)


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 0,
    shard_docs: int = SHARD_DOCS,
    blocks_per_doc: float = BLOCKS_PER_DOC,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and how it is taken: ``rounds`` times as a whole, and once more the
    words from - to of ``pieces``; also the hash of the text, the shard and its quota. One row for each row of ``docs``.
    """
    spark = docs.sparkSession
    sizes = common.stored(sized(docs), "mix-sizes")  # the texts are read once
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    n_shards = F.greatest(F.ceil(F.col("__docs") / shard_docs), F.lit(1))
    goals = targets(sources.select("source", "source_size"), weights, share, repeats)
    goals = sources.select(F.col("source").alias("__s"), "__docs", n_shards.alias("__shards")).join(
        goals, F.col("__s").eqNullSafe(F.col("source"))
    ).drop("__s")
    # The words of a block: the mix in about as many blocks as documents, at least one word each.
    everything = Window.partitionBy()
    block = F.greatest(
        F.floor(F.sum("target").over(everything) / F.greatest(blocks_per_doc * F.sum("__docs").over(everything), F.lit(1.0))),
        F.lit(1),
    )
    goals = goals.withColumn("block", block).withColumn("__blocks", F.round(F.sum("target").over(everything) / F.col("block")))
    quotas = apportion(goals, [], "target", F.col("__blocks"), "source", "source_blocks")
    quotas = common.stored(quotas, "mix-quotas")
    # Documents with their shard; sources are few, but nothing bounds them: a join that Spark plans by size.
    places = quotas.select(F.col("source").alias("__s"), "__shards", "block", "source_size", "target", "source_blocks")
    dealt = sizes.join(places, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    shard = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("__shards")).cast("int")
    dealt = dealt.withColumn("shard", shard)
    shards = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"), F.first("block").alias("block")
    )
    shard_quotas = apportion(shards, ["source"], "shard_size", F.col("source_blocks"), "shard", "quota")
    lines = dealt.join(
        shard_quotas.select(F.col("source").alias("__s"), F.col("shard").alias("__k"), "shard_size", "quota"),
        F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__k")),
    ).drop("__s", "__k")
    order = Window.partitionBy("source", "shard").orderBy(
        F.xxhash64("doc_id", F.lit(seed + 1)), F.col("doc_id").asc_nulls_last(), "size"
    )
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumn("__row", F.row_number().over(order)).withColumn("__end", end)
    return select_blocks(placed, repeats, seed).select(
        "doc_id", "size", "source_size", "target", "taken", "shard", "quota", "key", F.col("__rounds").alias("rounds"), "pieces"
    )


def select_blocks(placed: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Add taken: the words that a shard's quota of blocks takes from each document at [__end - size, __end).

    The line of a shard has n = ceil(shard_size / block) blocks. Whole rounds take all of them, and what is left of
    the quota takes the first blocks in seeded order. A document is one row for each block that it touches.
    """
    n = F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1))
    used = F.least(F.col("quota"), repeats * n)
    start = F.col("__end") - F.col("size")
    first, last = F.floor(start / F.col("block")), F.floor((F.col("__end") - 1) / F.col("block"))
    blocks = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("bigint")))
    pieces = placed.withColumn("__rounds", F.floor(used / n)).withColumn("__more", used % n).withColumn("__b", F.explode(blocks))
    begin = F.col("__b") * F.col("block")
    words = F.when(
        F.col("__b") >= 0, F.least(F.col("__end"), begin + F.col("block")) - F.greatest(start, begin)
    ).otherwise(0)
    by_seed = Window.partitionBy("source", "shard").orderBy(
        (F.col("__b") < 0).cast("int"), F.xxhash64("source", "shard", "__b", F.lit(seed + 2)), "__b"
    )
    chosen = (F.dense_rank().over(by_seed) <= F.col("__more")).cast("bigint")
    taken = words * (F.col("__rounds") + chosen)
    piece = F.struct((F.greatest(start, begin) - start).alias("from"), words.cast("bigint").alias("words"))
    names = [*placed.columns, "__rounds"]
    keep = [F.first(c).alias(c) for c in names if c not in ("source", "shard", "__row")]
    return (
        pieces.withColumns({"__taken": taken, "__piece": F.when((chosen > 0) & (words > 0), piece)})
        .groupBy("source", "shard", "__row")
        .agg(*keep, F.sum("__taken").cast("bigint").alias("taken"), F.sort_array(F.collect_list("__piece")).alias("pieces"))
    )


def take(docs: DataFrame, weights: list[int], share: float = 1.5, repeats: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy, and one for the pieces that come on top.

    The pieces of a document keep their order and white space. Equal rows share what is taken of them.
    """
    mixed = mix(docs, weights, share, repeats, seed).where(F.col("taken") > 0)
    whole = F.array_repeat(F.struct(F.lit(None).cast("array<struct<from:bigint,words:bigint>>").alias("p")), F.col("rounds").cast("int"))
    more = F.when(F.size("pieces") > 0, F.array(F.struct(F.col("pieces").alias("p")))).otherwise(F.slice(whole, 1, 0))
    copies = mixed.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("size").alias("__size"), F.concat(whole, more).alias("__c"))
    copies = copies.groupBy("__id", "__key", "__size").agg(F.flatten(F.collect_list("__c")).alias("__c"))
    # Null ids as a key of their own, so that one shuffle of the texts serves the window and the join.
    named = lambda c: F.concat(F.when(F.col(c).isNull(), "").otherwise("="), F.coalesce(F.col(c).cast("string"), F.lit("")))
    once = Window.partitionBy("__own", "__k").orderBy(F.lit(0))
    own = docs.withColumn("__own", named("doc_id")).withColumn("__k", F.xxhash64("text"))
    own = own.withColumn("__n", F.row_number().over(once)).where(F.col("__n") == 1)
    copies = copies.withColumn("__id", named("__id"))
    joined = own.join(copies, (F.col("__own") == F.col("__id")) & (F.col("__k") == F.col("__key")))
    words = F.regexp_extract_all("text", F.lit(f"{common.WORD}{common.SPACE}*"), F.lit(0))
    parts = F.transform("__p.p", lambda x: F.array_join(F.slice(words, x["from"].cast("int") + 1, x["words"].cast("int")), ""))
    in_all = F.aggregate("__p.p", F.lit(0).cast("bigint"), lambda n, x: n + x["words"])
    text = F.when(F.col("__p.p").isNull() | (in_all == F.col("__size")), F.col("text")).otherwise(F.array_join(parts, ""))
    return joined.withColumn("__p", F.explode("__c")).withColumn("text", text).select(*docs.columns)
