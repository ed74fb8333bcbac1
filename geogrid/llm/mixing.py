"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, named, stored

# Expected copies are whole numbers of this unit, so that prefix sums are exact and the same in every run.
UNIT = 1_000_000_000


def ranked_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``sources`` (one row per source) with ``weight``: the weights in turn, by code point of the name, null last.

    One window over the source names: a table of one row per source, never of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    return sources.withColumn("weight", weight)


def water_filled(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    ``share`` of all sizes is dealt out by weight; no target is above ``cap`` times its source's size, and what a
    capped source leaves goes to the others by weight. The sources that are capped are those with the smallest
    (cap * size / weight), so one pass in that order finds the level at which the rest is filled.
    """
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    x = (
        sources.withColumn("limit", F.col("source_size") * F.lit(cap))
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("used", F.coalesce(F.sum("limit").over(before), zero))
        .withColumn("used_weight", F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("fill", (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("used_weight")))
        # Filling rises until the first source that stays open and falls after it: its peak is the level sought.
        .withColumn("peak", F.max("fill").over(every))
    )
    target = F.least(F.col("limit"), F.col("peak") * F.col("weight"))
    return x.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, 0 to UNIT - 1, from the seed and the name alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return F.floor(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") * F.lit(UNIT) / F.lit(1 << 32)).cast("long")


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How often each document goes into the mix: systematic sampling within its source.

    Returns one row per input row: ``doc_id, text_hash, source, size, source_size, target, copies``. Every document of a source has the
    same expected number of copies, target / source_size, which is at most ``cap``. Within the source, in order of
    (size, doc_id, text_hash), expected copies are summed up from one random offset, and a document is emitted once
    per whole number that its sum crosses: neighbours in size take turns, so the words taken stay within about one
    document of the target.

    The order is a range partitioning, so a source that has a third of all rows is cut over many tasks; a task's sum
    starts where the sums of the tasks before it end. Null source is a source of its own, null text has size 0. Rows
    that repeat one another are separate documents. A source of size 0 has target 0 and no copies. An empty table
    gives no rows. Columns other than doc_id, text and source are not looked at.
    """
    spark = docs.sparkSession
    # Stored before it is ranged: finding the ranges reads it a second time, and words are counted once.
    slim = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", n_words(F.col("text")).alias("size")), "sizes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.repartitionByRange(n, "source", "size", "doc_id", "text_hash")
    # Stored once: both uses below must see the same cut.
    slim = stored(ranged.withColumn("part", F.spark_partition_id()), "mix")

    parts = slim.groupBy("source", "part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = water_filled(ranked_weights(sizes, weights), share, cap)
    rate = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)) * F.lit(UNIT)).cast("long")
    targets = targets.withColumn("rate", rate).withColumn("first", offset(F.col("source"), seed))

    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("rows_before", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of", "part_size", "part_rows")
    )
    within = Window.partitionBy("source", "part").orderBy("size", "doc_id", "text_hash")
    x = slim.withColumn("nth", F.row_number().over(within))
    starts = starts.withColumnsRenamed({"source": "of", "part": "of_part"})
    x = x.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    # Whole numbers throughout: a quotient of decimals would be rounded up just below an integer.
    upto = lambda rows: F.call_function("div", rows.cast("decimal(19,0)") * F.col("rate").cast("decimal(11,0)") + F.col("first"), F.lit(UNIT).cast("decimal(11,0)"))
    last = F.col("rows_before") + F.col("nth")
    return x.select("doc_id", "text_hash", "source", "size", "source_size", "target", (upto(last) - upto(last - 1)).cast("int").alias("copies"))


def numbered(repeats: DataFrame) -> DataFrame:
    """``repeats`` with ``__mix_nth``: the rows of each (__mix_id, __mix_hash) from 1, in any order.

    Rows are numbered within the tasks that they are in, after the counts of earlier tasks.
    """
    # Stored, so that every use sees the same tasks.
    x = stored(repeats.withColumn("__mix_part", F.spark_partition_id()), "repeats")
    key = ["__mix_id", "__mix_hash"]
    parts = x.groupBy(*key, "__mix_part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__mix_before")
    parts = parts.select(F.col("__mix_id").alias("id"), F.col("__mix_hash").alias("hash"), F.col("__mix_part").alias("part"), before)
    within = Window.partitionBy(*key, "__mix_part").orderBy(F.xxhash64("__mix_row"))
    x = x.withColumn("__mix_in", F.row_number().over(within))
    x = x.join(parts, F.col("__mix_id").eqNullSafe(F.col("id")) & (F.col("__mix_hash") == F.col("hash")) & (F.col("__mix_part") == F.col("part")))
    return x.withColumn("__mix_nth", F.col("__mix_before") + F.col("__mix_in"))


def emit(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as ``mix`` says; columns as in ``docs``.

    doc_id is the key of documents. Rows that repeat both id and text share their copies, and it is dealt out which
    of them have one more, so the mix gets just as many as it says: they are numbered within the tasks that they are
    in, after the counts of earlier tasks, so a row that a third of all rows repeat is in no one task. Null ids and
    texts are keys like others, an empty table gives no rows, and extra columns are carried along, whatever they are
    called.
    """
    copies = mix.groupBy(F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_hash")).agg(
        F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_rows")
    )
    copies = stored(copies.where("__mix_copies > 0"), "copies")
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("__mix_row"), F.col("doc_id").alias("__mix_doc"), F.xxhash64("text").alias("__mix_of"))
    same = F.col("__mix_doc").eqNullSafe(F.col("__mix_id")) & (F.col("__mix_of") == F.col("__mix_hash"))
    x = rows.join(copies.where("__mix_rows = 1"), same).withColumn("__mix_nth", F.lit(1).cast("long"))
    repeats = copies.where("__mix_rows > 1")
    if not repeats.isEmpty():
        x = x.unionByName(numbered(rows.join(repeats, same)).select(x.columns))
    total, n = F.col("__mix_copies"), F.col("__mix_rows")
    own = F.call_function("div", total, n) + (F.col("__mix_nth") <= total % n).cast("int")
    return x.where(own > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), own))).select("__mix_row.*")
