"""Exact de-duplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, salts

MOST_SALTS = 240


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """Groups of rows with equal (normalised) text, and the row of each group that stays.

    Returns one row per input row: the input's id, ``keep_id`` (the largest id of the group), ``group_size``,
    ``kept`` and ``text_sha256``. Three combining steps, each of which compares whole texts and not only digests:
    rows of one task are combined by the partial aggregate before anything is shuffled; the groups of one salt are
    combined after the first shuffle; the winners of the salts, at most one row per salt and text, after the second.
    The salt of the combining is the task of the first scan, so a text that makes up a third of all rows is still one
    row per task when it is shuffled. Ids are looked up by digest and a second salt, a hash of the id that any task
    computes alike; there are as many salts as shuffle partitions, but MOST_SALTS at most. More would only split one
    text's ids, rows of a hundred bytes, over more than 240 tasks.

    Null text counts as empty. Rows that repeat an id: ``kept`` is true for each copy of the winning id. A null id
    is smaller than any other and stays only where all ids of its group are null. Very long texts are compared whole.
    An empty table gives no rows. Other columns of the input are not looked at, whatever they are called.
    """
    words = -(-min(MOST_SALTS, salts(docs.sparkSession)) // 60)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("content"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(60 * words)).cast("int").alias("salt"),
    ).withColumn("digest", F.sha2("content", 256))

    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s.cast("int"))
    # The salts that the ids of a text have, as bits of a few longs.
    masks = [f"mask{k}" for k in range(words)]
    bits = [F.bit_or(F.when(F.col("salt").between(60 * k, 60 * k + 59), bit(F.col("salt") - 60 * k))).alias(m) for k, m in enumerate(masks)]
    of_task = F.pmod(F.spark_partition_id(), F.lit(60 * words)).alias("task")
    by_task = rows.groupBy("digest", of_task, "content").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"), F.min("salt").alias("low"), F.max("salt").alias("high"), *bits)
    by_text = by_task.groupBy("digest", "content").agg(
        F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.bit_or(m).alias(m) for m in masks],
    )
    # The look-up is by digest: were there two texts of one digest, the query would stop here.
    found = by_text.groupBy("digest").agg(*[F.max(c).alias(c) for c in ("keep_id", "group_size", "low", "high", *masks)], F.count("*").alias("texts"))
    found = found.where(F.assert_true(F.col("texts") == 1, F.lit("two texts share a digest")).isNull())
    has = lambda s: F.element_at(F.array(*masks), (s / 60).cast("int") + 1).bitwiseAND(bit(s % 60)) != 0
    every = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.filter(F.sequence("low", "high"), has))
    found = found.select("digest", "keep_id", "group_size", F.explode(every).alias("salt"))
    ids = rows.select("doc_id", "digest", "salt")
    return ids.join(found, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row of each group of equal (normalised) texts, that with the largest id; columns as in ``docs``.

    The same steps as ``exact_groups``, with the row that stays carried along instead of looked up. Of rows that
    repeat an id and a text one stays. Null text counts as empty; a row that stays keeps its own text. Very long
    texts are compared whole, an empty table gives no rows, and other columns are carried along, whatever they are
    called.
    """
    words = -(-min(MOST_SALTS, salts(docs.sparkSession)) // 60)
    text, doc_id = named(text_col), named(id_col)
    rest = [named(c) for c in docs.columns if c != text_col]
    same = F.coalesce(F.when(text.isNotNull(), normalise(text) == text), F.lit(False))
    # The text itself is carried only where the content doesn't tell it.
    rows = docs.select(
        normalise(F.coalesce(text, F.lit(""))).alias("content"),
        F.struct(F.struct(*rest).alias("rest"), F.when(~same, text).alias("text"), same.alias("same")).alias("row"),
        F.struct(doc_id.isNotNull().alias("a"), doc_id.alias("b")).alias("id"),
        F.pmod(F.spark_partition_id(), F.lit(60 * words)).alias("salt"),
    ).withColumn("digest", F.sha2("content", 256))
    best = [F.max_by("row", "id").alias("row"), F.max("id").alias("id")]
    by_salt = rows.groupBy("digest", "salt", "content").agg(*best)
    by_text = by_salt.groupBy("digest", "content").agg(*best)
    own = F.when(F.col("row.same"), F.col("content")).otherwise(F.col("row.text"))
    return by_text.select(*[own.alias(c) if c == text_col else F.col("row.rest").getField(c).alias(c) for c in docs.columns])
