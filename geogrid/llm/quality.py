"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

BUCKETS = 1 << 14  # a power of two
PRIOR = 4.0
SYMBOL = "[#*$%&|<>]"


def with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__text`` (null as empty) and ``__words``."""
    x = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    return x.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def alike(rows: str, field: str) -> Column:
    """Of sorted structs those whose ``field`` equals that of a neighbour."""
    at = lambda i: F.get(F.col(rows), i)[field]
    return F.filter(rows, lambda p, i: F.coalesce(p[field] == at(i - 1), F.lit(False)) | F.coalesce(p[field] == at(i + 1), F.lit(False)))


def base_counts(worded: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A word is repeated if it is in a window of three words that the text has twice or more. Equal windows have equal
    hashes: only texts with a hash that comes twice sort their hashes, and only windows under such hashes are then
    compared as strings, which decides. Words have no spaces, so joined windows are equal if all their words are.
    """
    x = worded.withColumn("n_words", F.size("__words").cast("long"))
    x = x.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    x = x.withColumn("n_symbols", F.regexp_count("__text", F.lit(SYMBOL)).cast("long"))
    x = x.withColumn("n_dup_lines", n_dup_lines(F.col("__text")))
    word = lambda i: F.get(F.col("__words"), i)
    heads = F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0)))
    x = x.withColumn("__hashes", F.transform(heads, lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2))))
    placed = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.withColumn("__placed", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), placed))
    window = lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2))
    x = x.withColumn("__again", alike("__placed", "h"))
    x = x.withColumn("__windows", F.sort_array(F.transform("__again", lambda p: F.struct(window(p["i"]).alias("w"), p["i"].alias("i")))))
    words = F.flatten(F.transform(alike("__windows", "w"), lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))
    n = F.coalesce(F.size(F.array_distinct(words)), F.lit(0))
    n = F.when(F.col("__placed").isNull(), 0).otherwise(n)
    return x.withColumn("n_repeat_words", n.cast("long")).drop("__hashes", "__placed", "__again", "__windows")


def bucket(*words: Column) -> Column:
    """Bucket of an n-gram."""
    return F.xxhash64(*words).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def low_words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams(words: str) -> Column:
    """Buckets of the single words and pairs of an array of words."""
    ones = F.transform(words, lambda w: bucket(w))
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(ones, F.transform(heads, lambda w, i: bucket(w, F.get(words, i + 1))))


def trusted_ids(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """Ids of the trusted sample: good and not toxic, at most ``most`` of them, those with the smallest hash."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").alias("__trusted")).distinct()
    return ids.orderBy(F.xxhash64("__trusted"), "__trusted").limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """For each bucket log P(bucket | trusted) - log P(bucket | raw).

    One is added to each raw count, and PRIOR n-grams a bucket, dealt as the raw multinomial has them, to the trusted
    counts: where little is known, the ratio is near 0. The raw multinomial counts the n-grams of every document; the trusted
    one those of documents in ``trusted``, whose size is bounded by ``trusted_ids``. Words are exploded with their next
    ones and counted within tasks first; the driver gets BUCKETS rows.
    """
    x = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("__trusted"), "left")
    x = x.select(F.col("__trusted").isNotNull().cast("long").alias("t"), low_words(F.coalesce("text", F.lit(""))).alias("w"))
    later = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
    x = x.select("t", F.explode(F.arrays_zip(F.col("w").alias("a"), later.alias("b"))).alias("p"))
    pair = F.when(F.col("p.b").isNotNull(), bucket(F.col("p.a"), F.col("p.b")))
    x = x.select("t", F.explode(F.array(bucket(F.col("p.a")), pair)).alias("b")).where("b is not null")
    rows = x.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good")).collect()
    raw, good = [1] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    every, best, prior = sum(raw), sum(good), PRIOR * BUCKETS
    return [math.log((g + prior * r / every) / (best + prior)) - math.log(r / every) for g, r in zip(good, raw, strict=True)]


def judged(docs: DataFrame, labels: DataFrame, threshold: float = -0.1, trusted_most: int = 20_000) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, score and kept.

    ``score`` is the mean log-likelihood ratio of the text's hashed words and word pairs between trusted and raw
    text; a document is kept if the base rules pass (50 words or more, at most half of the words in repeated
    windows) and its score is at least ``threshold``. Every row is decided by itself and by these two multinomials,
    at any input size in the same way. Null and empty text have no words, so they fail the base rules, score 0.
    Without labels both multinomials differ by a constant only. Rows that repeat get equal results. An empty table
    gives no rows. Columns other than doc_id and text are not looked at.
    """
    ratios = log_ratios(docs, trusted_ids(labels, trusted_most))
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")  # folded to one constant
    x = base_counts(with_words(docs.select("doc_id", "text"))).withColumn("__low", low_words(F.col("__text")))
    summed = F.aggregate(grams("__low"), F.lit(0.0), lambda a, b: a + F.get(table, b))
    x = x.withColumn("score", F.coalesce(F.try_divide(summed, 2.0 * F.col("n_words") - 1), F.lit(0.0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    x = x.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    x = x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    # Stored, or a filter on a result would be pushed down as the whole expression behind it, once for each word.
    return stored(x, "quality")
