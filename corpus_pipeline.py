"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geogrid.llm import exact_dedup, langid, mixing, near_dedup, packing
from geogrid.llm.common import delete, documents, fresh, job, scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that identification rejects go.

    Rejected are null and empty texts, texts without a letter, and those that no dictionary explains clearly better
    than the next. Repeated rows fare alike, long texts are read whole, an empty table gives no rows, and extra
    columns are carried along, whatever they are called. Where no row has a label, nothing is told and all rows go.
    """
    dictionaries = langid.learn(docs.where(~langid.held_out()))
    name = fresh("language", docs.columns)
    found = langid.predict(docs, dictionaries, keep=tuple(docs.columns), result=name)
    return found.where(~F.col(name)["rejected"]).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id; null and empty texts are equal, and so one of all stays.

    Texts of any length are compared whole, of rows that repeat an id and a text one stays, an empty table gives no
    rows, and extra columns are carried along.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates.

    Rows are told apart by their texts, so a text that is like no other stays even if its id is null or repeats.
    Null and empty texts are one class, texts of any length are compared whole, an empty table gives no rows, and
    extra columns are carried along.
    """
    return near_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, so ids can repeat.

    Null is a source of its own; null and empty texts have no words and are taken at the rate of their source. Ties
    of size go by id and text. Rows that repeat share their copies. An empty table gives no rows, and extra columns
    are carried along.
    """
    return mixing.emit(docs, mixing.mixed(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 4096, as ``packing.packed`` returns them.

    Null and empty texts are one end token.
    The mix repeats documents, so rows can repeat (doc_id, piece). Long texts are cut into pieces, none is dropped. An empty table gives no rows; other columns are not looked at.
    """
    pieces = packing.tokenised(docs).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return packing.packed(pieces)


STAGES = [
    ("language ID", identify),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

# SQL can't express compression, consistent sampling and packing; tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows.

    A stage's intermediate tables go once its result is written, and that result once the next stage's is; those of
    the last stage stay, since its rows are read from them.
    """
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        to = scratch(spark, name.replace(" ", "-"))
        with job(spark, "stage"):
            found = stage(spark, docs, sf_dir)
            schema = found.schema
            found.write.parquet(to)
        if last:
            delete(spark, last)
        docs, last = spark.read.schema(schema).parquet(to), to
    return STAGES[-1][1](spark, docs, sf_dir)
