"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``, within a ``job`` in that job's folder.

    Where the session names none, a temporary folder is set for it in local mode (tests on one machine); on a
    cluster, whose hosts have different disks, that is an error.
    """
    root = spark.conf.get("spark.geogrid.job", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-geogrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    A lost executor costs at most the tasks that ran on it, and readers get only the columns they use.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def job(spark: SparkSession, name: str) -> Iterator[None]:
    """Intermediate tables written within go to one folder, which is deleted at the end, also after an error.

    What is to outlive the job is written, to a path named before, while it lasts: a DataFrame that is read only
    later would miss its tables.
    """
    path, setting = scratch(spark, name), "spark.geogrid.job"
    outer = spark.conf.get(setting, None)
    spark.conf.set(setting, path)
    try:
        yield
    finally:
        spark.conf.set(setting, outer) if outer else spark.conf.unset(setting)
        delete(spark, path)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def named(column: str) -> Column:
    """The column of this very name, whatever marks are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def id_schema(docs: DataFrame, *rest: str, name: str = "doc_id") -> T.StructType:
    """The id column as ``docs`` has it, and after it the columns that the DDL strings of ``rest`` name."""
    return T.StructType([T.StructField(name, docs.schema["doc_id"].dataType), *T.StructType.fromDDL(", ".join(rest)).fields])


def salts(spark: SparkSession) -> int:
    """Salts for hot keys: as many as there are shuffle partitions, so that one key can use them all."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
