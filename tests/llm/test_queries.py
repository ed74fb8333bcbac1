"""The registered queries of the text operators, and the pipeline's stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geogrid.llm.common import named, stored
from geogrid.llm.queries import QUERIES, SQL
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = QUERIES[name](spark, DATA)
    assert found.select("doc_id").distinct().count() == docs.count()


def test_every_dealt_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, kept[-1], DATA), "stage")
        assert out.columns == columns, name
        kept.append(out)
    known, single, distinct, mix = kept[1:]
    assert known.count() >= 0.98 * docs.count()
    assert single.count() == single.select("text").distinct().count() == known.select("text").distinct().count()
    assert distinct.join(single, "doc_id", "left_semi").count() == distinct.count() < single.count()
    assert mix.join(distinct, "doc_id", "left_anti").count() == 0
    words = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(mix) / words(distinct) - 1.5) < 0.15
    pieces = corpus_pipeline.STAGES[-1][1](spark, mix, DATA)
    assert pieces.select("doc_id").distinct().count() == mix.select("doc_id").distinct().count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_stages_of_awkward_rows(spark):
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n"), (None, text), (None, None), (4, text), (4, text), (4, text + " tail"), (5, "ab"), (6, "y" * 100_000), (7, text * 60), (7, text * 60)]
    extra = ("language", "kept", "size", "copies", "content", "name", "row", "sequence_id", "offset", "Shard", "score", "source_size", "a.b", "__text", "__same", "__row", "back`tick", "found", "rest")
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 5 else "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in extra})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, DATA), "stage")
        assert out.columns == columns, name
        assert out.select(*map(named, extra)).distinct().count() <= 1, name
        # Each stage also gets the awkward rows themselves, with nothing filtered before.
        if name != "language ID":
            docs = out
    assert docs.where("length(text) > 99999").count() >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "stage")
    assert docs.count() == 0


def test_both_copies_of_the_stores_are_alike():
    import inspect

    from geogrid.llm import common
    from geogrid.operators import storage

    code = lambda f: [x for x in inspect.getsource(f).split('"""')[2].split() if x]
    assert code(common.scratch) == code(storage.scratch) and code(common.stored) == code(storage.stored)


def test_a_job_clears_its_tables(spark):
    import os

    from geogrid.llm import common

    root = os.path.dirname(common.scratch(spark, "x")).removeprefix("file://")
    before = set(os.listdir(root))
    with common.job(spark, "outer"):
        kept = common.stored(spark.range(3).toDF("a"), "t")
        with common.job(spark, "inner"):
            assert common.stored(kept, "u").count() == 3
        assert kept.count() == 3 and len(set(os.listdir(root)) - before) == 1
    assert set(os.listdir(root)) == before
    with pytest.raises(ZeroDivisionError), common.job(spark, "fails"):
        common.stored(spark.range(2).toDF("a"), "v")
        1 / 0
    assert set(os.listdir(root)) == before and spark.conf.get("spark.geogrid.job", None) is None
