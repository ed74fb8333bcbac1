"""The whole pipeline against a plain reading of its five stages."""

from __future__ import annotations

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

import corpus_pipeline
from geogrid.llm import langid, near_dedup, packing, shingles
from geogrid.llm.queries import SQL
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def told(rows, learnt):
    """Rows whose language is told: by the fewest bytes, or by what three parts of each dictionary add where those tie."""
    import zstandard as z

    of = lambda d: z.ZstdCompressor(level=langid.LEVEL, write_content_size=False, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT))
    bare = z.ZstdCompressor(level=langid.LEVEL, write_content_size=False)
    whole = [of(d) for d in learnt.values()]
    n = langid.LEAD
    parts = [[d[k * n : (k + 1) * n] for k in range(langid.LEADS)] for d in learnt.values()]
    after = [of(d[langid.LEADS * n :]) for d in learnt.values()]
    for r in rows:
        text = r["text"]
        if not text or not any(map(str.isalpha, text)):
            continue
        data = text.lower().encode()
        sizes = [len(c.compress(data)) for c in whole]
        if min(sizes) > 0.99 * len(bare.compress(data)) + 3:
            continue
        if sizes.count(min(sizes)) > 1:
            sizes = [sum(len(c.compress(x + data)) - len(c.compress(x)) for x in lead) for c, lead in zip(after, parts, strict=True)]
        low = sorted(sizes)
        if (low[1] - low[0]) / max(1, low[0]) >= 0.005:
            yield r


def single(rows):
    best = {}
    for r in rows:
        if r["text"] not in best or r["doc_id"] > best[r["text"]]["doc_id"]:
            best[r["text"]] = r
    return list(best.values())


def leaders(spark, rows, schema):
    """Of all pairs of 0.8 or more the classes, and of each class the row with the smallest id."""
    settings = near_dedup.Settings()
    idf = near_dedup.inverse_frequencies(spark.createDataFrame(rows, schema), settings.common)
    h, n, sizes = shingles.shingled(pa.array([r["text"] for r in rows]))
    w, ends = shingles.weights(h, n, idf), sizes.cumsum()
    sets = [(h[e - k : e], w[e - k : e]) for e, k in zip(ends, sizes, strict=True)]
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] != own[j] and shingles.similarity(sets[i], sets[j]) >= settings.similarity:
                own = [own[j] if x == own[i] else x for x in own]
    kept = {}
    for r, k in zip(rows, own, strict=True):
        if k not in kept or r["doc_id"] < kept[k]["doc_id"]:
            kept[k] = r
    return list(kept.values())


def copies(rows):
    """How often the mix takes each document, by the query's SQL over what is left."""
    db = duckdb.connect()
    db.register("documents", pd.DataFrame([r.asDict() for r in rows]))
    return {i: taken // size for i, size, taken in db.sql(f"SELECT doc_id, size, taken FROM ({SQL['op8_systematic_mix']})").fetchall()}


def test_pipeline_is_that_of_a_plain_reading(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    learnt = langid.learn(docs.where(~langid.held_out()))
    known = list(told(docs.collect(), learnt))
    left = leaders(spark, single(known), docs.schema)
    times = copies(left)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for r in left:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r["doc_id"], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += times[r["doc_id"]]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    assert len(left) < len(single(known)) < len(known) <= docs.count() and sum(times.values()) > len(left)

    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.02 * math.ceil(sum(r["length"] for r in got) / 4096) + 1
