"""Near-duplicates among texts that share a long passage: right classes, and work that doesn't grow with the square."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from geogrid.llm import near_dedup, shingles


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def sharing(n):
    """n texts that share 85 of 100 words, too little to be alike, and a near copy of each tenth."""
    passage, texts = words(170, 1), []
    for i in range(n):
        text = passage + words(30, 100 + i)
        texts.append((i, " ".join(text)))
        if i % 10 == 0:
            text[5 + i % 190] = f"new{i}"
            texts.append((100_000 + i, " ".join(text)))
    return texts


def test_texts_that_share_a_passage_are_not_sent_in_squares(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROWS", 8)
    stored, sent = near_dedup.stored, {}

    def counted(df, name):
        found = stored(df, name)
        if name in ("likely", "rare", "homes"):
            sent[name] = found.count()
        return found

    monkeypatch.setattr(near_dedup, "stored", counted)
    counts = []
    for n in (60, 240):
        df = spark.createDataFrame(sharing(n), "doc_id long, text string")
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df).collect()}
        assert got == {i: i % 100_000 for i in got} and len(got) == n + n // 10
        counts.append(sent["likely"])
    assert counts[1] <= 6 * counts[0] + 20  # 4 times the rows; it was 16 times


@pytest.mark.parametrize("rows", [4, 512])
def test_pairs_within_reach_are_all_pairs_that_are_alike(spark, monkeypatch, rows):
    """Without leaders: whatever is alike and of different classes meets, however shingles are cut into parts."""
    monkeypatch.setattr(near_dedup, "ROWS", rows)
    r, base, texts = random.Random(5), words(80, 2), []
    for _ in range(150):
        text = base[: r.choice([60, 70, 75, 80, 80, 80])]
        for at in r.sample(range(len(text)), r.choice([0, 1, 1, 2, 2, 3, 6])):
            text[at] = f"e{r.randrange(6)}"
        texts.append(" ".join(text * r.choice([1, 1, 1, 2])))
    texts += ["", "one", "One", "  ", "two words"]
    h, times, sizes = shingles.shingled(pa.array(texts))
    counts = np.bincount(shingles.bucket(h), minlength=shingles.BUCKETS)
    idf = near_dedup.inverse(counts, len(texts), 0.1)
    w, ends = shingles.weights(h, times, idf), sizes.cumsum()
    sets = [(h[e - k : e], w[e - k : e]) for e, k in zip(ends, sizes, strict=True)]
    classes = [i if i % 3 else 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(zip(classes, texts, strict=True))], "id long, class long, text string")
    rare = near_dedup.rare_shingles(df, idf, near_dedup.rarity(counts), 0.8)
    found = near_dedup.within_reach(near_dedup.meetings(rare), rare.where("bins is not null").select("id", "bins"), float(idf.max()), 0.8)
    found = {(x["a"], x["b"]) for x in found.collect()}
    pairs = {(i, j) for j in range(len(texts)) for i in range(j) if classes[i] != classes[j]}
    alike = {(i, j) for i, j in pairs if shingles.similarity(sets[i], sets[j]) >= 0.8}
    assert alike <= found <= pairs and len(alike) > 100 and len(found) < 0.8 * len(pairs)
