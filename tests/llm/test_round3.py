"""SimHash, periodic runs and the conversation trie against brute force; nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from geogrid.llm import langid, periodic, pii, simhash, turn_trie
from geogrid.llm.queries import QUERIES
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, fp string, mask string, runs string, class string, g string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, white space of all kinds, repeated rows and ids, columns with names that operators use."""
    base, long = words(90, 2), words(20_000, 1)
    rows = [
        (1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, long), (5, long + " tail"), (6, base), (7, base), (7, base), (None, base), (None, None), (None, "only here"),
        (8, base + " tail"), (9, "one"), (10, "One TWO"), (11, "aé中 x \U0001f600 É"), (12, base[: len(base) // 2]), (13, "x" * 200_000), (14, "a b " * 9),
        (15, "ha " * 50_000), (16, ("u v w x y z " * 7 + words(9, 3) + " ") * 5), (17, "a a a a a b a a a a a b a a a a a b a a a a a b"),
    ]
    return spark.createDataFrame([(i, t, "f", "m", "r", "c", "g") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def fingerprint(text):
    found = WORD.findall(lower(text or ""))
    grams = [" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def reached(prints: dict[int, set], radius: int = 3) -> dict[int, int | None]:
    """Of each fingerprint the smallest id of its component, all pairs compared."""
    names = list(prints)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = collections.defaultdict(set)
    for n in names:
        ids[find(n)] |= prints[n]
    return {n: min((i for i in ids[find(n)] if i is not None), default=None) for n in names}


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_simhash_components(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in df.collect()]
    prints = collections.defaultdict(set)
    for i, f in rows:
        prints[f].add(i)
    smallest = reached(prints)
    got = simhash.near_components(df).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(key((i, f"{f:016x}", smallest[f])) for i, f in rows)
    if table == "docs":
        assert sorted(map(key, QUERIES["op11_simhash_near_dedup"](df.sparkSession, DATA).collect())) == sorted(map(key, got))
    assert simhash.near_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_close_pairs_are_all_pairs(radius):
    r = np.random.default_rng(radius)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.array([int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for c in centres for _ in range(70)], np.uint64)
    n = len(fp)
    lo, hi = np.arange(n) + 1, np.full(n, n)
    lo[100:130], hi[100:130] = 200, 331  # other lanes, cut within a word
    lo[5] = hi[5] = n
    found = {(a, b) for i, j in simhash.close_pairs(fp, lo, hi, radius) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(i, j) for i in range(n) for j in range(lo[i], hi[i]) if int(fp[i] ^ fp[j]).bit_count() <= radius}


def test_large_buckets_are_divided_and_compared_in_squares(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 16)
    r = random.Random(5)
    chain = [0]
    for _ in range(150):  # a chain of steps of two and three bits
        f = chain[-1]
        for b in r.sample(range(40), r.randint(2, 3)):
            f ^= 1 << b
        chain.append(f)
    fps = {f | 1 << 63 for f in chain} | {r.getrandbits(64) for _ in range(200)} | {(1 << 63) | r.getrandbits(20) for _ in range(150)}
    smallest = reached({f: {f} for f in fps})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    vertices = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {f: {f} for f in fps}
    for a, b in simhash.links(vertices).collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert a in smallest and b in smallest
        whole = found[a] | found[b]
        for f in whole:
            found[f] = whole
    assert {f: min(found[f]) for f in fps} == smallest


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """Every period's maximal stretches, those that have a smaller period left out."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                piece = w[start : start + length]
                if not any(all(piece[k] == piece[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_rewritten(w: list[str], doc_id) -> list[str]:
    n, h = len(w), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_of_words_over_small_alphabets():
    r = random.Random(11)
    for trial in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            unit = [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randint(1, 25))]
            texts.append([r.randrange(3) for _ in range(r.randint(0, 12))] + unit * r.randint(1, 9) + unit[: r.randint(0, 5)] + [r.randrange(2) for _ in range(r.randint(1, 40))])
        columns = [np.array(t) + 1000 * k for k, t in enumerate(texts)]
        begins = np.cumsum([0] + [len(t) for t in texts])[:-1]
        got = sorted(periodic.runs(np.concatenate(columns), begins))
        assert got == sorted((s + int(b), n, q) for b, t in zip(begins, texts, strict=True) for s, n, q in brute_runs(t)), trial


def test_word_lists_cut_at_any_length():
    text = "aé  b\tc\x0bd " * 50
    for limit in (1, 2, 7, 1000):
        from geogrid.llm.tokens import word_lists

        assert [w for part in word_lists(text.encode(), limit) for w in part] == [w.encode() for w in WORD.findall(text)]


def check_periodic(rows, got):
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for doc_id, text, brute in rows:
        w = brute_rewritten(WORD.findall(text or ""), doc_id)
        found = brute(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        kept = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        wanted = (len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], want, kept)
        names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
        assert wanted in {tuple(r[c] for c in names) for r in by[doc_id]}, doc_id
    assert len(got) == len(rows)


def test_periodic_query_is_that_of_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"], lambda w: brute_runs(w) if len(w) < 1200 else slower(w)) for r in docs.collect()]
    check_periodic(rows, QUERIES["op12_periodic_runs"](spark, DATA).collect())


def slower(w):
    """As brute_runs, for long texts: overlaps of each lag by numpy, smallest period by divisors."""
    ids = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in w])
    found = []
    for q in range(1, len(a) // 4 + 1):
        same = np.concatenate(([False], a[:-q] == a[q:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            n = e - s + q
            if n >= max(6, 4 * q) and not any((a[s : s + n - p] == a[s + p : s + n]).all() for p in range(1, q) if q % p == 0):
                found.append((s, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_periodic_runs_of_awkward_rows(awkward):
    got = periodic.periodic_runs(awkward, rewrite=True).collect()
    assert len(got) == awkward.count()
    listed = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]]) for r in got)
    want = []
    for r in awkward.collect():
        w = brute_rewritten(WORD.findall(r["text"] or ""), r["doc_id"])
        want.append((str(r["doc_id"]), len(w), [(0, len(w), 1)] if len(set(w)) == 1 and len(w) > 5 else slower(w)))
    assert listed == sorted(want)
    assert periodic.periodic_runs(awkward.limit(0)).count() == 0


def brute_trie(turns: list[tuple], rebuild: bool) -> list[tuple]:
    convs = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: heads[c]] + x[heads[c] :] for c, x in own.items()}
    members = collections.defaultdict(list)
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        worth = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        kids = [below[k] for k in children[node]]
        below[node] = (sum(k[0] for k in kids) or 1, worth + sum(k[1] for k in kids))
        ends = ",".join(str(c) for c in members[node] if len(own[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(kids), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check_trie(spark, turns, rebuild, shards=None):
    df = spark.createDataFrame([(*t, "x", 1, 2) for t in turns], "conv_id long, turn long, role string, text string, path string, depth long, base long")
    got = [tuple(r[c] for c in turn_trie.NODE) for r in turn_trie.prefix_trie(df, rebuild).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_trie(turns, rebuild)))


def test_trie_of_shared_beginnings_over_many_shards(spark):
    r = random.Random(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shards in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(shards))
            turns = []
            for c in range(230):
                if c % 7 == 3:
                    continue
                for t in range(r.randint(1, 7)):
                    turns.append((c, t, "u", f"t{r.randint(0, 2)}" if c % 3 else "same"))
            turns += [(c, t, "u", f"deep{t if t < c else 9}") for c in (300, 301, 302) for t in range(c - 200)]
            check_trie(spark, turns, rebuild=shards != 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_of_awkward_rows(spark):
    turns = [
        (5, None, None, None), (5, 1, "u", "hi"), (5, 1, "a", "hi"), (5, 1, "a", "hi"), (7, None, "", ""), (105, 2, "u", ""), (None, 1, "u", "hi"), (100, 1, "u", "é中\U0001f600"),
        (8, 1, "u", "x" * 300_000), (9, 1, "u", "x" * 300_000), (-5, 0, "u", "hi"), (-100, 0, "w", "hello"), (10, 1, "ua", "b"), (11, 1, "u", "ab"), (1, 1, "u", "gone"),
    ]
    check_trie(spark, turns, False)
    check_trie(spark, [t for t in turns if t[0] is None or t[0] >= 0], True)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_trie.prefix_trie(empty, True).count() == 0


def test_trie_query_is_that_of_brute_force(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in turn_trie.NODE) for r in QUERIES["op13_turn_trie"](spark, DATA).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_trie(turns, True)))


def test_copies_fill_neither_the_sample_nor_a_dictionary(spark):
    from pyspark.sql import functions as F

    copies = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"), F.lit("en").alias("lang"))
    other = spark.createDataFrame([(i, f"number {i} of some others", "en") for i in range(200)], "doc_id long, text string, lang string")
    lines = langid.learn(copies.unionByName(other))["en"].decode().split("\n")
    assert len(lines) == len(set(lines)) == 120


def test_personal_data_of_ids_of_any_type_and_names_behind_cues(spark):
    names = {
        "contact Dr. Anna Schmidt today": "Anna Schmidt", "signed Mr Juan Lopez": "Juan Lopez", "name: Anna Schmidt": "Anna Schmidt",
        "My name is Anna Schmidt, hello": "Anna Schmidt", "dear Mrs. Jean-Luc Picard went": "Jean-Luc Picard", "Mr. Bean": "Bean", "the Bean": None,
    }
    for text, name in names.items():
        assert [text[c["start"] : c["end"]] for c in pii.candidates(text, []) if c["kind"] == "name"] == ([name] if name else [])
    rows = [(f"id{i}", t, "x") for i, t in enumerate([*names, None, "mail a@b.cc"])]
    got = pii.detected(spark.createDataFrame(rows, "doc_id string, text string, base string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert [s["kind"] for r in got if r["doc_id"] == "id8" for s in r["base"]] == ["email"]


def test_quality_verdicts_recomputed(spark, docs):
    from geogrid.llm import quality

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    mask = quality.BUCKETS - 1

    def grams(text):
        w = [x.encode() for x in WORD.findall((text or "").lower())]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [h & mask for h in one] + [xxhash.xxh64_intdigest(b, h) & mask for h, b in zip(one, w[1:], strict=False)]

    rows = docs.collect()
    raw, good = np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in rows:
        np.add.at(raw, grams(r["text"]), 1)
        if r["doc_id"] in trusted:
            np.add.at(good, grams(r["text"]), 1)
    prior = quality.PRIOR * quality.BUCKETS
    ratio = np.log((good + prior * raw / raw.sum()) / (good.sum() + prior)) - np.log(raw / raw.sum())
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_rules"](spark, DATA).collect()}
    for r in rows:
        g, n = grams(r["text"]), len(WORD.findall(r["text"] or ""))
        x = got[r["doc_id"]]
        score = ratio[g].sum() / (2 * n - 1) if n else 0.0
        failed = n < 50 or 100 * x["n_repeat_words"] > 50 * n
        assert x["n_words"] == n and abs(x["score"] - score) < 1e-4
        assert x["base_failed"] == failed and (abs(score + 0.1) < 1e-4 or x["kept"] == (not failed and score >= -0.1))


def planted(n=300):
    """Documents with one name or secret each, the span that it is, and documents without any."""
    r = random.Random(21)
    firsts, lasts = "Anna Juan Marie Peter Olga Ravi Lucía Jean Omar Ingrid".split(), "Schmidt Lopez Dubois Novak Patel Haddad Larsen Moreau García Weber".split()
    titles = ("Dr. ", "Mr ", "Mrs. ", "Prof. ", "Herr ", "Frau ", "")
    abouts = ("Please contact ", "Signed ", "The name is ", "Name: ", "best regards ", "the patient ", "our customer ")
    keys = ("password=", "api_key: ", 'secret = "', "token: ", "AWS_ACCESS_KEY=", "db_passwd=")
    out = []
    for i in range(n):
        head, tail = words(r.randint(5, 30), i), words(r.randint(5, 30), 9000 + i)
        if i % 3 == 0:
            name = f"{r.choice(firsts)} {r.choice(lasts)}"
            cue = r.choice(abouts) + r.choice(titles)
            out.append((i, f"{head} {cue}{name}, {tail}", "name", len(head) + 1 + len(cue), len(name)))
        elif i % 3 == 1:
            value = "".join(r.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(r.randint(12, 40))) + "7x9"
            key = r.choice(keys)
            out.append((i, f"{head} {key}{value}{chr(34) if chr(34) in key else ''} {tail}", "secret", len(head) + 1 + len(key), len(value)))
        else:
            out.append((i, f"{head} note: {words(1, i)} of the customer service, time: {words(1, i + 1)} {tail}", None, 0, 0))
    return out


def test_planted_names_and_secrets_are_found(spark):
    rows = planted()
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["added"]} for r in pii.detected(df).collect()}
    for kind in ("name", "secret"):
        want = [(i, (kind, start, start + n)) for i, _, k, start, n in rows if k == kind]
        hits = sum(span in got[i] for i, span in want)
        found = sum(k == kind for spans in got.values() for k, _, _ in spans)
        print(kind, "recall", hits / len(want), "precision", hits / max(found, 1))
        assert hits / len(want) >= 0.9 and hits / found >= 0.9, kind
    assert sum(bool(got[i]) for i, _, k, _, _ in rows if k is None) <= 0.02 * len(rows)


def test_added_spans_are_those_of_the_model_recomputed(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + i, t) for i, t, *_ in planted(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cands = [(r["doc_id"], c) for r in pii.labelled(df).collect() for c in r["candidates"]]
    counts = collections.Counter((c["kind"], c["votes"]) for _, c in cands)
    truth = {}
    for kind in {k for k, _ in counts}:
        votes = {v: n for (k, v), n in counts.items() if k == kind}
        n, m = np.array(list(votes.values()), float), [list(v) for v in votes]
        hit = np.array([[[x == c for c in "yn-"] for x in v] for v in m], float)  # pattern, labeler, vote
        start = {1: np.array([3.5, 0.5, 1.0]), 0: np.array([0.5, 3.5, 1.0])}
        table = {1: np.tile([0.7, 0.1, 0.2], (hit.shape[1], 1)), 0: np.tile([0.1, 0.7, 0.2], (hit.shape[1], 1))}
        prior = 0.5
        for _ in range(60):
            like = {t: np.prod((hit * table[t]).sum(2), axis=1) for t in (0, 1)}
            p = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
            prior = min(0.99, max(0.01, ((p * n).sum() + 1) / (n.sum() + 2)))
            for t, q in ((1, p), (0, 1 - p)):
                table[t] = (np.einsum("p,pij->ij", q * n, hit) + start[t]) / ((q * n).sum() + 5)
        truth |= {(kind, v): x for v, x in zip(votes, p, strict=True)}
    yes, no, total = collections.Counter(), collections.Counter(), collections.defaultdict(lambda: [0.0, 0.0])
    for _, c in cands:
        p = truth[c["kind"], c["votes"]]
        total[c["kind"]][0] += p
        total[c["kind"]][1] += 1 - p
        for f in c["shape"]:
            yes[f] += p
            no[f] += 1 - p
    want = collections.defaultdict(set)
    for i, c in cands:
        a, b = total[c["kind"]]
        shape = np.mean([np.log((yes[f] + 1) / (a + 2)) - np.log((no[f] + 1) / (b + 2)) for f in c["shape"]])
        p = truth[c["kind"], c["votes"]]
        odds = shape + np.log(max(p, 1e-9) / max(1 - p, 1e-9))
        assert abs(odds) > 1e-6
        if odds > 0:
            want[i].add((c["kind"], c["start"], c["end"]))
    for r in pii.detected(df).collect():
        assert {(s["kind"], s["start"], s["end"]) for s in r["added"]} == want[r["doc_id"]]
