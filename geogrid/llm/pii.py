"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_schema, stored
from .tokens import slices

# The kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "name")

SPAN = "kind: string, start: long, `end`: long"
_span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_vote = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("shape", pa.list_(pa.string()))])
FOUND = f"base array<struct<{SPAN}>>, candidates array<struct<{SPAN}, votes: string, shape: array<string>>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins between two digits that one longer match would take, so these need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ has at most one address around it: the longest local part that is free, and a dotted domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern spans: leftmost, not overlapping within a kind, failing matches dropped."""
    found = [(s, e, "email") for s, e in emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


# The gazetteers.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential")
NAME_WORDS = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "sir", "señor", "señora")
ABOUT_WORDS = ("name", "named", "called", "contact", "signed", "regards", "patient", "customer", "employee")

_KEY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_JOIN = re.compile(r"\s{0,3}[\"']?")
_SEPARATOR = re.compile(r"[=:]")
_VALUE = re.compile(r"[^\s\"'=,;]{6,}")
# What follows the name of a credential is whole, up to the next name of a list.
_CREDENTIAL = re.compile(r"(?:[^\s\"',;]|[,;](?![A-Za-z_][A-Za-z0-9_.-]*[=:][^=\s]))+")
_PROPER = r"[^\W\d_a-z][^\W\d_]+"
_TITLE, _ABOUT = (rf"(?:{'|'.join(w)})\b" for w in (NAME_WORDS, ABOUT_WORDS))
_NAME = re.compile(rf"\b(?:((?i:{_ABOUT}))(?:[ ]is|[ ]?:)?[ ]{{1,2}})?(?:((?i:{_TITLE}))(\.?)[ ]{{1,2}})?(?<=[ ])({_PROPER}(?:[ -]{_PROPER})*)")


def secrets(text: str) -> list[tuple[str, str, int, str]]:
    """(key in lower case, what joins, start, value) by separator: the whole key is before it, the whole value after it."""
    out, free = [], 0
    for m in _SEPARATOR.finditer(text):
        end = m.start()
        if end < free:
            continue
        while end > max(free, m.start() - 3) and text[end - 1].isspace():
            end -= 1
        start = end
        while start > free and text[start - 1] in _KEY:
            start -= 1
        key = text[start:end].lstrip("0123456789.-").lower()
        if len(key) < 2:
            continue
        at = _JOIN.match(text, m.end()).end()
        value = (_CREDENTIAL if any(w in key for w in CREDENTIAL_WORDS) else _VALUE).match(text, at)
        found = value[0].rstrip(".,;") if value else ""
        if len(found) >= 6:
            out.append((key, text[end:at], at, found))
            free = value.end()
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in map(s.count, set(s)))


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """Spans that may be personal data beyond the patterns, with each labeler's vote and the span's shape.

    ``votes`` has a letter for each labeler: y, n, or - where it abstains. The labelers are a pattern of what the span
    looks like, a gazetteer of the words around it, and its context (what joins it to those words). ``base`` is sorted
    by start; candidates that overlap one of its spans are left out.
    """
    out = []
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))

    def add(kind: str, start: int, end: int, votes: str, shape: list[str]) -> None:
        before = bisect_left(starts, end)
        if not before or ends[before - 1] <= start:
            out.append({"kind": kind, "start": start, "end": end, "votes": votes, "shape": [f"{kind}:{x}" for x in shape]})

    if "=" in text or ":" in text:
        for word, join, start, value in secrets(text):
            digits, letters = sum(map(str.isdigit, value)), sum(map(str.isalpha, value))
            mixed, ent = digits > 1 and letters > 1, _entropy(value)
            votes = ("y" if mixed and ent >= 2.8 else "n" if not digits else "-") + ("y" if any(w in word for w in CREDENTIAL_WORDS) else "n")
            votes += "y" if '"' in join or "'" in join or "=" in join else "-"
            add("secret", start, start + len(value), votes, [f"length{_bin(len(value), 10, 16, 24, 40)}", f"entropy{_bin(ent, 2, 2.8, 3.4)}", f"mixed{mixed}", f"join{join.strip()}", f"hex{all(c in '0123456789abcdefABCDEF' for c in value)}"])
    low = text.lower()
    if any(w in low for w in NAME_WORDS + ABOUT_WORDS):
        for m in _NAME.finditer(text):
            about, title, dot, value = m[1], m[2], m[3], m[4]
            if title or about:
                parts = re.split("[ -]", value)
                votes = ("y" if len(parts) > 1 and all(p[1:].islower() for p in parts) else "n") + ("y" if title else "-")
                votes += "y" if title and (dot or about) else "-"
                add("name", m.start(4), m.end(4), votes, [f"words{_bin(len(parts), 2, 3, 4)}", f"case{value.istitle()}", f"title{bool(title)}", f"length{_bin(len(value), 6, 12, 20)}"])
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base (pattern spans), candidates (spans with votes and shape); whole texts, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            base, cands = [], []
            for t in b.column("text").to_pylist():
                found = base_spans(t or "")
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
                cands.append(candidates(t or "", found))
            cols = [b.column("doc_id"), pa.array(base, pa.list_(_span)), pa.array(cands, pa.list_(_vote))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "candidates"])

    return docs.select("doc_id", "text").mapInArrow(run, id_schema(docs, FOUND))


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 60) -> dict[tuple[str, str], float]:
    """Probability that a span is personal data for each (kind, votes), by expectation-maximisation.

    ``counts`` says how often each vote pattern occurs; there are a few dozen at any input size. Labelers are taken
    to be independent given the truth; each starts out as right four times in five.
    """
    out = {}
    for kind in {k for k, _ in counts}:
        rows = {v: n for (k, v), n in counts.items() if k == kind}
        width = len(next(iter(rows)))
        prior = 0.5
        table = [{True: {"y": 0.7, "n": 0.1, "-": 0.2}, False: {"y": 0.1, "n": 0.7, "-": 0.2}} for _ in range(width)]
        post: dict[str, float] = {}
        for _ in range(rounds):
            for v in rows:
                yes = prior * math.prod(table[i][True][c] for i, c in enumerate(v))
                no = (1 - prior) * math.prod(table[i][False][c] for i, c in enumerate(v))
                post[v] = yes / (yes + no)
            total = sum(rows.values())
            mass = sum(post[v] * n for v, n in rows.items())
            prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
            for i in range(width):
                for truth, whole in ((True, mass), (False, total - mass)):
                    start = {"y": 3.5, "n": 0.5, "-": 1.0} if truth else {"y": 0.5, "n": 3.5, "-": 1.0}
                    for c in "yn-":
                        part = sum((post[v] if truth else 1 - post[v]) * n for v, n in rows.items() if v[i] == c)
                        table[i][truth][c] = (part + start[c]) / (whole + 5)
        out |= {(kind, v): p for v, p in post.items()}
    return out


def detected(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, base, added: pattern spans, and spans that the trained classifier adds.

    Three steps over all rows. Labelers vote on candidate spans (one pass over the texts, stored). Vote patterns are
    counted, and expectation-maximisation turns the counts into the labelers' reliabilities and so each candidate's
    probability. Those probabilities train the final classifier, a naive Bayes model of the span's shape, from sums
    by shape feature, and it decides on each candidate together with the votes' probability. The driver gets counts
    by vote pattern and by shape feature, some hundred numbers at any input size.

    Null and empty text have no span. Base spans always stay; added ones never overlap them. Rows that repeat are
    separate. Offsets are code points, the end is exclusive. Very long texts are read whole, an empty table gives no
    rows, ids keep their type, and columns other than doc_id and text are not looked at, whatever they are called.
    """
    found = stored(labelled(docs), "spans")
    votes = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.shape")
    counts = {(r["kind"], r["votes"]): r["n"] for r in votes.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    truth = reliabilities(counts)
    if not truth:
        return found.select("doc_id", "base", F.expr(f"cast(array() as array<struct<{SPAN}>>)").alias("added"))
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(k, v, p) for (k, v), p in truth.items()], "kind string, votes string, p double"))
    by_shape = (
        votes.join(known, ["kind", "votes"])
        .select("p", F.explode("shape").alias("f"))
        .groupBy("f")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    weight, whole = {}, {}
    for k in {k for k, _ in counts}:
        yes = sum(truth[key] * n for key, n in counts.items() if key[0] == k)
        whole[k] = (yes, sum(n for key, n in counts.items() if key[0] == k) - yes)
    for r in by_shape:
        yes, no = whole[r["f"].split(":")[0]]
        weight[r["f"]] = math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
    lookup = lambda pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(float(v)))])
    shape_weight, vote_weight = lookup(weight.items()), lookup((f"{k}|{v}", math.log(max(p, 1e-9) / max(1 - p, 1e-9))) for (k, v), p in truth.items())
    least = math.log(threshold / (1 - threshold))

    def real(c: Column) -> Column:
        shape = F.aggregate(c["shape"], F.lit(0.0), lambda a, f: a + F.coalesce(shape_weight[f], F.lit(0.0)))
        return shape / F.greatest(F.size(c["shape"]), F.lit(1)) + vote_weight[F.concat(c["kind"], F.lit("|"), c["votes"])] > least

    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    return found.select("doc_id", "base", F.transform(F.filter("candidates", real), span).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, by start and then kind, joined by commas."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]), s["end"], s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
