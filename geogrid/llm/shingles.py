"""Weighted word shingles of many texts at once, and consistent weighted samples of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
BUCKETS = 1 << 20  # document frequencies are counted by the top 20 bits of a shingle's hash
CHUNK = 1 << 19  # bytes of text worked on at once; arrays of eight times that are made of them

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # ASCII case folds
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _random.integers(0, 1 << 63, WORDS, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def _word_hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; a word also ends before each of ``firsts``."""
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[firsts] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U)), starts


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts, and how many words each text has; long columns go piece by piece."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column])  # offsets from 0
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
    hashes, at = [], int(offsets[0])
    counts = np.zeros(len(column), np.int64)
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and not _BLANK[data[to]] and to not in offsets:
            to += 1
        firsts = offsets[(offsets >= at) & (offsets < to)] - at
        h, starts = _word_hashes(data[at:to], firsts)
        hashes.append(h)
        counts += np.bincount(np.searchsorted(offsets, starts + at, "right") - 1, minlength=len(column))[: len(column)]
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), counts


def shingled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text: hashes, how often each occurs, and how many each text has.

    Texts of one to four words have one shingle, all their words; texts without words have none. Whole texts count.
    """
    words, counts = _words(column)
    ends = counts.cumsum()
    hashes, times, sizes = [], [], np.zeros(len(counts), np.int64)
    n = len(words)
    rolled = np.zeros(max(0, n - WORDS + 1), U)
    for k in range(WORDS):
        rolled += words[k : n - WORDS + 1 + k] * _PLACE[k] if n >= WORDS else rolled
    rolled = mixed(rolled)
    for i, (end, many) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if many >= WORDS:
            h, t = np.unique(rolled[end - many : end - WORDS + 1], return_counts=True)
        elif many:
            h, t = mixed((words[end - many : end] * _PLACE[:many]).sum(keepdims=True) + U(many)), np.ones(1, np.int64)
        else:
            continue
        hashes.append(h)
        times.append(t)
        sizes[i] = len(h)
    return (np.concatenate(hashes), np.concatenate(times), sizes) if hashes else (np.zeros(0, U), np.zeros(0, np.int64), sizes)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(44)).astype(np.int64)


def weights(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF."""
    return times * idf[bucket(hashes)]


def _gamma_table(bits: int = 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.full(1 << bits, 1.0)
    for _ in range(80):
        x = np.maximum(x - np.clip((1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), -1, 1), 1e-9)
    return x


_GAMMA = _gamma_table().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA).astype(np.float32)


def sampled(hashes: np.ndarray, weight: np.ndarray, sizes: np.ndarray, samples: int) -> np.ndarray:
    """Improved consistent weighted samples (Ioffe): texts x ``samples`` of 64-bit sample names; 0 where a text has no shingle.

    For shingle s and sample k, r and c are Gamma(2, 1) and b is uniform, all from the hash of (s, k);
    t = floor(ln w / r + b), and the shingle with the smallest ln c - r (t - b + 1) is taken, with its t. Two texts
    take the same (s, t) with the probability that is their weighted Jaccard similarity.
    """
    out = np.zeros((len(sizes), samples), U)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = sizes.cumsum()[full] - sizes[full]
    log_w = np.log(weight).astype(np.float32)
    low = U(0xFFFF)
    for k in range(samples):
        u = mixed(hashes + U((0xD1B54A32D192ED03 * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
        r = _GAMMA[(u & low).astype(np.int32)]
        c = _LOG_GAMMA[((u >> U(16)) & low).astype(np.int32)]
        b = ((u >> U(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + b)
        a = c - r * (t - b + np.float32(1))
        bits = a.view(np.uint32)
        bits ^= np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
        name = (u >> U(32)) * U(0x9E3779B1) + t.astype(np.int64).astype(U) * U(0x85EBCA6B)
        out[full, k] = np.minimum.reduceat((bits.astype(U) << U(32)) | (name & U(0xFFFFFFFF)), starts)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (sorted hashes, weights): sum of minima by sum of maxima."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))
