"""Importance resampling against plain Python, and on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skerry.llm import resample
from tests.llm.test_operators import AWKWARD, awkward, empty  # noqa: F401


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(x) for x in w] + [zlib.crc32(a + b" " + b) for a, b in zip(w, w[1:])]


def brute(rows, target, buckets=10_000, percent=25, least=20, seed=7):
    s, t = (Counter(c % buckets for x in xs for c in features(x)[1]) for xs in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for doc_id, text in rows:
        n, crc = features(text)
        weight = sum(gain[c % buckets] for c in crc) // len(crc) if crc else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(crc), weight, score, None, n >= least and doc_id is not None])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(order[:percent * len(order) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_checksums_of_pairs_come_from_their_words():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in [1, 2, 3, 4, 7, 8, 100, 5000, 70_000, 1, *rng.integers(1, 40, 200)]]
    crc, lens = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    assert resample.joined(crc, lens).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def test_scans_find_every_word_in_order():
    texts = [b"The cat, the CAT-the", b"", b"...", "x9 é日本 A_b".encode(), b"the" * 3, b"a\x00b a b"]
    found, counts = resample.bucket_lists(texts, 1 << 32)
    want = []
    for t in texts:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        want += [zlib.crc32(f) for i, x in enumerate(w) for f in [x, *([x + b" " + w[i + 1]] if i + 1 < len(w) else [])]]
    assert found.tolist() == want and counts.tolist() == [len(re.findall(rb"[0-9a-zA-Z\x80-\xff]+", t)) for t in texts]


def test_awkward_rows(spark, awkward, empty):  # noqa: F811
    target = spark.createDataFrame([("word1 word2 word3",), (None,), ("no id here",)], "text string")
    assert got(resample.resample(awkward, target, least_words=2, percent=60)) == brute([(r[0], r[1]) for r in AWKWARD], ["word1 word2 word3", None, "no id here"], least=2, percent=60)
    assert resample.resample(empty, target).count() == 0
    assert got(resample.resample(awkward, empty)) == brute([(r[0], r[1]) for r in AWKWARD], [])


@pytest.mark.parametrize("buckets", [50, 10_000, 100_000])
def test_draws_with_ties_and_many_copies(spark, monkeypatch, buckets):
    monkeypatch.setattr(resample, "COPIES", 16)
    rows = [(i % 40, " ".join(f"w{(i * j) % 17}" for j in range(25))) for i in range(300)] + [(7, "one " * 30)] * 150
    target = ["w1 w2 w3 w4", "one one"]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), buckets)) == brute(rows, target, buckets)
