"""Passages that repeat across documents against plain Python, and on awkward tables."""

import hashlib
import random

import numpy as np
import pytest

from skerry.llm import substring_dedup
from tests.llm.test_operators import AWKWARD, awkward, empty  # noqa: F401


def brute(rows, window=13):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    owner = {}
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i:i + window])
            owner[key] = min(owner.get(key, d), d)
    out = []
    for d, w in split:
        gone = {k for i in range(len(w) - window + 1 if d is not None else 0) if owner[tuple(w[i:i + window])] < d for k in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=120, words=400):
    """Texts with passages of 8 to 60 words from a common pool, cut and joined anywhere, and copies of whole texts."""
    rng = random.Random(seed)
    pool = [[f"p{rng.randint(0, words)}" for _ in range(rng.randint(8, 60))] for _ in range(15)]
    rows = []
    for d in range(n):
        w = [f"w{rng.randint(0, words)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(w))
            w[at:at] = p[a:rng.randint(a, len(p))]
        rows.append((rng.randint(0, 100), rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(500 + i, rng.choice(rows)[1]) for i in range(20)]


@pytest.mark.parametrize("seed,block", [(1, 6000), (2, 20_000), (3, 1 << 20)])
def test_passages_of_a_pool(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert got(substring_dedup.repeated_passages(df, block_bytes=block)) == want and sum(r[2] > 0 for r in want) > 30


def test_many_copies_and_a_passage_in_every_document(spark):
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(13))
    rows = [(i, "one text " * 10) for i in range(200)] + [(1000 + i, f"{' '.join(f'a{rng.randint(0, 9999)}' for _ in range(rng.randint(0, 9)))} {shared} {i} b") for i in range(300)]
    assert got(substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=20_000)) == brute(rows)


def test_awkward_rows(spark, awkward, empty):  # noqa: F811
    short = [(d, t) for d, t, *_ in AWKWARD]
    for block in (100_000, 1 << 20):
        assert got(substring_dedup.repeated_passages(awkward, block_bytes=block)) == brute(short)
    assert substring_dedup.repeated_passages(empty).count() == 0
    rows = [(None, "x " * 30), (1, "x " * 30), (1, "x " * 30), (0, None), (2, "x " * 13), (3, "x " * 12), (-5, "X " * 30)]
    assert got(substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_rolling_hashes_depend_on_the_stretch_alone():
    rng = np.random.default_rng(4)
    part = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    a = substring_dedup.Rolling(np.concatenate([rng.integers(0, 1 << 63, 100, dtype=np.uint64), part]), substring_dedup.BASES[0])
    b = substring_dedup.Rolling(np.concatenate([part, rng.integers(0, 1 << 63, 7, dtype=np.uint64)]), substring_dedup.BASES[0])
    i = np.arange(30)
    assert (a.of(100 + i, 110 + i) == b.of(i, 10 + i)).all() and len(set(b.of(i, 10 + i).tolist())) == 30


def test_blocks_are_read_where_they_lie(spark, sf_dir, capsys):
    """Documents go through one exchange; the steps after it exchange hashes alone."""
    from skerry.llm.common import Scratch, table

    with Scratch(spark, "test") as scratch:
        docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "doc_id % 6 as block")
        stored = scratch.write_bucketed(docs, "blocks", 6, ["block"])
        marks = spark.createDataFrame([(1, 0, 1, 1, 1)], "block long, kind byte, a long, b long, owner long")
        both = stored.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda t, m: substring_dedup.locate(t, m, 13), substring_dedup.RESULT)
        both.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
