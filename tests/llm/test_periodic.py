"""Periodic runs against the definition, and on awkward tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from skerry.llm import periodic
from tests.llm.test_operators import AWKWARD, awkward, empty  # noqa: F401


def runs(s, least=24, exponent=3):
    """By the definition: for every period the maximal stretches, each with its smallest period."""
    out = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def row(doc_id, text, plant):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_runs_of_random_sequences():
    rng = random.Random(5)
    for _ in range(400):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 80)
        s = [rng.randint(1, k) for _ in range(n)]
        block = [rng.randint(1, k) for _ in range(rng.randint(1, 12))]
        s += (block * 12)[:rng.randint(0, 100)] + s[:rng.randint(0, n)]
        for least, exponent in ((24, 3), (4, 2), (7, 4)):
            assert periodic.runs_of(s, least, exponent) == runs(s, least, exponent)


def test_extensions_are_common_prefixes():
    rng = random.Random(6)
    s = [rng.randint(1, 3) for _ in range(200)]
    i, j = (np.array([rng.randint(0, 200) for _ in range(500)]) for _ in range(2))
    same = lambda a, b: next((k for k in range(200) if max(a, b) + k >= 200 or s[a + k] != s[b + k]), 0)
    got_ = periodic.Extensions(periodic.SuffixTree(s)).common(i, j).tolist()
    assert all(x == same(a, b) for a, b, x in zip(i.tolist(), j.tolist(), got_) if a != b)


def test_zones_hold_all_runs():
    rng = random.Random(7)
    rows = []
    for d in range(150):
        w = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            at, q = rng.randint(0, len(w)), rng.randint(1, 15)
            block = [f"w{rng.randint(0, 400)}" for _ in range(q)]
            w[at:at] = (block * 30)[:rng.randint(20, 26) if q < 9 else rng.randint(3 * q - 2, 3 * q + 4)]
        rows.append((d, " ".join(w)))
    out = periodic.search([r[0] for r in rows], [r[1].encode() for r in rows], plant=False)
    assert out == [row(*r, False) for r in rows] and sum(r[1] for r in out) > 60


def test_awkward_rows(spark, awkward, empty):  # noqa: F811
    for plant in (False, True):
        want = [row(r[0], r[1], plant) if r[0] not in (4, 5) else None for r in AWKWARD]
        result = got(periodic.periodic_runs(awkward, plant))
        assert [r for r in result if r[0] not in (4, 5)] == sorted((r for r in want if r), key=repr)
    long = {r[0]: r for r in got(periodic.periodic_runs(awkward)) if r[0] in (4, 5)}  # 977 words over and over, 30,000 in all
    assert long[4][1:6] == (1, 0, 30_000, 977, 30_000_000 // 977) and long[5][1:] == long[4][1:]
    assert periodic.periodic_runs(empty).count() == 0
