"""Periodic runs of words: maximal stretches that repeat with a smallest period, found with suffix trees, and collapsed.

A run is a stretch of words with smallest period q and a length of at least max(24, 3 * q) that no neighbouring word extends.
Each document is searched by itself, inside a task; nothing is exchanged. First, zones are set apart: every 9 words inside a
run occur in it twice, so a run lies in one stretch of words whose 9-word windows all occur twice in the document (for q up to
8 the least length 24, beyond that 3 * q, is at least 2 * q + 8). Documents without a zone of 24 words have no run. This is an
exact filter, not a limit.

In a zone, Ukkonen's suffix tree of the words and one of their reversal answer how far two places agree to the right and to
the left: the depth of the lowest common ancestor of two leaves, a range minimum over the Euler tour of the tree. A run's
Lyndon root is the longest Lyndon word at its place, in the order of words or in the reverse order (Bannai et al., 2017: The
"runs" theorem); it ends where the next smaller suffix starts, and the walks of the tree in both orders rank the suffixes. Each
of these at most two candidates for a place is extended in both directions, and is a run if it is long enough.

Memory for a zone of n words is some 1 kB times n. Defined results: null and empty texts have no words, no run and the checksum
of an empty text; a null doc_id has nothing planted in it; repeated rows are searched one by one and give equal rows; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import bounded_arrow, table

LEAST, EXPONENT, WINDOW = 24, 3, 9
ODD = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class SuffixTree:
    """Suffix tree (Ukkonen, online) of a sequence of positive numbers, closed by 0, the smallest of all."""

    def __init__(self, seq: list[int]):
        self.s = [*seq, 0]
        self._build()

    def _build(self) -> None:
        s = self.s
        n = len(s)
        begin, end, link, kids = [0], [0], [0], [{}]
        leaves: list[int] = []
        node, edge, length, open_suffixes = 0, 0, 0, 0
        for i, c in enumerate(s):
            open_suffixes += 1
            inner = 0  # the inner node of this step that still lacks its suffix link
            while open_suffixes:
                if not length:
                    edge = i
                child = kids[node].get(s[edge])
                if child is None:
                    kids[node][s[edge]] = len(begin)
                    leaves.append(len(begin))
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    size = min(end[child], i + 1) - begin[child]
                    if length >= size:  # walk down
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[begin[child] + length] == c:  # the suffix is there already, and so are all shorter ones
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    middle, leaf, cut = len(begin), len(begin) + 1, begin[child] + length
                    kids[node][s[edge]] = middle
                    begin += [begin[child], i]
                    end += [cut, n]
                    link += [0, 0]
                    kids += [{s[cut]: child, c: leaf}, None]
                    begin[child] = cut
                    leaves.append(leaf)
                    if inner:
                        link[inner] = middle
                    inner = middle
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        self.begin, self.end, self.kids, self.leaves = begin, end, kids, leaves  # leaves in the order of their suffixes

    def walk(self, falling: bool = False) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(rank of each suffix, depths of the Euler tour, place of each suffix in the tour); children in rising or falling order of their
        first number, but the closing 0 always first."""
        begin, end, kids = self.begin, self.end, self.kids
        depth, place, order = [0] * len(begin), [0] * len(begin), []
        tour: list[int] = []
        stack = [0]
        while stack:
            x = stack.pop()
            if x < 0:  # back from a child
                tour.append(depth[~x])
                continue
            below = kids[x]
            if below is None:
                place[x] = len(tour)
                order.append(x)
            else:
                inner, own = ~x, depth[x]
                nodes = sorted(below.items(), key=lambda kv: -kv[0] if kv[0] else -(1 << 62)) if falling else sorted(below.items())
                for _, child in reversed(nodes):
                    depth[child] = own + end[child] - begin[child]
                    stack.append(inner)
                    stack.append(child)
            tour.append(depth[x])
        at = np.array(place)[self.leaves]
        ranks = np.empty(len(self.leaves), np.int64)
        ranks[np.argsort(at, kind="stable")] = np.arange(len(at))
        return ranks.tolist(), np.array(tour), at


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high + 1]) of each range: two overlapping entries of a sparse table, whose levels are made one after another."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(values[low[at]], values[high[at] - (1 << k) + 1])
        values = np.minimum(values[:-(1 << k)], values[1 << k:])
    return out


class Extensions:
    """How many numbers two places of a sequence have in common to the right."""

    def __init__(self, tree: SuffixTree):
        self.ranks, self.tour, self.place = tree.walk()

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        return range_minima(self.tour, np.minimum(a, b), np.maximum(a, b))


def next_smaller(ranks: list[int]) -> np.ndarray:
    """For each suffix the next one of smaller rank: where the longest Lyndon word at its place ends. The last suffix is the closing 0."""
    n = len(ranks) - 1
    following = [0] * n + [n]
    for i in range(n - 1, -1, -1):
        j = i + 1
        while ranks[j] > ranks[i]:
            j = following[j]
        following[i] = j
    return np.array(following[:n])


def runs_of(seq: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of positive numbers with length >= max(least, exponent * period), exponent at least 2."""
    n = len(seq)
    if n < least:
        return []
    tree = SuffixTree(seq)
    right, left = Extensions(tree), Extensions(SuffixTree(seq[::-1]))
    found = []
    for ranks in (right.ranks, tree.walk(falling=True)[0]):
        i = np.arange(n)
        period = next_smaller(ranks) - i
        fits = exponent * period <= n
        i, period = i[fits], period[fits]
        end = i + period + right.common(i, i + period)
        start = i - left.common(n - i, n - i - period)  # of the words before i and before i + period, read backwards
        long = end - start >= np.maximum(least, exponent * period)
        found.append(np.stack([start, end - start, period], 1)[long])
    return [tuple(r) for r in np.unique(np.concatenate(found), axis=0).tolist()]


def zones(gram_keys: np.ndarray, counts: np.ndarray, window: int = WINDOW, least: int = LEAST) -> list[list[tuple[int, int]]]:
    """For each text the stretches [a, b) of words, ``least`` or longer, whose windows all occur twice in the text.

    gram_keys: one number for each window of each text, text by text, equal for equal windows of one text."""
    _, inverse, times = np.unique(gram_keys, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    windows = np.maximum(counts - window + 1, 0)
    out: list[list[tuple[int, int]]] = []
    at = 0
    for n in windows.tolist():
        own = again[at:at + n]
        at += n
        if not own.any():
            out.append([])
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        out.append([(a, b + window - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + window - 1 - a >= least])
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word each word becomes where a document is chosen to repeat a part of itself; None if it stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def window_keys(ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A number for each window inside each text; windows of different texts differ but for chance."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    with np.errstate(over="ignore"):
        key = owner[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
        for j in range(window):
            key = (key ^ hashes[ids[j:j + n]]) * ODD
            key ^= key >> np.uint64(29)
    return key[owner[:n] == owner[window - 1:]]


def describe(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result row of a document with these runs."""
    best = (None,) * 4
    keep = words
    if runs:
        top = None
        dropped = np.zeros(len(words), bool)
        for start, length, period in sorted(runs):
            if top is None or length * top[2] > top[1] * period:  # ties go to the earlier start, then the smaller period
                top = (start, length, period)
            dropped[start + period:start + length] = True
        best = (*top, 1000 * top[1] // top[2])
        keep = [words[i] for i in np.flatnonzero(~dropped).tolist()]
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


def search(doc_ids: list[int | None], texts: list[bytes], plant: bool) -> list[tuple]:
    split = [t.split() for t in texts]  # bytes are split at ASCII white space
    known = {w: i for i, w in enumerate(set().union(*split))}
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    ends = np.cumsum(counts).tolist()
    for k, (doc_id, n, e) in enumerate(zip(doc_ids, counts.tolist(), ends)):
        moved = planted(doc_id, n) if plant else None
        if moved is not None:
            ids[e - n:e] = ids[e - n:e][moved]
            split[k] = [split[k][i] for i in moved.tolist()]
    out = []
    for doc_id, words, e, parts in zip(doc_ids, split, ends, zones(window_keys(ids, hashes, counts), counts)):
        own = ids[e - len(words):e] + 1
        runs = [(a + start, length, period) for a, b in parts for start, length, period in runs_of(own[a:b].tolist())]
        out.append(describe(doc_id, words, runs))
    return out


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_runs, the run of greatest exponent, and checksums of all runs and of the text without repeats.

    ``plant`` first makes every tenth document repeat a part of itself, by its doc_id, to have runs of known places."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]
        for b in batches:
            rows = search(b.column("doc_id").to_pylist(), [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()], plant)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


OP12_SQL = r"""
with crc_table as (
  select list(c order by i) as t from (select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: k::ubigint)),
    lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) r(i))
), split as (
  select row_number() over () as id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), hashed as (
  select id, doc_id, w, len(w) as n, case when doc_id is null then 1 else xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::bigint])), 4294967295::ubigint)::bigint end as h from split, crc_table
), params as (select *, (h // 10) % greatest(n, 1) as a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) as p from hashed
), docs as (
  select id, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) else w end as w from params
), grams as (
  select id, i, hash(w[i + 1:i + 16]) as g from (select id, w, unnest(range(n - 15)) as i from docs where n >= 24)
), periods as (
  select distinct x.id, y.i - x.i as q from (select * from grams qualify count(*) over (partition by id, g) > 1) x
  join (select * from grams qualify count(*) over (partition by id, g) > 1) y on x.id = y.id and x.g = y.g and y.i > x.i
), equal as (
  select id, q, i from (select id, q, w, unnest(range(n - q)) as i from periods join docs using (id) where 3 * q <= n) where w[i + 1] = w[i + q + 1]
), stretches as (
  select id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by id, q order by i) as grp from equal) group by id, q, grp
), runs as (select id, start, length, min(q) as period from stretches where length >= greatest(24, 3 * q) group by id, start, length
), per_doc as (
  select id, count(*) as n_runs, list({'start': start, 'length': length, 'period': period} order by length::double / period desc, start, period)[1] as best,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as listed from runs group by id
), gone as (select distinct id, unnest(range(start + period, start + length)) as i from runs
), gone_lists as (select id, list(i) as gone from gone group by id
), kept as (
  select id, string_agg(word, ' ' order by i) as text from (select id, unnest(w) as word, unnest(range(n)) as i from docs where id in (select id from per_doc)) anti join gone using (id, i) group by id
)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(case when n_runs is null then array_to_string(w, ' ') else coalesce(text, '') end) as collapsed_sha256
from docs left join per_doc using (id) left join kept using (id)
"""
