"""Removal of passages that repeat across documents, by Aho-Corasick automata of the confirmed passages.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it also starts in a document of
smaller doc_id. Documents are dealt into blocks of a bounded size, written once, bucketed by block; every later step reads the
blocks where they lie, and only short hashes travel.

1. Candidates. The gram (5 words) of least hash inside a window is its anchor; neighbouring windows with the same anchor form a
   segment, some 17 words. A block reports each distinct segment once: hash of the anchor, hash of the segment, smallest
   doc_id. Anchors that occur in one document alone are done.
2. Confirmed segments. All rows of a segment learn the smallest doc_id that has it, its owner. Blocks whose documents have it
   from a smaller doc_id are told so.
3. Confirmed windows. If an anchor has several segments in several documents (where copied passages begin and end), the blocks
   of the owners report the windows of these segments by 128-bit hashes, and learn the owner of each window.
4. Location. A block compiles an automaton of its confirmed passages, the longest stretches of confirmed windows - words are
   numbers, written in two letters each - with their owners as payloads, streams all its documents through it, and removes each
   occurrence in documents above the owner.

Windows that occur twice are found whatever their number: equal windows have equal anchors, and a window whose segment is not
itself found in a smaller document is reported by both its owner and that smaller document. A group of thousands of copies is
one row for each block and segment; what is compared are minima, never pairs.

Defined results: null and empty texts have no words; a text of fewer words than a window loses none; a null doc_id is no source
and loses nothing; rows of one doc_id are one document, they take nothing from each other; repeated rows give equal rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, checkpointed, table

GRAM = 5
# Odd multipliers of the rolling hashes and the mixer (golden-ratio style constants; any odd numbers do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * MIX[0]
        h = (h ^ (h >> np.uint64(29))) * MIX[1]
        return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any stretches of a sequence from prefix sums of its elements times powers of an odd base, modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
            self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Block:
    """The documents of a block: words as numbers, windows and segments as positions among all words."""

    def __init__(self, rows: pa.Table, window: int):
        self.window = window
        self.doc_ids = rows["doc_id"].to_pylist()
        lists = pc.ascii_split_whitespace(pc.fill_null(rows["text"].combine_chunks(), ""))
        flat, ends = lists.flatten(), np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        full = np.asarray(pc.not_equal(flat, ""))  # white space at either end of a text gives empty words
        self.words = flat.filter(pa.array(full))
        self.counts = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], ends])])
        coded = self.words.dictionary_encode()
        self.ids = np.asarray(coded.indices).astype(np.int64)
        known = coded.dictionary.cast(pa.binary()).to_pylist()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), np.uint64).reshape(-1, 2)
        self.first, self.second = (Rolling(both[:, k][self.ids] if len(known) else np.zeros(0, np.uint64), BASES[k]) for k in (0, 1))
        self.number = np.array([0 if d is None else d for d in self.doc_ids], np.int64)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        n = max(len(self.ids) - window + 1, 0)
        fits = owner[:n] == owner[window - 1:] if n else np.zeros(0, bool)
        named = np.array([d is not None for d in self.doc_ids], bool)
        self.starts = np.flatnonzero(fits & named[owner[:n]]) if n else np.zeros(0, np.int64)
        self.owner = owner

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, hash of the anchor, hash of the segment, doc_id) of each segment."""
        if not len(self.starts):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        at = np.arange(len(self.ids) - GRAM + 1)
        grams = self.first.of(at, at + GRAM)
        anchor = self.starts.copy()
        least = grams[anchor]
        for j in range(1, self.window - GRAM + 1):
            other = grams[self.starts + j]
            better = other < least
            least = np.where(better, other, least)
            anchor = np.where(better, self.starts + j, anchor)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        begin = self.starts[new]
        end = self.starts[np.append(new[1:], len(anchor)) - 1] + self.window
        return begin, end, least[new].view(np.int64), self.second.of(begin, end).view(np.int64), self.number[self.owner[begin]]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = starts + self.window
        return self.first.of(starts, ends).view(np.int64), self.second.of(starts, ends).view(np.int64)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for both hashes; it stands for them inside a block only."""
    with np.errstate(over="ignore"):
        return mixed(a.view(np.uint64) + b.view(np.uint64) * np.uint64(BASES[0]))


def extremes(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of an occurrence, smallest doc_id, largest doc_id) of each distinct pair of hashes."""
    _, first, inverse = np.unique(combined(a, b), return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], np.arange(len(first)))
    if not len(first):
        return first, doc[:0], doc[:0]
    return first, np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)


def known_values(a: np.ndarray, b: np.ndarray, marks: pa.Table, missing: int) -> np.ndarray:
    """The owner that ``marks`` (a, b, owner) has for each pair of hashes, or ``missing``."""
    own_a, own_b, owner = (marks[c].to_numpy() for c in ("a", "b", "owner"))
    out = np.full(len(a), missing, np.int64)
    if len(own_a):
        at, low, _ = extremes(own_a, own_b, owner)  # in the order of the combined numbers
        keys = combined(own_a[at], own_b[at])
        asked = combined(a, b)
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = (keys[place] == asked) & (own_a[at][place] == a) & (own_b[at][place] == b)
        out[hit] = low[place[hit]]
    return out


def report_segments(rows: pa.Table, window: int) -> pa.Table:
    _, _, anchor, segment, doc = Block(rows, window).segments()
    at, low, _ = extremes(anchor, segment, doc)
    return pa.table({"anchor": anchor[at], "segment": segment[at], "low": low, "block": pa.array(np.full(len(at), rows["block"][0].as_py()), pa.int64())})


def report_windows(rows: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    """Windows of the segments named by ``marks`` (a, b)."""
    if not len(marks) or not len(rows):
        empty = np.zeros(0, np.int64)
        return pa.table({"a": empty, "b": empty, "low": empty, "high": empty, "block": empty})
    block = Block(rows, window)
    begin, end, anchor, segment, _ = block.segments()
    hit = known_values(anchor, segment, marks.append_column("owner", pa.array(np.ones(len(marks), np.int64))), 0) > 0
    lens = end[hit] - begin[hit] - window + 1
    starts = np.repeat(begin[hit] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
    a, b = block.windows(starts)
    at, low, high = extremes(a, b, block.number[block.owner[starts]])
    return pa.table({"a": a[at], "b": b[at], "low": low, "high": high, "block": np.full(len(at), rows["block"][0].as_py(), np.int64)})


def passages(block: Block, marks: pa.Table) -> list[tuple[int, int, int]]:
    """(first word, word after the last, owner) of every longest stretch of windows that are confirmed in documents below their own; the
    owner is the largest of the windows' owners."""
    begin, end, anchor, segment, doc = block.segments()
    if not len(begin):
        return []
    kind = marks["kind"].to_numpy()
    none = np.iinfo(np.int64).max
    _, inverse = np.unique(combined(anchor, segment), return_inverse=True)
    low = np.full(int(inverse.max()) + 1, none)
    np.minimum.at(low, inverse, doc)
    by_segment = np.minimum(low[inverse], known_values(anchor, segment, marks.filter(pa.array(kind == 0)), none))
    owner = np.repeat(by_segment, end - begin - block.window + 1)  # segments hold all windows, in order
    told = marks.filter(pa.array(kind == 1))
    if len(told):
        owner = np.minimum(owner, known_values(*block.windows(block.starts), told, none))
    hit = np.flatnonzero(owner < block.number[block.owner[block.starts]])
    if not len(hit):
        return []
    at, own = block.starts[hit], owner[hit]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | np.diff(block.owner[at]).astype(bool)]))
    ends = at[np.append(new[1:], len(at)) - 1] + block.window
    return list(zip(at[new].tolist(), ends.tolist(), np.maximum.reduceat(own, new).tolist()))


def covered(block: Block, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words lie in an occurrence of a passage whose owner is below their document: one automaton, one scan of all documents."""
    out = np.zeros(len(block.ids) + 1, np.int64)
    if not found:
        return out[:-1] > 0
    used = np.zeros(int(block.ids.max()) + 1, bool)
    for s, e, _ in found:
        used[block.ids[s:e]] = True
    rank = np.cumsum(used) - 1
    digits = 2 if rank[-1] < 1 << 16 else 3  # each word is as many letters of 256, the first from an alphabet of its own
    letters = np.zeros((len(block.ids), digits), np.uint32)
    for k in range(digits):
        letters[:, k] = (rank[block.ids] >> (8 * (digits - 1 - k))) & 255
    letters[:, 0] += 256
    letters[~used[block.ids]] = 512
    text = letters.tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton()
    for s, e, owner in found:
        key = text[digits * s:digits * e]
        automaton.add_word(key, (min(owner, automaton.get(key, (owner, 0))[0]), e - s))
    automaton.make_automaton()
    ends = np.cumsum(block.counts)
    for d, (doc_id, e) in enumerate(zip(block.doc_ids, ends.tolist())):
        if doc_id is None:
            continue
        base = e - int(block.counts[d])
        for at, (owner, n) in automaton.iter(text, digits * base, digits * e):
            if owner < doc_id:
                last = at // digits
                out[last - n + 1] += 1
                out[last + 1] -= 1
    return np.cumsum(out[:-1]) > 0


def locate(rows: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    if not len(rows):
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
    block = Block(rows, window)
    gone = covered(block, passages(block, marks))
    ends = np.concatenate([[0], np.cumsum(block.counts)])
    kept = np.concatenate([[0], np.cumsum(~gone)])[ends]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), block.words.filter(pa.array(~gone))), " ")
    digest = [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()]
    return pa.table({"doc_id": pa.array(block.doc_ids, pa.int64()), "n_words": block.counts, "n_removed": block.counts - np.diff(kept), "kept_sha256": pa.array(digest, pa.string())})


def repeated_passages(docs: DataFrame, window: int = 13, block_bytes: int = 2 << 20) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces); checkpointed."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    buckets = min(blocks, 100_000)
    with Scratch(spark, "substring-dedup") as scratch:
        # rows are dealt by their place in the input: no doc_id and no text, however frequent, makes a block large
        dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
        stored = scratch.write_bucketed(dealt.repartition(buckets, "block"), "blocks", buckets, ["block"])
        found = stored.groupBy("block").applyInArrow(lambda t: report_segments(t, window), "anchor long, segment long, low long, block long")

        anchor, segment = Window.partitionBy("anchor"), Window.partitionBy("anchor", "segment")
        shared = found.withColumns({"_least": F.min("low").over(anchor), "_most": F.max("low").over(anchor), "_several": F.min("segment").over(anchor) < F.max("segment").over(anchor)})
        shared = shared.filter("_least < _most").withColumn("owner", F.min("low").over(segment))
        shared = shared.withColumn("open", (F.col("owner") == F.col("low")) & F.col("_several")).filter("owner < low or open")
        shared = scratch.write(shared.select("block", F.col("anchor").alias("a"), F.col("segment").alias("b"), "owner", "open"), "segments")

        asked = stored.groupBy("block").cogroup(shared.filter("open").select("block", "a", "b").groupBy("block"))
        windows = asked.applyInArrow(lambda t, m: report_windows(t, m, window), "a long, b long, low long, high long, block long")
        windows = windows.withColumn("owner", F.min("low").over(Window.partitionBy("a", "b"))).filter("owner < high")
        windows = scratch.write(windows.select("block", "a", "b", "owner"), "windows")

        marks = shared.filter("not open").select("block", F.lit(0).cast("byte").alias("kind"), "a", "b", "owner").unionByName(
            windows.withColumn("kind", F.lit(1).cast("byte")))
        return checkpointed(stored.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda t, m: locate(t, m, window), RESULT))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with split as (
  select row_number() over () as id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select id, doc_id, i, w[i + 1:i + 13] as words from (select id, doc_id, w, unnest(range(len(w) - 12)) as i from split where doc_id is not null)
), owned as (select words, min(doc_id) as owner from windows group by words
), gone as (select distinct id, i + unnest(range(13)) as i from windows join owned using (words) where owner < doc_id
), removed as (select id, count(*) as n_removed from gone group by id
), kept as (
  select id, string_agg(word, ' ' order by i) as text from (select id, unnest(w) as word, unnest(range(len(w))) as i from split where id in (select id from removed)) anti join gone using (id, i) group by id
)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(case when n_removed is null then array_to_string(w, ' ') else coalesce(text, '') end) as kept_sha256
from split left join removed using (id) left join kept using (id)
"""
