"""Importance resampling towards a target distribution: hashed n-gram features, their gain of target over corpus, Gumbel draws.

Features are words and pairs of adjacent words; a feature's bucket is the crc32 of its bytes. A batch's texts are folded (A-Z
lower-cased, every delimiter a space); its distinct words, with a space at either end, form an Aho-Corasick dictionary whose
payloads are each word's crc32 and byte length. One scan of the batch emits the payloads in text order, and the crc32 of a
pair comes from two adjacent payloads alone: crc(a + b) is crc(a) moved on by len(b) zero bytes, xor crc(b).

Texts are scanned once: each document's buckets are written to the shared folder, two bytes each. They are counted (one row
for each bucket and task is exchanged; the counts of the ``buckets`` buckets meet on the driver) and read again for the
weights. Ranks come from counts of documents for each score, summed up in two levels, and from the order of documents within
one score.

Defined results: a null or empty text has no features, weight 0 and takes no part in the draw, like all documents of fewer
than ``least_words`` words; a null doc_id has no score and takes no part, but its text counts in the corpus; equal scores go
to the smaller doc_id; repeated rows are separate documents with equal scores, so one of them may be drawn without the other;
an empty corpus gives no rows, an empty target has counts of zero; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, bounded_arrow, checkpointed, table

# The reflected polynomial of crc32, and the bytes that belong to words: digits, a-z and all of non-ASCII characters.
CRC_POLYNOMIAL = 0xEDB88320
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
FOLD = bytes(c if c in WORD_BYTES else 32 for c in bytes(range(256)).lower())
#: Scores are counted in bins of this many values before they are summed up.
SCORE_BIN = 256
#: Copies of one row are dealt out in runs of at most this many.
COPIES = 1 << 16


def _shift_tables(bits: int = 40) -> np.ndarray:
    """[k, j, v]: what byte j with value v of a crc becomes after 2**k zero bytes; the four of a crc are xored."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(CRC_POLYNOMIAL), step >> 1)
    tables = np.zeros((bits, 4, 256), np.uint32)
    for j in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        tables[0, j] = step[v & 255] ^ (v >> np.uint32(8))
    for k in range(1, bits):
        tables[k] = _moved(tables[k - 1], tables[k - 1])
    return tables


def _moved(crc: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


SHIFT = _shift_tables()
SPACE = np.uint32(zlib.crc32(b" "))


def after_zeros(crc: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """crc32 values (without their final xor) moved on by ``lens`` zero bytes each."""
    out = crc.copy()
    for k in range(int(lens.max(initial=0)).bit_length()):
        at = np.flatnonzero((lens >> k) & 1)
        out[at] = _moved(out[at], SHIFT[k])
    return out


def joined(crc: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """crc32 of each word, a space and its successor, from the words' own crc32 and lengths."""
    left = _moved(crc[:-1], SHIFT[0]) ^ SPACE
    return after_zeros(left, lens[1:]) ^ crc[1:]


def scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 and byte length of every word of all texts in order, number of words of each text)."""
    folded = [t.translate(FOLD) for t in texts]
    split = [t.split() for t in folded]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = ahocorasick.Automaton()
    for w in set().union(*split):
        words.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    payloads = np.zeros(0, np.int64)
    if len(words):
        words.make_automaton()
        whole = f" {b' '.join(folded).decode('latin-1')} "
        payloads = np.fromiter(map(itemgetter(1), words.iter(whole)), np.int64, int(counts.sum()))
    return (payloads & 0xFFFFFFFF).astype(np.uint32), payloads >> 32, counts


def bucket_lists(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, text by text: each word, then its pair with the next one; number of words of each text)."""
    crc, lens, counts = scan(texts)
    both = np.zeros((len(crc), 2), np.uint32)
    both[:, 0] = crc
    paired = np.ones((len(crc), 2), bool)
    if len(crc):
        both[:-1, 1] = joined(crc, lens)
        paired[np.cumsum(counts)[counts > 0] - 1, 1] = False  # the last word of a text has no successor
    return both[paired].astype(np.int64) % buckets, counts


def features(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary: numbers of two bytes, or four if there are more than 65,536 buckets)."""
    bounded_arrow(docs.sparkSession)
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, counts = bucket_lists([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()], buckets)
            n = counts + np.maximum(counts - 1, 0)
            data = found.astype(kind)
            ends = np.cumsum(n) * data.itemsize
            stored = pa.array([data.view(np.uint8)[e - k:e].tobytes() for e, k in zip(ends.tolist(), (n * data.itemsize).tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), pa.array(n), stored], names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _stored(b: pa.RecordBatch, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("buckets").to_pylist()), kind)


def bucket_counts(stored: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all documents fall into each bucket. A task adds up its batches first."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_stored(b, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = stored.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed share of each bucket in the target over that in the corpus."""
    n = len(corpus)
    every_s, every_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * every_s / ((s + 1.0) * every_t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(stored: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_features").to_numpy()
            before = np.concatenate([[0], np.cumsum(gain[_stored(b, kind)])])
            total = before[np.cumsum(n)] - before[np.cumsum(n) - n]
            yield pa.RecordBatch.from_arrays([*b.select(["doc_id", "n_words", "n_features"]).columns, pa.array(total // np.maximum(n, 1))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return stored.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variate) from the first 32 bits of sha256 of "seed:doc_id"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """scored (doc_id, n_features, weight, score, eligible) -> with rank: the first ``percent`` % of the eligible rows by score, then doc_id."""
    own = ["doc_id", "n_features", "weight", "score"]
    per_score = scratch.write(scored.filter("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("score") / SCORE_BIN)), "per-score")
    higher = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # some hundred bins, whatever the input
    inside = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    bins = per_score.groupBy("bin").agg(F.sum("n").alias("total")).withColumn("above", F.coalesce(F.sum("total").over(higher), F.lit(0)))
    offsets = per_score.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bins, "bin").select("score", (F.col("above") + F.col("_in")).alias("above"))
    eligible = per_score.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    offsets = scratch.write(offsets.filter(F.col("above") < percent * eligible // 100), "offsets")
    # copies of one row count as one with a number, so that they need not be sorted one by one
    same = scored.filter("eligible").groupBy(*own).agg(F.count(F.lit(1)).alias("n")).join(offsets, "score")
    before = F.sum("n").over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("above", F.col("above") + F.coalesce(before, F.lit(0)))
    runs = same.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    each = runs.withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("n") - F.col("run") * COPIES))))
    rank = F.col("above") + F.col("run") * COPIES + F.col("i")
    high = each.select(*own, F.when(rank <= percent * eligible // 100, rank).alias("rank"))
    low = scored.filter("eligible").join(offsets, "score", "left_anti").unionByName(scored.filter("not eligible"))
    return high.unionByName(low.select(*own, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_features, weight, score, rank (null: not drawn), all long; checkpointed."""
    with Scratch(docs.sparkSession, "resample") as scratch:
        stored = scratch.write(features(docs, buckets), "features")
        wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
        gain = gains(bucket_counts(stored, buckets), bucket_counts(features(wanted, buckets), buckets))
        rows = weights(stored, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        rows = scratch.write(rows.withColumn("eligible", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)).drop("n_words"), "scored")
        return checkpointed(ranked(rows, percent, scratch))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with crc_table as (
  select list(c order by i) as t from (select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: k::ubigint)),
    lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) r(i))
), texts as (
  select doc_id, 0 as side, text from documents union all select null, 1, text from benchmark
), words as (
  select row_number() over () as id, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), features as (
  select id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) as f from words
), counted as (select id, side, f, count(*) as n from features group by all
), coded as (
  select f, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(length(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::ubigint)),
    lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::bigint])), 4294967295::ubigint) % 10000)::bigint as bucket
  from (select distinct f from counted) d, crc_table
), placed as (select id, side, bucket, n from counted join coded using (f)
), totals as (select coalesce(sum(n) filter (side = 0), 0)::double as all_s, coalesce(sum(n) filter (side = 1), 0)::double as all_t from placed
), bucket_sums as (
  select bucket, coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t from placed group by bucket
), gain as (
  select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as g from bucket_sums, totals
), weighed as (select id, sum(n)::bigint as n_features, floor(sum(n * g)::double / sum(n))::bigint as weight from placed join gain using (bucket) where side = 0 group by id
), scored as (
  select id, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('7:', doc_id::varchar)), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words left join weighed using (id) where side = 0
), draw as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r, count(*) over (partition by n_words >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 25 * n // 100 then r end as rank from draw
"""
