"""Language-model scores by Stupid Backoff over n-gram count tables partitioned by hash.

1. Documents become blocks of tokens (a block is one Arrow batch of whole documents; words are kept as 64-bit hashes), written once.
2. Every block explodes into its n-grams of each order; equal ones of a block are one entry with a count. The entries are
   partitioned by the hash of the n-gram: a bucket holds one hash range of one order's count table.
3. In its bucket an n-gram's counts over all blocks are summed, and each block's entries are joined to the sums.
4. The joined counts go back to the blocks and each document's log scores are summed.

An n-gram that is in every document has one entry for each block, not for each occurrence, so no key is hot; entries travel
as sorted, delta-coded runs, one row for each block and bucket, and the counts come back in the run's order, without keys. The
numbers of buckets and of partitions follow the number of tokens, so a task's share stays the same; a run gets shorter as
buckets grow in number (at 30 GB some 200 n-grams), and at worst is one n-gram, which is a plain row.

Score of a token: count(n-gram) / count(its context) for the longest n-gram seen at least ``min_count`` times, times
``backoff`` for each order given up; below the bigram it is the word's share of all tokens. The first tokens of a document
have shorter contexts, at no penalty. A word that the corpus does not hold counts as half a token.

Defined results: words are runs of characters other than ASCII white space, with A-Z lower-cased; null and empty texts have no tokens
and a log score of 0; repeated rows are separate documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, bounded_arrow, checkpointed, table
from skerry.llm.near_dedup import mixed
from skerry.llm.pieces import split_batch

_BLOCK = "block long, corpus boolean, doc_ids array<long>, lens array<int>, words binary, codes binary, n_tokens long"
_ENTRY = "ngram_order int, bucket int, block long, corpus boolean, keys binary, counts binary"
_REPLY = "block long, ngram_order int, bucket int, totals binary"
_SCORE = "doc_id long, n_tokens long, n_backoff long, log_score double"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers byte by byte in planes, each compressed by itself where that helps: the high planes hold few values."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    small = [pa.compress(p.tobytes(), "zstd", asbytes=True) if len(values) > 64 else b"" for p in planes]
    stored = [c if 0 < len(c) < len(values) else p.tobytes() for c, p in zip(small, planes)]
    head = np.array([width, len(values), *map(len, stored)], "<u4")
    return head.tobytes() + b"".join(stored)


def unpack(data: bytes) -> np.ndarray:
    width, n = np.frombuffer(data, "<u4", 2).tolist()
    at, out = 8 + 4 * width, np.zeros((n, 8), np.uint8)
    for i, size in enumerate(np.frombuffer(data, "<u4", width, 8).tolist()):
        plane = data[at:at + size] if size == n else pa.decompress(data[at:at + size], n, "zstd", asbytes=True)
        out[:, i] = np.frombuffer(plane, np.uint8)
        at += size
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def token_blocks(docs: DataFrame, corpus: bool) -> DataFrame:
    bounded_arrow(docs.sparkSession, rows=8192, size="8m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            offsets, codes, words = split_batch(pc.ascii_lower(b.column("text")), pc.ascii_split_whitespace)
            blank = words.index("").as_py()
            if blank >= 0:  # what white space at a text's ends and empty texts leave
                real = codes != blank
                offsets, codes = np.concatenate([[0], np.cumsum(real)])[offsets], codes[real]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in words), np.uint64, len(words))
            block = ((2 * part + int(corpus)) << 32) | i
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([corpus]), pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([np.diff(offsets).astype(np.int32)], pa.list_(pa.int32())), pa.array([hashes.tobytes()], pa.binary()),
                 pa.array([pack(codes.astype(np.uint64))], pa.binary()), pa.array([len(codes)])],
                names=["block", "corpus", "doc_ids", "lens", "words", "codes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _BLOCK)


def ngrams(words: bytes, codes: bytes, lens: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Order by order, the n-gram hash that ends at each token; where a document has no such n-gram the hash is 0."""
    h = np.frombuffer(words, np.uint64)[unpack(codes).astype(np.int32)] if len(words) else np.zeros(0, np.uint64)
    place = np.arange(len(h), dtype=np.int32) - np.repeat((np.cumsum(lens) - lens).astype(np.int32), lens)
    yield np.maximum(mixed(h, 1), np.uint64(1))
    gram = h
    for n in range(2, order + 1):
        gram = np.concatenate([np.zeros(1, np.uint64), gram[:-1]]) if len(gram) else gram
        gram = mixed(gram, n) ^ h  # the (n-1)-gram that ends one token before, then this word
        yield np.where(place >= n - 1, np.maximum(mixed(gram, n + 20), np.uint64(1)), np.uint64(0))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys without 0, their counts)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    counts = np.diff(first, append=len(keys))
    skip = int(len(first) > 0 and keys[0] == 0)
    return keys[first[skip:]], counts[skip:]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the key, so that each bucket is a run of the sorted keys."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def explode_ngrams(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, corpus = b.column("block")[i].as_py(), b.column("corpus")[i].as_py()
                words, codes, lens = b.column("words")[i].as_py(), b.column("codes")[i].as_py(), b.column("lens")[i].values.to_numpy()
                for o, keys in enumerate(ngrams(words, codes, lens, order), 1):
                    distinct, counts = _counted(keys)
                    cuts = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
                    full = np.flatnonzero(np.diff(cuts))
                    runs = [(distinct[cuts[p]:cuts[p + 1]], counts[cuts[p]:cuts[p + 1]]) for p in full]
                    n = len(full)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, o, np.int32)), pa.array(full.astype(np.int32)), pa.array(np.full(n, block)), pa.array([corpus] * n, pa.bool_()),
                         pa.array([pack_sorted(d) for d, _ in runs], pa.binary()), pa.array([pack(c.astype(np.uint64)) for _, c in runs], pa.binary())],
                        names=["ngram_order", "bucket", "block", "corpus", "keys", "counts"])

    return blocks.mapInArrow(run, _ENTRY)


def join_counts(entries: DataFrame, corpus_is_docs: bool) -> DataFrame:
    """In each bucket: the count table of its hash range, joined to the entries of the blocks that are to be scored."""
    def run(group: pa.Table) -> pa.Table:
        owned = group.column("corpus").to_pylist()
        runs = [unpack_sorted(k.as_py()) for k in group.column("keys")]
        keys = np.concatenate(runs)
        ends = np.cumsum([len(k) for k in runs])
        del runs
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int32)
        ordered = keys[order]
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]), dtype=np.int32)
        del keys, order, ordered
        totals = np.zeros(int(rank.max(initial=-1)) + 1, np.float64)
        for c, own, end, begin in zip(group.column("counts"), owned, ends, [0, *ends[:-1]]):
            if own:
                totals[rank[begin:end]] += unpack(c.as_py())  # a run holds each key once
        keep = [i for i, own in enumerate(owned) if corpus_is_docs or not own]
        packed = [pack(totals[rank[(ends[i - 1] if i else 0):ends[i]]].astype(np.uint64)) for i in keep]
        same = {"ngram_order": pa.int32(), "bucket": pa.int32()}
        return pa.table([group.column("block").take(pa.array(keep, pa.int64())), *[pa.array(group.column(c).to_pylist()[:1] * len(keep), k) for c, k in same.items()],
                         pa.array(packed, pa.binary())], names=["block", "ngram_order", "bucket", "totals"])

    return entries.groupBy("ngram_order", "bucket").applyInArrow(run, _REPLY)


def score_blocks(blocks: DataFrame, replies: DataFrame, order: int, n_corpus: int, min_count: int, backoff: float) -> DataFrame:
    def score_block(r: dict, totals: dict[int, list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = r["lens"].values.to_numpy()
        n = int(lens.sum())
        place = np.arange(n, dtype=np.int32) - np.repeat((np.cumsum(lens) - lens).astype(np.int32), lens)
        score, level, below = np.zeros(n), np.ones(n, np.int8), np.zeros(n)
        for o, keys in enumerate(ngrams(r["words"].as_py(), r["codes"].as_py(), lens, order), 1):
            # the totals are in the order of the block's distinct keys; 0, no such n-gram, comes first where it occurs
            _, inverse = np.unique(keys, return_inverse=True)
            none = [np.zeros(int(n > 0 and (keys == 0).any()), np.uint64)]
            counts = np.concatenate(none + [unpack(t) for t in totals.pop(o, [])]).astype(np.float64)[inverse]
            del keys, inverse
            if o == 1:
                score = np.log(np.maximum(counts, 0.5) / max(n_corpus, 1))
            else:
                context = np.concatenate([[1.0], below[:-1]]) if n else below
                seen = (place >= o - 1) & (counts >= min_count)
                score[seen] = np.log(np.maximum(counts[seen], 1) / np.maximum(context[seen], 1))
                level[seen] = o
            below = counts
        given_up = np.minimum(place + 1, order) - level
        score += given_up * np.log(backoff)
        marks = np.concatenate([[0], np.cumsum(lens)])
        sums, backs = np.concatenate([[0], np.cumsum(score)]), np.concatenate([[0], np.cumsum(given_up > 0)])
        return lens.astype(np.int64), np.diff(backs[marks]), np.diff(sums[marks])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("ngram_order", "ascending"), ("bucket", "ascending")])
        totals: dict[int, list[bytes]] = {}
        for o, t in zip(right.column("ngram_order").to_pylist(), right.column("totals")):
            totals.setdefault(o, []).append(t.as_py())
        out = []
        for i in range(left.num_rows):
            r = {c: left.column(c)[i] for c in ("lens", "words", "codes")}
            n_tokens, n_backoff, log_score = score_block(r, totals)
            out.append(pa.table([left.column("doc_ids")[i].values, pa.array(n_tokens), pa.array(n_backoff), pa.array(log_score)], names=["doc_id", "n_tokens", "n_backoff", "log_score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64())],
                                                          names=["doc_id", "n_tokens", "n_backoff", "log_score"])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _SCORE)


def lm_scores(docs: DataFrame, corpus: DataFrame | None = None, order: int = 3, min_count: int = 2, backoff: float = 0.4,
              bucket_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens, n_backoff (tokens that gave up an order), log_score (natural, summed) under counts of ``corpus`` (docs
    themselves by default); checkpointed. With ``min_count`` 1 and the documents as their own corpus no token would ever back
    off, as every n-gram is seen in its own document; hence 2."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "lm-score") as scratch:
        # tables bucketed by block: the texts themselves are not shuffled when the counts come back to them
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = scratch.write_bucketed(token_blocks(docs, corpus is None), "blocks", max(least, size >> 25), ["block"])
        everything = blocks
        if corpus is not None:
            everything = blocks.unionByName(scratch.write(token_blocks(corpus, True), "corpus"))
        sizes = everything.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("corpus"), F.col("n_tokens"))), F.lit(0)).alias("corpus")).first()
        buckets = max(1, -(-sizes["all"] // bucket_tokens))
        # a task joins about eight buckets, however many there are
        entries = explode_ngrams(everything, order, buckets).repartition(max(least, order * buckets // 8), "ngram_order", "bucket")
        replies = join_counts(entries, corpus is None)
        return checkpointed(score_blocks(blocks, replies, order, sizes["corpus"], min_count, backoff))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 3).alias("log_score"))


OP8_SQL = r"""
with w as (
  select doc_id, generate_subscripts(x, 1) as i, unnest(x) as a from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as x from documents)
), g as (
  select doc_id, i, a as w1, lag(a) over d as w2, lag(a, 2) over d as w3 from w window d as (partition by doc_id order by i)
), c1 as (select w1, count(*) as n1 from g group by 1),
c2 as (select w1, w2, count(*) as n2 from g where w2 is not null group by all),
c3 as (select w1, w2, w3, count(*) as n3 from g where w3 is not null group by all),
s as (
  select g.doc_id, case when n3 >= 2 then ln(n3 / p2.n2::double) when c2.n2 >= 2 then ln(c2.n2 / p1.n1::double) + case when g.w3 is null then 0 else ln(0.4::double) end
      else ln(c1.n1 / (select count(*) from g)::double) + (least(i, 3) - 1) * ln(0.4::double) end as score,
    case when n3 >= 2 then 0 when c2.n2 >= 2 then (g.w3 is not null)::int else (g.w2 is not null)::int end as gave
  from g join c1 using (w1) left join c2 on c2.w1 = g.w1 and c2.w2 = g.w2 left join c3 on c3.w1 = g.w1 and c3.w2 = g.w2 and c3.w3 = g.w3
    left join c1 p1 on p1.w1 = g.w2 left join c2 p2 on p2.w1 = g.w2 and p2.w2 = g.w3
)
select d.doc_id, count(score) as n_tokens, coalesce(sum(gave), 0)::bigint as n_backoff, round(coalesce(sum(score), 0), 3) as log_score
from documents d left join s using (doc_id) group by d.doc_id
"""
