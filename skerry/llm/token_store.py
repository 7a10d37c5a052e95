"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on doc_id, in ascending doc_id order.

Texts are range-partitioned and sorted by doc_id, encoded in Arrow batches and written as ORC; every file holds one range.
A row stores its partition and the number of ids before it in that partition, so global positions need only the
partitions' totals, no global sort. Readers prune stripes and row groups by doc_id.

Defined results: null text is empty and has the end id alone; null doc_ids come first; rows of equal doc_id are adjacent
and in the order of their texts' hashes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, bounded_arrow, checkpointed, table
from skerry.llm.pieces import Memo, gather, list_array, split_batch

END_ID = 2
PUNCTUATION = string.punctuation
_STORED = "doc_id long, part int, before long, ids array<int>"
_memos: dict[str, Memo] = {}


def word_memo(vocabulary: str) -> Memo:
    """A worker's cache of encoded pieces of words."""
    if vocabulary not in _memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(vocabulary)
        # what encode_batch relies on: words end in </w>, A-Z is lower-cased, white space and punctuation separate
        sure = all(tok.encode(a, add_special_tokens=False).ids == tok.encode(b, add_special_tokens=False).ids for a, b in (("Ab Cd", "ab cd"), ("ab, cd", "ab , cd"), ("ab \t\n cd", "ab cd")))
        if not sure or not any(w.endswith("</w>") for w in tok.get_vocab(with_added_tokens=False)):
            raise ValueError("not a lower-casing vocabulary with word ends: its texts cannot be encoded word by word")
        last = np.zeros(tok.get_vocab_size(with_added_tokens=True), bool)
        last[[i for w, i in tok.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True

        def together(words: list[str]) -> list[list[int]]:
            """Words of letters alone, encoded in lines; the ids that end a word show where to cut."""
            lines = [words[i:i + 64] for i in range(0, len(words), 64)]
            out: list[list[int]] = []
            for own, e in zip(lines, tok.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
                ends = [0, *(np.flatnonzero(last[e.ids]) + 1).tolist()]
                if len(ends) == len(own) + 1:
                    ids = e.ids
                    out += [ids[i:j] for i, j in zip(ends, ends[1:])]
                else:
                    out += [x.ids for x in tok.encode_batch_fast(own, add_special_tokens=False)]
            return out

        def encode(words: list[str]) -> list[list[int]]:
            plain = [w.isalpha() for w in words]
            easy = iter(together([w for w, p in zip(words, plain) if p]))
            hard = iter(tok.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
            return [next(easy) if p else next(hard).ids for p in plain]

        _memos[vocabulary] = Memo(encode, limit=700_000)
    return _memos[vocabulary]


def encode_batch(texts: pa.Array, memo: Memo, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each text), each text with its end id.

    White space is dropped by this kind of tokenizer and no rule of it looks across white space, so a text's ids are those of
    its white-space-separated words, one after another. A word of letters and the ASCII punctuation after it are separate
    too, and A-Z may be lower-cased beforehand, so each distinct run of letters is encoded once."""
    offsets, codes, words = split_batch(texts, pc.ascii_split_whitespace)
    heads, tails = [], []
    for w in words.to_pylist():
        head = w.rstrip(PUNCTUATION)
        if head.isalpha():
            heads.append(head.lower() if head.isascii() else head)
            tails.append(w[len(head):])
        else:
            heads.append(w)
            tails.append("")
    known: dict[str, int] = {}
    numbers = [known.setdefault(x, len(known)) for x in heads]
    numbers += [known.setdefault(x, len(known)) for x in tails]
    slots = memo.slots(list(known))
    starts, lens = memo.starts[slots][numbers], memo.lens[slots][numbers]
    n = len(heads)
    # two runs of ids for each word, and one more "word": the end of a text
    flat = np.concatenate([memo.flat[:memo.used], np.array([end_id], np.int32)])
    starts = np.stack([np.append(starts[:n], memo.used), np.append(starts[n:], 0)], 1)
    lens = np.stack([np.append(lens[:n], 1), np.append(lens[n:], 0)], 1)
    codes = np.insert(codes, offsets[1:], n)
    per_word = lens[codes]
    bounds = np.concatenate([[0], np.cumsum(per_word.sum(1))])
    at = offsets + np.arange(len(offsets))
    return gather(flat, starts[codes].ravel(), per_word.ravel()), np.diff(bounds[at])


def write_token_orc(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, stripe_bytes: int = 16 << 20,
                    stride: int = 1000, bloom_fpp: float = 0.01) -> None:
    """Encode doc_id, text and write the ORC files."""
    bounded_arrow(docs.sparkSession, rows=4096, size="12m")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, before = word_memo(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, lens = encode_batch(b.column("text"), memo, end_id)
            starts = before + np.cumsum(lens) - lens
            before += int(lens.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(lens), part, np.int32)), pa.array(starts), list_array(ids, lens)],
                names=["doc_id", "part", "before", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    (ordered.mapInArrow(encode, _STORED).write.mode("overwrite")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp))
     .option("orc.create.index", "true").option("orc.row.index.stride", str(stride))
     .option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path))


def read_token_orc(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """doc_id, part, before, ids; bounds or single doc_ids are pushed down to stripes, row groups and Bloom filters."""
    out = spark.read.schema(_STORED).orc(path)
    if low is not None:
        out = out.filter(F.col("doc_id") >= low)
    if high is not None:
        out = out.filter(F.col("doc_id") <= high)
    return out if ids is None else out.filter(F.col("doc_id").isin(ids))


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, part, before, n_tokens, ids_crc32 of stored rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("ids")
            offsets = np.asarray(col.offsets).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(np.asarray(col.values), dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), b.column("before"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    bounded_arrow(tokens.sparkSession)
    return tokens.mapInArrow(digest, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")


def with_global_start(digests: DataFrame) -> DataFrame:
    """Turn positions within partitions into positions over all documents; one row for each partition is summed up in order."""
    totals = digests.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return digests.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark, "token-store") as scratch:
        write_token_orc(docs, f"{scratch.path}/orc", public_tokenizers.path("word_bpe_49k.json"))
        digests = checkpointed(token_digests(read_token_orc(spark, f"{scratch.path}/orc")))
    return with_global_start(digests)
