"""Benchmark decontamination by latent semantic retrieval.

1. Every document is split into words once for each block of items and written as the numbers of the words that the block has.
   Document frequencies of the benchmark's words are counted over all documents. Words in more than ``max_df`` of the documents have no
   weight, like stop words, but every item keeps its ``rarest`` words whatever their frequency.
2. A distributed randomised SVD (range finder with power steps, then a small eigenproblem) of TF-IDF rows gives a latent space of
   ``rank`` dimensions. Its rows are the items of a block (at most ``2 * rank``) and all consecutive passages of all documents, both of the
   same total weight. Passages are short, so their Gram matrix (word by word) is added up by Spark once, and each step
   multiplies by its rows; only sums of one row for each word leave the tasks.
3. Every document is cut into overlapping passages of words. A passage whose latent cosine with an item reaches ``min_cosine`` times
   the part of the item that the space holds is a candidate: an exact copy passes however little of an item the space holds.
4. A candidate is confirmed by the longest common subsequence of words between the item and the passage with its
   surroundings: either most of the item is there (``min_lcs``), or, for paraphrases, a fair part of it (``min_paraphrase``) together
   with its answer, the item's last sentence (``min_answer`` of its informative words; if these are fewer than three, all of them
   and ``min_short`` of the item). Items of one sentence have no answer.

The benchmark is a stated query set against all passages; its word table and latent vectors are broadcast, in blocks of at most
about ``2 * rank`` items and ``block_words`` words, so what the driver and the tasks hold is bounded (block_words x rank numbers),
but for a single item of more words. Each block reads the documents again.

Defined results: null and empty documents and items match nothing; items shorter than ``min_item_words`` words are only
matched as exact word sequences; repeated documents are judged alike, repeated items each match; an empty
table gives no matches; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, bounded_arrow, checkpointed, table, text_hash, without

WORD = re.compile(r"\w+")
#: Answers with fewer informative words are weak evidence: all of them must be there, and more of the item.
SHORT_ANSWER = 3
SENTENCE_END = re.compile(r"[.!?]+\s+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def answer_words(text: str | None) -> list[str]:
    """Words of the last sentence that has any."""
    parts = [w for s in SENTENCE_END.split(text or "") if (w := words_of(s))]
    return parts[-1] if len(parts) > 1 else []


def lcs_length(masks: dict, seq: list) -> int:
    """Longest common subsequence by bit parallelism; masks: word -> bit mask of its places in the item."""
    state = 0
    for w in seq:
        m = masks.get(w)
        if m:
            x = state | m
            state = x & ~(x - ((state << 1) | 1))
    return state.bit_count()


def place_masks(words: list) -> dict:
    masks: dict = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | (1 << i)
    return masks


def coded_documents(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, _th, codes): the numbers of a text's words in order, -1 for words that the vocabulary lacks, as little-endian integers of
    ``code_type`` in one binary value; a null text has none."""
    bounded_arrow(docs.sparkSession)
    shared, kind = docs.sparkSession.sparkContext.broadcast(vocabulary), code_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            codes = [np.fromiter(map(get, words_of(t), repeat(-1)), kind).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_th"), pa.array(codes, pa.binary())], names=["doc_id", "_th", "codes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("_th"), "text")
    return texts.mapInArrow(run, "doc_id long, _th long, codes binary")


def code_type(vocabulary: dict[str, int]) -> str:
    return "<i2" if len(vocabulary) < 1 << 15 else "<i4"


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all documents of a batch one after another, how many each has)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // width, int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return flat.astype(np.int64), np.diff(offsets).astype(np.int64) // width


def document_frequencies(coded: DataFrame, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """(documents, documents holding each word): counted in the tasks, one row for each word and task is shuffled."""
    bounded_arrow(coded.sparkSession)
    n_words, kind = len(vocabulary), code_type(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_words + 1, np.int64)
        for b in batches:
            codes, lens = unpacked(b.column("codes"), kind)
            known = codes >= 0
            held = np.unique(np.repeat(np.arange(len(lens)), lens)[known] * n_words + codes[known])  # (document, word), each once
            df[:-1] += np.bincount(held % max(n_words, 1), minlength=n_words)
            df[-1] += len(b)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["word", "n"])

    rows = coded.select("codes").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_words + 1, np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return int(out[-1]), out[:-1]


def weighted_passages(coded: DataFrame, idf: np.ndarray, kind: str, length: int) -> DataFrame:
    """TF-IDF rows (words, weights) of unit length of the consecutive passages of ``length`` words of all documents, as far as they have weight."""
    bounded_arrow(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        weighted = np.append(idf > 0, False)  # -1 is the last entry
        for b in batches:
            codes, lens = unpacked(b.column("codes"), kind)
            at = np.flatnonzero(weighted[codes])
            first_word, per_doc = np.cumsum(lens) - lens, -(-lens // length)
            doc = np.searchsorted(first_word, at, side="right") - 1
            passage = (np.cumsum(per_doc) - per_doc)[doc] + (at - first_word[doc]) // length
            cells, n = np.unique(passage * len(idf) + codes[at], return_counts=True)
            passage, word = np.divmod(cells, max(len(idf), 1))
            marks = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(cells) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(marks, len(cells)))
            x = n * idf[word]
            x /= np.repeat(np.sqrt(np.add.reduceat(x * x, marks)), sizes) if len(cells) else 1.0
            offsets = pa.array(np.append(marks, len(cells)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(word.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x))],
                                             names=["words", "weights"])

    return coded.select("codes").mapInArrow(run, "words array<int>, weights array<double>")


def gram_rows(rows: DataFrame) -> DataFrame:
    """(word, words, weights): the rows of A'A for rows A of a bounded number of words, added up by pairs of words."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, weights = b.column("words"), b.column("weights")
            w, x = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weights.flatten().to_numpy(zero_copy_only=False)
            lens = np.diff(words.offsets.to_numpy()).astype(np.int64)
            size = np.repeat(lens, lens)  # for each entry the entries of its row
            one = np.repeat(np.arange(len(w)), size)
            first = np.repeat(np.repeat(np.cumsum(lens) - lens, lens), size)
            two = first + np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
            top = int(w.max(initial=0)) + 1
            keys, place = np.unique(w[one] * top + w[two], return_inverse=True)
            i, j = np.divmod(keys, top)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j.astype(np.int32)), pa.array(np.bincount(place, x[one] * x[two], len(keys)))], names=["word", "other", "x"])

    bounded_arrow(rows.sparkSession)
    summed = rows.mapInArrow(pairs, "word long, other int, x double").groupBy("word", "other").agg(F.sum("x").alias("x"))
    return summed.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("other", "x"))).alias("_r")).select(
        "word", F.col("_r.other").alias("words"), F.col("_r.x").alias("weights"))


def randomised_svd(rows: DataFrame, n_words: int, rank: int, own: list[tuple[np.ndarray, np.ndarray]] = (), power: int = 2, extra: int = 16, seed: int = 7) -> np.ndarray:
    """Right singular vectors [word, rank] of a sparse matrix; rows has ``words`` array<int> and ``weights`` array<double>, a bounded number in each.
    ``own`` are a few (words, weights) more, of any length, here."""
    return gram_space(checkpointed(gram_rows(rows)), n_words, rank, own, power, extra, seed)


def gram_space(gram: DataFrame, n_words: int, rank: int, own: list[tuple[np.ndarray, np.ndarray]] = (), power: int = 2, extra: int = 16, seed: int = 7) -> np.ndarray:
    """The same of gram_rows. Each step multiplies by them: a task sends one row for each row that it has."""
    spark = gram.sparkSession
    bounded_arrow(spark)
    width = min(rank + extra, n_words)

    def times_gram(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for b in batches:
                words, weights = b.column("words"), b.column("weights")
                w, x, at = words.flatten().to_numpy(), weights.flatten().to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
                data = np.stack([x[lo:hi] @ q[w[lo:hi]] for lo, hi in zip(at[:-1], at[1:])]) if len(b) else np.zeros((0, q.shape[1]))
                offsets = pa.array(np.arange(len(data) + 1, dtype=np.int32) * q.shape[1])
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.ListArray.from_arrays(offsets, pa.array(data.ravel()))], names=["word", "y"])

        out = np.zeros_like(q)
        made = gram.mapInArrow(run, "word long, y array<double>").toArrow()  # one row for each word
        if len(made):
            out[made["word"].to_numpy()] = np.asarray(made["y"].combine_chunks().flatten()).reshape(-1, q.shape[1])
        for w, x in own:
            out[w] += np.outer(x, x @ q[w])
        shared.destroy()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_words, width)))[0]
    for _ in range(power):
        q = np.linalg.qr(times_gram(q))[0]
    small = q.T @ times_gram(q)  # the Gram matrix in the found range
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    best = best[values[best] > max(values.max(initial=0), 0) * 1e-12]
    return q @ turn[:, best]


class ItemIndex:
    """What a task needs of one block of items: word numbers, idf, latent vectors, and masks for the checks."""

    def __init__(self, items: pd.DataFrame, vocabulary: dict[str, int], idf: np.ndarray, space: np.ndarray):
        self.ids = items["item_id"].to_numpy()
        self.vocabulary, self.idf = vocabulary, idf
        self.names = [*sorted(vocabulary, key=vocabulary.get), None]  # -1 is a word of no item
        self.space = space.astype(np.float32)
        self.words = [words_of(t) for t in items["text"]]
        # of the answer only informative words are evidence
        self.answers = [[w for w in answer_words(t) if idf[vocabulary[w]] > 0] for t in items["text"]]
        rows, full = np.zeros((len(items), space.shape[1])), np.zeros(len(items))
        for i, ws in enumerate(self.words):
            at, n = np.unique([vocabulary[w] for w in ws], return_counts=True)
            if len(at):
                rows[i], full[i] = (n * idf[at]) @ space[at], np.linalg.norm(n * idf[at])
        held = np.linalg.norm(rows, axis=1)
        self.latent = (rows / np.maximum(held, 1e-12)[:, None]).astype(np.float32)
        self.held = (held / np.maximum(full, 1e-12)).astype(np.float32)  # the part of each item that the space holds
        self.weighted = np.append(idf > 0, False)  # a word with no weight cannot move a passage's vector
        self.masks = [place_masks(w) for w in self.words]
        self.answer_masks = [place_masks(w) for w in self.answers]

    def candidates(self, codes: np.ndarray, lens: np.ndarray, stride: int, min_cosine: float, chunk: int = 1 << 15) -> list[tuple[int, int, int, float]]:
        """(document, item, first word of the passage, cosine) for a batch (its word numbers, and how many each document has); a passage is two
        neighbouring blocks of ``stride`` words.

        Vectors are linear in the words, so each block is projected once and passages are sums of two blocks. The norm
        counts occurrences one by one and so is never more than the true one: no candidate is lost by it."""
        at = np.flatnonzero(self.weighted[codes])  # -1 is the last entry, which has no weight
        if not len(at):
            return []
        codes = codes[at]
        first_word = np.cumsum(lens) - lens
        per_doc = -(-lens // stride)
        first_block = np.cumsum(per_doc) - per_doc
        doc = np.searchsorted(first_word, at, side="right") - 1
        block = first_block[doc] + (at - first_word[doc]) // stride
        marks = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        blocks, weight = block[marks], self.idf[codes]
        mass = np.append(np.add.reduceat(weight * weight, marks), 0.0)
        sums = np.zeros((len(blocks) + 1, self.space.shape[1]), np.float32)
        for lo in range(0, len(marks), 4096):
            part = marks[lo:lo + 4096]
            end = marks[lo + 4096] if lo + 4096 < len(marks) else len(codes)
            own = slice(part[0], end)
            sums[lo:lo + len(part)] = np.add.reduceat(self.space[codes[own]] * weight[own, None].astype(np.float32), part - part[0], axis=0)
        inner = blocks > first_block[doc[marks]]
        starts = np.unique(np.concatenate([blocks, blocks[inner] - 1]))
        owner = np.searchsorted(first_block, starts, side="right") - 1
        last = first_block[owner] + per_doc[owner] - 1

        def place(wanted: np.ndarray, there: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(blocks, wanted), len(blocks) - 1)
            return np.where(there & (blocks[i] == wanted), i, len(blocks))

        one, two = place(starts, np.ones(len(starts), bool)), place(starts + 1, starts < last)
        norm = np.sqrt(np.maximum(mass[one] + mass[two], 1e-18))
        out = []
        for lo in range(0, len(starts), chunk):
            part = slice(lo, lo + chunk)
            cos = (sums[one[part]] + sums[two[part]]) @ self.latent.T
            cos /= norm[part, None].astype(np.float32)
            for p, i in zip(*(x.tolist() for x in np.nonzero(cos >= min_cosine * self.held))):
                d = int(owner[lo + p])
                out.append((d, i, int(starts[lo + p] - first_block[d]) * stride, min(float(cos[p, i]), 1.0)))
        return out

    def confirm(self, item: int, words: list[str], start: int, length: int, rule: tuple[float, float, float, float]) -> tuple[float, float, bool]:
        min_lcs, min_paraphrase, min_answer, min_short = rule
        own = self.words[item]
        region = words[max(0, start - len(own)):start + length + len(own)]
        places = self.masks[item]
        # words that occur in both, as often as in the item, bound the subsequence: most candidates end here
        if sum(places[w].bit_count() for w in places.keys() & set(region)) < min(min_lcs, min_paraphrase) * len(own):
            return 0.0, 0.0, False
        lcs = lcs_length(places, region) / len(own)
        answer = self.answers[item]
        got = lcs_length(self.answer_masks[item], region) / len(answer) if answer else 0.0
        least, all_of = (min_paraphrase, min_answer) if len(answer) >= SHORT_ANSWER else (max(min_short, min_paraphrase), 1.0)
        return lcs, got, lcs >= min_lcs or (lcs >= least and len(answer) > 0 and got >= all_of)


def item_row(words: list[str], vocabulary: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, weights) of an item, of unit length."""
    at, n = np.unique(np.array([vocabulary[w] for w in words], np.int64), return_counts=True)
    x = n * idf[at]
    return at[x > 0], x[x > 0] / max(float(np.sqrt((x * x).sum())), 1e-12)


def find_leaks(docs: DataFrame, benchmark: DataFrame, stride: int = 32, rank: int = 256, min_cosine: float = 0.12, min_lcs: float = 0.7,
               min_paraphrase: float = 0.6, min_answer: float = 0.8, min_short: float = 0.65, min_item_words: int = 5, block_words: int = 50_000,
               max_df: float = 0.01, rarest: int = 8, sample: int | None = None) -> DataFrame:
    """doc_id, _th (hash of the text), item_id, cosine, lcs, answer of each confirmed document and item (best passage), checkpointed.

    The space is fitted on the passages of all documents; a caller may restrict that step (and no other) to ``sample`` texts."""
    spark = docs.sparkSession
    schema = "doc_id long, _th long, item_id long, cosine double, lcs double, answer double"
    found = spark.createDataFrame([], schema)
    items = benchmark.filter(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).select("item_id", "text")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // (2 * rank)), (size["chars"] or 0) // (6 * block_words))
    with Scratch(spark, "decontaminate") as scratch:
        for b in range(blocks):
            # at most about 2 * rank items, a bounded table, reach the driver at a time
            own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas()
            own = own[np.array([bool(words_of(t)) for t in own["text"]], bool)].sort_values(["item_id", "text"], ignore_index=True)
            if not len(own):
                continue
            vocabulary = {w: i for i, w in enumerate(sorted({w for t in own["text"] for w in words_of(t)}))}
            kind = code_type(vocabulary)
            coded = scratch.write(coded_documents(docs, vocabulary), f"coded{b}")
            n_docs, df = document_frequencies(coded, vocabulary)
            idf = np.where(df <= max_df * max(n_docs, 1), np.log((n_docs + 1.0) / (df + 1.0)), 0.0)
            # every item keeps its rarest words, however common they are
            own_words = [np.unique([vocabulary[w] for w in words_of(t)]) for t in own["text"]]
            keep = np.unique(np.concatenate([w[np.argsort(df[w], kind="stable")[:rarest]] for w in own_words]))
            idf[keep] = np.maximum(idf[keep], np.log((n_docs + 2.0) / (df[keep] + 1.0)))
            fitted = coded
            if sample is not None:
                fitted = coded.join(F.broadcast(coded.select("_th").distinct().orderBy("_th").limit(sample)), "_th", "left_semi").dropDuplicates(["_th"])
            gram = scratch.write(gram_rows(weighted_passages(fitted, idf, kind, 2 * stride)), f"gram{b}")
            # rows are of unit length, so the diagonal of their Gram matrix adds up to their number; the items weigh as much as the passages
            diagonal = F.get("weights", (F.array_position("words", F.col("word").cast("int")) - 1).cast("int"))
            n_rows = round(gram.agg(F.sum(diagonal)).first()[0] or 0)
            of_items = [item_row(words_of(t), vocabulary, idf) for t in own["text"].drop_duplicates()]
            factor = max(1.0, (n_rows / len(of_items)) ** 0.5)
            space = gram_space(gram, len(vocabulary), min(rank, max(1, n_rows + len(of_items) - 1)), [(w, factor * x) for w, x in of_items])
            index = spark.sparkContext.broadcast(ItemIndex(own, vocabulary, idf, space))
            rule = (min_lcs, min_paraphrase, min_answer, min_short)

            def search(batches: Iterator[pa.RecordBatch], index=index, rule=rule, kind=kind) -> Iterator[pa.RecordBatch]:
                ix = index.value
                short = [i for i, w in enumerate(ix.words) if len(w) < min_item_words]
                for batch in batches:
                    codes, lens = unpacked(batch.column("codes"), kind)
                    ends = np.cumsum(lens)
                    words = lambda d: [ix.names[c] for c in codes[ends[d] - lens[d]:ends[d]].tolist()]
                    best: dict[tuple[int, int], tuple] = {}
                    last, own_words = -1, []
                    for d, i, start, cos in ix.candidates(codes, lens, stride, min_cosine):
                        if best.get((d, i), (0,))[0] >= 1.0 or len(ix.words[i]) < min_item_words:
                            continue
                        if d != last:
                            last, own_words = d, words(d)
                        lcs, answer, hit = ix.confirm(i, own_words, start, 2 * stride, rule)
                        if hit and (lcs, cos) > best.get((d, i), (0, 0))[:2]:
                            best[d, i] = (lcs, cos, answer)
                    for d in range(len(lens) if short else 0):
                        joined = f" {' '.join(w or '' for w in words(d))} "
                        best |= {(d, i): (1.0, 1.0, 1.0) for i in short if f" {' '.join(ix.words[i])} " in joined}
                    ids, hashes = batch.column("doc_id").to_pylist(), batch.column("_th").to_pylist()
                    out = [(ids[d], hashes[d], int(ix.ids[i]), cos, lcs, a) for (d, i), (lcs, cos, a) in best.items()]
                    cols = list(zip(*out)) or [[]] * 6
                    kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "_th", "item_id", "cosine", "lcs", "answer"])

            bounded_arrow(spark)
            found = found.unionByName(scratch.write(coded.mapInArrow(search, schema), f"leaks{b}"))
            scratch.drop(f"coded{b}")
        return checkpointed(found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that no item matches, with all their columns; a row with a null doc_id stays unless its text matches."""
    leaks = find_leaks(docs, benchmark, **parameters).select("doc_id", "_th")
    return without(docs, leaks)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), F.round("lcs", 6).alias("lcs"), F.round("answer", 6).alias("answer"))
