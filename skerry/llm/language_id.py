"""Language identification by Bayesian evidence fusion.

Text likelihood: a multinomial model over hashed byte trigrams, fitted on a bounded sample of labelled documents
(``train_rows``, chosen by a hash of the id). Address prior: how often each language was read from the texts of a host,
shrunk to its address suffix, shrunk to the whole corpus; counted over all documents by grouped aggregation. Declared
language: how often each value of the markup's language goes with each language, counted over all documents. The
posterior is the product of the three; the text's part is tempered, because neighbouring trigrams are not independent.

A document is rejected if it has no letters or if no language reaches ``min_posterior``.

Defined results: null and empty texts have no language and are rejected; missing declarations, hosts or suffixes add no
evidence of their own (they share one group); ties go to the language first in alphabetical order; without labelled
documents no language is known and all are rejected; repeated rows are judged alike; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, bounded_arrow, checkpointed, table, text_hash
from skerry.llm.url_filter import address_suffix, url_host, url_path

SLOTS = 1 << 16


def _folded() -> np.ndarray:
    """Byte classes: A-Z lower-cased, digits and ASCII punctuation and white space as one space."""
    fold = np.arange(256, dtype=np.uint32)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    return fold


FOLD = _folded()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of the trigram at each byte, first and last + 1 place of each text's trigrams) of a string array without nulls."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and n else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    b = FOLD[raw]
    if len(b) < 3:
        return np.zeros(0, np.uint32), bounds[:-1] * 0, bounds[:-1] * 0
    slots = b[:-2] * np.uint32(0x9E3779B1)
    slots += b[1:-1] * np.uint32(0x85EBCA77)
    slots += b[2:] * np.uint32(0xC2B2AE3D)
    slots ^= slots >> np.uint32(15)
    slots &= np.uint32(SLOTS - 1)
    return slots, bounds[:-1], np.maximum(bounds[1:] - 2, bounds[:-1])


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts))
    full = ends > starts
    if full.any():
        marks = np.stack([starts[full], ends[full]], 1).ravel()
        padded = np.append(values, np.zeros(1, values.dtype))
        out[full] = np.add.reduceat(padded, marks, dtype=np.float64)[::2]
    return out


def train_text_model(docs: DataFrame, train_rows: int = 20_000) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, slot]) from doc_id, text and label column ``lang``. A sample by hash holds about train_rows
    documents, under twice that. Each language takes 65,536 numbers in each task and on the driver."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    one_in = max(1, labelled.count() // train_rows)
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            slots, starts, ends = trigrams(b.column("text"))
            for lang, s, e in zip(b.column("lang").to_pylist(), starts.tolist(), ends.tolist()):
                if lang not in totals:
                    totals[lang] = np.zeros(SLOTS, np.int64)
                totals[lang] += np.bincount(slots[s:e], minlength=SLOTS) if e - s > SLOTS // 8 else 0
                if e - s <= SLOTS // 8:
                    at, n = np.unique(slots[s:e], return_counts=True)
                    totals[lang][at] += n
        for lang, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])],
                                             names=["lang", "slot", "n"])

    padded = sample.select("lang", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"))
    counts = padded.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    grid = np.full((len(langs), SLOTS), 0.5)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        grid[i, own["slot"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)


def text_likelihoods(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], most_trigrams: int = 40) -> DataFrame:
    """keep columns, ``ll`` array<double> by language (tempered to the weight of most_trigrams independent ones) and ``grams``."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(model)
    blank = int(trigrams(pa.array(["   "]))[0][0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        for b in batches:
            slots, starts, ends = trigrams(b.column("_padded"))
            letters = segment_sums((slots != blank).astype(np.float32), starts, ends)
            sums = np.stack([segment_sums(row[slots], starts, ends) for row in logp], 1) if langs else np.zeros((b.num_rows, 0))
            sums -= sums.max(1, keepdims=True) if langs else 0
            grams = np.maximum(ends - starts, 1)
            sums *= (np.minimum(grams, most_trigrams) / grams)[:, None]
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(langs))
            lists = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists, pa.array(letters.astype(np.int64))], names=[*keep, "ll", "grams"])

    padded = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("_padded")
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, padded).mapInArrow(score, f"{kinds}, ll array<double>, grams long")


def _first_max(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def _counts(df: DataFrame, keys: list[str], n_langs: int) -> DataFrame:
    """Per group the number of documents whose text speaks for each language; partial sums precede the shuffle."""
    sums = [F.sum(F.when(F.col("top") == i, 1).otherwise(0)).cast("double").alias(f"c{i}") for i in range(n_langs)]
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"c{i}" for i in range(n_langs)]).alias("c"))


def _shrunk(counts: Column, up: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, up, lambda c, u: (c + strength * u) / (total + strength))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], evidence: DataFrame | None = None, min_posterior: float = 0.5,
             host_strength: float = 20.0, suffix_strength: float = 20.0) -> DataFrame:
    """docs (doc_id, text, host) and evidence (doc_id, declared, host, suffix; one row for each id, its host goes first) ->
    doc_id, _th (hash of the text), language, posterior, text_language, accepted; checkpointed. One row for each row of docs.
    Texts are never shuffled: what is joined are their likelihoods."""
    spark, langs = docs.sparkSession, model[0]
    names = F.array(*[F.lit(x) for x in langs]) if langs else F.array().cast("array<string>")
    if evidence is None:
        evidence = spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, declared string, host string, suffix string")
    with Scratch(spark, "language-id") as scratch:
        rows = docs.select("doc_id", "text", text_hash(F.col("text")).alias("_th"), F.col("host").alias("_source"))
        rows = text_likelihoods(rows, model, ["doc_id", "_th", "_source"]).join(evidence, "doc_id", "left")
        low = {c: F.coalesce(F.lower(F.col(c)), F.lit("")) for c in ("declared", "suffix")}
        rows = rows.withColumns(low | {"host": F.coalesce(F.lower("host"), F.lower("_source"), F.lit(""))}).drop("_source")
        if not langs:
            return checkpointed(rows.select("doc_id", "_th", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
                                            F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted")))
        rows = scratch.write(rows.withColumn("top", F.when(F.col("grams") > 0, _first_max(F.col("ll")))), "scored")
        n = len(langs)
        flat = F.array(*[F.lit(1.0 / n)] * n)
        whole = _counts(rows.withColumn("one", F.lit(1)), ["one"], n).select(_shrunk(F.col("c"), flat, float(n)).alias("p0"))
        hosts = _counts(rows, ["host", "suffix"], n)
        by_suffix = hosts.groupBy("suffix").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n)])
        by_suffix = by_suffix.select("suffix", F.array(*[f"c{i}" for i in range(n)]).alias("cs")).join(F.broadcast(whole))  # one row
        by_suffix = by_suffix.select("suffix", _shrunk(F.col("cs"), F.col("p0"), suffix_strength).alias("up"))
        hosts = hosts.join(by_suffix, "suffix").select("host", "suffix", _shrunk(F.col("c"), F.col("up"), host_strength).alias("prior"))
        said = _counts(rows, ["declared"], n)
        totals = said.agg(F.array(*[F.sum(F.col("c")[i]) for i in range(n)]).alias("all"), F.count(F.lit(1)).alias("kinds"))
        said = said.join(F.broadcast(totals)).select(  # one row
            "declared", F.zip_with("c", "all", lambda c, t: (c + 1.0) / (t + F.col("kinds"))).alias("fit"))
        hosts, said = scratch.write(hosts, "hosts"), scratch.write(said, "said")
        out = rows.join(hosts, ["host", "suffix"], "left").join(said, "declared", "left")
        logs = F.zip_with(F.zip_with("ll", "prior", lambda a, p: a + F.log(p)), "fit", lambda a, p: a + F.log(p))
        out = out.withColumn("logs", logs).withColumn("hi", F.array_max("logs"))
        norm = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("hi")))
        out = out.withColumn("posterior", F.when(F.col("grams") > 0, 1.0 / norm).otherwise(F.lit(0.0)))
        language = F.when(F.col("grams") > 0, F.get(names, _first_max(F.col("logs")).cast("int")))
        return checkpointed(out.select(
            "doc_id", "_th", language.alias("language"), "posterior", F.get(names, F.col("top").cast("int")).alias("text_language"),
            ((F.col("grams") > 0) & (F.col("posterior") >= min_posterior)).alias("accepted")))


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, declared, host, suffix of the first page whose address names the document."""
    host = url_host(F.col("url"))
    number = F.regexp_extract(url_path(F.col("url")), r"/(\d{1,18})(?:\.\w+|/)?$", 1)
    seen = pages.select(
        F.when(number != "", number.cast("long")).alias("doc_id"),
        F.struct("page_id", F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z-]+)", 1).alias("declared"),
                 host.alias("host"), address_suffix(host).alias("suffix")).alias("p")).filter(F.col("doc_id").isNotNull())
    return seen.groupBy("doc_id").agg(F.min("p").alias("p")).select("doc_id", "p.declared", "p.host", "p.suffix")


def document_languages(docs: DataFrame, pages: DataFrame, train_rows: int = 20_000) -> DataFrame:
    """Languages of documents, with the markup and address of the pages they came from and else their source as host."""
    model = train_text_model(docs.select("doc_id", "text", "lang"), train_rows)
    return identify(docs.select("doc_id", "text", F.col("source").alias("host")), model, page_evidence(pages))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = document_languages(docs, pages)
    return out.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "accepted")
