"""Embedding pipeline: vectors for chunks that lack one, progress, costs, document state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import prepare_for_embedding, word_count

WIDTH = 384
#: Notional price of 1000 tokens.
RATE = 0.00002
Encoder = Callable[[list[str]], np.ndarray]


def embed_chunks(chunks: DataFrame, encoder: Encoder | None = None, width: int = WIDTH, batch: int = 100) -> DataFrame:
    """(chunk_id, content) -> (chunk_id, embedding array<float>, embed_ok): unit vectors of the cleaned text.

    The default is a hashed bag of words, all in the JVM; a neural model comes in as ``encoder``, a function from texts to rows
    that is loaded once in each worker. Texts without words get a zero vector and are flagged, as are batches that fail."""
    clean = chunks.select("chunk_id", prepare_for_embedding(F.coalesce("content", F.lit(""))).alias("content"))
    if encoder is not None:
        return clean.mapInArrow(lambda it: zero_vector_fallback(it, encoder, width, batch), "chunk_id long, embedding array<float>, embed_ok boolean")
    words = Tokenizer(inputCol="content", outputCol="_w").transform(clean)
    counts = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=width).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_v").transform(counts)
    empty = F.col("content") == ""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    return unit.select("chunk_id", F.when(empty, zeros).otherwise(vector_to_array("_v", "float32")).alias("embedding"), (~empty).alias("embed_ok"))


def zero_vector_fallback(batches: Iterator[pa.RecordBatch], encoder: Encoder, width: int, batch: int = 100, attempts: int = 3) -> Iterator[pa.RecordBatch]:
    """Encode in small batches; a batch that fails is tried row by row, up to ``attempts`` times each; what still fails is a flagged zero vector."""
    def units(texts: list[str]) -> list[np.ndarray]:
        rows = np.asarray(encoder(texts), np.float32)
        if rows.shape != (len(texts), width):
            raise ValueError(f"the encoder returned {rows.shape}")
        return list(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12))

    def one(text: str) -> np.ndarray | None:
        for _ in range(attempts):
            try:
                return units([text])[0]
            except Exception:  # noqa: BLE001  whatever the model raises, the row is flagged
                continue
        return None

    for b in batches:
        texts = b.column("content").to_pylist()
        done: list[np.ndarray | None] = []
        for i in range(0, len(texts), batch):
            try:
                done += units(texts[i:i + batch])
            except Exception:  # noqa: BLE001
                done += [one(t) for t in texts[i:i + batch]]
        ok = [v is not None for v in done]
        rows = [(v if v is not None else np.zeros(width, np.float32)).tolist() for v in done]
        yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(rows, pa.list_(pa.float32())), pa.array(ok)], names=["chunk_id", "embedding", "embed_ok"])


def without_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector, in no order."""
    return chunks.join(vectors.filter("embedding is not null").select("chunk_id"), "chunk_id", "left_anti")


def pending_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector, in document and index order."""
    return without_vectors(chunks, vectors).orderBy("document_id", "chunk_index")


def upsert_embeddings(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest update of each chunk wins over the stored vector; of equal times the row whose hash is smaller."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("embedding_generated_at"), F.xxhash64(*updates.columns))
    new = updates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    cols = [c for c in vectors.columns if c != "chunk_id"]
    joined = vectors.alias("o").join(new.alias("n"), "chunk_id", "full")
    return joined.select("chunk_id", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in cols])


def embedding_progress(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(document_id, total, embedded, pending, percent): the percentage is rounded half to even, 0 without chunks."""
    done = vectors.filter("embedding is not null").select("chunk_id", F.lit(1).alias("_e"))
    out = chunks.join(done, "chunk_id", "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.count("_e").alias("embedded"))
    return out.withColumn("pending", F.col("total") - F.col("embedded")).withColumn(
        "percent", F.bround(F.when(F.col("total") > 0, 100.0 * F.col("embedded") / F.col("total")).otherwise(0.0), 0).cast("int"))


def embedding_cost_estimate(chunks: DataFrame) -> DataFrame:
    out = chunks.groupBy("document_id").agg(F.sum(word_count(F.col("content"))).alias("total_tokens"), F.count(F.lit(1)).alias("chunk_count"))
    return out.withColumn("cost_usd", F.lit(0).cast("decimal(12,8)"))


def embedding_cost_rows(estimates: DataFrame, model: str, rate: float = RATE) -> DataFrame:
    """One notional cost row for each finished document."""
    per_token = F.lit(Decimal(repr(rate)) / 1000).cast("decimal(12,10)")
    cost = (F.col("total_tokens").cast("decimal(12,0)") * per_token).cast("decimal(12,8)")
    return estimates.select("document_id", F.col("total_tokens").alias("token_count"), "chunk_count", F.lit(model).alias("model_name"), cost.alias("cost_usd"))


def advance_status(documents: DataFrame, progress: DataFrame) -> DataFrame:
    """A ready document all of whose chunks have vectors becomes indexed; documents without chunks are skipped."""
    p = progress.select("document_id", F.col("total").alias("_t"), F.col("pending").alias("_p"))
    done = (F.col("status") == "ready") & (F.coalesce("_t", F.lit(0)) > 0) & (F.col("_p") == 0)
    return documents.join(p, "document_id", "left").withColumns({
        "embedding_status": F.when(done, "complete").when((F.col("status") == "ready") & (F.coalesce("_t", F.lit(0)) == 0), "skipped").otherwise(F.col("embedding_status")),
        "status": F.when(done, "indexed").otherwise(F.col("status"))}).drop("_t", "_p")
