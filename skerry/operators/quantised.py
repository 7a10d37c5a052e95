"""Approximate nearest neighbours: inverted lists of product-quantised codes, distance tables, exact re-ranking.

Lists are k-means cells; in a list a vector is a code of ``subspaces`` bytes, the numbers of the nearest centres of its parts. Codes
lie in a folder for each list, so that a search reads the folders of the lists that its queries probe. A task holds one part of a
list and the queries that probe it; a query's score for a code is a sum of table entries (query part times centre). The best
``rerank`` codes of each query are looked up as vectors and scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.vectors import build_ivf, dot, norm, unit

#: Codes of one part of a list, if all lists were of equal size.
PART_ROWS = 16_384


@dataclass
class QuantisedIndex:
    """centroids (list_id, centroid); codes at ``path`` (chunk_id, code) in folders by list_id; books [subspace, code, component]."""

    path: str
    centroids: DataFrame
    books: np.ndarray
    parts: int
    rows: int

    def codes(self, lists: list[int] | None = None) -> DataFrame:
        out = self.centroids.sparkSession.read.schema("chunk_id long, code binary, list_id int").parquet(self.path)
        return out if lists is None else out.filter(F.col("list_id").isin(lists))


def _centres(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means of a bounded sample; a centre without rows takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    out = rows[rng.choice(len(rows), k, replace=len(rows) < k)]
    for _ in range(rounds):
        far = ((rows[:, None, :] - out[None]) ** 2).sum(2) if len(rows) * k < 1 << 22 else (rows ** 2).sum(1)[:, None] - 2 * rows @ out.T + (out ** 2).sum(1)
        near = far.argmin(1)
        sums, n = np.zeros_like(out), np.bincount(near, minlength=k)
        np.add.at(sums, near, rows)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
        lost = np.flatnonzero(n == 0)
        out[lost] = rows[np.argsort(-far[np.arange(len(rows)), near], kind="stable")[:len(lost)]] if len(lost) <= len(rows) else out[lost]
    return out


def _books(units: DataFrame, width: int, subspaces: int, codes: int, seed: int) -> np.ndarray:
    """The centres of each subspace, trained side by side; ``units`` is a bounded sample."""
    size = width // subspaces
    parts = units.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda s: F.slice("_u", s * size + 1, size))).alias("s", "x"))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.argsort([hash(tuple(x)) for x in rows["x"]], kind="stable")]  # whatever order they came in
        found = _centres(np.array(rows["x"].tolist(), float), codes, seed)
        return pd.DataFrame({"s": int(rows["s"].iloc[0]), "c": np.arange(codes), "x": found.tolist()})

    out = np.zeros((subspaces, codes, size))
    for r in parts.groupBy("s").applyInPandas(train, "s int, c int, x array<double>").collect():  # subspaces x codes rows, whatever the input
        out[r.s, r.c] = r.x
    return out


def build_quantised(vectors: DataFrame, path: str, lists: int = 100, subspaces: int = 16, codes: int = 256, train_rows: int = 20_000, seed: int = 7) -> QuantisedIndex:
    """vectors (chunk_id, embedding of one width, a multiple of ``subspaces``) -> an index at ``path``. Centres are fitted on about
    ``train_rows`` rows, taken by a hash of the id; every vector is in the index, but those that are null or of no length."""
    if not 2 <= codes <= 256:
        raise ValueError("a code has 2 to 256 values")
    centroids, assigned = build_ivf(vectors, lists, train_rows, seed)
    units = assigned.select("chunk_id", "list_id", unit(F.col("embedding")).alias("_u"))
    rows, width = assigned.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if width % subspaces:
        raise ValueError(f"{width} components cannot be cut into {subspaces} equal parts")
    share = max(1, rows // train_rows)
    books = _books(units.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0), width, subspaces, codes, seed)

    def encode(batches):
        for b in batches:
            x = np.array(b.column("_u").to_pylist(), float).reshape(-1, subspaces, width // subspaces)
            near = np.stack([((books[s] ** 2).sum(1) - 2 * x[:, s] @ books[s].T).argmin(1) for s in range(subspaces)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array([r.tobytes() for r in near], pa.binary()), b.column("list_id")], names=["chunk_id", "code", "list_id"])

    coded = units.mapInArrow(encode, "chunk_id long, code binary, list_id int")
    coded.write.partitionBy("list_id").parquet(path)
    return QuantisedIndex(path, centroids, books, max(1, -(-rows // (lists * PART_ROWS))), rows)


def probes(index: QuantisedIndex, queries: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, query_vector) -> with list_id, once for each of the nprobe nearest lists."""
    near = queries.crossJoin(F.broadcast(index.centroids)).withColumn("_s", dot(F.col("query_vector"), F.col("centroid")) / norm(F.col("centroid")))  # one row for each list
    w = Window.partitionBy("query_id").orderBy(F.desc("_s"), "list_id")
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= nprobe).select("query_id", "query_vector", "list_id")


def candidates(index: QuantisedIndex, probed: DataFrame, rerank: int) -> DataFrame:
    """(query_id, chunk_id, approximate): the best ``rerank`` codes of each query by table sums. Only folders of probed lists are read."""
    wanted = [r[0] for r in probed.select("list_id").distinct().collect()]  # at most the number of lists
    books = index.books

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(left), -1)
            ids = left["chunk_id"].to_numpy()
            for own, v in zip(right["query_id"].to_pylist(), right["query_vector"].to_pylist()):
                table = np.einsum("scd,sd->sc", books, np.array(v, float).reshape(len(books), -1))
                total = sum(table[s][codes[:, s]] for s in range(len(books)))
                total[ids == own] = -np.inf
                best = np.argpartition(-total, rerank - 1)[:rerank] if len(total) > rerank else np.arange(len(total))
                best = best[total[best] > -np.inf]
                found.append((np.full(len(best), own, np.int64), ids[best], total[best]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "chunk_id", "approximate"), cols)))

    codes = index.codes(wanted).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(index.parts)).cast("int"))
    asked = probed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))))
    every = codes.groupBy("list_id", "part").cogroup(asked.groupBy("list_id", "part")).applyInArrow(score, "query_id long, chunk_id long, approximate double")
    w = Window.partitionBy("query_id").orderBy(F.desc("approximate"), "chunk_id")
    return every.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= rerank).drop("_r")


def quantised_knn(index: QuantisedIndex, vectors: DataFrame, queries: DataFrame, nprobe: int = 10, k: int = 10, rerank: int = 100) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): the best k of the re-ranked candidates by exact cosine, of the query's own id none."""
    some = candidates(index, probes(index, queries, nprobe), rerank).join(vectors.select("chunk_id", "embedding"), "chunk_id")
    some = some.join(queries.withColumn("_qn", norm(F.col("query_vector"))), "query_id")
    cos = F.round(dot(F.col("embedding"), F.col("query_vector")) / (norm(F.col("embedding")) * F.col("_qn")), 6)
    top = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return some.select("query_id", "chunk_id", cos.alias("similarity")).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def scan_shares(index: QuantisedIndex, queries: DataFrame, nprobe: int, rerank: int) -> DataFrame:
    """(query_id, code_share, exact_share): of all rows, those whose codes a query meets, and those that are scored exactly."""
    sizes = index.codes().groupBy("list_id").agg(F.count(F.lit(1)).alias("_n"))
    met = probes(index, queries, nprobe).join(sizes, "list_id").groupBy("query_id").agg(F.sum("_n").alias("_n"))
    return met.select("query_id", F.round(F.col("_n") / index.rows, 6).alias("code_share"), F.round(F.least(F.col("_n"), F.lit(rerank)) / index.rows, 6).alias("exact_share"))
