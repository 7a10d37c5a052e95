"""Vector search: exact nearest neighbours by cosine, k-means lists, similar documents, recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skerry.operators.chunking import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; null for an all-zero vector, so that a failed embedding is never scored."""
    return bind(F.sqrt(dot(a, a)), lambda n: F.nullif(n, F.lit(0.0)))


def unit(a: Column) -> Column:
    # bound: a length named in the lambda would be computed again for each component
    return bind(norm(a), lambda n: F.when(n.isNotNull(), F.transform(a, lambda x: x.cast("double") / n)))


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows as one matrix of unit vectors, which of them are usable): those of the commonest length with finite components and a length
    above zero; the others are zeros."""
    lists = column.combine_chunks()
    lens = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    width = int(np.bincount(lens).argmax()) if len(lens) else 0
    good = (lens == width) & (width > 0)
    flat = np.asarray(lists.filter(pa.array(good)).flatten().cast(pa.float64()).fill_null(float("nan")))
    some = flat.reshape(-1, width) if width else np.zeros((0, 0))
    length = np.sqrt((some * some).sum(1))
    fine = np.isfinite(length) & (length > 0)
    out = np.zeros((len(lens), width))
    at = np.flatnonzero(good)[fine]
    out[at] = some[fine] / length[fine, None]
    good = np.zeros(len(lens), bool)
    good[at] = True
    return out, good


def _equal(left: pa.Table, right: pa.Table, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """([query, row] equal, [query, row] neither null) of a column of the queries (right) and one of the rows (left)."""
    a, b = left[names[0]].to_pandas(), right[names[1]].to_pandas()
    codes = pd.factorize(pd.concat([a, b], ignore_index=True))[0]
    x, q = codes[:len(a)], codes[len(a):]
    return q[:, None] == x[None, :], (q[:, None] >= 0) & (x[None, :] >= 0)


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k scores, ties by ``order``, with all others that rounding to 6 digits could bring to the same value as the k-th;
    of equal scores k are enough."""
    live = np.flatnonzero(scores > -2)
    if len(live) > k:
        floor = np.partition(scores[live], len(live) - k)[len(live) - k]
        live = live[scores[live] >= floor - 2e-6]
    live = live[np.lexsort((order[live], -scores[live]))]
    values = scores[live]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], values[1:] != values[:-1]]), np.arange(len(values)), 0)) if len(values) else live
    return live[np.arange(len(values)) - first < k]


def _block_top(left: pa.Table, right: pa.Table, k: int, key: str, differ: dict[str, str], same: dict[str, str], at_once: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, row places, similarities) of the best rows of a block for each query: matrix products of ``at_once`` queries, so that
    a task holds the scores of those alone."""
    x, x_good = _rows(left["embedding"])
    q, q_good = _rows(right["query_vector"])
    none = np.zeros(0, np.int64)
    if not x.size or not q.size or x.shape[1] != q.shape[1]:
        return none, none, np.zeros(0)
    order = np.argsort(np.argsort(left[key].to_pandas().to_numpy(), kind="stable"), kind="stable")
    out = [(none, none, np.zeros(0))]
    for lo in range(0, len(q), at_once):
        some = slice(lo, lo + at_once)
        scores = q[some] @ x.T
        scores[~q_good[some]] = -9.0
        scores[:, ~x_good] = -9.0
        for names, wanted in [(n, False) for n in differ.items()] + [(n, True) for n in same.items()]:
            equal, known = _equal(left, right.slice(lo, at_once), names)
            scores[~known | (equal != wanted)] = -9.0
        found = [_best(row, order, k) for row in scores]
        places = np.repeat(np.arange(len(found)), [len(f) for f in found])
        rows = np.concatenate(found)
        out.append((places + lo, rows, scores[places, rows]))
    return tuple(map(np.concatenate, zip(*out)))


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, key: str = "chunk_id",
              differ: dict[str, str] | None = None, query_keys: tuple[str, ...] = ("query_id",), keep: tuple[str, ...] = (), scope: DataFrame | None = None,
              same: dict[str, str] | None = None, block_rows: int = 16_384, block_queries: int = 2048) -> DataFrame:
    """Top k rows for each query by cosine similarity, ranked; similarity is rounded to 6 digits, ties go to the smaller key.

    Vectors and queries are dealt into blocks of bounded size; each pair of blocks is one matrix product in one task, which passes on the
    best k rows of each query. Vectors are exchanged once for every ``block_queries`` queries, queries once for every block of vectors.
    ``differ`` and ``same`` name columns of the vectors and of the queries that must not, or must, be equal (nulls: the pair is left out).
    Vectors with null or non-finite components, of no length, or of another width than the queries are never returned. With a ``scope``
    (query_id, document_id), only pairs that it names are scored, by equi-joins. For very large batches of queries use quantised_knn."""
    differ, same = differ or {}, same or {}
    if scope is not None:
        v = vectors.filter(F.col("embedding").isNotNull()).withColumn("_n", norm(F.col("embedding")))
        pairs = v.join(scope.select("query_id", "document_id"), "document_id").join(queries.withColumn("_qn", norm(F.col("query_vector"))), "query_id")
        for names, wanted in [(n, False) for n in differ.items()] + [(n, True) for n in same.items()]:
            pairs = pairs.filter((F.col(names[0]) == F.col(names[1])) == wanted)
        cos = F.round(dot(F.col("embedding"), F.col("query_vector")) / (F.col("_n") * F.col("_qn")), 6)
        scored = pairs.select(*query_keys, key, *keep, cos.alias("similarity")).filter(F.col("similarity").isNotNull())
    else:
        v = vectors.filter(F.col("embedding").isNotNull()).select(*dict.fromkeys([key, *keep, *differ, *same]), "embedding")
        q = queries.filter(F.col("query_vector").isNotNull()).select(*dict.fromkeys([*query_keys, *differ.values(), *same.values()]), "query_vector")
        rows, asked = max(1, -(-v.count() // block_rows)), max(1, -(-q.count() // block_queries))
        deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
        left = v.withColumn("_b", deal(rows)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
        right = q.withColumn("_q", deal(asked)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        kinds = StructType([*[q.schema[c] for c in query_keys], *[v.schema[c] for c in (key, *keep)]]).add("similarity", "double")

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return pa.table([pa.array([], f.type) for f in to_arrow_schema(kinds)], schema=to_arrow_schema(kinds))
            places, at, similarity = _block_top(a, b, k, key, differ, same)
            return pa.table({**{c: b[c].take(pa.array(places)) for c in query_keys}, **{c: a[c].take(pa.array(at)) for c in (key, *keep)}, "similarity": similarity})

        found = left.groupBy("_b", "_q").cogroup(right.groupBy("_b", "_q")).applyInArrow(search, kinds)
        scored = found.withColumn("similarity", F.round("similarity", 6))
    w = Window.partitionBy(*query_keys).orderBy(F.desc("similarity"), key)
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top if threshold is None else top.filter(F.col("similarity") > threshold)  # the order is that of the score: cut, then filter


def similar_documents(vectors: DataFrame, sources: DataFrame, k: int = 5, sample: int = 3) -> DataFrame:
    """For each source document: its first ``sample`` embedded chunks each draw 3k chunks of other documents (of the same owner, if the
    table has an ``owner`` column); the best score for each document counts."""
    own = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    has_owner = "owner" in vectors.columns
    first = vectors.filter(F.col("embedding").isNotNull()).join(sources.select("document_id").distinct(), "document_id", "left_semi")
    first = first.withColumn("_i", F.row_number().over(own)).filter(F.col("_i") <= sample).select(
        F.col("document_id").alias("source_id"), F.col("_i").alias("sample_no"), F.col("embedding").alias("query_vector"),
        *([F.col("owner").alias("_owner")] if has_owner else []))
    pool = exact_knn(vectors, first, 3 * k, differ={"document_id": "source_id"}, same={"owner": "_owner"} if has_owner else None,
                     query_keys=("source_id", "sample_no"), keep=("document_id",))
    best = pool.groupBy("source_id", "document_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "document_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def build_ivf(vectors: DataFrame, lists: int = 100, train_rows: int = 100_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(centroids, vectors with list_id): k-means on unit vectors of a bounded sample, every vector is assigned."""
    units = vectors.filter(norm(F.col("embedding")).isNotNull()).withColumn("_u", unit(F.col("embedding"))).withColumn("_f", array_to_vector("_u"))
    rows = units.count()
    share = max(1, rows // train_rows)
    train = units.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0) if share > 1 else units
    model = KMeans(k=min(lists, max(2, rows)), featuresCol="_f", predictionCol="list_id", seed=seed, maxIter=8).fit(train.select("_f"))
    centroids = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")
    return centroids, model.transform(units).drop("_u", "_f")


def knn_recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """(query_id, recall): share of the exact neighbours that the approximate search found."""
    found = approx.select("query_id", "chunk_id").withColumn("_hit", F.lit(1))
    return exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.round(F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1)), 6).alias("recall"))
