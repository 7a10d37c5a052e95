"""Exact top-k by integer inner product with MaxScore pruning.

Terms are the vectors' dimensions. Rows are dealt into shards of bounded size, queries into blocks; each (shard, block) pair
is one group. A shard keeps a posting list for each term, with bounds. With a score that the query's k-th best row is known to
reach, the terms of smallest bound that cannot reach it together are non-essential: only the essential terms' lists are
traversed for all rows, the others are probed, in steps of falling bound, for the rows that still compete.

A floor is known from the start: after the lists of the best-bounded quarter of the terms, a shard scores the few rows that lead
by then in full, and the k-th best of these is the floor for the rest of the traversal.

Shards are searched in rounds, each with ``growth`` times the rows of all before it; after a round the shards' results are
merged, and the k-th best score of each query is the floor of the next round. Shards return only rows that reach the floor,
so a round passes on about ``growth`` times k rows for each query, however many shards there are.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, neither as queries nor as
candidates; shorter vectors count as padded with zeros; equal scores go to the smaller id; repeated rows are separate
candidates, and a query skips all rows of its own id; repeated query rows are one query, and different vectors of one query
id are separate queries with ranks of their own; an empty table gives no rows; extra columns are ignored. Components are
scaled and floored to 64-bit integers; products are exact as long as the scores stay below 2**63.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, checkpointed, table

EXACT_FLOAT = 2**52
#: Rows are dealt to rounds and shards by a hash below this.
PLACES = 1 << 30


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


class Postings:
    """The posting lists of a shard: for each term the rows that hold it, with their values, and the extremes over all rows. A list of more
    than half of the rows is kept as a column of all of them, as adding a row's zero costs less than its number."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.columns, self.lists = np.ascontiguousarray(self.x.T), []
        for column in self.columns:
            rows = np.flatnonzero(column)
            self.lists.append((slice(None), column) if 2 * len(rows) > len(ids) else (rows, column[rows]))
        self.low, self.high = (f(0) if len(ids) else np.zeros(x.shape[1]) for f in (self.x.min, self.x.max))
        self.norms = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))
        self.longest = float(self.norms.max(initial=0.0))


def maxscore(own: int, q: np.ndarray, floor: float, p: Postings, k: int, step: int = 4, leaders: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
    """The best k rows (not of the query's own id) with a score of at least ``floor``: (ids, scores, number of products).

    A term's bound is the greatest product that the shard's values allow. What terms can add together is at most the sum of
    their bounds, and (by Cauchy and Schwarz) at most the norm of the query's rest times the row's norm. ``leaders`` times k
    rows with the highest scores in the first quarter of the terms raise the floor, which only drops rows below k others."""
    bounds = np.maximum(q * p.low, q * p.high).astype(np.float64)
    terms = np.argsort(-bounds, kind="stable")
    rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0.0)
    tail = np.sqrt(np.append(np.cumsum((q[terms].astype(np.float64) ** 2)[::-1])[::-1], 0.0))
    slack = 1e-9 * (1.0 + float(np.abs(q).sum()) * max(abs(float(p.low.min(initial=0))), abs(float(p.high.max(initial=0)))))
    scores, products, at = np.zeros(len(p.ids), p.x.dtype), 0, 0

    def essential(floor: float) -> int:
        # what follows is non-essential: a row cannot reach the floor by it alone
        reach = np.minimum(rest, tail * p.longest) + slack >= floor
        return min(int(np.flatnonzero(reach)[-1]) + 1 if reach.any() else 0, len(terms))

    def traverse(upto: int) -> None:
        nonlocal products, at
        for t in terms[at:upto]:
            rows, values = p.lists[t]
            scores[rows] += q[t] * values
            products += len(values)
        at = max(at, upto)

    others = np.flatnonzero(p.ids != own)
    lead = -(-len(terms) // 4)
    if floor == -np.inf and len(others) > leaders * k:
        traverse(lead)
        first = others[np.argpartition(-scores[others], leaders * k)[:leaders * k]]
        full = scores[first] + p.x[first[:, None], terms[lead:]] @ q[terms[lead:]]
        products += len(first) * (len(terms) - lead)
        floor = max(floor, float(np.partition(full, len(full) - k)[len(full) - k]))
    traverse(essential(floor))
    live = np.flatnonzero(scores + np.minimum(rest[at], tail[at] * p.norms) + slack >= floor)
    scores = scores[live]
    while at < len(terms) and len(live):  # probe the next terms of the rows that still compete
        some = terms[at:at + step]
        scores = scores + sum(q[t] * p.columns[t][live] for t in some)
        products += len(live) * len(some)
        at += len(some)
        stay = scores + np.minimum(rest[at], tail[at] * p.norms[live]) + slack >= floor
        live, scores = live[stay], scores[stay]
    good = (p.ids[live] != own) & (scores >= floor)
    ids, scores = p.ids[live[good]], scores[good].astype(np.int64)
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best], products


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """float64 while all sums of products are exact in it."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    return np.float64 if bound < EXACT_FLOAT else np.int64


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, shard_rows: int = 4096, block_rows: int = 2048, growth: int = 16) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score (all long but the rank, an int); checkpointed."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            width = max(left["v"].map(len).max(), right["v"].map(len).max())
            x, q = _matrix(left["v"], width), _matrix(right["v"], width)
            kind = exact_type(q, x)
            postings, q = Postings(left["vec_id"].to_numpy(), x.astype(kind)), q.astype(kind)
            for no, own, floor, v in zip(right["query_no"], right["vec_id"], right["floor"].fillna(-np.inf), q):
                ids, scores, _ = maxscore(own, v, floor, postings, k)
                out.append((np.full(len(ids), no), ids, scores))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_no", "vec_id", "score"), columns)))

    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    with Scratch(spark, "maxscore") as scratch:
        place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(PLACES))
        rows = scratch.write(clean(vectors).withColumn("place", place), "rows")
        asked = scratch.write(clean(queries).distinct().withColumn("query_no", F.monotonically_increasing_id()), "asked")
        n, blocks = rows.count(), max(1, -(-asked.count() // block_rows))
        found, done, size, turn = None, 0, shard_rows, 0
        while done < PLACES:
            upto = PLACES if size >= n else PLACES * size // n
            part = rows.filter((F.col("place") >= done) & (F.col("place") < upto))
            shards = max(1, -(-n * (upto - done) // (PLACES * shard_rows)))
            floors = asked.withColumn("floor", F.lit(None).cast("double"))
            if found is not None:  # the k-th best score so far: what a row has to reach
                last = found.filter(F.col("rank") == k).select("query_no", F.col("score").cast("double").alias("floor"))
                floors = asked.join(last, "query_no", "left")
            left = part.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            right = floors.withColumn("block", F.pmod(F.xxhash64("query_no"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
            tasks = max(shards * blocks, 1)
            new = left.repartition(tasks, "shard", "block").groupBy("shard", "block").cogroup(right.repartition(tasks, "shard", "block").groupBy("shard", "block")).applyInPandas(
                search, "query_no long, vec_id long, score long")
            every = new if found is None else new.unionByName(found.drop("rank"))
            found = scratch.write(every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), f"found{turn}")
            done, size, turn = upto, size * growth, turn + 1
        return checkpointed(found.join(asked.select("query_no", F.col("vec_id").alias("query_id")), "query_no").select("query_id", "rank", "vec_id", "score"))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20
"""
