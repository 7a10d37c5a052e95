"""Nearest neighbours by blocks against all pairs, ties and odd vectors."""

import numpy as np
import pytest

from skerry.operators import quantised, vectors

ROWS, QUERIES = "chunk_id long, document_id long, owner string, embedding array<float>", "query_id long, asker string, query_vector array<float>"


def brute(rows, queries, k, differ=False, same=False, threshold=None):
    out = []
    for q, asker, qv in queries:
        scored = []
        for c, _, owner, v in rows:
            if v is None or qv is None or len(v) != len(qv) or any(x is None or not np.isfinite(x) for x in [*v, *qv]) or (differ and c == q) or (same and (owner is None or owner != asker)):
                continue
            a, b = np.array(v, np.float32).astype(float), np.array(qv, np.float32).astype(float)
            if np.linalg.norm(a) and np.linalg.norm(b):
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0, c))
        out += [(q, c, pytest.approx(-s, abs=1.5e-6), i) for i, (s, c) in enumerate(sorted(scored)[:k], 1) if threshold is None or -s > threshold]
    return out


def got(df):
    return [(r.query_id, r.chunk_id, r.similarity, r.rank) for r in df.orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i // 3, f"u{i % 4}" if i % 9 else None, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, 90, "u1", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(300, 91, "u2", [2.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(400, 92, "u1", None), (401, 92, "u1", []), (402, 92, "u1", [0.0] * 6), (403, 92, "u1", [1.0, 2.0]), (404, 92, "u1", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (405, 92, "u1", [float("nan")] * 6), (406, 92, "u1", [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    queries = [(i, f"u{i % 4}", rows[i][3]) for i in range(0, 120, 10)] + [(200, "u1", [3.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (900, None, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (901, "u1", None), (902, "u1", [0.0] * 6)]
    return rows, queries, spark.createDataFrame(rows, ROWS), spark.createDataFrame(queries, QUERIES)


@pytest.mark.parametrize("block_rows,block_queries", [(16_384, 2048), (25, 2048), (60, 5)])
def test_blocks_find_what_all_pairs_give(data, block_rows, block_queries):
    rows, queries, v, q = data
    sized = {"block_rows": block_rows, "block_queries": block_queries}
    assert got(vectors.exact_knn(v, q, 7, differ={"chunk_id": "query_id"}, **sized)) == brute(rows, queries, 7, differ=True)
    assert got(vectors.exact_knn(v, q, 7, 0.2, same={"owner": "asker"}, **sized)) == brute(rows, queries, 7, same=True, threshold=0.2)


def test_empty_sides(spark, data):
    _, _, v, q = data
    assert vectors.exact_knn(v, q.filter("false"), 3).count() == 0 and vectors.exact_knn(v.filter("false"), q, 3).count() == 0


def test_no_pair_is_joined_row_by_row(data, capsys):
    _, _, v, q = data
    vectors.exact_knn(v, q, 3, differ={"chunk_id": "query_id"}).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, i // 3, "u", (centres[0 if i % 3 == 0 else i % 12] + 0.25 * rng.normal(size=16)).tolist()) for i in range(1500)]  # a third of all in one place
    rows += [(9000, 1, "u", None), (9001, 1, "u", [0.0] * 16)]
    v = spark.createDataFrame(rows, ROWS)
    q = v.filter("chunk_id % 50 = 0 and chunk_id < 1500").selectExpr("chunk_id as query_id", "embedding as query_vector")
    return v, q, quantised.build_quantised(v, f"file://{tmp_path_factory.mktemp('q')}/codes", lists=12, subspaces=8, codes=64, train_rows=700)


def test_few_lists_are_enough_where_vectors_have_clusters(clustered):
    v, q, index = clustered
    exact = vectors.exact_knn(v, q, 10, differ={"chunk_id": "query_id"})
    found = quantised.quantised_knn(index, v, q, nprobe=2, k=10, rerank=120)
    recall = [r.recall for r in vectors.knn_recall(exact, found).collect()]
    shares = quantised.scan_shares(index, q, 2, 120).collect()
    assert len(recall) == 30 and np.mean(recall) >= 0.9
    assert np.mean([r.code_share for r in shares]) < 0.35 and max(r.exact_share for r in shares) < 0.09
    same = {(r.query_id, r.chunk_id): r.similarity for r in exact.collect()}
    assert all(same[key] == r.similarity for r in found.collect() if (key := (r.query_id, r.chunk_id)) in same)


def test_every_vector_is_in_the_index_and_parts_change_nothing(clustered):
    v, q, index = clustered
    assert index.codes().count() == 1500 == index.rows and index.codes().select("chunk_id").distinct().count() == 1500
    whole = quantised.quantised_knn(index, v, q, nprobe=12, k=5, rerank=60)
    cut = quantised.quantised_knn(quantised.QuantisedIndex(index.path, index.centroids, index.books, 7, index.rows), v, q, nprobe=12, k=5, rerank=60)
    assert got(whole) == got(cut) and not [r for r in whole.collect() if r.query_id == r.chunk_id]


def test_folders_of_other_lists_are_not_read(spark, clustered):
    v, q, index = clustered
    one = q.limit(1)
    lists = {r.list_id for r in quantised.probes(index, one, 2).collect()}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = quantised.candidates(index, quantised.probes(index, one, 2), 20)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = [x for x in plan.split("\n") if "FileScan parquet" in x and "code" in x]
    assert len(lists) == 2 and len(scan) == 1 and "list_id" in scan[0].split("PartitionFilters: [")[1].split("]")[0]


def test_vectors_that_cannot_be_cut_are_refused(spark, data, tmp_path):
    with pytest.raises(ValueError, match="equal parts"):
        quantised.build_quantised(spark.createDataFrame([(i, 0, "u", [1.0, 2.0, float(i)]) for i in range(9)], ROWS), f"file://{tmp_path}/c", lists=2, subspaces=2)


def test_a_block_holds_the_scores_of_few_queries():
    """A full pair of blocks: 2,048 queries by 16,384 rows would be 268 MB of scores at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from skerry.operators import vectors

    rng = np.random.default_rng(3)
    rows = lambda n: pa.FixedSizeListArray.from_arrays(pa.array(rng.standard_normal(n * 8)), 8).cast(pa.list_(pa.float64()))
    left = pa.table({"chunk_id": pa.array(np.arange(16_384)), "embedding": rows(16_384)})
    right = pa.table({"query_id": pa.array(np.arange(2048) * 8), "query_vector": rows(2048)})
    tracemalloc.start()
    got = vectors._block_top(left, right, 5, "chunk_id", {"chunk_id": "query_id"}, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    x, q = (np.array(t.to_pylist()) for t in (left["embedding"], right["query_vector"]))
    cos = (q[:300] / np.linalg.norm(q[:300], axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    cos[np.arange(300), np.arange(300) * 8] = -9
    places, at, _ = got
    for i in range(0, 300, 7):
        assert at[places == i][:5].tolist() == np.argsort(-cos[i], kind="stable")[:5].tolist()


def test_a_length_is_computed_once_for_each_vector(spark):
    """Not again for each component of the unit vector, which took the square of the width."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [0.0, -2.0])], "i int, a array<float>").repartition(1)
    out = rows.select("i", vectors.unit(F.col("a")).alias("u"), vectors.norm(F.col("a")).alias("n"))
    assert rows.select(vectors.unit(F.col("a")).alias("u"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert {r.i: (r.u, r.n) for r in out.collect()} == {0: ([0.6, 0.8], 5.0), 1: (None, None), 2: (None, None), 3: ([0.0, -1.0], 2.0)}
