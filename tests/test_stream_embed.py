"""Chunks that lack a vector are embedded where they are, without an order of all of them."""

from skerry.sources.versioned import VersionedTable
from skerry.streaming import jobs


def test_pending_chunks_are_not_sorted(spark, tmp_path, monkeypatch):
    plans, embed = [], jobs.embed_chunks

    def spy(chunks, encoder):
        plans.append(chunks._jdf.queryExecution().optimizedPlan().toString())
        return embed(chunks, encoder)

    monkeypatch.setattr(jobs, "embed_chunks", spy)
    schema = "chunk_id long, document_id long, chunk_index int, content string"
    source, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for ids in ((3, 1, 2), (2, 5, 4)):
        spark.createDataFrame([(i, 1, i, f"word {i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_embed(spark, source, schema, sink, f"file://{tmp_path}/state").awaitTermination()
    assert len(plans) == 2 and "LeftAnti" in plans[1] and "Sort [" not in plans[1]
    assert sorted(r.chunk_id for r in VersionedTable(spark, sink, keys=("chunk_id",)).read().collect()) == [1, 2, 3, 4, 5]
