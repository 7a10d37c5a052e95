"""Versioned tables: replacement by key, replays, cut-off commits, merges; and the streams that write them."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skerry.functions.text import clean_documents
from skerry.operators.chunking import ChunkingConfig, chunk_documents
from skerry.sources import uploads, versioned
from skerry.sources.shared import shared_folder
from skerry.sources.versioned import ConcurrentCommit, VersionedTable
from skerry.streaming import jobs

ROWS = "document_id long, line int, text string"


def rows(spark, docs):
    """{document: [lines]}"""
    return spark.createDataFrame([(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], ROWS)


def held(table, version=None):
    out = {}
    for r in sorted(table.read(version).collect()):
        out.setdefault(r.document_id, []).append(r.text)
    return out


def test_newest_rows_of_each_document(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", fanout=3)
    with pytest.raises(LookupError):
        t.read()
    want = {}
    for i in range(10):
        new = {d: [f"{i}-{d}-{k}" for k in range(d % 3 + 1)] for d in range(i, 3 * i + 2)}
        assert t.commit(rows(spark, new), source="s", batch_id=i)
        want |= new
        assert held(t) == want
    assert len(t.manifest()["segments"]) < 5 and max(s["level"] for s in t.manifest()["segments"]) == 2
    t.delete(spark.createDataFrame([(7,), (8,), (999,)], "document_id long"))
    assert held(t) == {d: x for d, x in want.items() if d not in (7, 8)}
    t.commit(rows(spark, {8: ["back"]}), spark.createDataFrame([(9,)], "document_id long"))  # 9 is touched and has no rows any more
    want = {d: x for d, x in want.items() if d not in (7, 9)} | {8: ["back"]}
    assert held(t) == want
    before = held(t, version=t.versions()[-1])
    t.compact(everything=True)
    assert held(t) == before == want and len(t.manifest()["segments"]) == 1
    lost = t.vacuum()
    assert lost and held(t) == want and len(t.versions()) == 1 and len(t._names("rows")) == 1


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(spark.range(20_000).selectExpr("id as document_id", "1 as line", "sha2(cast(id as string), 512) as text"))
    t.commit(rows(spark, {5: ["new"], 19_999: ["new"]}))
    big, small = t.manifest()["segments"]
    assert small["bytes"] < big["bytes"] / 100
    assert t.read().count() == 20_000 and t.read().filter("document_id = 5").first().text == "new"


def test_many_replaced_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for i in range(3):
        t.commit(rows(spark, {d: [f"{i}"] for d in range(40)}))
    want = held(t)
    monkeypatch.setattr(versioned, "BROADCAST_KEYS", 10)
    assert held(t) == want == {d: ["2"] for d in range(40)}


def test_a_commit_that_is_cut_off_and_a_replay(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(rows(spark, {1: ["a"], 2: ["b"]}), source="s", batch_id=0)
    swap = VersionedTable._swap

    def lost(self, manifest):
        raise RuntimeError("the driver died here")

    monkeypatch.setattr(VersionedTable, "_swap", lost)
    with pytest.raises(RuntimeError, match="died"):
        t.commit(rows(spark, {2: ["c"]}), source="s", batch_id=1)
    monkeypatch.setattr(VersionedTable, "_swap", swap)
    assert held(t) == {1: ["a"], 2: ["b"]} and len(t._names("rows")) == 2
    assert t.commit(rows(spark, {2: ["c"]}), source="s", batch_id=1)
    files = t._names("rows")
    assert not t.commit(rows(spark, {2: ["c"]}), source="s", batch_id=1) and not t.commit(rows(spark, {1: ["z"]}), source="s", batch_id=0)
    assert t._names("rows") == files and held(t) == {1: ["a"], 2: ["c"]}
    assert len(t.vacuum(versions=9)) == 1 and held(t) == {1: ["a"], 2: ["c"]}


def test_two_commits_at_a_time(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(rows(spark, {1: ["a"]}))
    base = t.manifest()
    t.commit(rows(spark, {1: ["b"]}))
    with pytest.raises(ConcurrentCommit):
        t._swap(base | {"version": base["version"] + 1})
    assert held(t) == {1: ["b"]} and not [n for n in t._names("manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_null_keys_and_empty_batches(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", keys=("document_id", "line"))
    t.commit(spark.createDataFrame([], ROWS))
    assert t.read().count() == 0
    t.commit(spark.createDataFrame([(None, 1, "a"), (1, None, "b")], ROWS))
    t.commit(spark.createDataFrame([(None, 1, "c")], ROWS))
    assert sorted(map(str, t.read().collect())) == sorted(map(str, spark.createDataFrame([(None, 1, "c"), (1, None, "b")], ROWS).collect()))


def test_ingest_stream_replays_without_change(spark, tmp_path):
    source, sink = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "a.txt").write_text("Alpha text one. Alpha text two.")
    (source / "b.exe").write_text("no")
    jobs.stream_ingest(spark, str(source), sink, str(tmp_path / "c1")).awaitTermination()
    table = VersionedTable(spark, sink)
    first = sorted(map(str, table.read().collect()))
    (source / "c.txt").write_text("Gamma text.")
    jobs.stream_ingest(spark, str(source), sink, str(tmp_path / "c1")).awaitTermination()
    assert table.read().select("document_id").distinct().count() == 2
    jobs.stream_ingest(spark, str(source), sink, str(tmp_path / "c2")).awaitTermination()  # everything is delivered again
    again = sorted(map(str, table.read().filter("document_id like '%a.txt'").collect()))
    assert len(first) == 1 and again == first and table.read().count() == 2


def test_segments_replaced_whole_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "BROADCAST_KEYS", 0)
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(rows(spark, {1: ["a"], 2: ["b"]}))
    t.commit(rows(spark, {1: ["c"], 2: ["d", "e"]}))
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert held(t) == {1: ["c"], 2: ["d", "e"]} and "Join" not in plan and "Exchange" not in plan
    t.commit(rows(spark, {2: ["f"], 3: ["g"]}))  # one segment is replaced in part now
    assert held(t) == {1: ["c"], 2: ["f"], 3: ["g"]}
    assert len(t.drop_replaced()) == 1 and not t.drop_replaced() and len(t.vacuum()) == 1 and held(t) == {1: ["c"], 2: ["f"], 3: ["g"]}


def test_a_deletion_outlives_the_segments_that_it_replaces(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(rows(spark, {1: ["a"], 2: ["b"]}))
    t.delete(spark.createDataFrame([(1,)], "document_id long"))
    assert t.drop_replaced() == [] and held(t) == {2: ["b"]}
    t.commit(rows(spark, {2: ["c"]}))
    assert len(t.drop_replaced()) == 1 and held(t) == {2: ["c"]}
    t.commit(rows(spark, {1: ["d"]}))
    assert len(t.drop_replaced()) == 1 and len(t.vacuum()) == 2 and held(t) == {1: ["d"], 2: ["c"]}


def test_ingest_leaves_only_its_table_on_disk(spark, sf_dir, tmp_path):
    """Texts are neither written down between the steps nor left behind by their exchange."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = docs.select(F.concat(F.lit("/up/"), "doc_id", F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "utf-8").alias("content"))
    made.write.parquet(f"file://{tmp_path}/in")
    shared = Path("/" + shared_folder(spark).removeprefix("file:").lstrip("/"))

    def size(files):
        return sum(f.stat().st_size for f in files if f.is_file())

    def disk():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        blocks = [Path(blocks.apply(i).getPath()) for i in range(blocks.size())]
        return size(shared.rglob("part-*")), size(f for f in blocks if f.name.startswith("shuffle_"))

    before = disk()
    jobs.stream_ingest(spark, spark.readStream.schema(made.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", str(tmp_path / "c")).awaitTermination()
    after, texts = disk(), docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert VersionedTable(spark, f"file://{tmp_path}/out").read().count() >= docs.count() / 2
    assert after[0] - before[0] < texts / 10 and after[1] - before[1] < texts / 10


def test_embed_stream_resumes(spark, tmp_path):
    source, sink = str(tmp_path / "in"), f"file://{tmp_path}/out"
    schema = "chunk_id long, document_id long, chunk_index int, content string"
    spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 1, "b")], schema).write.parquet(source)
    jobs.stream_embed(spark, source, schema, sink, str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([(2, 1, 1, "b"), (3, 2, 0, "c")], schema).write.mode("append").parquet(source)
    jobs.stream_embed(spark, source, schema, sink, str(tmp_path / "c1")).awaitTermination()
    table = VersionedTable(spark, sink, keys=("chunk_id",))
    assert sorted(r.chunk_id for r in table.read().collect()) == [1, 2, 3]
    assert [spark.read.parquet(f"{sink}/rows/_segment={s['name']}").count() for s in table.manifest()["segments"]] == [2, 1]


def test_each_type_of_file_has_its_own_rule(spark, tmp_path):
    files = {"a.md": "# Title\n\nSome **bold** text.", "b.json": json.dumps({"n": 1, "name": "x", "list": []}), "c.csv": "name,age\nann,30\nbob,41\n", "d.txt": "# stays", "e.json": "{broken",
             "f.csv": "".join(f"{i};{i * i}\n" for i in range(3)), "g.pdf.exe": "x", "h.xls": "cells"}
    made = spark.createDataFrame([(f"/up/{n}", len(t), t.encode()) for n, t in files.items()], "path string, length long, content binary")
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert jobs.ingest_batch(made, table, ChunkingConfig(), "s", 0) and not jobs.ingest_batch(made, table, ChunkingConfig(), "s", 0)
    got = {}
    for r in table.read().orderBy("document_id", "chunk_index").collect():
        got[r.document_id[4:]] = got.get(r.document_id[4:], "") + r.content + "\n"
    assert got["a.md"].startswith("Title") and "**" not in got["a.md"] and "# stays" in got["d.txt"]
    assert "Top-level keys:" in got["b.json"] and "- name: str" in got["b.json"] and "- n: int" in got["b.json"] and got["e.json"].strip() == "{broken"
    assert "Rows: 2 | Columns: 2" in got["c.csv"] and "| name | age |" in got["c.csv"] and "| bob | 41 |" in got["c.csv"] and "g.pdf.exe" not in got
    # a new delivery replaces: one document is now refused by its size, one has no text, one is new
    again = spark.createDataFrame([("/up/a.md", 1 << 30, b"# x"), ("/up/d.txt", 0, b""), ("/up/z.txt", 3, b"new")], "path string, length long, content binary")
    jobs.ingest_batch(again, table, ChunkingConfig(), "s", 1)
    assert sorted(r[0][4:] for r in table.read().select("document_id").distinct().collect()) == ["b.json", "c.csv", "e.json", "f.csv", "h.xls", "z.txt"]


def test_ingested_chunks_are_those_of_a_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = docs.select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "utf-8").alias("content"))
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    for part in range(3):
        jobs.ingest_batch(made.filter(F.pmod(F.xxhash64("path"), F.lit(3)) == part), table, ChunkingConfig(), "s", part)
    pages = docs.select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("document_id"), F.lit(1).alias("page_number"), "text")
    want = chunk_documents(clean_documents(pages), ChunkingConfig())
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.select(*table.read().columns).collect()))


def test_utf16_without_a_mark(spark):
    texts = ["Hello world. Plain text, some words.", "ééé abc def 12", "a", "Ünïcode 😀 text with emoji 😀 and more", "naïve café", "x" * 5001 + "😀"]
    made = [(f"{i}{e}", t.encode(e), t) for i, t in enumerate(texts) for e in ("utf-8", "utf-16-le", "utf-16-be", "utf-16", "utf-8-sig")]
    made += [(f"{i}latin", t.encode("latin-1"), t) for i, t in enumerate(texts) if all(ord(c) < 256 for c in t)] + [("e", b"", ""), ("odd", b"a\x00b", "a\x00b"), ("zeros", b"\x00" * 8, "\x00" * 8), ("swap", "ab\ud800cd".encode("utf-16-le", "surrogatepass"), None)]
    df = spark.createDataFrame(made, "path string, content binary, want string")
    assert [r.path for r in uploads.decode_corpus(df, "want").collect() if r.want is not None and r.text != r.want] == []
    assert uploads.decode_corpus(df).filter("path = 'swap'").first().encoding != "utf-16le"
