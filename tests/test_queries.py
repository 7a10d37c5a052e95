"""Every registered query of the library against its DuckDB twin on the smallest data; the others must run and give rows."""

import re
import unicodedata

import pytest

from skerry.operators import chunking
from skerry.plans import registry
from skerry.plans.chunk_queries import v_rich
from tests.differential import duck_rows, spark_rows

QUERIES, SQL = registry.collect("QUERIES"), registry.collect("SQL")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in SQL:
        assert got == duck_rows(SQL[name], sf_dir)
    else:
        assert got[1]


def test_twins_have_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_registered_index_search_finds_nine_of_ten(spark):
    import numpy as np

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in QUERIES["ann_knn"](spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    recall = {}
    for q, found in got.items():
        near = ids[np.argsort(-(x @ x[ids == q][0]), kind="stable")]
        recall[q] = len(found & set(near[near != q][:10].tolist())) / 10
    assert np.mean(list(recall.values())) >= 0.9
    told = {r.query_id: r.recall for r in QUERIES["knn_recall"](spark, d).collect()}
    assert told.keys() == recall.keys() and abs(np.mean(list(told.values())) - np.mean(list(recall.values()))) < 0.01
    assert all(r.exact_share <= 0.25 and r.exact_share < r.code_share < 0.95 for r in QUERIES["knn_recall"](spark, d).collect())


def test_searches_take_every_fiftieth_row(spark, sf_dir):
    ids = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    fiftieth = {i for i in ids if i % 50 == 0}
    for name in ("exact_knn", "semantic_search", "ann_knn", "knn_recall"):
        assert {r.query_id for r in QUERIES[name](spark, sf_dir).select("query_id").collect()} == fiftieth, name
    assert fiftieth <= {r.query_id for r in QUERIES["hybrid_search"](spark, sf_dir).select("query_id").collect()}
    sources = {r.source_id for r in QUERIES["similar_documents"](spark, sf_dir).select("source_id").collect()}
    assert sources == {i // 5 for i in ids if i // 5 % 50 == 0}


@pytest.fixture(scope="module")
def accented(spark, sf_dir, tmp_path_factory):
    """The documents and three more with compatibility characters; (folder, texts)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = ["ﬁne ① Ａ\u00a0b, ½. x\n\n\n\ny", "cafe\u0301 naïve. " * 80, "\u3000\x00ﬀ\n"]
    rows = spark.createDataFrame([(10**6 + i, t, "fr", "src0", len(t)) for i, t in enumerate(more)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("accented"))
    docs.select(*rows.columns).unionByName(rows).write.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} | {10**6 + i: t for i, t in enumerate(more)}
    assert sum(not t.isascii() for t in texts.values() if t) > 3
    return folder, texts


def test_whole_texts_are_cleaned(spark, accented):
    def clean(t):
        t = unicodedata.normalize("NFKC", t.replace(". ", ".\n\n\n\n").replace(",", "\x07\t"))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", t))

    folder, texts = accented
    got = {r.document_id: r.text for r in QUERIES["clean_whitespace"](spark, folder).collect()}
    assert got == {i: t if t is None else clean(t) for i, t in texts.items()}


def test_whole_texts_are_prepared(spark, accented):
    def prepare(t):
        t = re.sub(r"\A\s+|\s+\Z", "", unicodedata.normalize("NFKC", f" {t}\n ".replace("\x00", "")), flags=re.A)
        words = re.findall(r"\s*\S+", t, re.A)
        return t if len(words) <= 100 else re.sub(r" [^ ]*\Z", "", "".join(words[:100]))

    folder, texts = accented
    got = {r.document_id: r.text for r in QUERIES["prepare_for_embedding"](spark, folder).collect()}
    assert got == {i: t if t is None else prepare(t) for i, t in texts.items()}


def test_every_line_is_judged_whole(spark, sf_dir):
    def header(line):
        x = re.sub(r"\A\s+|\s+\Z", "", line, flags=re.A)
        letters = [unicodedata.category(c) for c in x if unicodedata.category(c)[0] == "L"]
        shouted = not re.search(chunking.TABLE_ROW, x, re.A) and not re.search(chunking.LIST_ITEM, x, re.A) and len(letters) >= 2 and letters.count("Lu") >= 0.9 * len(letters)
        return x != "" and len(x) <= 80 and (bool(re.search(chunking.MD_HEADER, x, re.A)) or shouted)

    want = {(r.document_id, r.page_number, i): header(line.upper() if i % 7 == 3 else line)
            for r in v_rich(spark, sf_dir).collect() for i, line in enumerate(r.text.split("\n"))}
    rows = QUERIES["is_header_line"](spark, sf_dir).collect()
    got = {(r.document_id, r.page_number, r.line_no): r.is_header for r in rows}
    assert len(rows) == len(want) and got == want and {True, False} <= set(got.values())


@pytest.mark.parametrize("name", ["stream_ingest", "stream_latency_alert"])
def test_streams_read_tables_of_several_files(spark, sf_dir, tmp_path, name):
    """A table may be a folder of files, whose own names say nothing of the table."""
    for t in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(200).repartition(3).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() > 100
