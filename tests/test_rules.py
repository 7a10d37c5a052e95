"""Rules that are easy to get wrong, one small case each."""

import datetime as dt
import random

from pyspark.sql import functions as F

from skerry.functions import text as t
from skerry.operators import catalog, chunking, keyword, monitoring, search, tabular, vectors
from skerry.operators.embedding import WIDTH, embed_chunks
from skerry.sources import uploads
from skerry.streaming import jobs

SIMPLE = "chunk_id long, document_id long, chunk_index int, embedding array<float>, content string"


def value(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first()["x"]


def test_zero_vectors_are_never_returned(spark):
    v = spark.createDataFrame([(1, 1, 0, [0.0, 0.0], "a"), (2, 1, 1, [1.0, 0.0], "b"), (3, 1, 2, None, "c")], SIMPLE)
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<float>")
    assert [r.chunk_id for r in vectors.exact_knn(v, q, 5).collect()] == [2]
    assert [r.chunk_id for r in vectors.exact_knn(v, q, 5, 1.0).collect()] == []  # the threshold is strict


def test_fusion_uses_reading_order(spark):
    ranked = spark.createDataFrame([(1, 10, 0, "x", 0.9, 1), (1, 20, 0, "y", 0.8, 2), (1, 10, 5, "z", 0.1, 3)],
                                   "query_id long, document_id long, chunk_index int, content string, score double, rank int")
    order = search.group_by_document(ranked)
    assert [(r.document_id, r.chunk_index) for r in order.orderBy("position").collect()] == [(10, 0), (10, 5), (20, 0)]
    fused = search.rrf_fuse(order, order.filter("false")).collect()
    assert {(r.document_id, r.chunk_index): r["rank"] for r in fused}[(10, 5)] == 2
    both = search.rrf_fuse(order, order, 1).first()
    assert both.score == 1.0


def test_dedupe_follows_the_limit(spark):
    ranked = spark.createDataFrame([(1, 1, 0, "same", 0.9, 1), (1, 2, 0, "same", 0.9, 2), (1, 3, 0, "other", 0.5, 3)],
                                   "query_id long, document_id long, chunk_index int, content string, score double, rank int")
    assert sorted(r.document_id for r in search.dedupe_by_content(ranked).collect()) == [1, 3]


def test_long_document_crowds_the_pool(spark):
    rows = [(i, 1, i, [1.0, 0.01 * i], "c") for i in range(40)] + [(100, 2, 0, [1.0, 0.0], "s"), (101, 3, 0, [1.0, 0.9], "o")]
    v = spark.createDataFrame(rows, SIMPLE)
    got = vectors.similar_documents(v, spark.createDataFrame([(2,)], "document_id long"), k=2).collect()
    assert [r.document_id for r in got] == [1]


def test_web_queries(spark):
    chunks = spark.createDataFrame([(1, 0, "red blood cells and cats"), (1, 1, "blood red cat"), (2, 0, "white cells")], "document_id long, chunk_index int, content string")
    postings = keyword.build_postings(chunks)

    def ask(text):
        q = spark.createDataFrame([(1, text)], "query_id long, text string")
        return sorted((r.document_id, r.chunk_index) for r in keyword.match_postings(postings, keyword.parse_web_query(q)).collect())

    assert ask("red cat") == [(1, 0), (1, 1)]
    assert ask('"red blood"') == [(1, 0)]
    assert ask("blood -cells") == [(1, 1)]
    assert ask("white or cats") == [(1, 0), (1, 1), (2, 0)]
    assert ask('"unclosed the -') == [] and ask("") == []


def test_suggest_takes_wildcards_literally(spark):
    p = spark.createDataFrame([(1, "u", "a%b"), (2, "u", "do")], "query_id long, user_id string, prefix string")
    h = spark.createDataFrame([("u", "axxb", 1, dt.datetime(2024, 1, 1)), ("u", "a%bc", 2, dt.datetime(2024, 1, 2)), ("u", "A%BC", 3, dt.datetime(2024, 1, 1))],
                              "user_id string, query_text string, event_id long, created_at timestamp_ntz")
    d = spark.createDataFrame([], "uploaded_by string, filename string, display_name string")
    pr = spark.createDataFrame([], "owner_id string, name string")
    assert [r.text for r in search.suggest(p, h, d, pr).orderBy("position").collect()] == ["a%bc", "A%BC"]


def test_suggest_by_runs_equals_containment(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choices("abAé.", k=k))
    docs = [(i, f"u{i % 3}", word(rng.randrange(0, 9)), rng.choice([None, word(6)])) for i in range(150)] + [(900, None, "abab", None), (901, "u0", None, None)]
    asked = [(i, f"u{i % 4}", rng.choice([" ", ""]) + word(rng.randrange(1, 6))) for i in range(90)] + [(99, "u0", None), (98, None, "aba")]
    documents = spark.createDataFrame(docs, "document_id long, uploaded_by string, filename string, display_name string")
    history = spark.createDataFrame([], "event_id long, user_id string, query_text string, created_at timestamp_ntz")
    projects = spark.createDataFrame([(f"p{i}", d[1], d[2]) for i, d in enumerate(docs[:40])], "project_id string, owner_id string, name string")
    got = search.suggest(spark.createDataFrame(asked, "query_id long, user_id string, prefix string"), history, documents, projects, k=1000)
    want = []
    for q, user, prefix in asked:
        p = (prefix or "").strip(" ").lower()
        if len(p) >= 3 and user:
            want += [(q, "document", shown if shown is not None else name) for _, owner, name, shown in docs if owner == user and any(p in x.lower() for x in (name, shown) if x)]
            want += [(q, "project", name) for _, owner, name, _ in docs[:40] if owner == user and p in (name or "").lower()]
    assert sorted((r.query_id, r.kind, r.text) for r in got.collect()) == sorted(want) and len(want) > 50


def test_suggest_answers_each_prefix_of_a_user_once(spark):
    """Many requests for one prefix, one of which is delivered twice, against long histories: latest queries, then names, each cut to its limit."""
    rng = random.Random(9)
    documents = spark.createDataFrame([(i, f"u{i % 2}", f"doc_{i:04}", None) for i in range(400)], "document_id long, uploaded_by string, filename string, display_name string")
    searches = [(i, f"u{i % 2}", f"doc_{rng.randrange(6)}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(500))) for i in range(600)]
    asked = [(i, f"u{i % 2}", rng.choice(["doc_", "DOC_0", "doc_3"])) for i in range(300)] + [(7, "u1", "doc_0")]
    history = spark.createDataFrame(searches, "event_id long, user_id string, query_text string, created_at timestamp_ntz")
    projects = spark.createDataFrame([("u0", "my doc_3")], "owner_id string, name string")
    listed = search.containing(search.name_postings(documents.selectExpr("uploaded_by as user_id", "filename as text", "array(filename) as fields")),
                               spark.createDataFrame([("u0", "doc_")], "user_id string, _p string"))
    assert listed.columns == ["user_id", "_p", "text"] and listed.count() == 200
    got = search.suggest(spark.createDataFrame(asked, "query_id long, user_id string, prefix string"), history, documents, projects)
    want = []
    for q in {a[0] for a in asked}:
        rows, names = [], []
        for _, user, prefix in [a for a in asked if a[0] == q]:
            p = prefix.lower()
            rows += [(at, e, text) for e, u, text, at in searches if u == user and text.startswith(p)]
            names += [(1, 0, d) for d in (f"doc_{i:04}" for i in range(400) if f"u{i % 2}" == user) if p in d] + [(2, 0, "my doc_3")] * (user == "u0" and p in "my doc_3")
        first = {}
        for i, (_, _, text) in enumerate(sorted(rows, reverse=True)[:3]):
            first.setdefault(text, i)
        want += [(q, i + 1, ("recent_query", "document", "project")[n], t) for i, (n, _, t) in enumerate(sorted([(0, i, t) for t, i in first.items()] + names)[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_confidences_have_an_exact_mean(spark):
    """Means on a half, which sums of doubles bring to either side of it by their order."""
    halves = {i: [round(60 + i / 10 + d, 2) for d in (0.1, 0.2, 0.15)] * 7 for i in range(20)}  # mean i/10 + 60.15
    rows = [(i, c, "w") for i, cs in halves.items() for c in cs] + [(90, float("nan"), "w"), (90, 70.0, "w"), (91, -1.0, "w"), (91, 80.0, " "), (92, 59.95, "w"), (93, None, "w")]
    got = {r.key: (r.confidence, r.warning) for r in t.ocr_confidence(spark.createDataFrame(rows, "key int, conf double, word string"), ["key"]).collect()}
    assert got == {i: ((602 + i) / 10, False) for i in halves} | {90: (70.0, False), 91: (None, True), 92: (60.0, False), 93: (None, True)}


def test_upload_codes(spark):
    rows = [("a.pdf", "application/pdf", 51 << 20), ("a.docx", "application/pdf", 1), ("a.csv", "application/pdf", 1), ("a/b.pdf", "application/pdf", 1), ("x" * 253 + ".md", "text/markdown", 1), ("a.pdf", "x/y", 1)]
    got = uploads.validate_uploads(spark.createDataFrame(rows, "filename string, mime_type string, size_bytes long")).collect()
    assert [r.reject_code for r in got] == ["FILE_TOO_LARGE", "UNSUPPORTED_FILE_TYPE", None, "INVALID_FILENAME", "INVALID_FILENAME", "UNSUPPORTED_FILE_TYPE"]


def test_decoding(spark):
    rows = [("a", "é".encode()), ("b", "é".encode("latin-1")), ("c", b"\xff\xfe" + "é".encode("utf-16le")), ("d", b"\xef\xbb\xbfx"), ("e", b"")]
    got = {r.path: (r.text, r.encoding) for r in uploads.decode_corpus(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": ("é", "utf-8"), "b": ("é", "latin-1"), "c": ("é", "utf-16le"), "d": ("x", "utf-8-sig"), "e": ("", "utf-8")}


def test_text_rules(spark):
    text = F.col("text")
    assert value(spark, "1O5 l2 Ill\n***\nx", t.fix_ocr_tokens(text)) == "105 12 Ill\nx"
    assert value(spark, "Na 140 mmol/L, 5 mg/dLx", t.protect_lab_values(text)) == "Na 140⁠mmol/L, 5 mg/dLx"
    assert value(spark, "a\nRESULTS\nb\nNotes:\n\nc", t.isolate_section_headers(text)) == "a\n\nRESULTS\n\nb\n\nNotes:\n\nc"
    assert value(spark, "ﬁne\x00\n\n\n\nx", t.clean_whitespace(text)) == "fine\n\nx"
    assert value(spark, "# T\n**b** _i_ `c` [l](u)\n> q\n* x\n---\n| a | b |", t.markdown_to_text(text)) == "T\nb i c l\nq\n- x\n\na | b"


def test_header_lines_of_pages(spark):
    pages = [(1, i, f"{'Top' if i < 4 else 'Else'}\nbody {i}\npage {i}") for i in range(1, 6)] + [(2, 1, "Top\nx"), (2, 2, "Top\nx")]
    got = {(r.document_id, r.page_number): r.text for r in t.strip_repeated_headers_footers(spark.createDataFrame(pages, "document_id long, page_number int, text string")).collect()}
    assert got[(1, 1)] == "\nbody 1\npage 1" and got[(1, 4)].startswith("Else") and got[(2, 1)] == "Top\nx"


def test_csv_rules(spark):
    lines = ["# comment", 'name;value;value', "x;1;a", '"y;z";N/A;b', ";;", "w;3;c"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "dataset string, line_no int, line string")
    d = tabular.sniff_delimiter(df)
    assert d.first().delimiter == ";"
    cells = tabular.text_to_grid(df, d)
    headers = tabular.detect_header_rows(cells)
    names = tabular.name_columns(cells, headers)
    assert headers.first().header_rows == 1
    assert [r.column_name for r in names.orderBy("col_no").collect()] == ["name", "value", "value_1"]
    data = tabular.data_cells(cells, headers, names)
    assert sorted(r.value for r in data.filter("col_no = 1").collect()) == ["w", "x", "y;z"]
    assert data.select("row_no").distinct().count() == 3


def test_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, " "), (3, None)], "chunk_id long, content string")
    rows = {r.chunk_id: r for r in embed_chunks(df).collect()}
    assert abs(sum(x * x for x in rows[1].embedding) - 1) < 1e-5 and rows[1].embed_ok and len(rows[1].embedding) == WIDTH
    assert not rows[2].embed_ok and not any(rows[3].embedding)


def test_failing_encoder_gives_flagged_zero_vectors(spark):
    def encoder(texts):
        import numpy as np

        if any("bad" in x for x in texts):
            raise RuntimeError("no")
        return np.ones((len(texts), 4))

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "chunk_id long, content string")
    rows = {r.chunk_id: (r.embed_ok, r.embedding) for r in embed_chunks(df, encoder, 4).collect()}
    assert rows[1] == (True, [0.5] * 4) and rows[2] == (False, [0.0] * 4)


def test_alerts_and_retries(spark):
    logs = spark.createDataFrame([(i, "u", 6000 if i >= 5 else 100, dt.datetime(2024, 1, 1, 0, i)) for i in range(10)], "event_id long, user_id string, search_time_ms int, created_at timestamp_ntz")
    levels = [r.level for r in monitoring.search_latency_alert(logs, 3).orderBy("event_id").collect()]
    assert levels == ["ok"] * 5 + ["warning", "warning"] + ["error"] * 3 or levels[-1] == "error"
    docs = spark.createDataFrame([(1, "error", "x", "pending/a"), (2, "error", "x", "uploads/a"), (3, "ready", "error", "uploads/a"), (4, "indexed", "complete", "uploads/a")],
                                 "document_id long, status string, embedding_status string, file_key string")
    assert [r.action for r in catalog.plan_retries(docs).orderBy("document_id").collect()] == ["reject_file_not_ready", "re_parse", "re_embed", "reject"]


def test_alert_stream_equals_batch(spark, tmp_path):
    rows = [(f"u{i % 3}", i, dt.datetime(2024, 1, 1, 0, 0, i % 60), (i * 37) % 9000) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, event_id long, created_at timestamp, search_time_ms int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.latency_alerts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.event_id, r.mean_ms, r.level) for r in spark.table("alerts").collect())
    assert got == sorted((r.event_id, r.mean_ms, r.level) for r in monitoring.search_latency_alert(df).collect())


def test_transition_stream_equals_batch(spark, tmp_path):
    rows = [(i % 4, dt.datetime(2024, 1, 1, 0, i), ["pending", "indexed", "error", "indexed", "ready"][i * 7 % 5]) for i in range(40)]
    df = spark.createDataFrame(rows, "document_id long, seen_at timestamp, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = (jobs.stream_status_transitions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("moves")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("moves").collect())) == sorted(map(tuple, catalog.status_transitions(df).select("document_id", "status", "seen_at").collect()))


def test_owner_month_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, "u1", dt.datetime(2024, 1, 5)), (2, "u1", dt.datetime(2024, 2, 5)), (3, "u2", dt.datetime(2024, 1, 5))], "document_id long, uploaded_by string, created_at timestamp_ntz")
    uploads.write_by_owner_month(df, str(tmp_path / "x"))
    assert [r.document_id for r in spark.read.parquet(str(tmp_path / "x")).filter("user_id = 'u1' and month = 2").collect()] == [2]


def test_cut_marks_in_texts_stay(spark):
    pages = spark.createDataFrame([(1, 1, "ab\u0001cd\n\nef\u0001\u0002 One. Two\u0001\u0003 x")], "document_id long, page_number int, text string")
    blocks = [r.text for r in chunking.split_blocks(pages).orderBy("block_no").collect()]
    assert blocks == ["ab\u0001cd", "ef\u0001\u0002 One. Two\u0001\u0003 x"]
    row = pages.select(tabular.split_quoted(F.lit('a\u0001b,"c,\u0003d",e'), F.lit(",")).alias("cells"), t.fix_ocr_tokens(F.lit("x\u0001 1O0")).alias("ocr"),
                       chunking.split_sentences(F.col("text"), F.lit(0)).alias("sentences")).first()
    assert row.cells == ["a\u0001b", "c,\u0003d", "e"] and row.ocr == "x\u0001 100"
    assert [u.text for u in row.sentences] == ["ab\u0001cd\n\nef\u0001\u0002 One.", "Two\u0001\u0003 x"]


def test_json_keys_of_every_form(spark):
    docs = spark.createDataFrame([(1, '{"a.b": 1, "a": {"b": "s"}, "x[0]": true, "x": [1], "": null}')], "document_id long, text string")
    got = {(r.key, r.type) for r in t.json_profile(docs).collect()}
    assert got == {("a.b", "integer"), ("a", "object"), ("x[0]", "boolean"), ("x", "array"), ("", "null")}


def test_percentages_count_as_numbers_in_header_rows(spark):
    cells = spark.createDataFrame([("d", r, c, v) for r, row in enumerate([["10%", "20%"], ["30%", "40%"]], 1) for c, v in enumerate(row, 1)], "dataset string, row_no int, col_no int, value string")
    assert tabular.detect_header_rows(cells).first().header_rows == 0


def test_stems_find_other_forms(spark):
    chunks = spark.createDataFrame([(1, 0, "They were running three studies"), (2, 0, "nothing here")], "document_id long, chunk_index int, content string")
    asked = spark.createDataFrame([(1, "run study"), (2, "the")], "query_id long, text string")
    got = keyword.match_postings(keyword.build_postings(chunks), keyword.parse_web_query(asked)).collect()
    assert [(r.query_id, r.document_id) for r in got] == [(1, 1)]
