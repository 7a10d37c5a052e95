"""Properties of chunking on small texts, and the rules that are easy to get wrong."""

import time

from pyspark.sql import functions as F

from skerry.operators.chunking import ChunkingConfig, chunk_documents, count_tokens, glue_split_lab_values, is_header_line, split_list_items, split_sentences

SMALL = ChunkingConfig(max_tokens=60, min_tokens=10, overlap=8)
LONG = " ".join(f"Sentence number {i} tells about the sample and its storage." for i in range(60))
TABLE = "| id | glucose | unit | note |\n| --- | --- | --- | --- |\n" + "\n".join(f"| {i} | {90 + i} mg/dL | x | fine |" for i in range(80))


def chunks(spark, text, config=SMALL, page=1):
    df = spark.createDataFrame([(1, page, text)], "document_id long, page_number int, text string")
    return chunk_documents(df, config).orderBy("chunk_index").collect()


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, "", count_tokens(F.col("text"))) == 0
    assert one(spark, "a b  c\nd", count_tokens(F.col("text"))) == 4


def test_short_text_is_one_chunk(spark):
    text = "First sentence here. Second one follows it."
    got = chunks(spark, text)
    assert [(c.content, c.char_start, c.char_end, c.chunk_index) for c in got] == [(text, 0, len(text), 0)]


def test_long_text_is_packed_with_overlap(spark):
    got = chunks(spark, LONG)
    assert len(got) >= 2 and [c.chunk_index for c in got] == list(range(len(got)))
    assert all(c.token_count <= 1.1 * SMALL.max_tokens for c in got)
    for a, b in zip(got, got[1:]):
        assert b.content.startswith(" ".join(a.content.split()[-SMALL.overlap:]))
    assert all(0 <= c.char_start < c.char_end <= len(LONG) for c in got)
    assert all(a.char_start <= b.char_start for a, b in zip(got, got[1:]))


def test_table_is_never_split(spark):
    got = chunks(spark, TABLE)
    assert len(got) == 1 and got[0].chunk_type == "table" and got[0].contains_table and got[0].content.count("\n") == 81


def test_mixed_document(spark):
    got = chunks(spark, f"LAB REPORT\n\nShort words before the table that are enough to be alone here.\n\n{TABLE}\n\nClosing line.")
    assert [c.chunk_type for c in got] == ["header+content", "table", "paragraph"] and got[0].is_header


def test_small_paragraphs_are_merged(spark):
    got = chunks(spark, "\n\n".join(f"Tiny note number {i}." for i in range(20)))
    assert all(c.token_count >= SMALL.min_tokens for c in got)
    assert all(any(f"number {i}." in c.content for c in got) for i in range(20))


def test_lone_small_note_is_kept(spark):
    assert [c.content for c in chunks(spark, "Only this.")] == ["Only this."]


def test_headers(spark):
    for head in ("RESULTS", "# Results"):
        got = chunks(spark, f"{head}\nThe body of the section follows right after its header line here.")
        assert len(got) == 1 and got[0].chunk_type == "header+content" and got[0].is_header
    for line, header in (("RESULTS OF 2024", True), ("- ITEM ONE", False), ("A", False), ("X" * 81, False), ("Mixed Case", False)):
        assert one(spark, line, is_header_line(F.col("text"))) is header


def test_lab_value_stays_with_its_unit(spark):
    units = glue_split_lab_values(split_sentences(F.col("text"), F.lit(0)))
    texts = [u["text"] for u in one(spark, "It was 126. Mg/dL is the unit. Then 5. MmHg 7. Bpm", units)]
    assert texts[0] == "It was 126. Mg/dL is the unit." or "126" in texts[0]
    ends = [u["text"] for u in one(spark, "Value 7! mg/dL done", units)]
    assert ends == ["Value 7! mg/dL done"]
    pair = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(0).alias("char_start"), F.lit(1).alias("char_end")) for t in ("a 1", "mg/dL 2", "bpm 3", "x")])
    assert [u["text"] for u in one(spark, "", glue_split_lab_values(pair))] == ["a 1 mg/dL 2", "bpm 3", "x"]  # not glued twice
    got = chunks(spark, "Glucose was 126 mg/dL today. " + LONG, ChunkingConfig(40, 5, 5))
    assert got[0].contains_lab_values and sum("126 mg/dL" in c.content for c in got) == 1


def test_list_items_stay_whole(spark):
    text = "intro line\n" + "\n".join(f"- item {i} has some words" + "\n  and goes on" * (i % 2) for i in range(20))
    got = chunks(spark, text, ChunkingConfig(30, 5, 0))
    assert {c.chunk_type for c in got} == {"list"}
    assert all(sum(f"- item {i} has some words\n  and goes on" in c.content for c in got) == 1 for i in range(1, 20, 2))
    assert not any("intro line" in c.content for c in got)  # lines before the first marker are dropped in lists that are split
    kept = one(spark, text, split_list_items(F.col("text"), F.lit(0), keep_preamble=True))
    assert kept[0]["text"] == "intro line"


def test_pages(spark):
    df = spark.createDataFrame([(1, 2, LONG), (1, 1, "First page text."), (1, 3, " \n "), (2, None, "No page."), (3, 1, "")], "document_id long, page_number int, text string")
    rows = chunk_documents(df, SMALL).collect()
    first = sorted((r.chunk_index, r.page_number) for r in rows if r.document_id == 1)
    assert [i for i, _ in first] == list(range(len(first))) and first[0][1] == 1 and {p for _, p in first} == {1, 2}
    assert [r.page_number for r in rows if r.document_id == 2] == [None] and not [r for r in rows if r.document_id == 3]


def test_merges_cascade_but_not_over_tables(spark):
    got = chunks(spark, "a b.\n\nc d.\n\n| x |\n\ne f.", ChunkingConfig(60, 3, 0))
    assert [c.content for c in got] == ["a b.\n\nc d.", "| x |", "e f."]


def test_windows_without_sentences(spark):
    got = chunks(spark, LONG, ChunkingConfig(50, 5, 0, sentences=False))
    assert all(c.token_count <= 50 for c in got) and " ".join(c.content for c in got).split() == LONG.split()


def test_pages_of_one_file_are_cut_in_many_tasks(spark, capsys):
    """Pages are exchanged before they are cut, however few partitions they come in; the chunks stay the same."""
    rows = [(d, p, f"HEAD {p}\n\n{LONG}\n\n- a\n- b") for d in range(3) for p in (1, 2, None)]
    one = spark.createDataFrame(rows, "document_id long, page_number int, text string").coalesce(1)
    chunk_documents(one, SMALL).explain()
    plan = capsys.readouterr().out
    assert plan.rindex("Exchange hashpartitioning") > plan.rindex("Generate")
    key = lambda r: (r.document_id, r.chunk_index)
    got = sorted(chunk_documents(one, SMALL).collect(), key=key)
    assert got == sorted(chunk_documents(one.repartition(3), SMALL).collect(), key=key) and {r.page_number for r in got} == {1, 2, None}


def test_a_long_page_costs_as_much_as_its_parts(spark):
    """What an aggregate gathers is copied at each of its steps: texts in it would make long pages cost the square of their length."""
    def seconds(pages, sentences):
        text = F.expr(f"array_join(transform(sequence(1, {sentences}), i -> concat('Sentence ', id, ' has the number ', i, ' and goes on for some more words.')), ' ')")
        rows = spark.range(0, pages, 1, 4).select(F.col("id").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))
        began = time.time()
        chunk_documents(rows).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(400, 100)  # compiles
    assert seconds(4, 10_000) < 5 * seconds(400, 100) + 5
