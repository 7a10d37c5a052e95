"""The stored inverted index: built in parts, searched in one pruned scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skerry.operators import keyword, search
from skerry.sources.inverted import InvertedIndex

CHUNKS = "document_id long, chunk_index int, content string"
WORDS = "glucose insulin reading sample result patient assay level buffer protein".split()


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(d, i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for d in range(60) for i in range(rng.randint(1, 3))], CHUNKS).cache()


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["glucose", "insulin reading", '"sample result"', "patient -assay", "level or buffer", '"protein protein"', '"assay level" glucose', "-glucose", "the", "", 'sample "result patient" or insulin -"level buffer"',
             "unknownword", "reading or unknownword", '"glucose insulin glucose"']
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_parts_give_what_a_full_build_gives(spark, chunks, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/i", buckets=8, fanout=3)
    assert index.postings().count() == 0
    for i in range(4):
        index.add(chunks.filter(F.col("document_id") % 4 == i), "s", i)
    assert rows(index.postings()) == rows(keyword.build_postings(chunks))
    changed = chunks.filter("document_id < 20").withColumn("content", F.concat("content", F.lit(" extra glucose")))
    index.add(changed, "s", 4)
    index.remove(chunks.filter("document_id = 59").select("document_id"))
    now = chunks.filter("document_id between 20 and 58").unionByName(changed)
    assert rows(index.postings()) == rows(keyword.build_postings(now))
    index.table.compact(everything=True)
    assert rows(index.postings()) == rows(keyword.build_postings(now)) and len(index.table.manifest()["segments"]) == 1


def test_one_row_for_each_chunk_decides_like_joins_do(spark, chunks, queries):
    postings, parsed = keyword.build_postings(chunks), keyword.parse_web_query(queries)
    want = keyword.cover_density_rank(postings, parsed, keyword.match_postings(postings, parsed))
    got = keyword.scored_matches(postings, parsed)
    assert rows(got) == rows(want) and got.count() > 100
    scope = spark.createDataFrame([(q, d) for q in range(14) for d in range(q, 60, 3)], "query_id long, document_id long")
    assert rows(keyword.scored_matches(postings, parsed, scope)) == rows(want.join(scope, ["query_id", "document_id"], "left_semi"))


def test_covers_are_minimal(spark, chunks):
    """Against all stretches of each chunk."""
    queries = spark.createDataFrame([(1, "glucose insulin"), (2, "sample result patient"), (3, "assay")], "query_id long, text string")
    texts = {(r.document_id, r.chunk_index): r.content.split() for r in chunks.collect()}
    terms = {1: ("glucose", "insulin"), 2: ("sample", "result", "patient"), 3: ("assay",)}
    got = {(r.query_id, r.document_id, r.chunk_index): r.score for r in keyword.scored_matches(keyword.build_postings(chunks), keyword.parse_web_query(queries)).collect()}
    want = {}
    for q, ts in terms.items():
        for key, w in texts.items():
            covers = [(p, e) for p in range(len(w)) for e in range(p, len(w)) if set(ts) <= set(w[p:e + 1])]
            minimal = [c for c in covers if not any(o != c and o[0] >= c[0] and o[1] <= c[1] for o in covers)]
            if minimal:
                want[(q, *key)] = round(sum(1 / (1 + (e - p + 1) - len(ts)) for p, e in minimal), 6)
    assert got == pytest.approx(want, abs=2e-6)


def test_a_search_reads_the_folders_of_its_terms_once(spark, chunks, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/i", buckets=32)
    index.add(chunks)
    asked = spark.createDataFrame([(1, "glucose insulin")], "query_id long, text string")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the filters are cut off in the plan's text
    found = search.keyword_search(index, chunks, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x and "positions" in x]
    assert len(scans) == 1 and "bucket" in scans[0].split("PartitionFilters")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pruned = scans[0].split("PartitionFilters: [")[1].split("]")[0]
    numbers = re.findall(r"\d+", re.sub(r"#\d+", "", pruned.split("bucket", 1)[1]))
    assert 1 <= len(numbers) <= 3, pruned  # of 32 folders
    assert rows(found) == rows(search.keyword_search(keyword.build_postings(chunks), chunks, asked))


def test_positions_are_exchanged_once_for_all_queries(spark):
    """Many queries of the same words: what is shuffled for them is one row for each chunk, which every query's own test decides."""
    texts = [" ".join(w for i, w in enumerate(("alpha", "beta", "gamma", "delta")) if n >> i & 1) or "none" for n in range(16)]
    chunks = spark.createDataFrame([(n, 0, f"{t} filler {t}") for n, t in enumerate(texts)], "document_id long, chunk_index int, content string")
    asked = {q: ("alpha beta", "alpha or delta", "gamma -alpha", '"alpha beta" or "gamma delta"')[q % 4] for q in range(40)}
    parsed = keyword.parse_web_query(spark.createDataFrame(list(asked.items()), "query_id long, text string"))
    rules = (lambda t: {"alpha", "beta"} <= t, lambda t: bool({"alpha", "delta"} & t), lambda t: "gamma" in t and "alpha" not in t,
             lambda t: {"alpha", "beta"} <= t or {"gamma", "delta"} <= t)
    found = keyword.matched_chunks(keyword.build_postings(chunks), parsed)
    got = [(r.query_id, r.document_id) for r in found.collect()]
    want = [(q, n) for q in asked for n, t in enumerate(texts) if rules[q % 4](set(t.split()))]
    assert sorted(got) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("_lead")  # nothing above the join with the queries is grouped or exchanged
    assert "Aggregate" not in plan[:joined] and "Repartition" not in plan[:joined]
