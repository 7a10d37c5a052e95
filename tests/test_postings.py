"""Postings are built where the chunks are: by stems of frequent words that are broadcast, and of rare ones in place."""

from skerry.operators import keyword
from skerry.plans.views import v_chunks
from tests.differential import spark_rows


def test_frequent_and_rare_words_have_the_same_stems(spark, sf_dir):
    chunks = v_chunks(spark, sf_dir).filter("document_id < 60")
    every, few = keyword.build_postings(chunks), keyword.build_postings(chunks, common=5)
    assert every.columns == ["term", "document_id", "chunk_index", "positions", "tf"]
    assert spark_rows(every) == spark_rows(few) and every.count() > 1000


def test_postings_are_not_exchanged(spark, sf_dir):
    plan = keyword.build_postings(v_chunks(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(document_id" in plan
    assert plan.count("Exchange hashpartitioning(word") <= 1  # of the broadcast words alone
