"""The training-corpus pipeline: five stages over whole documents, each written as Parquet and read again for the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import decontaminate, language_id, line_dedup, near_dedup, unigram
from skerry.llm.common import delete, shared_dir, table, text_hash, within, without


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not known go: those without letters, or where no language reaches half of the posterior. Null and empty texts
    go; repeated rows are judged alike; all columns stay as they are."""
    judged = language_id.document_languages(docs, table(spark, sf_dir, "pages"))
    return without(docs, judged.filter(~F.col("accepted")).select("doc_id", "_th"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; the documents stay, also those without a doc_id (they count as one) and those left without
    lines; a null text becomes an empty one; repeated rows of a doc_id count once and are treated alike."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one of the smallest doc_id; near is a similarity of 0.8 or more (op4's own query
    keeps 0.85). Every row is judged by its own text, so a text that only shares its doc_id with others stays; repeated rows leave one.
    Rows without words or without a doc_id stay."""
    judged = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=80)
    out = without(docs, judged.filter("not first").select("doc_id", "_th"))
    repeated = judged.filter("first and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "_th").count().filter("count > 1").select("doc_id", "_th")
    if repeated.isEmpty():
        return out
    one = within(out, repeated).withColumn("_skerry_th", text_hash(F.col("text"))).dropDuplicates(["doc_id", "_skerry_th"]).drop("_skerry_th")
    return without(out, repeated).unionByName(one)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none; repeated rows are judged alike, each row by its own text."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as SentencePiece ids, with a check that they decode to the text; null and empty texts have no ids; each row gives one row."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = unigram.encode_and_decode(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), path)
    return out.select("doc_id", "lang", "source", "piece_ids", "n_pieces", "ids_crc32", (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: The sketches, the latent space and the piece search cannot be put in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder, read back for the next one, and then removed; the last
    one's stays."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if i:
            delete(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
