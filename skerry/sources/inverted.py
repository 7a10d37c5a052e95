"""A stored inverted index: postings of chunks in a versioned table, in folders by a hash of the term and sorted by term.

New documents are a new segment, changed ones replace their postings by document, segments are merged in levels. A search names
its terms first, so that only the folders of their hashes are read, in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.keyword import build_postings
from skerry.sources.versioned import VersionedTable


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fanout: int = 8):
        self.spark, self.buckets = spark, buckets
        self.table = VersionedTable(spark, path, ("document_id",), fanout, folder_by="bucket", sort_by=("term", "document_id", "chunk_index"))

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, chunks: DataFrame, source: str | None = None, batch_id: int | None = None) -> bool:
        """(document_id, chunk_index, content) of new or changed documents: their postings replace what the index has of them."""
        postings = build_postings(chunks).withColumn("bucket", self.bucket(F.col("term")))
        return self.table.commit(postings, chunks.select("document_id"), source, batch_id)

    def remove(self, documents: DataFrame) -> bool:
        return self.table.delete(documents)

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """All postings, or those in the folders of ``terms`` (term). The folders' numbers, at most ``buckets``, are looked up first."""
        if not self.table.versions():
            return self.spark.createDataFrame([], "term string, document_id long, chunk_index int, positions array<int>, tf long")
        rows = self.table.read()
        if terms is not None:
            wanted = [r[0] for r in terms.select(self.bucket(F.col("term"))).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(wanted))
        return rows.drop("bucket")
