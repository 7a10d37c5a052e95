"""Catalogue of documents: listings, details, state changes, cascading deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.referential import purge_rows

# Progress shown for each status.
PROGRESS = {"pending": 0, "processing": 50, "ready": 75, "indexed": 100, "error": 0}
# Display classes by mime type.
CLASSES = {"application/pdf": "pdf", "text/csv": "spreadsheet", "application/vnd.ms-excel": "spreadsheet",
           "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "spreadsheet", "image/png": "image", "image/jpeg": "image", "image/tiff": "image"}


def list_documents(documents: DataFrame, user: str, project: str | None = None, status: str | None = None, mime: str | None = None,
                   page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of a user's documents, newest first (ties by id); at most 100 a page."""
    out = documents.filter(F.col("uploaded_by") == user)
    for column, value in (("project_id", project), ("status", status), ("mime_type", mime)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    size = min(per_page, 100)
    return out.orderBy(F.desc("created_at"), "document_id").offset((page - 1) * size).limit(size)


def display_class(mime):
    out = None
    for k, v in CLASSES.items():
        out = F.when(mime == k, v) if out is None else out.when(mime == k, v)
    return out.otherwise("text")


def filter_sort_documents(documents: DataFrame, text: str | None = None, klass: str | None = None, sort: str = "newest") -> DataFrame:
    """Documents whose name contains the text, of one display class, with their place in the chosen order."""
    out = documents.withColumn("name", F.coalesce("display_name", "filename"))
    if text:
        out = out.filter(F.contains(F.lower("name"), F.lit(text.lower())))
    if klass:
        out = out.filter(display_class(F.col("mime_type")) == klass)
    order = {"newest": [F.desc("created_at")], "oldest": [F.asc("created_at")], "name": [F.lower("name")]}[sort]
    return out.orderBy(*order, "document_id")


def document_detail(documents: DataFrame, users: DataFrame, chunks: DataFrame, preview: int = 500) -> DataFrame:
    """Uploader, and for documents that are ready or indexed the first chunk's beginning, embedded chunks and the model."""
    first = chunks.groupBy("document_id").agg(F.min_by("content", "chunk_index").alias("_first"), F.count("embedding").alias("_embedded"), F.max("embedding_model").alias("_model"))
    live = F.col("status").isin("ready", "indexed")
    out = documents.join(users.select(F.col("user_id").alias("uploaded_by"), F.col("full_name").alias("uploader")), "uploaded_by", "left").join(first, "document_id", "left")
    return out.select("document_id", "uploader", "status", F.when(live, F.substring("_first", 1, preview)).alias("preview"),
                      F.when(live, F.coalesce("_embedded", F.lit(0))).alias("embedded_chunks"), F.when(live, F.col("_model")).alias("embedding_model"))


def document_status(documents: DataFrame) -> DataFrame:
    progress = F.lit(0)
    for status, value in PROGRESS.items():
        progress = F.when(F.col("status") == status, value).otherwise(progress)
    return documents.select("document_id", "status", progress.alias("progress"))


def failed_documents(documents: DataFrame) -> DataFrame:
    return documents.filter("status = 'error' or (status = 'ready' and embedding_status = 'error')")


def plan_retries(documents: DataFrame) -> DataFrame:
    """What to do with each document when a retry is asked for, and the new values of its fields."""
    failed, re_embed = F.col("status") == "error", (F.col("status") == "ready") & (F.col("embedding_status") == "error")
    stored = ~F.startswith("file_key", F.lit("pending/"))
    action = F.when(re_embed, "re_embed").when(failed & ~stored, "reject_file_not_ready").when(failed, "re_parse").otherwise("reject")
    out = documents.select("document_id", "status", "embedding_status", action.alias("action"))
    return out.select("document_id", "action", F.when(F.col("action") == "re_parse", "processing").otherwise(F.col("status")).alias("status"),
                      F.when(F.col("action") == "re_parse", "pending").when(F.col("action") == "re_embed", "generating").otherwise(F.col("embedding_status")).alias("embedding_status"))


def list_chunks(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The first n (at most 200) chunks of each document."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= min(n, 200)).drop("_r")


def purge(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Delete users (user_id), and with them what their keys reach, see ``referential.purge_rows``; audit rows stay without their user."""
    return purge_rows(tables, {"users": users})


def clear_history(history: DataFrame, users: DataFrame) -> DataFrame:
    return purge({"history": history}, users)["history"]


def usage_summary(users: DataFrame, documents: DataFrame, queries: DataFrame, as_of: str) -> DataFrame:
    """Documents, stored bytes and queries of the month for each user; zero where there are none."""
    docs = documents.groupBy(F.col("uploaded_by").alias("user_id")).agg(F.count(F.lit(1)).alias("documents"), F.sum("file_size_bytes").alias("storage_bytes"))
    now = F.lit(as_of).cast("timestamp_ntz")
    month = queries.filter((F.col("created_at") >= F.date_trunc("month", now)) & (F.col("created_at") <= now))
    asked = month.groupBy("user_id").agg(F.count(F.lit(1)).alias("queries_this_month"))
    out = users.select("user_id").join(docs, "user_id", "left").join(asked, "user_id", "left")
    return out.select("user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "storage_bytes", "queries_this_month")])


def project_summary(projects: DataFrame, documents: DataFrame) -> DataFrame:
    counts = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("document_count"))
    out = projects.filter(~F.col("is_archived")).join(counts, "project_id", "left")
    return out.select("project_id", "owner_id", "name", F.coalesce("document_count", F.lit(0)).alias("document_count"))


def apply_document_updates(documents: DataFrame, patches: DataFrame) -> DataFrame:
    """patches (document_id, project_id, status): a value that is given replaces the old one, null keeps it."""
    p = patches.select("document_id", F.col("project_id").alias("_project"), F.col("status").alias("_status"))
    return (documents.join(p, "document_id", "left").withColumn("project_id", F.coalesce("_project", "project_id"))
            .withColumn("status", F.coalesce("_status", "status")).drop("_project", "_status"))


def readiness(documents: DataFrame) -> DataFrame:
    out = documents.groupBy("uploaded_by").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "indexed").alias("indexed"))
    return out.withColumn("still_indexing", (F.col("total") > 0) & (F.col("indexed") == 0))


def processing_durations(documents: DataFrame) -> DataFrame:
    """Seconds from start to completion by mime type: median and maximum over documents that have both times."""
    spent = documents.filter("processing_started_at is not null and processing_completed_at is not null").withColumn(
        "_s", F.unix_seconds(F.col("processing_completed_at").cast("timestamp")) - F.unix_seconds(F.col("processing_started_at").cast("timestamp")))
    return spent.groupBy("mime_type").agg(F.count(F.lit(1)).alias("documents"), F.percentile("_s", 0.5).alias("median_seconds"), F.max("_s").alias("max_seconds"))


def status_transitions(snapshots: DataFrame) -> DataFrame:
    """(document_id, seen_at, status) -> the first time each document is seen as indexed or failed after another status."""
    w = Window.partitionBy("document_id").orderBy("seen_at")
    done = F.col("status").isin("indexed", "error")
    rows = snapshots.withColumn("_before", F.lag("status").over(w)).filter(done & (F.col("_before").isNull() | (F.col("_before") != F.col("status"))))
    return rows.groupBy("document_id", "status").agg(F.min("seen_at").alias("seen_at"))
