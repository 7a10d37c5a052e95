"""Streaming jobs run over the test tables until they have caught up; their results equal those of the batch twins."""

from pyspark.sql import functions as F

from skerry.operators.chunking import ChunkingConfig
from skerry.plans import catalog_queries
from skerry.plans.views import duck, load_table, v_chunks
from skerry.sources.shared import cut_lineage, new_folder, remove_folder
from skerry.sources.versioned import VersionedTable
from skerry.streaming import jobs


DAY_US = 86_400_000_000


def _stream(spark, d, name):
    """A table as a stream, be it one file or a folder of files: as a pattern, since a stream takes a plain path for a folder."""
    return spark.readStream.schema(load_table(spark, d, name).schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def _events(spark, d):
    """The events table as a stream of search logs."""
    return _stream(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") * 100).cast("int").alias("search_time_ms"), F.col("ts").cast("timestamp").alias("created_at"))


def _kept(spark, rows, folder):
    """The rows, checkpointed; the folder that they came from is removed."""
    out = cut_lineage(rows)
    remove_folder(spark, folder)
    return out


def _caught_up(spark, stream, name):
    """What a stream gives when all present input is done."""
    out = new_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _kept(spark, spark.read.schema(stream.schema).parquet(f"{out}/rows"), out)


def stream_latency_alert(spark, d):
    return _caught_up(spark, jobs.latency_alerts(_events(spark, d)), "alerts")


def stream_status_transitions(spark, d):
    statuses = F.array(*[F.lit(s) for s in ("pending", "processing", "ready", "indexed", "error")])
    seen = _events(spark, d).select(F.col("user_id").alias("document_id"), F.col("created_at").alias("seen_at"), F.get(statuses, (F.col("event_id") % 5).cast("int")).alias("status"))
    return _caught_up(spark, jobs.stream_status_transitions(seen), "transitions").withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


def _out_of_order(spark, d, name, job):
    """The events in six deliveries, each up to a day out of order, to a stream that goes on after each of them; what it has told by then.
    Events of the last day still wait for the watermark."""
    base, events = new_folder(spark, name), load_table(spark, d, "events")
    late = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(DAY_US))
    parts = events.select("event_id", "user_id", F.floor(F.col("value") * 100).cast("int").alias("search_time_ms"), F.col("ts").cast("timestamp").alias("created_at"),
                          F.floor(late / (5 * DAY_US)).alias("part"))
    parts.write.partitionBy("part").parquet(f"{base}/parts")
    for part in sorted(r[0] for r in spark.read.parquet(f"{base}/parts").select("part").distinct().collect()):  # one for each five days
        spark.read.parquet(f"{base}/parts").filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/arrived")
        stream = job(spark.readStream.schema(parts.drop("part").schema).parquet(f"{base}/arrived"))
        query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        query.start().awaitTermination()
    return _kept(spark, spark.read.parquet(f"{base}/rows"), base)


def stream_latency_ordered(spark, d):
    return _out_of_order(spark, d, "ordered_alerts", lambda rows: jobs.ordered_latency_alerts(rows, "1 day", 60 * DAY_US // 1000))


def stream_status_ordered(spark, d):
    statuses = F.array(*[F.lit(s) for s in ("pending", "processing", "ready", "indexed", "error")])

    def job(rows):
        seen = rows.select(F.col("user_id").alias("document_id"), F.col("created_at").alias("seen_at"), F.get(statuses, (F.col("event_id") % 5).cast("int")).alias("status"))
        return jobs.ordered_status_transitions(seen, "1 day", 60 * DAY_US // 1000)

    return _out_of_order(spark, d, "ordered_transitions", job).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


def stream_embed(spark, d):
    """Chunks arrive in two deliveries, the second with some of the first again; every chunk gets one vector."""
    base = new_folder(spark, "embed")
    chunks = v_chunks(spark, d).selectExpr("document_id * 1048576 + chunk_index as chunk_id", "document_id", "chunk_index", "content")
    schema = "chunk_id long, document_id long, chunk_index int, content string"
    for part in ("chunk_index < 4", "chunk_index >= 3"):
        chunks.filter(part).write.mode("append").parquet(f"{base}/chunks")
        jobs.stream_embed(spark, f"{base}/chunks", schema, f"{base}/vectors", f"{base}/state").awaitTermination()
    vectors = VersionedTable(spark, f"{base}/vectors", keys=("chunk_id",)).read()
    return _kept(spark, vectors.select("chunk_id", "embed_ok", F.size("embedding").alias("width")), base)


def stream_ingest(spark, d):
    """The documents as a stream of uploads of three types, delivered, then all delivered again by another stream: their chunks."""
    base = new_folder(spark, "ingest")
    docs = _stream(spark, d, "documents")
    name = F.concat(F.lit("/up/"), F.col("doc_id"), F.get(F.array(*[F.lit(x) for x in (".txt", ".md", ".pdf")]), (F.col("doc_id") % 3).cast("int")))
    files = docs.select(name.alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "utf-8").alias("content"))
    for checkpoint in ("first", "again"):
        jobs.stream_ingest(spark, files, f"{base}/chunks", f"{base}/{checkpoint}", ChunkingConfig()).awaitTermination()
    table = VersionedTable(spark, f"{base}/chunks")
    table.drop_replaced()
    table.vacuum()
    return table.read().select("document_id", "chunk_index", "chunk_type", "token_count", "content")  # the table is the result: no copy of it


def versioned_rows(spark, d):
    """Lines of documents in a versioned table: a delivery, new texts for a third of the documents, the same batch once more, a deletion, and
    a last delivery that brings some back; with merges of segments on the way."""
    base, lines = new_folder(spark, "versioned"), v_chunks(spark, d)
    table = VersionedTable(spark, base, fanout=3)
    changed = lines.filter("document_id % 3 = 0 and chunk_index <= 5").withColumn("content", F.concat(F.lit("* "), "content"))
    table.commit(lines.filter("document_id % 4 <> 3"), source="s", batch_id=0)
    for _ in range(2):
        table.commit(changed, source="s", batch_id=1)
    table.delete(lines.filter("document_id % 10 = 7").select("document_id").distinct(), "s", 2)
    table.commit(lines.filter("document_id % 4 = 3"), source="s", batch_id=3)
    return _kept(spark, table.read(), base)


QUERIES = {f.__name__: f for f in (stream_latency_alert, stream_status_transitions, stream_latency_ordered, stream_status_ordered, stream_embed, stream_ingest, versioned_rows)}
_TOLD = "(select date_trunc('milliseconds', max(ts)) - interval 1 day from events)"
SQL = {
    "stream_latency_alert": catalog_queries.SQL["search_latency_alert"].replace("select event_id, user_id, mean_ms,", "select user_id, event_id, mean_ms,"),
    "stream_status_transitions": catalog_queries.SQL["status_transitions"],
    "stream_latency_ordered": f"select r.* from ({catalog_queries.SQL['search_latency_alert']}) r join events using (event_id) where ts <= {_TOLD}",
    "stream_status_ordered": f"select * from ({catalog_queries.SQL['status_transitions']}) where seen_at <= {_TOLD}",
    "stream_embed": """select document_id * 1048576 + row_number() over (partition by document_id order by pos) - 1 as chunk_id, true as embed_ok, 384 as width
        from (select doc_id as document_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as content from documents) where trim(content) <> ''""",
    "versioned_rows": duck("""select document_id, chunk_index, case when changed then concat('* ', content) else content end as content
        from (select *, document_id % 4 <> 3 and document_id % 3 = 0 as changed from v_chunks)
        where (document_id % 4 = 3 or document_id % 10 <> 7) and (not changed or chunk_index <= 5)""", "v_chunks"),
}
