"""Streaming and incremental jobs: what happens between arrivals of files, chunks and searches.

Sinks are versioned tables: a batch replaces exactly the rows of its own keys in one commit, named by the stream's checkpoint and
the batch id, so a batch that is delivered twice is written once, and writes as much as it brings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skerry.functions.text import clean_documents, json_profile, markdown_to_text
from skerry.operators import tabular
from skerry.operators.chunking import ChunkingConfig, chunk_documents
from skerry.operators.embedding import embed_chunks, without_vectors
from skerry.operators.monitoring import TAIL, alert_level
from skerry.sources.shared import cut_lineage
from skerry.sources.uploads import decode_corpus, mime_of, validate_uploads
from skerry.sources.versioned import VersionedTable

UPLOAD = "path string, modificationTime timestamp, length long, content binary"


def table_pages(texts: DataFrame) -> DataFrame:
    """(document_id, text) of delimited files -> (document_id, text): the report of each as its one page."""
    lines = texts.select(F.col("document_id").alias("dataset"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    grid, _ = tabular.caption_rows(cut_lineage(tabular.text_to_grid(lines, tabular.sniff_delimiter(lines))))
    grid = cut_lineage(grid)
    headers = cut_lineage(tabular.detect_header_rows(grid))
    cells = cut_lineage(tabular.data_cells(grid, headers, tabular.name_columns(grid, headers)))
    return tabular.dataset_report(cells).select(F.col("dataset").alias("document_id"), F.col("report").alias("text"))


# Names of JSON types in the summaries.
JSON_TYPES = {"object": "dict", "array": "list", "string": "str", "boolean": "bool", "integer": "int", "number": "float", "null": "NoneType"}


def json_pages(texts: DataFrame) -> DataFrame:
    """(document_id, text) of JSON files -> a summary of the top level (keys in alphabetical order), a blank line, and the text; files that
    are no JSON stay texts."""
    def named(kinds):
        for kind, name in JSON_TYPES.items():
            kinds = F.regexp_replace(kinds, rf"\b{kind}\b", name)
        return kinds

    line = F.concat(F.lit("\n  - "), F.col("key"), F.lit(": "), named(F.col("type")))
    facts = json_profile(texts).groupBy("document_id").agg(
        F.first("kind").alias("_kind"), F.first("key").alias("_n"), F.first("type").alias("_types"), F.array_join(F.array_sort(F.collect_list(line)), "").alias("_keys"))
    head = (F.when(F.col("_kind") == "object", F.concat(F.lit("Top-level keys:"), "_keys"))
            .when(F.col("_kind") == "array", F.concat(F.lit("Top-level: a list of "), "_n", F.lit(" items (element types: "), F.coalesce(F.nullif(named(F.col("_types")), F.lit("")), F.lit("none")), F.lit(")")))
            .when(F.col("_kind") == "scalar", F.concat(F.lit("Top-level value type: "), named(F.col("_types")))))
    return texts.join(facts, "document_id", "left").select("document_id", F.concat_ws("\n\n", head, "text").alias("text"))


#: Types with a rule of their own: markdown without its marks, JSON with a summary, delimited files as reports. All others stay as they are.
TEXT_RULES: dict[str, Callable[[Column], Column]] = {"text/markdown": markdown_to_text}
PAGE_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"application/json": json_pages, "text/csv": table_pages}


def upload_pages(decoded: DataFrame, present: set[str]) -> DataFrame:
    """(document_id, mime_type, text) -> (document_id, page_number, text), by the rule of each type. ``decoded`` is read once, and once more
    for each type with a page rule that is ``present``: of those alone the texts are written down meanwhile, as their rules read them several times."""
    text = F.col("text")
    for kind, rule in TEXT_RULES.items():
        text = F.when(F.col("mime_type") == kind, rule(F.col("text"))).otherwise(text)
    parts = [rule(cut_lineage(decoded.filter(F.col("mime_type") == kind).select("document_id", "text"))) for kind, rule in PAGE_RULES.items() if kind in present]
    parts.append(decoded.filter(~F.col("mime_type").isin(list(PAGE_RULES))).select("document_id", text.alias("text")))
    return reduce(DataFrame.unionByName, parts).select("document_id", F.lit(1).alias("page_number"), "text")


def ingest_batch(uploads: DataFrame, table: VersionedTable, config: ChunkingConfig, source: str | None = None, batch_id: int | None = None) -> bool:
    """(path, length, content) -> chunks in ``table``; a document that is rejected now, or has no text any more, loses its chunks. False if
    the batch was in already."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    named = uploads.withColumns({"filename": name, "size_bytes": F.col("length"), "mime_type": mime_of(name)})
    fine = validate_uploads(named).filter("reject_code is null")
    present = {r[0] for r in fine.select("mime_type").distinct().collect()}  # a handful of allowed types
    pages = clean_documents(upload_pages(decode_corpus(fine, "mime_type").withColumnRenamed("path", "document_id"), present))
    chunks = chunk_documents(pages, config, dealt_by=("document_id",))  # one page each
    return table.commit(chunks, uploads.select(F.col("path").alias("document_id")), source, batch_id)


def stream_ingest(spark: SparkSession, source: str | DataFrame, sink: str, checkpoint: str, config: ChunkingConfig = ChunkingConfig()) -> StreamingQuery:
    """New files of a folder (or a stream of path, length, content): check, decode, clean, chunk, replace by document. Runs until all present
    files are done; read the sink with ``VersionedTable(spark, sink).read()``."""
    files = spark.readStream.format("binaryFile").schema(UPLOAD).load(source) if isinstance(source, str) else source
    table = VersionedTable(spark, sink)

    def run(batch: DataFrame, batch_id: int) -> None:
        # texts that were exchanged go when their batch is written, not when the driver happens to collect its garbage; a stream has its own session
        batch.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        ingest_batch(batch, table, config, checkpoint, batch_id)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_embed(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, encoder: Callable | None = None) -> StreamingQuery:
    """Embed chunks that have no vector in the sink yet; can be stopped and started again."""
    table = VersionedTable(spark, sink, keys=("chunk_id",))

    def run(batch: DataFrame, batch_id: int) -> None:
        chunks = batch.dropDuplicates(["chunk_id"])
        todo = without_vectors(chunks, table.read()) if table.versions() else chunks
        table.commit(embed_chunks(todo, encoder), None, checkpoint, batch_id)

    return (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latency_alerts(logs: DataFrame, key: str = "user_id", n: int = TAIL) -> DataFrame:
    """A stream of logs (key, event_id, created_at, search_time_ms) -> (key, event_id, mean_ms, level) after each search: a ring of the last
    n times is the state of each key. Rows of one micro-batch are taken in time order."""
    def update(keys: tuple, frames, state):
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["created_at", "event_id"])
        out = []
        for event, ms in zip(rows["event_id"], rows["search_time_ms"]):
            ring = (ring + [int(ms)])[-n:]
            out.append((keys[0], event, round(sum(ring) / len(ring), 6)))
        state.update((ring,))
        yield pd.DataFrame(out, columns=[key, "event_id", "mean_ms"])

    kind = dict(logs.dtypes)[key]
    out = logs.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, event_id long, mean_ms double", "ring array<long>", "append", "NoTimeout")
    return out.withColumn("level", alert_level(F.col("mean_ms")))


def stream_status_transitions(snapshots: DataFrame) -> DataFrame:
    """A stream of (document_id, seen_at, status) -> the first time each document is indexed or failed."""
    def update(keys: tuple, frames, state):
        last, told = (state.get[0], state.get[1]) if state.exists else (None, [])
        told = list(told)
        rows = pd.concat(list(frames)).sort_values("seen_at")
        out = []
        for at, status in zip(rows["seen_at"], rows["status"]):
            if status in ("indexed", "error") and status != last and status not in told:
                told.append(status)
                out.append((keys[0], status, at))
            last = status
        state.update((last, told))
        yield pd.DataFrame(out, columns=["document_id", "status", "seen_at"])

    kinds = dict(snapshots.dtypes)
    schema = f"document_id {kinds['document_id']}, status string, seen_at {kinds['seen_at']}"
    return snapshots.groupBy("document_id").applyInPandasWithState(update, schema, "last string, told array<string>", "append", "NoTimeout")


def in_event_order(stream: DataFrame, key: str, at: str, fields: list[str], memory: str, start: tuple, step: Callable, schema: str,
                   delay: str, idle_ms: int, buckets: int = 1024) -> DataFrame:
    """Apply ``step(memory, micros, *fields) -> (memory, rows)`` to the rows of each key in the order of their time (then of the fields), across
    micro-batches: the result is that of one batch over all rows, in whatever batches they come.

    A row waits in the state until the watermark (the latest time seen, less ``delay``) reaches it, as no earlier row can come after that;
    a timer lets it go when no more rows come. Rows that come behind the watermark are dropped, rows without a time too. A key
    without rows for more than ``idle_ms`` of event time starts anew, so that its memory can go once the watermark is that far. Null fields
    are handed on as None.

    Keys are dealt into ``buckets`` by their hash, and a state holds those of a bucket: each call of Python costs milliseconds, so that a state
    for each key would take longer than its rows. A state holds what its keys get within the delay, and their memories."""
    kinds = dict(stream.dtypes)
    columns = ["_key", "_us", *fields]
    width, held_kinds = len(columns), [kinds[key], "long", *(kinds[f] for f in fields)]
    memories = StructType.fromDDL(memory).fields
    kept_schema = ", ".join(f"_m{i} array<{f.dataType.simpleString()}>" for i, f in enumerate(memories))
    state_schema = ", ".join([*(f"_h{i} array<{k}>" for i, k in enumerate(held_kinds)), f"_known array<{kinds[key]}>", "_last array<bigint>", kept_schema])
    names = [c.split()[0] for c in schema.split(", ")]

    def update(keys: tuple, frames, state):
        held, kept = [], {}
        if state.exists:
            parts = state.get
            held = list(zip(*parts[:width]))
            kept = {k: (last, tuple(m)) for k, last, *m in zip(*parts[width:])}
        if not state.hasTimedOut:
            for frame in frames:
                held += [tuple(r[c] for c in columns) for r in frame["_row"]]
        held.sort(key=lambda r: [(x is not None, x) for x in r[1:]])
        mark, out = state.getCurrentWatermarkMs(), []
        ready = sum(r[1] <= mark * 1000 for r in held)
        for own, *row in held[:ready]:
            last, before = kept.get(own, (row[0], start))
            after, rows = step(before if row[0] - last <= idle_ms * 1000 else start, *row)
            out += [(own, *r) for r in rows]
            kept[own] = (row[0], tuple(after))
        held = held[ready:]
        waiting = {r[0] for r in held}
        # timers are met by watermarks after them
        kept = {k: x for k, x in kept.items() if k in waiting or x[0] // 1000 + idle_ms >= mark}
        if held or kept:
            state.update((*([r[i] for r in held] for i in range(width)), list(kept), [x[0] for x in kept.values()],
                          *([x[1][i] for x in kept.values()] for i in range(len(memories)))))
            due = (held[0][1] - 1) // 1000 if held else min(x[0] for x in kept.values()) // 1000 + idle_ms
            state.setTimeoutTimestamp(max(due, mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    timed = stream.filter(F.col(at).isNotNull()).withWatermark(at, delay)
    row = F.struct(F.col(key).alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"), *fields)
    dealt = timed.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket"), at, row.alias("_row"))
    return dealt.groupBy("_bucket").applyInPandasWithState(update, schema, state_schema, "append", "EventTimeTimeout")


def ordered_latency_alerts(logs: DataFrame, delay: str, idle_ms: int = 7 * 86_400_000, key: str = "user_id", n: int = TAIL) -> DataFrame:
    """``latency_alerts`` by event time: a search that comes late, but within the delay, takes the place that its time gives it. Searches
    without a time in milliseconds are left out."""
    def step(memory: tuple, micros: int, event: int, ms: int) -> tuple:
        ring = [*memory[0], int(ms)][-n:]
        return (ring,), [(event, round(sum(ring) / len(ring), 6))]

    timed = logs.filter(F.col("search_time_ms").isNotNull())
    out = in_event_order(timed, key, "created_at", ["event_id", "search_time_ms"], "ring array<long>", ([],), step, f"{key} {dict(logs.dtypes)[key]}, event_id long, mean_ms double", delay, idle_ms)
    return out.withColumn("level", alert_level(F.col("mean_ms")))


def ordered_status_transitions(snapshots: DataFrame, delay: str, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """``stream_status_transitions`` by event time; snapshots of equal time are taken in the order of their status."""
    def step(memory: tuple, micros: int, status: str) -> tuple:
        last, told = memory[0], list(memory[1])
        new = status in ("indexed", "error") and status != last and status not in told
        return (status, told + [status] * new), [(status, micros)] * new

    schema = f"document_id {dict(snapshots.dtypes)['document_id']}, status string, _at long"
    out = in_event_order(snapshots, "document_id", "seen_at", ["status"], "last string, told array<string>", (None, []), step, schema, delay, idle_ms)
    return out.select("document_id", "status", F.timestamp_micros("_at").alias("seen_at"))
