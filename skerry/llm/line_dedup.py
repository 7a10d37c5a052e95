"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line stripped of ASCII white space and with A-Z lower-cased. The documents come in batches; each batch
counts its keys' documents, merge-anti-joins the keys that the runs already know to be frequent, and adds its own counts as
a new sorted run. When a level holds ``fanout`` runs they are compacted into one run of the next level. Keys found in at
least ``min_docs`` documents lose all their lines in every document.

Two 32/64-bit hashes (96 bits together) stand for a key, so no text is shuffled for counting. Runs are tables bucketed and sorted
by the hashes, so runs are merged bucket by bucket without an exchange. With a ``store`` folder the runs outlive the call: a
later call opens them, and its lines count together with those of all calls before.

Defined results: null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped; a document is a
doc_id (null counts as one id), so repeated rows of an id count once and all get the same treatment (an id that comes again in a
later call to a store counts again); an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import ASCII_SPACE, Scratch, ascii_lower, checkpointed, children, delete, table

KEY = ["_h1", "_h2"]


class LevelledRuns:
    """Sorted runs of (key hashes, number of documents) in levels, as bucketed tables in a folder.

    A run's folder is run-LEVEL-FIRST-LAST-BUCKETS: it holds the batches FIRST to LAST. A compacted run is written before the runs that
    it replaces are removed; a run whose batches a higher level has is ignored, so a compaction that was cut off does no harm."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int = 3, buckets: int = 0):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"skerry_{uuid.uuid4().hex}"
        found = [tuple(int(x) for x in m.groups()) for n in children(spark, folder) if (m := re.fullmatch(r"run-(\d+)-(\d+)-(\d+)-(\d+)", n))
                 and "_SUCCESS" in children(spark, f"{folder}/{n}")]
        live = [r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]
        self.buckets = live[0][3] if live else max(1, buckets or self.partitions)
        self.runs: list[tuple[int, int, int]] = sorted(r[:3] for r in live)  # level, first and last batch
        self.next = max([r[2] + 1 for r in live], default=0)
        for r in self.runs:
            spark.sql(f"create table {self._table(r)} (_h1 bigint, _h2 int, _docs bigint) using parquet clustered by (_h1, _h2) sorted by (_h1, _h2) "
                      f"into {self.buckets} buckets location '{self._path(r)}'")

    def _table(self, run: tuple) -> str:
        return f"{self.prefix}_{'_'.join(map(str, run))}"

    def _path(self, run: tuple) -> str:
        return f"{self.folder}/run-{'-'.join(map(str, run))}-{self.buckets}"

    def _write(self, counts: DataFrame, table_name: str, path: str) -> None:
        if self.buckets != self.partitions:  # else an aggregation has dealt the keys to the buckets already
            counts = counts.repartition(self.buckets, *KEY)
        counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table_name)

    def _add_run(self, counts: DataFrame, run: tuple) -> None:
        self._write(counts, self._table(run), self._path(run))
        self.runs.append(run)

    def merged(self, runs: list[tuple] | None = None) -> DataFrame | None:
        """Runs (all of them by default) as one: counts of equal keys add up. The tables' buckets need no exchange."""
        # the filter lets nothing go; with it the union is one of rows, which keeps buckets together (one of column batches does not)
        tables = [self.spark.table(self._table(r)).filter("_docs > 0") for r in (self.runs if runs is None else runs)]
        if not tables:
            return None
        return reduce(DataFrame.unionByName, tables).groupBy(*KEY).agg(F.sum("_docs").alias("_docs"))

    def frequent(self, name: str) -> DataFrame | None:
        """Keys of at least min_docs documents, written as a bucketed table."""
        merged = self.merged()
        if merged is None:
            return None
        self._write(merged.filter(F.col("_docs") >= self.min_docs), f"{self.prefix}_{name}", f"{self.folder}/{self.prefix}-{name}")
        return self.spark.table(f"{self.prefix}_{name}").select(*KEY)

    def drop_frequent(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {self.prefix}_{name}")
        delete(self.spark, f"{self.folder}/{self.prefix}-{name}")

    def add(self, counts: DataFrame) -> None:
        """Add a batch: keys already known as frequent need no more counting, the others form a new run."""
        known = self.frequent("known")
        if known is not None:
            counts = counts.join(known.hint("merge"), KEY, "left_anti")
        self._add_run(counts, (0, self.next, self.next))
        if known is not None:
            self.drop_frequent("known")
        self.next, level = self.next + 1, 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self._add_run(self.merged(full), (level + 1, min(r[1] for r in full), max(r[2] for r in full)))
            for r in full:
                self.runs.remove(r)
                self.spark.sql(f"drop table {self._table(r)}")
                delete(self.spark, self._path(r))
            level += 1

    def close(self) -> None:
        """Forget the tables; their files stay in the folder."""
        for r in self.runs:
            self.spark.sql(f"drop table if exists {self._table(r)}")


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64(text).alias("_th"),
        F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"),
    )
    return rows.withColumn("_key", ascii_lower(F.btrim("_line", F.lit(ASCII_SPACE))))


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, store: str | None = None) -> DataFrame:
    """(_id, _th, _drop): for each document (id and hash of its text) the positions of its dropped lines, checkpointed."""
    spark = docs.sparkSession
    with Scratch(spark, "line-dedup") as scratch:
        keyed = _lines(docs).filter(F.char_length("_key") >= min_chars).select(
            "_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.hash("_key").alias("_h2"),
            F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int").alias("_batch"),
        )
        keyed = scratch.write(keyed, "lines", ["_batch"])
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(keyed.count() // 2_000_000, 100_000))
        runs = LevelledRuns(spark, store or f"{scratch.path}/runs", min_docs, fanout, buckets)
        try:
            for b in range(batches):
                batch = keyed.filter(F.col("_batch") == b)
                # distinct first: a line that a third of the documents share is spread by its document ids
                once = batch.select(*KEY, "_id").distinct()
                runs.add(once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_docs")))
            # written first, so that the join either broadcasts it (its file size is known) or splits the lines of a hot key
            hits = keyed.join(runs.frequent("all"), KEY, "left_semi")
            return checkpointed(hits.groupBy("_id", "_th").agg(F.collect_set("_pos").alias("_drop")))
        finally:
            runs.drop_frequent("all")
            runs.close()


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, store: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_lines`` (before dropping) and ``n_dropped`` (both long) added.

    Columns of ``docs`` with those two names are replaced. ``store``: a folder of runs to count with and to add to.
    """
    drop = dropped_lines(docs, min_docs, min_chars, batches, fanout, store)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text")]
    drop = drop.select(F.col("_id").alias("_skerry_id"), F.col("_th").alias("_skerry_th"), F.col("_drop").alias("_skerry_drop"))
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.withColumn("_skerry_text", text).withColumn("_skerry_hash", F.xxhash64(text))
    out = left.join(drop, F.col("doc_id").eqNullSafe(F.col("_skerry_id")) & (F.col("_skerry_hash") == F.col("_skerry_th")), "left")
    text, dropped = F.col("_skerry_text"), F.col("_skerry_drop")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.when(dropped.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        kept.alias("text"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP9_SQL = r"""
with l as (
  select doc_id, generate_subscripts(s, 1) as pos, unnest(s) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)
), k as (
  select doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
), hot as (
  select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10
), f as (
  select k.*, hot.key is not null as dropped from k left join hot on k.key = hot.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from f group by doc_id
"""
