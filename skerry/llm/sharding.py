"""K-d tree partitioning of documents into shards of near-equal bytes (DataFrame functions only).

A node that must become c shards is cut in two, of c // 2 and c - c // 2 shards, along its widest metadata dimension, at
the weighted quantile of its bytes; so the leaves reach the target of total / shards. The quantile is found without
sorting: a histogram of bytes over the dimension finds the bin of the cut, and a second histogram over a hash of the rows
inside that bin finds the place of the cut there, so ties and groups of equal rows are split too. The driver
only holds the tree: one row for each node.

Defined results: null text has no bytes; null dimensions count as 0, nulls of source and language as one value; empty tables give empty tables; extra
columns do not matter; repeated rows are separate rows, each with its own slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, checkpointed, table

BINS, SUB_BINS = 1024, 8192


def _at(values: Sequence, index: Column, kind: str) -> Column:
    """The value that belongs to a node, from a literal array with one entry for each node of the level."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index)


def _cut(hist: DataFrame, unit: str, targets: Column) -> dict[int, tuple]:
    """For each node, the first unit whose running weight reaches the target: (unit, weight before it, weight with it).
    The histogram has at most nodes x bins rows; one row for each node reaches the driver."""
    w = Window.partitionBy("node").orderBy(unit)
    run = hist.withColumn("cum", F.sum("w").over(w)).withColumn("target", targets)
    first = run.filter(F.col("cum") >= F.col("target")).groupBy("node").agg(F.min(F.struct(unit, "cum", "w")).alias("x"))
    return {r["node"]: (r["x"][unit], r["x"]["cum"] - r["x"]["w"], r["x"]["cum"]) for r in first.collect()}


def kd_shards(rows: DataFrame, dims: Sequence[str], weight: str, shards: int, scratch: Scratch) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) to a table of metadata rows with a long column ``rid``; dims are numeric columns."""
    cur = rows.withColumn("node", F.lit(0))
    want = [shards]
    level = 0
    dim_cols = F.array(*[F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in dims])
    overall = None
    while max(want) > 1:
        stats = cur.groupBy("node").agg(
            F.sum(weight).alias("w"), *[F.min(F.coalesce(F.col(d).cast("double"), F.lit(0.0))).alias(f"lo{i}") for i, d in enumerate(dims)],
            *[F.max(F.coalesce(F.col(d).cast("double"), F.lit(0.0))).alias(f"hi{i}") for i, d in enumerate(dims)]).collect()
        by = {r["node"]: r for r in stats}
        overall = overall or by.get(0)
        if overall is None:
            break
        ndim = range(len(dims))
        dim, lo, hi, target, splits = [], [], [], [], []
        for node, c in enumerate(want):
            r = by.get(node)
            spread = [(r[f"hi{i}"] - r[f"lo{i}"]) / ((overall[f"hi{i}"] - overall[f"lo{i}"]) or 1.0) if r else 0.0 for i in ndim]
            i = max(ndim, key=lambda j: (spread[j], -j))
            dim.append(i)
            lo.append(float(r[f"lo{i}"]) if r else 0.0)
            hi.append(float(r[f"hi{i}"]) if r else 1.0)
            splits.append(c // 2)
            target.append(float(r["w"]) * (c // 2) / c if r and c > 1 else 0.0)
        node = F.col("node")
        x = F.get(dim_cols, _at(dim, node, "int"))
        low, high = _at(lo, node, "double"), _at(hi, node, "double")
        b = F.when(high > low, F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
        sub = F.pmod(F.xxhash64(F.lit(level), F.col("rid")), F.lit(SUB_BINS)).cast("int")
        marked = cur.withColumn("bin", b).withColumn("sub", sub)
        live = marked.filter(_at([c > 1 for c in want], node, "boolean"))
        cuts = _cut(live.groupBy("node", "bin").agg(F.sum(weight).alias("w")), "bin", _at(target, node, "double"))
        cut_bin = [cuts.get(n, (0, 0, 0))[0] for n in range(len(want))]
        inner = [target[n] - float(cuts.get(n, (0, 0, 0))[1]) for n in range(len(want))]
        inside = live.filter(F.col("bin") == _at(cut_bin, node, "int")).groupBy("node", "sub").agg(F.sum(weight).alias("w"))
        subs = _cut(inside, "sub", _at(inner, node, "double"))
        cut_sub = []
        for n in range(len(want)):
            s, before, with_it = subs.get(n, (0, 0, 0))
            cut_sub.append(int(s) if with_it - inner[n] <= inner[n] - before else int(s) - 1)  # the nearer side
        left = (F.col("bin") < _at(cut_bin, node, "int")) | ((F.col("bin") == _at(cut_bin, node, "int")) & (F.col("sub") <= _at(cut_sub, node, "int")))
        first, after = [], []
        for n, c in enumerate(want):
            first.append(len(after))
            after += [c] if c == 1 else [splits[n], c - splits[n]]
        child = _at(first, node, "int") + F.when(_at([c > 1 for c in want], node, "boolean") & ~left, 1).otherwise(0)
        cur = scratch.write(marked.withColumn("node", child).drop("bin", "sub"), f"level{level}")
        if level:
            scratch.drop(f"level{level - 1}")
        want, level = after, level + 1
    return cur.withColumnRenamed("node", "shard")


def _slots(rows: DataFrame, n_rows: int, per_group: int = 200_000) -> DataFrame:
    """Gapless slots from 0 in each shard: rows are numbered in hash groups of bounded size, groups follow each other."""
    groups = max(1, -(-n_rows // per_group))
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    counts = rows.groupBy("shard", "_g").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_g").orderBy("doc_id", "rid")) - 1
    return rows.withColumn("_r", number).join(starts, ["shard", "_g"]).withColumn("slot", (F.col("_start") + F.col("_r")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 40, extra_bytes: int = 16) -> DataFrame:
    """documents -> doc_id, size, text_crc32, shard, slot, checkpointed. Metadata dimensions: document id, size, source, language."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    with Scratch(spark, "sharding") as scratch:
        rows = docs.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id",
            (F.octet_length(text) + extra_bytes).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.log2(F.octet_length(text) + 1).alias("d_size"), F.col("doc_id").cast("double").alias("d_id"),
            F.pmod(F.xxhash64("source"), F.lit(1 << 20)).cast("double").alias("d_source"),
            F.pmod(F.xxhash64("lang"), F.lit(1 << 20)).cast("double").alias("d_lang"),
        )
        rows = scratch.write(rows, "rows")
        out = kd_shards(rows, ["d_id", "d_source", "d_lang", "d_size"], "size", shards, scratch)
        out = _slots(out, rows.count()).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
        return checkpointed(out)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
