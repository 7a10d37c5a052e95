"""Near-duplicate detection: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct 5-word shingles (as 64-bit hashes). The sketch places the set's elements into bins in
rounds, each with new hashes; a bin keeps the least value of the first round that reaches it, and after as many rounds as
bins a round aims all elements at one bin, so every coordinate is filled. Rows of equal sets are one class from the start;
classes that agree in a whole band share a bucket. Verification is on full sets, bucket by bucket:

1. every class is compared with the first class of each of its buckets (a pair is compared once, in whatever buckets it is);
2. the connected groups of these links are formed; a bucket whose classes are in one group is done;
3. in the others, the classes outside the bucket's largest group are compared with all of it, but not inside a group. Buckets
   of the same classes count once.

So a bucket costs its size if it holds copies, and chains of buckets are never compared as a whole. Comparisons are dealt in
cells of bounded numbers of documents and of shingles; no pair leaves a task but a spanning forest of its links. The
components of all links are exact for all pairs that share a bucket.

With 24 bands of 4 coordinates a pair at similarity 0.85 shares no bucket with a chance of 2e-8 (3e-6 at 0.8).

Defined results: a row without words (or null) has an empty set and is linked with nothing; with fewer words than a
shingle the whole sequence is the one shingle; each row is judged by its own text, so rows of one doc_id with different texts
may be in different components; a component's id is its smallest doc_id; a null doc_id is linked with nothing and kept;
repeated rows are equal sets; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import Scratch, bounded_arrow, checkpointed, table, text_hash
from skerry.llm.components import components

# Odd multipliers of the hash mixers (golden-ratio style constants; any odd numbers do).
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
FRACTION = np.uint64(40)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(32))) * MIX[3]
        h = (h ^ (h >> np.uint64(29))) * MIX[4]
        return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of UTF-8 text; bytes.split() splits at ASCII white space and lower() folds A-Z only."""
    w = text.lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    size = min(n, words)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for j in range(size):
            out = (out ^ h[j:n - size + 1 + j]) * MIX[j % 5]
            out ^= out >> np.uint64(31)
    return np.unique(mixed(out))


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches [set, bin] of non-empty sets, all sets of a batch together."""
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    flat_out = out.ravel()
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    low = (np.uint64(1) << FRACTION) - np.uint64(1)
    for r in range(2 * bins):
        if not len(flat):
            break
        h = mixed(flat, r + 1)
        if r < bins:
            place = ((h >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
        else:
            place = np.full(len(h), r - bins, np.uint64)
        key = owner.astype(np.uint64) * np.uint64(bins) + place
        # sorted by bin, then value: the first of each bin is its least
        packed = np.sort((key << FRACTION) | (mixed(h, 7) & low))
        bin_of = packed >> FRACTION
        first = np.concatenate([[True], bin_of[1:] != bin_of[:-1]])
        at = bin_of[first].astype(np.int64)
        free = flat_out[at] == np.iinfo(np.uint64).max
        flat_out[at[free]] = (np.uint64(r) << FRACTION) | (packed[first][free] & low)
        open_sets = (out == np.iinfo(np.uint64).max).any(1)
        if not open_sets.all():
            stay = open_sets[owner]
            flat, owner = flat[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = sketch.reshape(len(sketch), bands, rows)
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), bands)).copy()
        for j in range(rows):
            key = mixed(key ^ parts[:, :, j], j + 11)
    return key.view(np.int64)


def _binary(col: pa.Array) -> list[bytes]:
    return col.cast(pa.binary()).to_pylist()


def fingerprints(docs: DataFrame, bands: int, rows: int, words: int = 5) -> DataFrame:
    """doc_id, _th (hash of the text), n_shingles, digest (of the set; null if empty), bands array<long>."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or b"", words) for t in _binary(b.column("text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), bands), np.int64)
            if full:
                keys[full] = band_keys(sketches([sets[i] for i in full], bands * rows), bands, rows)
            digest = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["doc_id", "_th", "n_shingles", "digest", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("_th"), "text")
    return rows_in.mapInArrow(run, "doc_id long, _th long, n_shingles long, digest binary, bands array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """[i, j]: elements that the sorted sets left[i] and right[j] (none empty) have in common."""
    sizes = np.array([len(s) for s in right])
    flat = np.concatenate(right)
    if len(left) == 1:
        at = np.minimum(np.searchsorted(left[0], flat), len(left[0]) - 1)
        return np.add.reduceat((left[0][at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)[None, :]
    own = np.concatenate(left)
    known = np.intersect1d(own, flat)
    out = np.zeros((len(left), len(right)), np.float32)  # counts are small integers: exact in float32 up to 2**24 shingles

    def entries(values: np.ndarray, lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        col = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        row = np.repeat(np.arange(len(lens)), lens)
        keep = known[col] == values if len(known) else np.zeros(len(values), bool)
        order = np.argsort(col[keep], kind="stable")
        return row[keep][order], col[keep][order]

    (r1, c1), (r2, c2) = entries(own, [len(s) for s in left]), entries(flat, sizes)
    for lo in range(0, len(known), columns):
        blocks = []
        for n, r, c in ((len(left), r1, c1), (len(right), r2, c2)):
            a, b = np.searchsorted(c, [lo, lo + columns])
            block = np.zeros((n, min(columns, len(known) - lo)), np.float32)
            block[r[a:b], c[a:b] - lo] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return np.rint(out).astype(np.int64)


def cell_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of labels, of the links (100 * intersection >= percent * union) of left to right rows (node, label,
    shingles) of different labels; nodes of one label count as connected."""
    sets = [[np.frombuffer(s, np.uint64) for s in side["shingles"]] for side in (left, right)]
    sizes = [np.array([len(s) for s in own]) for own in sets]
    common = common_counts(*sets)
    hit = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    labels = left["label"].to_numpy(), right["label"].to_numpy()
    hit &= labels[0][:, None] != labels[1][None, :]
    i, j = np.nonzero(hit)
    ends = np.stack([labels[0][i], labels[1][j]], 1)
    _, one = np.unique(np.sort(ends, 1), axis=0, return_index=True)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for a, b in ends[one].tolist():
        u, v = top(a), top(b)
        if u != v:
            parent[u] = v
            out.append((a, b))
    return out


def cells(members: DataFrame, scratch: Scratch, cell: int, shingles: int) -> DataFrame:
    """members (grp, node, label, n, side) -> the same with k1, k2, k3, the task of a row: in each task some rows of side 0 meet some of
    side 1 of a group, at most about ``cell`` documents and ``shingles`` shingles of each. Small groups share tasks."""
    def share(side: int) -> Column:
        own = F.when(F.col("side") == side, F.col("n"))
        return F.ceil(F.greatest(F.count(own) / cell, F.sum(own) / shingles)).cast("int")

    sizes = members.groupBy("grp").agg(share(0).alias("m0"), share(1).alias("m1")).filter("m0 > 0 and m1 > 0")
    sizes = scratch.write(sizes, "cell-sizes")
    tasks = max(1, (members.agg(F.sum("n")).first()[0] or 0) // shingles)
    placed = members.join(sizes, "grp").withColumn("h", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("m0")).otherwise(F.col("m1"))).cast("int"))
    small = (F.col("m0") == 1) & (F.col("m1") == 1)
    others = F.when(F.col("side") == 0, F.col("m1")).otherwise(F.col("m0"))
    dealt = placed.withColumn("g", F.explode(F.sequence(F.lit(0), others - 1)))
    mine, theirs = F.col("h"), F.col("g")
    return dealt.select(
        "grp", "node", "label", "n", "side", F.when(small, F.lit(-1)).otherwise(F.col("grp")).alias("k1"),
        F.when(small, F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("int")).when(F.col("side") == 0, mine).otherwise(theirs).alias("k2"),
        F.when(small, 0).when(F.col("side") == 0, theirs).otherwise(mine).alias("k3"))


def verified(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the cells as pairs (a, b) of labels; sets: node, shingles."""
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for _, g in pdf.groupby("grp", sort=False):
            left, right = g[g["side"] == 0], g[g["side"] == 1]
            if len(left) and len(right):
                links += cell_links(left, right, percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.join(sets, "node").groupBy("k1", "k2", "k3").applyInPandas(verify, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """nodes (node, doc_id, _th) -> node, shingles (sorted 64-bit hashes), one row for each node. Texts meet the nodes by one exchange,
    whatever the sizes; copies of a row then lie in one partition, and one of them goes on."""
    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or b"", words).tobytes() for t in _binary(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("_th"), "text")
    met = texts.join(nodes.hint("shuffle_hash"), ["doc_id", "_th"]).dropDuplicates(["doc_id", "_th"])
    return met.select("node", "text").mapInArrow(to_sets, "node long, shingles binary")


def first_comparisons(stars: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """stars (node, low: the first node of one of its buckets) -> members of groups: each first node against its followers. Pairs
    whose set sizes cannot be similar enough are left out."""
    low = sizes.select(F.col("node").alias("low"), F.col("n").alias("n_low"))
    pairs = stars.distinct().join(sizes, "node").join(low, "low").filter(F.least("n", "n_low") * 100 >= F.greatest("n", "n_low") * percent)
    spokes = pairs.select(F.col("low").alias("grp"), "node", F.col("node").alias("label"), "n", F.lit(1).alias("side"))
    hubs = pairs.select(F.col("low").alias("grp"), F.col("low").alias("node"), F.col("low").alias("label"), F.col("n_low").alias("n"), F.lit(0).alias("side"))
    return spokes.unionByName(hubs.distinct())


def later_comparisons(banded: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """banded (node, n, band, key) of shared buckets, labels (node, component) of the first links -> members of groups: in buckets with
    several labels, the nodes outside the label of most nodes against all nodes."""
    labelled = banded.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = scratch.write(labelled, "labelled")
    bucket = labelled.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("node").alias("low"),
                                                 F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("nodes"))
    open_ones = bucket.filter("k > 2 and l0 <> l1").groupBy("k", "low", "high", "nodes").agg(F.min(F.struct("band", "key")).alias("one"))
    open_ones = scratch.write(open_ones.select("one.band", "one.key", F.monotonically_increasing_id().alias("grp")), "open")
    rows = labelled.join(open_ones, ["band", "key"])
    most = rows.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.max(F.struct("c", "label")).alias("big"))
    most = scratch.write(most.select("grp", F.col("big.label").alias("big")), "most")
    rows = rows.join(most, "grp").select("grp", "node", "label", "n", "big")
    every = rows.drop("big").withColumn("side", F.lit(1))
    return scratch.write(every.unionByName(rows.filter("label <> big").drop("big").withColumn("side", F.lit(0))), "later")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, bands: int = 24, rows: int = 4, cell: int = 400,
                    cell_shingles: int = 400_000, set_bytes: int = 16 << 20) -> DataFrame:
    """documents -> doc_id, _th (hash of the row's text), n_shingles, component_id, kept (doc_id is the component's), first (the row's text
    and doc_id are the component's first, by doc_id, then hash); checkpointed."""
    spark = docs.sparkSession
    with Scratch(spark, "near-dedup") as scratch:
        prints = scratch.write(fingerprints(docs, bands, rows, words), "prints")
        known = prints.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
        # classes of equal sets: only the digest is shuffled, with partial minima for large classes
        classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "_th")).alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        classes = scratch.write(classes.select("digest", "head"), "classes")
        own = F.struct("doc_id", "_th")
        split = known.join(classes, "digest", "left")
        reps = split.filter(F.col("head").isNull()).unionByName(split.filter(F.col("head") == own).dropDuplicates(["digest"]))
        reps = scratch.write(reps.select(F.monotonically_increasing_id().alias("node"), "doc_id", "_th", "digest", F.col("n_shingles").alias("n"), "bands"), "reps")
        banded = scratch.write(reps.select("node", "n", F.posexplode("bands").alias("band", "key")), "banded")
        buckets = banded.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
        banded = scratch.write(banded.join(buckets.drop("high"), ["band", "key"]), "shared")
        scratch.drop("banded")
        sizes = scratch.write(banded.select("node", "n").distinct(), "sizes")
        nodes = scratch.write(reps.join(sizes, "node", "left_semi").select("node", "doc_id", "_th"), "nodes")
        # bucketed by node once, as two rounds of cells ask for sets by node; some 8 bytes a shingle
        buckets = max(1, -(-8 * (sizes.agg(F.sum("n")).first()[0] or 0) // set_bytes))
        sets = scratch.write_bucketed(_sets(docs, nodes, words).repartition(buckets, "node"), "sets", buckets, ["node"])
        stars = banded.filter("node <> low").select("node", "low")
        members = scratch.write(first_comparisons(stars, sizes, percent), "first")
        links = scratch.write(verified(cells(members, scratch, cell, cell_shingles), sets, percent), "links")
        labels = scratch.write(components(links, scratch, "labels"), "labels")
        later = later_comparisons(banded.drop("low"), labels, scratch)
        more = scratch.write(verified(cells(later, scratch, cell, cell_shingles), sets, percent), "more")
        if not more.isEmpty():
            # components of the labels: what is connected already stays one node
            merged = components(more, scratch, "final").select(F.col("node").alias("component"), F.col("component").alias("final"))
            known_labels = labels.unionByName(merged.select(F.col("component").alias("node"), "component")).distinct()
            labels = scratch.write(known_labels.join(merged, "component", "left").select("node", F.coalesce("final", "component").alias("component")), "joined")
        heads = labels.join(reps.select("node", "digest", F.struct("doc_id", "_th").alias("rep")), "node")
        lowest = heads.groupBy("component").agg(F.min("rep").alias("head_all"))
        fates = heads.join(lowest, "component").select("digest", "head_all")
        # empty sets have no digest, and all of them would meet in one partition
        whole = prints.drop("bands")
        out = whole.filter(F.col("digest").isNotNull()).join(classes, "digest", "left").join(fates, "digest", "left")
        out = out.unionByName(whole.filter(F.col("digest").isNull()), allowMissingColumns=True)
        alone = F.col("digest").isNull() | F.col("doc_id").isNull()
        out = out.withColumn("_head", F.when(alone, own).otherwise(F.coalesce("head_all", "head", own)))
        return checkpointed(out.select(
            "doc_id", "_th", "n_shingles", F.col("_head.doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("_head.doc_id"), F.lit(True)).alias("kept"), (own.eqNullSafe(F.col("_head"))).alias("first")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")
