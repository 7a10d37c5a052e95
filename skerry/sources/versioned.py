"""Tables whose rows are replaced by key, in append-only segments that a manifest lists.

A commit writes the rows of its keys into a new folder and then puts a new manifest beside the old ones by one rename that fails
if the name is taken; nothing that was written before is touched, so a commit costs what its own batch costs. A reader takes
the newest manifest and, of each key, only the rows of its newest segment. Segments are merged in levels: as soon as ``fanout``
of one level are there, they become one of the next, without the rows that newer segments replace.

    rows/_segment=<name>    the batch's rows, with _seq, the number of their commit; in folders by a column and sorted if a layout is given
    keys/_segment=<name>    each key of the batch once: keys, _seq, _gone (deleted)
    manifests/v<version>    {"version", "next", "applied": {source: last batch id}, "segments": [{"name", "level", "bytes"}], "schema"}

A commit that names its source and batch id is applied once: ids of a source rise, as those of a stream do, and an id that is
not above the last one applied changes nothing. A commit that is cut off before the rename leaves a folder that no manifest
lists; ``vacuum`` removes it. Two commits at a time: one of them raises ``ConcurrentCommit`` and can be tried again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skerry.sources.shared import cut_lineage

#: Up to so many replaced keys (some 40 bytes each) are broadcast to the rows, counted beforehand; more of them are joined by exchange.
BROADCAST_KEYS = 500_000


class ConcurrentCommit(RuntimeError):
    """Another commit took the next version."""


def _joined(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Joined on equal columns, null with null; the sides are called l and r."""
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    return left.alias("l").join(right.alias("r"), same, how)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("document_id",), fanout: int = 8, folder_by: str | None = None, sort_by: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.fanout, self.folder_by, self.sort_by = spark, path.rstrip("/"), list(keys), fanout, folder_by, list(sort_by)

    # --- files ---

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        target, fs = self._hadoop(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []

    def _delete(self, path: str) -> None:
        target, fs = self._hadoop(path)
        fs.delete(target, True)

    def _bytes(self, name: str) -> int:
        found = [self._hadoop(f"{self.path}/{part}/_segment={name}") for part in ("rows", "keys")]
        return sum(fs.getContentSummary(target).getLength() for target, fs in found)

    # --- manifests ---

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in self._names("manifests") if n.startswith("v") and n[1:].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; one without segments if there is none yet."""
        found = self.versions()
        if version is None and not found:
            return {"version": -1, "next": 0, "applied": {}, "segments": [], "schema": None}
        target, fs = self._hadoop(f"{self.path}/manifests/v{max(found) if version is None else version:010d}")
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        """Make ``manifest`` the newest one: written aside, then renamed to a name that must be free."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        side, fs = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(side, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        target, _ = self._hadoop(f"{self.path}/manifests/v{manifest['version']:010d}")
        none = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(side.toUri(), self.spark._jsc.hadoopConfiguration()).rename(side, target, none)
        except Exception as e:
            fs.delete(side, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommit(f"version {manifest['version']} of {self.path} is taken") from e
            raise

    # --- writing ---

    def commit(self, rows: DataFrame, touched: DataFrame | None = None, source: str | None = None, batch_id: int | None = None, gone: bool = False) -> bool:
        """Replace what the table has of the keys of ``rows``. ``touched`` names keys beyond them: those without rows lose what they had.
        False, and nothing written, if this source's batch is in already."""
        base = self.manifest()
        if source is not None and batch_id is not None and base["applied"].get(source, -1) >= batch_id:
            return False
        name, seq = f"s{base['next']:010d}-{uuid.uuid4().hex}", base["next"]
        self._write(rows.withColumn("_seq", F.lit(seq).cast("long")), name)
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/_segment={name}").select(*self.keys)
        keys = written if touched is None else written.unionByName(touched.select(*self.keys))
        keys.distinct().select(*self.keys, F.lit(seq).cast("long").alias("_seq"), F.lit(gone).alias("_gone")).write.parquet(f"{self.path}/keys/_segment={name}")
        applied = base["applied"] | ({source: batch_id} if source is not None and batch_id is not None else {})
        self._swap({"version": base["version"] + 1, "next": seq + 1, "applied": applied, "schema": base["schema"] or rows.schema.jsonValue(),
                    "segments": [*base["segments"], {"name": name, "level": 0, "bytes": self._bytes(name)}]})
        self.compact()
        return True

    def _write(self, rows: DataFrame, name: str) -> None:
        if self.folder_by:
            rows = rows.repartition(self.folder_by).sortWithinPartitions(self.folder_by, *self.sort_by)
        rows.write.option("compression", "zstd").partitionBy(*([self.folder_by] if self.folder_by else [])).parquet(f"{self.path}/rows/_segment={name}")

    def delete(self, keys: DataFrame, source: str | None = None, batch_id: int | None = None) -> bool:
        """Remove all rows of these keys."""
        schema = self.schema() or keys.select(*self.keys).schema
        return self.commit(self.spark.createDataFrame([], schema), keys, source, batch_id, gone=True)

    # --- reading ---

    def schema(self, manifest: dict | None = None) -> StructType | None:
        found = (manifest or self.manifest())["schema"]
        return StructType.fromJson(found) if found else None

    def _key_schema(self, manifest: dict) -> StructType:
        whole = self.schema(manifest)
        return StructType([whole[k] for k in self.keys]).add("_seq", "long").add("_gone", "boolean")

    def _all_keys(self, manifest: dict, names: list[str] | None = None) -> DataFrame:
        names = [s["name"] for s in manifest["segments"]] if names is None else names
        return self._listed("keys", self._key_schema(manifest), names)

    def _listed(self, part: str, schema: StructType, names: list[str]) -> DataFrame:
        """Of rows or keys what these segments have, with _segment; folders of others are pruned."""
        return self.spark.read.schema(schema.add("_segment", "string")).parquet(f"{self.path}/{part}").filter(F.col("_segment").isin(names))

    def _marked(self, manifest: dict) -> DataFrame:
        """(keys, _seq, _segment, _replaced, _stale): what newer commits replace, and with it what is deleted. Of keys alone, rows are not read."""
        keys = self._all_keys(manifest)
        last = keys.groupBy(*self.keys).agg(F.max("_seq").alias("_last"), F.max_by("_gone", "_seq").alias("_end"))
        return _joined(keys, last, self.keys, "inner").select(*[F.col(f"l.{k}") for k in self.keys], "_seq", "_segment", F.expr("_seq < _last").alias("_replaced"), F.expr("_seq < _last or _end").alias("_stale"))

    @staticmethod
    def _counts(marked: DataFrame, flag: str) -> dict[str, tuple[int, int]]:
        """Of each segment with keys, how many it has and how many of them have the flag."""
        return {r[0]: (r[1], r[2]) for r in marked.groupBy("_segment").agg(F.count(F.lit(1)), F.count_if(flag)).collect()}

    def _live(self, manifest: dict, names: list[str]) -> DataFrame:
        """Segments of which nothing is stale are read as they are, and those that are stale whole not at all; only what lies between is joined."""
        marked = self._marked(manifest)
        counts = {k: x for k, x in self._counts(marked, "_stale").items() if k in names}
        schema, mixed = self.schema(manifest).add("_seq", "long"), [k for k, (n, stale) in counts.items() if 0 < stale < n]
        rows = self._listed("rows", schema, [k for k in names if not counts.get(k, (0, 0))[1]]).drop("_segment")
        if not mixed:
            return rows
        stale = cut_lineage(marked.filter(F.col("_stale") & F.col("_segment").isin(mixed)).select(*self.keys, "_seq"))
        stale = F.broadcast(stale) if sum(counts[k][1] for k in mixed) <= BROADCAST_KEYS else stale
        return rows.unionByName(_joined(self._listed("rows", schema, mixed).drop("_segment"), stale, [*self.keys, "_seq"], "left_anti"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of every key's newest commit, as of a version. Rows are exchanged only where a segment is replaced in part, and if more
        keys of such segments were replaced since the last merge than may be broadcast."""
        manifest = self.manifest(version)
        if not manifest["segments"]:
            if manifest["schema"] is None:
                raise LookupError(f"nothing was committed to {self.path} yet")
            return self.spark.createDataFrame([], self.schema(manifest))
        return self._live(manifest, [s["name"] for s in manifest["segments"]]).drop("_seq")

    # --- upkeep ---

    def compact(self, everything: bool = False) -> int:
        """Merge levels that are full, lowest first (or all segments): the number of merges. Each row is written again once a level."""
        done = 0
        while True:
            base = self.manifest()
            levels: dict[int, list[dict]] = {}
            for s in base["segments"]:
                levels.setdefault(s["level"], []).append(s)
            full = [k for k in sorted(levels) if len(levels[k]) >= self.fanout]
            some = base["segments"] if everything and not done and len(base["segments"]) > 1 else levels[full[0]] if full else None
            if not some:
                return done
            names, level = [s["name"] for s in some], max(s["level"] for s in some) + 1
            name = f"m{base['version'] + 1:010d}-{uuid.uuid4().hex}"
            self._write(self._live(base, names), name)
            keys = self._all_keys(base, names)
            last = keys.groupBy(*self.keys).agg(F.max_by(F.struct("_seq", "_gone"), "_seq").alias("_x")).select(*self.keys, "_x.*")
            # a deleted key is remembered until there is nothing older that it could hide
            (last.filter("not _gone") if len(some) == len(base["segments"]) else last).write.parquet(f"{self.path}/keys/_segment={name}")
            left = [s for s in base["segments"] if s["name"] not in names]
            self._swap(base | {"version": base["version"] + 1, "segments": [*left, {"name": name, "level": level, "bytes": self._bytes(name)}]})
            done += 1

    def drop_replaced(self) -> list[str]:
        """Leave out segments whose keys newer commits have all replaced, without writing any row; ``vacuum`` removes their folders. Their names."""
        base = self.manifest()
        lost = sorted(k for k, (n, replaced) in self._counts(self._marked(base), "_replaced").items() if n == replaced) if base["segments"] else []
        if lost:
            self._swap(base | {"version": base["version"] + 1, "segments": [s for s in base["segments"] if s["name"] not in lost]})
        return lost

    def vacuum(self, versions: int = 1) -> list[str]:
        """Remove the manifests but the last ``versions``, and folders that those do not list: replaced ones, and those of commits that were
        cut off. Not while a commit is running. The names of removed folders."""
        keep = self.versions()[-versions:]
        listed = {s["name"] for v in keep for s in self.manifest(v)["segments"]}
        for v in self.versions()[:-versions]:
            self._delete(f"{self.path}/manifests/v{v:010d}")
        lost = sorted({n.removeprefix("_segment=") for part in ("rows", "keys") for n in self._names(part) if n.startswith("_segment=")} - listed)
        for n in lost:
            for part in ("rows", "keys"):
                self._delete(f"{self.path}/{part}/_segment={n}")
        return lost
