"""Deletion over a graph of keys: what goes, or loses a reference, when rows of any table are deleted."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources.shared import cut_lineage


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    cascade: bool  # else the reference is set to null


# The tables' own keys, and their references with what a deletion does to them.
PRIMARY = {"users": "user_id", "projects": "project_id", "documents": "document_id", "logs": "event_id"}
FOREIGN = [
    ForeignKey("projects", "owner_id", "users", True), ForeignKey("memberships", "project_id", "projects", True), ForeignKey("memberships", "user_id", "users", True),
    ForeignKey("documents", "uploaded_by", "users", True), ForeignKey("documents", "project_id", "projects", False), ForeignKey("chunks", "document_id", "documents", True),
    ForeignKey("costs", "document_id", "documents", True), ForeignKey("costs", "user_id", "users", True), ForeignKey("queries", "user_id", "users", True),
    ForeignKey("queries", "project_id", "projects", False), ForeignKey("queries", "search_log_id", "logs", False), ForeignKey("history", "user_id", "users", True),
    ForeignKey("history", "project_id", "projects", False), ForeignKey("logs", "user_id", "users", True), ForeignKey("logs", "project_id", "projects", False),
    ForeignKey("audit", "user_id", "users", False),
]


def deleted_keys(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], foreign: list[ForeignKey], primary: dict[str, str]) -> dict[str, DataFrame]:
    """The keys (k) of each table that go: those of ``doomed`` (a table's key column), and, round by round until no new one is found, those of
    rows that refer to them by a cascading key. Only keys are joined, and each round joins those of the last one alone; cycles end,
    as a key counts once."""
    gone = {t: cut_lineage(rows.select(F.col(primary[t]).alias("k")).filter("k is not null").distinct()) for t, rows in doomed.items()}
    fresh = dict(gone)
    while fresh:
        found: dict[str, DataFrame] = {}
        for key in foreign:
            if key.cascade and key.parent in fresh and key.child in tables and key.child in primary:
                hit = tables[key.child].select(F.col(key.column).alias("k"), F.col(primary[key.child]).alias("_own")).join(fresh[key.parent], "k", "left_semi")
                hit = hit.select(F.col("_own").alias("k"))
                found[key.child] = found[key.child].unionByName(hit) if key.child in found else hit
        fresh = {}
        for table, keys in found.items():
            new = keys.filter("k is not null").distinct()
            new = cut_lineage(new.join(gone[table], "k", "left_anti") if table in gone else new)
            if not new.isEmpty():
                fresh[table] = new
                gone[table] = cut_lineage(gone[table].unionByName(new)) if table in gone else new
    return gone


def purge_rows(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], foreign: list[ForeignKey] = FOREIGN, primary: dict[str, str] = PRIMARY) -> dict[str, DataFrame]:
    """The tables after rows are deleted: ``doomed`` names tables and has their keys (other columns are ignored; keys that do not exist delete
    nothing, but references to them). Rows that refer to a deleted row go or lose the reference, as the key says; null references
    point at nothing. A table that others refer to need not be among ``tables``, but rows behind a missing one are found only through
    their own references. Columns stay in their order."""
    gone = deleted_keys(tables, doomed, foreign, primary)
    out = {}
    for name, rows in tables.items():
        left = rows
        if name in gone:
            left = left.join(gone[name].withColumnRenamed("k", primary[name]), primary[name], "left_anti")
        for key in foreign:
            if key.child != name or key.parent not in gone or key.column not in rows.columns:
                continue
            ends = gone[key.parent].select(F.col("k").alias(key.column))
            if key.cascade:
                left = left.join(ends, key.column, "left_anti")
            else:
                left = left.join(ends.withColumn("_gone", F.lit(True)), key.column, "left").withColumn(
                    key.column, F.when(F.col("_gone").isNull(), F.col(key.column))).drop("_gone")
        out[name] = left.select(*rows.columns)
    return out
