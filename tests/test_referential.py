"""Deletion over keys: cycles, missing tables, nulls; digits and lines of tabular reports."""

import pytest
from pyspark.sql import functions as F

from skerry.operators import tabular
from skerry.operators.referential import ForeignKey, purge_rows


def ids(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cascades_set_nulls_and_cycles(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 5), (6, None), (7, 8), (8, 7)], "person long, boss long")
    tools = spark.createDataFrame([("a", 3, 6), ("b", 6, 4), ("c", None, None), ("d", 7, 5)], "tool string, owner long, lender long")
    keys = [ForeignKey("people", "boss", "people", True), ForeignKey("tools", "owner", "people", True), ForeignKey("tools", "lender", "people", False)]
    doom = lambda *x: {"people": spark.createDataFrame([(i,) for i in x], "person long")}
    out = purge_rows({"people": people, "tools": tools}, doom(2), keys, {"people": "person"})
    assert ids(out["people"]) == [(1, None), (5, 5), (6, None), (7, 8), (8, 7)] and ids(out["tools"]) == [("b", 6, None), ("c", None, None), ("d", 7, 5)]
    out = purge_rows({"people": people, "tools": tools}, doom(7, 5, 99), keys, {"people": "person"})
    assert [r[0] for r in ids(out["people"])] == [1, 2, 3, 4, 6] and [r[0] for r in ids(out["tools"])] == ["a", "b", "c"] and out["people"].columns == ["person", "boss"]
    out = purge_rows({"people": people, "tools": tools}, {"people": people.filter("person < 0")}, keys, {"people": "person"})
    assert ids(out["people"]) == ids(people) and ids(out["tools"]) == ids(tools)


def test_tables_that_are_not_given(spark):
    chunks = spark.createDataFrame([(1, 0), (2, 0), (None, 0)], "document_id long, chunk_index int")
    assert ids(purge_rows({"chunks": chunks}, {"documents": spark.createDataFrame([(2,)], "document_id long")})["chunks"]) == [(1, 0), (None, 0)]


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 12345678.9, 0.00001, 0.0001, 0.000123456, 9999.4, 9999.6, 123.456, 1000.0, 1e15, -0.00098765, 99.995, 1 / 3, 2.5e-300, 1.7e308])
def test_numbers_of_four_digits(spark, x):
    assert spark.createDataFrame([(x,)], "x double").select(tabular.significant(F.col("x"))).first()[0] == f"{x:.4g}"


def test_report_of_a_small_table(spark):
    rows = [("name", "age", "visit_date", "empty"), ("ann", "30", "2024-01-05", ""), ("bob", "41.5", "2024-03-01", ""), ("cy", "10000000.25", "2023-12-31", "")]
    cells = spark.createDataFrame([("d", i, j + 1, v) for i, r in enumerate(rows, 1) for j, v in enumerate(r)], "dataset string, row_no long, col_no int, value string")
    headers = tabular.detect_header_rows(cells)
    report = tabular.dataset_report(tabular.data_cells(cells, headers, tabular.name_columns(cells, headers))).first()["report"]
    head = ["Dataset: d", "Rows: 3 | Columns: 4", "Columns: name, age, visit_date, empty", "Numeric columns:", "  - age: min=30.0, max=10000000.25, mean=3333357.25",
            "Date range: visit_date: 2023-12-31 to 2024-03-01", "", "| name | age | visit_date | empty |", "| --- | --- | --- | --- |"]
    assert report.split("\n")[:9] == head
    none = tabular.dataset_report(tabular.data_cells(cells, headers, tabular.name_columns(cells, headers)).filter("col_no = 1")).first()["report"]
    assert "\nDate range: none detected\n" in none and "Numeric columns" not in none
