"""Delimited text whose quoted fields go on over lines, compared with Python's reader."""

import csv
import random

from skerry.operators import tabular


def grid(spark, files, block_lines):
    lines = spark.createDataFrame([(name, i, x) for name, xs in files.items() for i, x in enumerate(xs)], "dataset string, line_no long, line string")
    delimiters = spark.createDataFrame([(name, ";" if name.endswith("1") else ",") for name in files], "dataset string, delimiter string")
    out = {name: {} for name in files}
    for r in tabular.text_to_grid(lines, delimiters, block_lines).collect():
        out[r.dataset].setdefault(r.row_no, {})[r.col_no] = r.value
    return {name: [[row[c] for c in sorted(row)] for _, row in sorted(rows.items())] for name, rows in out.items()}


def read(name, lines):
    kept = [x for x in lines if not x.lstrip(" ").startswith("#")]
    return [row for row in csv.reader(kept, delimiter=";" if name.endswith("1") else ",") if any(c.strip(" ") for c in row)]


def test_random_quotes_over_lines_and_blocks(spark):
    rng = random.Random(4)
    files = {f"f{i}": ["".join(rng.choices('ab",; #', weights=[4, 2, 3, 3, 2, 1, 1], k=rng.randrange(9))) for _ in range(rng.randrange(1, 40))] for i in range(60)}
    for block_lines in (1, 4, 1024):
        got = grid(spark, files, block_lines)
        for name, lines in files.items():
            assert got[name] == read(name, lines), (block_lines, name, lines)


def test_long_fields_and_odd_input(spark):
    files = {"long": ["1,\"begin", *["line %d, with a \"\"word\"\"" % i for i in range(300)], "end\",last", "2,x,y"], "open": ["1,\"never closed", "a,b", "c"],
             "blank": ["", " , ", ""], "comment": ["1,\"a", " # gone", "b\",2", "#3,4"], "inner": ["5\" pipe,6\" pipe", "\"a\"b,c", "\"\"\"\",\"\""]}
    got = grid(spark, files, 16)
    assert got == {name: read(name, lines) for name, lines in files.items()}
    assert len(got["long"]) == 2 and len(got["open"]) == 1 and got["blank"] == [] and got["comment"] == [["1", "ab", "2"]]
    empty = spark.createDataFrame([], "dataset string, line_no long, line string")
    assert tabular.text_to_grid(empty, spark.createDataFrame([], "dataset string, delimiter string")).count() == 0
