"""Profiling of tabular files at corpus scale, over long cell grids (dataset, row_no, col_no, value) of many files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import CUT, DATE_COLUMN, LAB_PATTERNS, LAB_UNITS, cut_at_marks

DELIMITERS = [",", ";", "\t", "|"]
# Numbers as they appear in cells, and names of identifier columns.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
HEADER_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?$"
ID_COLUMN = r"(?i)(mrn|patient[_\s]?id|subject[_\s]?id|patient[_\s]?no)"
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd"]


def filled(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def looks_numeric(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(NUMBER), F.lit(False))


def number(value: Column) -> Column:
    return F.when(looks_numeric(value), F.trim(value).try_cast("double"))


def sniff_delimiter(lines: DataFrame, sample: int = 10) -> DataFrame:
    """(dataset, line_no, line) -> (dataset, delimiter): of the first lines that are no comments, the candidate whose count per line is most
    consistent (most lines with the commonest non-zero count, then the higher count, then the earlier candidate); a comma if none occurs."""
    w = Window.partitionBy("dataset").orderBy("line_no")
    head = lines.filter(~F.ltrim("line").startswith("#")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
    candidates = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]))
    counted = head.select("dataset", "line", candidates.alias("c")).withColumn("n", F.length("line") - F.length(F.replace("line", F.col("c.d"), F.lit(""))))
    same = counted.filter("n > 0").groupBy("dataset", "c", "n").agg(F.count(F.lit(1)).alias("k"))
    best = same.groupBy("dataset").agg(F.max_by("c.d", F.struct("k", "n", -F.col("c.no"))).alias("_d"))
    return lines.select("dataset").distinct().join(best, "dataset", "left").select("dataset", F.coalesce("_d", F.lit(",")).alias("delimiter"))


def _after_quotes(text: Column, delimiter: Column, inside: bool, cells: bool) -> Column:
    """The state of a CSV reader after ``text``, which begins inside a quoted field or at the start of a record: a fold over the pieces
    between quotes. A quote opens at the start of a field, closes inside of one, opens again right after it closed (a doubled quote), and
    is a plain character elsewhere. With ``cells`` the state holds the text too, in pieces with CUT for each delimiter that cuts."""
    pieces = F.split(text, '"', -1)
    head = F.get(pieces, F.lit(0))
    state = [F.concat(delimiter, head).alias("prev"), F.lit(inside).alias("inside"), F.lit(False).alias("closed")]

    def step(acc: Column, piece: Column) -> Column:
        starts = F.endswith(acc["prev"], delimiter)
        opens = ~acc["inside"] & (starts | (acc["closed"] & (acc["prev"] == "")))
        after = [piece.alias("prev"), opens.alias("inside"), acc["inside"].alias("closed")]
        if cells:
            mark = F.when(~acc["inside"] & ~starts, '"').otherwise("")
            shown = F.concat(mark, F.when(opens, piece).otherwise(F.replace(piece, delimiter, F.lit(CUT))))
            after.append(F.concat(acc["out"], F.array(shown)).alias("out"))
        return F.struct(*after)

    if cells:
        state.append(F.array(F.replace(head, delimiter, F.lit(CUT))).alias("out"))
    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.struct(*state), step)


def open_after(line: Column, delimiter: Column, inside: bool) -> Column:
    """Whether a quoted field is open after the line, which begins inside of one or not."""
    return F.when(F.contains(line, F.lit('"')), _after_quotes(line, delimiter, inside, False)["inside"]).otherwise(F.lit(inside))


def split_quoted(record: Column, delimiter: Column) -> Column:
    """Cells of a record: a delimiter inside a quoted field does not cut, doubled quotes inside of it are one."""
    def mark(text: Column) -> Column:
        quoted = F.array_join(_after_quotes(text, delimiter, False, True)["out"], "")
        return F.when(F.contains(text, F.lit('"')), quoted).otherwise(F.replace(text, delimiter, F.lit(CUT)))

    return cut_at_marks(record, mark)


def records(lines: DataFrame, delimiters: DataFrame, block_lines: int = 1024) -> DataFrame:
    """(dataset, line_no, line) -> (dataset, delimiter, line_no of the first line, record): lines that a quoted field goes on over are put
    together, without the line ends; comment lines are dropped first, also those inside of a quoted field.

    A line either keeps the reader's state, turns it over or sets it, so a block of lines is known by what it does to either state. Blocks
    are summed up by themselves; one row for each block then passes the state, and the line where the open record began, from block to
    block. A field that is never closed goes on to the end of its dataset. Lines that are null are dropped."""
    rows = lines.filter(~F.ltrim("line").startswith("#")).join(delimiters, "dataset").withColumn("_block", F.floor(F.col("line_no") / block_lines))
    line, mark = F.col("line"), F.col("delimiter")
    rows = rows.withColumns({"_a": open_after(line, mark, False), "_b": open_after(line, mark, True)})
    w = Window.partitionBy("dataset", "_block").orderBy("line_no")
    rows = rows.withColumn("_turns", F.count_if(F.col("_a") & ~F.col("_b")).over(w))
    rows = rows.withColumn("_set", F.last(F.when(F.col("_a") == F.col("_b"), F.struct("_a", "_turns")), ignorenulls=True).over(w))
    odd = (F.col("_turns") - F.coalesce("_set._turns", F.lit(0))) % 2 == 1
    rows = rows.withColumns({f"_open{i}": F.coalesce("_set._a", F.lit(bool(i))) != odd for i in (0, 1)})
    # the first line of the record that each line belongs to, if the block begins outside (0) or inside (1) of a field
    flags = rows.withColumns({f"_start{i}": F.when(~F.lag(f"_open{i}", 1, bool(i)).over(w), F.col("line_no")) for i in (0, 1)})
    rows = flags.withColumns({f"_from{i}": F.last(f"_start{i}", ignorenulls=True).over(w) for i in (0, 1)})
    ends = rows.groupBy("dataset", "_block").agg(F.max_by(F.struct("_open0", "_open1", "_from0", "_from1"), "line_no").alias("e"))
    before = Window.partitionBy("dataset").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ends.select("dataset", "_block", "e._open0", "e._open1", "e._from0", "e._from1")
    blocks = blocks.withColumn("_t", F.count_if(F.col("_open0") & ~F.col("_open1")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("_s", F.last(F.when(F.col("_open0") == F.col("_open1"), F.struct(F.col("_open0").alias("v"), "_t")), ignorenulls=True).over(before))
    passed = F.coalesce(F.lag("_t").over(Window.partitionBy("dataset").orderBy("_block")), F.lit(0)) - F.coalesce("_s._t", F.lit(0))
    blocks = blocks.withColumn("_in", F.coalesce("_s.v", F.lit(False)) != (passed % 2 == 1))
    blocks = blocks.withColumn("_carried", F.last(F.when(F.col("_in"), F.col("_from1")).otherwise(F.col("_from0")), ignorenulls=True).over(before))
    rows = rows.join(blocks.select("dataset", "_block", "_in", "_carried"), ["dataset", "_block"])
    first = F.coalesce(F.when(F.col("_in"), F.col("_from1")).otherwise(F.col("_from0")), "_carried")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = rows.select("dataset", "delimiter", first.alias("_first"), "line_no", "line").groupBy("dataset", "delimiter", "_first").agg(parts.alias("_p"))
    return out.select("dataset", "delimiter", F.col("_first").alias("line_no"), F.array_join("_p.line", "").alias("record"))


def text_to_grid(lines: DataFrame, delimiters: DataFrame, block_lines: int = 1024) -> DataFrame:
    """Lines to cells: comment lines and rows without any filled cell are dropped; rows are numbered from 1 in what remains. Rows are numbered
    within blocks of lines, after the counts of the blocks before, so that a large dataset is not sorted in one task."""
    rows = records(lines, delimiters, block_lines).withColumn("_c", split_quoted(F.col("record"), F.col("delimiter")))
    rows = rows.filter(F.exists("_c", lambda c: F.trim(c) != "")).select("dataset", "line_no", F.floor(F.col("line_no") / block_lines).alias("_block"), "_c")
    before = Window.partitionBy("dataset").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("dataset", "_block").agg(F.count(F.lit(1)).alias("_n")).select("dataset", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("dataset", "_block").orderBy("line_no"))
    cells = rows.withColumn("_r", place).join(counts, ["dataset", "_block"]).withColumn("row_no", (F.col("_before") + F.col("_r")).cast("int"))
    return cells.select("dataset", "row_no", F.posexplode("_c").alias("_i", "value")).select("dataset", "row_no", (F.col("_i") + 1).alias("col_no"), "value")


def caption_rows(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells without caption rows, captions): rows of at least two filled cells, all equal, over at least 60 % of the columns."""
    v = F.when(filled(F.col("value")), F.trim("value"))
    rows = cells.groupBy("dataset", "row_no").agg(F.count(v).alias("_n"), F.countDistinct(v).alias("_d"), F.count(F.lit(1)).alias("_w"), F.min(v).alias("caption"))
    captions = rows.filter("_n >= 2 and _d = 1 and _n >= 0.6 * _w").select("dataset", "row_no", "caption")
    return cells.join(captions.select("dataset", "row_no"), ["dataset", "row_no"], "left_anti"), captions


def detect_header_rows(cells: DataFrame) -> DataFrame:
    """(dataset, header_rows 0, 1 or 2). A row is no header if over 30 % of its filled cells are numbers. Otherwise the columns whose next
    rows (up to row 11) are numbers by 70 % vote: a label above numbers for, a number above numbers against. Ties: yes for the first row, no for the second."""
    top = cells.filter((F.col("row_no") <= 11) & filled(F.col("value"))).withColumn("num", F.trim("value").rlike(HEADER_NUMBER).cast("int"))

    def verdict(r: int, default: bool) -> DataFrame:
        own = top.filter(F.col("row_no") == r).select("dataset", "col_no", F.col("num").alias("own"))
        below = top.filter(F.col("row_no") > r).groupBy("dataset", "col_no").agg(F.avg("num").alias("share"))
        j = own.join(below, ["dataset", "col_no"], "left").withColumn("_nc", F.coalesce(F.col("share") >= 0.7, F.lit(False)))
        s = j.groupBy("dataset").agg(F.avg("own").alias("numeric"), F.count_if(F.col("_nc") & (F.col("own") == 0)).alias("yes"), F.count_if(F.col("_nc") & (F.col("own") == 1)).alias("no"))
        vote = F.when((F.col("yes") == 0) & (F.col("no") == 0), F.lit(default)).otherwise(F.col("yes") >= F.col("no") if default else F.col("yes") > F.col("no"))
        return s.select("dataset", ((F.col("numeric") <= 0.3) & vote).alias(f"h{r}"))

    first, second = verdict(1, True), verdict(2, False)
    out = cells.select("dataset").distinct().join(first, "dataset", "left").join(second, "dataset", "left")
    return out.select("dataset", F.when(~F.coalesce("h1", F.lit(False)), 0).when(F.coalesce("h2", F.lit(False)), 2).otherwise(1).alias("header_rows"))


def name_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(dataset, col_no, column_name): header cells joined by an underscore, Column_i where blank, repeated names numbered."""
    head = cells.join(headers, "dataset").filter((F.col("row_no") <= F.col("header_rows")) & filled(F.col("value")))
    parts = head.groupBy("dataset", "col_no").agg(F.array_sort(F.collect_list(F.struct("row_no", F.trim("value").alias("v")))).alias("_p"))
    named = cells.select("dataset", "col_no").distinct().join(parts, ["dataset", "col_no"], "left").withColumn(
        "_b", F.coalesce(F.array_join(F.transform("_p", lambda p: p["v"]), "_"), F.concat(F.lit("Column_"), F.col("col_no").cast("string"))))
    w = Window.partitionBy("dataset", "_b").orderBy("col_no")
    n = F.row_number().over(w) - 1
    return named.withColumn("_n", n).select("dataset", "col_no", F.when(F.col("_n") == 0, F.col("_b")).otherwise(F.concat("_b", F.lit("_"), F.col("_n").cast("string"))).alias("column_name"))


def data_cells(cells: DataFrame, headers: DataFrame, names: DataFrame) -> DataFrame:
    """Cells below the header rows with the names of their columns; blank cells are null."""
    body = cells.join(headers, "dataset").filter(F.col("row_no") > F.col("header_rows")).drop("header_rows")
    return body.join(names, ["dataset", "col_no"]).withColumn("value", F.when(filled(F.col("value")), F.col("value")))


_COLUMN = ["dataset", "col_no", "column_name"]


def infer_numeric_columns(cells: DataFrame, share: float = 0.9) -> DataFrame:
    """(dataset, col_no, column_name, ratio, is_numeric): by 90 % or more of the non-null cells."""
    out = cells.groupBy(*_COLUMN).agg(F.count("value").alias("_n"), F.count(number(F.col("value"))).alias("_k"))
    ratio = F.when(F.col("_n") > 0, F.col("_k") / F.col("_n"))
    return out.select(*_COLUMN, F.round(ratio, 6).alias("ratio"), F.coalesce(ratio >= share, F.lit(False)).alias("is_numeric"))


def parsed_date(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def infer_date_columns(cells: DataFrame, share: float = 0.8) -> DataFrame:
    """Columns named like dates, or (unless numeric) parsed as dates by 80 %, with their range; columns without a date are left out."""
    numeric = infer_numeric_columns(cells).select("dataset", "col_no", "is_numeric")
    d = parsed_date(F.col("value"))
    out = cells.groupBy(*_COLUMN).agg(F.count("value").alias("_n"), F.count(d).alias("_k"), F.min(d).alias("min_date"), F.max(d).alias("max_date"))
    named = F.col("column_name").rlike(DATE_COLUMN)
    out = out.join(numeric, ["dataset", "col_no"]).filter((F.col("_k") > 0) & (named | (~F.col("is_numeric") & (F.col("_k") >= share * F.col("_n")))))
    return out.select(*_COLUMN, "min_date", "max_date")


def detect_lab_columns(cells: DataFrame, sample: int = 20) -> DataFrame:
    """Columns with a unit in the name, or a value with a unit among the first non-null cells."""
    w = Window.partitionBy("dataset", "col_no").orderBy("row_no")
    head = cells.filter("value is not null").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
    by_value = head.filter(F.col("value").rlike(LAB_PATTERNS["cell"])).select(*_COLUMN)
    by_name = cells.filter(F.col("column_name").rlike(f"(?i)({LAB_UNITS})")).select(*_COLUMN)
    return by_value.unionByName(by_name).distinct()


def detect_id_columns(columns: DataFrame) -> DataFrame:
    return columns.select(*_COLUMN).distinct().filter(F.col("column_name").rlike(ID_COLUMN))


def numeric_profile(cells: DataFrame) -> DataFrame:
    numeric = infer_numeric_columns(cells).filter("is_numeric").select("dataset", "col_no")
    v = number(F.col("value"))
    return cells.join(numeric, ["dataset", "col_no"], "left_semi").groupBy(*_COLUMN).agg(
        F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"), F.round(F.avg(v), 4).alias("mean"))


def significant(v: Column, digits: int = 4) -> Column:
    """A number with this many significant digits, without zeros at its end; with an exponent below 1e-4 and from 10 ** digits on."""
    s = F.format_string(f"%.{digits - 1}e", v)
    exponent = F.substring_index(s, "e", -1).cast("int")
    bare = F.concat(F.regexp_replace(F.substring_index(s, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(s, "e", -1))
    return F.when((exponent < -4) | (exponent >= digits), bare).otherwise(F.regexp_replace(s.cast("decimal(38,12)").cast("string"), r"\.?0+$", ""))


def _plain(v: Column) -> Column:
    """A number of at most four decimals, at least one of them shown."""
    return F.regexp_replace(F.regexp_replace(v.cast("decimal(38,4)").cast("string"), "0+$", ""), r"\.$", ".0")


def column_summary(cells: DataFrame) -> DataFrame:
    """One line for each column: no data, a date range, a numeric range, or distinct values and the commonest one (ties: the smallest)."""
    v = number(F.col("value"))
    stats = cells.groupBy(*_COLUMN).agg(F.count("value").alias("_n"), F.countDistinct("value").alias("_d"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    w = Window.partitionBy("dataset", "col_no").orderBy(F.desc("_c"), "value")
    common = cells.filter("value is not null").groupBy("dataset", "col_no", "value").agg(F.count(F.lit(1)).alias("_c")).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    out = stats.join(common.select("dataset", "col_no", F.col("value").alias("_v"), "_c"), ["dataset", "col_no"], "left")
    out = out.join(infer_numeric_columns(cells).select(*_COLUMN, "is_numeric"), _COLUMN, "left").join(infer_date_columns(cells), _COLUMN, "left")
    text = (F.when(F.col("_n") == 0, "no data").when(F.col("min_date").isNotNull(), F.format_string("date range %s to %s", F.col("min_date").cast("string"), F.col("max_date").cast("string")))
            .when(F.col("is_numeric"), F.concat(F.lit("min="), significant(F.col("min")), F.lit(", max="), significant(F.col("max")), F.lit(", mean="), significant(F.col("mean"))))
            .otherwise(F.concat(F.col("_d").cast("string"), F.lit(" unique values; most common: '"), F.col("_v"), F.lit("' ("), F.col("_c").cast("string"), F.lit("x)"))))
    return out.select(*_COLUMN, F.concat("column_name", F.lit(": "), text).alias("summary"))


def render_markdown_table(cells: DataFrame) -> DataFrame:
    """(dataset, markdown) of grids whose first row is the header: white space squeezed, bars escaped, short rows padded."""
    width = cells.groupBy("dataset").agg(F.max("col_no").cast("int").alias("_w"))
    clean = F.replace(F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    rows = cells.select("dataset", "row_no", F.col("col_no").cast("int").alias("col_no"), clean.alias("v")).join(width, "dataset")
    rows = rows.groupBy("dataset", "row_no", "_w").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "v"))).alias("_m"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("_w")), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(""))), " | "), F.lit(" |"))
    lines = rows.select("dataset", "row_no", "_w", line.alias("line"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_w")), " | "), F.lit(" |"))
    ordered = lines.groupBy("dataset", "_w").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]).alias("_l"))
    return ordered.select("dataset", F.array_join(F.concat(F.slice("_l", 1, 1), F.array(rule), F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))), "\n").alias("markdown"))


def dataset_report(cells: DataFrame, full_limit: int = 500, preview: int = 100) -> DataFrame:
    """(dataset, report): head lines, then the whole table if it has at most full_limit rows, else its first rows and the column summaries.

    cells: named data cells (dataset, row_no, col_no, column_name, value)."""
    shape = cells.groupBy("dataset").agg(F.countDistinct("row_no").alias("_rows"), F.countDistinct("col_no").alias("_cols"), F.min("row_no").alias("_first"))
    names = cells.select(*_COLUMN).distinct()
    columns = names.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("col_no", "column_name"))).alias("_names"))
    limit = F.when(F.col("_rows") <= full_limit, F.col("_rows")).otherwise(F.lit(preview))
    w = Window.partitionBy("dataset", "col_no").orderBy("row_no")
    shown = cells.withColumn("_r", F.row_number().over(w)).join(shape, "dataset").filter(F.col("_r") <= limit)
    grid = shown.select("dataset", F.col("_r").cast("long").alias("row_no"), "col_no", "value").unionByName(
        names.select("dataset", F.lit(0).cast("long").alias("row_no"), "col_no", F.col("column_name").alias("value")))
    lines = column_summary(cells).groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("col_no", "summary"))).alias("_s"))
    numbers = numeric_profile(cells).withColumn("_line", F.concat(F.lit("\n  - "), "column_name", F.lit(": min="), _plain(F.col("min")), F.lit(", max="), _plain(F.col("max")), F.lit(", mean="), _plain(F.col("mean"))))
    dates = infer_date_columns(cells).withColumn("_line", F.concat("column_name", F.lit(": "), F.col("min_date").cast("string"), F.lit(" to "), F.col("max_date").cast("string")))
    listed = lambda df, name: df.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "_line"))), lambda x: x["_line"]).alias(name))
    out = shape.join(columns, "dataset").join(render_markdown_table(grid), "dataset").join(lines, "dataset").join(listed(numbers, "_numbers"), "dataset", "left").join(listed(dates, "_dates"), "dataset", "left")
    head = F.concat(F.lit("Dataset: "), "dataset", F.lit("\nRows: "), F.col("_rows").cast("string"), F.lit(" | Columns: "), F.col("_cols").cast("string"), F.lit("\nColumns: "),
                    F.array_join(F.transform("_names", lambda x: x["column_name"]), ", "), F.coalesce(F.concat(F.lit("\nNumeric columns:"), F.array_join("_numbers", "")), F.lit("")),
                    F.lit("\nDate range: "), F.coalesce(F.array_join("_dates", "; "), F.lit("none detected")))
    cut = F.concat(F.lit(f"First {preview} of "), F.col("_rows").cast("string"), F.lit(" rows:\n"), "markdown", F.lit("\n\nColumn summaries (all columns):\n"),
                   F.array_join(F.transform("_s", lambda x: F.concat(F.lit("  - "), x["summary"])), "\n"))
    return out.select("dataset", F.concat(head, F.lit("\n\n"), F.when(F.col("_rows") <= full_limit, F.col("markdown")).otherwise(cut)).alias("report"))


def profile_rollup(profiles: DataFrame) -> DataFrame:
    """(workbook, dataset, row_count, columns array) -> (workbook, datasets, row_count, columns): union of columns, sum of rows."""
    return profiles.groupBy("workbook").agg(F.count(F.lit(1)).alias("datasets"), F.sum("row_count").alias("row_count"),
                                            F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))
