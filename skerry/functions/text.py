"""Text cleaning and text features as column expressions and group aggregates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[ \t\n\r\f\x0B]"

# Clinical units (longer list for cells and prose, shorter one for chunks).
LAB_UNITS = "mg/dL|mmol/L|g/dL|IU/L|mEq/L|U/L|ng/mL|pg/mL|mIU/L|mcg/mL|µg/dL|ug/dL|mmHg|bpm|kg|cm|mL|%"
CHUNK_UNITS = "mg/dL|mmol/L|IU/L|%|g/L"
# Patterns of values with a unit. Cells and prose reject a letter or digit after the unit.
LAB_PATTERNS = {
    "chunk": rf"(\d+\.?\d*){SPACE}*({CHUNK_UNITS})",
    "cell": rf"(?i)(\d+\.?\d*){SPACE}*({LAB_UNITS})(?![A-Za-z0-9])",
    "prose": rf"(?i)(\d+\.?\d*){SPACE}+({LAB_UNITS})(?![A-Za-z0-9])",
}
# Notebook evidence.
DATE_PATTERN = (r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b")
RESEARCHER_PATTERN = r"(?i)\b(recorded by|performed by|signed|signature|investigator|principal investigator|PI|technician|researcher)\b"
# Control characters that go, and runs of line feeds that become two.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
LINE_FEEDS = r"\n{3,}"
WORD_JOINER = "⁠"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often the body names it. What the body gives is copied."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space (as \\s means it) at both ends: a pattern would be tried at every space in between."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


# Marks for cutting texts by patterns; a mark that a text has itself is escaped meanwhile.
_MARK, CUT, _ESCAPED = "\u0001", "\u0001\u0003", "\u0001\u0002"


def cut_at_marks(text: Column, mark: Callable[[Column], Column]) -> Column:
    """The pieces of text between the CUTs that ``mark`` puts into it; every other character stays."""
    plain = F.split(mark(text), CUT, -1)
    escaped = F.split(mark(F.replace(text, F.lit(_MARK), F.lit(_ESCAPED))), CUT, -1)
    return F.when(F.contains(text, F.lit(_MARK)), F.transform(escaped, lambda p: F.replace(p, F.lit(_ESCAPED), F.lit(_MARK)))).otherwise(plain)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC form. Only texts with non-ASCII characters leave the JVM."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkc(other), text)


def clean_whitespace(text: Column) -> Column:
    """NFKC; no control characters but tab, LF and CR; at most two LF in a row."""
    return F.regexp_replace(F.regexp_replace(nfkc(text), CONTROLS, ""), LINE_FEEDS, "\n\n")


# Markdown constructs and what stays of them, in this order; and marks of which a text must have one for the pattern to fit.
MARKDOWN_RULES = [
    (r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```", "$1", ["```"]),
    (r"`([^`]+)`", "$1", ["`"]),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1", ["!["]),
    (r"\[([^\]]+)\]\([^)]*\)", "$1", ["["]),
    (r"(?m)^#{1,6}\s+(.*)$", "$1", ["#"]),
    (r"(\*\*\*|___)(.+?)\1", "$2", ["***", "___"]),
    (r"(\*\*|__)(.+?)\1", "$2", ["**", "__"]),
    (r"(\*|_)(.+?)\1", "$2", ["*", "_"]),
    (r"(?m)^>\s?", "", [">"]),
    (r"(?m)^\s*([-*_])\1{2,}\s*$", "", ["---", "***", "___"]),
    (r"(?m)^(\s*)([-*+]|\d+\.)\s+", "$1- ", ["-", "*", "+", "."]),
    (r"(?m)^\|?[\s:|-]+\|[\s:|-]*$", "", ["|"]),
    (r"(?m)^\|\s*(.*?)\s*\|$", "$1", ["|"]),
]


def markdown_to_text(text: Column) -> Column:
    def rule(pattern: str, kept: str, marks: list[str]) -> Callable[[Column], Column]:
        return lambda t: F.when(reduce(or_, [F.contains(t, F.lit(m)) for m in marks]), F.regexp_replace(t, pattern, kept)).otherwise(t)

    for pattern, kept, marks in MARKDOWN_RULES:
        text = bind(text, rule(pattern, kept, marks))
    return text


def json_profile(documents: DataFrame, text: str = "text") -> DataFrame:
    """(document_id, kind, key, type): one row for each top-level key of an object, one for an array (key = its length, type = types of its
    first 200 elements) or a scalar; documents that are no JSON have kind ``invalid``."""
    def json_type(v: Column) -> Column:
        s = F.schema_of_variant(v)
        return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
                .when(s == "BIGINT", "integer").when(s == "VOID", "null").otherwise("number"))

    docs = documents.select("document_id", F.col(text).alias("_t"), F.try_parse_json(text).alias("_v"))
    docs = docs.withColumn("_type", F.when(F.col("_v").isNotNull(), json_type(F.col("_v"))))
    objects = docs.filter("_type = 'object'").select("document_id", "_v")
    keys = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    keys = keys.select("document_id", F.lit("object").alias("kind"), "key", json_type(F.col("value")).alias("type"))
    items = docs.filter("_type = 'array'").select("document_id", F.expr("cast(_v as array<variant>)").alias("_a"))
    arrays = items.select("document_id", F.lit("array").alias("kind"), F.size("_a").cast("string").alias("key"),
                          F.array_join(F.array_sort(F.array_distinct(F.transform(F.slice("_a", 1, 200), json_type))), ", ").alias("type"))
    rest = docs.filter("_type is null or _type not in ('object', 'array')").select(
        "document_id", F.when(F.col("_type").isNull(), "invalid").otherwise("scalar").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("_type").alias("type"))
    return keys.unionByName(arrays).unionByName(rest)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def text_stats(text: Column) -> Column:
    """struct(words, lines, paragraphs); a final line end does not start a line."""
    lines = F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))
    paragraphs = F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(r"\S")))
    return F.struct(word_count(text).alias("words"), F.when(text == "", 0).otherwise(lines).alias("lines"), paragraphs.alias("paragraphs"))


def lab_notebook_score(text: Column) -> Column:
    """struct(score, flag): a date, a measurement and a researcher count one each; two are enough."""
    score = text.rlike(DATE_PATTERN).cast("int") + text.rlike(LAB_PATTERNS["cell"]).cast("int") + text.rlike(RESEARCHER_PATTERN).cast("int")
    return F.struct(score.alias("score"), (score >= 2).alias("flag"))


def extract_lab_values(docs: DataFrame, variant: str = "chunk", text: str = "text") -> DataFrame:
    """(document_id, pos, value, unit) of all values with a unit."""
    p = F.lit(LAB_PATTERNS[variant])
    pairs = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("value"), F.regexp_extract_all(text, p, F.lit(2)).alias("unit"))
    out = docs.select("document_id", F.posexplode(pairs).alias("pos", "x"))
    return out.select("document_id", "pos", "x.value", "x.unit")


def protect_lab_values(text: Column) -> Column:
    """Value and unit joined by a word joiner, which is no white space."""
    return F.regexp_replace(text, LAB_PATTERNS["prose"], f"$1{WORD_JOINER}$2")


# Fixed value: a line in capitals, or a short line that ends in a colon.
SECTION_HEADER = r"^(?:[A-Z][A-Z0-9 /&\-]{2,60}|[A-Za-z][A-Za-z0-9 /&\-]{1,60}:)$"


def isolate_section_headers(text: Column) -> Column:
    """Blank lines around header lines, where there are none yet; header lines are trimmed."""
    def header(line: Column) -> Column:
        return F.trim(line).rlike(SECTION_HEADER)

    def blank(line: Column) -> Column:
        return F.trim(F.coalesce(line, F.lit(""))) == ""

    def one(lines: Column, line: Column, i: Column) -> Column:
        before, after = F.get(lines, i - 1), F.get(lines, i + 1)
        # a header before this one has already put a blank line between them
        head = F.when((i > 0) & ~blank(before) & ~header(before), "\n").otherwise("")
        tail = F.when(~blank(after), "\n").otherwise("")
        return F.when(header(line), F.concat(head, F.trim(line), tail)).otherwise(line)

    return bind(F.split(text, "\n", -1), lambda lines: F.array_join(F.transform(lines, lambda line, i: one(lines, line, i)), "\n"))


def strip_repeated_headers_footers(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text): in documents of at least 3 pages, first or last non-blank lines that are the same on at least
    max(3, n // 2 + 1) pages are blanked. Counts run over (document, line), so a document of very many pages is spread."""
    lines = F.split("text", "\n", -1)
    spots = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    p = pages.withColumn("_lines", lines).withColumn("_first", F.array_min(spots)).withColumn("_last", F.array_max(spots))
    p = p.withColumn("_head", F.trim(F.get("_lines", F.col("_first")))).withColumn("_foot", F.trim(F.get("_lines", F.col("_last"))))
    n = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    least = F.greatest(F.lit(3), F.floor(F.col("_n") / 2) + 1)

    def repeated(column: str, flag: str) -> DataFrame:
        counts = p.filter(F.col(column).isNotNull()).groupBy("document_id", column).agg(F.count(F.lit(1)).alias("_c"))
        return counts.join(n, "document_id").filter(F.col("_c") >= least).select("document_id", column, F.lit(True).alias(flag))

    out = p.join(repeated("_head", "_h"), ["document_id", "_head"], "left").join(repeated("_foot", "_f"), ["document_id", "_foot"], "left")
    # a page whose header is its only line: after the header is blanked there is no last line left
    foot = F.col("_f").isNotNull() & ~(F.col("_h").isNotNull() & (F.col("_first") == F.col("_last")))
    cleaned = F.transform("_lines", lambda x, i: F.when((F.col("_h").isNotNull() & (i == F.col("_first"))) | (foot & (i == F.col("_last"))), "").otherwise(x))
    text = F.when(F.col("_h").isNull() & F.col("_f").isNull(), F.col("text")).otherwise(F.array_join(cleaned, "\n"))
    return out.select("document_id", "page_number", text.alias("text"))


def flag_scanned(pages: DataFrame, least_chars: int = 100, first_pages: int = 3) -> DataFrame:
    """(document_id, is_scanned): too little text on the first pages together."""
    some = pages.filter(F.col("page_number") <= first_pages).groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "").alias("_t"))
    text = F.regexp_replace("_t", r"^\s+|\s+\z", "")
    return some.select("document_id", (F.length(text) < least_chars).alias("is_scanned"))


def fix_ocr_tokens(text: Column) -> Column:
    """Lines without letters or digits go; in tokens of digits and look-alikes that are digits by half or more, O, o become 0 and l, I become 1."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    # split at token borders, so that every second piece can be judged alone
    pieces = cut_at_marks(F.array_join(lines, "\n"), lambda t: F.regexp_replace(t, r"\b([0-9OolI]{2,})\b", f"{CUT}$1{CUT}"))

    def fixed(piece: Column) -> Column:
        digits = F.length(piece) - F.length(F.regexp_replace(piece, "[0-9]", ""))
        return F.when(piece.rlike(r"^[0-9OolI]{2,}$") & (digits > 0) & (digits * 2 >= F.length(piece)), F.translate(piece, "OolI", "0011")).otherwise(piece)

    return F.array_join(F.transform(pieces, fixed), "")


def ocr_confidence(words: DataFrame, keys: Sequence[str], low: float = 60) -> DataFrame:
    """(keys, confidence, warning): mean of the usable confidences to 1 digit, null (and a warning) when there is none.

    Confidences count in millionths, so that the mean is exact in whatever order they are added; its halves are rounded up."""
    usable = F.when((F.col("conf") >= 0) & (F.col("conf") < float("inf")) & (F.trim("word") != ""), F.floor(F.col("conf") * 1e6 + 0.5).cast("decimal(19,0)"))
    out = words.groupBy(*keys).agg(F.sum(usable).alias("_sum"), F.count(usable).alias("_n"))
    tenths = F.when(F.col("_n") > 0, F.expr("(20 * _sum + 1000000 * _n) div (2000000 * _n)"))
    out = out.select(*keys, (tenths.cast("double") / 10.0).alias("confidence"))
    return out.withColumn("warning", F.coalesce(F.col("confidence") < low, F.lit(True)))


def prepare_for_embedding(text: Column, max_tokens: int = 8000) -> Column:
    """No NUL, NFKC, trimmed; texts of more than max_tokens words are cut, back to the last space."""
    t = F.regexp_replace(nfkc(F.regexp_replace(text, r"\x00", "")), r"^\s+|\s+\z", "")
    # words with the white space before them: a repeated group would overflow the regex engine's stack on long texts
    cut = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(r"\s*\S+"), F.lit(0)), 1, max_tokens), "")
    return F.when(word_count(t) <= max_tokens, t).otherwise(F.regexp_replace(cut, r" [^ ]*\z", ""))


# Fixed value: names of date columns.
DATE_COLUMN = r"(?i)(date|_dt$|^dt_|\bdob\b)"


def fix_date_serials(cells: DataFrame) -> DataFrame:
    """Numbers from 1 to 100000 in date-named columns are days after 1899-12-30."""
    number = F.expr("try_cast(value as double)")
    as_date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")), "yyyy-MM-dd")
    serial = F.col("column_name").rlike(DATE_COLUMN) & number.between(1, 100000)
    return cells.withColumn("value", F.when(serial, as_date).otherwise(F.col("value")))


def document_text_rollup(pages: DataFrame) -> DataFrame:
    """(document_id, text, word_count, page_count): pages in order, separated by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    out = pages.groupBy("document_id").agg(ordered.alias("_p"), F.sum(word_count(F.col("text"))).alias("word_count"), F.count(F.lit(1)).alias("page_count"))
    return out.select("document_id", F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n").alias("text"), "word_count", "page_count")


def clean_documents(pages: DataFrame, steps: Sequence[str] = ("whitespace", "lab_values", "headers")) -> DataFrame:
    """Page texts through the chosen steps, in order, as one narrow stage."""
    known = {"whitespace": clean_whitespace, "lab_values": protect_lab_values, "headers": isolate_section_headers, "markdown": markdown_to_text, "ocr": fix_ocr_tokens}
    for s in steps:
        pages = pages.withColumn("text", known[s](F.col("text")))
    return pages.withColumn("text", strip(F.col("text")))
