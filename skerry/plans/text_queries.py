"""Text and upload queries with their DuckDB twins."""

from pyspark.sql import functions as F

from skerry.functions import text as t
from skerry.plans.views import duck, load_table, v_cells, v_chunks, v_documents, v_pages, v_search_logs
from skerry.sources import uploads as u
from skerry.sources.shared import new_folder

AS_OF = "2024-01-31 00:00:00"


def load_documents(spark, d):
    return load_table(spark, d, "documents")


def _manifest(spark, d):
    return v_documents(spark, d).selectExpr(
        "document_id", """case document_id % 9 when 0 then concat('a/', filename) when 1 then concat('x..', filename) when 2 then concat('Scan ', document_id, '.PDF') when 3 then concat('n', document_id, '.docx')
            when 4 then concat('my file (', document_id, ').Csv') when 5 then repeat('y', cast(document_id % 300 as int)) || '.md' when 6 then '.hidden' when 7 then 'archive.tar.tiff' else filename end as filename""",
        "mime_type", "file_size_bytes * 40000 as size_bytes")


_MANIFEST = """select document_id, case document_id % 9 when 0 then concat('a/', filename) when 1 then concat('x..', filename) when 2 then concat('Scan ', document_id, '.PDF') when 3 then concat('n', document_id, '.docx')
    when 4 then concat('my file (', document_id, ').Csv') when 5 then repeat('y', cast(document_id % 300 as int)) || '.md' when 6 then '.hidden' when 7 then 'archive.tar.tiff' else filename end as filename,
    mime_type, file_size_bytes * 40000 as size_bytes from v_documents"""
_EXT = "lower(regexp_extract(regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '^\\.+', ''), '[^.](\\.[^.]*)$', 1))"


def validate_uploads(spark, d):
    return u.validate_uploads(_manifest(spark, d))


def sanitize_filename(spark, d):
    return _manifest(spark, d).select("document_id", u.sanitize_filename(F.col("filename")).alias("safe_name"))


def classify_mime(spark, d):
    return v_documents(spark, d).select("document_id", u.classify_mime(F.col("mime_type")).alias("x")).select("document_id", "x.label", "x.category", "x.class")


def replace_document_chunks(spark, d):
    old = v_chunks(spark, d)
    new = old.filter("document_id % 5 = 0 and chunk_index < 2").withColumn("content", F.concat(F.lit("new "), "content"))
    return u.replace_document_chunks(old, new)


def append_audit(spark, d):
    docs = v_documents(spark, d).filter("status = 'indexed'").withColumn("chunk_count", F.expr("cast(document_id % 13 as int)"))
    return u.append_audit(docs, "document.indexed", AS_OF)




def clean_whitespace(spark, d):
    docs = v_documents(spark, d).withColumn("text", F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n\n\n")), F.lit(","), F.lit("\x07\t")))
    return docs.select("document_id", t.clean_whitespace(F.col("text")).alias("text"))


def json_profile(spark, d):
    events = load_table(spark, d, "events").select(F.col("event_id").alias("document_id"), F.expr("""case event_id % 5 when 0 then concat('[', event_id, ', "a", true, null]')
        when 1 then cast(event_id as string) when 2 then concat('{"n": ', event_id, ', "s": "x", "l": [1], "o": {}, "z": null, "b": false, "f": 1.5}') else props end""").alias("text"))
    return t.json_profile(events)


def text_stats(spark, d):
    docs = v_documents(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return docs.select("document_id", t.text_stats(F.col("text")).alias("s")).select("document_id", "s.*")


_NOTES = """case document_id % 6 when 0 then concat(text, ' 2024-03-05 glucose 126 mg/dL') when 1 then concat('Recorded by X. ', text, ' 5/12/24')
    when 2 then concat(text, ' Na 140 mmol/L, 7.2% and 12.5mg/dL; signed') when 3 then concat('Mar 4, 2024 ', text) else text end"""


def lab_notebook_score(spark, d):
    docs = v_documents(spark, d).withColumn("text", F.expr(_NOTES))
    return docs.select("document_id", t.lab_notebook_score(F.col("text")).alias("s")).select("document_id", "s.*")


def extract_lab_values(spark, d):
    return t.extract_lab_values(v_documents(spark, d).withColumn("text", F.expr(_NOTES)))


def _footed(spark, d):
    """Pages with a header on most and a footer on some."""
    return v_pages(spark, d).withColumn("text", F.expr("""concat(case when (document_id + page_number) % 5 <> 0 then concat('Clinic ', document_id, '\\n') else '' end, text,
        case when page_number % 2 = 0 then '\\nend of page\\n' else concat('\\npage ', page_number) end)"""))


_FOOTED = """select document_id, page_number, concat(case when (document_id + page_number) % 5 <> 0 then concat('Clinic ', document_id, chr(10)) else '' end, text,
    case when page_number % 2 = 0 then chr(10) || 'end of page' || chr(10) else concat(chr(10), 'page ', page_number) end) as text from v_pages"""


def strip_repeated_headers_footers(spark, d):
    return t.strip_repeated_headers_footers(_footed(spark, d))


def flag_scanned(spark, d):
    return t.flag_scanned(v_pages(spark, d).withColumn("text", F.expr("case when document_id % 3 = 0 then left(text, 30) else concat('  ', text, '\\n') end")))


def ocr_confidence(spark, d):
    words = load_table(spark, d, "events").selectExpr("user_id", "value - 30 as conf", "case when event_type = 'error' then ' ' else event_type end as word")
    return t.ocr_confidence(words, ["user_id"])


def prepare_for_embedding(spark, d):
    docs = v_documents(spark, d)
    return docs.select("document_id", t.prepare_for_embedding(F.concat(F.lit(" \x00"), "text", F.lit("\n ")), 100).alias("text"))


def fix_date_serials(spark, d):
    cells = v_cells(spark, d).withColumn("column_name", F.expr("case col_no when 1 then 'visit_date' when 4 then 'start_dt' else column_name end"))
    return t.fix_date_serials(cells).select("row_no", "col_no", "value")


def document_text_rollup(spark, d):
    return t.document_text_rollup(v_pages(spark, d))


def write_by_owner_month(spark, d):
    """Uploads written to folders of user, year and month, and read back with the folders' columns."""
    path = new_folder(spark, "uploads")
    u.write_by_owner_month(v_documents(spark, d).select("document_id", "uploaded_by", "created_at"), path)
    return spark.read.parquet(path).select("document_id", "user_id", "year", "month")


QUERIES = {f.__name__: f for f in (
    load_documents, write_by_owner_month, validate_uploads, sanitize_filename, classify_mime, replace_document_chunks, append_audit, clean_whitespace, json_profile, text_stats,
    lab_notebook_score, extract_lab_values, strip_repeated_headers_footers, flag_scanned, ocr_confidence, prepare_for_embedding, fix_date_serials,
    document_text_rollup)}

_MIMES = ", ".join(f"'{m}'" for m in u.ALLOWED)
_EXTS = ", ".join(sorted({f"'{e}'" for _, es in u.ALLOWED.values() for e in es}))
_LAB = "(\\d+\\.?\\d*)[ \\t\\n\\r\\f\\v]*(" + t.CHUNK_UNITS + ")"
_CELL = "(?i)(\\d+\\.?\\d*)\\s*(" + t.LAB_UNITS + ")([^A-Za-z0-9]|$)"
SQL = {
    "load_documents": "select * from documents",
    "write_by_owner_month": duck("select document_id, uploaded_by as user_id, year(created_at)::int as year, month(created_at)::int as month from v_documents", "v_documents"),
    "validate_uploads": duck(f"""select *, case when size_bytes > 52428800 then 'FILE_TOO_LARGE' when {_EXT} not in ({_EXTS}) then 'UNSUPPORTED_FILE_TYPE'
        when mime_type not in ({_MIMES}) then 'UNSUPPORTED_FILE_TYPE' when contains(filename, '..') or contains(filename, '/') or contains(filename, chr(92)) or length(filename) > 255 then 'INVALID_FILENAME' end as reject_code
        from m""", "v_documents", m=_MANIFEST),
    "sanitize_filename": duck(f"""select document_id, concat(left(regexp_replace(replace(left(base, length(base) - length(ext)), ' ', '_'), '[^\\p{{L}}\\p{{N}}_\\-]', '', 'g'), 100 - length(ext)), ext) as safe_name
        from (select *, regexp_extract(filename, '([^/]*)$', 1) as base, {_EXT} as ext from m)""", "v_documents", m=_MANIFEST),
    "classify_mime": duck("""select document_id, case mime_type when 'application/pdf' then 'PDF Document' when 'text/csv' then 'CSV Spreadsheet' when 'text/plain' then 'Text File' when 'text/markdown' then 'Markdown Document'
        when 'application/json' then 'JSON File' when 'image/png' then 'PNG Image' else 'Excel Spreadsheet' end as label,
        case mime_type when 'application/pdf' then 'pdf' when 'text/csv' then 'csv' when 'image/png' then 'image' when 'application/vnd.ms-excel' then 'excel' else 'text' end as category,
        case mime_type when 'application/pdf' then 'pdf' when 'text/csv' then 'spreadsheet' when 'image/png' then 'image' when 'application/vnd.ms-excel' then 'spreadsheet' else 'text' end as class from v_documents""", "v_documents"),
    "replace_document_chunks": duck("""select * from v_chunks where document_id not in (select document_id from v_chunks where document_id % 5 = 0 and chunk_index < 2)
        union all select document_id, chunk_index, concat('new ', content) from v_chunks where document_id % 5 = 0 and chunk_index < 2""", "v_chunks"),
    "append_audit": duck(f"""select uploaded_by as user_id, 'document.indexed' as action, 'document' as resource_type, document_id as resource_id,
        concat('{{"status":"', status, '","chunk_count":', cast(document_id % 13 as varchar), '}}') as metadata, timestamp '{AS_OF}' as created_at from v_documents where status = 'indexed'""", "v_documents"),
    "json_profile": """with e as (select event_id, event_id % 5 as k, props from events where event_id % 5 >= 3),
        p as (select event_id, props, unnest(json_keys(props)) as key from e)
        select event_id as document_id, 'object' as kind, key, case json_type(props, '$."' || key || '"') when 'VARCHAR' then 'string' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number'
          when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'null' end as type from p
        union all select event_id, 'array', '4', 'boolean, integer, null, string' from events where event_id % 5 = 0
        union all select event_id, 'scalar', null, 'integer' from events where event_id % 5 = 1
        union all select event_id, 'object', k, t from events, (values ('n','integer'),('s','string'),('l','array'),('o','object'),('z','null'),('b','boolean'),('f','number')) v(k, t) where event_id % 5 = 2""",
    "text_stats": duck(r"""select document_id, len(regexp_extract_all(text, '\S+'))::int as words, case when text = '' then 0 else len(string_split(regexp_replace(text, '\n$', ''), chr(10))) end::int as lines,
        len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S')))::int as paragraphs from (select document_id, replace(text, '. ', '.' || chr(10) || chr(10)) as text from v_documents)""", "v_documents"),
    "lab_notebook_score": duck(f"""select document_id, score, score >= 2 as flag from (select document_id, regexp_matches(text, '{t.DATE_PATTERN}')::int + regexp_matches(text, '{_CELL}')::int
        + regexp_matches(text, '{t.RESEARCHER_PATTERN}')::int as score from (select document_id, {_NOTES} as text from v_documents))""", "v_documents"),
    "extract_lab_values": duck(f"""select document_id, pos::int as pos, value, unit from (select document_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as value, unnest(b) as unit
        from (select document_id, regexp_extract_all(text, '{_LAB}', 1) as a, regexp_extract_all(text, '{_LAB}', 2) as b from (select document_id, {_NOTES} as text from v_documents)))""", "v_documents"),
    "strip_repeated_headers_footers": duck("""select document_id, page_number, case when not h and not f then text else array_to_string(list_transform(l, lambda x, i: case when (h and i = fst) or (f and i = lst and not (h and fst = lst)) then '' else x end), chr(10)) end as text
        from (select p.*, coalesce(hc >= greatest(3, n // 2 + 1), false) as h, coalesce(fc >= greatest(3, n // 2 + 1), false) as f from
          (select *, count(*) over (partition by document_id) as n, case when head is not null then count(*) over (partition by document_id, head) end as hc, case when foot is not null then count(*) over (partition by document_id, foot) end as fc from lines) p)""",
        "v_pages", footed=_FOOTED,
        spots="select *, list_filter(list_transform(l, lambda x, i: case when trim(x) <> '' then i end), lambda i: i is not null) as s from (select *, string_split(text, chr(10)) as l from footed)",
        lines="select document_id, page_number, text, l, list_min(s) as fst, list_max(s) as lst, trim(l[list_min(s)]) as head, trim(l[list_max(s)]) as foot from spots"),
    "flag_scanned": duck(r"""select document_id, length(regexp_replace(string_agg(case when document_id % 3 = 0 then left(text, 30) else '  ' || text || chr(10) end, '' order by page_number), '^\s+|\s+$', '', 'g')) < 100 as is_scanned
        from v_pages where page_number <= 3 group by 1""", "v_pages"),
    "ocr_confidence": """select user_id, confidence, coalesce(confidence < 60, true) as warning from (
        select user_id, case when n > 0 then ((20 * total + 1000000 * n) // (2000000 * n))::double / 10.0::double end as confidence
        from (select user_id, sum(millionths) as total, count(millionths) as n
          from (select user_id, case when value - 30 >= 0 and value - 30 < 'infinity'::double and event_type <> 'error' then floor((value - 30) * 1e6::double + 0.5::double)::bigint end as millionths from events) group by 1))""",
    "fix_date_serials": duck("""select row_no, col_no, case when col_no in (1, 4) and try_cast(value as double) between 1 and 100000
        then strftime(date '1899-12-30' + cast(floor(try_cast(value as double)) as int), '%Y-%m-%d') else value end as value from v_cells""", "v_cells"),
    "document_text_rollup": duck(r"""select document_id, string_agg(text, chr(10) || chr(10) order by page_number) as text, sum(len(regexp_extract_all(text, '\S+')))::bigint as word_count, count(*) as page_count from v_pages group by 1""", "v_pages"),
}


# --- steps of page cleaning, on texts that get the constructs they are for ---------------------------------------------

_MARKED = """concat('# Title ', document_id, {nl}, '**', left(text, 20), '** and _', substr(text, 21, 10), '_ `', document_id, '`', {nl}, '> ', substr(text, 31, 30), {nl}, '* item', {nl}, '| a | b |', {nl}, '|---|---|', {nl},
    '[link](http://x.example/', document_id, ')', {nl}, text)"""
_LABBED = "concat('RESULTS ', document_id, {nl}, replace(text, '. ', ' 126 mg/dL. '), {nl}, 'Notes:', {nl}, {nl}, text, ' Na 140  mmol/L, 7 %x 1O5 l2 0Ill ', document_id, 'O ', {nl}, '*** --', {nl}, 'end')"


def _with(spark, d, expression):
    return v_documents(spark, d).withColumn("text", F.expr(expression.format(nl="'\\n'")))


def markdown_to_text(spark, d):
    return _with(spark, d, _MARKED).select("document_id", t.markdown_to_text(F.col("text")).alias("text"))


def protect_lab_values(spark, d):
    return _with(spark, d, _LABBED).select("document_id", t.protect_lab_values(F.col("text")).alias("text"))


def isolate_section_headers(spark, d):
    return _with(spark, d, _LABBED).select("document_id", t.isolate_section_headers(F.col("text")).alias("text"))


def fix_ocr_tokens(spark, d):
    return _with(spark, d, _LABBED).select("document_id", t.fix_ocr_tokens(F.col("text")).alias("text"))


def clean_documents(spark, d):
    pages = _with(spark, d, _LABBED).select("document_id", F.lit(1).alias("page_number"), "text")
    return t.clean_documents(pages)


def decode_corpus(spark, d):
    """Documents as bytes in four encodings, decoded again."""
    docs = v_documents(spark, d).select(F.concat(F.lit("f"), F.col("document_id").cast("string")).alias("path"), F.expr("""case document_id % 4 when 0 then encode(text, 'UTF-8') when 1 then concat(X'FFFE', encode(text, 'UTF-16LE'))
        when 2 then concat(X'EFBBBF', encode(text, 'UTF-8')) else encode(text, 'ISO-8859-1') end""").alias("content"))
    return u.decode_corpus(docs)


QUERIES |= {f.__name__: f for f in (markdown_to_text, protect_lab_values, isolate_section_headers, fix_ocr_tokens, clean_documents, decode_corpus)}

_LABBED_CTE = {"x": f"select document_id, {_LABBED.format(nl='chr(10)')} as text from v_documents"}
_HEADER = r"regexp_matches(trim({0}), '^(?:[A-Z][A-Z0-9 /&\-]{{2,60}}|[A-Za-z][A-Za-z0-9 /&\-]{{1,60}}:)$')"
SQL |= {
    "protect_lab_values": duck(f"""select document_id, regexp_replace(text, '(?i)(\\d+\\.?\\d*)\\s+({t.LAB_UNITS})([^A-Za-z0-9]|$)', '\\1{t.WORD_JOINER}\\2\\3', 'g') as text from x""", "v_documents", **_LABBED_CTE),
    "isolate_section_headers": duck(f"""select document_id, array_to_string(list_transform(l, lambda y, i: case when {_HEADER.format('y')} then
        concat(case when i > 1 and trim(l[i - 1]) <> '' and not {_HEADER.format('l[i - 1]')} then chr(10) else '' end, trim(y), case when trim(coalesce(l[i + 1], '')) <> '' then chr(10) else '' end) else y end), chr(10)) as text
        from (select document_id, string_split(text, chr(10)) as l from x)""", "v_documents", **_LABBED_CTE),
    "fix_ocr_tokens": duck(r"""select document_id, array_to_string(list_transform(string_split(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[\p{L}\p{N}]')), chr(10)), '\b([0-9OolI]{2,})\b', chr(1) || '\1' || chr(1), 'g'), chr(1)),
        lambda p: case when regexp_matches(p, '^[0-9OolI]{2,}$') and length(regexp_replace(p, '[^0-9]', '', 'g')) > 0 and length(regexp_replace(p, '[^0-9]', '', 'g')) * 2 >= length(p) then translate(p, 'OolI', '0011') else p end), '') as text from x""", "v_documents", **_LABBED_CTE),
    "decode_corpus": duck("""select concat('f', cast(document_id as varchar)) as path, text, case document_id % 4 when 0 then 'utf-8' when 1 then 'utf-16le' when 2 then 'utf-8-sig' else case when regexp_matches(text, '[^\\x00-\\x7F]') then 'latin-1' else 'utf-8' end end as encoding from v_documents""", "v_documents"),
}
