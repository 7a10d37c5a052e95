"""Tabular profiling and embedding-pipeline queries with their DuckDB twins."""

from pyspark.sql import functions as F

from skerry.functions import text as t
from skerry.operators import embedding as e
from skerry.operators import tabular as tb
from skerry.plans.views import duck, load_table, v_cells, v_chunks, v_documents
from skerry.sources.shared import cut_lineage

# --- tabular ---------------------------------------------------------------------------------------------------------
# Raw lines: customers as delimited text in 25 "files", with comments, two header rows in some and captions in others.
_LINES = """select concat('file_', c_nationkey) as dataset, c_custkey + 10 as line_no,
    concat_ws(element_at(array(',', ';', '|'), cast(c_nationkey % 3 as int) + 1), c_custkey, concat('"', c_name, ', x"'), case when c_custkey % 37 = 0 then 'N/A' else cast(c_acctbal as string) end, c_mktsegment) as line from {t}"""
_LINES_DUCK = """select concat('file_', c_nationkey) as dataset, c_custkey + 10 as line_no,
    concat_ws([',', ';', '|'][c_nationkey % 3 + 1], c_custkey, concat('"', c_name, ', x"'), case when c_custkey % 37 = 0 then 'N/A' else cast(c_acctbal as varchar) end, c_mktsegment) as line from customer"""


def _lines(spark, d):
    return spark.sql(_LINES, t=load_table(spark, d, "customer"))


def sniff_delimiter(spark, d):
    return tb.sniff_delimiter(_lines(spark, d))


def text_to_grid(spark, d):
    lines = _lines(spark, d)
    return tb.text_to_grid(lines, tb.sniff_delimiter(lines))


# Every document as a record over many lines in the file of its source: id, the text in quotes, language.
_QUOTED = """select source as dataset, doc_id * 1048576 + pos as line_no, line from (select coalesce(source, '') as source, doc_id,
    posexplode(split(concat(doc_id, ',"\n', replace(coalesce(text, ''), '"', '""'), '\n",', coalesce(lang, '')), '\n')) as (pos, line) from {t})"""


def quoted_records(spark, d):
    lines = cut_lineage(spark.sql(_QUOTED, t=load_table(spark, d, "documents")))
    return tb.text_to_grid(lines, lines.select("dataset").distinct().withColumn("delimiter", F.lit(",")))


def _grid(spark, d):
    """The cell view with header rows on top: one row for every dataset of customers of one nation; nation 1 has two header rows, nation 2 none, nation 3 a caption."""
    body = v_cells(spark, d).join(load_table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), F.col("c_nationkey").alias("nation")), "row_no")
    body = body.withColumn("value", F.expr("case when col_no = 4 and row_no % 37 = 0 then 'N/A' when col_no = 2 and row_no % 50 = 0 then concat('7.', row_no % 10, ' mg/dL') else value end")).selectExpr(
        "concat('n', nation) as dataset", "row_no + 10 as seq", "col_no", "value")
    keys = body.filter("dataset <> 'n2'").select("dataset").distinct()
    head = keys.selectExpr("dataset", "1 as seq", "stack(5, 1,'patient_id', 2,'visit_date', 3,'', 4,'Glucose_mg/dL', 5,'patient_id') as (col_no, value)")
    second = keys.filter("dataset = 'n1'").selectExpr("dataset", "2 as seq", "stack(5, 1,'key', 2,'name', 3,'', 4,'bal', 5,'segment') as (col_no, value)")
    caption = keys.filter("dataset = 'n3'").selectExpr("dataset", "0 as seq", "stack(5, 1,'Ward A', 2,'Ward A', 3,' Ward A', 4,'', 5,'Ward A') as (col_no, value)")
    rows = body.unionByName(head).unionByName(second).unionByName(caption)
    return rows.selectExpr("dataset", "cast(dense_rank() over (partition by dataset order by seq) as bigint) as row_no", "col_no", "value")


def _numbered(cells):
    return cells.selectExpr("dataset", "cast(dense_rank() over (partition by dataset order by row_no) as bigint) as row_no", "col_no", "value")


def caption_rows(spark, d):
    return tb.caption_rows(_grid(spark, d))[1]


def _plain(spark, d):
    return _numbered(tb.caption_rows(_grid(spark, d))[0])


def detect_header_rows(spark, d):
    return tb.detect_header_rows(_plain(spark, d))


def name_columns(spark, d):
    cells = cut_lineage(_plain(spark, d))
    return tb.name_columns(cells, tb.detect_header_rows(cells))


def _data(spark, d):
    cells = cut_lineage(_plain(spark, d))
    headers = cut_lineage(tb.detect_header_rows(cells))
    return cut_lineage(tb.data_cells(cells, headers, tb.name_columns(cells, headers)))


def infer_numeric_columns(spark, d):
    return tb.infer_numeric_columns(_data(spark, d))


def infer_date_columns(spark, d):
    orders = load_table(spark, d, "orders").selectExpr("o_orderpriority as dataset", "o_orderkey as row_no", "stack(3, 1,'o_orderdate',cast(cast(o_orderdate as date) as string), 2,'status',o_orderstatus, 3,'total_dt',cast(o_totalprice as string)) as (col_no, column_name, value)")
    return tb.infer_date_columns(orders)


def detect_lab_columns(spark, d):
    return tb.detect_lab_columns(_data(spark, d))


def detect_id_columns(spark, d):
    return tb.detect_id_columns(_data(spark, d))


def numeric_profile(spark, d):
    return tb.numeric_profile(v_cells(spark, d))


def column_summary(spark, d):
    """Of the customers' cells and of order dates and prices: text, numbers and dates; with a column of small numbers and an empty one."""
    orders = load_table(spark, d, "orders").selectExpr("'orders' as dataset", "o_orderkey as row_no", "stack(3, 1, 'o_orderdate', cast(cast(o_orderdate as date) as string), 2, 'share', cast(cast(o_orderkey as decimal(20,8)) / 1000000 as string), 3, 'note', cast(null as string)) as (col_no, column_name, value)")
    return tb.column_summary(v_cells(spark, d).unionByName(orders))


def render_markdown_table(spark, d):
    cells = v_cells(spark, d).join(load_table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), "c_nationkey"), "row_no")
    return tb.render_markdown_table(cells.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dataset"), "row_no", "col_no", F.expr("case when col_no = 2 then concat(value, ' |  x') else value end").alias("value")).filter("not (col_no = 5 and row_no % 7 = 0)"))


def dataset_report(spark, d):
    return tb.dataset_report(_data(spark, d), full_limit=40, preview=10)


def profile_rollup(spark, d):
    p = load_table(spark, d, "customer").groupBy(F.expr("c_nationkey % 4").alias("workbook"), "c_nationkey").agg(F.count(F.lit(1)).alias("row_count"), F.collect_set("c_mktsegment").alias("columns"))
    return tb.profile_rollup(p).withColumn("columns", F.array_join("columns", ","))


# --- embedding pipeline ------------------------------------------------------------------------------------------------


def _chunks(spark, d):
    return v_chunks(spark, d).withColumn("chunk_id", F.expr("document_id * 1048576 + chunk_index"))


def _made(spark, d):
    """Vectors of most chunks, as stored rows."""
    return _chunks(spark, d).filter("(document_id + chunk_index) % 4 <> 0 or document_id % 10 = 5").selectExpr(
        "chunk_id", "array(cast(chunk_index as float), cast(1 as float)) as embedding", "'m0' as embedding_model", "timestamp_ntz'2024-01-01 00:00:00' as embedding_generated_at")


def embed_chunks(spark, d):
    chunks = v_documents(spark, d).select(F.col("document_id").alias("chunk_id"), F.col("text").alias("content"))
    return e.embed_chunks(chunks).select("chunk_id", "embed_ok", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm2"))


def pending_chunks(spark, d):
    return e.pending_chunks(_chunks(spark, d), _made(spark, d)).select("chunk_id", "document_id", "chunk_index")


def upsert_embeddings(spark, d):
    new = _made(spark, d).filter("chunk_id % 3 = 0 or chunk_id % 7 = 0").selectExpr("chunk_id", "embedding", "'m1' as embedding_model", "timestamp_ntz'2024-02-01 00:00:00' as embedding_generated_at")
    newer = new.filter("chunk_id % 7 = 0").selectExpr("chunk_id", "embedding", "'m2' as embedding_model", "timestamp_ntz'2024-03-01 00:00:00' as embedding_generated_at")
    return e.upsert_embeddings(_made(spark, d), new.unionByName(newer)).select("chunk_id", "embedding_model", "embedding_generated_at")


def embedding_progress(spark, d):
    return e.embedding_progress(_chunks(spark, d), _made(spark, d))


def embedding_cost_estimate(spark, d):
    return e.embedding_cost_estimate(v_chunks(spark, d))


def embedding_cost_rows(spark, d):
    return e.embedding_cost_rows(e.embedding_cost_estimate(v_chunks(spark, d)), "m0").withColumn("cost_usd", F.col("cost_usd").cast("double"))


def advance_status(spark, d):
    return e.advance_status(v_documents(spark, d), e.embedding_progress(_chunks(spark, d).filter("document_id % 15 <> 0"), _made(spark, d))).select("document_id", "status", "embedding_status")


QUERIES = {f.__name__: f for f in (
    sniff_delimiter, text_to_grid, quoted_records, caption_rows, detect_header_rows, name_columns, infer_numeric_columns, infer_date_columns, detect_lab_columns,
    detect_id_columns, numeric_profile, column_summary, render_markdown_table, dataset_report, profile_rollup, embed_chunks, pending_chunks,
    upsert_embeddings, embedding_progress, embedding_cost_estimate, embedding_cost_rows, advance_status)}

_NUM = f"regexp_matches(trim(value), '{tb.NUMBER}')"
_GRID = {
    "body": """select concat('n', c_nationkey) as dataset, row_no + 10 as seq, col_no, case when col_no = 4 and row_no % 37 = 0 then 'N/A' when col_no = 2 and row_no % 50 = 0 then concat('7.', row_no % 10, ' mg/dL') else value end as value
        from v_cells join customer on c_custkey = row_no""",
    "keys": "select distinct dataset from body where dataset <> 'n2'",
    "all_rows": """select * from body union all select dataset, 1, k, v from keys, (values (1,'patient_id'),(2,'visit_date'),(3,''),(4,'Glucose_mg/dL'),(5,'patient_id')) h(k, v)
        union all select 'n1', 2, k, v from (values (1,'key'),(2,'name'),(3,''),(4,'bal'),(5,'segment')) h(k, v)
        union all select 'n3', 0, k, v from (values (1,'Ward A'),(2,'Ward A'),(3,' Ward A'),(4,''),(5,'Ward A')) h(k, v)""",
    "grid": "select dataset, dense_rank() over (partition by dataset order by seq) as row_no, col_no, value from all_rows",
    "caps": "select dataset, row_no, min(trim(value)) filter (trim(value) <> '') as caption from grid group by all having count(*) filter (trim(value) <> '') >= 2 and count(distinct trim(value)) filter (trim(value) <> '') = 1 and count(*) filter (trim(value) <> '') >= 0.6 * count(*)",
    "plain": "select dataset, dense_rank() over (partition by dataset order by row_no) as row_no, col_no, value from grid anti join caps using (dataset, row_no)",
    "tops": f"select dataset, row_no, col_no, regexp_matches(trim(value), '{tb.HEADER_NUMBER}')::int as num from plain where row_no <= 11 and trim(value) <> ''",
}


def _verdict(r: int, yes: str, default: str) -> str:
    return f"""select dataset, avg(own) <= 0.3 and case when count(*) filter (nc) = 0 then {default} else count(*) filter (nc and own = 0) {yes} count(*) filter (nc and own = 1) end as h from
        (select o.dataset, o.num as own, coalesce(share >= 0.7, false) as nc from tops o left join (select dataset, col_no, avg(num) as share from tops where row_no > {r} group by all) b using (dataset, col_no) where o.row_no = {r}) group by 1"""


_HEADERS = _GRID | {"v1": _verdict(1, ">=", "true"), "v2": _verdict(2, ">", "false"),
                    "headers": "select dataset, case when not coalesce(v1.h, false) then 0 when coalesce(v2.h, false) then 2 else 1 end as header_rows from (select distinct dataset from plain) left join v1 using (dataset) left join v2 using (dataset)"}
_NAMES = _HEADERS | {
    "raw_names": """select dataset, col_no, coalesce(string_agg(case when row_no <= header_rows and trim(value) <> '' then trim(value) end, '_' order by row_no), concat('Column_', col_no)) as b from plain join headers using (dataset) group by dataset, col_no""",
    "names": "select dataset, col_no, case when n = 0 then b else concat(b, '_', n) end as column_name from (select *, row_number() over (partition by dataset, b order by col_no) - 1 as n from raw_names)"}
_DATA = _NAMES | {"data": "select p.dataset, p.row_no, p.col_no, column_name, case when trim(value) <> '' then value end as value from plain p join headers using (dataset) join names using (dataset, col_no) where p.row_no > header_rows"}
_NUMERIC = {"numeric": f"select dataset, col_no, column_name, round(count(*) filter ({_NUM}) / nullif(count(value), 0)::double, 6) as ratio, coalesce(count(*) filter ({_NUM}) / nullif(count(value), 0)::double >= 0.9, false) as is_numeric from data group by all"}
_MADE = """select document_id * 1048576 + chunk_index as chunk_id, document_id, chunk_index, content, (document_id + chunk_index) % 4 <> 0 or document_id % 10 = 5 as made from v_chunks"""
_TOKENS = r"sum(len(regexp_extract_all(content, '\S+')))::bigint"
SQL = {
    "sniff_delimiter": duck("""select dataset, coalesce(delimiter, ',') as delimiter from (select distinct dataset from ln) left join
        (select dataset, d as delimiter from (select *, row_number() over (partition by dataset order by k desc, n desc, no) as r from (select dataset, no, d, n, count(*) as k from counted where n > 0 group by all)) where r = 1) using (dataset)""",
        ln=_LINES_DUCK, head="select * from (select *, row_number() over (partition by dataset order by line_no) as r from ln where not starts_with(ltrim(line), '#')) where r <= 10",
        counted="select dataset, no, d, length(line) - length(replace(line, d, '')) as n from head, (values (0, ','), (1, ';'), (2, chr(9)), (3, '|')) c(no, d)"),
    "text_to_grid": duck("""select dataset, (row_number() over (partition by dataset order by c_custkey))::int as row_no, k as col_no, v as value from
        (select concat('file_', c_nationkey) as dataset, * from customer), lateral (values (1, cast(c_custkey as varchar))) u(k, v) where false
        union all select dataset, row_no::int, u.k, u.v from (select concat('file_', c_nationkey) as dataset, row_number() over (partition by c_nationkey order by c_custkey) as row_no, * from customer),
          lateral (values (1, cast(c_custkey as varchar)), (2, concat(c_name, ', x')), (3, case when c_custkey % 37 = 0 then 'N/A' else cast(c_acctbal as varchar) end), (4, c_mktsegment)) u(k, v)"""),
    "quoted_records": """select dataset, row_no::int as row_no, u.k as col_no, u.v as value from (select coalesce(source, '') as dataset, row_number() over (partition by coalesce(source, '') order by doc_id) as row_no, doc_id,
          coalesce(lang, '') as lang, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: not starts_with(ltrim(x, ' '), '#')), '') as body from documents),
          lateral (values (1, cast(doc_id as varchar)), (2, body), (3, lang)) u(k, v)""",
    "caption_rows": duck("select dataset, row_no, caption from caps", "v_cells", **_GRID),
    "detect_header_rows": duck("select * from headers", "v_cells", **_HEADERS),
    "name_columns": duck("select * from names", "v_cells", **_NAMES),
    "infer_numeric_columns": duck("select * from numeric", "v_cells", **_DATA, **_NUMERIC),
    "infer_date_columns": """select o_orderpriority as dataset, 1 as col_no, 'o_orderdate' as column_name, min(o_orderdate::date) as min_date, max(o_orderdate::date) as max_date from orders group by 1""",
    "detect_lab_columns": duck(f"""select distinct dataset, col_no, column_name from (select *, row_number() over (partition by dataset, col_no order by row_no) as r from data where value is not null) where r <= 20 and regexp_matches(value, '(?i)(\\d+\\.?\\d*)\\s*({t.LAB_UNITS})([^A-Za-z0-9]|$)')
        union select distinct dataset, col_no, column_name from data where regexp_matches(column_name, '(?i)({t.LAB_UNITS})')""", "v_cells", **_DATA),
    "detect_id_columns": duck(f"select distinct dataset, col_no, column_name from data where regexp_matches(column_name, '{tb.ID_COLUMN}')", "v_cells", **_DATA),
    "numeric_profile": duck("select dataset, col_no, column_name, round(min(value::double), 4) as min, round(max(value::double), 4) as max, round(avg(value::double), 4) as mean from v_cells where col_no in (1, 3, 4) group by all", "v_cells"),
    "column_summary": duck("""select dataset, col_no, column_name, concat(column_name, ': ', case when n = 0 then 'no data' when column_name = 'o_orderdate' then concat('date range ', lo, ' to ', hi)
        when k >= 0.9 * n then concat('min=', format('{:.4g}', a), ', max=', format('{:.4g}', z), ', mean=', format('{:.4g}', m))
        else concat(d, ' unique values; most common: ''', common, ''' (', c, 'x)') end) as summary from
        (select dataset, col_no, column_name, count(value) as n, count(distinct value) as d, min(value) as lo, max(value) as hi, count(try_cast(value as double)) as k, min(try_cast(value as double)) as a,
            max(try_cast(value as double)) as z, avg(try_cast(value as double)) as m from every group by all)
        left join (select dataset, col_no, value as common, c from (select *, row_number() over (partition by dataset, col_no order by c desc, value) as r from (select dataset, col_no, value, count(*) as c from every where value is not null group by all)) where r = 1) using (dataset, col_no)""", "v_cells",
        every="""select dataset, col_no, column_name, value from v_cells union all select 'orders', n, k, v from orders, lateral (values (1, 'o_orderdate', cast(o_orderdate::date as varchar)),
            (2, 'share', cast(o_orderkey::decimal(20,8) / 1000000 as varchar)), (3, 'note', null)) u(n, k, v)"""),
    "render_markdown_table": duck("""select dataset, concat(min_by(line, row_no), chr(10), '| --- | --- | --- | --- | --- |', case when count(*) > 1 then chr(10) || array_to_string(list(line order by row_no)[2:], chr(10)) else '' end) as markdown from
        (select concat('n', c_nationkey) as dataset, c_custkey as row_no, concat('| ', c_custkey, ' | ', trim(regexp_replace(c_name, '\\s+', ' ', 'g')), ' \\| x | ', c_nationkey, ' | ', cast(c_acctbal as varchar), ' | ', case when c_custkey % 7 = 0 then '' else c_mktsegment end, ' |') as line from customer) group by 1"""),
    "profile_rollup": """select c_nationkey % 4 as workbook, count(distinct c_nationkey) as datasets, count(*) as row_count, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') as columns from customer group by 1""",
    "embed_chunks": duck("select document_id as chunk_id, trim(text) <> '' as embed_ok, case when trim(text) <> '' then 1.0::double else 0.0::double end as norm2 from v_documents", "v_documents"),
    "pending_chunks": duck("select chunk_id, document_id, chunk_index from c where not made", "v_chunks", c=_MADE),
    "upsert_embeddings": duck("""select chunk_id, case when chunk_id % 7 = 0 then 'm2' when chunk_id % 3 = 0 then 'm1' else 'm0' end as embedding_model,
        case when chunk_id % 7 = 0 then timestamp '2024-03-01' when chunk_id % 3 = 0 then timestamp '2024-02-01' else timestamp '2024-01-01' end as embedding_generated_at from c where made""", "v_chunks", c=_MADE),
    "embedding_progress": duck("""select document_id, count(*) as total, count(*) filter (made) as embedded, count(*) filter (not made) as pending, round_even(100.0::double * count(*) filter (made) / count(*), 0)::int as percent from c group by 1""", "v_chunks", c=_MADE),
    "embedding_cost_estimate": duck(f"select document_id, {_TOKENS} as total_tokens, count(*) as chunk_count, cast(0 as decimal(12,8)) as cost_usd from v_chunks group by 1", "v_chunks"),
    "embedding_cost_rows": duck(f"select document_id, n as token_count, k as chunk_count, 'm0' as model_name, cast(n * 0.00000002 as decimal(12,8))::double as cost_usd from (select document_id, {_TOKENS} as n, count(*) as k from v_chunks group by 1)", "v_chunks"),
    "advance_status": duck("""select document_id, case when status = 'ready' and coalesce(n, 0) > 0 and p = 0 then 'indexed' else status end as status,
        case when status = 'ready' and coalesce(n, 0) > 0 and p = 0 then 'complete' when status = 'ready' and coalesce(n, 0) = 0 then 'skipped' else embedding_status end as embedding_status
        from v_documents left join (select document_id, count(*) as n, count(*) filter (not made) as p from c where document_id % 15 <> 0 group by 1) using (document_id)""", "v_documents", "v_chunks", c=_MADE),
}
