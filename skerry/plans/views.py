"""Adapter views: the generated tables in the shape that the operators expect, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DOCUMENT_COLUMNS = """doc_id as document_id, source as uploaded_by, lang as project_id,
  concat('doc_', cast(doc_id as varchar(20)), '.txt') as filename,
  case when doc_id % 3 = 0 then null else concat('Report ', cast(doc_id as varchar(20))) end as display_name,
  case doc_id % 7 when 0 then 'application/pdf' when 1 then 'text/csv' when 2 then 'text/plain' when 3 then 'text/markdown'
    when 4 then 'application/json' when 5 then 'image/png' else 'application/vnd.ms-excel' end as mime_type,
  case when doc_id % 11 = 0 then 'error' when doc_id % 5 = 0 then 'ready' when doc_id % 13 = 0 then 'processing' else 'indexed' end as status,
  case when doc_id % 11 = 0 or doc_id % 10 = 0 then 'error' when doc_id % 5 = 0 then 'generating'
    when doc_id % 13 = 0 then 'pending' else 'complete' end as embedding_status,
  n_chars as file_size_bytes, {epoch} + doc_id * interval '1' hour as created_at, text"""
_SPARK_EPOCH, _DUCK_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'", "timestamp '2024-01-01 00:00:00'"


def v_documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"select {_DOCUMENT_COLUMNS.format(epoch=_SPARK_EPOCH)} from {{t}}", t=load_table(spark, d, "documents"))


def v_chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("""select document_id, cast(row_number() over (partition by document_id order by pos) - 1 as int) as chunk_index, content
      from (select doc_id as document_id, posexplode(split(text, '\\n')) as (pos, content) from {t}) x where trim(content) <> ''""",
                     t=load_table(spark, d, "documents"))


def v_vectors(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.expr("cast(floor(vec_id / 5) as bigint)").alias("document_id"),
        F.expr("cast(vec_id % 5 as int)").alias("chunk_index"), "embedding")


def v_vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with the content of their chunk, where there is one."""
    return v_vectors(spark, d).join(v_chunks(spark, d), ["document_id", "chunk_index"], "left").withColumn(
        "content", F.coalesce("content", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))))


def v_vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return v_vectors(spark, d).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def v_text_queries(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("""select item_id as query_id, concat_ws(' ', lower(w[3]), lower(w[5])) as text
      from (select item_id, regexp_extract_all(text, '[A-Za-z]+', 0) as w from {t}) x""", t=load_table(spark, d, "benchmark"))


def v_search_logs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("""select event_id, user_id, sha2(props, 256) as query_hash, props as query_text,
      case when event_type in ('click','view') then 'semantic' when event_type in ('signup','error') then 'keyword' else 'hybrid' end as search_type,
      case when event_type = 'error' then 0 else event_id % 10 + 1 end as result_count,
      cast(floor(value * 100) as int) as search_time_ms, event_type <> 'error' as had_results, ts as created_at from {t}""",
                     t=load_table(spark, d, "events"))


def v_pages(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "conversations").select(
        F.col("conv_id").alias("document_id"), F.expr("cast(turn + 1 as int)").alias("page_number"), "text")


_CELL_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def v_cells(spark: SparkSession, d: str) -> DataFrame:
    stack = ", ".join(f"{i}, '{c}', cast({c} as string)" for i, c in enumerate(_CELL_COLUMNS, 1))
    return load_table(spark, d, "customer").select(
        F.lit("customer").alias("dataset"), F.col("c_custkey").alias("row_no"),
        F.expr(f"stack({len(_CELL_COLUMNS)}, {stack}) as (col_no, column_name, value)"))


def v_projects(spark: SparkSession, d: str) -> DataFrame:
    return v_documents(spark, d).groupBy("project_id").agg(F.min("uploaded_by").alias("owner_id")).select(
        "project_id", "owner_id", F.concat(F.lit("Project "), F.col("project_id")).alias("name"), (F.col("project_id") == "es").alias("is_archived"))


def v_users(spark: SparkSession, d: str) -> DataFrame:
    return v_documents(spark, d).select(F.col("uploaded_by").alias("user_id")).distinct().select(
        "user_id", F.concat(F.lit("User "), "user_id").alias("full_name"), F.concat("user_id", F.lit("@example.org")).alias("email"))


def v_costs(spark: SparkSession, d: str) -> DataFrame:
    return v_documents(spark, d).filter("status = 'indexed'").select(
        "document_id", F.col("uploaded_by").alias("user_id"), F.size(F.expr("regexp_extract_all(text, '\\\\S+', 0)")).cast("long").alias("token_count"), "created_at"
    ).withColumn("cost_usd", F.expr("cast(token_count * 0.00000002 as decimal(12,8))"))


DUCK = {
    "v_documents": f"select {_DOCUMENT_COLUMNS.format(epoch=_DUCK_EPOCH)} from documents",
    "v_chunks": """select document_id, cast(row_number() over (partition by document_id order by pos) - 1 as int) as chunk_index, content
      from (select doc_id as document_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as content from documents) x
      where trim(content) <> ''""",
    "v_vectors": "select vec_id as chunk_id, cast(floor(vec_id / 5) as bigint) as document_id, cast(vec_id % 5 as int) as chunk_index, embedding from embeddings",
    "v_vector_chunks": """select v.chunk_id, v.document_id, v.chunk_index, v.embedding, coalesce(c.content, concat('chunk ', cast(v.chunk_id as varchar))) as content
      from v_vectors v left join v_chunks c on v.document_id = c.document_id and v.chunk_index = c.chunk_index""",
    "v_vector_queries": "select chunk_id as query_id, embedding as query_vector from v_vectors where chunk_id % 50 = 0",
    "v_text_queries": """select item_id as query_id, concat_ws(' ', lower(w[4]), lower(w[6])) as text
      from (select item_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark) x""",
    "v_search_logs": """select event_id, user_id, sha256(props) as query_hash, props as query_text,
      case when event_type in ('click','view') then 'semantic' when event_type in ('signup','error') then 'keyword' else 'hybrid' end as search_type,
      case when event_type = 'error' then 0 else event_id % 10 + 1 end as result_count,
      cast(floor(value * 100) as int) as search_time_ms, event_type <> 'error' as had_results, ts as created_at from events""",
    "v_pages": "select conv_id as document_id, cast(turn + 1 as int) as page_number, text from conversations",
    "v_cells": "select 'customer' as dataset, c_custkey as row_no, n as col_no, k as column_name, v as value from customer, lateral (values "
               + ", ".join(f"({i}, '{c}', cast({c} as varchar))" for i, c in enumerate(_CELL_COLUMNS, 1)) + ") u(n, k, v)",
    "v_projects": """select project_id, min(uploaded_by) as owner_id, concat('Project ', project_id) as name, project_id = 'es' as is_archived
      from v_documents group by project_id""",
    "v_users": "select distinct uploaded_by as user_id, concat('User ', uploaded_by) as full_name, concat(uploaded_by, '@example.org') as email from v_documents",
    "v_costs": """select document_id, uploaded_by as user_id, token_count, created_at, cast(token_count * 0.00000002 as decimal(12,8)) as cost_usd
      from (select *, len(regexp_extract_all(text, '\\S+'))::bigint as token_count from v_documents where status = 'indexed')""",
}
_NEEDS = {"v_vector_chunks": ["v_vectors", "v_chunks"], "v_vector_queries": ["v_vectors"], "v_projects": ["v_documents"], "v_users": ["v_documents"],
          "v_costs": ["v_documents"]}


def duck(body: str, /, *views: str, **ctes: str) -> str:
    """DuckDB SQL with the named views, then named sub-queries, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    parts = [f"{v} as ({DUCK[v]})" for v in order] + [f"{k} as ({q})" for k, q in ctes.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
