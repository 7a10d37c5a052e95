"""Catalogue and monitoring queries with their DuckDB twins."""

from pyspark.sql import functions as F

from skerry.operators import catalog as c
from skerry.operators import monitoring as m
from skerry.operators import referential
from skerry.plans.views import duck, v_chunks, v_costs, v_documents, v_projects, v_search_logs, v_users

AS_OF = "2024-01-31 00:00:00"
DOC = ("document_id", "filename", "status", "mime_type", "created_at")


def _keyed(spark, d):
    return v_documents(spark, d).withColumn("file_key", F.expr("concat(case when document_id % 4 = 0 then 'pending/' else 'uploads/' end, filename)"))


def _timed(spark, d):
    return v_documents(spark, d).withColumn("processing_started_at", F.col("created_at")).withColumn(
        "processing_completed_at", F.expr("case when status = 'indexed' then created_at + make_dt_interval(0, 0, 0, file_size_bytes % 997) end"))


def list_documents(spark, d):
    return c.list_documents(v_documents(spark, d), "src3", status="indexed", page=2, per_page=10).select(*DOC)


def filter_sort_documents(spark, d):
    return c.filter_sort_documents(v_documents(spark, d), "report 1", "spreadsheet", "name").select("document_id", "name", "mime_type")


def _embedded(spark, d):
    return v_chunks(spark, d).withColumn("embedding", F.expr("case when chunk_index % 3 <> 0 then 1 end")).withColumn("embedding_model", F.expr("case when chunk_index % 3 <> 0 then concat('m', chunk_index % 2) end"))


def document_detail(spark, d):
    return c.document_detail(v_documents(spark, d), v_users(spark, d), _embedded(spark, d))


def document_status(spark, d):
    return c.document_status(v_documents(spark, d))


def failed_documents(spark, d):
    return c.failed_documents(v_documents(spark, d)).select(*DOC)


def plan_retries(spark, d):
    return c.plan_retries(_keyed(spark, d))


def list_chunks(spark, d):
    return c.list_chunks(v_chunks(spark, d), 5)


def search_history(spark, d):
    history = v_search_logs(spark, d).withColumn("project_id", F.expr("element_at(array('en','de','fr','es','xx'), cast(event_id % 5 as int) + 1)"))
    return m.search_history(history, v_projects(spark, d)).select("event_id", "user_id", "query_text", "project_name")


def purge(spark, d):
    docs, gone = v_documents(spark, d), v_users(spark, d).filter("user_id in ('src0', 'src5')")
    audit = docs.select("document_id", F.col("uploaded_by").alias("user_id"))
    out = c.purge({"documents": docs, "chunks": v_chunks(spark, d), "costs": v_costs(spark, d), "audit": audit}, gone)
    rows = [t.groupBy().agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum("document_id").alias("id_sum")) for n, t in out.items()]
    rows.append(out["audit"].filter("user_id is null").groupBy().agg(F.lit("orphans").alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum("document_id").alias("id_sum")))
    total = rows[0]
    for r in rows[1:]:
        total = total.unionByName(r)
    return total


def _library(spark, d):
    """All tables that keys connect; projects, logs and answers refer to each other in ways of the test data's own making."""
    docs, user = v_documents(spark, d), F.concat(F.lit("src"), F.expr("event_id % 20"))
    logs = v_search_logs(spark, d).select("event_id", user.alias("user_id"), F.expr("element_at(array('en','de','fr','es'), cast(event_id % 4 as int) + 1)").alias("project_id"))
    members = docs.selectExpr("project_id", "concat('src', document_id % 20) as user_id").distinct()
    return {"users": v_users(spark, d), "projects": v_projects(spark, d), "memberships": members, "documents": docs.select("document_id", "uploaded_by", "project_id"),
            "chunks": v_chunks(spark, d).select("document_id", "chunk_index"), "costs": v_costs(spark, d).select("document_id", "user_id"), "logs": logs,
            "history": logs, "queries": logs.withColumn("search_log_id", F.expr("event_id - event_id % 7")), "audit": docs.selectExpr("document_id", "uploaded_by as user_id")}


#: Of each table: a number to add up, and the references that are counted.
_TALLY = {"users": ("0", []), "projects": ("0", ["owner_id"]), "memberships": ("0", ["project_id", "user_id"]), "documents": ("document_id", ["project_id", "uploaded_by"]),
          "chunks": ("document_id * 1000 + chunk_index", []), "costs": ("document_id", ["user_id"]), "logs": ("event_id", ["project_id"]), "history": ("event_id", ["project_id"]),
          "queries": ("event_id", ["project_id", "search_log_id"]), "audit": ("document_id", ["user_id"])}


def _tallied(tables):
    rows = [tables[n].groupBy().agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.expr(number).cast("long")), F.lit(0)).alias("id_sum"),
                                    F.coalesce(F.sum(sum([F.col(r).isNotNull().cast("long") for r in refs], F.lit(0).cast("long"))), F.lit(0)).alias("references")) for n, (number, refs) in _TALLY.items()]
    total = rows[0]
    for r in rows[1:]:
        total = total.unionByName(r)
    return total


def purge_users(spark, d):
    tables = _library(spark, d)
    return _tallied(referential.purge_rows(tables, {"users": tables["users"].filter("user_id in ('src0', 'src5', 'src7')")}))


def purge_projects(spark, d):
    tables = _library(spark, d)
    return _tallied(referential.purge_rows(tables, {"projects": tables["projects"].filter("project_id in ('de', 'es')")}))


def purge_documents(spark, d):
    tables = _library(spark, d)
    return _tallied(referential.purge_rows(tables, {"documents": tables["documents"].filter("document_id % 3 = 1"), "logs": tables["logs"].filter("event_id % 14 = 0")}))


def clear_history(spark, d):
    logs = v_search_logs(spark, d)
    return c.clear_history(logs, logs.filter("user_id % 3 = 0").select("user_id")).select("event_id", "user_id")


def log_searches(spark, d):
    docs = v_documents(spark, d)
    queries = docs.select(F.col("document_id").alias("query_id"), F.col("uploaded_by").alias("user_id"), F.col("filename").alias("text"),
                          F.lit("keyword").alias("search_type"), F.expr("cast(document_id % 700 as int)").alias("search_time_ms"))
    results = v_chunks(spark, d).filter("document_id % 3 <> 0").select(F.col("document_id").alias("query_id"))
    return m.log_searches(queries, results, AS_OF)[1]


def search_latency_alert(spark, d):
    return m.search_latency_alert(v_search_logs(spark, d))


def embedding_cost_totals(spark, d):
    return m.embedding_costs(v_costs(spark, d), v_users(spark, d), AS_OF)[0]


def embedding_costs(spark, d):
    return m.embedding_costs(v_costs(spark, d), v_users(spark, d), AS_OF)[1]


def content_gaps(spark, d):
    return m.content_gaps(v_search_logs(spark, d))


def mode_comparison(spark, d):
    return m.mode_comparison(v_search_logs(spark, d))


def answer_feedback(spark, d):
    logs = v_search_logs(spark, d)
    answers = logs.select(F.expr("case when event_id % 6 = 0 then null else event_id end").alias("search_log_id"),
                          F.expr("case event_id % 3 when 0 then true when 1 then false end").alias("helpful"))
    return m.answer_feedback(answers, logs)


def usage_summary(spark, d):
    logs = v_search_logs(spark, d).withColumn("user_id", F.concat(F.lit("src"), F.expr("user_id % 25")))
    return c.usage_summary(v_users(spark, d), v_documents(spark, d), logs, AS_OF)


def project_summary(spark, d):
    return c.project_summary(v_projects(spark, d), v_documents(spark, d).filter("project_id <> 'fr'"))


def apply_document_updates(spark, d):
    patches = v_documents(spark, d).filter("document_id % 4 = 0").selectExpr(
        "document_id", "case when document_id % 8 = 0 then 'moved' end as project_id", "case when document_id % 12 = 0 then 'indexed' end as status")
    return c.apply_document_updates(v_documents(spark, d), patches).select("document_id", "project_id", "status")


def readiness(spark, d):
    return c.readiness(v_documents(spark, d))


def processing_durations(spark, d):
    return c.processing_durations(_timed(spark, d))


def status_transitions(spark, d):
    seen = v_search_logs(spark, d).selectExpr("user_id as document_id", "created_at as seen_at",
                                              "element_at(array('pending','processing','ready','indexed','error'), cast(event_id % 5 as int) + 1) as status")
    return c.status_transitions(seen)


QUERIES = {f.__name__: f for f in (
    list_documents, filter_sort_documents, document_detail, document_status, failed_documents, plan_retries, list_chunks, search_history, purge, purge_users, purge_projects, purge_documents,
    clear_history, log_searches, search_latency_alert, embedding_cost_totals, embedding_costs, content_gaps, mode_comparison, answer_feedback,
    usage_summary, project_summary, apply_document_updates, readiness, processing_durations, status_transitions)}

_MONTH = f"created_at >= date_trunc('month', timestamp '{AS_OF}') and created_at <= timestamp '{AS_OF}'"
_LIBRARY = {
    "t_users": "select user_id from v_users", "t_projects": "select project_id, owner_id from v_projects",
    "t_memberships": "select distinct project_id, concat('src', cast(document_id % 20 as varchar)) as user_id from v_documents",
    "t_documents": "select document_id, uploaded_by, project_id from v_documents", "t_chunks": "select document_id, chunk_index from v_chunks", "t_costs": "select document_id, user_id from v_costs",
    "t_logs": "select event_id, concat('src', cast(event_id % 20 as varchar)) as user_id, ['en','de','fr','es'][event_id % 4 + 1] as project_id from v_search_logs",
    "t_audit": "select document_id, uploaded_by as user_id from v_documents",
}


def _purged(users: str, projects: str, documents: str, logs: str) -> str:
    """Conditions under which rows of the four tables that others refer to go, in SQL; the rest follows from their keys."""
    gone = {"x_users": f"select user_id as k from t_users where {users}",
            "x_projects": f"select project_id as k from t_projects where {projects} or owner_id in (select k from x_users)",
            "x_documents": f"select document_id as k from t_documents where {documents} or uploaded_by in (select k from x_users)",
            "x_logs": f"select event_id as k from t_logs where {logs} or user_id in (select k from x_users)"}
    kept = lambda c, t: f"(case when {c} in (select k from {t}) then null else {c} end)"
    project = kept("project_id", "x_projects")
    after = {
        "users": ("select user_id from t_users where user_id not in (select k from x_users)", "0", []),
        "projects": ("select owner_id from t_projects where project_id not in (select k from x_projects)", "0", ["owner_id"]),
        "memberships": ("select project_id, user_id from t_memberships where project_id not in (select k from x_projects) and user_id not in (select k from x_users)", "0", ["project_id", "user_id"]),
        "documents": (f"select document_id, uploaded_by, {project} as p from t_documents where document_id not in (select k from x_documents)", "document_id", ["p", "uploaded_by"]),
        "chunks": ("select * from t_chunks where document_id not in (select k from x_documents)", "document_id * 1000 + chunk_index", []),
        "costs": ("select * from t_costs where document_id not in (select k from x_documents) and user_id not in (select k from x_users)", "document_id", ["user_id"]),
        "logs": (f"select event_id, {project} as p from t_logs where event_id not in (select k from x_logs)", "event_id", ["p"]),
        "history": (f"select event_id, {project} as p from t_logs where user_id not in (select k from x_users)", "event_id", ["p"]),
        "queries": (f"select event_id, {project} as p, {kept('(event_id - event_id % 7)', 'x_logs')} as s from t_logs where user_id not in (select k from x_users)", "event_id", ["p", "s"]),
        "audit": (f"select document_id, {kept('user_id', 'x_users')} as u from t_audit", "document_id", ["u"]),
    }
    parts = [f"""select '{n}' as table_name, count(*) as n_rows, coalesce(sum({number}), 0)::bigint as id_sum, coalesce(sum({' + '.join(['0', *[f"({r} is not null)::int" for r in refs]])}), 0)::bigint as "references" from ({sql})"""
             for n, (sql, number, refs) in after.items()]
    return duck(" union all ".join(parts), "v_users", "v_projects", "v_documents", "v_chunks", "v_costs", "v_search_logs", **_LIBRARY, **gone)


SQL = {
    "list_documents": duck(f"select {', '.join(DOC)} from v_documents where uploaded_by = 'src3' and status = 'indexed' order by created_at desc, document_id limit 10 offset 10", "v_documents"),
    "filter_sort_documents": duck("""select document_id, coalesce(display_name, filename) as name, mime_type from v_documents
        where contains(lower(coalesce(display_name, filename)), 'report 1') and mime_type in ('text/csv', 'application/vnd.ms-excel', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet')""", "v_documents"),
    "document_detail": duck("""select document_id, full_name as uploader, status, case when status in ('ready','indexed') then left(frst, 500) end as preview,
        case when status in ('ready','indexed') then coalesce(n, 0) end as embedded_chunks, case when status in ('ready','indexed') then model end as embedding_model
        from v_documents d left join v_users u on u.user_id = d.uploaded_by left join (select document_id, min_by(content, chunk_index) as frst, count(*) filter (chunk_index % 3 <> 0) as n,
          max(case when chunk_index % 3 <> 0 then concat('m', cast(chunk_index % 2 as varchar)) end) as model from v_chunks group by 1) c using (document_id)""", "v_documents", "v_users", "v_chunks"),
    "document_status": duck("select document_id, status, case status when 'processing' then 50 when 'ready' then 75 when 'indexed' then 100 else 0 end as progress from v_documents", "v_documents"),
    "failed_documents": duck(f"select {', '.join(DOC)} from v_documents where status = 'error' or (status = 'ready' and embedding_status = 'error')", "v_documents"),
    "plan_retries": duck("""select document_id, action, case when action = 're_parse' then 'processing' else status end as status,
        case action when 're_parse' then 'pending' when 're_embed' then 'generating' else embedding_status end as embedding_status
        from (select *, case when status = 'ready' and embedding_status = 'error' then 're_embed' when status = 'error' and document_id % 4 = 0 then 'reject_file_not_ready'
          when status = 'error' then 're_parse' else 'reject' end as action from v_documents)""", "v_documents"),
    "list_chunks": duck("select document_id, chunk_index, content from v_chunks where chunk_index < 5", "v_chunks"),
    "search_history": duck("""select event_id, user_id, query_text, p.name as project_name from (select *, row_number() over (partition by user_id order by created_at desc, event_id desc) as r from v_search_logs) h
        left join v_projects p on p.project_id = ['en','de','fr','es','xx'][event_id % 5 + 1] where r <= 20""", "v_search_logs", "v_projects"),
    "purge": duck("""select 'documents' as table_name, count(*) as n_rows, sum(document_id)::bigint as id_sum from v_documents where uploaded_by not in ('src0','src5')
        union all select 'chunks', count(*), sum(document_id)::bigint from v_chunks join v_documents using (document_id) where uploaded_by not in ('src0','src5')
        union all select 'costs', count(*), sum(document_id)::bigint from v_costs where user_id not in ('src0','src5')
        union all select 'audit', count(*), sum(document_id)::bigint from v_documents
        union all select 'orphans', count(*), sum(document_id)::bigint from v_documents where uploaded_by in ('src0','src5')""", "v_documents", "v_chunks", "v_costs"),
    "purge_users": _purged("user_id in ('src0', 'src5', 'src7')", "false", "false", "false"),
    "purge_projects": _purged("false", "project_id in ('de', 'es')", "false", "false"),
    "purge_documents": _purged("false", "false", "document_id % 3 = 1", "event_id % 14 = 0"),
    "clear_history": duck("select event_id, user_id from v_search_logs where user_id % 3 <> 0", "v_search_logs"),
    "log_searches": duck(f"""select document_id as query_id, uploaded_by as user_id, sha256(filename) as query_hash, 'keyword' as search_type, coalesce(n, 0) as result_count,
        cast(document_id % 700 as int) as search_time_ms, coalesce(n, 0) > 0 as had_results, timestamp '{AS_OF}' as created_at
        from v_documents left join (select document_id, count(*) as n from v_chunks where document_id % 3 <> 0 group by 1) using (document_id)""", "v_documents", "v_chunks"),
    "search_latency_alert": duck("""select event_id, user_id, mean_ms, case when mean_ms > 5000 then 'error' when mean_ms > 2000 then 'warning' else 'ok' end as level
        from (select event_id, user_id, round(avg(search_time_ms) over (partition by user_id order by created_at, event_id rows between 19 preceding and current row), 6) as mean_ms from v_search_logs)""", "v_search_logs"),
    "embedding_cost_totals": duck(f"""select round(coalesce(sum(cost_usd)::double, 0), 8) as total_cost_usd, round(coalesce(avg(cost_usd::double), 0), 8) as mean_cost_usd,
        round(coalesce(sum(cost_usd)::double, 0) / 31 * 31, 6) as projected_cost_usd from v_costs where {_MONTH}""", "v_costs"),
    "embedding_costs": duck(f"""select user_id, full_name, email, sum(cost_usd)::double as total_cost_usd from v_costs join v_users using (user_id) where {_MONTH}
        group by all order by total_cost_usd desc, user_id limit 10""", "v_costs", "v_users"),
    "content_gaps": duck("select * from (select query_hash, count(*) as searches, count(*) filter (not had_results) as without_results from v_search_logs group by 1) where without_results > 0", "v_search_logs"),
    "mode_comparison": duck("""select search_type, count(*) as searches, round(avg(had_results::int), 6) as hit_rate, round(avg(result_count), 6) as mean_results, round(avg(search_time_ms), 6) as mean_ms,
        round(quantile_cont(search_time_ms, 0.95), 6) as p95_ms from v_search_logs group by 1""", "v_search_logs"),
    "answer_feedback": duck("""select l.search_type, count(*) as answers, count(helpful) as rated, round(avg(helpful::int), 6) as helpful_rate
        from (select case when event_id % 6 = 0 then null else event_id end as log_id, case event_id % 3 when 0 then true when 1 then false end as helpful from v_search_logs) a
        left join v_search_logs l on l.event_id = a.log_id group by 1""", "v_search_logs"),
    "usage_summary": duck(f"""select user_id, coalesce(n, 0) as documents, coalesce(b, 0)::bigint as storage_bytes, coalesce(q, 0) as queries_this_month from v_users
        left join (select uploaded_by as user_id, count(*) as n, sum(file_size_bytes) as b from v_documents group by 1) using (user_id)
        left join (select concat('src', cast(user_id % 25 as varchar)) as user_id, count(*) as q from v_search_logs where {_MONTH} group by 1) using (user_id)""", "v_users", "v_documents", "v_search_logs"),
    "project_summary": duck("""select project_id, owner_id, name, coalesce(n, 0) as document_count from v_projects
        left join (select project_id, count(*) as n from v_documents where project_id <> 'fr' group by 1) using (project_id) where not is_archived""", "v_projects", "v_documents"),
    "apply_document_updates": duck("select document_id, case when document_id % 8 = 0 then 'moved' else project_id end as project_id, case when document_id % 12 = 0 then 'indexed' else status end as status from v_documents", "v_documents"),
    "readiness": duck("select uploaded_by, count(*) as total, count(*) filter (status = 'indexed') as indexed, count(*) filter (status = 'indexed') = 0 as still_indexing from v_documents group by 1", "v_documents"),
    "processing_durations": duck("""select mime_type, count(*) as documents, quantile_cont((file_size_bytes % 997)::double, 0.5) as median_seconds, max(file_size_bytes % 997) as max_seconds
        from v_documents where status = 'indexed' group by 1""", "v_documents"),
    "status_transitions": duck("""select document_id, status, min(seen_at) as seen_at from (select *, lag(status) over (partition by document_id order by seen_at) as before from s)
        where status in ('indexed','error') and (before is null or before <> status) group by all""", "v_search_logs",
        s="select user_id as document_id, created_at as seen_at, ['pending','processing','ready','indexed','error'][event_id % 5 + 1] as status from v_search_logs"),
}
