"""Search queries over the adapter views, with their DuckDB twins."""

from pyspark.sql import functions as F

from skerry.functions.stem import DUCK, stem_sql
from skerry.operators import keyword as kw
from skerry.operators import quantised as qt
from skerry.operators import search as s
from skerry.operators import vectors as v
from skerry.plans.views import (duck, v_chunks, v_documents, v_projects, v_search_logs, v_text_queries, v_vector_chunks, v_vector_queries,
                                v_vectors)
from skerry.sources.inverted import InvertedIndex
from skerry.sources.shared import cut_lineage, new_folder, remove_folder

OTHER = {"chunk_id": "query_id"}
AS_OF = "2024-01-31 00:00:00"
K, THRESHOLD, POOL = 10, 0.1, 30
#: Of the index of inverted lists; see the README for what fewer probes find on vectors that have no clusters.
LISTS, NPROBE, RERANK = 20, 16, 100
RESULT = ("query_id", "document_id", "chunk_index", "content", "context_before", "context_after", "score", "position")


def exact_knn(spark, d):
    return v.exact_knn(v_vectors(spark, d), v_vector_queries(spark, d), K, THRESHOLD, differ=OTHER)


def _semantic(spark, d, k=K, threshold=THRESHOLD):
    return s.semantic_search(v_vector_chunks(spark, d), v_chunks(spark, d), v_vector_queries(spark, d), k, threshold, OTHER)


def semantic_search(spark, d):
    return _semantic(spark, d).select(*RESULT)


def similar_documents(spark, d):
    vectors = v_vectors(spark, d)
    return v.similar_documents(vectors, vectors.filter("document_id % 50 = 0").select("document_id").distinct())


def _quantised(spark, d):
    folder = new_folder(spark, "quantised")
    return folder, qt.build_quantised(v_vectors(spark, d), folder, lists=LISTS)


def ann_knn(spark, d):
    folder, index = _quantised(spark, d)
    out = cut_lineage(qt.quantised_knn(index, v_vectors(spark, d), v_vector_queries(spark, d), NPROBE, K, RERANK))
    remove_folder(spark, folder)
    return out


def knn_recall(spark, d):
    """Recall of ann_knn as registered (same lists, probes and queries), and the shares of all rows that it met as codes and scored exactly."""
    vectors, queries = v_vectors(spark, d), v_vector_queries(spark, d)
    folder, index = _quantised(spark, d)
    exact = v.exact_knn(vectors, queries, K, differ=OTHER)
    recall = v.knn_recall(exact, qt.quantised_knn(index, vectors, queries, NPROBE, K, RERANK))
    out = cut_lineage(recall.join(qt.scan_shares(index, queries, NPROBE, RERANK), "query_id"))
    remove_folder(spark, folder)
    return out


_indexes: dict[tuple[str, str], InvertedIndex] = {}


def _index(spark, d):
    """The stored index of a directory's chunks: built by the first search of an application, in two deliveries, and searched by all others."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        index, chunks = InvertedIndex(spark, new_folder(spark, "index")), v_chunks(spark, d)
        index.add(chunks.filter("document_id % 10 <> 0"), "build", 0)
        index.add(chunks.filter("document_id % 10 = 0"), "build", 1)
        _indexes[key] = index
    return _indexes[key]


def _postings(spark, d):
    return _index(spark, d).postings()


def build_postings(spark, d):
    return kw.build_postings(v_chunks(spark, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


def _asked(spark, d):
    """Text queries in four shapes: plain, phrase, negated second word, either word."""
    q = v_text_queries(spark, d)
    a, b = F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))
    shape = F.col("query_id") % 4
    return q.withColumn("text", F.when(shape == 1, F.concat(F.lit('"'), "text", F.lit('"'))).when(shape == 2, F.concat(a, F.lit(" -"), b))
                        .when(shape == 3, F.concat(a, F.lit(" or "), b)).otherwise(F.col("text")))


def parse_web_query(spark, d):
    return kw.parse_web_query(_asked(spark, d)).withColumn("terms", F.array_join("terms", " "))


def match_postings(spark, d):
    return kw.match_postings(_postings(spark, d), kw.parse_web_query(_asked(spark, d)))


def cover_density_rank(spark, d):
    return kw.cover_density_rank(_postings(spark, d), kw.parse_web_query(v_text_queries(spark, d)))


def _keyword(spark, d, k=K):
    return s.keyword_search(_index(spark, d), v_chunks(spark, d), v_text_queries(spark, d), k)


def keyword_search(spark, d):
    return _keyword(spark, d).select(*RESULT)


def scope_corpus(spark, d):
    q = spark.createDataFrame([(1, "src0", None, None, None), (2, "src1", "en", None, None), (3, "src2", None, "2024-01-20 00:00:00", None),
                               (4, "src3", None, None, ["text/plain", "application/pdf"])],
                              "query_id long, user_id string, project_id string, since string, mime_types array<string>")
    q = q.withColumn("since", F.col("since").cast("timestamp_ntz")).withColumn("document_ids", F.lit(None).cast("array<bigint>"))
    docs = v_documents(spark, d)  # and a request for every document: it and two others, as far as they are the same user's and type
    named = docs.selectExpr("document_id + 1000 as query_id", "uploaded_by as user_id", "cast(null as string) as project_id", "cast(null as timestamp_ntz) as since",
                            "array(mime_type) as mime_types", "array(document_id, document_id + 1, document_id + 20, null) as document_ids")
    return s.scope_corpus(v_chunks(spark, d), docs, q.unionByName(named)).select("query_id", "document_id", "chunk_index", "content")


def _ranked(spark, d):
    """Chunks ranked by a made-up score within a document's language: the input of the steps after ranking."""
    docs = v_documents(spark, d).select("document_id", F.expr("document_id % 50").alias("query_id"))
    out = v_chunks(spark, d).join(docs, "document_id").withColumn("score", F.expr("round((document_id * 7 + chunk_index * 13) % 101 / 101.0, 6)").cast("double"))
    return out.selectExpr("*", "row_number() over (partition by query_id order by score desc, document_id, chunk_index) as rank")


def dedupe_by_content(spark, d):
    return s.dedupe_by_content(_ranked(spark, d)).select("query_id", "document_id", "chunk_index", "score", "rank")


def attach_context(spark, d):
    return s.attach_context(_ranked(spark, d), v_chunks(spark, d)).select("query_id", "document_id", "chunk_index", "context_before", "context_after")


def group_by_document(spark, d):
    return s.group_by_document(_ranked(spark, d)).select("query_id", "document_id", "chunk_index", "position")


def rrf_fuse(spark, d):
    semantic = s.group_by_document(_ranked(spark, d).filter("rank <= 30"))
    words = s.group_by_document(_ranked(spark, d).filter("rank between 20 and 50").withColumn("rank", F.col("rank") - 19))
    return s.rrf_fuse(semantic, words, K)


def hybrid_search(spark, d):
    out = s.hybrid_search(v_vector_chunks(spark, d), _index(spark, d), v_chunks(spark, d), v_vector_queries(spark, d),
                          v_text_queries(spark, d), K, THRESHOLD, OTHER)
    return out.select("query_id", "document_id", "chunk_index", "score", "position")


def _scope(spark, d, queries):
    """Each query is asked by one user, who sees only the own documents."""
    users = queries.select("query_id", F.concat(F.lit("src"), F.expr("query_id % 20")).alias("user_id"))
    return s.visible_documents(v_documents(spark, d), users)


def scoped_semantic_search(spark, d):
    queries = v_vector_queries(spark, d)
    return s.semantic_search(v_vector_chunks(spark, d), v_chunks(spark, d), queries, K, THRESHOLD, OTHER, _scope(spark, d, queries)).select(*RESULT)


def scoped_keyword_search(spark, d):
    queries = v_text_queries(spark, d)
    return s.keyword_search(_index(spark, d), v_chunks(spark, d), queries, K, _scope(spark, d, queries)).select(*RESULT)


def scoped_hybrid_search(spark, d):
    vectors, texts = v_vector_queries(spark, d), v_text_queries(spark, d)
    scope = _scope(spark, d, vectors.select("query_id").union(texts.select("query_id")).distinct())
    out = s.hybrid_search(v_vector_chunks(spark, d), _index(spark, d), v_chunks(spark, d), vectors, texts, K, THRESHOLD, OTHER, scope)
    return out.select("query_id", "document_id", "chunk_index", "score", "position")


def stems(spark, d):
    words = v_chunks(spark, d).select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    return kw.stems(words)


def best_sentence(spark, d):
    return s.best_sentence(_keyword(spark, d), v_text_queries(spark, d))


def _prefixes(spark, d):
    """Five fixed requests, and one for every document: its user types the first letters of its name, or the last ones in capitals."""
    typed = v_documents(spark, d).selectExpr("document_id + 1000 as query_id", "uploaded_by as user_id",
                                             "if(document_id % 2 = 0, substring(filename, 1, 5), upper(right(filename, 6))) as prefix")
    return typed.unionByName(spark.createDataFrame([(1, "src0", "doc_1"), (2, "src1", "Report 2"), (3, "src10", "project"), (4, "src2", "do"), (5, "src3", "doc%")],
                                 "query_id long, user_id string, prefix string"))


def _history(spark, d):
    return v_search_logs(spark, d).select("event_id", F.concat(F.lit("src"), F.expr("user_id % 20")).alias("user_id"),
                                          F.concat(F.lit("doc_1"), F.expr("event_id % 7")).alias("query_text"), "created_at")


def suggest(spark, d):
    return s.suggest(_prefixes(spark, d), _history(spark, d), v_documents(spark, d), v_projects(spark, d))


def check_access(spark, d):
    docs = v_documents(spark, d)
    requests = docs.select(F.col("document_id").alias("query_id"), F.concat(F.lit("src"), F.expr("document_id % 9")).alias("user_id"), "document_id", "project_id")
    return s.check_access(requests, docs, v_projects(spark, d))


def resolve_filters(spark, d):
    docs = v_documents(spark, d)
    q = docs.selectExpr("document_id as query_id", "element_at(array('pdf','csv','excel','image','text','none'), cast(document_id % 6 as int) + 1) as category",
                        "element_at(array('week','month','3months','all'), cast(document_id % 4 as int) + 1) as period")
    return s.resolve_filters(q, AS_OF)


QUERIES = {f.__name__: f for f in (
    exact_knn, semantic_search, similar_documents, ann_knn, knn_recall, build_postings, parse_web_query, match_postings, cover_density_rank,
    keyword_search, scoped_semantic_search, scoped_keyword_search, scoped_hybrid_search, stems, scope_corpus, dedupe_by_content, attach_context, group_by_document, rrf_fuse, hybrid_search, best_sentence, suggest,
    check_access, resolve_filters)}

# --- DuckDB twins ---------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
_COS = (f"round({_DOT.format(a='v.embedding', b='q.query_vector')} / (nullif(sqrt({_DOT.format(a='v.embedding', b='v.embedding')}), 0) * "
        f"nullif(sqrt({_DOT.format(a='q.query_vector', b='q.query_vector')}), 0)), 6)")


def _knn_ctes(table: str, k: int, threshold: float, scope: bool = False) -> dict[str, str]:
    seen = " and (q.query_id, v.document_id) in (select (query_id, document_id) from scope)" if scope else ""
    return {"scored": f"select q.query_id, v.*, {_COS} as similarity from {table} v, v_vector_queries q where v.chunk_id <> q.query_id and v.embedding is not null{seen}",
            "knn": f"""select * from (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from scored
                where similarity is not null) where rank <= {k} and similarity > {threshold}"""}


_STOP = ", ".join(f"'{w}'" for w in kw.STOP_WORDS)


def _stem(t: str) -> str:
    return stem_sql(t, DUCK)


_POSTINGS = {
    "words": """select document_id, chunk_index, generate_subscripts(w, 1) as pos, unnest(w) as word
        from (select document_id, chunk_index, regexp_extract_all(lower(content), '[a-z0-9]+') as w from v_chunks)""",
    "stems": f"select word, {_stem('word')} as term from (select distinct word from words) as d",
    "hits": f"select document_id, chunk_index, pos, term from words join stems using (word) where word not in ({_STOP})",
    "postings": "select term, document_id, chunk_index, list(pos order by pos) as positions, count(*) as tf from hits group by all",
}


def _parsed(table: str) -> dict[str, str]:
    return {
        "tokens": f"""select query_id, generate_subscripts(t, 1) - 1 as clause_id, unnest(t) as token
            from (select query_id, regexp_extract_all(lower(text), '-?"[^"]*"|\\S+') as t from {table})""",
        "alternatives": """select *, (sum((token = 'or')::int) over (partition by query_id order by clause_id))::int as alternative from tokens""",
        "parsed": f"""select query_id, alternative, clause_id, case when starts_with(token, '-') then 'not' when regexp_matches(token, '^-?"') and len(terms) > 1 then 'phrase' else 'and' end as kind, terms
            from (select *, list_transform(list_filter(regexp_extract_all(token, '[a-z0-9]+'), lambda t: t not in ({_STOP})), lambda t: {_stem('t')}) as terms from alternatives where token <> 'or')
            where len(terms) > 0""",
    }


_ASKED = """select query_id, case query_id % 4 when 1 then concat('"', text, '"') when 2 then concat(split_part(text, ' ', 1), ' -', split_part(text, ' ', 2))
    when 3 then concat(split_part(text, ' ', 1), ' or ', split_part(text, ' ', 2)) else text end as text from v_text_queries"""
_MATCH = {
    "wanted": "select distinct query_id, alternative, unnest(terms) as term from parsed where kind <> 'not'",
    "needed": "select query_id, alternative, count(*) as need from wanted group by all",
    "alls": """select query_id, alternative, document_id, chunk_index from (select query_id, alternative, document_id, chunk_index, count(*) as got
        from postings join wanted using (term) group by all) join needed using (query_id, alternative) where got = need""",
    "ph": "select query_id, alternative, clause_id, len(terms) as n, generate_subscripts(terms, 1) - 1 as off, unnest(terms) as term from parsed where kind = 'phrase'",
    "runs": """select query_id, alternative, document_id, chunk_index, clause_id from (
        select query_id, alternative, clause_id, n, document_id, chunk_index, pos - off as start, count(distinct off) as c from hits join ph using (term) group by all) where c = n group by all""",
    "asked_ph": "select query_id, alternative, count(*) as asked from parsed where kind = 'phrase' group by all",
    "got_ph": "select query_id, alternative, document_id, chunk_index, count(*) as got from runs group by all",
    "banned": "select distinct query_id, alternative, document_id, chunk_index from postings join (select query_id, alternative, unnest(terms) as term from parsed where kind = 'not') using (term)",
    "matched": """select distinct query_id, document_id, chunk_index from alls left join asked_ph using (query_id, alternative)
        left join got_ph using (query_id, alternative, document_id, chunk_index) left join (select *, true as ban from banned) using (query_id, alternative, document_id, chunk_index)
        where ban is null and (asked is null or asked = got)""",
}
_COVER = {
    "places": "select m.query_id, m.document_id, m.chunk_index, h.term, h.pos from matched m join hits h using (document_id, chunk_index) join (select distinct query_id, term from wanted) w on w.query_id = m.query_id and w.term = h.term",
    "terms_n": "select query_id, document_id, chunk_index, count(distinct term) as n from places group by all",
    "ends": "select distinct query_id, document_id, chunk_index, pos as q from places",
    "lasts": "select e.query_id, e.document_id, e.chunk_index, q, term, max(pos) as last from ends e join places p using (query_id, document_id, chunk_index) where pos <= q group by all",
    "covers": "select query_id, document_id, chunk_index, q, min(last) as p, count(*) as c from lasts group by all",
    "minimal": "select query_id, document_id, chunk_index, n, p, min(q) as q from covers join terms_n using (query_id, document_id, chunk_index) where c = n group by all",
    "cover_scores": "select query_id, document_id, chunk_index, round(sum(1.0::double / (1 + (q - p + 1) - n)), 6) as score from minimal group by all",
}


def _finish(ranked: str, name: str) -> dict[str, str]:
    """SQL of what follows a ranked list (query_id, document_id, chunk_index, content, score, rank)."""
    return {
        f"{name}_dd": f"select * exclude (dd) from (select *, row_number() over (partition by query_id, content order by score desc, rank) as dd from {ranked}) where dd = 1",
        name: f"""select query_id, r.document_id, r.chunk_index, r.content, b.content as context_before, a.content as context_after, score,
            row_number() over (partition by query_id order by best desc, frst, r.chunk_index)::int as position
            from (select *, max(score) over (partition by query_id, document_id) as best, min(rank) over (partition by query_id, document_id) as frst from {name}_dd) r
            left join v_chunks b on b.document_id = r.document_id and b.chunk_index = r.chunk_index - 1
            left join v_chunks a on a.document_id = r.document_id and a.chunk_index = r.chunk_index + 1"""}


_SCOPE = {"scope": """select query_id, document_id from (select query_id from v_vector_queries union select query_id from v_text_queries) q
    join v_documents on uploaded_by = concat('src', cast(query_id % 20 as varchar))"""}


def _semantic_ctes(k: int, scope: bool = False) -> dict[str, str]:
    return _knn_ctes("v_vector_chunks", k, THRESHOLD, scope) | {"sem_ranked": "select query_id, document_id, chunk_index, content, similarity as score, rank from knn"} | _finish("sem_ranked", "sem")


def _keyword_ctes(k: int, scope: bool = False) -> dict[str, str]:
    match = dict(_MATCH)
    if scope:
        match["matched"] += " and (query_id, document_id) in (select (query_id, document_id) from scope)"
    return _POSTINGS | _parsed("v_text_queries") | match | _COVER | {
        "kw_ranked": f"""select * from (select s.*, c.content, row_number() over (partition by query_id order by score desc, document_id, chunk_index) as rank
            from cover_scores s join v_chunks c using (document_id, chunk_index)) where rank <= {k}"""} | _finish("kw_ranked", "kwd")


def _fuse(a: str, b: str) -> dict[str, str]:
    return {"lists": f"select query_id, document_id, chunk_index, position, 0 as list from {a} union all select query_id, document_id, chunk_index, position, 1 from {b}",
            "sums": "select query_id, document_id, chunk_index, round(sum(1.0::double / (60 + position)), 9) as total, min(list * 100000 + position) as frst from lists group by all",
            "fused": f"""select query_id, document_id, chunk_index, rank::int as rank, round(least(total / (2.0::double / 61), 1.0), 6) as score
                from (select *, row_number() over (partition by query_id order by total desc, frst) as rank from sums) where rank <= {K}"""}


_RANKED = {"ranked": """select *, row_number() over (partition by query_id order by score desc, document_id, chunk_index) as rank from (
    select c.*, document_id % 50 as query_id, round(((document_id * 7 + chunk_index * 13) % 101)::decimal(10,1) / 101.0::decimal(4,1), 6)::double as score from v_chunks c)"""}
_COLS = ", ".join(RESULT)
SQL = {
    "exact_knn": duck("select query_id, chunk_id, similarity, rank::int as rank from knn", "v_vector_queries", **_knn_ctes("v_vectors", K, THRESHOLD)),
    "semantic_search": duck(f"select {_COLS} from sem", "v_vector_chunks", "v_vector_queries", **_semantic_ctes(K)),
    "similar_documents": duck(
        "select source_id, document_id, similarity, rank::int as rank from (select *, row_number() over (partition by source_id order by similarity desc, document_id) as rank from best) where rank <= 5",
        "v_vectors",
        first="select document_id as source_id, i as sample_no, embedding as query_vector from (select *, row_number() over (partition by document_id order by chunk_index, chunk_id) as i from v_vectors where document_id % 50 = 0) where i <= 3",
        pairs=f"select q.source_id, q.sample_no, v.chunk_id, v.document_id, {_COS} as similarity from v_vectors v, first q where v.document_id <> q.source_id",
        pool="select * from (select *, row_number() over (partition by source_id, sample_no order by similarity desc, chunk_id) as r from pairs) where r <= 15",
        best="select source_id, document_id, max(similarity) as similarity from pool group by all"),
    "build_postings": duck("select term, document_id, chunk_index, array_to_string(positions, ',') as positions, tf from postings", "v_chunks", **_POSTINGS),
    "parse_web_query": duck("select query_id, alternative, clause_id::int as clause_id, kind, array_to_string(terms, ' ') as terms from parsed", "v_text_queries", asked=_ASKED, **_parsed("asked")),
    "match_postings": duck("select * from matched", "v_chunks", "v_text_queries", asked=_ASKED, **_POSTINGS, **_parsed("asked"), **_MATCH),
    "cover_density_rank": duck("select * from cover_scores", "v_chunks", "v_text_queries", **_POSTINGS, **_parsed("v_text_queries"), **_MATCH, **_COVER),
    "keyword_search": duck(f"select {_COLS} from kwd", "v_chunks", "v_text_queries", **_keyword_ctes(K)),
    "stems": duck("select word, term from stems", "v_chunks", **_POSTINGS),
    "scoped_semantic_search": duck(f"select {_COLS} from sem", "v_vector_chunks", "v_vector_queries", "v_text_queries", "v_documents", **_SCOPE, **_semantic_ctes(K, True)),
    "scoped_keyword_search": duck(f"select {_COLS} from kwd", "v_chunks", "v_vector_queries", "v_text_queries", "v_documents", **_SCOPE, **_keyword_ctes(K, True)),
    "scope_corpus": duck("""select q::bigint as query_id, c.document_id, chunk_index, content from v_chunks c join v_documents d using (document_id),
        (values (1, 'src0'), (2, 'src1'), (3, 'src2'), (4, 'src3')) u(q, usr) where uploaded_by = usr and (q <> 2 or project_id = 'en')
        and (q <> 3 or created_at >= timestamp '2024-01-20 00:00:00') and (q <> 4 or mime_type in ('text/plain', 'application/pdf'))
        union all select q.document_id + 1000, c.document_id, chunk_index, content from v_documents q join v_documents d
          on d.document_id in (q.document_id, q.document_id + 1, q.document_id + 20) and d.uploaded_by = q.uploaded_by and d.mime_type = q.mime_type
          join v_chunks c on c.document_id = d.document_id""", "v_chunks", "v_documents"),
    "dedupe_by_content": duck("select query_id, document_id, chunk_index, score, rank::int as rank from (select *, row_number() over (partition by query_id, content order by score desc, rank) as dd from ranked) where dd = 1", "v_chunks", **_RANKED),
    "attach_context": duck("""select query_id, r.document_id, r.chunk_index, b.content as context_before, a.content as context_after from ranked r
        left join v_chunks b on b.document_id = r.document_id and b.chunk_index = r.chunk_index - 1
        left join v_chunks a on a.document_id = r.document_id and a.chunk_index = r.chunk_index + 1""", "v_chunks", **_RANKED),
    "group_by_document": duck("""select query_id, document_id, chunk_index, row_number() over (partition by query_id order by best desc, frst, chunk_index)::int as position
        from (select *, max(score) over (partition by query_id, document_id) as best, min(rank) over (partition by query_id, document_id) as frst from ranked)""", "v_chunks", **_RANKED),
    "rrf_fuse": duck("select * from fused", "v_chunks", **_RANKED,
                     sa="select * from ranked where rank <= 30", sb="select * replace (rank - 19 as rank) from ranked where rank between 20 and 50",
                     ga="select query_id, document_id, chunk_index, row_number() over (partition by query_id order by best desc, frst, chunk_index) as position from (select *, max(score) over (partition by query_id, document_id) as best, min(rank) over (partition by query_id, document_id) as frst from sa)",
                     gb="select query_id, document_id, chunk_index, row_number() over (partition by query_id order by best desc, frst, chunk_index) as position from (select *, max(score) over (partition by query_id, document_id) as best, min(rank) over (partition by query_id, document_id) as frst from sb)",
                     **_fuse("ga", "gb")),
    "hybrid_search": duck("""select query_id, document_id, chunk_index, score, row_number() over (partition by query_id order by best desc, frst, chunk_index)::int as position
        from (select *, max(score) over (partition by query_id, document_id) as best, min(rank) over (partition by query_id, document_id) as frst from fused)""",
                          "v_vector_chunks", "v_vector_queries", "v_text_queries", **_semantic_ctes(POOL), **_keyword_ctes(POOL), **_fuse("sem", "kwd")),
    "scoped_hybrid_search": duck("""select query_id, document_id, chunk_index, score, row_number() over (partition by query_id order by best desc, frst, chunk_index)::int as position
        from (select *, max(score) over (partition by query_id, document_id) as best, min(rank) over (partition by query_id, document_id) as frst from fused)""",
                          "v_vector_chunks", "v_vector_queries", "v_text_queries", "v_documents", **_SCOPE, **_semantic_ctes(POOL, True), **_keyword_ctes(POOL, True), **_fuse("sem", "kwd")),
    "best_sentence": duck("""select query_id, document_id, chunk_index, case when n > 0 then s end as sentence, n as n_words from (
        select query_id, document_id, chunk_index, s, n::int as n, row_number() over (partition by query_id, document_id, chunk_index order by n desc, i) as r from counted) where r = 1""",
        "v_chunks", "v_text_queries", **_keyword_ctes(K),
        pieces=r"""select query_id, document_id, chunk_index, generate_subscripts(p, 1) as i, trim(unnest(p)) as s from (select *, list_filter(string_split(regexp_replace(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as p from kwd)""",
        counted="""select p.*, len(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\\s+'), lambda w: length(w) > 2)), lambda w: contains(lower(s), w))) as n from pieces p join v_text_queries q using (query_id)"""),
    "suggest": duck("""select query_id::bigint as query_id, position::int as position, kind, text from (select *, row_number() over (partition by query_id order by kind_no, i, text) as position from (
        select query_id, 0 as kind_no, 'recent_query' as kind, text, min(i) as i from mine where i <= 3 group by query_id, text
        union all select query_id, 1, 'document', coalesce(display_name, filename), 0 from v_documents join pre on uploaded_by = user_id
          where contains(lower(filename), p) or coalesce(contains(lower(display_name), p), false)
        union all select query_id, 2, 'project', name, 0 from v_projects join pre on owner_id = user_id where contains(lower(name), p))) where position <= 5""",
        "v_documents", "v_projects", "v_search_logs",
        pre="""select * from (values (1, 'src0', 'doc_1'), (2, 'src1', 'report 2'), (3, 'src10', 'project'), (5, 'src3', 'doc%')) t(query_id, user_id, p)
            union all select document_id + 1000, uploaded_by, lower(case when document_id % 2 = 0 then substring(filename, 1, 5) else right(filename, 6) end) from v_documents""",
        mine="""select pre.query_id, concat('doc_1', cast(event_id % 7 as varchar)) as text, row_number() over (partition by pre.query_id order by created_at desc, event_id desc) as i
            from v_search_logs h join pre on pre.user_id = concat('src', cast(h.user_id % 20 as varchar)) where starts_with(concat('doc_1', cast(event_id % 7 as varchar)), p)"""),
    "check_access": duck("""select document_id as query_id, 'document' as kind, cast(document_id as varchar) as id from v_documents where uploaded_by <> concat('src', cast(document_id % 9 as varchar))
        union select document_id, 'project', d.project_id from v_documents d join v_projects p using (project_id) where owner_id <> concat('src', cast(document_id % 9 as varchar))""", "v_documents", "v_projects"),
    "resolve_filters": duck(f"""select document_id as query_id, m.mime_type,
        case document_id % 4 when 0 then timestamp '{AS_OF}' - interval 7 day when 1 then timestamp '{AS_OF}' - interval 30 day when 2 then timestamp '{AS_OF}' - interval 90 day end as since
        from v_documents left join (values {", ".join(f"({i}, '{x}')" for i, c in enumerate(s.CATEGORIES) for x in s.CATEGORIES[c])}) m(n, mime_type) on document_id % 6 = n""", "v_documents"),
}
