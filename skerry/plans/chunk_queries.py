"""Chunking queries with their DuckDB twins. The pages get headers, tables, lists and blank lines by the same expression in both engines."""

from pyspark.sql import functions as F

from skerry.operators import chunking as c
from skerry.plans.views import duck, v_pages

CONFIG = c.ChunkingConfig(max_tokens=40, min_tokens=8, overlap=5)
_RICH = """concat('REPORT NO ', document_id, {nl}, text, {nl}, {nl}, '| a | b |', {nl}, '| 1 | 126 mg/dL |', {nl}, {nl}, case when page_number % 2 = 0 then concat('intro', {nl}) else '' end, '- ', replace(text, '. ', concat('.', {nl}, '- ')),
    {nl}, ' ', {nl}, '# Notes ', page_number, {nl}, left(text, 40), {nl}, {nl}, {nl}, text, ' Result was 126. mg/dL level at 5 . Mmol ended 12. Mg/dL. Done. ', text)"""


def v_rich(spark, d):
    return v_pages(spark, d).withColumn("text", F.expr(_RICH.format(nl="'\\n'")))


def _blocks(spark, d, config=CONFIG):
    return c.page_blocks(v_rich(spark, d), config)


def count_tokens(spark, d):
    return v_rich(spark, d).select("document_id", "page_number", c.count_tokens(F.col("text")).alias("tokens"))


def split_blocks(spark, d):
    return c.split_blocks(v_rich(spark, d))


def is_header_line(spark, d):
    lines = v_rich(spark, d).select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.when(F.col("line_no") % 7 == 3, F.upper("line")).otherwise(F.col("line")))
    return lines.select(
        "document_id", "page_number", "line_no", c.is_header_line(c.strip(F.col("line"))).alias("is_header"))


def peel_header(spark, d):
    return _blocks(spark, d)


def classify_block(spark, d):
    return c.split_blocks(v_rich(spark, d)).select("document_id", "page_number", "block_no", c.classify_block(F.col("text")).alias("kind"))


def merge_adjacent_paragraphs(spark, d):
    return c.merge_adjacent_paragraphs(_blocks(spark, d)).select("document_id", "page_number", "block_no", "kind", "text", "char_start", "char_end")


def _units(spark, d, units, kind=None):
    blocks = _blocks(spark, d)
    blocks = blocks.filter(F.col("kind") == kind) if kind else blocks
    return blocks.select("document_id", "page_number", "block_no", F.posexplode(units).alias("unit_no", "u")).select("document_id", "page_number", "block_no", "unit_no", "u.*")


def split_sentences(spark, d):
    return _units(spark, d, c.split_sentences(F.col("text"), F.col("char_start")), "paragraph")


def glue_split_lab_values(spark, d):
    """Sentences of which some end in a number and some begin with a unit, also several in a row."""
    cut = F.transform(c.split_sentences(F.col("text"), F.col("char_start")), lambda u, i: F.struct(
        F.concat(F.when(i % 5 > 1, "mmHg ").otherwise(""), u["text"], F.when(i % 5 > 0, " 12").otherwise("")).alias("text"), u["char_start"].alias("char_start"), u["char_end"].alias("char_end")))
    return _units(spark, d, c.glue_split_lab_values(cut), "paragraph")


def split_list_items(spark, d):
    return _units(spark, d, c.split_list_items(F.col("text"), F.col("char_start")), "list")


def fixed_token_windows(spark, d):
    return _units(spark, d, c.fixed_token_windows(F.col("text"), F.lit(0), 20), "paragraph")


def accumulate_units(spark, d):
    units = c.split_sentences(F.col("text"), F.col("char_start"))
    return _units(spark, d, c.accumulate_units(units, CONFIG, "paragraph"), "paragraph").drop("chunk_type")


def chunk_block(spark, d):
    return _units(spark, d, c.chunk_block(CONFIG))


def _small(spark, d):
    """Sentences and other blocks as chunks of very different size."""
    made = _blocks(spark, d).select("document_id", "page_number", "block_no", c.chunk_block(c.ChunkingConfig(12, 8, 0)).alias("chunks"))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "chunks")))
    return made.groupBy("document_id", "page_number").agg(F.flatten(F.transform(ordered, lambda x: x["chunks"])).alias("chunks"))


def merge_small_chunks(spark, d):
    rows = _small(spark, d).select("document_id", "page_number", F.posexplode(c.merge_small_chunks(F.col("chunks"), CONFIG)).alias("chunk_no", "c"))
    return rows.select("document_id", "page_number", "chunk_no", "c.content", "c.chunk_type", "c.token_count")


def chunk_metadata(spark, d):
    blocks = _blocks(spark, d).select("document_id", "page_number", "block_no", F.col("text").alias("content"), F.col("kind").alias("chunk_type"))
    return c.chunk_metadata(blocks).drop("content")


def chunk_documents(spark, d):
    return c.chunk_documents(v_rich(spark, d), CONFIG).drop("char_start", "char_end")


def chunk_stats(spark, d):
    return c.chunk_stats(v_pages(spark, d).withColumnRenamed("text", "content"))


QUERIES = {f.__name__: f for f in (
    count_tokens, split_blocks, is_header_line, peel_header, classify_block, merge_adjacent_paragraphs, split_sentences, glue_split_lab_values,
    split_list_items, fixed_token_windows, accumulate_units, chunk_block, merge_small_chunks, chunk_metadata, chunk_documents, chunk_stats)}

_CH1 = "chr(1)"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _offsets(source: str, keys: str, marked: str, base: str) -> dict[str, str]:
    """Pieces between cuts with offsets; every second piece is a separator."""
    return {
        "pieces": f"select {keys}, base, generate_subscripts(p, 1) as i, unnest(p) as text from (select {keys}, {base} as base, string_split({marked}, chr(1)) as p from {source})",
        "placed": f"select *, base + coalesce(sum(length(text)) over (partition by {keys} order by i rows between unbounded preceding and 1 preceding), 0) as s from pieces",
        "kept": f"""select {keys}, (row_number() over (partition by {keys} order by i) - 1)::int as no, text, s::int as char_start, (s + length(text))::int as char_end
            from placed where i % 2 = 1 and regexp_matches(text, '\\S')""",
    }


_RICH_CTE = {"rich": f"select document_id, page_number, {_RICH.format(nl='chr(10)')} as text from v_pages"}
_SPLIT = {k.replace("pieces", "b_pieces").replace("placed", "b_placed").replace("kept", "b_kept"): q.replace("from pieces", "from b_pieces").replace("from placed", "from b_placed")
          for k, q in _offsets("rich", "document_id, page_number", r"regexp_replace(text, '(\n[ \t]*\n[ \t\n]*)', chr(1) || '\1' || chr(1), 'g')", "0").items()}


def _header(x: str) -> str:
    return (f"({x} <> '' and length({x}) <= 80 and (regexp_matches({x}, '^#{{1,6}}\\s+.+$') or (not regexp_matches({x}, '^\\s*\\|.*\\|\\s*$') and not regexp_matches({x}, '^\\s*([-*+]|\\d+[.)])\\s+') "
            f"and length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) >= 2 and length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) >= 0.9 * length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')))))")


def _kind(t: str) -> str:
    lines = f"list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '\\S'))"
    return (f"case when len({lines}) > 0 and len(list_filter({lines}, lambda x: not regexp_matches(x, '^\\s*\\|.*\\|\\s*$'))) = 0 then 'table' "
            f"when len({lines}) > 0 and len(list_filter({lines}, lambda x: regexp_matches(x, '^\\s*([-*+]|\\d+[.)])\\s+'))) * 2 >= len({lines}) then 'list' else 'paragraph' end")


_HEAD = "split_part(text, chr(10), 1)"
_PEEL = {
    "heads": f"select *, {_STRIP.format(_HEAD)} as hd, {_HEAD} as raw, substr(text, length({_HEAD}) + 2) as rest from b_kept",
    "flags": f"select *, {_header('hd')} as h from heads",
    "blocks": f"""select document_id, page_number, no * 2 as block_no, text, {_kind('text')} as kind, char_start, char_end from flags where not h
        union all select document_id, page_number, no * 2, hd, 'header', char_start, char_start + length(raw)::int from flags where h
        union all select document_id, page_number, no * 2 + 1, rest, {_kind('rest')}, char_start + length(raw)::int + 1, char_end from flags where h and regexp_matches(rest, '\\S')""",
}
_BASE = _RICH_CTE | _SPLIT | _PEEL
_K = "document_id, page_number, block_no"
_SENT = _offsets("(select * from blocks where kind = 'paragraph')", _K, r"regexp_replace(text, '([.!?])(\s+)([A-Z])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g')", "char_start")
_TOK = "len(regexp_extract_all({0}, '\\S+'))"


def _accumulate(units: str, max_tokens: int, overlap: int, sep: str, acc: str = "acc", packed: str = "packed") -> dict[str, str]:
    """Recursive twin of the greedy packing over units (keys, no, text, char_start, char_end)."""
    last = f"(case when {_TOK.format('cur')} <= {overlap} then cur else array_to_string(regexp_extract_all(cur, '\\S+')[-{max(overlap, 1)}:], ' ') end)" if overlap else "cast(null as varchar)"
    return {
        f"{acc}(document_id, page_number, block_no, no, cur, n, s, e, closed, cs, ce)": f"""
            select {_K}, no, text, {_TOK.format('text')}, char_start, char_end, cast(null as varchar), cast(null as int), cast(null as int) from {units} where no = 0
            union all
            select a.document_id, a.page_number, a.block_no, u.no,
              case when a.n + {_TOK.format('u.text')} > {max_tokens} then concat_ws('{sep}', {last}, u.text) else a.cur || '{sep}' || u.text end,
              case when a.n + {_TOK.format('u.text')} > {max_tokens} then coalesce({_TOK.format(last)}, 0) else a.n end + {_TOK.format('u.text')},
              case when a.n + {_TOK.format('u.text')} > {max_tokens} then u.char_start else a.s end, u.char_end,
              case when a.n + {_TOK.format('u.text')} > {max_tokens} then a.cur end, case when a.n + {_TOK.format('u.text')} > {max_tokens} then a.s end, case when a.n + {_TOK.format('u.text')} > {max_tokens} then a.e end
            from {acc} a join {units} u on a.document_id = u.document_id and a.page_number = u.page_number and a.block_no = u.block_no and u.no = a.no + 1""",
        packed: f"""select {_K}, no, closed as content, cs as char_start, ce as char_end from {acc} where closed is not null
            union all select {_K}, no + 1, cur, s, e from {acc} a where no = (select max(no) from {units} u where u.document_id = a.document_id and u.page_number = a.page_number and u.block_no = a.block_no)""",
    }


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


_ITEMS = {
    "i_lines": f"select {_K}, char_start, generate_subscripts(l, 1) as i, unnest(l) as line from (select *, string_split(text, chr(10)) as l from blocks where kind = 'list')",
    "i_numbered": f"""select *, char_start + coalesce(sum(length(line) + 1) over (partition by {_K} order by i rows between unbounded preceding and 1 preceding), 0) as s,
        sum(regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s+')::int) over (partition by {_K} order by i) as item from i_lines""",
    "items": f"select {_K}, (item - 1)::int as no, string_agg(line, chr(10) order by i) as text, min(s)::int as char_start, max(s + length(line))::int as char_end from i_numbered where item > 0 group by document_id, page_number, block_no, item",
}


def _chunk_blocks(max_tokens: int, overlap: int) -> dict[str, str]:
    """``made``: chunks of every block. No sentence of these pages ends in a digit, so there is nothing to glue."""
    large = f"{_TOK.format('b.text')} > {max_tokens}"
    return _SENT | _ITEMS | {
        "big_sentences": f"select k.* from kept k join blocks b using ({_K}) where {large}", "big_items": f"select k.* from items k join blocks b using ({_K}) where {large}",
    } | _accumulate("big_sentences", max_tokens, overlap, " ", "acc_s", "packed_s") | _accumulate("big_items", max_tokens, overlap, "' || chr(10) || '", "acc_i", "packed_i") | {
        "made": f"""select {_K}, 0 as no, text as content, case kind when 'header' then 'header+content' else kind end as chunk_type, char_start, char_end from blocks b where kind in ('table', 'header') or not {large}
            union all select {_K}, no, content, 'paragraph', char_start, char_end from packed_s union all select {_K}, no, content, 'list', char_start, char_end from packed_i"""}


def _joined(a: str, b: str) -> str:
    return f"struct_pack(content := {a}.content || chr(10) || chr(10) || {b}.content, chunk_type := case when {a}.chunk_type = 'header+content' then {a}.chunk_type else {b}.chunk_type end)"


def _back(out: str, c: str) -> str:
    return f"(case when len({out}) > 0 and {out}[-1].chunk_type <> 'table' then list_append({out}[1:len({out}) - 1], {_joined(f'{out}[-1]', c)}) else list_append({out}, {c}) end)"


def _merge(least: int) -> dict[str, str]:
    """Recursive twin of the merging of small chunks: the state is the list of finished chunks and the one that is held."""
    out1 = f"(case when m.held is not null and c.chunk_type = 'table' then {_back('m.out', 'm.held')} else m.out end)"
    cur = f"(case when m.held is not null and c.chunk_type <> 'table' then {_joined('m.held', 'c.x')} else c.x end)"
    small = f"(c.chunk_type <> 'table' and {_TOK.format(cur + '.content')} < {least})"
    return {
        "seq": "select document_id, page_number, chunk_type, struct_pack(content := content, chunk_type := chunk_type) as x, row_number() over (partition by document_id, page_number order by block_no, no) as i from made",
        "merging(document_id, page_number, i, out, held)": f"""select distinct document_id, page_number, 0::bigint, [x][1:0], case when false then x end from seq where i = 1
            union all select m.document_id, m.page_number, c.i, case when {small} then {out1} else list_append({out1}, {cur}) end, case when {small} then {cur} end
            from merging m join seq c on c.document_id = m.document_id and c.page_number = m.page_number and c.i = m.i + 1""",
        "merged": f"select document_id, page_number, case when held is not null then {_back('out', 'held')} else out end as out from merging m where i = (select max(i) from seq s where s.document_id = m.document_id and s.page_number = m.page_number)",
        "final": "select document_id, page_number, (generate_subscripts(out, 1) - 1)::int as chunk_no, unnest(out) as c from merged",
    }


SQL = {
    "count_tokens": duck(f"select document_id, page_number, {_TOK.format('text')}::int as tokens from rich", "v_pages", **_RICH_CTE),
    "split_blocks": duck("select document_id, page_number, no as block_no, text, char_start, char_end from b_kept", "v_pages", **_RICH_CTE, **_SPLIT),
    "peel_header": duck("select * from blocks", "v_pages", **_BASE),
    "classify_block": duck(f"select document_id, page_number, no as block_no, {_kind('text')} as kind from b_kept", "v_pages", **_RICH_CTE, **_SPLIT),
    "merge_adjacent_paragraphs": duck("""select document_id, page_number, min(block_no) as block_no, min_by(kind, block_no) as kind, string_agg(text, chr(10) || chr(10) order by block_no) as text, min(char_start) as char_start, max(char_end) as char_end
        from runs group by document_id, page_number, run""", "v_pages", **_BASE,
        runs="""select *, sum(fresh) over (partition by document_id, page_number order by block_no) as run from (select *, case when kind = 'paragraph' and lag(kind) over (partition by document_id, page_number order by block_no) = 'paragraph' then 0 else 1 end as fresh from blocks)"""),
    "split_sentences": duck(f"select {_K}, no as unit_no, text, char_start, char_end from kept", "v_pages", **_BASE, **_SENT),
    "glue_split_lab_values": duck(f"""select {_K}, (row_number() over (partition by {_K} order by no) - 1)::int as unit_no, case when glued then text || ' ' || nt else text end as text, char_start, case when glued then ne else char_end end as char_end
        from (select *, coalesce(lag(glued) over (partition by {_K} order by no), false) as eaten from picked) where not eaten""", "v_pages", **_BASE, **_SENT,
        cut="select * replace (concat(case when no % 5 > 1 then 'mmHg ' else '' end, text, case when no % 5 > 0 then ' 12' else '' end) as text) from kept",
        fits=f"select *, lead(text) over u as nt, lead(char_end) over u as ne, coalesce(regexp_matches(text, '\\d\\s*$') and regexp_matches(lead(text) over u, '(?i)^\\s*(mg/dL|mmol/L|IU/L|g/L|mEq/L|mmHg|bpm|%)'), false) as fit from cut window u as (partition by {_K} order by no)",
        runs=f"select *, sum((not fit)::int) over (partition by {_K} order by no) as run from fits",
        picked=f"select *, fit and (row_number() over (partition by {_K}, run, fit order by no) - 1) % 2 = 0 as glued from runs"),
    "split_list_items": duck(f"""select {_K}, (item - 1)::int as unit_no, string_agg(line, chr(10) order by i) as text, min(s)::int as char_start, max(s + length(line))::int as char_end from numbered where item > 0 group by all""",
        "v_pages", **_BASE, lines=f"select {_K}, char_start, generate_subscripts(l, 1) as i, unnest(l) as line from (select *, string_split(text, chr(10)) as l from blocks where kind = 'list')",
        numbered=f"""select *, char_start + coalesce(sum(length(line) + 1) over (partition by {_K} order by i rows between unbounded preceding and 1 preceding), 0) as s,
            sum(regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s+')::int) over (partition by {_K} order by i) as item from lines"""),
    "fixed_token_windows": duck(f"""select {_K}, w::int as unit_no, text, (sum(length(text)) over (partition by {_K} order by w) - length(text))::int as char_start, (sum(length(text)) over (partition by {_K} order by w))::int as char_end
        from (select {_K}, (i - 1) // 20 as w, string_agg(t, ' ' order by i) as text from (select {_K}, generate_subscripts(x, 1) as i, unnest(x) as t from (select *, regexp_extract_all(text, '\\S+') as x from blocks where kind = 'paragraph')) group by all)""", "v_pages", **_BASE),
    "accumulate_units": _recursive(duck(f"select {_K}, (row_number() over (partition by {_K} order by no) - 1)::int as unit_no, content, char_start, char_end, {_TOK.format('content')}::int as token_count from packed",
                                        "v_pages", **_BASE, **_SENT, **_accumulate("kept", CONFIG.max_tokens, CONFIG.overlap, " "))),
    "chunk_block": _recursive(duck(f"select {_K}, (row_number() over (partition by {_K} order by no) - 1)::int as unit_no, content, chunk_type, char_start, char_end, {_TOK.format('content')}::int as token_count from made",
                                   "v_pages", **_BASE, **_chunk_blocks(CONFIG.max_tokens, CONFIG.overlap))),
    "merge_small_chunks": _recursive(duck(f"select document_id, page_number, chunk_no, c.content as content, c.chunk_type as chunk_type, {_TOK.format('c.content')}::int as token_count from final",
                                          "v_pages", **_BASE, **_chunk_blocks(12, 0), **_merge(CONFIG.min_tokens))),
    "chunk_documents": _recursive(duck(f"""select document_id, page_number, (row_number() over (partition by document_id order by page_number, chunk_no) - 1)::int as chunk_index, content, chunk_type, token_count, contains_table, contains_lab_values, is_header
        from (select *, c.content as content, c.chunk_type as chunk_type, {_TOK.format('c.content')}::int as token_count, c.chunk_type = 'table' as contains_table,
          regexp_matches(c.content, '(\\d+\\.?\\d*)[ \\t\\n\\r\\f\\v]*(mg/dL|mmol/L|IU/L|%|g/L)') as contains_lab_values, {_header('x')} as is_header
          from (select *, {_STRIP.format("split_part(c.content, chr(10), 1)")} as x from final))""", "v_pages", **_BASE, **_chunk_blocks(CONFIG.max_tokens, CONFIG.overlap), **_merge(CONFIG.min_tokens))),
    "chunk_metadata": duck(f"""select {_K}, kind as chunk_type, kind = 'table' as contains_table, regexp_matches(text, '(\\d+\\.?\\d*)[ \\t\\n\\r\\f\\v]*(mg/dL|mmol/L|IU/L|%|g/L)') as contains_lab_values, {_header('x')} as is_header
        from (select *, {_STRIP.format(_HEAD)} as x from blocks)""", "v_pages", **_BASE),
    "chunk_stats": duck("select document_id, count(*) as chunk_count, sum(len(regexp_extract_all(text, '\\S+')))::bigint as word_count, count(distinct page_number) as page_count from v_pages group by 1", "v_pages"),
}
