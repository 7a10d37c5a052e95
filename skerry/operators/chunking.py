"""Structure-aware chunking of page texts.

Pages are cut into blocks at blank lines; headers, tables, lists and paragraphs are told apart; large blocks are cut into
sentences, list items or token windows and packed greedily with an overlap; small chunks are merged with their neighbours.
Everything inside a page is array expressions in the JVM; only pages meet again when a document's chunks are numbered. A
token is a run of non-space characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import CUT, LAB_PATTERNS, bind, cut_at_marks, strip, word_count

# What lines look like, and units that may begin a cut-off lab value.
BLANK_LINES = r"(\n[ \t]*\n[ \t\n]*)"
MD_HEADER = r"^#{1,6}\s+.+$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
LIST_ITEM = r"^\s*([-*+]|\d+[.)])\s+"
LEADING_UNIT = r"(?i)^(mg/dL|mmol/L|IU/L|g/L|mEq/L|mmHg|bpm|%)"
UNIT = "array<struct<text:string,char_start:int,char_end:int>>"
CHUNK = "array<struct<content:string,chunk_type:string,char_start:int,char_end:int,token_count:int>>"

#: So many lengths are added up one by one, then their sums.
BLOCK = 64


@dataclass(frozen=True)
class ChunkingConfig:
    max_tokens: int = 512
    min_tokens: int = 50
    overlap: int = 64
    sentences: bool = True
    paragraphs: bool = True
    keep_preamble: bool = False


def count_tokens(text: Column) -> Column:
    return word_count(text)


def _struct(text: Column, start: Column, end: Column) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"))


def _runs(items: Column, starts: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of each run of items that begins at one of ``starts`` (from 0) and ends before the next."""
    def runs(items: Column, starts: Column) -> Column:
        return F.transform(starts, lambda s, k: bind(F.slice(items, s + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - s), make))

    return bind(items, lambda items: bind(starts, lambda starts: runs(items, starts)))


def _placed(texts: Column, base: Column, gap: int = 0) -> Column:
    """texts as units one after the other from ``base`` on, with ``gap`` characters between them. Lengths are added up in blocks, as an
    aggregate copies what it has gathered at each step: it gathers numbers, never texts, and few of them."""
    def ends(lengths: Column, base: Column) -> Column:
        return F.aggregate(lengths, F.array(base.cast("int")), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))

    def units(texts: Column) -> Column:
        lengths = F.transform(texts, lambda t: F.length(t) + gap)
        blocks = _runs(lengths, F.filter(F.transform(texts, lambda t, i: F.when(i % BLOCK == 0, i)), lambda i: i.isNotNull()), lambda run: ends(run, F.lit(0)))

        def placed(blocks: Column, bases: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                first, block = F.get(bases, (i / BLOCK).cast("int")), F.get(blocks, (i / BLOCK).cast("int"))
                return _struct(t, first + F.get(block, i % BLOCK), first + F.get(block, i % BLOCK + 1) - gap)

            return F.transform(texts, one)

        return bind(blocks, lambda blocks: bind(ends(F.transform(blocks, lambda b: F.element_at(b, -1)), base), lambda bases: placed(blocks, bases)))

    return bind(texts, units)


def _with_offsets(pieces: Column, base: Column) -> Column:
    """Every second piece is a separator: the others as units with their character offsets, blank ones left out."""
    return F.filter(_placed(pieces, base), lambda u, i: (i % 2 == 0) & u["text"].rlike(r"\S"))


def is_header_line(line: Column) -> Column:
    """A markdown header, or a line of at least two letters of which 90 % are capitals; never a table row or list item."""
    def check(line: Column) -> Column:
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
        capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
        shouted = ~line.rlike(TABLE_ROW) & ~line.rlike(LIST_ITEM) & bind(letters, lambda n: (n >= 2) & (capitals >= 0.9 * n))
        return (line != "") & (F.length(line) <= 80) & (line.rlike(MD_HEADER) | shouted)

    return bind(line, check)


def first_line(text: Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def classify_block(text: Column) -> Column:
    def kind(lines: Column) -> Column:
        items = F.size(F.filter(lines, lambda x: x.rlike(LIST_ITEM)))
        table = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(TABLE_ROW))
        return F.when(table, "table").when((F.size(lines) > 0) & (items * 2 >= F.size(lines)), "list").otherwise("paragraph")

    return bind(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\S")), kind)


def split_blocks(pages: DataFrame, paragraphs: bool = True) -> DataFrame:
    """(document_id, page_number, text) -> (…, block_no, text, char_start, char_end): blank blocks are left out."""
    pieces = cut_at_marks(F.col("text"), lambda t: F.regexp_replace(t, BLANK_LINES, f"{CUT}$1{CUT}")) if paragraphs else F.array("text")
    units = _with_offsets(pieces, F.lit(0))
    return pages.select("document_id", "page_number", F.posexplode(units).alias("block_no", "u")).select("document_id", "page_number", "block_no", "u.*")


def peel_header(blocks: DataFrame) -> DataFrame:
    """A header on a block's first line becomes a block of its own; adds ``kind``."""
    text = F.col("text")
    head = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.length(head) + 2, F.length(text))

    def block(t: Column, kind: Column, start: Column, end: Column) -> Column:
        return F.struct(t.alias("text"), kind.alias("kind"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"))

    whole = F.array(block(text, classify_block(text), F.col("char_start"), F.col("char_end")))
    header = block(strip(head), F.lit("header"), F.col("char_start"), F.col("char_start") + F.length(head))
    body = block(rest, classify_block(rest), F.col("char_start") + F.length(head) + 1, F.col("char_end"))
    parts = F.when(~is_header_line(strip(head)), whole).when(rest.rlike(r"\S"), F.array(header, body)).otherwise(F.array(header))
    out = blocks.select("document_id", "page_number", "block_no", F.posexplode(parts).alias("part", "b"))
    return out.select("document_id", "page_number", (F.col("block_no") * 2 + F.col("part")).alias("block_no"), "b.*")


def merge_adjacent_paragraphs(blocks: DataFrame) -> DataFrame:
    """Runs of paragraphs become one block each; tables, lists and headers stay apart."""
    w = Window.partitionBy("document_id", "page_number").orderBy("block_no")
    run = (F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph")
    marked = blocks.withColumn("_new", F.when(F.coalesce(run, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return marked.groupBy("document_id", "page_number", "_run").agg(
        F.min("block_no").alias("block_no"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.min_by("kind", "block_no").alias("kind"),
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")).drop("_run")


def split_sentences(text: Column, base: Column) -> Column:
    """Units between ``.``, ``!`` or ``?`` with white space after it and a capital letter."""
    return _with_offsets(cut_at_marks(text, lambda t: F.regexp_replace(t, r"([.!?])(\s+)(?=[A-Z])", f"$1{CUT}$2{CUT}")), base)


def glue_split_lab_values(units: Column) -> Column:
    """A unit that ends in a digit and the next one that begins with a measure become one; a glued unit is not glued again."""
    def joined(run: Column) -> Column:
        return _struct(F.array_join(F.transform(run, lambda u: u["text"]), " "), F.get(run, 0)["char_start"], F.element_at(run, -1)["char_end"])

    def glue(units: Column) -> Column:
        def fits(u: Column, i: Column) -> Column:
            return F.coalesce(strip(F.get(units, i - 1)["text"]).rlike(r"\d\z") & F.regexp_replace(u["text"], r"^\s+", "").rlike(LEADING_UNIT), F.lit(False))

        init = F.struct(F.array().cast("array<int>").alias("out"), F.lit(False).alias("glued"), F.lit(0).alias("at"))

        def step(acc: Column, fit: Column) -> Column:
            glued = fit & ~acc["glued"]
            return F.struct(F.when(glued, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["at"]))).alias("out"), glued.alias("glued"), (acc["at"] + 1).alias("at"))

        starts = F.aggregate(F.transform(units, fits), init, step, lambda acc: acc["out"])
        return F.when(F.exists(units, lambda u: u["text"].rlike(LEADING_UNIT.replace("^", r"^\s*", 1))), _runs(units, starts, joined)).otherwise(units)

    return bind(units, glue)


def split_list_items(text: Column, base: Column, keep_preamble: bool = False) -> Column:
    """One unit for each marked line with its continuation lines. Lines before the first marker are dropped, unless kept as an own unit."""
    def joined(run: Column) -> Column:
        return _struct(F.array_join(F.transform(run, lambda u: u["text"]), "\n"), F.get(run, 0)["char_start"], F.element_at(run, -1)["char_end"])

    def items(lines: Column) -> Column:
        opens = F.transform(lines, lambda u, i: F.when(u["text"].rlike(LIST_ITEM) | (F.lit(keep_preamble) & (i == 0)), i))
        return _runs(lines, F.filter(opens, lambda i: i.isNotNull()), joined)

    return bind(_placed(F.split(text, "\n", -1), base, 1), items)


def fixed_token_windows(text: Column, base: Column, window: int) -> Column:
    """Runs of ``window`` tokens joined by one space; offsets are those of the joined text."""
    def cut(tokens: Column) -> Column:
        starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(max(1, window)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(window)), " "))

    return _placed(bind(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), cut), base)


def _chunk(content: Column, kind: Column | str, start: Column, end: Column, n: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(content.alias("content"), kind.alias("chunk_type"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), (count_tokens(content) if n is None else n).alias("token_count"))


def last_tokens(text: Column, n: int) -> Column:
    """The last n tokens joined by one space, or the text itself if it has no more."""
    def last(tokens: Column, fewer: Column) -> Column:
        return F.when(F.size(tokens) <= n, fewer).otherwise(F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), F.lit(max(n, 1))), " "))

    def tokens(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))

    # the end of the text mostly has enough of them; its first one may be cut, and is never among the last n of more than n
    return bind(tokens(F.right(text, F.lit(16 * max(n, 1)))), lambda end: last(end, bind(tokens(text), lambda whole: last(whole, text))))


def accumulate_units(units: Column, config: ChunkingConfig, kind: str) -> Column:
    """Greedy packing: a chunk is closed when the next unit would exceed max_tokens; the next one starts with the last ``overlap`` tokens of
    the closed one. A unit above the maximum stays whole.

    Where chunks begin is found by the units' numbers of tokens alone, then the overlaps, then the texts are joined once."""
    sep, overlap = " " if kind == "paragraph" else "\n", max(config.overlap, 0)

    def starts(units: Column) -> Column:
        init = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("at"))

        def step(acc: Column, n: Column) -> Column:
            full = (acc["at"] > 0) & (acc["n"] + n > config.max_tokens)
            return F.struct(F.when(full | (acc["at"] == 0), F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"),
                            (F.when(full, F.least(acc["n"], F.lit(overlap))).otherwise(acc["n"]) + n).alias("n"), (acc["at"] + 1).alias("at"))

        return F.aggregate(F.transform(units, lambda u: count_tokens(u["text"])), init, step, lambda acc: acc["out"])

    def body(run: Column) -> Column:
        return _struct(F.array_join(F.transform(run, lambda u: u["text"]), sep), F.get(run, 0)["char_start"], F.element_at(run, -1)["char_end"])

    def begun(over: Column, text: Column) -> Column:
        return F.when(over != "", F.concat(over, F.lit(sep), text)).otherwise(text)

    def closed(bodies: Column) -> Column:
        if not overlap:
            return F.transform(bodies, lambda b: _chunk(b["text"], kind, b["char_start"], b["char_end"]))
        # overs: what each chunk repeats of the one before it, and one more
        overs = F.aggregate(bodies, F.array(F.lit("")), lambda overs, b: F.concat(overs, F.array(last_tokens(begun(F.element_at(overs, -1), b["text"]), overlap))))
        return bind(overs, lambda overs: F.transform(bodies, lambda b, k: bind(begun(F.get(overs, k), b["text"]), lambda t: _chunk(t, kind, b["char_start"], b["char_end"]))))

    return bind(units, lambda units: bind(_runs(units, starts(units), body), closed))


def chunk_block(config: ChunkingConfig) -> Column:
    """Chunks of a block (columns text, kind, char_start, char_end)."""
    text, kind, start = F.col("text"), F.col("kind"), F.col("char_start")
    whole = lambda n: F.array(_chunk(text, F.when(kind == "header", "header+content").otherwise(kind), start, F.col("char_end"), n))
    units = glue_split_lab_values(split_sentences(text, start)) if config.sentences else fixed_token_windows(text, start, config.max_tokens)
    return bind(count_tokens(text), lambda n: F.when(kind.isin("table", "header") | (n <= config.max_tokens), whole(n))
                .when(kind == "list", accumulate_units(split_list_items(text, start, config.keep_preamble), config, "list"))
                .otherwise(accumulate_units(units, config, "paragraph")))


def merge_small_chunks(chunks: Column, config: ChunkingConfig) -> Column:
    """A chunk below min_tokens is put before the next chunk that is no table (and the result is tested again), else after the last one that
    is no table, else stays.

    Chunks that become one stand side by side: where they begin is found by kinds and numbers of tokens, then the texts are joined once."""
    def joined(run: Column) -> Column:
        kind = F.when(F.exists(run, lambda c: c["chunk_type"] == "header+content"), "header+content").otherwise(F.element_at(run, -1)["chunk_type"])
        whole = _chunk(F.array_join(F.transform(run, lambda c: c["content"]), "\n\n"), kind, F.get(run, 0)["char_start"], F.element_at(run, -1)["char_end"])
        return F.when(F.size(run) == 1, F.get(run, 0)).otherwise(whole)

    def starts(chunks: Column) -> Column:
        """out: where those begin that are done, and whether the last of them is a table; then the one that may still grow."""
        init = F.struct(F.array().cast("array<int>").alias("out"), F.lit(True).alias("shut"), F.lit(0).alias("start"), F.lit(False).alias("table"), F.lit(0).alias("n"), F.lit(0).alias("at"))

        def done(acc: Column, back: Column) -> tuple[Column, Column]:
            """A small one goes back to the last that is done, unless there is none or it is a table."""
            gone = back & ~acc["shut"]
            return F.when(gone, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["start"]))), F.when(gone, False).otherwise(acc["table"])

        def step(acc: Column, c: Column) -> Column:
            small = ~acc["table"] & (acc["n"] < config.min_tokens)
            grows, first = small & ~c["table"], acc["at"] == 0
            out, shut = done(acc, small)
            return F.struct(F.when(first | grows, acc["out"]).otherwise(out).alias("out"), F.when(first | grows, acc["shut"]).otherwise(shut).alias("shut"),
                            F.when(grows & ~first, acc["start"]).otherwise(acc["at"]).alias("start"), c["table"].alias("table"),
                            (F.when(grows & ~first, acc["n"]).otherwise(0) + c["n"]).alias("n"), (acc["at"] + 1).alias("at"))

        def finish(acc: Column) -> Column:
            return F.when(acc["at"] == 0, acc["out"]).otherwise(done(acc, ~acc["table"] & (acc["n"] < config.min_tokens))[0])

        return F.aggregate(F.transform(chunks, lambda c: F.struct((c["chunk_type"] == "table").alias("table"), c["token_count"].alias("n"))), init, step, finish)

    return bind(chunks, lambda chunks: _runs(chunks, starts(chunks), joined))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    c = F.col("content")
    return chunks.withColumns({"contains_table": F.col("chunk_type") == "table", "contains_lab_values": c.rlike(LAB_PATTERNS["chunk"]), "is_header": is_header_line(first_line(c))})


def page_blocks(pages: DataFrame, config: ChunkingConfig) -> DataFrame:
    blocks = peel_header(split_blocks(pages, config.paragraphs))
    return blocks if config.paragraphs else merge_adjacent_paragraphs(blocks)


def chunk_documents(pages: DataFrame, config: ChunkingConfig = ChunkingConfig(), dealt_by: tuple[str, ...] = ("document_id", "page_number")) -> DataFrame:
    """(document_id, page_number, text) -> chunks numbered over the whole document. Pages without text give none.

    Pages are dealt before they are cut: by the key that their blocks meet by again, and however few files they come in. Chunks are dealt
    again by document to be numbered, except where pages are dealt by document alone, which suits documents of few pages."""
    pages = pages.repartition(*dealt_by)
    made = page_blocks(pages, config).select("document_id", "page_number", "block_no", chunk_block(config).alias("chunks"))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "chunks")))
    per_page = made.groupBy("document_id", "page_number").agg(F.flatten(F.transform(ordered, lambda x: x["chunks"])).alias("chunks"))
    rows = per_page.select("document_id", "page_number", F.posexplode(merge_small_chunks(F.col("chunks"), config)).alias("_i", "c"))
    w = Window.partitionBy("document_id").orderBy("page_number", "_i")
    rows = rows.select("document_id", "page_number", (F.row_number().over(w) - 1).alias("chunk_index"), "c.*")
    return chunk_metadata(rows)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(count_tokens(F.col("content"))).alias("word_count"), F.countDistinct("page_number").alias("page_count"))
