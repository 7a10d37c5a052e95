"""Keyword search over postings: terms with positions, web-style queries, cover-density ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.stem import SPARK, stem_sql
from skerry.sources.shared import cut_lineage
from skerry.sources.versioned import BROADCAST_KEYS

# English words that are not indexed.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off
over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now""".split()


def stems(words: DataFrame) -> DataFrame:
    """(word) -> (word, term): each distinct word is stemmed once."""
    return words.select("word").distinct().withColumn("term", F.expr(stem_sql("word", SPARK)))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def build_postings(chunks: DataFrame, common: int = BROADCAST_KEYS) -> DataFrame:
    """(document_id, chunk_index, content) -> (term, document_id, chunk_index, positions, tf); positions count all words, stop words too.

    The ``common`` most frequent words are stemmed once and broadcast; rarer ones, of which each has few places, are stemmed where they
    are. So words are not exchanged to meet their stems, and of chunks that are together by document the postings are not either."""
    found = chunks.select("document_id", "chunk_index", F.posexplode(_terms(F.col("content"))).alias("pos", "word")).filter(~F.col("word").isin(STOP_WORDS))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    stemmed = stems(cut_lineage(counts.orderBy(F.desc("_n"), "word").limit(common)))
    words = found.join(F.broadcast(stemmed), "word", "left").withColumn("term", F.coalesce("term", F.expr(stem_sql("word", SPARK))))
    # by document first: chunks come in this order, so that there is little to sort
    return words.groupBy("document_id", "chunk_index", "term").agg(
        F.array_sort(F.collect_list((F.col("pos") + 1).cast("int"))).alias("positions"), F.count(F.lit(1)).alias("tf")).select("term", "document_id", "chunk_index", "positions", "tf")


def parse_web_query(queries: DataFrame) -> DataFrame:
    """(query_id, text) -> (query_id, alternative, clause_id, kind, terms): words and "phrases", minus for negation, ``or`` between
    alternatives. Never fails; clauses without indexable terms disappear."""
    tokens = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit('-?"[^"]*"|\\S+'), F.lit(0))).alias("clause_id", "token"))
    w = Window.partitionBy("query_id").orderBy("clause_id")
    tokens = tokens.withColumn("alternative", F.sum((F.col("token") == "or").cast("int")).over(w)).filter("token <> 'or'")
    bare = F.filter(_terms(F.col("token")), lambda t: ~t.isin(STOP_WORDS))
    negative, quoted = F.col("token").startswith("-"), F.col("token").rlike('^-?"')
    out = tokens.withColumn("_bare", bare).withColumn("terms", F.expr(f"transform(_bare, t -> {stem_sql('t', SPARK)})")).filter(F.size("terms") > 0)
    kind = F.when(negative, "not").when(quoted & (F.size("terms") > 1), "phrase").otherwise("and")
    return out.select("query_id", F.col("alternative").cast("int").alias("alternative"), "clause_id", kind.alias("kind"), "terms")


def match_postings(postings: DataFrame, parsed: DataFrame) -> DataFrame:
    """(query_id, document_id, chunk_index): an alternative matches when all its terms occur, its phrases' terms are adjacent and no negated
    term occurs; a query matches if one alternative does."""
    return matched_chunks(postings, parsed).select("query_id", "document_id", "chunk_index")


def _cover_score(found: Column) -> Column:
    """found: array of (term, positions) -> the sum over minimal covers [p, q] of all terms of 1 / (1 + (q - p + 1) - n).

    One fold over the places in order, which keeps the last place of each term. Where q is reached, the shortest stretch that ends
    there starts at the least last place p; it is minimal where p is new, as p only grows."""
    terms = F.transform(found, lambda f: f["term"])
    n = F.size(terms)
    places = F.array_sort(F.flatten(F.transform(found, lambda f, i: F.transform(f["positions"], lambda p: F.struct(p.alias("q"), i.alias("t"))))))
    none = F.struct(F.transform(terms, lambda t: F.lit(0)).alias("last"), F.lit(0).alias("p"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda old, i: F.when(i == x["t"], x["q"]).otherwise(old))
        one = F.transform(F.array(last), lambda now: F.struct(now.alias("last"), F.array_min(now).alias("p")))  # binds ``last``, so that it is built once
        return F.get(F.transform(one, lambda y: F.struct(y["last"].alias("last"), y["p"].alias("p"), F.when(
            y["p"] > acc["p"], acc["total"] + 1.0 / (1 + (x["q"] - y["p"] + 1) - n)).otherwise(acc["total"]).alias("total"))), 0)

    return F.round(F.aggregate(places, none, step, lambda acc: acc["total"]), 6)


def cover_density_rank(postings: DataFrame, parsed: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """matches + score, as scored_matches; without ``matches`` all chunks that match, whose postings are then exchanged but once."""
    scored = scored_matches(postings, parsed)
    return scored if matches is None else scored.join(matches, ["query_id", "document_id", "chunk_index"], "left_semi")


def query_terms(parsed: DataFrame) -> DataFrame:
    """parsed -> (query_id, term, uses): where each term of a query is used: (alternative, clause_id, kind, off, len)."""
    uses = parsed.select("query_id", "alternative", "clause_id", "kind", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    return uses.groupBy("query_id", "term").agg(F.collect_list(F.struct("alternative", "clause_id", "kind", "off", "len")).alias("uses"))


def query_needs(parsed: DataFrame) -> DataFrame:
    """parsed -> (query_id, needs): for each alternative with a positive clause the number of distinct terms and its phrases' clause ids."""
    positive = parsed.filter("kind <> 'not'")
    per = positive.select("query_id", "alternative", "clause_id", "kind", F.explode("terms").alias("term")).groupBy("query_id", "alternative").agg(
        F.countDistinct("term").cast("int").alias("need"), F.collect_set(F.when(F.col("kind") == "phrase", F.col("clause_id"))).alias("phrases"))
    return per.groupBy("query_id").agg(F.collect_list(F.struct("alternative", "need", "phrases")).alias("needs"))


def query_alternatives(parsed: DataFrame) -> DataFrame:
    """parsed -> a row for each alternative with a positive clause: _all (its terms, which every match of it has), _lead (the least of them),
    query_id, _alternative, _terms (what query_terms gives, as one array), needs."""
    terms = query_terms(parsed).groupBy("query_id").agg(F.collect_list(F.struct("term", "uses")).alias("_terms"))
    leads = parsed.filter("kind <> 'not'").select("query_id", "alternative", F.explode("terms").alias("term")).groupBy(
        "query_id", F.col("alternative").alias("_alternative")).agg(F.min("term").alias("_lead"), F.collect_set("term").alias("_all"))
    return leads.join(terms, "query_id").join(query_needs(parsed), "query_id")


def matched_chunks(postings: DataFrame, parsed: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id, chunk_index, _found: (term, positions, uses) of the query's terms that the chunk has) of all chunks that match.

    The postings of the batch's terms are exchanged once, whatever the number of queries: what a chunk has of them is one row, which then
    meets the alternatives whose leading term it has and decides on them by itself. ``scope`` (query_id, document_id) restricts the chunks
    first. ``parsed`` is read a few times. Up to BROADCAST_KEYS terms and alternatives are broadcast, counted first."""
    keys = ["query_id", "document_id", "chunk_index"]
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    wanted = cut_lineage(parsed.select(F.explode("terms").alias("term")).distinct())
    asked = cut_lineage(query_alternatives(parsed))
    hits = postings.join(few(wanted), "term", "left_semi").select("term", "document_id", "chunk_index", "positions").repartition("document_id")
    chunks = hits.groupBy("document_id", "chunk_index").agg(F.collect_list(F.struct("term", "positions")).alias("_has"))
    if scope is not None:
        seen = scope.join(few(asked.select("query_id").distinct()), "query_id", "left_semi")
        chunks = chunks.join(seen.groupBy("document_id").agg(F.collect_set("query_id").alias("_seen")), "document_id")
    chunks = chunks.withColumn("_words", F.transform("_has", lambda h: h["term"]))
    pairs = chunks.withColumn("_lead", F.explode("_words")).join(few(asked), "_lead").filter(F.forall("_all", lambda t: F.array_contains("_words", t)))
    if scope is not None:
        pairs = pairs.filter(F.array_contains("_seen", F.col("query_id")))
    positions = lambda t: F.get(F.filter("_has", lambda h: h["term"] == t["term"]), 0)["positions"]
    found = F.filter(F.transform("_terms", lambda t: F.struct(t["term"].alias("term"), positions(t).alias("positions"), t["uses"].alias("uses"))),
                     lambda f: f["positions"].isNotNull())
    rows = pairs.select(*keys, "_alternative", "needs", F.explode(F.array(found)).alias("_found"))  # one row: built once, however often it is named
    found = F.col("_found")

    def used(f: Column, test) -> Column:
        return F.exists(f["uses"], test)

    def phrase(clause: Column) -> Column:
        """Some place where all terms of the clause follow each other. A term that the clause has twice counts at both places."""
        parts = F.flatten(F.transform(found, lambda f: F.transform(F.filter(f["uses"], lambda u: u["clause_id"] == clause),
                                                                  lambda u: F.struct(u["len"].alias("len"), F.transform(f["positions"], lambda p: p - u["off"]).alias("starts")))))
        whole = F.size(parts) == F.get(parts, 0)["len"]
        common = F.aggregate(F.slice(parts, 2, 1 << 20), F.get(parts, 0)["starts"], lambda acc, x: F.array_intersect(acc, x["starts"]))
        return F.coalesce(whole & (F.size(common) > 0), F.lit(False))

    def alternative(a: Column) -> Column:
        got = F.size(F.filter(found, lambda f: used(f, lambda u: (u["alternative"] == a["alternative"]) & (u["kind"] != "not"))))
        banned = F.exists(found, lambda f: used(f, lambda u: (u["alternative"] == a["alternative"]) & (u["kind"] == "not")))
        return (got == a["need"]) & ~banned & F.forall(a["phrases"], phrase)

    # a chunk meets a query once for each alternative; the first one that matches counts
    first = F.array_min(F.transform(F.filter("needs", alternative), lambda a: a["alternative"]))
    return rows.filter(first == F.col("_alternative")).select(*keys, "_found")


def scored_matches(postings: DataFrame, parsed: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id, chunk_index, score) of all chunks that match: score is the sum over minimal covers [p, q] of all the query's
    terms of 1 / (1 + (q - p + 1) - n)."""
    positive = F.filter("_found", lambda f: F.exists(f["uses"], lambda u: u["kind"] != "not"))
    return matched_chunks(postings, parsed, scope).select("query_id", "document_id", "chunk_index", _cover_score(positive).alias("score"))
