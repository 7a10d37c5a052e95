"""The training-data operators against SQL twins, brute force, public libraries and held-out labels, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from skerry.llm import components, decontaminate, language_id, line_dedup, lm_score, maxscore, near_dedup, queries, sharding, token_store, unigram, url_filter
from skerry.llm.common import Scratch, table
from tests.differential import duck_rows, spark_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, _drop int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "src0", None, "x", 1), (2, "", None, None, 0, None, None), (3, "   \n\t ", "en", "src0", 1, "x", 2), (4, LONG, "en", "src0", 9, "x", 3),
    (5, LONG, "de", "src1", 9, "x", 3), (6, "one two", "fr", "src1", 7, "x", 3), (6, "one two", "fr", "src1", 7, "x", 3), (7, "One\ttwo", "fr", "", 7, "x", 3),
    (8, "é" * 50 + " 日本 ▁ 😀\x00", "es", "src2", 5, "x", 3), (None, "no id here at all", "en", "src0", 5, "x", 3), (9, "\n\n\n", "en", "src0", 3, "x", 3),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(queries.SQL[name], sf_dir)


# --- 1 SentencePiece ---------------------------------------------------------------------------------------------------
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_words_and_whole_texts_have_the_same_best_paths(texts):
    import pyarrow as pa

    m = unigram.load_model(PIECES)
    some = [*list(texts.values())[:25], "", " ", "  a   b  ", "日本 語 ▁x ▁ y", "tab\there\n\nthere", "x" * 300]
    ids, lens = unigram._ids_of(pa.array(some), m)
    cuts = np.concatenate([[0], np.cumsum(lens)])
    assert all(ids[a:b].tolist() == unigram.encode_text(m, t) for t, a, b in zip(some, cuts, cuts[1:]))


def test_best_paths_score_like_the_library_lattice(texts):
    import sentencepiece

    data = open(PIECES, "rb").read()
    at = data.rfind(b"\x12\x06tok_v0\x18\x02")
    library = sentencepiece.SentencePieceProcessor(model_proto=data[:at + 9] + b"\x01" + data[at + 10:])  # the same pieces as a unigram model
    m = unigram.load_model(PIECES)
    words = sorted({w for t in list(texts.values())[:20] for w in t.split()})[:300]
    for w in words:
        best = max(library.nbest_encode_as_ids(w, 8), key=lambda ids: sum(m.scores[i] for i in ids if m.types[i] != unigram.BYTE))
        own = unigram.encode_text(m, w)
        if all(m.types[i] == unigram.NORMAL for i in own):
            assert sum(m.scores[i] for i in own) == pytest.approx(max(sum(m.scores[i] for i in own), sum(m.scores[i] for i in best)))


def test_sentencepiece_round_trip(spark, sf_dir, awkward, empty):
    assert spark_rows(unigram.op1_sentencepiece(spark, sf_dir))[1]
    assert unigram.op1_sentencepiece(spark, sf_dir).filter("not round_trip").count() == 0
    rows = unigram.decode(unigram.encode(awkward, PIECES), PIECES).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) and got[1].n_pieces == 0 and got[2].decoded == "" and got[3].decoded == "   \n\t " and got[4].decoded == LONG
    assert got[8].decoded == AWKWARD[8][1].replace("▁", " ") and got[8].n_bytes > 0 and got[6].n_lines == "x"
    assert unigram.decode(unigram.encode(empty, PIECES), PIECES).count() == 0
    both = unigram.encode_and_decode(awkward, PIECES)
    assert sorted(map(str, both.drop("piece_ids").collect())) == sorted(map(str, unigram.decode(unigram.encode(awkward, PIECES), PIECES).select(both.drop("piece_ids").columns).collect()))


# --- 2 token store -----------------------------------------------------------------------------------------------------
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _expected_tokens(pairs):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(WORDS), 0, []
    for i, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store_equals_library(spark, sf_dir, texts):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.op2_token_store(spark, sf_dir).collect())
    assert got == _expected_tokens(sorted(texts.items()))


def test_token_store_awkward(spark, awkward, empty, tmp_path):
    path = f"file://{tmp_path}/orc"
    odd = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(
        [(20, "A<|endoftext|>b it's DOGS' '' \x85x ΑΣ. é", None, None, None, None, None), (21, "<|ENDOFTEXT|> ., ..", None, None, None, None, None)], SCHEMA))
    token_store.write_token_orc(odd, path, WORDS)
    stored = token_store.read_token_orc(spark, path)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.with_global_start(token_store.token_digests(stored)).collect())
    assert got == _expected_tokens(sorted((r.doc_id, r.text) for r in odd.collect()))
    assert [r.doc_id for r in token_store.read_token_orc(spark, path, low=6, high=7).orderBy("doc_id").collect()] == [6, 7]
    assert token_store.read_token_orc(spark, path, ids=[8]).count() == 1
    plan = token_store.read_token_orc(spark, path, ids=[8])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1][:200]
    token_store.write_token_orc(empty, path + "2", WORDS)
    assert token_store.with_global_start(token_store.token_digests(token_store.read_token_orc(spark, path + "2"))).count() == 0


# --- 3 URL filter ------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme.net/x", "http://A.Example.NET/en/x?q#f", "http://example.net", "https://x.org/fr/1#a/b", "ftp://x.example.com/de/?u=http://y", "http://com#x", "http://net/", "http://b.com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    good = spark.createDataFrame([(9, True), (9, None), (9, False), (5, True)], "page_id long, good boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, good, threshold=0.9).collect()}
    assert got[0][:3] == ("", "", None) and got[1][:3] == ("", "", None) and got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][:3] == ("example.net", "", None)
    assert got[5] == ("x.org", "/fr/1", "org/fr/", "allow") and got[6] == ("x.example.com", "/de/", "example.com/de/", "block")
    assert got[7][:3] == ("com", "", None) and got[8] == ("net", "/", "net/", "block") and got[9][3] == "block"
    assert url_filter.judge_urls(pages.filter("false"), good).count() == 0


def test_labels_without_quality_repeated_pages_and_long_urls(spark, tmp_path):
    """Against the SQL twin, on tables with suffixes of two labels, nulls in labels, repeated rows and very long addresses."""
    from tests.differential import duck_rows, spark_rows

    hosts = ["a.shop.co.uk", "b.shop.co.uk", "shop.co.uk", "co.uk", "x.com.au", "deep.er.x.com.au", "a.org", "b.org"]
    rows = [(i % 150, f"https://{hosts[i % 8]}/p/{i % 150}") for i in range(300)] + [(900, None), (901, "x://" + "h" * 3000 + ".org/" + "p/" * 20_000), (902, f"http://a.org/{'1' * 30}")] * 2
    labels = [(i % 150, [1, 0, None][i % 3 if i % 7 else 2], [0, 1, None][i % 5 % 3]) for i in range(0, 220)] + [(None, 1, 0)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/l")
    for name, part in (("pages", "p"), ("labels", "l")):
        spark.read.parquet(f"{tmp_path}/{part}").coalesce(1).write.parquet(f"{tmp_path}/t/{name}")
        next((tmp_path / "t" / name).glob("part-*")).rename(tmp_path / "t" / f"{name}.parquet")
    for name in "region nation customer supplier part orders lineitem events documents embeddings benchmark conversations".split():
        (tmp_path / "t" / f"{name}.parquet").symlink_to(tmp_path / "t" / "pages.parquet")
    got = spark_rows(url_filter.op3_url_filter(spark, str(tmp_path / "t")))
    assert got == duck_rows(queries.SQL["op3_url_filter"], str(tmp_path / "t")) and len(got[1]) == len(rows)
    outcomes = url_filter.labelled_outcomes(spark.createDataFrame([(1, "http://a.org/5")], "page_id long, url string"), spark.createDataFrame([(5, None, 1)], "doc_id long, quality int, toxic int"))
    assert outcomes.count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [(f"h{i}.bad.com", 20, 2) for i in range(8)] + [(f"h{i}.good.com", 20, 19) for i in range(8)] + [("new.bad.com", 0, 0), ("new.good.com", 0, 0), ("lone.bad.com", 1, 1)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, n long, s long")).collect()}
    assert got["new.bad.com"]["mean"] < 0.4 < 0.6 < got["new.good.com"]["mean"] and got["lone.bad.com"]["mean"] < 0.6
    assert all(r.bound < r["mean"] for r in got.values())


# --- 4 near duplicates -------------------------------------------------------------------------------------------------


def _components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    parent, holders = {i: i for i in sets}, {}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in holders.get(g, ()))
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark, sf_dir, texts):
    want = _components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op4_near_dedup(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("cell", [400, 7])
def test_group_of_near_copies_in_cells(spark, cell):
    """Copies of one text with a few to many words changed: links of every strength around the threshold."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(160)], {}
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, len(w), int(rng.integers(0, 7))):
            w[at] = f"x{rng.integers(1000)}"
        rows[i] = " ".join(w)
    rows |= {100 + i: rows[0] for i in range(30)} | {200 + i: f"short {i % 3}" for i in range(9)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, cell=cell).collect()}
    assert got == _components(rows)


def test_near_duplicates_awkward(awkward, empty):
    rows = near_dedup.near_duplicates(awkward).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(AWKWARD)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[9] == (0, 9, True) and got[5][1:] == (4, False)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False) and got[None][1:] == (None, True)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_text(spark, texts):
    a, b = sorted(texts.values(), key=len)[-2:]
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (5, b), (None, a)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept, r.first) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1, True, True), (3, 3, True, True), (5, 3, False, False), (5, 5, True, True), (5, 5, True, True), (7, 5, False, False)]


def test_a_chain_of_weak_candidates_is_not_compared_as_a_whole(spark):
    """Each text shares most of its words with the next: candidates in a chain, and no links."""
    n = 300
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30 * i, 30 * i + 100))) for i in range(n)], "doc_id long, text string")
    with Scratch(spark, "test") as scratch:
        prints = near_dedup.fingerprints(df, 24, 4).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
        low = prints.groupBy("band", "key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        shared = scratch.write(prints.join(low, ["band", "key"]), "shared")
        assert shared.select("node").distinct().count() > 0.5 * n  # most are candidates of a neighbour
        sizes = shared.select("node", "n").distinct()
        first = near_dedup.first_comparisons(shared.filter("node <> low").select("node", "low"), sizes, 85)
        later = near_dedup.later_comparisons(shared.drop("low", "k"), spark.createDataFrame([], "node long, component long"), scratch)
        pairs = 0
        for members in (first, later):
            for r in members.groupBy("grp").pivot("side", [0, 1]).count().dropna().collect():
                pairs += r["0"] * r["1"]
    assert pairs < 3 * n < n * n / 20
    assert near_dedup.near_duplicates(df).filter("not kept").count() == 0


def test_copies_of_a_row_give_one_set_in_any_number_of_buckets(spark):
    base = [" ".join(f"g{g}w{j}" for j in range(80)) for g in range(3)]
    rows = [(i, base[i % 3] + ("" if i < 3 else f" tail{i}")) for i in range(12)] + [(50, None), (51, "alone in the table of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df.unionByName(df), set_bytes=500).collect()}
    assert got == {i: i % 3 if i < 12 else i for i, _ in rows}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 2**63, 170).astype(np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(1, 2**63, 15).astype(np.uint64)])) for _ in range(2))
    s = near_dedup.sketches([a, b, shared[:1]], 2048)
    assert abs((s[0] == s[1]).mean() - 170 / 200) < 0.05
    assert (s != np.iinfo(np.uint64).max).all()  # every coordinate is filled, even of a set of one


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(7, 3), (3, 3)]
    with Scratch(spark, "test") as scratch:
        got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch, "x").collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 3 for i in [3, 7, *range(200, 260)])


# --- 5 decontamination -------------------------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_left_alone(spark, sf_dir, texts):
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x.lower() in t.lower()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, sf_dir).collect()}
    assert got == want and want


def test_paraphrases_and_awkward_texts(spark, awkward, empty):
    item = "The quick copper kettle boiled over near the ancient lighthouse while seven sailors argued. The answer is purple marmalade on toasted rye bread."
    words = item.split()
    para = " ".join(w for i, w in enumerate(words) if i % 5 != 2 or i > 14)
    filler = " ".join(f"filler{i}" for i in range(300))
    docs = awkward.unionByName(spark.createDataFrame([(50, f"{filler} {para} {filler}", "en", "s", 1, "x", 1), (51, filler, "en", "s", 1, "x", 1), (52, filler + " the answer is on the", "en", "s", 1, "x", 1),
                                                      (53, f"{filler} two words {filler}", "en", "s", 1, "x", 1)], SCHEMA))
    bench = spark.createDataFrame([(1, item, "a"), (1, item, "b"), (2, None, "a"), (3, "", "a"), (4, "two words", "a")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(50, 1), (53, 4)}
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.filter("false")).count() == 0


def test_paraphrase_recall_against_the_subsequence_of_all_windows(spark, sf_dir, texts):
    """Rewritten items put into documents; brute force confirms every window of every document with every item."""
    rng, rule = np.random.default_rng(8), (0.7, 0.6, 0.8, 0.65)
    bench = table(spark, sf_dir, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    vocabulary = sorted({w for t in texts.values() for w in decontaminate.words_of(t)})
    rows = dict(texts)
    for n, (i, t) in enumerate(sorted(items.items())):
        w = t.split()
        last = max(t.rfind(". ", 0, len(t) - 2), 0)
        tail = len(t[last:].split()) if last else 0
        out = []
        for at, x in enumerate(w):
            turn = rng.random() if at < len(w) - tail else 1.0
            out += [] if turn < 0.12 else [str(rng.choice(vocabulary))] if turn < 0.24 else [x, str(rng.choice(vocabulary))] if turn < 0.4 else [x]
        host = rows[n].split() if rows[n] else []
        cut = len(host) // 2
        rows[100_000 + n] = " ".join(host[:cut] + out + host[cut:])
    index = decontaminate.ItemIndex(bench.toPandas(), {w: i for i, w in enumerate(sorted({w for t in items.values() for w in decontaminate.words_of(t)}))},
                                    np.ones(10_000), np.zeros((10_000, 1)))
    want = set()
    for d, t in rows.items():
        w = decontaminate.words_of(t)
        for k, i in enumerate(index.ids):
            if any(index.confirm(k, w, at, 64, rule)[2] for at in range(0, max(len(w), 1), 32)):
                want.add((d, int(i)))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    planted = {(d, i) for d, i in want if d >= 100_000}
    print(len(want), len(planted), len(got & want) / len(want), len(got & planted) / max(len(planted), 1))
    assert len(planted) >= 20 and len(got & planted) >= 0.9 * len(planted) and len(got & want) >= 0.9 * len(want) and not got - want


def test_the_space_is_smaller_than_its_rows(spark, sf_dir, texts):
    """An item of which the space holds little is still found: the cut follows the part that is held."""
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x.lower() in t.lower()}
    docs = table(spark, sf_dir, "documents")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), rank=20, sample=150).collect()}
    assert got == want


def test_short_items_of_a_large_benchmark_are_found(spark):
    rng = np.random.default_rng(4)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 6)) for _ in range(2000)]
    known = sorted({w for t in items for w in t.split()})
    around = [" ".join(rng.choice(known, 80)) for _ in range(400)]
    docs = spark.createDataFrame([(i, f"{around[2 * i]} {items[10 * i]} {around[2 * i + 1]}") for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(i, 10 * i) for i in range(200)}


def test_randomised_svd_finds_the_space(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 5)) @ rng.standard_normal((5, 40))
    rows = spark.createDataFrame([(list(range(40)), [float(v) for v in r]) for r in a], "words array<int>, weights array<double>")
    v = decontaminate.randomised_svd(rows, 40, 5)
    assert np.allclose(a @ v @ v.T, a, atol=1e-6)


def test_lcs():
    masks = decontaminate.place_masks("a b c d e a".split())
    assert decontaminate.lcs_length(masks, "x b y d a z".split()) == 3 and decontaminate.lcs_length(masks, []) == 0


# --- 6 MaxScore --------------------------------------------------------------------------------------------------------


def test_top_k_ties_shards_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 8) / 8]) for i in range(200)] + [(i, [0.5] * 8) for i in range(200, 260)]
    bad = [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf")]), (None, [1.0]), (305, [0.25, 0.25])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in maxscore.top_k(df, df.filter("vec_id % 20 = 0 or vec_id > 299"), k=20, shard_rows=64, block_rows=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v))).astype(int) for i, v in [*rows, (305, [0.25, 0.25])]}
    assert set(got) == {i for i in q if i % 20 == 0 or i == 305}
    for i in got:
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:20]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert maxscore.top_k(df.filter("false"), df).count() == 0 and maxscore.top_k(df, df.filter("false")).count() == 0


def test_max_score_needs_fewer_products_than_brute_force():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 8, (4096, 64))).astype(np.float64)
    shard = maxscore.Postings(np.arange(4096), x)
    queries = np.floor(rng.normal(0, 8, (40, 64))).astype(np.float64)
    products = rows = 0
    for q in queries:
        exact = np.sort(x @ q)[::-1]
        ids, scores, n = maxscore.maxscore(-1, q, float(exact[19]), shard, 20)
        assert scores.tolist() == exact[:20].tolist()
        products += n
        higher = maxscore.maxscore(-1, q, float(exact[0]), shard, 20)  # a floor from elsewhere: one row comes back, for less work
        rows += len(higher[0])
        assert higher[2] < n
    assert products < 0.7 * len(queries) * x.size and rows < 2 * len(queries)


def test_the_given_vectors_are_pruned_without_a_floor_from_elsewhere():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pandas()
    x, ids = np.floor(64 * np.stack(t["embedding"].map(lambda v: np.asarray(v, np.float64)))), t["vec_id"].to_numpy()
    shard = maxscore.Postings(ids, x)  # all rows: one shard of the registered query
    products, queries = 0, np.flatnonzero(ids % 20 == 0)
    for i in queries:
        found, scores, n = maxscore.maxscore(ids[i], x[i], -np.inf, shard, 20)
        best = sorted(zip((-x @ x[i])[ids != ids[i]], ids[ids != ids[i]]))[:20]
        assert [(-s, d) for s, d in zip(scores, found)] == best
        products += n
    assert products < 0.7 * len(queries) * x.size


def test_rounds_of_shards_and_repeated_queries(spark):
    rng = np.random.default_rng(6)
    x = np.floor(64 * rng.normal(0, 0.1, (700, 6)).astype(np.float32).astype(np.float64)).astype(int)
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)] + [(0, (x[1] / 64).tolist()), (0, (x[0] / 64).tolist())], "vec_id long, embedding array<double>")
    rows = maxscore.top_k(df, df.filter("vec_id = 0"), k=5, shard_rows=20, growth=3).collect()
    ids, all_x = [*range(700), 0, 0], np.concatenate([x, x[1:2], x[:1]])
    want = []
    for q in (x[0], x[1]):
        want += [(n, i, -s) for n, (s, i) in enumerate(sorted((-int(a @ q), i) for i, a in zip(ids, all_x) if i != 0)[:5], 1)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in rows) == sorted(want) and {r.query_id for r in rows} == {0}


# --- 7 language --------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark, sf_dir, awkward, empty):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train_text_model(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1").withColumn("host", F.col("source"))
    out = language_id.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in out]) > 0.97 and np.mean([r.accepted for r in out]) > 0.97
    odd = {r.doc_id: r for r in language_id.identify(awkward.withColumn("host", F.col("source")), model).collect()}
    assert len(odd) == 10 and not odd[1].accepted and not odd[3].accepted and odd[3].language is None and odd[4].language == odd[5].language
    assert language_id.identify(empty.withColumn("host", F.col("source")), model).count() == 0
    none = language_id.train_text_model(empty)
    assert language_id.identify(awkward.withColumn("host", F.col("source")), none).filter("accepted").count() == 0


def test_declared_language_and_host_move_an_unsure_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train_text_model(docs)
    rows = docs.select("doc_id", "text", F.concat("lang", F.lit(".example.net")).alias("host"), F.col("lang").alias("declared"))
    known = rows.unionByName(spark.createDataFrame([(10**6, "e", "de.example.net", "de"), (10**6 + 1, "e", "es.example.net", "es")], rows.schema))
    evidence = known.select("doc_id", "declared", "host", F.lit("net").alias("suffix"))
    got = {r.doc_id: r.language for r in language_id.identify(known.drop("declared"), model, evidence).filter("doc_id >= 1000000").collect()}
    assert got == {10**6: "de", 10**6 + 1: "es"}


def test_language_id_equals_brute_force(spark, texts):
    """The whole operator once more in plain Python: counts, priors, posterior."""
    hosts = {d: f"h{d % 7}.{('com', 'net')[d % 2]}" for d in texts}
    langs = {d: ("en", "de", "fr")[d % 3] if d % 4 else None for d in texts}
    df = spark.createDataFrame([(d, t, langs[d], hosts[d]) for d, t in texts.items()], "doc_id long, text string, lang string, host string")
    evidence = spark.createDataFrame([(d, ("xx", "en", "")[d % 3], hosts[d], hosts[d][-3:]) for d in texts if d % 5], "doc_id long, declared string, host string, suffix string")
    model = language_id.train_text_model(df)

    def slots(t):
        b = [int(x) for x in language_id.FOLD[list(f" {t or ''} ".encode())]]
        out = []
        for i in range(len(b) - 2):
            h = (b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA77 + b[i + 2] * 0xC2B2AE3D) % 2**32
            out.append((h ^ (h >> 15)) % language_id.SLOTS)
        return out

    grams, blank = {d: slots(t) for d, t in texts.items()}, slots("   ")[0]
    names = sorted({x for x in langs.values() if x})
    counts = {x: Counter(s for d in texts if langs[d] == x and texts[d] is not None for s in grams[d]) for x in names}
    logp = {x: {s: np.log((c.get(s, 0) + 0.5) / (sum(c.values()) + 0.5 * language_id.SLOTS)) for s in {s for g in grams.values() for s in g}} for x, c in counts.items()}
    assert model[0] == names
    ll, top = {}, {}
    for d, g in grams.items():
        sums = np.array([sum(logp[x][s] for s in g) for x in names])
        ll[d] = (sums - sums.max()) * min(len(g), 40) / max(len(g), 1)
        top[d] = int(np.argmax(ll[d])) if any(s != blank for s in g) else None
    said = {d: ("xx", "en", "")[d % 3] if d % 5 else "" for d in texts}
    place = {d: (hosts[d], hosts[d][-3:] if d % 5 else "") for d in texts}
    count = lambda key: {k: np.array([sum(key[d] == k and top[d] == i for d in texts) for i in range(3)], float) for k in set(key.values())}
    whole, of_host, of_said = sum(count(place).values()), count(place), count(said)
    p0 = (whole + 3.0 / 3) / (whole.sum() + 3.0)
    of_suffix = count({d: s for d, (_, s) in place.items()})
    up = {k: (c + 20 * p0) / (c.sum() + 20) for k, c in of_suffix.items()}
    rows = {r.doc_id: r for r in language_id.identify(df, model, evidence).collect()}
    for d in texts:
        if top[d] is None:
            assert rows[d].language is None and not rows[d].accepted
            continue
        c = of_host[place[d]]
        prior = (c + 20 * up[place[d][1]]) / (c.sum() + 20)
        fit = (of_said[said[d]] + 1) / (whole + len(of_said))
        logs = ll[d] + np.log(prior) + np.log(fit)
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert (rows[d].language, rows[d].accepted) == (names[int(np.argmax(p))], bool(p.max() >= 0.5)) and abs(rows[d].posterior - p.max()) < 1e-4


# --- 8 language model --------------------------------------------------------------------------------------------------


def _backoff(corpus, docs, order=3, least=2):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    c = Counter(tuple(w[i - n + 1:i + 1]) for t in corpus for w in [split(t)] for i in range(len(w)) for n in range(1, order + 1) if i >= n - 1)
    total, out = sum(v for k, v in c.items() if len(k) == 1), {}
    for d, t in docs.items():
        w, score = split(t), 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if n == 1 or c[g] >= least:
                    s = max(c[g], 0.5) / total if n == 1 else c[g] / c[g[:-1]]
                    score += np.log(s) + (most - n) * np.log(0.4)
                    break
        out[d] = (len(w), round(float(score), 4))
    return out


def test_scores_of_other_documents(spark, awkward, empty):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["one two three one two", "two three four", "one two four", None, ""])], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, round(r.log_score, 4)) for r in lm_score.lm_scores(awkward, corpus, order=3, bucket_tokens=20_000).collect()}
    assert got == _backoff([r.text for r in corpus.collect()], {a[0]: a[1] for a in AWKWARD})
    assert got[1] == (0, 0.0) and lm_score.lm_scores(empty).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_scores_of_the_corpus_itself_in_many_buckets(spark, sf_dir, texts, order):
    ascii_only = {i: t for i, t in texts.items() if t.isascii()}
    df = spark.createDataFrame(list(ascii_only.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_tokens, r.log_score) for r in lm_score.lm_scores(df, order=order, bucket_tokens=5000).collect()}
    want = _backoff(ascii_only.values(), ascii_only, order=order)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-3 for i in want)


def test_registered_scores_count_trigrams(spark, tmp_path):
    docs = {1: "one two three one two three", 2: "zero two three four", 3: "one two four five", 4: None}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.log_score) for r in lm_score.op8_lm_score(spark, str(tmp_path)).collect()}
    want, two = _backoff(docs.values(), docs), _backoff(docs.values(), docs, order=2)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-3 for i in want)
    assert abs(want[1][1] - two[1][1]) > 0.1  # two orders would give other scores


# --- 9 line dedup ------------------------------------------------------------------------------------------------------


def test_lines(spark, awkward, empty):
    rows = [(i, f"own {i}\n  Common Line\t\nlast", "z") for i in range(12)] + [(50 + i, "rare\nrare\nrare", "z") for i in range(9)] + [(70, None, "z"), (71, "", "z"), (72, "common line", "z"), (72, "common line", "z"), (73, "a\n\n\nb\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[3].text == "own 3" and got[3].n_lines == 3 and got[3].n_dropped == 2 and got[50].text == "rare\nrare\nrare"
    assert got[70].text == "" and got[70].n_lines == 1 and got[72].text == "" and got[72].n_dropped == 1 and got[73].text == "a\n\n\nb\n" and got[73].n_lines == 5
    assert line_dedup.dedup_lines(df).count() == len(rows)
    assert line_dedup.dedup_lines(awkward).count() == len(AWKWARD) and line_dedup.dedup_lines(empty).count() == 0


def test_runs_give_the_same_lines_however_batches_fall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.dedup_lines(docs, min_docs=3, batches=b, fanout=f).collect()) for b, f in ((1, 2), (5, 2))]
    assert rows[0] == rows[1]


def test_runs_outlive_the_call_and_merge_without_exchange(spark, tmp_path):
    """Lines that become frequent only with a later call's documents; the store is compacted on the way and holds nothing but runs."""
    def docs(first, n):
        return spark.createDataFrame([(i, f"shared {i % 4}\nown {i}") for i in range(first, first + n)], "doc_id long, text string")

    store = f"file://{tmp_path}/runs"
    kept = [{r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs(20 * i, 20), batches=2, fanout=3, store=store).collect()} for i in range(3)]
    assert set(kept[0].values()) == {0} and set(kept[1].values()) == {1} and set(kept[2].values()) == {1}  # 5, 10, 15 documents
    names = sorted(x for x in (p.name for p in (tmp_path / "runs").iterdir()) if not x.startswith("."))
    assert names and all(x.startswith("run-") for x in names)
    runs = line_dedup.LevelledRuns(spark, store, 10)
    try:
        assert len(runs.runs) > 1 and {r[2] for r in runs.runs} >= {5} and runs.next == 6
        plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == len(runs.runs)
        assert runs.merged().filter("_docs >= 10").count() == 4
    finally:
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("skerry_")]


# --- 10 sharding -------------------------------------------------------------------------------------------------------


def test_shards(spark, sf_dir, texts, awkward, empty):
    rows = sharding.op10_sharding(spark, sf_dir).collect()
    by = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        by.setdefault(r.shard, []).append(r)
    assert sorted(r.doc_id for r in rows) == sorted(texts) and set(by) <= set(range(40))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(awkward, 3).count() == len(AWKWARD) and sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_shards_keep_the_law_of_bytes(spark, sf):
    """40 shards whose bytes differ from the mean by at most half of the largest document; one law for all; slots without gaps."""
    rows = sharding.op10_sharding(spark, f"/root/testdata/{sf}").collect()
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r)
    sums = np.array([sum(r["size"] for r in held.get(k, [])) for k in range(40)])
    assert set(held) == set(range(40)) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert np.abs(sums - sums.mean()).max() <= max(r["size"] for r in rows) / 2, (sums.min(), sums.mean(), sums.max())
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in held.values())


def test_shards_split_groups_of_equal_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
                                    F.lit("s").alias("source"), F.lit("en").alias("lang"))
    sizes = [r["s"] for r in sharding.shard_documents(df, 7).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 7 and max(sizes) < 1.02 * min(sizes)


def test_cuts_follow_the_widest_dimension_at_weighted_medians(spark):
    """Four shards: the first cut is along a (all spreads are equal, the first dimension wins), the next ones along b, which is then wider."""
    rng = np.random.default_rng(9)
    a, b, w = rng.integers(-500, 500, 4000), rng.integers(0, 50, 4000), rng.integers(1, 100, 4000)
    df = spark.createDataFrame([(i, int(x), int(y), int(z)) for i, (x, y, z) in enumerate(zip(a, b, w))], "rid long, a long, b long, w long")
    with Scratch(spark, "test") as scratch:
        shard = {r.rid: r.shard for r in sharding.kd_shards(df, ["a", "b"], "w", 4, scratch).collect()}
    s = np.array([shard[i] for i in range(4000)])
    sums = np.array([w[s == k].sum() for k in range(4)])
    assert sums.max() < 1.03 * sums.min()
    low, high = s < 2, s >= 2
    at = np.sort(a)[np.searchsorted(np.cumsum(w[np.argsort(a, kind="stable")]), w.sum() / 2)]  # the weighted median
    assert abs(a[low].max() - at) <= 2 and abs(a[high].min() - at) <= 2
    for x, y in ((0, 1), (2, 3)):
        assert b[s == x].max() <= b[s == y].min() + 1


def test_a_vocabulary_of_another_kind_is_refused(spark):
    with pytest.raises(ValueError):
        token_store.word_memo(public_tokenizers.path("byte_bpe_50k.json"))
