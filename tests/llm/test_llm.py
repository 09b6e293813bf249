import math
import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import boilerplate, fuse, mixture, neighbours, sentences, split, terms, tokenizer, topn

# --- 1 splitting ---------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longerword ", "End. ", "\n", "\n\n", "字。", "x" * 70, "é́ "]), max_size=120).map("".join))
def test_split_covers_in_order(text):
    spans = split.split_spans(text, 100, 20)
    assert all(0 < b - a <= 100 for a, b in spans)
    assert (not spans) == (not text)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert b - 20 <= c <= b < d and a < c


def test_split_prefers_natural_ends():
    text = ("one two three. " * 20 + "\n") * 3
    spans = split.split_spans(text, 400, 50)
    assert all(text[b - 1].isspace() for _, b in spans)
    assert split.split_spans("a" * 250, 100, 10)[0] == (0, 100)


def test_split_table(spark):
    rows = [("a", "w " * 100, 1), ("a", "w " * 100, 1), ("b", None, 2), ("c", "", 3), ("d", "short", 4), (None, "v " * 100, 5)]
    df = spark.createDataFrame(rows, "id string, body string, piece_no int")
    out = split.split_oversized(df.select("id", "body", "piece_no"), ["id"], "body", 100, 10)
    got = out.orderBy("id", "piece_no").collect()
    assert {r.id for r in got} == {"a", None}
    a = [r for r in got if r.id == "a"]
    assert len(a) == len({r.piece_no for r in a}) and all(len(r.piece) <= 100 and r.overlap <= 10 for r in a)
    assert "".join(r.piece[r.overlap :] for r in sorted(a, key=lambda r: r.piece_no)) == "w " * 100
    assert split.split_oversized(df.limit(0), ["id"], "body").count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(df, ["id"], "body", 100, 50)


# --- 2 top N -------------------------------------------------------------------------------------------------------------


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    out = set()
    for g in {g for g, _ in best}:
        out |= {(g, i) for _, i in sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]}
    return out


def test_top_n(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([rng.randrange(400), None] + [rng.randrange(-(2**62), 2**62)] * 3), rng.choice([round(rng.random(), 1), rng.gauss(0, 1e9), math.nan, None, math.inf, -math.inf, -0.0, 0.0, 5e-324, 1.7e308, -1.7e308])) for _ in range(3000)]
    rows += [(9, i, 0.5) for i in range(500)] + [(10, 7, 1.0)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, s double").withColumn("__score", F.lit("clash")).withColumn("n", F.lit(1))
    for floor in (20_000, 50):  # with and without salted groups
        monkeypatch.setattr(topn, "HOT_FLOOR", floor)
        got = {(r.g, r.i) for r in topn.top_n_per_group(df, ["g"], "i", "s", 10).collect()}
        assert got == brute_top(rows, 10)
    assert topn.top_n_per_group(df.limit(0), ["g"], "i", "s").count() == 0
    quota = spark.createDataFrame([(9, 3), (10, 5), (1, 0)], "g bigint, n bigint")
    got = {(r.g, r.i) for r in topn.top_n_per_group(df, ["g"], "i", "s", quota=quota).collect()}
    assert got == {(9, 0), (9, 1), (9, 2), (10, 7)}


def test_order_code_is_the_bits(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 1 - 2**-53, 1 + 2**-52, 4 - 2**-51, 2.0**1023]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)) if x == x]
    values += [2.0**k * (1 + d) for k in range(-1021, 1023, 7) for d in (0, -(2**-53), 2**-52)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", topn.order_code(F.col("v")).alias("c")).collect()
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert [r.c for r in rows] == [bits(r.v) for r in rows]


def test_top_n_of_the_smallest_differences(spark):
    rows = [(1, 1, 0.0), (1, 2, 5e-324), (1, 3, -5e-324), (2, -(2**63), 1.0), (2, 2**63 - 1, 1.0), (2, 0, 1.0)] + [(3, i, 2.0**-i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, s double")
    for n in (1, 2):
        assert {(r.g, r.i) for r in topn.top_n_per_group(df, ["g"], "i", "s", n).collect()} == brute_top(rows, n)


# --- 3 boilerplate -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8).flatmap(lambda n: st.tuples(st.lists(st.integers(-8, 8), min_size=n, max_size=n), st.dictionaries(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda e: e[0] < e[1]), st.integers(1, 6)))))
def test_min_cut_is_minimal(case):
    unary, edges = case

    def energy(labels):
        return sum(-u if x else 0 for u, x in zip(unary, labels)) + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])

    n = len(unary)
    best = min(energy([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
    assert abs(energy(boilerplate.min_cut([float(u) for u in unary], {e: float(w) for e, w in edges.items()})) - best) < 1e-6
    a, b, w = (np.array(c, k) for c, k in (([e[0] for e in edges], int), ([e[1] for e in edges], int), (list(edges.values()), float)))
    assert abs(energy(boilerplate.cut_graph(np.array(unary, float), a, b, w).tolist()) - best) < 1e-6


def test_boilerplate_page(spark):
    own = "The kettle was moved to the harbour because the wooden drill had failed. Nobody came to repair it, although the town knew."
    body = "Home > Kettle > A kettle\nWe use cookies to improve this site.\nA kettle\n" + own + "\n\nRecent posts\nHow to mend a broken drill\nWhat is the difference between a drill and…\n© 2020 Site. All rights reserved."
    rows = [("a", "https://x.example/1", "A kettle", body, None), ("a", "https://x.example/1", "A kettle", body, None), ("b", None, None, None, None), ("c", None, None, "", None), (None, None, None, "x", None), ("d", None, None, own, None), ("e", "", "", "\n \n" + own * 200, None)]
    df = spark.createDataFrame(rows, "id string, url string, title string, body string, crawl_ts timestamp").withColumn("line", F.lit(1))
    got = {(r.id, r.line_no): r.own for r in boilerplate.label_lines(df).collect()}
    assert {k[0] for k in got} == {"a", "d", "e"}
    assert [got["a", i] for i in (1, 2, 3, 4, 6, 7, 8, 9)] == [False, False, True, True, False, False, False, False]
    assert ("a", 5) not in got and got["d", 1]
    assert {r.id: r.text for r in boilerplate.main_text(df).collect()}["a"] == "A kettle\n" + own
    assert boilerplate.label_lines(df.limit(0)).count() == 0


def lines_of(*bodies, titles=None, facts=None):
    kinds = pa.list_(pa.struct([("line_no", pa.int32()), ("rate", pa.float64()), ("site_pages", pa.int64()), ("share", pa.float64()), ("title_like", pa.bool_()), ("usual", pa.float64())]))
    return boilerplate.Lines(pa.array(bodies, pa.string()), pa.array(titles or [None] * len(bodies), pa.string()), pa.array(facts or [[]] * len(bodies), kinds))


def test_costs_are_the_classifier():
    own = "The kettle was moved to the harbour because the wooden drill had failed and nobody came."
    body = "\n".join(["We use cookies to improve this site.", own, "Recent posts", "What is the difference between a drill and…", "", "few small words", "1. some flour", "漢字の文。", "9" * 5000])
    lines = lines_of(body, "", "\n \n", own)
    assert lines.no.tolist() == [1, 2, 3, 4, 6, 7, 8, 9, 1] and lines.page.tolist() == [0] * 8 + [3]
    sure = np.random.RandomState(3).normal(size=len(boilerplate.SHAPE) + boilerplate.WORDS) * 0.1
    assert (lines.log_odds(sure) != 0).all() and np.allclose(lines.log_odds(sure), -lines.log_odds(-sure)) and not lines.log_odds(0 * sure).any()
    empty = lines_of("", "\n")
    assert len(empty.log_odds(sure)) == 0 and len(boilerplate.cut_graph(np.zeros(0), *empty.edges(np.zeros(0)))) == 0
    # a sentence on 1 % of a large site's pages is repeated all the same, and teaches nothing
    once, often = (lines_of(own, facts=[[{"line_no": 1, "rate": n / 10_000, "site_pages": 10_000, "share": 1.0, "title_like": False, "usual": 0.0}]]) for n in (1, 100))
    assert once.weak_labels().tolist() == [0] and often.weak_labels().tolist() == [-1]


def test_labels_follow_the_training():
    rng = np.random.RandomState(1)
    x = np.ones((400, len(boilerplate.SHAPE)), np.float32)
    y = np.arange(400) % 2
    words = np.where(y == 1, 5, 9)  # only the words tell the labels apart
    w = boilerplate.train(x, y, rng.random_sample(400) > 0.5, np.arange(400), words)
    assert w[len(boilerplate.SHAPE) + 5] > 1 and w[len(boilerplate.SHAPE) + 9] < -1
    assert not boilerplate.train(x, 0 * y, y > 1, np.arange(400), words).any()


def test_cut_of_a_long_page():
    rng = np.random.RandomState(2)
    n = 20_000
    u = rng.normal(size=n)
    a = np.concatenate([np.arange(n - 1), np.arange(n - 2)])
    b = np.concatenate([np.arange(1, n), np.arange(2, n)])
    w = np.concatenate([rng.choice([0.2, 0.35, 5.0], n - 1), np.full(n - 2, 0.15)])
    began = time.perf_counter()
    label = boilerplate.cut_graph(u, a, b, w)
    assert time.perf_counter() - began < 20
    energy = lambda x: (np.where(x, -u, 0).sum() + w[x[a] != x[b]].sum())
    best = energy(label)
    # no single line and no run of lines is better on the other side
    for k in rng.randint(0, n - 12, 300).tolist():
        other = label.copy()
        other[k : k + rng.randint(1, 12)] ^= True
        assert energy(other) >= best - 1e-9


def test_shared_lines_do_not_depend_on_the_number_of_sites(spark):
    notice = "Our partner offers a discount on winter tyres this month."

    def lines(sites):
        # a quarter of the sites carry the notice, on three of ten pages each
        rows = [(f"{s}-{p}", f"https://s{s}.example/{p}", None, f"page {'abcdefghij'[p]} of site {s} itself\n" + (notice if s % 4 == 0 and p < 3 else f"nothing {'abcdefghij'[p]} {s}"), None) for s in range(sites) for p in range(10)]
        return spark.createDataFrame(rows, "id string, url string, title string, body string, crawl_ts timestamp")

    few, many = ({tuple(f[c] for c in boilerplate.FACTS) for f in boilerplate._line_facts(boilerplate._pages(lines(n))).where("id = '0-0'").first()["facts"] if f["line_no"] == 2} for n in (4, 40))
    assert few == many == {(0.3, 10, 0.25, False, 0.3)}


def test_pages_without_url_take_the_rates_of_known_sites(spark):
    rows = [(f"a{p}", f"https://a.example/{p}", None, "Skillets\nOur depot in the old harbour is closed on all Mondays in winter.\n" + f"own text {'abcdefghij'[p]}", None) for p in range(10)]
    rows += [(f"n{k}", None, None, ("Skillets\n" if k == 0 else "") + f"A wholly different sentence about {'abcdefgh'[k % 8] * (k // 8 + 1)} was written here by somebody with patience.", None) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, url string, title string, body string, crawl_ts timestamp")
    facts = {(r.id, f["line_no"]): (f["rate"], f["site_pages"], f["share"]) for r in boilerplate._line_facts(boilerplate._pages(df)).collect() for f in r.facts}
    assert facts["n0", 1] == facts["a0", 1] == (1.0, 10, 1.0) and facts["n0", 2] == (0.0, 1, 0.0) and len(facts) == 91
    own = {(r.id, r.line_no): r.own for r in boilerplate.label_lines(df).collect()}
    assert not own["n0", 1] and not own["a0", 1] and own["n0", 2] and all(own[f"n{k}", 1] for k in range(1, 60))


# --- 4 neighbours --------------------------------------------------------------------------------------------------------


def test_hadamard_keeps_norms():
    x = np.random.RandomState(0).randn(5, 64).astype(np.float32)
    y = neighbours._hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-4)
    assert np.allclose(neighbours._hadamard(y), x, atol=1e-4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes = neighbours.table_codes(unit, 6, [16], 2)
    assert codes.shape == (5, 6, 2) and codes.max() < 32 and (codes[:, :, 0] // 2 != codes[:, :, 1] // 2).all()
    joined = neighbours.table_codes(unit, 6, [64, 1], 3)
    assert joined.max() < 256 and all(len(set(c)) == 3 for c in joined.reshape(-1, 3).tolist())


def test_buckets_follow_the_vectors(monkeypatch):
    # 64 buckets of one hash hold 1,024 vectors here: from there on hashes are joined
    monkeypatch.setattr(neighbours, "FILL", 16)
    work = {}
    for n in (500, 4_000, 32_000, 128_000):
        x = np.random.RandomState(0).randn(n, 32).astype(np.float32)
        axes = neighbours.axes_for(n, 32)
        codes = neighbours.table_codes(x / np.linalg.norm(x, axis=1)[:, None], 2, axes, 2)
        sizes = [np.unique(codes[:, t, 0], return_counts=True) for t in range(2)]
        met = [dict(zip(*map(np.ndarray.tolist, s))) for s in sizes]
        work[n] = np.mean([met[t].get(c, 0) for t in range(2) for p in range(2) for c in codes[:500, t, p].tolist()])
        assert n / np.prod([2 * a for a in axes]) <= 16
    assert neighbours.axes_for(128_000, 32) == [32, 32, 1] and neighbours.axes_for(20_000_000, 384)[0] == 512
    assert max(work.values()) < 3 * min(work.values())  # of 256 times the vectors
    assert [neighbours.tables_for(a) for a in ([4], [32], [64], [512, 8])] == [6, 6, 8, 22]


def brute_neighbours(corpus, questions, k=5):
    good = lambda v: v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    c = {i: unit(v) for i, v in corpus if i is not None and good(v)}
    out = set()
    for kind, rows in (("corpus", corpus), ("question", questions)):
        for i, v in {i: v for i, v in rows if i is not None and good(v)}.items():
            u = unit(v)
            best = sorted((-round(float(u @ w), 6), j) for j, w in c.items() if not (kind == "corpus" and j == i))[:k]
            out |= {(kind, i, j) for _, j in best}
    return out


@pytest.mark.parametrize("rows_limit", [8192, 16])
def test_nearest_vectors(spark, monkeypatch, rows_limit):
    monkeypatch.setattr(neighbours, "ROWS", rows_limit)  # small: buckets in chunks
    rng = np.random.RandomState(1)
    centres = rng.randn(6, 16)
    corpus = [(i, [float(x) for x in centres[i % 6] + 0.2 * rng.randn(16)]) for i in range(150)]
    corpus += [(i, corpus[0][1]) for i in range(1000, 1030)] + [(5000 + i, [3 * x for x in corpus[i][1]]) for i in range(3)] + [corpus[4]] * 2
    corpus += [(900, None), (901, [0.0] * 16), (902, [math.nan] + [1.0] * 15), (903, [1.0] * 5), (None, [1.0] * 16), (904, [None] + [1.0] * 15)]
    questions = [(i, [float(x) for x in 7 * (centres[i % 6] + 0.2 * rng.randn(16))]) for i in range(20)] + [(77, None), (3, None)]
    schema = "array<float>"
    c = spark.createDataFrame(corpus, f"corpus_id bigint, embedding {schema}").withColumn("vec", F.lit(0))
    q = spark.createDataFrame(questions, f"qid bigint, embedding {schema}")
    got = [(r.vec_kind, r.vec_id, r.corpus_id) for r in neighbours.nearest_vectors(c, q, dim=16).collect()]
    want = brute_neighbours(corpus, questions)
    assert len(got) == len(set(got))
    assert {(k, i) for k, i, _ in got} == {(k, i) for k, i, _ in want}
    assert len(want & set(got)) >= 0.97 * len(want)
    assert neighbours.nearest_vectors(c.limit(0), q, dim=16).count() == 0
    one = neighbours.nearest_vectors(c.where("corpus_id = 7"), None, dim=16)
    assert one.count() == 0


def test_neighbour_recall_on_tables(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    c, q = spark.read.parquet(f"{d}/corpus_embeddings.parquet"), spark.read.parquet(f"{d}/question_embeddings.parquet")
    got = {(r.vec_kind, r.vec_id, r.corpus_id) for r in neighbours.nearest_vectors(c, q).collect()}
    good = {}
    for kind, df, key in (("corpus", c, "corpus_id"), ("question", q, "qid")):
        for r in df.collect():
            v = r.embedding
            if v is not None and len(v) == 384 and np.isfinite(v).all() and any(v):
                good.setdefault(kind, {})[r[key]] = np.array(v) / np.linalg.norm(v)
    ids = sorted(good["corpus"])
    m = np.stack([good["corpus"][i] for i in ids])
    want = set()
    for kind in good:
        for i, v in good[kind].items():
            best = sorted((-round(s, 6), j) for s, j in zip((m @ v).tolist(), ids) if not (kind == "corpus" and i == j))[:5]
            want |= {(kind, i, j) for _, j in best}
    assert len(want & got) >= 0.98 * len(want)


# --- 5 and 6 terms -------------------------------------------------------------------------------------------------------

POSTINGS = [
    ("Cat", 1, 2, 0), ("Cat", 1, 2, 0), (" cat ", 1, 3, 0), ("cat", 2, 1, 1), ("cat", 3, 1, 1), ("cat", 4, 1, 1), ("dog", 1, 4, 0), ("dog", 1, 4, 1), (None, 1, 1, 0), (" ", 1, 1, 0), ("", 2, 1, 0), ("x", 1, None, 0),
    ("x", 1, 0, 0), ("x", 2, -3, 0), ("é", 2, 1, 0), ("É", 2, 1, 0), ("y" * 5000, 9, 1, 0), ("z", None, 1, 0),
]
PAGES = [(i, "d", "u", c, 0, 0) for i, c in ((1, 10), (1, 10), (2, None), (3, 5), (4, 0), (5, None), (6, 3), (7, 3), (8, 3), (None, 4))]


@pytest.fixture(scope="module")
def tables(spark):
    p = spark.createDataFrame(POSTINGS, "term string, doc_id bigint, freq int, block_no int").withColumn("occurrences", F.lit("clash"))
    return p, spark.createDataFrame(PAGES, "doc_id bigint, docno string, url string, term_cnt int, begin_pos bigint, end_pos bigint")


def test_term_counts(tables, monkeypatch):
    postings, pages = tables
    want = {"cat": (8, 4), "dog": (8, 1), "é": (1, 1), "É": (1, 1), "y" * 5000: (1, 1)}
    for block in (1 << 18, 2):  # one block, and many
        monkeypatch.setattr(terms, "BLOCK_TERMS", block)
        got = terms.term_counts(terms.clean_postings(postings)).collect()
        assert {r.term: (r.occurrences, r.pages) for r in got} == want
        assert sorted(r.term_id for r in got) == list(range(len(want)))
    marks = {r.term: r.mark for r in terms.mark_terms(terms.term_counts(terms.clean_postings(postings)), pages).collect()}
    assert marks["cat"] == "common" and marks["dog"] == "rare"
    assert terms.term_counts(terms.clean_postings(postings.limit(0))).count() == 0


def test_lexicon_check(spark, tables):
    lex = spark.createDataFrame([("cat", 0, 0, 3, 0), ("Cat", 0, 0, 1, 1), ("Cat", 0, 0, 1, 1), ("dog", 0, 0, None, 0), (None, 0, 0, 1, 0)], "term string, ids_begin bigint, freqs_begin bigint, doc_cnt bigint, block_no int")
    got = {r.term: (r.lexicon_pages, r.agrees) for r in terms.against_lexicon(terms.term_counts(terms.clean_postings(tables[0])), lex).collect()}
    assert got["cat"] == (4, True) and got["dog"] == (None, False) and got["é"] == (None, False)


def test_term_weights(tables):
    postings, pages = tables
    rows = {(r.doc_id, r.term): r for r in terms.term_weights(postings, pages).collect()}
    n, dl = 8, {1: 10, 2: 3, 3: 5, 4: 0, 5: 0, 6: 3, 7: 3, 8: 3}
    avg = sum(dl.values()) / n
    r = rows[1, "dog"]
    assert r.score == round(math.log((n - 1 + 0.5) / 1.5) * 8 * 1.9 / (8 + 0.9 * (0.6 + 0.4 * 10 / avg)), 6)
    assert rows[9, "y" * 5000].df == 1
    top = {(r.doc_id, r.rank): r.term for r in terms.top_terms(terms.term_weights(postings, pages)).collect()}
    assert top[2, 1] == "É" and top[2, 2] == "é" and top[1, 1] == "dog"
    assert terms.term_weights(postings.limit(0), pages).count() == 0


# --- 7 fusion ------------------------------------------------------------------------------------------------------------

S = ["a", "b", "c"]


def test_fusion(spark, monkeypatch):
    rng = random.Random(5)
    val = lambda: rng.choice([None, math.nan, rng.randint(0, 5) * 1.0, rng.gauss(0, 100)])
    rows = [(g, i, val(), val(), val()) for g in range(40) for i in range(rng.randint(1, 9))]
    rows += rows[:20] + [(None, 1, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)] + [(99, i, float(i), float(i), 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "q bigint, p bigint, a double, b double, c double").withColumn("rank", F.lit("clash"))
    ranking = fuse.ideal_point_ranking(df, "q", "p", S)
    got = ranking.collect()
    best = {}
    for g, i, *s in rows:
        if g is not None and i is not None:
            best[g, i] = [x if x is not None and not math.isnan(x) else None for x in s]
    assert len(got) == len(best)
    for g in {k for k, _ in best}:
        mine = sorted((r.rank, -r.closeness, r.p) for r in got if r.q == g)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: x[1:])
    higher = lambda x, y: sum(u is not None and (v is None or u > v) for u, v in zip(x, y))
    want = {(g, i) for (g, i), s in best.items() if all(higher(s, t) >= 2 for (h, j), t in best.items() if h == g and j != i)}
    for chunk in (512, 3):
        monkeypatch.setattr(fuse, "CHUNK", chunk)
        assert {(r.q, r.p) for r in fuse.majority_winner(ranking, "q", "p", S).collect()} == want
    assert fuse.majority_winner(fuse.ideal_point_ranking(df.limit(0), "q", "p", S), "q", "p", S).count() == 0


def test_no_score_dominates(spark):
    # a thousandfold scale of one score changes nothing
    rng = random.Random(2)
    rows = [(1, i, rng.random(), rng.random(), rng.random()) for i in range(30)]
    order = lambda f: [r.p for r in fuse.ideal_point_ranking(spark.createDataFrame([(q, p, a * f, b, c) for q, p, a, b, c in rows], "q bigint, p bigint, a double, b double, c double"), "q", "p", S).orderBy("rank").collect()]
    assert order(1.0) == order(1024.0)


# --- 8 encoding ----------------------------------------------------------------------------------------------------------

ODD = ["", None, " ", "Hello world", "<|endoftext|>", "é́ 👩‍🔧🧰 漢字 \x00\x01", "a" * 5000, "İ​﻿", "हिन्दी ไทย", "\r\n\t  x"]


def test_encoding(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokenizer.encode(df, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and got[3] == [15496, 995] and 50256 not in got[4]
    assert [tokenizer.decode_one(got[i]) for i in range(len(ODD))] == [t or "" for t in ODD]
    counts = {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df, ["doc_id"], "text").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = tokenizer.decode(tokenizer.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    spans = tokenizer.token_spans(df, "doc_id", "text").collect()
    assert all(0 <= r.begin_pos <= r.end_pos <= len(ODD[r.doc_id]) for r in spans)
    assert tokenizer.encode(df.limit(0), "doc_id", "text").count() == 0


def test_encoding_agrees_with_the_other_library(spark, data):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in tokenizer.encode(docs, "doc_id", "text").collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id])


# --- 9 mixing ------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(0, 900), st.sampled_from([1 << 16, 150]))
def test_budget_fit_is_best(stock, budget, gap):
    lengths, counts = np.array(sorted(stock)), np.array([stock[k] for k in sorted(stock)])
    take = mixture.fit_budget(lengths, counts, budget, gap)
    assert (take >= 0).all() and (take <= counts).all()
    got, sums = int((take * lengths).sum()), {0}
    for n, c in stock.items():
        sums = {s + n * i for s in sums for i in range(c + 1)}
    assert got <= budget or got == sum(n * c for n, c in stock.items()) <= budget
    if gap > budget:
        assert got == max(s for s in sums if s <= budget)


def test_budget_fit_is_in_proportion():
    rng = np.random.RandomState(5)
    lengths = np.unique((60 * (1 / rng.random_sample(900)) ** 0.8).astype(int).clip(20, 40_000) + np.arange(900))
    counts = np.ones_like(lengths)
    for part in (0.2, 0.4, 0.7):
        budget = int(lengths.sum() * part)
        drawn = [mixture.fit_budget(lengths, counts, budget, seed=k) for k in range(30)]
        assert all(int((t * lengths).sum()) == budget for t in drawn)
        by_tenth = [np.mean([t[k] for t in drawn]) for k in np.array_split(np.arange(len(lengths)), 10)]
        assert max(by_tenth) - min(by_tenth) < 0.2 and abs(np.mean(by_tenth) - part) < 0.1
        assert len({tuple(t) for t in drawn}) == 30
    again = mixture.fit_budget(lengths, counts, budget, seed=3)
    assert (again == drawn[3]).all()
    # documents longer than the gap, and budgets around them
    fit = lambda stock, budget: int((mixture.fit_budget(np.array(list(stock)), np.array(list(stock.values())), budget) * np.array(list(stock))).sum())
    assert fit({70_000: 1, 90_000: 1}, 95_000) == 90_000
    assert fit({70_000: 3, 80_000: 1}, 150_000) == 150_000 and fit({66_000: 2, 70_001: 2}, 136_001) == 136_001
    assert fit({3_000_000: 5, 1_999_999: 4, 7: 2}, 6_999_998 + 7) == 6_999_998 + 7 and fit({2_000_000: 50, 3_000_000: 3}, 41_000_000) == 41_000_000
    assert fit({10: 5, 1_000: 1}, 1_035) == 1_030


def test_shares():
    goal = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)]
    assert mixture.share_budgets(1000, goal, {"a": 10_000, "b": 5000, "c": 5000}) == {"a": 500, "b": 300, "c": 200}
    short = mixture.share_budgets(1000, goal, {"a": 10_000, "b": 50})
    assert short == {"a": 900, "b": 100, "c": 0}
    assert mixture.reachable_total(goal, {"a": 1000, "b": 300, "c": 100}, 0.8) == 2000


def test_mix(spark):
    docs = [(i, f"word {i} " * (i % 7 + 1), s) for i, s in enumerate(["big"] * 300 + ["Small "] * 10 + ["other"] * 5)] + [(900, None, "big"), (901, "", "big"), (902, "x", None), (None, "x", "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("uses", F.lit("clash"))
    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixture.mix_sources(df, goal, total_tokens=1500, seed=1)
    rows, rep = mix.collect(), {r.source: r for r in report.collect()}
    assert {r.source for r in rows} == {"big", "small"} and len({r.doc_id for r in rows}) == len(rows)
    assert max(r.uses for r in rows if r.source == "small") <= 3 and {r.uses for r in rows if r.source == "big"} == {1}
    assert rep["none"].actual_share == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-5
    assert rep["big"].mix_tokens == rep["big"].budget == sum(r.n_tokens for r in rows if r.source == "big")
    again = {(r.doc_id, r.uses) for r in mixture.mix_sources(df, goal, total_tokens=1500, seed=1)[0].collect()}
    assert again == {(r.doc_id, r.uses) for r in rows}
    empty, rep0 = mixture.mix_sources(df.limit(0), goal)
    assert empty.count() == 0 and rep0.count() == 3


# --- 10 sentences --------------------------------------------------------------------------------------------------------

CASES = [
    (["Dr. Lee saw 3.5 m. of rope at 5 p.m. on Monday.", "It held."], " "),
    (["The shop closes at 5 p.m.", "We left."], " "),
    (["Open config.yaml and set x = 1.2 now.", "Done!"], ""),
    (["“It failed. Nobody came,” said Ms. Roe.", "Why?", "Nobody knows."], " "),
    (["'It is thin.'", "That was all he would say."], " "),
    (['"Where is it?" Capt. Roe asked twice.', "(Prices are in crowns.)", "See No. 3 (it is short. It is old.) for more."], " "),
    (["1. First item here.", "2. Second item."], "\n"),
    (["バルブが壊れた。", "「誰も来ない。」と管理人は言った。", "終わり？"], ""),
    (["管理员说：“水泵坏了。没有人来修。”", "裂缝长28.6厘米。"], ""),
    (["«تعطلت المضخة. لم يأت أحد» قال الحارس.", "كم ثمن السلم؟"], " "),
    (["दरार 17.2 से.मी. लंबी है।", "डॉ. मेहरीन ने कहा।"], " "),
    (["Πόσο κοστίζει η πόρτα;", "Η γέφυρα άνοιξε το 1945."], " "),
    (["ควรตรวจบันไดก่อนฤดูหนาว", "วาล์วใช้ได้นาน 41 ปี", "จบ"], "  "),
    (["Am 26. Mai 1893 zog es um, z. B. nach Ulm.", "Ende."], " "),
    (["Трещина 16,3 см, т. е. мала.", "Дом на ул. Мира, д. 4, стоит."], " "),
    (["Great! 🙏🏽", "Next one."], " "),
    (["¿Qué dijo?, preguntó.", "¡No!"], " "),
    (["the valve is dry. 😀", "an early rash may point up.", "who knows?"], " "),
]


@pytest.mark.parametrize(("want", "glue"), CASES)
def test_sentences(want, glue):
    text = glue.join(want)
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_sentence_blocks():
    text = "Heading\r\n\r\nA line that\r\ngoes on. And more\n \nfor (i = 0; i < n; ++i) { x += a[i]; }\n\n\n"
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["Heading", "A line that\r\ngoes on.", "And more", "for (i = 0; i < n; ++i) { x += a[i]; }"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?…\n\r\"'“”«»()。「」;123ก ๆ👍　​", max_size=60))
def test_sentences_cover_everything(text):
    spans = sentences.sentences(text)
    at = 0
    for a, b in spans:
        assert at <= a < b <= len(text) and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "A bee. C dee."), (2, None), (3, ""), (4, " \n "), (5, "x" * 100_000), (6, "(" * 50_000)], "doc_id bigint, text string").withColumn("sentence", F.lit(0))
    got = sentences.sentence_spans(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {1, 5, 6} and [r.sentence for r in got if r.doc_id == 1] == ["A bee.", "C dee."]
    assert sentences.sentence_spans(df.limit(0), "doc_id", "text").count() == 0


def test_long_single_quotation_is_one_sentence():
    inner = " ".join(["The pump broke down again and nobody in town came to look at it."] * 12)
    text = f"'{inner}' They left."
    assert len(inner) > 400 and [text[a:b] for a, b in sentences.sentences(text)] == [f"'{inner}'", "They left."]


def test_list_levels_are_on_the_stack():
    text = "Intro here.\n\n1. First item.\n\n   - Inner one. It goes on.\n\n   - Inner two.\n\n2. Second item.\n\nBack at the margin."
    got = [(text[a:b], d) for a, b, d in sentences.leveled_sentences(text)]
    assert got == [("Intro here.", 0), ("1. First item.", 1), ("- Inner one.", 2), ("It goes on.", 2), ("- Inner two.", 2), ("2. Second item.", 1), ("Back at the margin.", 0)]
