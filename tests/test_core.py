import gzip
import json
import math
import random
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import codec, present, scoring
from lodestone.functions.text import query_key, tokens
from lodestone.operators import evaluate, index, ordinal, retrieve, skew, vector
from lodestone.service import Engine, mode_number, serve
from lodestone.sources import binary, files
from lodestone.streaming import cache
from lodestone.streaming.requests import answer_stream

GOLDEN = {
    "WORLD cafÉ": ["world", "cafÉ"], "a—b": ["a", "b"], "文。字": ["文", "字"], "中文，文": ["中文，文"], "あこん": ["ん"], "a b": ["a b"], "😀x": ["😀x"], "": [], "!?": [],
}


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


def test_tokens(spark):
    for text, want in GOLDEN.items():
        assert one(spark, text, "string", tokens) == want
    assert one(spark, None, "string", tokens) is None
    assert one(spark, "  The the  CAT-cat dog ", "string", query_key) == "cat dog the"


def test_vbyte_golden(spark):
    for v, want in {0: "80", 127: "FF", 128: "0081", 16383: "7FFF", 16384: "000081", 2**32 - 1: "7F7F7F7F8F"}.items():
        assert one(spark, [v], "array<bigint>", lambda x: F.hex(codec.vbyte_encode(x))) == want
    assert one(spark, [3, 7, 20], "array<bigint>", codec.delta) == [3, 4, 13]


def test_codec_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, sorted(rng.choice([0, 1, 127, 128, 2**32 - 1, 2**35, 2**62, rng.randrange(2**40)]) for _ in range(rng.randrange(30)))) for i in range(200)] + [(200, None), (201, [])]
    df = spark.createDataFrame(rows, "i int, v array<bigint>")
    got = df.select("i", codec.vbyte_decode(codec.vbyte_encode(F.col("v"))).alias("v"), codec.undelta(codec.delta(F.col("v"))).alias("d"), F.octet_length(codec.vbyte_encode(F.col("v"))).alias("n"), F.transform("v", lambda x: codec.vbyte_size(x)).alias("s")).collect()
    assert {r.i: r.v for r in got} == {r.i: r.d for r in got} == dict(rows)
    assert all(r.n == sum(r.s) for r in got if r.v)
    broken = spark.createDataFrame([(bytearray([0x81, 0x05]),), (bytearray([0x85]),), (None,), (bytearray(),)], "b binary")
    assert [r[0] for r in broken.select(codec.vbyte_decode(F.col("b"))).collect()] == [[1], [5], None, []]
    for bad in (codec.vbyte_encode, lambda x: F.transform(x, codec.vbyte_size)):
        with pytest.raises(Exception, match="negative"):
            one(spark, [-1], "array<bigint>", bad)


def test_long_lists_in_linear_time():
    values = np.cumsum(np.random.RandomState(0).randint(1, 300, 3_000_000))
    began = time.perf_counter()
    data, _ = codec.to_vbytes(np.diff(values, prepend=0))
    back, _ = codec.from_vbytes(data, np.array([0, len(data)]))
    assert (np.cumsum(back) == values).all() and time.perf_counter() - began < 10


def test_scores(spark):
    row = spark.createDataFrame([(3, 2, 10, 100, 20.0)], "f int, df bigint, dl int, n bigint, a double")
    got = row.select(scoring.bm25(*(F.col(c) for c in ("f", "df", "dl", "n", "a")))).first()[0]
    assert got == pytest.approx(math.log(98.5 / 2.5) * 3 * 1.9 / (3 + 0.9 * (0.6 + 0.4 * 10 / 20)))
    assert one(spark, 3, "int", lambda r: scoring.reciprocal_rank(r, 10)) == pytest.approx(1 / 3)
    assert one(spark, None, "int", lambda r: scoring.reciprocal_rank(r, 10)) == 0
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert v.select(scoring.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2**-0.5)


def snippet_by_bytes(text, terms, length):
    """The same windows, by stepping over bytes."""
    import re

    low, data, size = text.encode(), text.encode(), len(text.encode())
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in low).decode()
    for t in terms:
        for m in re.finditer("[0-9a-z\u0080-῿⁰-⿿む-\U0010ffff]+", low):
            if m[0] == t:
                pos = len(low[: m.start()].encode())
                a, b = max(pos - length // 2, 0), min(pos + length // 2, size)
                while a > 0 and a < size and data[a] >= 128:
                    a -= 1
                moved = b
                while b < size and data[b] >= 128:
                    b += 1
                if b > moved and b + 1 < size:
                    b += 1
                return data[a:b].decode()
    return None


def test_snippets(spark, data):
    docs = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r.text]
    docs += ["é cat", "dog", "cat", "ééé cat ééé", "a cat é"]
    words = ["cat", "de", "filter", "the", "und"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "i int, t string")
    for length in (4, 5, 60):
        got = {r.i: r.s for r in df.select("i", present.snippet(F.col("t"), F.array(*map(F.lit, words)), length).alias("s")).collect()}
        assert got == {i: snippet_by_bytes(t, words, length) for i, t in enumerate(docs)}
    with pytest.raises(ValueError):
        present.snippet(F.col("t"), F.array(), 0)


def test_windows_are_the_snippets():
    rng = random.Random(6)
    words = ["cat", "é", "字", "dog", " ", ".", "\n", "xé", "éx", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(words) for _ in range(rng.randrange(12)))
        length = rng.choice([1, 2, 3, 4, 9, 60])
        for term in ("cat", "dog", "é", "xé"):
            assert present.windows(text, [(term, length)]).get((term, length)) == snippet_by_bytes(text, [term], length)


def test_highlight_and_modes(spark):
    rows = spark.createDataFrame([("Cat dog", ["cat"]), ("Cat dog", ["dog", "12"]), ("Cat", None), (None, ["cat"])], "t string, w array<string>")
    assert [r[0] for r in rows.select(present.highlight(F.col("t"), F.col("w"))).collect()] == ["<b>Cat</b> dog", "Cat <b>dog</b>", "Cat", None]
    assert one(spark, "Cat 12 cats É", "string", lambda t: present.highlight(t, ["cat", "12", ""])) == "<b>Cat</b> 12 cats É"
    assert one(spark, "x", "string", lambda t: present.highlight(t, [])) == "x"
    assert [one(spark, p, "string", present.mode_of) for p in ("con", "r", "x", "")] == ["conjunctive", "reranking", None, "conjunctive"]
    assert [mode_number(t) for t in (0, 1, 2, 3, 9)] == ["conjunctive", "disjunctive", "semantic", "reranking", "semantic"]


DOCS = [(0, "u0", "cat dog cat"), (1, "u1", "cat"), (2, "u2", "dog bird"), (3, "u3", "cat dog cat"), (4, "u4", ""), (5, None, None), (6, "u6", "fish")]


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, url string, text string")
    postings = index.term_freqs(docs)
    return docs, postings, index.lexicon(postings), index.page_table(docs)


def queries(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, query string")


def test_index(spark, built, tmp_path):
    docs, postings, lexicon, pages = built
    assert {(r.term, r.doc_id, r.freq) for r in postings.collect()} >= {("cat", 0, 2), ("bird", 2, 1)}
    assert {r.term: r.doc_cnt for r in lexicon.collect()} == {"cat": 3, "dog": 3, "bird": 1, "fish": 1}
    assert index.corpus_stats(pages).first().asDict() == {"n": 7, "total_terms": 10, "avgdl": 10 / 7}
    assert index.corpus_stats(pages.limit(0)).first().asDict() == {"n": 0, "total_terms": 0, "avgdl": None}
    index.write_index(docs, str(tmp_path / "i"))
    back = index.read_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, back["postings"].collect())) == sorted(map(tuple, postings.collect()))
    packed = {r.term: (r.doc_ids, r.freqs) for r in index.packed_blocks(postings).collect()}
    assert packed["cat"] == ([0, 1, 3], [2, 1, 2])
    blocks = index.packed_blocks(postings, 2).where("term = 'cat'").orderBy("block").collect()
    assert [(r.block, r.doc_ids) for r in blocks] == [(0, [0, 1]), (1, [3])]


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_merging_blocks_is_building_at_once(spark, built, cut):
    docs, postings, *_ = built
    parts = [index.term_freqs(docs.where(F.col("doc_id") % cut == i)).withColumn("block_no", F.lit(i)) for i in range(cut)]
    blocks = parts[0]
    for p in parts[1:]:
        blocks = blocks.unionByName(p)
    assert sorted(map(tuple, index.merge_blocks(blocks).collect())) == sorted(map(tuple, postings.collect()))


def test_index_files(spark, built, tmp_path):
    _, postings, *_ = built
    for diff in (True, False):
        files.write_index_text(postings, str(tmp_path / f"t{diff}"), diff)
        assert sorted(map(tuple, files.read_index_text(spark, str(tmp_path / f"t{diff}"), diff).collect())) == sorted(map(tuple, postings.collect()))
    files.write_lines(built[2], str(tmp_path / "lex"), ["term", "doc_cnt"])
    assert sorted(map(tuple, files.read_lines(spark, str(tmp_path / "lex"), "term string, doc_cnt bigint").collect())) == sorted(map(tuple, built[2].collect()))
    (next((tmp_path / "tTrue" / "ids").glob("part-*"))).unlink()
    with pytest.raises(ValueError, match="files of ids"):
        files.read_index_text(spark, str(tmp_path / "tTrue"))
    with pytest.raises(Exception, match="white space"):
        files.write_index_text(spark.createDataFrame([("a b", 1, 1)], "term string, doc_id bigint, freq int"), str(tmp_path / "w"))
    bad = spark.createDataFrame([("a", "1 2", "1")], "term string, ids string, freqs string")
    with pytest.raises(Exception, match="differ in number"):
        files.parse_index_lines(bad).collect()
    for block in (1 << 20, 1):
        sizes = {r.term: r for r in index.index_sizes(postings, block).collect()}
        assert sizes["cat"].delta_bytes == 3 and sizes["cat"].raw_bytes == 12


def test_delta_of_long_lists(spark):
    """Linear in the length: lists that are fields of an array of structs are not built again for every element."""
    n = 100_000
    postings = spark.range(n).select(F.lit("a").alias("term"), (F.col("id") * 3).alias("doc_id"), F.lit(1).alias("freq"))
    began = time.monotonic()
    assert [(r.term, r.block, r.ids) for r in files.index_lines(postings).collect()] == [("a", 0, " ".join(["0"] + ["3"] * (n - 1)))]
    assert time.monotonic() - began < 20
    rows = [(0, [5, 7, 20]), (1, [4]), (2, []), (3, None), (4, [1, None, 9])]
    for kind in ("int", "bigint"):
        df = spark.createDataFrame(rows, f"i int, v array<{kind}>").select("i", codec.delta(F.col("v")).alias("d"))
        assert df.schema["d"].dataType.simpleString() == f"array<{kind}>"
        assert {r.i: r.d for r in df.collect()} == {0: [5, 2, 13], 1: [4], 2: [], 3: None, 4: [1, None, None]}


@pytest.mark.parametrize("form", ["bin", "vbyte"])
def test_block_files(spark, tmp_path, monkeypatch, form):
    """Blocks are read by several tasks; lists that are longer than a batch, or come in several parts, stay whole."""
    rows = [("a", i * 700, 1 + i % 200, i % 8) for i in range(100_000)] + [("\u0100\u00e9", i, 300, 3) for i in range(3)] + [("c\\s", 2**32 - 1, 7, 11), ("c\\s", 2**32 - 1, 7, 11), ("b", 0, 2**20, 8), (None, 1, 1, 1), ("", 1, 1, 1)]
    postings = spark.createDataFrame(rows, "term string, doc_id bigint, freq bigint, block_no int").repartition(5)
    path = str(tmp_path / "b")
    binary.write_blocks(postings, path, form)
    read = lambda: binary.read_blocks(spark, path, form)
    assert read().select(F.spark_partition_id()).distinct().count() > 1
    monkeypatch.setattr(binary, "DECODED_AT_ONCE", 5)
    assert sorted(map(tuple, read().collect())) == sorted(r for r in rows if r[0])
    whole = {"bin": b"b \1\0\0\0\0\0\0\0", "vbyte": b"b \1\0\0\0\x80"}[form]
    assert (tmp_path / "b" / f"008.{form}").read_bytes() == whole
    (tmp_path / "b" / f"008.{form}").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="cut short"):
        read().collect()
    (tmp_path / "b" / f"008.{form}").write_bytes(whole[:2] + b"\2" + whole[3:] + whole[-1:] * (4 if form == "bin" else 1))
    with pytest.raises(Exception, match="differ in number"):
        read().collect()
    for bad, why in (("a b", "white space"), ("a\tb", "white space")):
        with pytest.raises(Exception, match=why):
            binary.write_blocks(postings.limit(1).withColumn("term", F.lit(bad)), str(tmp_path / "w"), form)
    for c in ("doc_id", "freq"):
        with pytest.raises(Exception, match="32 bits"):
            binary.write_blocks(postings.where("term = 'b'").withColumn(c, F.lit(-1)), str(tmp_path / "x"), form)
    (tmp_path / "none").mkdir()
    assert binary.read_blocks(spark, str(tmp_path / "none"), form).count() == 0


@pytest.mark.parametrize("form", ["bin", "vbyte"])
def test_binary_files(spark, tmp_path, monkeypatch, form):
    rows = [("a", i * 700, 1 + i % 200) for i in range(300)] + [("b", 2**32 - 1, 2**20), ("é", 0, 1)]
    postings = spark.createDataFrame(rows, "term string, doc_id bigint, freq bigint")
    for pages, diff, parts in ((1 << 20, True, None), (1000, True, 3), (1000, False, 1)):
        monkeypatch.setattr(binary, "packed_blocks", lambda p: index.packed_blocks(p, pages))
        path = str(tmp_path / f"{pages}{diff}")
        lexicon = binary.write_merged(postings, path, form, diff, parts)
        assert sorted(map(tuple, binary.read_merged(spark, path, None, form, diff).collect())) == sorted(rows)
        assert sorted(map(tuple, binary.read_merged(spark, path, ["é", "b", "none"], form, diff).collect())) == sorted(rows[300:])
    assert [r.value for r in binary.lexicon_lines(lexicon).where("term = 'a'").collect()] == ["a 0 0 300"]
    with pytest.raises(Exception, match="32 bits"):
        binary.write_merged(postings.limit(1).withColumn("doc_id", F.lit(2**32)), str(tmp_path / "x"), form)
    blocks = postings.withColumn("block_no", (F.col("doc_id") % 3).cast("int"))
    binary.write_blocks(blocks, str(tmp_path / "b"), form)
    assert [n[0][-len(form) - 4 :] for n in binary.block_files(str(tmp_path / "b"), form)] == [f"00{i}.{form}" for i in range(3)]
    assert sorted(map(tuple, binary.read_blocks(spark, str(tmp_path / "b"), form).collect())) == sorted(map(tuple, blocks.collect()))
    (tmp_path / "b" / f"001_freqs.{form}").unlink()
    with pytest.raises(ValueError, match="pair"):
        binary.block_files(str(tmp_path / "b"), form)
    binary.write_merged(postings.limit(0), str(tmp_path / "e"), form)
    assert binary.read_merged(spark, str(tmp_path / "e"), None, form).count() == 0


def test_search(spark, built, monkeypatch):
    _, postings, lexicon, pages = built
    q = queries(spark, [(1, "cat dog"), (2, "Dog CAT cat"), (3, "cat zzzz"), (4, "cat"), (5, "zzzz"), (6, None), (7, ""), (1, "cat dog"), (None, "cat")])
    hits = lambda both, n=10: {(r.qid, r.rank): (r.doc_id, r.score) for r in retrieve.search(q, postings, lexicon, pages, both, n).collect()}
    both, any_ = hits(True), hits(False)
    assert [both[1, i][0] for i in (1, 2)] == [0, 3] and (1, 3) not in both  # a tie goes to the smaller id
    assert [both[2, i] for i in (1, 2)] == [both[1, i] for i in (1, 2)]
    assert {k[1]: v for k, v in both.items() if k[0] == 3} == {k[1]: v for k, v in both.items() if k[0] == 4}  # unknown terms are ignored
    assert not {5, 6, 7} & {k[0] for k in any_}
    docs = lambda h, qid: {v[0] for k, v in h.items() if k[0] == qid}
    assert docs(both, 1) <= docs(any_, 1) == {0, 1, 2, 3}
    assert {k: v for k, v in any_.items() if k[1] <= 2} == hits(False, 2)  # a shorter list is a prefix
    counts = {r.qid: r.hits for r in retrieve.hit_counts(q, postings, lexicon, True).collect()}
    assert counts == {1: 2, 2: 2, 3: 3, 4: 3, 5: 0, 6: 0, 7: 0}
    freqs = {(r.qid, r.doc_id): r.freqs for r in retrieve.hit_freqs(retrieve.search(q, postings, lexicon, pages, True), q, postings).collect()}
    assert [tuple(x) for x in freqs[1, 0]] == [("cat", 2), ("dog", 1)]
    with pytest.raises(ValueError):
        retrieve.search(q, postings, lexicon, pages, True, 0)
    strict = {r.qid for r in retrieve.search(q, postings, lexicon, pages, True, strict=True).collect()}
    assert strict == {1, 2, 4} and retrieve.search(q.limit(0), postings, lexicon, pages, True).count() == 0
    monkeypatch.setattr(retrieve, "BLOCK", 2)  # several passes over the shards
    monkeypatch.setattr(retrieve, "NAMED", 1)
    assert hits(True) == both and hits(False) == any_
    for terms, both_ in ((["cat", "dog"], True), (["bird", "cat"], False), (["zzzz"], True)):
        count, best = retrieve.answer_one(terms, postings, lexicon, pages, both_)
        asked = queries(spark, [(1, " ".join(terms))])
        assert [(r.doc_id, r.score) for r in retrieve.search(asked, postings, lexicon, pages, both_).orderBy("rank").collect()] == best
        assert [r.hits for r in retrieve.hit_counts(asked, postings, lexicon, both_).collect()] == [count]


def test_vectors(spark, tmp_path):
    corpus = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [math.nan, 1.0]), (7, [1.0]), (3, [0.0, 1.0]), (8, [1.0, 1.0])]
    c = spark.createDataFrame(corpus, "cid bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "qid bigint, embedding array<float>")
    top = [(r.item, r.score) for r in vector.top_k(q, c, "qid", "cid", 3, dim=2).orderBy("rank").collect()]
    assert top == [(1, 1.0), (2, 1.0), (8, 0.707107)]
    assert [r.item for r in vector.top_k(q, c, "qid", "cid", 2, dim=2, normalise=False).orderBy("rank").collect()] == [2, 1]
    assert vector.top_k(q.limit(0), c, "qid", "cid", 2).count() == 0
    farther = vector.top_k(q, c, "qid", "cid", 2, dim=2, score=lambda a, b: -np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)))
    assert [r.item for r in farther.orderBy("rank").collect()] == [1, 2]
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "b" * 9)], "i bigint, t string")
    made = vector.encode_batches(texts, "i", "t", lambda: lambda xs: [[len(x), 1] for x in xs], 1)
    assert sorted(map(tuple, made.collect())) == [(1, [2.0, 1.0]), (4, [9.0, 1.0])]
    marks = vector.score_batches(texts.withColumn("q", F.lit("x")), ["i"], "q", "t", lambda: lambda ps: [len(a + b) for a, b in ps], 2)
    assert sorted(map(tuple, marks.collect())) == [(1, 3.0), (2, 1.0), (3, 1.0), (4, 10.0)]
    vector.save_vectors(made, str(tmp_path / "v"), "i")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    with pytest.raises(ValueError, match="sizes"):
        vector.save_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "i int, embedding array<double>"), str(tmp_path / "w"), "i")
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, 5.0), (1, 4, None), (1, 5, math.nan)], "qid bigint, rank int, s double")
    assert [r["rank"] for r in vector.rerank(rows, "s").orderBy("rank2").collect()] == [2, 1, 3, 4, 5]


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, 10), (2, 4, 20), (3, 1, 99), (2, 6, 20)], "qid bigint, rank int, doc_id bigint")
    qrels = spark.createDataFrame([(1, 10), (1, 9), (2, 20), (3, 30), (None, 1)], "qid bigint, doc_id bigint")
    assert evaluate.mrr(hits, qrels).first().mrr == round((1 + 0.25 + 0) / 3, 9)
    assert evaluate.mrr(hits, qrels, 3).first().mrr == round(1 / 3, 9)
    assert evaluate.reciprocal_ranks(hits, qrels.unionByName(spark.createDataFrame([(2, 99)], "qid bigint, doc_id bigint")), all_labels=True).where("qid = 2").first().rr == 0.25
    assert evaluate.mrr(hits, qrels.limit(0)).first().asDict() == {"queries": 0, "mrr": None}


def test_trec(spark, tmp_path):
    rec = lambda no, url, text: f"<DOC>\n<DOCNO>{no}</DOCNO>\n<TEXT>\n{url}\n{text}\n</TEXT>\n</DOC>\n"
    body = rec("D1", "u1", "one\ntwo") + rec("D2", "u2", "") + "<DOC>\n<TEXT>\nno number\n</TEXT>\n</DOC>\n" + rec("D3", "", "three word")
    (tmp_path / "a.trec").write_text(body)
    with gzip.open(tmp_path / "b.trec.gz", "wt") as f:
        f.write(body)
    want = [("D1", "u1", "one\ntwo"), ("D2", "u2", ""), ("D3", "", "three word")]
    for name in ("a.trec", "b.trec.gz"):
        rows = files.read_trec(spark, str(tmp_path / name)).collect()
        assert [(r.docno, r.url, r.text) for r in rows if r.valid] == want and sum(not r.valid for r in rows) == 1
        ordered = files.read_trec_ordered(spark, str(tmp_path / name)).orderBy("doc_id").collect()
        assert [(r.doc_id, r.docno) for r in ordered] == [(0, "D1"), (1, "D2"), (2, "D3")]


def test_trec_order_over_files(spark, tmp_path):
    rec = lambda no, text: f"<DOC>\n<DOCNO>{no}</DOCNO>\n<TEXT>\nu\n{text}\n</TEXT>\n</DOC>\n"
    wanted = []
    for name, count, size in (("a.trec", 2, 10), ("b.trec", 40, 900), ("c.trec", 1, 5), ("d.trec.gz", 7, 50), ("e.trec", 300, 2000)):
        names = [f"{name[0]}{i}" for i in range(count)]
        wanted += names
        body = "".join(rec(n, "x " * size) for n in names)
        (tmp_path / name).write_bytes(gzip.compress(body.encode()) if name.endswith("gz") else body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")  # several splits of the large file
        rows = files.read_trec_ordered(spark, str(tmp_path)).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.docno for r in rows] == wanted and [r.doc_id for r in rows] == list(range(350))


def test_text_sources(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('1\ta "b" c\n2\tx\ty\nbad\tz\n')
    assert [tuple(r) for r in files.read_queries(spark, str(tmp_path / "q.tsv")).collect()] == [(1, 'a "b" c'), (2, "x\ty"), (None, "z")]
    lines = spark.createDataFrame([("1 0 D1 1",), ("2\t0\tD9\t1",), ("3",), (None,)], "value string")
    ords = spark.createDataFrame([("D1", 5)], "docno string, doc_id bigint")
    parsed = files.parse_qrels(lines)
    assert sorted(map(tuple, files.convert_qrels(parsed, ords, strict=False).collect())) == [(1, 5), (2, 0)]
    assert sorted(map(tuple, files.convert_qrels(parsed, ords).collect())) == [(1, 5)]
    (tmp_path / "c.tsv").write_text('D1\tu\tt "x\tbody\n')
    assert tuple(files.read_corpus_tsv(spark, str(tmp_path / "c.tsv")).first()) == ("D1", "u", 't "x', "body")
    docs = spark.createDataFrame([(5, "a"), (1, None), (3, "b"), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, files.corpus_map(docs).collect())) == [(0, 3), (1, 5)]


def test_running_total_and_ranks(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3, None if i == 7 else i) for i in range(100)], "i bigint, g bigint, v bigint")
    got = {r.i: r.before for r in ordinal.running_total(df.repartition(5), ["i"], F.col("v"), "before").collect()}
    assert got == {i: sum(j for j in range(i) if j != 7) for i in range(100)}
    ranks = {r.i: r["rank"] for r in skew.rank_in_groups(df, "g", [F.desc("i")]).collect()}
    assert ranks == {i: 1 + sum(1 for j in range(i + 1, 100) if j % 3 == i % 3) for i in range(100)}
    monkeypatch.setattr(skew, "HOT_FLOOR", 10)
    right = spark.createDataFrame([(0, "a"), (2, "c"), (9, "x")], "g bigint, name string")
    left = df.withColumn("g", F.when(F.col("i") > 0, F.col("g")))
    assert skew.hot_keys(left, ["g"])
    for how in ("inner", "left"):
        assert sorted(map(str, skew.join_hot(left, right, "g", how=how).collect())) == sorted(map(str, left.join(right, "g", how).collect()))


def test_lru():
    lru = cache.LRUCache(2)
    lru.put("a", 1), lru.put("b", 2)
    assert lru.get("a") == 1
    lru.put("c", 3)
    assert lru.get("b") is None and lru.get("a") == 1 and lru.get("c") == 3
    with pytest.raises(ValueError):
        cache.LRUCache(0)


def test_replay(spark, tmp_path):
    log = spark.createDataFrame([(1, "a b"), (2, "B a"), (3, "c"), (4, "d"), (5, "a b"), (6, None), (7, "")], "n bigint, query string")
    got = {r.n: r.cached for r in cache.replay(log, "n", capacity=2).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}
    rng = random.Random(8)
    rows = [(i, rng.choice("abcdefghij" * 3 + "klmnopqrst")) for i in range(3000)]
    for capacity in (1, 3, 12, 100):
        one_cache, want = cache.LRUCache(capacity), {}
        for i, k in rows:
            want[i] = one_cache.get(k) is not None
            one_cache.put(k, True)
        long = spark.createDataFrame(rows, "n bigint, query string").repartition(5)
        assert {r.n: r.cached for r in cache.replay(long, "n", capacity=capacity).collect()} == want
    with pytest.raises(ValueError):
        cache.replay(log, "n", capacity=0)
    log.write.parquet(str(tmp_path / "in"))
    stream = cache.replay_stream(spark.readStream.schema("n bigint, query string").parquet(str(tmp_path / "in")), capacity=64, shards=1)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 7 and sum(r.cached for r in rows) == 3


@pytest.fixture(scope="module")
def engine(spark, built):
    docs, postings, lexicon, pages = built
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "doc_id bigint, embedding array<float>")
    encoder = lambda: lambda texts: [[0.0, 1.0] if "dog" in t else [1.0, 0.0] for t in texts]
    return Engine(postings, lexicon, pages, docs.where("text is not null").select("doc_id", "text"), vectors, encoder, lambda: lambda pairs: [len(t) for _, t in pairs])


def test_engine(engine):
    first = engine.search("Cat dog", 0, 10, 8)
    assert first["count"] == 2 and not first["cached"] and [h["rank"] for h in first["data"]] == [1, 2] and first["data"][0]["url"] == "u0"
    assert first["data"][0]["freqs"] == [["cat", 2], ["dog", 1]]
    jobs = engine.postings.sparkSession.sparkContext.statusTracker()
    began = len(jobs.getJobIdsForGroup())
    again = engine.search("dog cat", 0, 10, 8)
    assert again["cached"] and again["data"] == first["data"] and len(jobs.getJobIdsForGroup()) == began  # no job
    assert engine.search("zzzz", 1)["count"] == 0
    assert [h["url"] for h in engine.search("cat", 2)["data"]] == ["u0", "u1"]  # a page without the word is dropped
    assert [h["url"] for h in engine.search("cat", 3)["data"]] == ["u0", "u1"]
    for bad in ({"n_results": 0}, {"snippet_len": 0}):
        with pytest.raises(ValueError):
            engine.search("cat", 0, **bad)


def test_http(engine):
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/"
    assert b"<form" in urllib.request.urlopen(url).read()
    post = lambda body: json.loads(urllib.request.urlopen(urllib.request.Request(url, body)).read())
    ok = {"query": "bird", "query_type": 1, "n_results": 3, "snippet_len": 20}
    assert post(json.dumps(ok).encode())["count"] == 1
    for bad in (b"no json", b"[]", json.dumps(ok | {"query_type": "x"}).encode(), json.dumps(ok | {"n_results": 0}).encode()):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(bad)
        assert e.value.code == 400
    server.shutdown()


def test_answers_leave_nothing_cached(spark, engine):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    rows = [(json.dumps({"query": q, "query_type": t, "n_results": n, "snippet_len": 10 + n}),) for q in ("cat", "dog cat", "zzz") for t in (0, 1, 2, 3) for n in range(1, 10)]
    got = {r.value: json.loads(r.response) for r in engine.answer(spark.createDataFrame(rows, "value string")).collect()}
    assert len(got) == len(rows) == 108 and held() == before
    for (value,) in rows:
        r = json.loads(value)
        assert len(got[value].get("data") or []) <= r["n_results"]
    one_ = got[rows[8][0]]
    alone = engine.search("cat", 0, 9, 19)
    assert one_["count"] == alone["count"] == 3 and [(h["rank"], h["score"], h["url"], h["snippet"]) for h in one_["data"]] == [(h["rank"], h["score"], h["url"], h["snippet"]) for h in alone["data"]]
    assert one_["data"][0]["freqs"] == [{"term": "cat", "freq": 2}]


def test_request_stream(spark, engine, tmp_path):
    rows = [(json.dumps({"query": q, "query_type": 1, "n_results": 3, "snippet_len": 20}),) for q in ("cat", "bird")] + [("nonsense",)]
    spark.createDataFrame(rows, "value string").write.text(str(tmp_path / "in"))
    answer_stream(engine, spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    got = {r.value: json.loads(r.response) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["nonsense"] == {"message": "missing or mistyped field"} and got[rows[1][0]]["count"] == 1


def test_cli(spark, built, tmp_path, monkeypatch, capsys):
    import io

    built[0].write.parquet(str(tmp_path / "d.parquet"))
    cli.main(["build", str(tmp_path / "d.parquet"), str(tmp_path / "i")])
    monkeypatch.setattr("sys.stdin", io.StringIO("dog\n"))
    cli.main(["search", str(tmp_path / "i"), "-q", "dis", "-n", "2"])
    out = capsys.readouterr().out
    assert "3 hits" in out and "1. [" in out and "dog(1)" in out
    (tmp_path / "q.tsv").write_text("1\tdog\n2\tbird\n3\tnone\n")
    (tmp_path / "r.txt").write_text("1 0\n2 2\n")
    cli.main(["evaluate", str(tmp_path / "i"), str(tmp_path / "q.tsv"), str(tmp_path / "r.txt")])
    assert "of 2 queries" in capsys.readouterr().out
    binary.write_blocks(built[1].withColumn("block_no", F.col("doc_id").cast("int") % 2), str(tmp_path / "blocks"))
    cli.main(["merge", str(tmp_path / "blocks"), str(tmp_path / "merged")])
    assert "4 terms" in capsys.readouterr().out and binary.read_merged(spark, str(tmp_path / "merged"), ["cat"]).count() == 3
    (tmp_path / "d.trec").write_text("".join(f"<DOC>\n<DOCNO>D{i}</DOCNO>\n<TEXT>\nu\nx\n</TEXT>\n</DOC>\n" for i in range(3)))
    (tmp_path / "raw.txt").write_text("7 0 D2 1\n8 0 D9 1\n")
    cli.main(["convert", str(tmp_path / "d.trec"), str(tmp_path / "raw.txt"), str(tmp_path / "conv")])
    assert "1 labels" in capsys.readouterr().out
    assert [tuple(r) for r in files.read_lines(spark, str(tmp_path / "conv"), "qid bigint, doc_id bigint").collect()] == [(7, 2)]
    built[0].select("doc_id", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding")).write.parquet(str(tmp_path / "v.parquet"))
    (tmp_path / "models_for_test.py").write_text("def encoder():\n    return lambda texts: [[1.0, 0.0] for _ in texts]\n\n\ndef scorer():\n    return lambda pairs: [len(t) for _, t in pairs]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr("sys.stdin", io.StringIO("cat\n"))
    cli.main(["search", str(tmp_path / "i"), "-q", "rer", "--embeddings", str(tmp_path / "v.parquet"), "--encoder", "models_for_test:encoder", "--scorer", "models_for_test:scorer"])
    assert "1. [11.00]" in capsys.readouterr().out
    for bad in (["search", "x", "-q", "zzz"], ["search", "x", "-n", "0"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_pushdown(spark, built, tmp_path):
    """Reading a posting list touches the named columns and row groups of its term only."""
    index.write_index(built[0], str(tmp_path / "i"))
    parts = index.read_index(spark, str(tmp_path / "i"))
    asked = queries(spark, [(1, "cat bird")])
    df = retrieve.search(asked, parts["postings"], parts["lexicon"], parts["page_table"], True)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "In(term, [bird,cat])" in plan or "In(term, [cat,bird])" in plan


