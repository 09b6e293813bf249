"""The registered queries over the driver's tables, and SQL for those that SQL can express.

Keyword retrieval runs over the given index (postings, lexicon, page_table); index building runs over documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import present
from lodestone.functions.scoring import idf
from lodestone.functions.text import LOWER, TOKEN, TOKEN_CLASS, UPPER, ascii_lower, query_terms, tokens
from lodestone.operators import evaluate, index, ordinal, retrieve, vector
from lodestone.service import response_data, responses
from lodestone.session import shared_path, table
from lodestone.sources import binary, files
from lodestone.streaming import cache

Query = Callable[[SparkSession, str], DataFrame]
#: Words that the highlighting query marks, and requests and prefixes that the checks see.
MARKED = ["how", "cost", "known", "prix", "kosten"]
REQUESTS = [
    '{"query":"a cat","query_type":0,"n_results":10,"snippet_len":200}', '{"query":"a","query_type":1,"n_results":0,"snippet_len":200}', '{"query":"a","query_type":1,"n_results":5,"snippet_len":-1}',
    '{"query":"a","query_type":"x","n_results":5,"snippet_len":9}', '{"query":"a"}', "not json", '{"query":"","query_type":3,"n_results":1,"snippet_len":1}',
]
PREFIXES = ["con", "d", "r", "x", "", "semantic", "conjunctively"]
MICROS = [0, 7, 999, 1000, 1500, 123456]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "url", "text")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return index.merge_blocks(table(spark, d, "postings"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return index.read_page_table(table(spark, d, "page_table"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # read twice by every search: for the document frequencies and for the lists
    postings = _postings(spark, d).persist()
    return postings, index.lexicon(postings), _pages(spark, d)


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    """The page of the best second-stage passage of every query stands for the human judgement that the tables lack."""
    rows = table(spark, d, "rerank_scores").where("cross_score is not null and not isnan(cross_score)")
    best = rows.groupBy("qid").agg(F.max(F.struct("cross_score", (-F.col("pid")).alias("p"))).alias("b"))
    return best.select("qid", F.expr("-b.p div 64").alias("doc_id"))


def _ranked(spark: SparkSession, d: str, score: str, n: int = 32) -> DataFrame:
    rows = table(spark, d, "rerank_scores").select("qid", "pid", score).where(F.col(score).isNotNull() & ~F.isnan(score))
    rows = rows.groupBy("qid", "pid").agg(F.max(score).alias("score"))
    return retrieve.top_n(rows, n, "qid", "pid").withColumn("doc_id", F.expr("pid div 64"))


def token_counts(spark, d):
    return index.page_table(_docs(spark, d)).select("doc_id", "term_cnt")


def term_freqs(spark, d):
    return index.term_freqs(_docs(spark, d))


def distinct_terms(spark, d):
    return index.token_rows(_docs(spark, d)).select("term").distinct()


def corpus_stats(spark, d):
    return index.corpus_stats(index.page_table(_docs(spark, d))).withColumn("avgdl", F.round("avgdl", 9))


def lexicon_df(spark, d):
    return index.lexicon(index.term_freqs(_docs(spark, d)))


def page_table(spark, d):
    return index.page_table(_docs(spark, d))


def page_table_read(spark, d):
    return _pages(spark, d)


def page_stats(spark, d):
    return index.corpus_stats(_pages(spark, d)).withColumn("avgdl", F.round("avgdl", 9))


def postings_packed(spark, d):
    return files.index_lines(index.term_freqs(_docs(spark, d)), store_diff=False)


def block_merge(spark, d):
    return _postings(spark, d)


def lexicon_merge(spark, d):
    return index.merge_lexicon(table(spark, d, "lexicon"))


def clean_queries(spark, d):
    return retrieve.clean_queries(table(spark, d, "queries")).select("qid", "key", F.size("terms").alias("terms"))


def lexicon_lookup(spark, d):
    known = retrieve.known_terms(table(spark, d, "queries"), index.lexicon(_postings(spark, d)))
    return known


def unknown_terms_ignored(spark, d):
    queries = table(spark, d, "queries")
    known = retrieve.known_terms(queries, index.lexicon(_postings(spark, d))).groupBy("kid").agg(F.count(F.lit(1)).alias("known"))
    rows = retrieve.clean_queries(queries).join(retrieve.query_ids(queries), "qid").join(known, "kid", "left")
    return rows.select("qid", "key", (F.size("terms") - F.coalesce("known", F.lit(0))).cast("bigint").alias("unknown"))


def bm25_disjunctive(spark, d):
    return retrieve.search(table(spark, d, "queries"), *_index(spark, d), conjunctive=False)


def bm25_conjunctive(spark, d):
    return retrieve.search(table(spark, d, "queries"), *_index(spark, d), conjunctive=True)


def hit_freqs(spark, d):
    queries, (postings, lexicon, pages) = table(spark, d, "queries"), _index(spark, d)
    hits = retrieve.hit_freqs(retrieve.search(queries, postings, lexicon, pages, conjunctive=True), queries, postings)
    return hits.select("qid", "doc_id", F.array_join(F.transform("freqs", lambda x: F.concat_ws(":", x["term"], x["freq"].cast("string"))), " ").alias("freqs"))


def hit_counts_and(spark, d):
    postings, lexicon, _ = _index(spark, d)
    return retrieve.hit_counts(table(spark, d, "queries"), postings, lexicon, conjunctive=True)


def hit_counts_or(spark, d):
    postings, lexicon, _ = _index(spark, d)
    return retrieve.hit_counts(table(spark, d, "queries"), postings, lexicon, conjunctive=False)


def intersect_docs(spark, d):
    postings, lexicon, _ = _index(spark, d)
    return retrieve.matches(table(spark, d, "queries"), postings, lexicon, conjunctive=True)


def union_docs(spark, d):
    postings, lexicon, _ = _index(spark, d)
    return retrieve.matches(table(spark, d, "queries"), postings, lexicon, conjunctive=False)


def idf_table(spark, d):
    n = index.corpus_stats(_pages(spark, d)).select("n")
    lex = index.lexicon(_postings(spark, d)).join(F.broadcast(n))  # one row
    return lex.select("term", "doc_cnt", F.round(idf(F.col("n"), F.col("doc_cnt")), 9).alias("idf"))


def negative_idf_terms(spark, d):
    return idf_table(spark, d).where("idf < 0")


def delta_encode(spark, d):
    return files.index_lines(_postings(spark, d)).select("term", "block", F.col("ids").alias("deltas"))


def delta_roundtrip(spark, d):
    return files.parse_index_lines(files.index_lines(_postings(spark, d)))


def vbyte_sizes(spark, d):
    return index.index_sizes(_postings(spark, d))


def compression_ratio(spark, d):
    sizes = vbyte_sizes(spark, d).agg(*(F.sum(c).alias(c) for c in ("raw_bytes", "delta_bytes", "id_bytes", "freq_bytes")))
    return sizes.select(*(F.round(F.col(c) / F.col("raw_bytes"), 9).alias(c.replace("bytes", "ratio")) for c in ("delta_bytes", "id_bytes", "freq_bytes")))


def vbyte_bytes(spark, d):
    return files.index_bytes(_postings(spark, d)).select("term", "block", "doc_cnt", F.hex("ids").alias("ids"), F.hex("freqs").alias("freqs"))


def vbyte_roundtrip(spark, d):
    return files.parse_index_bytes(files.index_bytes(_postings(spark, d)))


def byte_offsets(spark, d):
    docs = _docs(spark, d).where("doc_id is not null")
    rows = ordinal.running_total(docs, ["doc_id"], F.octet_length("text"), "begin_pos")
    return rows.select("doc_id", "begin_pos", (F.col("begin_pos") + F.coalesce(F.octet_length("text"), F.lit(0))).alias("end_pos"))


def cosine_topk(spark, d):
    return vector.top_k(table(spark, d, "question_embeddings"), table(spark, d, "corpus_embeddings"), "qid", "corpus_id", 32, dim=384)


def dot_topk(spark, d):
    return vector.top_k(table(spark, d, "question_embeddings"), table(spark, d, "corpus_embeddings"), "qid", "corpus_id", 32, dim=384, normalise=False)


def semantic_docs(spark, d):
    ids = table(spark, d, "corpus_embeddings").groupBy(F.col("corpus_id").alias("item")).agg(F.max("doc_id").alias("doc_id"))
    return cosine_topk(spark, d).where("rank <= 10").join(ids, "item").select("qid", "rank", "doc_id", "score")


def saved_results_top(spark, d):
    rows = table(spark, d, "semantic_search_results").where("qid is not null and pid is not null and score is not null and not isnan(score)")
    return retrieve.top_n(rows.groupBy("qid", "pid").agg(F.max("score").alias("score")), 32, "qid", "pid")


def rerank_topk(spark, d):
    first = _ranked(spark, d, "cos_score")
    second = table(spark, d, "rerank_scores").groupBy("qid", "pid").agg(F.max(F.when(~F.isnan("cross_score"), F.col("cross_score"))).alias("cross_score"))
    pairs = first.join(second, ["qid", "pid"])
    return vector.rerank(pairs, "cross_score").select("qid", "pid", "rank", "score", "rank2", "score2")


def qrels_best(spark, d):
    return evaluate.one_label(_qrels(spark, d))


def reciprocal_rank(spark, d):
    return evaluate.reciprocal_ranks(_ranked(spark, d, "bm25_score"), _qrels(spark, d)).withColumn("rr", F.round("rr", 9))


def mrr_and(spark, d):
    return evaluate.mrr(bm25_conjunctive(spark, d), _qrels(spark, d))


def mrr_or(spark, d):
    return evaluate.mrr(bm25_disjunctive(spark, d), _qrels(spark, d))


def mrr_vector(spark, d):
    return evaluate.mrr(saved_results_top(spark, d).withColumn("doc_id", F.expr("pid div 64")), _qrels(spark, d))


def mrr_stages(spark, d):
    parts = [evaluate.mrr(_ranked(spark, d, s), _qrels(spark, d)).withColumn("stage", F.lit(s)) for s in ("bm25_score", "cos_score", "cross_score")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The body of the latest record of every page that has one."""
    docs = table(spark, d, "msmarco_docs").where("body is not null").groupBy(F.col("id").alias("docno")).agg(F.max(F.struct("crawl_ts", "body")).alias("r"))
    return _pages(spark, d).select("docno", "doc_id").join(docs, "docno").select("doc_id", F.col("r.body").alias("text"))


def _answered(spark: SparkSession, d: str) -> DataFrame:
    queries, (postings, lexicon, pages) = table(spark, d, "queries"), _index(spark, d)
    hits = retrieve.search(queries, postings, lexicon, pages, conjunctive=True)
    return response_data(hits, pages, _texts(spark, d), queries, postings=postings)


def _freq_text(sep: str, end: str) -> Column:
    return F.array_join(F.transform("freqs", lambda x: F.concat(x["term"], F.lit(sep), x["freq"].cast("string"), F.lit(end))), " ")


def snippets(spark, d):
    return _answered(spark, d).withColumn("freqs", _freq_text(":", ""))


def response_json(spark, d):
    return responses(_answered(spark, d), hit_counts_and(spark, d))


def response_items(spark, d):
    """What a client reads from the JSON of every answer."""
    item = "struct<rank: int, score: double, freqs: array<struct<term: string, freq: bigint>>, url: string, snippet: string>"
    rows = response_json(spark, d).select("qid", F.from_json("response", f"cached boolean, count bigint, data array<{item}>").alias("r"))
    rows = rows.select("qid", "r.cached", "r.count", F.explode_outer("r.data").alias("x")).select("qid", "cached", "count", "x.rank", "x.score", "x.freqs", "x.url", "x.snippet")
    return rows.withColumn("freqs", _freq_text(":", ""))


def cli_lines(spark, d):
    rows = _answered(spark, d)
    return rows.select("qid", "rank", present.cli_line(F.col("rank"), F.round("score", 2), F.col("freqs"), F.col("url"), F.col("snippet")).alias("line"))


def highlight(spark, d):
    docs = table(spark, d, "msmarco_docs").where("title is not null").select("id", "title").distinct()
    return docs.select("id", "title", present.highlight(F.col("title"), MARKED).alias("marked"))


def request_validation(spark, d):
    rows = spark.createDataFrame([(r,) for r in REQUESTS], "value string")
    return rows.select("value", present.request_error(present.parse_request(F.col("value"))).alias("message"))


def mode_prefix(spark, d):
    return spark.createDataFrame([(p,) for p in PREFIXES], "prefix string").select("prefix", present.mode_of(F.col("prefix")).alias("mode"))


def elapsed_text(spark, d):
    return spark.createDataFrame([(m,) for m in MICROS], "micros bigint").select("micros", present.elapsed(F.col("micros")).alias("shown"))


def nonempty_corpus_map(spark, d):
    return files.corpus_map(table(spark, d, "documents"))


def docno_ordinals(spark, d):
    return files.docno_ordinals(_pages(spark, d))


def qrels_convert(spark, d):
    """Raw qrels lines made from the judgements, one line in five with a docno that no page has."""
    rows = _qrels(spark, d).join(_pages(spark, d).select("doc_id", "docno"), "doc_id", "left")
    docno = F.when(F.col("qid") % 5 == 0, F.concat(F.lit("X"), "docno")).otherwise(F.col("docno"))
    lines = rows.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.coalesce(docno, F.lit("none")), F.lit("1")).alias("value"))
    return files.convert_qrels(files.parse_qrels(lines), files.docno_ordinals(_pages(spark, d)), strict=False)


def type_histogram(spark, d):
    kind = F.when(F.col("body").isNull(), "void").when(F.col("body") == "", "empty").otherwise(F.typeof("body"))
    return table(spark, d, "msmarco_docs").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def valid_utf8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.is_valid_utf8("text"), F.lit(True)).alias("valid"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))


def token_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(tokens(F.coalesce("text", F.lit(""))), 1, 256), " ").alias("head"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "msmarco_docs").where("id is not null").groupBy("id").agg(F.max(F.struct("crawl_ts", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("body", F.lit("")).alias("body"))).alias("r"))
    return docs.select("id", "r.url", "r.body")


def trec_scan(spark, d):
    """Every page as a TREC record and back; bodies with a closing tag of their own don't occur."""
    docs = table(spark, d, "msmarco_docs").where("id is not null").select("id", "url", "body").distinct()
    lines = docs.select(files.trec_record(F.col("id"), F.col("url"), F.col("body")).alias("value"))
    return files.parse_trec(lines.withColumn("value", F.regexp_replace("value", "</DOC>\n$", "")))


def _trec_files(spark: SparkSession, d: str, compression: str) -> DataFrame:
    """The latest records in the order of their ids, written to several TREC files and numbered by reading these."""
    path = shared_path(spark, "trec")
    rows = _latest(spark, d).repartitionByRange(7, "id").sortWithinPartitions("id")
    # the line's own end takes the place of the record's
    rows.select(F.regexp_replace(files.trec_record(F.col("id"), F.col("url"), F.col("body")), "\n$", "")).write.option("compression", compression).text(path)
    return files.read_trec_ordered(spark, path)


def trec_files_plain(spark, d):
    return _trec_files(spark, d, "none")


def trec_files_gzip(spark, d):
    return _trec_files(spark, d, "gzip")


def index_text_files(spark, d):
    path = shared_path(spark, "text-index")
    files.write_index_text(index.term_freqs(_docs(spark, d)), path)
    return files.read_index_text(spark, path)


def _merged(spark: SparkSession, d: str, codec: str, store_diff: bool = True, partitions: int | None = None) -> tuple[str, DataFrame]:
    path = shared_path(spark, codec)
    return path, binary.write_merged(_postings(spark, d), path, codec, store_diff, partitions)


def merged_bin(spark, d):
    return binary.read_merged(spark, _merged(spark, d, "bin")[0], codec="bin")


def merged_vbyte(spark, d):
    return binary.read_merged(spark, _merged(spark, d, "vbyte")[0])


def merged_vbyte_plain_ids(spark, d):
    return binary.read_merged(spark, _merged(spark, d, "vbyte", False)[0], store_diff=False)


def posting_access_bin(spark, d):
    return binary.read_merged(spark, _merged(spark, d, "bin")[0], MARKED, "bin")


def posting_access_vbyte(spark, d):
    return binary.read_merged(spark, _merged(spark, d, "vbyte")[0], MARKED)


def lexicon_offsets(spark, d):
    return binary.lexicon_lines(_merged(spark, d, "vbyte", partitions=1)[1])


def page_offsets(spark, d):
    pages = table(spark, d, "page_table").where("doc_id is not null").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("url", "term_cnt", "begin_pos", "end_pos")))
    return binary.page_lines(pages, ["doc_id"])


def _block_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "postings").where("doc_id is not null and freq >= 1").withColumn("term", F.trim(ascii_lower(F.col("term"))))
    return rows.where("term is not null and term != '' and not term rlike '\\\\s'").select("term", "doc_id", F.col("freq").cast("bigint").alias("freq"), "block_no")


def blocks_bin(spark, d):
    path = shared_path(spark, "blocks")
    binary.write_blocks(_block_rows(spark, d), path, "bin")
    return binary.read_blocks(spark, path, "bin")


def blocks_vbyte(spark, d):
    path = shared_path(spark, "blocks")
    binary.write_blocks(_block_rows(spark, d), path)
    return binary.read_blocks(spark, path)


def _counting_encoder() -> Callable:
    return lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts]


def _counting_scorer() -> Callable:
    return lambda pairs: [len(q) * 1000 + len(t) for q, t in pairs]


def encoded_texts(spark, d):
    """Every text by a model that counts characters, saved and read again."""
    path = shared_path(spark, "vectors")
    vector.save_vectors(vector.encode_batches(table(spark, d, "documents"), "doc_id", "text", _counting_encoder), path, "doc_id")
    return spark.read.parquet(path).select("doc_id", *(F.col("embedding")[i].cast("bigint").alias(n) for i, n in enumerate(("chars", "es", "blanks"))))


def reranked_texts(spark, d):
    """The hits of all words, put in order by a model of query and text, saved and read again."""
    queries, path = table(spark, d, "queries").where("qid is not null").groupBy("qid").agg(F.max("query").alias("query")), shared_path(spark, "scores")
    first = evaluate.KeywordEvaluator(*_index(spark, d), conjunctive=True)
    ranked = evaluate.RerankEvaluator(first, _texts(spark, d), _counting_scorer).collect_and_rank(queries, 10)
    vector.save_scores(ranked, path)
    return spark.read.parquet(path)


def bm25_strict(spark, d):
    return retrieve.search(table(spark, d, "queries"), *_index(spark, d), conjunctive=True, strict=True)


def mrr_all_labels(spark, d):
    rows = table(spark, d, "rerank_scores").where("cross_score > 0 and not isnan(cross_score)").select("qid", F.expr("pid div 64").alias("doc_id"))
    return evaluate.mrr(_ranked(spark, d, "bm25_score"), rows, all_labels=True)


def highlight_by_query(spark, d):
    """The words of each query marked in the titles of its first hits."""
    titles = _pages(spark, d).select("doc_id", F.col("docno").alias("id")).join(table(spark, d, "msmarco_docs").where("title is not null").groupBy("id").agg(F.max("title").alias("title")), "id")
    rows = bm25_conjunctive(spark, d).where("rank <= 3").join(titles, "doc_id").join(retrieve.clean_queries(table(spark, d, "queries")).select("qid", "key", "terms"), "qid")
    return rows.select("qid", "key", "doc_id", present.highlight(F.col("title"), F.col("terms")).alias("marked"))


def lru_replay(spark, d):
    log = table(spark, d, "queries").where("qid is not null")
    return cache.replay(log, "qid", capacity=100)


def query_log_terms(spark, d):
    rows = table(spark, d, "queries").select(F.explode(query_terms(F.col("query"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("queries"))


ALL: tuple[Query, ...] = (
    token_counts, term_freqs, distinct_terms, corpus_stats, lexicon_df, page_table, page_table_read, page_stats, postings_packed, block_merge, lexicon_merge, clean_queries, lexicon_lookup,
    unknown_terms_ignored, bm25_disjunctive, bm25_conjunctive, hit_freqs, hit_counts_and, hit_counts_or, intersect_docs, union_docs, idf_table, negative_idf_terms, delta_encode,
    delta_roundtrip, vbyte_sizes, compression_ratio, vbyte_bytes, vbyte_roundtrip, byte_offsets, cosine_topk, dot_topk, semantic_docs, saved_results_top, rerank_topk, qrels_best, reciprocal_rank,
    mrr_and, mrr_or, mrr_vector, mrr_stages, snippets, response_json, cli_lines, highlight, request_validation, mode_prefix, elapsed_text, nonempty_corpus_map, docno_ordinals, qrels_convert,
    type_histogram, valid_utf8, token_truncation, trec_scan, lru_replay, query_log_terms, response_items, trec_files_plain, trec_files_gzip, index_text_files, merged_bin, merged_vbyte, merged_vbyte_plain_ids,
    posting_access_bin, posting_access_vbyte, lexicon_offsets, page_offsets, blocks_bin, blocks_vbyte, encoded_texts, reranked_texts, bm25_strict, mrr_all_labels, highlight_by_query,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def _tok(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TOKEN}')"


_TOKENS = f"tok as (select doc_id, unnest({_tok('text')}) as term from documents)"
_FREQS = f"{_TOKENS}, tf as (select term, doc_id, count(*)::int as freq from tok group by 1, 2)"
_PAGES_BUILT = f"pt as (select doc_id, url, coalesce(len({_tok('text')}), 0)::int as term_cnt from documents)"
_POST = """raw as (select distinct term, doc_id, freq, block_no from postings where term is not null and term <> '' and doc_id is not null and freq >= 1),
post as (select term, doc_id, sum(freq)::bigint as freq from raw group by 1, 2), lex as (select term, count(*) as doc_cnt from post group by 1),
pg as (select doc_id, max(docno) as docno, max(url) as url, coalesce(max(term_cnt), 0) as term_cnt from page_table where doc_id is not null group by 1),
st as (select count(*)::double as n, sum(term_cnt)::double / count(*) as a from pg)"""
_QUERIES = f"""q0 as (select distinct qid, list_sort(list_distinct({_tok("coalesce(query, '')")})) as terms from queries where qid is not null),
q as (select qid, terms, array_to_string(terms, ' ') as txt, min(qid) over (partition by array_to_string(terms, ' ')) as key from q0), qt as (select distinct key, unnest(terms) as term from q),
known as (select key, qt.term, doc_cnt from qt join lex on qt.term = lex.term), nk as (select key, count(*) as n from known group by 1)"""
_SCORE = "round(sum(ln((st.n - doc_cnt + 0.5::double) / (doc_cnt + 0.5::double)) * m.freq * 1.9::double / (m.freq + 0.9::double * (0.6::double + 0.4::double * term_cnt / st.a)) order by m.term), 9)"


def _matched(both: bool) -> str:
    keep = " qualify count(*) over (partition by known.key, post.doc_id) = any_value(nk.n) over (partition by known.key)" if both else ""
    return f"m as (select known.key, post.doc_id, known.term, known.doc_cnt, post.freq from known join post on known.term = post.term join nk on nk.key = known.key{keep})"


def _search(both: bool, n: int = 10) -> str:
    return f"""with {_POST}, {_QUERIES}, {_matched(both)},
s as (select key, m.doc_id, {_SCORE} as score from m join pg on m.doc_id = pg.doc_id, st group by key, m.doc_id),
h as (select *, row_number() over (partition by key order by score desc, doc_id)::int as rank from s qualify rank <= {n}),
hits as (select qid, rank, doc_id, score from q join h on q.key = h.key)"""


_GOOD = "{v} is not null and len({v}) = 384 and not list_contains({v}, 'nan'::float) and len(list_filter({v}, lambda x: x <> 0)) > 0"
_VECTORS = f"""qv as (select qid, max(embedding) as e from question_embeddings where qid is not null and {_GOOD.format(v='embedding')} group by 1),
cv as (select corpus_id as item, max(doc_id) as doc_id, max(embedding) as e from corpus_embeddings where corpus_id is not null and {_GOOD.format(v='embedding')} group by 1)"""


def _topk(score: str, k: int = 32) -> str:
    return f"{_VECTORS}, vs as (select qid, item, doc_id, round({score}(qv.e::double[], cv.e::double[]), 6) as score from qv, cv), vr as (select qid, item, doc_id, score, row_number() over (partition by qid order by score desc, item)::int as rank from vs qualify rank <= {k})"


_QRELS = "qr as (select qid, -(max(struct_pack(a := cross_score, b := -pid)).b) // 64 as doc_id from rerank_scores where cross_score is not null and not isnan(cross_score) group by 1)"


def _rank_of(score: str) -> str:
    return f"(select qid, pid, pid // 64 as doc_id, max({score}) as score, row_number() over (partition by qid order by max({score}) desc, pid)::int as rank from rerank_scores where {score} is not null and not isnan({score}) group by qid, pid)"


_SAVED = "sv as (select qid, pid, max(score) as score, row_number() over (partition by qid order by max(score) desc, pid)::int as rank from semantic_search_results where qid is not null and pid is not null and score is not null and not isnan(score) group by 1, 2 qualify rank <= 32)"


def _rr(hits: str) -> str:
    return f"rr as (select qr.qid, coalesce(1.0::double / min(h.rank), 0) as rr from qr left join (select * from {hits} where rank <= 10) as h on h.qid = qr.qid and h.doc_id = qr.doc_id group by qr.qid)"


_MRR = "select count(*) as queries, round(avg(rr), 9) as mrr from rr"


def _vsize(v: str) -> str:
    return f"case when {v} < 128 then 1 when {v} < 16384 then 2 when {v} < 2097152 then 3 when {v} < 268435456 then 4 else 5 end"


_BLOCK_GAPS = "bg as (select *, doc_id // 1048576 as block, doc_id - coalesce(lag(doc_id) over (partition by term, doc_id // 1048576 order by doc_id), 0) as gap from post)"
_GAPS = f"g as (select *, doc_id - coalesce(lag(doc_id) over (partition by term order by doc_id), 0) as gap from post)"
_SIZES = f"sz as (select term, count(*) as doc_cnt, sum({_vsize('gap')})::bigint as delta_bytes, sum({_vsize('doc_id')})::bigint as id_bytes, sum({_vsize('freq')})::bigint as freq_bytes, 4 * count(*) as raw_bytes from g group by 1)"


def _vhex(v: str) -> str:
    return f"array_to_string(list_transform(range({_vsize(v)}), lambda i: printf('%02X', (({v} >> (7 * i)) & 127) + case when i = {_vsize(v)} - 1 then 128 else 0 end)), '')"


_HEAD = _tok("coalesce(text, '')")


def _values(rows: list, name: str) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(values {', '.join(f'({quote(r)})' for r in rows)}) as t({name})"


#: One character that is no part of a token.
_PART = TOKEN_CLASS.replace("[", "[^", 1)


def _counts() -> str:
    return "hc as (select q.key, coalesce(max(c.hits), 0) as hits from q left join (select key, count(distinct doc_id) as hits from m group by 1) as c on q.key = c.key group by 1)"


def _snippets(length: int = 200) -> str:
    """Hits with freqs and the snippet by bytes: text as pairs of hexadecimal digits."""
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    half = length // 2
    return f"""{_search(True)}, tx as (select doc_id, max(struct_pack(a := crawl_ts, b := body)).b as text from pg join msmarco_docs on id = docno where body is not null group by 1),
ht as (select hits.*, pg.url, tx.text, q.terms from hits join (select distinct qid, terms from q) as q on q.qid = hits.qid join pg on pg.doc_id = hits.doc_id join tx on tx.doc_id = hits.doc_id),
an as (select *, list_filter(terms, lambda t: list_contains(toks, t))[1] as anchor from (select *, regexp_extract_all({low}, '{TOKEN}') as toks from ht)),
po as (select *, strlen(regexp_extract({low}, '(?s)^((?:.*?{_PART})??)' || anchor || '(?:{_PART}.*)?$', 1)) as pos, strlen(text) as size, hex(encode(text)) as data from an where anchor is not null),
wi as (select *, greatest(pos - {half}, 0) as b0, least(pos + {half}, size) as e0 from po),
ed as (select *, length(regexp_extract(data[1 : 2 * b0 + 2], '((?:[89A-F][0-9A-F])+)$', 1)) // 2 as back, length(regexp_extract(data[2 * e0 + 1 :], '^((?:[89A-F][0-9A-F])*)', 1)) // 2 as run from wi),
fr as (select qid, doc_id, string_agg(term || ':' || freq, ' ' order by term) as freqs, string_agg(term || '(' || freq || ')', ' ' order by term) as shown from (select distinct hits.qid, hits.doc_id, post.term, post.freq from hits join (select distinct qid, unnest(terms) as term from q) as u on hits.qid = u.qid join post on post.term = u.term and post.doc_id = hits.doc_id) group by 1, 2),
sn as (select ed.qid, rank, ed.doc_id, score, fr.freqs, fr.shown, url, decode(unhex(data[2 * greatest(b0 - back, 0) + 1 : 2 * (e0 + run + case when run > 0 and e0 + run + 1 < size then 1 else 0 end)])) as snippet from ed join fr on fr.qid = ed.qid and fr.doc_id = ed.doc_id)"""


_BLOCK_ROWS = f"br as (select trim(translate(term, '{UPPER}', '{LOWER}'), ' ') as term, doc_id, freq::bigint as freq, block_no from postings where doc_id is not null and freq >= 1 and term is not null)"
_BLOCKS = f"with {_BLOCK_ROWS} select * from br where term <> '' and not regexp_matches(term, '\\s')"


def oracle_sql() -> dict[str, str]:
    marked = ", ".join(f"'{w}'" for w in MARKED)
    stages = " union all ".join(f"(with {_QRELS}, {_rr(_rank_of(s))} select count(*) as queries, round(avg(rr), 9) as mrr, '{s}' as stage from rr)" for s in ("bm25_score", "cos_score", "cross_score"))
    return {
        "token_counts": f"with {_PAGES_BUILT} select doc_id, term_cnt from pt",
        "term_freqs": f"with {_FREQS} select * from tf",
        "distinct_terms": f"with {_TOKENS} select distinct term from tok",
        "corpus_stats": f"with {_PAGES_BUILT} select count(*) as n, sum(term_cnt)::bigint as total_terms, round(sum(term_cnt)::double / count(*), 9) as avgdl from pt",
        "lexicon_df": f"with {_FREQS} select term, count(*) as doc_cnt from tf group by 1",
        "page_table": f"with {_PAGES_BUILT} select * from pt",
        "page_table_read": f"with {_POST} select * from pg",
        "page_stats": f"with {_POST} select count(*) as n, sum(term_cnt)::bigint as total_terms, round(sum(term_cnt)::double / count(*), 9) as avgdl from pg",
        "postings_packed": f"with {_FREQS} select term, doc_id // 1048576 as block, string_agg(doc_id::varchar, ' ' order by doc_id) as ids, string_agg(freq::varchar, ' ' order by doc_id) as freqs from tf group by 1, 2",
        "block_merge": f"with {_POST} select * from post",
        "lexicon_merge": "select term, coalesce(sum(doc_cnt), 0)::bigint as doc_cnt from (select distinct * from lexicon where term is not null and term <> '') group by 1",
        "clean_queries": f"with {_POST}, {_QUERIES} select qid, txt as key, len(terms)::int as terms from q",
        "lexicon_lookup": f"with {_POST}, {_QUERIES} select key as kid, term, doc_cnt from known",
        "unknown_terms_ignored": f"with {_POST}, {_QUERIES} select qid, txt as key, len(terms) - coalesce(nk.n, 0) as unknown from q left join nk on q.key = nk.key",
        "bm25_disjunctive": f"{_search(False)} select * from hits",
        "bm25_conjunctive": f"{_search(True)} select * from hits",
        "hit_freqs": f"{_search(True)}, u as (select distinct qid, unnest(terms) as term from q) select hits.qid, hits.doc_id, string_agg(post.term || ':' || post.freq, ' ' order by post.term) as freqs from hits join u on hits.qid = u.qid join post on post.term = u.term and post.doc_id = hits.doc_id group by 1, 2",
        "hit_counts_and": f"with {_POST}, {_QUERIES}, {_matched(True)}, c as (select key, count(distinct doc_id) as hits from m group by 1) select qid, coalesce(hits, 0) as hits from q left join c on q.key = c.key",
        "hit_counts_or": f"with {_POST}, {_QUERIES}, {_matched(False)}, c as (select key, count(distinct doc_id) as hits from m group by 1) select qid, coalesce(hits, 0) as hits from q left join c on q.key = c.key",
        "intersect_docs": f"with {_POST}, {_QUERIES}, {_matched(True)} select distinct key as kid, doc_id from m",
        "union_docs": f"with {_POST}, {_QUERIES}, {_matched(False)} select distinct key as kid, doc_id from m",
        "idf_table": f"with {_POST} select term, doc_cnt, round(ln((n - doc_cnt + 0.5::double) / (doc_cnt + 0.5::double)), 9) as idf from lex, st",
        "negative_idf_terms": f"with {_POST} select term, doc_cnt, round(ln((n - doc_cnt + 0.5::double) / (doc_cnt + 0.5::double)), 9) as idf from lex, st where idf < 0",
        "delta_encode": f"with {_POST}, {_BLOCK_GAPS} select term, block, string_agg(gap::varchar, ' ' order by doc_id) as deltas from bg group by 1, 2",
        "delta_roundtrip": f"with {_POST} select * from post",
        "vbyte_sizes": f"with {_POST}, {_GAPS}, {_SIZES} select * from sz",
        "compression_ratio": f"with {_POST}, {_GAPS}, {_SIZES} select round(sum(delta_bytes) / sum(raw_bytes), 9) as delta_ratio, round(sum(id_bytes) / sum(raw_bytes), 9) as id_ratio, round(sum(freq_bytes) / sum(raw_bytes), 9) as freq_ratio from sz",
        "vbyte_bytes": f"with {_POST}, {_BLOCK_GAPS} select term, block, count(*) as doc_cnt, string_agg({_vhex('gap')}, '' order by doc_id) as ids, string_agg({_vhex('freq')}, '' order by doc_id) as freqs from bg group by 1, 2",
        "vbyte_roundtrip": f"with {_POST} select * from post",
        "byte_offsets": "select doc_id, (sum(b) over (order by doc_id) - b)::bigint as begin_pos, (sum(b) over (order by doc_id))::bigint as end_pos from (select doc_id, coalesce(strlen(text), 0) as b from documents)",
        "cosine_topk": f"with {_topk('list_cosine_similarity')} select qid, rank, item, score from vr",
        "dot_topk": f"with {_topk('list_dot_product')} select qid, rank, item, score from vr",
        "semantic_docs": f"with {_topk('list_cosine_similarity', 10)} select qid, rank, doc_id, score from vr",
        "saved_results_top": f"with {_SAVED} select qid, pid, score, rank from sv",
        "rerank_topk": f"""with f as (select * from {_rank_of('cos_score')} where rank <= 32), x as (select qid, pid, max(case when not isnan(cross_score) then cross_score end) as score2 from rerank_scores group by 1, 2)
select f.qid, f.pid, rank, score, row_number() over (partition by f.qid order by score2 desc nulls last, rank)::int as rank2, score2 from f join x on f.qid = x.qid and f.pid = x.pid""",
        "qrels_best": f"with {_QRELS} select * from qr where qid is not null",
        "reciprocal_rank": f"with {_QRELS}, {_rr(_rank_of('bm25_score'))} select qid, round(rr, 9) as rr from rr",
        "mrr_and": f"{_search(True)}, {_QRELS}, {_rr('hits')} {_MRR}",
        "mrr_or": f"{_search(False)}, {_QRELS}, {_rr('hits')} {_MRR}",
        "mrr_vector": f"with {_SAVED}, {_QRELS}, svd as (select *, pid // 64 as doc_id from sv), {_rr('svd')} {_MRR}",
        "mrr_stages": stages,
        "snippets": f"{_snippets()} select qid, rank, doc_id, score, freqs, url, snippet from sn",
        "response_items": f"{_snippets()}, {_counts()} select q.qid, false as cached, case when sn.qid is null then 0 else hits end as count, rank, score, freqs, url, snippet from q join hc on q.key = hc.key left join sn on sn.qid = q.qid",
        "cli_lines": f"{_snippets()} select qid, rank, printf('%d. [%.2f] ', rank, round(score, 2) + 0.0::double) || shown || ' ' || chr(10) || coalesce(url, '') || chr(10) || '...' || snippet || '...' as line from sn",
        "highlight": f"select id, title, array_to_string(list_transform(regexp_extract_all(title, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: case when lower(x) in ({marked}) then '<b>' || x || '</b>' else x end), '') as marked from (select distinct id, title from msmarco_docs where title is not null)",
        "request_validation": f"""select value, case when not json_valid(value) then 'missing or mistyped field' when coalesce(json_type(value, '$.query'), '') <> 'VARCHAR' or coalesce(json_type(value, '$.query_type'), '') not in ('UBIGINT', 'BIGINT') or coalesce(json_type(value, '$.n_results'), '') not in ('UBIGINT', 'BIGINT')
or coalesce(json_type(value, '$.snippet_len'), '') not in ('UBIGINT', 'BIGINT') then 'missing or mistyped field' when (value ->> '$.n_results')::int < 1 then 'n_results must be positive' when (value ->> '$.snippet_len')::int < 1 then 'snippet_len must be positive' end as message from {_values(REQUESTS, 'value')}""",
        "mode_prefix": f"select prefix, coalesce({', '.join(f'case when starts_with({chr(39)}{m}{chr(39)}, prefix) then {chr(39)}{m}{chr(39)} end' for m in present.MODES)}) as mode from {_values(PREFIXES, 'prefix')}",
        "elapsed_text": f"select micros, case when micros < 1000 then printf('%.2f us', micros::double) else printf('%.2f ms', micros / 1000.0::double) end as shown from {_values(MICROS, 'micros')}",
        "nonempty_corpus_map": "select row_number() over (order by doc_id) - 1 as corpus_id, doc_id from documents where text is not null and text <> ''",
        "docno_ordinals": f"with {_POST} select docno, max(doc_id) as doc_id from pg where docno is not null group by 1",
        "qrels_convert": f"with {_POST}, {_QRELS} select qid, case when qid % 5 = 0 or pg.doc_id is null then 0 else pg.doc_id end as doc_id from qr left join pg on qr.doc_id = pg.doc_id",
        "type_histogram": "select case when body is null then 'void' when body = '' then 'empty' else 'string' end as kind, count(*) as n from msmarco_docs group by 1",
        "valid_utf8": "select doc_id, true as valid, coalesce(strlen(text), 0)::int as bytes from documents",
        "token_truncation": f"select doc_id, array_to_string(({_HEAD})[1:256], ' ') as head from documents",
        "trec_scan": "select distinct id as docno, coalesce(url, '') as url, coalesce(body, '') as text, true as valid from msmarco_docs where id is not null",
        **{name: f"with {_POST} select * from post" for name in ("merged_bin", "merged_vbyte", "merged_vbyte_plain_ids")},
        "index_text_files": f"with {_FREQS} select term, doc_id, freq::bigint as freq from tf",
        **{name: f"with {_POST} select * from post where term in ({marked})" for name in ("posting_access_bin", "posting_access_vbyte")},
        **{name: "select row_number() over (order by id) - 1 as doc_id, id as docno, r.b as url, r.c as text from (select id, max(struct_pack(a := crawl_ts, b := coalesce(url, ''), c := coalesce(body, ''))) as r from msmarco_docs where id is not null group by 1)" for name in ("trec_files_plain", "trec_files_gzip")},
        "lexicon_offsets": f"with {_POST}, {_GAPS}, {_SIZES} select term || ' ' || (sum(delta_bytes) over w - delta_bytes)::bigint || ' ' || (sum(freq_bytes) over w - freq_bytes)::bigint || ' ' || doc_cnt as value from sz window w as (order by term)",
        "page_offsets": "select doc_id, coalesce(max(url), '') || ' ' || coalesce(max(term_cnt), 0) || ' ' || coalesce(max(begin_pos), 0) || ' ' || coalesce(max(end_pos), 0) as value from page_table where doc_id is not null group by 1",
        "blocks_bin": _BLOCKS,
        "blocks_vbyte": _BLOCKS,
        "encoded_texts": "select doc_id, length(text) as chars, length(text) - length(replace(text, 'e', '')) as es, length(text) - length(replace(text, ' ', '')) as blanks from documents where text is not null and text <> ''",
        "reranked_texts": f"""{_search(True, 32).replace('from queries where', 'from (select qid, max(query) as query from queries group by 1) where', 1)}, tx as (select doc_id, max(struct_pack(a := crawl_ts, b := body)).b as text from pg join msmarco_docs on id = docno where body is not null group by 1),
rr as (select hits.qid, hits.doc_id, hits.rank as first, (length(coalesce(qq.query, '')) * 1000 + length(tx.text))::double as score from hits join (select qid, max(query) as query from queries group by 1) as qq on qq.qid = hits.qid join tx on tx.doc_id = hits.doc_id)
select qid, doc_id, score from rr qualify row_number() over (partition by qid order by score desc, first) <= 10""",
        "bm25_strict": f"{_search(True)} select distinct hits.* from hits join q on q.qid = hits.qid join nk on nk.key = q.key where nk.n = len(q.terms)",
        "mrr_all_labels": f"with lb as (select distinct qid, pid // 64 as doc_id from rerank_scores where cross_score > 0 and not isnan(cross_score)), h as {_rank_of('bm25_score')}, rr as (select lb.qid, coalesce(1.0::double / min(h.rank), 0) as rr from lb left join (select * from h where rank <= 10) as h on h.qid = lb.qid and h.doc_id = lb.doc_id group by 1) {_MRR}",
        "highlight_by_query": f"{_search(True)}, ti as (select pg.doc_id, max(title) as title from pg join msmarco_docs on id = docno where title is not null group by 1) select hits.qid, txt as key, hits.doc_id, array_to_string(list_transform(regexp_extract_all(title, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: case when list_contains(terms, lower(x)) and regexp_matches(x, '^\\p{{L}}') then '<b>' || x || '</b>' else x end), '') as marked from hits join (select distinct qid, txt, terms from q) as q on q.qid = hits.qid join ti on ti.doc_id = hits.doc_id where rank <= 3",
        "lru_replay": f"""with k as (select qid, array_to_string(list_sort(list_distinct({_tok("coalesce(query, '')")})), ' ') as key from queries where qid is not null),
o as (select *, row_number() over (order by qid, key) as n from k), p as (select *, lag(n) over (partition by key order by n) as prev from o)
select qid, key, prev is not null and (select count(distinct o.key) from o where o.n > p.prev and o.n < p.n) < 100 as cached from p""",
        "query_log_terms": f"select term, count(*) as queries from (select unnest(list_distinct({_tok('query')})) as term from queries) group by 1",
    }
