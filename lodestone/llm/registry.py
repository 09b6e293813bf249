"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import boilerplate, fuse, mixture, neighbours, sentences, split, terms, tokenizer, topn
from lodestone.session import table

SCORES = ["bm25_score", "cos_score", "cross_score"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that the splitter cut."""
    return p1_pieces(spark, d).where("piece_no = 2").select("id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "msmarco_docs"), ["id"], "body")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top(spark, d).select("qid", "pid")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "semantic_search_results"), ["qid"], "pid", "score", 10)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_lines(spark, d).where("not own").select("id", "line_no")


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.label_lines(table(spark, d, "msmarco_docs"))


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "msmarco_docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_nearest(spark, d).select("vec_kind", "vec_id", "corpus_id")


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, d, "corpus_embeddings"), table(spark, d, "question_embeddings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.term_counts(terms.clean_postings(table(spark, d, "postings")))
    return terms.mark_terms(counts, table(spark, d, "page_table")).where("mark is not null").select("term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.term_counts(terms.clean_postings(table(spark, d, "postings")))
    marked = terms.mark_terms(counts, table(spark, d, "page_table"))
    return terms.against_lexicon(marked, table(spark, d, "lexicon")).select("term", "occurrences", "pages", "lexicon_pages", "agrees", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_terms(p6_weights(spark, d)).select("doc_id", "term")


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_weights(table(spark, d, "postings"), table(spark, d, "page_table"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return fuse.majority_winner(p7_ranking(spark, d), "qid", "pid", SCORES)


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fuse.ideal_point_ranking(table(spark, d, "rerank_scores"), "qid", "pid", SCORES)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = tokenizer.decode(tokenizer.encode(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "back")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_spans(table(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "begin_pos", "end_pos")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"), "doc_id", "text")


#: What bench.py times.
HEADLINE = ["p1_pieces", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_mix", "p10_found"]
ALL = (
    p1_found, p1_pieces, p2_found, p2_top, p3_found, p3_lines, p3_main_text, p4_found, p4_nearest, p5_found, p5_counts, p6_found, p6_weights,
    p7_found, p7_ranking, p8_ids, p8_round_trip, p8_spans, p9_mix, p9_shares, p10_found, p10_sentences,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


_CLEAN = """
raw as (select distinct term, doc_id, freq, block_no from postings where term is not null and doc_id is not null and freq >= 1),
cl as (select trim(translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') as term, doc_id, freq from raw),
post as (select term, doc_id, sum(freq)::bigint as freq from cl where not regexp_matches(term, '^\\s*$') group by 1, 2),
cnt as (select term, sum(freq)::bigint as occurrences, count(*) as pages from post group by 1),
n as (select count(distinct doc_id) as n from page_table)"""

_MARK = "case when pages < 3 then 'rare' when pages > 0.25 * n then 'common' end"

_WEIGHTS = f"""with {_CLEAN},
pt as (select doc_id, max(term_cnt) as c from page_table where doc_id is not null group by 1),
sm as (select doc_id, sum(freq) as s from post group by 1),
dl as (select coalesce(pt.doc_id, sm.doc_id) as doc_id, coalesce(c, s, 0)::double as dl, pt.doc_id is not null as listed from pt full join sm on pt.doc_id = sm.doc_id),
st as (select count(*)::double as n, avg(dl) as a from dl where listed),
w as (select post.doc_id, post.term, post.freq, cnt.pages as df,
  round(ln((st.n - cnt.pages + 0.5::double) / (cnt.pages + 0.5::double)) * post.freq * 1.9::double / (post.freq + 0.9::double * (0.6::double + 0.4::double * dl.dl / st.a)), 6) as score
  from post join cnt on post.term = cnt.term join dl on post.doc_id = dl.doc_id, st)"""

_TOP = """with b as (select qid, pid, max(score) as score from semantic_search_results where score is not null and not isnan(score) and qid is not null and pid is not null group by 1, 2)
select {} from b qualify row_number() over (partition by qid order by score desc, pid) <= 10"""

_WINS = " + ".join(f"(x.{s} is not null and (y.{s} is null or x.{s} > y.{s}))::int" for s in SCORES)


def _ideal_point() -> str:
    best = ", ".join(f"max(case when not isnan({s}) then {s} end) as {s}" for s in SCORES)
    ends = ", ".join(f"quantile_disc({s}, 0.05) as l{i}, quantile_disc({s}, 0.95) as h{i}" for i, s in enumerate(SCORES))
    drawn = ", ".join(f"coalesce(least(greatest({s}, l{i}), h{i}), l{i}) as w{i}" for i, s in enumerate(SCORES))
    norms = ", ".join(f"max(w{i}) as hi{i}, min(w{i}) as lo{i}, sqrt(sum(w{i} * w{i})) as n{i}" for i in range(3))
    far = lambda to: "sqrt(" + " + ".join(f"power(coalesce((w{i} - {to}{i}) / nullif(n{i}, 0) / 3, 0), 2)" for i in range(3)) + ")"
    names = ", ".join(SCORES)
    return f"""with r as (select qid, pid, {best} from rerank_scores where qid is not null and pid is not null group by 1, 2), q as (select qid, {ends} from r group by 1),
w as (select r.*, {drawn} from r join q on r.qid = q.qid), n as (select qid, {norms} from w group by 1),
c as (select w.qid, pid, {names}, {far('lo')} as near, {far('hi')} as far from w join n on w.qid = n.qid),
k as (select qid, pid, {names}, round(coalesce(near / nullif(near + far, 0), 0), 9) as closeness from c)
select *, row_number() over (partition by qid order by closeness desc, pid) as rank from k"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "select distinct id from msmarco_docs where length(body) > 2000",
        "p2_found": _TOP.format("qid, pid"),
        "p2_top": _TOP.format("qid, pid, score"),
        "p5_found": f"with {_CLEAN} select term, {_MARK} as mark from cnt, n where {_MARK} is not null",
        "p5_counts": f"""with {_CLEAN},
lx as (select trim(translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') as term, sum(doc_cnt)::bigint as lexicon_pages from (select distinct * from lexicon where term is not null) group by 1)
select cnt.term, occurrences, pages, lexicon_pages, coalesce(lexicon_pages = pages, false) as agrees, {_MARK} as mark from cnt left join lx on cnt.term = lx.term, n""",
        "p6_found": f"{_WEIGHTS} select doc_id, term from w qualify row_number() over (partition by doc_id order by score desc, term) <= 3",
        "p6_weights": f"{_WEIGHTS} select * from w",
        "p7_found": f"""with r as (select qid, pid, {', '.join(f"max(case when not isnan({s}) then {s} end) as {s}" for s in SCORES)} from rerank_scores where qid is not null and pid is not null group by 1, 2)
select qid, pid from r as x where not exists (select 1 from r as y where y.qid = x.qid and y.pid <> x.pid and {_WINS} < 2)""",
        "p7_ranking": _ideal_point(),
        "p8_round_trip": "select doc_id, true as same from documents",
    }
