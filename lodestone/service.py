"""The search service: one engine over an index, with request checking, dispatch, caches, a batch form, HTTP and a CLI."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import present
from lodestone.functions.text import clean_terms, query_terms
from lodestone.operators import retrieve, vector
from lodestone.session import cut, shuffle_partitions
from lodestone.streaming.cache import LRUCache

#: Candidates of the first stage where a second one follows.
CANDIDATES = 32


def response_data(hits: DataFrame, pages: DataFrame, texts: DataFrame, queries: DataFrame, snippet_len: int = 200, postings: DataFrame | None = None) -> DataFrame:
    """(qid, rank, doc_id, score, freqs, url, snippet) of hits whose text holds a term of the query; ranks keep their gaps.

    ``queries`` may have a column snippet_len of their own. ``freqs`` are the (term, freq) of the query in the page, in term
    order, from ``postings``; null without them. A text is read once, whatever the number of queries that found it."""
    if snippet_len < 1:
        raise ValueError("the snippet length must be positive")
    hits = cut(hits)  # n of each query, read several times below
    length = F.col("snippet_len") if "snippet_len" in queries.columns else F.lit(snippet_len)
    asked = queries.where("qid is not null").select("qid", length.cast("int").alias("length"), F.explode(query_terms(F.coalesce("query", F.lit("")))).alias("term")).distinct()
    pairs = cut(hits.select("qid", "doc_id").distinct().join(asked, "qid"))
    wanted = pairs.select("doc_id", "term", "length").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("term", "length")).alias("wanted"))
    # few bytes, but much work for each: the number of tasks must not follow the bytes
    rows = wanted.repartition(shuffle_partitions(hits.sparkSession), "doc_id").join(texts, "doc_id").where("text is not null")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, terms, lengths, found = [], [], [], []
            for doc, want, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for (term, size), s in present.windows(text, [(w["term"], w["length"]) for w in want]).items():
                    for c, v in zip((ids, terms, lengths, found), (doc, term, size, s)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(lengths, pa.int32()), pa.array(found, pa.string())], ["doc_id", "term", "length", "snippet"])

    cuts = rows.select(F.col("doc_id").cast("bigint"), "wanted", "text").mapInArrow(cut_out, "doc_id bigint, term string, length int, snippet string")
    # the first of a query's sorted terms that the text holds decides
    first = pairs.join(cuts, ["doc_id", "term", "length"]).groupBy("qid", "doc_id").agg(F.min_by("snippet", "term").alias("snippet"))
    out = hits.join(first, ["qid", "doc_id"]).join(pages.select("doc_id", "url"), "doc_id", "left")
    if postings is None:
        out = out.withColumn("freqs", F.lit(None).cast("array<struct<term: string, freq: bigint>>"))
    else:
        found = pairs.select("qid", "doc_id", "term").join(postings.select("term", "doc_id", "freq"), ["term", "doc_id"])
        freqs = found.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("freq").cast("bigint").alias("freq")))).alias("freqs"))
        out = out.join(freqs, ["qid", "doc_id"], "left")
    return out.select("qid", "rank", "doc_id", "score", "freqs", "url", "snippet")


def responses(data: DataFrame, counts: DataFrame) -> DataFrame:
    """(qid, response): the JSON of every query of ``counts`` (qid, hits). ``data`` is missing where nothing is found."""
    items = data.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "freqs", "url", "snippet"))).alias("data"))
    rows = counts.join(items, "qid", "left")
    count = F.when(F.col("data").isNull(), F.lit(0)).otherwise(F.col("hits"))
    return rows.select("qid", F.to_json(F.struct(F.lit(False).alias("cached"), count.alias("count"), "data")).alias("response"))


class Engine:
    """Answers requests over an index. ``encoder`` and ``scorer`` are plug-ins: functions that load a model, which encodes a
    list of texts, or scores a list of (query, text)."""

    def __init__(self, postings: DataFrame, lexicon: DataFrame, pages: DataFrame, texts: DataFrame, embeddings: DataFrame | None = None, encoder: Callable[[], Callable] | None = None, scorer: Callable[[], Callable] | None = None, cache: int = 1000) -> None:
        self.postings, self.lexicon, self.pages, self.texts = postings, lexicon, pages, texts
        self.embeddings, self.encoder, self.scorer = embeddings, encoder, scorer
        self.caches = {m: LRUCache(cache) for m in present.MODES}
        self.lock = Lock()

    def hits(self, queries: DataFrame, mode: str, n: int) -> tuple[DataFrame, DataFrame]:
        """The hits (qid, rank, doc_id, score) and the numbers of all matches (qid, hits) of a batch of queries."""
        if n < 1:
            raise ValueError("n_results must be positive")
        if mode in ("conjunctive", "disjunctive"):
            both = mode == "conjunctive"
            return retrieve.search(queries, self.postings, self.lexicon, self.pages, both, n), retrieve.hit_counts(queries, self.postings, self.lexicon, both)
        if self.embeddings is None or self.encoder is None:
            raise ValueError("vector search needs embeddings and an encoder")
        vectors = vector.encode_batches(queries.where("qid is not null").select("qid", "query").distinct(), "qid", "query", self.encoder)
        found = vector.top_k(vectors, self.embeddings, "qid", "doc_id", CANDIDATES).withColumnRenamed("item", "doc_id")
        if mode == "reranking":
            if self.scorer is None:
                raise ValueError("reranking needs a scorer")
            pairs = found.join(queries.select("qid", "query").distinct(), "qid").join(self.texts, "doc_id")
            ranked = vector.rerank(vector.score_batches(pairs, ["qid", "doc_id", "rank"], "query", "text", self.scorer), "score2")
            found = ranked.select("qid", F.col("rank2").alias("rank"), "doc_id", F.col("score2").alias("score"))
        found = cut(found)  # read for the hits and for their number; CANDIDATES of each query
        return found.where(F.col("rank") <= n), found.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))

    def answer(self, requests: DataFrame) -> DataFrame:
        """(value, response) of every distinct JSON request; a faulty one gets {"message": ...}. One plan for each mode: the
        other settings go along with their queries. The requests are written once and nothing stays cached."""
        rows = requests.select("value").where("value is not null").distinct().withColumn("r", present.parse_request(F.col("value")))
        rows = cut(rows.withColumn("message", present.request_error(F.col("r"))).withColumn("qid", F.xxhash64("value")))
        out = rows.where("message is not null").select("value", F.to_json(F.struct("message")).alias("response"))
        named = F.element_at(F.create_map(*(F.lit(x) for t in range(4) for x in (t, mode_number(t)))), F.col("query_type"))
        sound = rows.where("message is null").select("value", "qid", "r.*")
        sound = sound.withColumn("mode", F.when(F.col("query_type").between(0, 3), named).otherwise("semantic"))
        for mode, n in sound.groupBy("mode").agg(F.max("n_results")).collect():  # four modes at most
            part = sound.where(F.col("mode") == mode)
            hits, counts = self.hits(part.select("qid", "query"), mode, n)
            hits = hits.join(part.select("qid", "n_results"), "qid").where("rank <= n_results").drop("n_results")
            keyword = mode in ("conjunctive", "disjunctive")
            data = response_data(hits, self.pages, self.texts, part.select("qid", "query", "snippet_len"), postings=self.postings if keyword else None)
            counts = part.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"))
            out = out.unionByName(part.join(responses(data, counts), "qid").select("value", "response"))
        return out

    def search(self, query: str, query_type: int = 2, n_results: int = 10, snippet_len: int = 200) -> dict:
        """One answer, from the cache where the same cleaned query (raw for vectors) came before: that costs no job.
        ``freqs`` are pairs [term, number]."""
        began, mode = time.perf_counter(), mode_number(query_type)
        if n_results < 1 or snippet_len < 1:
            raise ValueError("n_results must be positive" if n_results < 1 else "snippet_len must be positive")
        terms = clean_terms(query)
        key = (" ".join(terms) if query_type in (0, 1) else query, n_results, snippet_len)
        with self.lock:
            known = self.caches[mode].get(key)
        cached = known is not None
        if not cached:
            known = self._fresh(query, terms, mode, n_results, snippet_len)
            if known["count"] or mode in ("semantic", "reranking"):
                with self.lock:
                    self.caches[mode].put(key, known)
        return {**known, "cached": cached, "time": (time.perf_counter() - began) * 1e6}

    def _fresh(self, query: str, terms: list[str], mode: str, n: int, length: int) -> dict:
        keyword = mode in ("conjunctive", "disjunctive")
        if keyword:
            count, best = retrieve.answer_one(terms, self.postings, self.lexicon, self.pages, mode == "conjunctive", n) if terms else (0, [])
        else:
            hits, counts = self.hits(self.postings.sparkSession.createDataFrame([(0, query)], "qid bigint, query string"), mode, n)
            best = [(r.doc_id, r.score) for r in hits.orderBy("rank").collect()]
            count = sum(r.hits for r in counts.collect())
        ids = [d for d, _ in best]
        among = F.col("doc_id").isin(ids)
        if not ids:
            return {"count": 0}
        # n pages at most are fetched, by their ids
        urls = {r.doc_id: r.url for r in self.pages.where(among).select("doc_id", "url").collect()}
        texts = {r.doc_id: r.text for r in self.texts.where(among).select("doc_id", "text").collect() if r.text}
        freqs: dict[int, list] = {}
        if keyword:
            for r in self.postings.where(F.col("term").isin(terms) & among).select("doc_id", "term", "freq").collect():
                freqs.setdefault(r.doc_id, []).append([r.term, r.freq])
        data = []
        for rank, (doc, score) in enumerate(best, 1):
            cuts = present.windows(texts[doc], [(t, length) for t in terms]) if doc in texts else {}
            if cuts:
                item = {"rank": rank, "score": score, "url": urls.get(doc), "snippet": next(cuts[t, length] for t in terms if (t, length) in cuts)}
                data.append(item | ({"freqs": sorted(freqs.get(doc, []), key=lambda x: x[0].encode())} if keyword else {}))
        return {"count": count, "data": data} if data else {"count": 0}


def mode_number(query_type: int) -> str:
    """0 all terms, 1 any term, 3 reranking, everything else vectors."""
    return {0: "conjunctive", 1: "disjunctive", 3: "reranking"}.get(query_type, "semantic")


PAGE = r"""<!doctype html><meta charset="utf-8"><title>Search</title><form id="f"><input id="q" autofocus> <select id="t"><option value="0">all words<option value="1">any word<option value="2" selected>semantic<option value="3">reranked</select>
<input id="n" type="number" value="10" min="1"> <input id="l" type="number" value="200" min="1"> <button>Search</button></form><p id="s"></p><ol id="o"></ol>
<script>
const marked=(text,words)=>text.split(/(\p{L}+)/u).map((part,i)=>{if(i%2&&words.has(part.toLowerCase())){const b=document.createElement("b");b.textContent=part;return b}return part});
const span=us=>us<1000?us.toFixed(2)+" µs":(us/1000).toFixed(2)+" ms";
f.onsubmit=async e=>{e.preventDefault();const r=await fetch("/",{method:"POST",body:JSON.stringify({query:q.value,query_type:+t.value,n_results:+n.value,snippet_len:+l.value})});const j=await r.json();
const words=new Set(q.value.toLowerCase().split(/\P{L}+/u).filter(w=>w));
s.textContent=j.message||`${j.count} hits in ${span(j.time)}${j.cached?", cached":""}`;
o.replaceChildren(...(j.data||[]).map(h=>{const x=document.createElement("li");x.value=h.rank;const a=document.createElement("a");a.href=a.textContent=h.url;
x.append(`[${h.score.toFixed(2)}] `,(h.freqs||[]).map(([w,k])=>`${w}(${k}) `).join(""),a,document.createElement("br"),"…",...marked(h.snippet,words),"…");return x}))}
</script>"""


def serve(engine: Engine, port: int = 8080) -> ThreadingHTTPServer:
    """GET / gives a page, POST / answers a JSON request; a faulty one gets status 400. Call serve_forever on the result."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, kind: str, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            self.reply(200, "text/html; charset=utf-8", PAGE.encode())

        def do_POST(self) -> None:  # noqa: N802
            try:
                r = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                kinds = {"query": str, "query_type": int, "n_results": int, "snippet_len": int}
                for name, kind in kinds.items():
                    if type(r.get(name)) is not kind:
                        raise ValueError("missing or mistyped field")
                out, status = engine.search(**{k: r[k] for k in kinds}), 200
            except (ValueError, AttributeError) as e:
                out, status = {"message": str(e)}, 400
            self.reply(status, "application/json", json.dumps(out, ensure_ascii=False).encode())

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("", port), Handler)
