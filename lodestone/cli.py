"""python -m lodestone.cli build | merge | search | evaluate | convert (each with -h)."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import present
from lodestone.functions.scoring import B, K
from lodestone.operators import evaluate, index
from lodestone.operators.index import read_index, write_index
from lodestone.service import Engine, serve
from lodestone.session import local_session
from lodestone.sources import binary, files


def positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def mode(text: str) -> str:
    for m in present.MODES:
        if m.startswith(text):
            return m
    raise argparse.ArgumentTypeError("no such mode")


def plug_in(text: str) -> Callable:
    """A function that loads a model, named as module:function."""
    module, _, name = text.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise argparse.ArgumentTypeError(f"no such function: {e}") from e


def elapsed(micros: float) -> str:
    return f"{micros:.2f} us" if micros < 1000 else f"{micros / 1000:.2f} ms"


def _models(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--embeddings", help="Parquet with doc_id and embedding")
    parser.add_argument("--encoder", type=plug_in, help="module:function that loads a model of list of texts -> vectors")
    parser.add_argument("--scorer", type=plug_in, help="module:function that loads a model of list of (query, text) -> numbers")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="an index of TREC files, or of Parquet with doc_id, url and text")
    build.add_argument("docs")
    build.add_argument("index")
    merge = commands.add_parser("merge", help="a builder's blocks to a merged binary index")
    merge.add_argument("blocks", help="a folder of NNN and NNN_freqs files, or Parquet with term, doc_id, freq and block_no")
    merge.add_argument("out")
    merge.add_argument("-t", choices=binary.CODECS, default="vbyte")
    merge.add_argument("-d", choices=("true", "false"), default="true", help="ids as differences")
    search = commands.add_parser("search", help="answers queries of standard input, or HTTP")
    search.add_argument("index")
    search.add_argument("-q", type=mode, help="by default semantic where there are embeddings, else conjunctive")
    search.add_argument("-n", type=positive, default=10)
    search.add_argument("-l", type=positive, default=200)
    search.add_argument("-m", type=positive, default=1000, help="entries of the cache")
    search.add_argument("-w", type=positive, help="serve HTTP on this port instead")
    _models(search)
    rate = commands.add_parser("evaluate", help="mean reciprocal rank of labelled queries")
    rate.add_argument("index")
    rate.add_argument("queries", help="lines of a number, a tab and a query")
    rate.add_argument("qrels", help="lines of a query's number and a page's ordinal")
    rate.add_argument("-q", type=mode, default="conjunctive")
    rate.add_argument("-n", type=positive, default=10)
    rate.add_argument("-k", type=float, default=K)
    rate.add_argument("-b", type=float, default=B)
    _models(rate)
    convert = commands.add_parser("convert", help="docno in qrels to ordinals")
    convert.add_argument("docs", help="TREC files")
    convert.add_argument("qrels")
    convert.add_argument("out")
    return top


def _engine(spark: SparkSession, args: argparse.Namespace, cache: int = 1000) -> Engine:
    parts = read_index(spark, args.index)
    texts = spark.read.parquet(f"{args.index}/texts").select("doc_id", "text")
    vectors = spark.read.parquet(args.embeddings) if args.embeddings else None
    return Engine(parts["postings"], parts["lexicon"], parts["page_table"], texts, vectors, args.encoder, args.scorer, cache)


def _evaluator(spark: SparkSession, args: argparse.Namespace, queries: DataFrame) -> evaluate.Evaluator:
    parts = read_index(spark, args.index)
    if args.q in ("conjunctive", "disjunctive"):
        return evaluate.KeywordEvaluator(parts["postings"], parts["lexicon"], parts["page_table"], args.q == "conjunctive", args.k, args.b)
    engine = _engine(spark, args)

    class Vectors:
        def collect_and_rank(self, queries: DataFrame, n: int) -> DataFrame:
            return engine.hits(queries, args.q, n)[0]

    return Vectors()


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    for f in (getattr(args, "encoder", None), getattr(args, "scorer", None)):
        # a module of one file goes to the workers; packages must be installed there
        source = getattr(sys.modules.get(f.__module__), "__file__", None) if f and "." not in f.__module__ else None
        if source:
            spark.sparkContext.addPyFile(source)
    if args.command == "build":
        docs = spark.read.parquet(args.docs) if args.docs.endswith(".parquet") else files.read_trec_ordered(spark, args.docs)
        docs.write.mode("overwrite").parquet(f"{args.index}/texts")
        write_index(spark.read.parquet(f"{args.index}/texts"), args.index)
        stats = spark.read.parquet(f"{args.index}/stats").first()
        print(f"{stats.n} pages, {stats.avgdl or 0:.2f} terms on average")
    elif args.command == "merge":
        raw = spark.read.parquet(args.blocks) if args.blocks.endswith(".parquet") else binary.read_blocks(spark, args.blocks, args.t)
        lexicon = binary.write_merged(index.merge_blocks(raw), args.out, args.t, args.d == "true")
        sums = lexicon.agg(F.count_distinct("term").alias("terms"), F.sum("ids_bytes").alias("ids"), F.sum("freqs_bytes").alias("freqs")).first()
        print(f"{sums.terms} terms, {sums.ids or 0} bytes of ids, {sums.freqs or 0} bytes of freqs")
    elif args.command == "evaluate":
        queries, qrels = files.read_queries(spark, args.queries), files.read_lines(spark, args.qrels, "qid bigint, doc_id bigint")
        out = evaluate.evaluate(_evaluator(spark, args, queries), queries, qrels, args.n).first()
        print(f"MRR@{args.n} {out.mrr or 0:.6f} of {out.queries} queries")
    elif args.command == "convert":
        ordinals = files.docno_ordinals(files.read_trec_ordered(spark, args.docs))
        raw = files.parse_qrels(spark.read.text(args.qrels))
        files.write_lines(files.convert_qrels(raw, ordinals), args.out, ["qid", "doc_id"])
        print(f"{raw.join(ordinals, 'docno', 'left_anti').count()} labels of unknown pages left out")
    else:
        engine = _engine(spark, args, args.m)
        chosen = args.q or ("semantic" if args.embeddings and args.encoder else "conjunctive")
        if args.w:
            serve(engine, args.w).serve_forever()
        for line in sys.stdin:
            out = engine.search(line.strip(), present.MODES.index(chosen), args.n, args.l)
            print(f"{out['count']} hits in {elapsed(out['time'])}{' (cached)' if out['cached'] else ''}")
            for h in out.get("data") or []:
                terms = "".join(f"{t}({k}) " for t, k in h.get("freqs", []))
                print(f"{h['rank']}. [{h['score']:.2f}] {terms}\n{h['url'] or ''}\n...{h['snippet']}...")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(args, local_session())


if __name__ == "__main__":
    main()
