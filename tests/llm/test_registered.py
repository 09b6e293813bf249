"""The registered queries of the subpackage against their SQL, and those without SQL against the tables, on the smallest tables."""

import pytest
from test_queries import duck, same  # noqa: F401

from lodestone.llm import boilerplate, neighbours, registry, sentences, split, tokenizer

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, duck, name):  # noqa: F811
    same(QUERIES[name](spark, data), duck, SQL[name])


def rows(spark, data, name):
    return QUERIES[name](spark, data).collect()


def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def test_pieces(spark, data):
    bodies = {}
    for r in spark.read.parquet(f"{data}/msmarco_docs.parquet").select("id", "body").collect():
        if r.body and len(r.body) > 2000:
            bodies.setdefault(r.id, set()).add(r.body)
    got = {}
    for r in sorted(rows(spark, data, "p1_pieces"), key=lambda r: (r.id, r.body_no, r.piece_no)):
        assert len(r.piece) <= 2000 and r.overlap <= 200
        key = r.id, r.body_no
        got[key] = got.get(key, "") + r.piece[r.overlap :]
    whole = {}
    for (i, _), body in got.items():
        whole.setdefault(i, set()).add(body)
    assert whole == bodies
    assert split.split_spans("x" * 2000, 2000, 200) == [(0, 2000)]


def test_boilerplate(spark, data):
    lines = rows(spark, data, "p3_lines")
    assert {(r.id, r.line_no) for r in rows(spark, data, "p3_found")} == {(r.id, r.line_no) for r in lines if not r.own}
    kept = {}
    for r in sorted(lines, key=lambda r: (r.id, r.line_no)):
        if r.own:
            kept.setdefault(r.id, []).append(r.line)
    assert {r.id: r.text for r in rows(spark, data, "p3_main_text")} == {i: "\n".join(x) for i, x in kept.items()}
    assert 0.2 < sum(r.own for r in lines) / len(lines) < 0.9
    notices = [r for r in lines if r.line.startswith("©") or "All rights reserved" in r.line]
    assert notices and sum(r.own for r in notices) <= 0.05 * len(notices)
    assert boilerplate.TRAIN_PAGES > 0


def test_neighbours(spark, data):
    near = rows(spark, data, "p4_nearest")
    assert {(r.vec_kind, r.vec_id, r.corpus_id) for r in rows(spark, data, "p4_found")} == {(r.vec_kind, r.vec_id, r.corpus_id) for r in near}
    lists = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        lists.setdefault((r.vec_kind, r.vec_id), []).append((-r.cosine, r.corpus_id))
        assert r.vec_kind == "question" or r.vec_id != r.corpus_id
    assert all(x == sorted(x) and len(x) <= 5 for x in lists.values()) and neighbours.PROBES > 1


def test_tokens(spark, data):
    want = texts(spark, data)
    ids = {r.doc_id: r.ids for r in rows(spark, data, "p8_ids")}
    assert {i: tokenizer.decode_one(x) for i, x in ids.items()} == want
    spans = {}
    for r in sorted(rows(spark, data, "p8_spans"), key=lambda r: (r.doc_id, r.token_no)):
        spans.setdefault(r.doc_id, []).append(r.token_id)
        assert 0 <= r.begin_pos <= r.end_pos <= len(want[r.doc_id])
    assert spans == {i: x for i, x in ids.items() if x}


def test_mix(spark, data):
    goal = {r.source: r for r in spark.read.parquet(f"{data}/mix_targets.parquet").collect()}
    shares = {r.source: r for r in rows(spark, data, "p9_shares")}
    mix = rows(spark, data, "p9_mix")
    assert set(shares) == set(goal) and len({r.doc_id for r in mix}) == len(mix)
    for source, r in shares.items():
        used = [x for x in mix if x.source == source]
        assert r.mix_tokens == sum(x.n_tokens * x.uses for x in used) <= r.budget and all(1 <= x.uses <= goal[source].max_repeats for x in used)
        # where documents are few, a sum may be out of reach by less than one of them
        assert r.budget - r.mix_tokens < max([1, *(x.n_tokens for x in used)])
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-5


def test_sentences(spark, data):
    want = texts(spark, data)
    got = rows(spark, data, "p10_sentences")
    assert all(want[r.doc_id][r.begin_pos : r.end_pos] == r.sentence == r.sentence.strip() for r in got)
    assert {(r.doc_id, r.begin_pos, r.end_pos) for r in rows(spark, data, "p10_found")} == {(r.doc_id, r.begin_pos, r.end_pos) for r in got} == {(i, a, b) for i, t in want.items() for a, b in sentences.sentences(t)}
