"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import json
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def same(df, duck, sql):
    got = df.collect()
    r = duck.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(row[cols.index(k)]) for k in sorted(cols)) for row in r.fetchall())
    assert sorted(tuple(plain(row[k]) for k in sorted(cols)) for row in got) == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


def test_only_the_raw_json_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"response_json"} and set(SQL) <= set(QUERIES)


def test_response_json(spark, data):
    """Its fields are compared by response_items; here, that it is what a client can read."""
    for r in QUERIES["response_json"](spark, data).collect():
        answer = json.loads(r.response)
        assert answer["cached"] is False and (answer["count"] > 0) == bool(answer.get("data"))
        for hit in answer.get("data", []):
            assert set(hit) >= {"rank", "score", "freqs", "snippet"} and hit["freqs"] == sorted(hit["freqs"], key=lambda x: x["term"].encode())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(SQL)
