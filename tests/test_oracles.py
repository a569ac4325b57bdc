"""Every query with SQL agrees with DuckDB at the smallest scale; the others give rows of a stable schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from hopweave.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def one(duck, sql):
    return duck.sql(sql).fetchall()[0][0]


def falling(xs):
    return all(a >= b for a, b in zip(xs, xs[1:], strict=False))


def by(rows, key, order):
    out = {}
    for r in sorted(rows, key=lambda r: (r[key], r[order])):
        out.setdefault(r[key], []).append(r)
    return out


#: Of queries without SQL: their columns, and what must hold for their rows.
CHECKS = {
    "bootstrap_ci": ("mean low high", lambda rows, q: [r.low < r.mean < r.high and abs(r.mean - one(q, "select avg(quality) from labels join documents using (doc_id)")) < 1e-9 for r in rows]),
    "evaluation_report": (
        "section metric value",
        lambda rows, q: [
            {r.section.split(":")[0] for r in rows} == {"splits", "places", "arrivals", "links"},
            sum(r.value for r in rows if r.metric in ("test_rows", "pool_rows")) == one(q, "select count(*) from lineitem"),
            all(r.value == 0 for r in rows if r.metric == "leaks"),
            all(0 <= r.value <= 1 for r in rows if r.metric.startswith(("acc_", "hits_", "mrr"))),
            next(r.value for r in rows if r.metric == "mae") > 0,
        ],
    ),
    "fuzzy_dedupe": ("k out", lambda rows, q: [len(rows) == one(q, "select count(*) from customer"), any("|" in r.out for r in rows)]),
    "gazetteer_from_tokens": (
        "name lat lon country population source_tokens matched_from score",
        lambda rows, q: [{r.name for r in rows} == {x for (x,) in q.sql("select n_name from nation").fetchall()}, len(rows) == 25, *(0.8 < r.score <= 1.05 for r in rows), *(r.matched_from.startswith("NATION") for r in rows)],
    ),
    "greedy_match_f1": ("threshold tp fp fn precision recall f1", lambda rows, q: [sorted(r.threshold for r in rows) == [60, 70, 80, 90, 100], falling([r.tp for r in sorted(rows)]), len({r.tp + r.fn for r in rows}) == 1, max(r.tp for r in rows) > 0]),
    "next_place_accuracy": ("model n acc_1 acc_3 acc_5", lambda rows, q: [{r.model for r in rows} == {"logistic", "ngram"}, len({r.n for r in rows}) == 1, *(0.02 < r.acc_1 < r.acc_3 < r.acc_5 < 1 for r in rows)]),
    "next_place_model": ("victim w prob rank", lambda rows, q: [len(x) == 3 and [r["rank"] for r in x] == [1, 2, 3] and falling([r.prob for r in x]) for x in by(rows, "victim", "rank").values()]),
    "node_type_accuracy": ("n acc_1 acc_2", lambda rows, q: [r.n > 50 and 0.9 < r.acc_1 <= r.acc_2 for r in rows]),
    "node_types": ("id ntype predicted prob", lambda rows, q: [len(rows) > 50, *(r.ntype[0].replace("T", "P") == r.id[0] and 0.25 < r.prob <= 1 for r in rows)]),
    "resolve_fuzzy": ("loc lat lon how score", lambda rows, q: [len(rows) == 50, {r.how for r in rows} == {"exact", "fuzzy"}, *(r.score == 100 if r.how == "exact" else 88 <= r.score < 100 for r in rows)]),
    "resolve_in_country": ("loc lat lon score", lambda rows, q: [len(rows) == 25, *(84 <= r.score <= 105 and (r.lat + 84) / 7 % 5 == int(r["loc"][-1]) for r in rows)]),
    "resolve_locations": ("loc lat lon how", lambda rows, q: [{r.how for r in rows} >= {"lookup", "exact"}, sum(r.how == "lookup" for r in rows) == 5, *((r.lat, r.lon) == (1, 2) for r in rows if r.how == "lookup"), len({r["loc"] for r in rows}) == len(rows) > 50]),
    "similarity": ("p_partkey ratio token_set matcher weighted", lambda rows, q: [len(rows) == one(q, "select count(*) from part"), *(0 <= r.matcher <= r.ratio + 1e-9 and r.ratio <= 100 and r.weighted >= r.ratio - 1e-9 for r in rows)]),
}


def test_every_query_is_checked():
    assert set(CHECKS) == set(QUERIES) - set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_without_sql(spark, duck, name):
    columns, holds = CHECKS[name]
    df = QUERIES[name](spark, SF)
    assert df.columns == columns.split()
    rows = df.collect()
    found = holds(rows, duck)
    assert found and all(found), rows[:5]
