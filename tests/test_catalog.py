"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from notegrain.plans import catalog, roundtrips  # noqa: F401  registers its queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df, want = catalog.QUERIES[name](spark, FOLDER), db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows(df.select(*(f"`{c}`" for c in columns)).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_results_do_not_depend_on_partitions(spark):
    from notegrain.operators import spans
    from notegrain.plans import notes

    m = notes.broad(spark, FOLDER)
    one, many = (sorted(map(tuple, spans.longest_spans(m.repartition(n)).select("doc_seq", "start", "end", "cui").collect())) for n in (1, 7))
    assert one == many
