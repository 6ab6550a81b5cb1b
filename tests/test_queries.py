"""Each query of the signal engine against its SQL on the smallest tables."""

import duckdb
import pytest

from tremolo.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ["embeddings", "events", "lineitem", "part", "pages"]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple("null" if v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(oracle.SQL[name]).df()
    for k in got.columns:
        if got[k].dtype.kind in "iu" or want[k].dtype.kind in "iu":
            got[k], want[k] = got[k].astype(float), want[k].astype(float)
    assert rows(got) == rows(want)


def test_every_other_query_runs(spark):
    for name in sorted(set(queries.QUERIES) - set(oracle.SQL) - {"bench_full"}):
        assert queries.QUERIES[name](spark, SF).limit(1).count() == 1, name
