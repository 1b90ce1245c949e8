import duckdb
import pytest

from codeloom.plans import queries as Q

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", Q.QUERIES)
def test_same_as_sql(spark, con, name):
    a, b = Q.QUERIES[name](spark, DIR).toPandas(), con.execute(Q.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    c = sorted(a.columns)
    a, b = (x[c].astype(str).replace({"None": "nan", "<NA>": "nan"}).map(lambda v: v.removesuffix(".0")).sort_values(c).reset_index(drop=True) for x in (a, b))
    assert len(a) and a.equals(b), (a.compare(b).head() if a.shape == b.shape else (a.shape, b.shape))
