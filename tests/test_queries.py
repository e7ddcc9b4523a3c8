import duckdb
import pytest

from axisfold.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)

    def norm(x):
        return round(x, 5) + 0.0 if isinstance(x, float) else x

    mine = sorted([tuple(norm(r[c]) for c in columns) for r in got.collect()], key=str)
    theirs = sorted([tuple(map(norm, r)) for r in want.fetchall()], key=str)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=2e-5) for x, y in zip(a, b, strict=True)), (a, b)
