"""Every query that has SQL gives the rows that DuckDB gives; the others run and hold their invariants."""

import duckdb
import pytest

from bindscape.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(v):
    if v is None or v != v:
        return "null"
    return str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    r = duck.execute(registry.oracle_sql()[name])
    cols, want = [d[0] for d in r.description], r.fetchall()
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    left = sorted(tuple(text(r[c]) for c in order) for r in got.collect())
    right = sorted(tuple(text(row[cols.index(c)]) for c in order) for row in want)
    assert left == right


def test_wang_landau(spark):
    """The one query without SQL: its chains come near the exact density."""
    exact = {round(r["score"], 6): r["s"] for r in registry.queries()["X2_exact_density"](spark, SF).collect()}
    rows = registry.queries()["X2_wang_landau"](spark, SF).collect()
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"X2_wang_landau"}
    assert {r["task"] for r in rows} == {"a", "b"} and all(abs(r["s"] - exact[round(r["score"], 6)]) < 0.3 for r in rows)


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert len(rows) == 20 and [r["w"] for r in rows] == sorted((r["w"] for r in rows), reverse=True)
