"""Every query with a DuckDB twin gives the same rows; the others run."""

import math

import duckdb
import pytest

from tipoff.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SLOW = {"loso", "platt", "gbt_fit_score", "tuning"}


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(rows[r][k] for k in at) for r in range(len(rows))), key=lambda r: tuple((v is None, round(v, 4) if isinstance(v, float) else v) for v in r)), [columns[k] for k in at]


def same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, abs_tol=2e-5)
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, con, name):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    df = registry.queries()[name](spark, SF)
    got, columns = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(registry.oracle_sql()[name])
    want, names = table([c[0] for c in cursor.description], cursor.fetchall())
    assert columns == names
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_season_held_out_models(spark):
    out = registry.queries()["loso"](spark, "/root/testdata/sf0.01").collect()
    assert out and all(0 < r["log_loss"] < 0.7 and r["accuracy"] > 0.5 for r in out)
