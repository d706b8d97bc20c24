"""Every registered query of the engine equals its SQL on the smallest tables."""

import duckdb
import pytest

from flowlens.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "customer documents events lineitem orders part region nation supplier".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(shown(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql_runs(spark, name):
    rows = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows
    if name == "top_features_rf":
        assert len({r.feature for r in rows}) == len(rows) == 5 and abs(sum(r.importance for r in rows) - 1) < 1e-6
        assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    if name == "forest_scores":
        assert all(0 <= r.y_score <= 1 and r.y_pred == int(r.y_score >= 0.5) for r in rows)
