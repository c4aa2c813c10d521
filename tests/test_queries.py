"""Every registered query of the genomic operators against its SQL on the smallest tables."""

import math
import os

import pytest

from strandloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return db


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool | str):
        return str(v)
    return f"{float(v):.9g}"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, database, name):
    found = registry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = database.execute(registry.oracle_sql()[name])
    at = [c[0] for c in want.description]
    assert sorted(at) == columns
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_have_no_range_joins(spark):
    """Interval operators plan as equi-joins."""
    for name in ("first_containing", "overlap_semi", "add_missing", "flipped_bins", "cut_segments", "gene_states", "region_counts", "sync_decisions"):
        plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
