"""Registered queries read all rows of their tables, and all have SQL."""

import inspect
import re

from strandloom.plans import registry
from strandloom.plans import views as v
from tests.test_queries import FOLDER, database, plain, pytestmark  # noqa: F401


def test_all_queries_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_no_query_reads_a_part_of_its_keys():
    text = inspect.getsource(registry)
    assert not re.search(r"(?i)ps % \d+ = 0 AND|WHERE ps %|WHERE ps <|LIKE '%\d'|\.limit\(|TABLESAMPLE|\.sample\(", text.replace("ps % 2 = 0", "").replace("ps % 2 = 1", "").replace("WHERE )", ""))


def test_segments_are_cut_at_all_blocks(spark, database):  # noqa: F811
    want = {tuple(r) for r in database.execute(f'WITH {v.SQL.strip()}{registry._CUTS} SELECT chr, "start", "end" FROM seg').fetchall()}
    first = {(c, p) for c, p in database.execute(f'WITH {v.SQL.strip()} SELECT chr, min("start") FROM blk WHERE "start" NOT BETWEEN 1000000 AND 1199999 GROUP BY chr, "start" // 300000').fetchall()}
    assert len({(c, e) for c, _, e in want} & first) > 0.9 * len({x for x in first if x[1] >= 2})
    for name in ("segment_scores", "segment_medians", "snap_segments"):
        assert {(r.chr, r.start, r.end) for r in registry.queries()[name](spark, FOLDER).collect()} == want


def test_segment_medians_over_all_blocks(spark, database):  # noqa: F811
    want = sorted(tuple(map(plain, r)) for r in database.execute(f'WITH {v.SQL.strip()}{registry._CUTS} SELECT chr, "start", "end", round(state, 6) FROM seg').fetchall())
    found = registry._segments(spark, FOLDER).selectExpr("chr", "start", "end", "round(state, 6) AS state")
    assert sorted(tuple(map(plain, r)) for r in found.collect()) == want
