"""Helpers that the operators share."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import common as c


def test_pieces_are_bounded_by_rows_and_bytes():
    texts = ["a" * n for n in (10, 20, 5000, 1, 1, 1, 90, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    for rows, size in ((3, 100), (100, 60), (1, 1), (100, 10**9)):
        got = list(c.pieces(batch, rows, size))
        assert [x for p in got for x in p.column(0).to_pylist()] == list(range(len(texts)))
        for p in got:
            n = sum(len(t or "") for t in p.column(1).to_pylist())
            assert p.num_rows <= rows and (n <= size or p.num_rows == 1)
    assert list(c.pieces(batch.slice(0, 0), 3, 100)) == []


def test_bitmaps_hold_their_values(spark):
    values = [0, -1, 5, 1 << 40, -(1 << 62), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "x BIGINT")
    bits = c.bitmap_for(df, "x")
    assert len(bits) * 64 == 1 << 16 and c.in_bitmap(bits, np.array(values)).all()
    assert not c.in_bitmap(bits, np.array([7, 8, 9])).any()
    assert not c.in_bitmap(c.bitmap_for(df.where("false"), "x"), np.array(values)).any()
    many = c.bitmap_for(spark.range(20_000).select(F.xxhash64("id").alias("x")), "x")
    assert len(many) * 64 >= 16 * 20_000


def test_fresh_names_clash_with_none(spark):
    df = spark.createDataFrame([(1, 2, 3)], "gone INT, Gone_ INT, n INT")
    assert c.fresh(df, "gone", "gone", "m", "N") == ["gone__", "gone___", "m", "N_"]


def test_only_the_chosen_rows_come(spark, make_docs):
    rows = c.id_and_text(make_docs([(i % 50, f"text {i}") for i in range(120)] + [(None, "x")]), "doc_id", "text")
    chosen = spark.createDataFrame([(3,), (49,), (3,), (1000,)], "who BIGINT")
    assert sorted(r[0] for r in c.only(rows, chosen, "who").collect()) == [3, 3, 3, 49, 49]


def test_samples_have_about_their_size(spark):
    df = spark.range(10_000).withColumn("k", F.col("id") % 4)
    assert 800 < c.about(df, ["id"], 1000).count() < 1200 and c.about(df, ["id"], 20_000).count() == 10_000
    some = c.smallest_hashes(df, "id", 100, "k").groupBy("k").count().collect()
    assert all(90 <= r["count"] <= 100 for r in some) and len(some) == 4


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        _jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))

    spark = SimpleNamespace(sparkContext=Context(), conf=SimpleNamespace(get=lambda key, other: other))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        c.shared_folder(spark)
