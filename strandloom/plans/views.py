"""Genomic views over the supplied tables, in Spark and as SQL.

Contigs chr1 to chr22 have 3,000,000 bases each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 3_000_000
BIN = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, pos, value, et: events by second of the month."""
    pos = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(_chr("user_id"), pos.cast("long").alias("pos"), "value", F.col("event_type").alias("et"))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, start, end, hp, rid: line items by shipping day."""
    start = _days("l_shipdate") * 1000
    hp = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(_chr("l_suppkey"), start.alias("start"), (start + F.col("l_quantity") * 100).cast("long").alias("end"), hp.alias("hp"), F.col("l_orderkey").alias("rid"))


def blk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, ps, start, end, hp1, hp2: orders by day; haplotype values from the price."""
    start = _days("o_orderdate") * 1000
    hp1 = F.floor(F.col("o_totalprice") / 10000).cast("double")
    return table(spark, sf_dir, "orders").select(
        _chr("o_custkey"), F.col("o_orderkey").alias("ps"), start.alias("start"), (start + F.floor(F.col("o_totalprice") / 1000) + 1).cast("long").alias("end"),
        hp1.alias("hp1"), (F.col("o_orderkey") % 50).cast("double").alias("hp2"),
    )


def gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, start, end, gene: parts laid along the contigs."""
    start = (F.col("p_partkey") * 7919) % 2_900_000
    return table(spark, sf_dir, "part").select(_chr("p_partkey"), start.alias("start"), (start + F.col("p_size") * 1000).cast("long").alias("end"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 23).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chr"), F.lit(LENGTH).cast("long").alias("len"))


def centromeres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("chr", F.lit(1_000_000).cast("long").alias("start"), F.lit(1_199_999).cast("long").alias("end"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, start, end, hp1, hp2: mean SNP value of views and of other events in each bin, 0 without."""
    idx = F.floor(F.col("pos") / BIN).cast("long")
    is_view = F.col("et") == "view"
    means = snp(spark, sf_dir).groupBy("chr", idx.alias("b")).agg(F.avg(F.when(is_view, F.col("value"))).alias("hp1"), F.avg(F.when(~is_view, F.col("value"))).alias("hp2"))
    rows = contigs(spark, sf_dir).select("chr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LENGTH // BIN - 1).cast("long"))).alias("b"))
    out = rows.join(means, ["chr", "b"], "left")
    # a little more than the mean, so that ties of decimal means round alike in every engine
    value = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) + 1e-9, 4).alias(c)
    return out.select("chr", (F.col("b") * BIN).alias("start"), ((F.col("b") + 1) * BIN - 1).alias("end"), value("hp1"), value("hp2"))


def _chr(column: str):
    return F.concat(F.lit("chr"), (F.col(column) % 22 + 1).cast("string")).alias("chr")


def _days(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1995-01-01").cast("date")).cast("long")


SQL = f"""
snp AS (SELECT 'chr' || CAST(user_id % 22 + 1 AS VARCHAR) AS chr, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS pos, value, event_type AS et FROM events),
read AS (SELECT 'chr' || CAST(l_suppkey % 22 + 1 AS VARCHAR) AS chr, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 1000 AS "start",
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 1000 + l_quantity * 100 AS BIGINT) AS "end", CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS hp, l_orderkey AS rid FROM lineitem),
blk AS (SELECT 'chr' || CAST(o_custkey % 22 + 1 AS VARCHAR) AS chr, o_orderkey AS ps, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1000 AS "start",
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1000 + floor(o_totalprice / 1000) + 1 AS BIGINT) AS "end", floor(o_totalprice / 10000) AS hp1, CAST(o_orderkey % 50 AS DOUBLE) AS hp2 FROM orders),
gene AS (SELECT 'chr' || CAST(p_partkey % 22 + 1 AS VARCHAR) AS chr, (p_partkey * 7919) % 2900000 AS "start", CAST((p_partkey * 7919) % 2900000 + p_size * 1000 AS BIGINT) AS "end", 'G' || CAST(p_partkey AS VARCHAR) AS gene FROM part),
contigs AS (SELECT 'chr' || CAST(i AS VARCHAR) AS chr, CAST({LENGTH} AS BIGINT) AS len, i AS ord FROM range(1, 23) r(i)),
cen AS (SELECT chr, CAST(1000000 AS BIGINT) AS "start", CAST(1199999 AS BIGINT) AS "end" FROM contigs),
bins AS (SELECT c.chr, b * {BIN} AS "start", (b + 1) * {BIN} - 1 AS "end", round(coalesce(hp1, 0) + 1e-9, 4) AS hp1, round(coalesce(hp2, 0) + 1e-9, 4) AS hp2
  FROM contigs c CROSS JOIN range(0, {LENGTH // BIN}) g(b) LEFT JOIN (SELECT chr, pos // {BIN} AS b, avg(CASE WHEN et = 'view' THEN value END) AS hp1, avg(CASE WHEN et <> 'view' THEN value END) AS hp2 FROM snp GROUP BY 1, 2) m USING (chr, b))"""
