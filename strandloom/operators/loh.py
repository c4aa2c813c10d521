"""Loss of heterozygosity: filters, coverage in lost regions, haplotype assignment, collection from states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.scalar import bin_index
from strandloom.operators.segments import keep_first_disjoint

#: Coverage that stands for a lost haplotype, so that it is neither zero nor visible.
LOST = 0.0001


def long_regions(regions: DataFrame, least: int = 1_000_000, hp: int = 1) -> DataFrame:
    """Regions longer than the least length, with the haplotype they are kept on."""
    return regions.where(F.col("end") - F.col("start") > least).withColumn("hp", F.lit(hp))


def region_events(regions: DataFrame, event: str) -> DataFrame:
    """Regions as lines of text."""
    return regions.select(F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("end").cast("string"), F.lit(event)).alias("line"))


def give_to_first(bins: DataFrame, depth: DataFrame, regions: DataFrame) -> DataFrame:
    """Bins that start in a lost region get the whole depth (hp1 + hp2 + hp3 of ``depth``) on haplotype 1."""
    hit = iv.point_join(bins.select("chr", F.col("start").alias("pos")), regions.select("chr", "start", "end")).select("chr", F.col("pos").alias("start"), F.lit(True).alias("__lost")).distinct()
    total = depth.select("chr", "start", (F.col("hp1") + F.col("hp2") + F.col("hp3")).alias("__total"))
    rows = bins.join(hit, ["chr", "start"], "left").join(total, ["chr", "start"], "left")
    lost = F.coalesce(F.col("__lost"), F.lit(False))
    return rows.withColumns({"hp1": F.when(lost, F.coalesce("__total", F.lit(0.0))).otherwise(F.col("hp1")), "hp2": F.when(lost, LOST).otherwise(F.col("hp2")), "hp3": F.when(lost, 0.0).otherwise(F.col("hp3"))}).select(bins.columns)


def assign_haplotype(regions: DataFrame, bins: DataFrame, size: int) -> DataFrame:
    """hp = 2 where the mean of haplotype 2 over a region's bins, without the first and last, exceeds LOST."""
    spans = regions.select("chr", (bin_index(F.col("start"), size) + 1).alias("start"), (bin_index(F.col("end"), size) - 2).alias("end"), F.col("start").alias("from")).where("end >= start")
    means = iv.point_join(bins.withColumn("pos", bin_index(F.col("start"), size)), spans, bucket=64).groupBy("chr", F.col("r_from").alias("start")).agg(F.avg("hp2").alias("__mean"))
    rows = regions.join(means, ["chr", "start"], "left")
    return rows.withColumn("hp", F.when(F.col("__mean") > LOST, 2).otherwise(F.col("hp"))).select(regions.columns)


def collect_regions(one: DataFrame, two: DataFrame, least: int = 2_000_000) -> DataFrame:
    """Segments of copy number 0 on either haplotype (chr, start, end, cn), disjoint and merged where they touch."""
    long_zero = lambda t: t.where((F.col("cn") == 0) & (F.col("end") - F.col("start") > least)).select("chr", "start", "end")
    first, second = long_zero(one), long_zero(two)
    by_start = first.select(F.col("chr").alias("c"), F.col("start").alias("s"))
    by_end = first.select(F.col("chr").alias("c"), F.col("end").alias("e"))
    new = second.join(by_start, (F.col("chr") == F.col("c")) & (F.col("start") == F.col("s")), "left_anti").join(by_end, (F.col("chr") == F.col("c")) & (F.col("end") == F.col("e")), "left_anti")
    return iv.merge_touching(keep_first_disjoint(first.unionByName(new)))
