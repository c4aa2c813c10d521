"""Contig order, lists and genome offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chr_ord(chrom: Column) -> Column:
    """Karyotypic order: numbers, then X and Y, then names with suffixes and others."""
    bare = F.regexp_replace(chrom, "^chr", "")
    number = F.regexp_extract(bare, r"^(\d+)", 1).try_cast("int")
    rest = F.regexp_replace(bare, r"^(\d+|X|Y)", "")
    return (
        F.when((rest == "") & number.isNotNull(), number).when((rest == "") & (bare == "X"), 1000).when((rest == "") & (bare == "Y"), 1001)
        .when(number.isNotNull(), number + 2000).otherwise(3000)
    )


def expand(contigs: str) -> list[str]:
    """``chr1-22,chrX`` as a list of names."""
    out: list[str] = []
    for part in contigs.split(","):
        if m := re.fullmatch(r"(\D*)(\d+)-(?:\D*)(\d+)", part.strip()):
            out += [f"{m[1]}{i}" for i in range(int(m[2]), int(m[3]) + 1)]
        elif part.strip():
            out.append(part.strip())
    return out


def contig_table(spark: SparkSession, lengths: dict[str, int]) -> DataFrame:
    """chr, len, chr_ord and offset in the genome; as many rows as there are contigs."""
    return with_offsets(spark.createDataFrame(list(lengths.items()), "chr STRING, len BIGINT"))


def with_offsets(contigs: DataFrame) -> DataFrame:
    """Adds chr_ord and the sum of the lengths of the contigs before. The window spans one row per contig."""
    order = Window.orderBy("chr_ord", "chr").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("chr_ord", chr_ord(F.col("chr"))).withColumn("offset", F.coalesce(F.sum("len").over(order), F.lit(0)))


def karyotypic(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in karyotypic order, then by the columns given."""
    return df.orderBy(chr_ord(F.col("chr")), "chr", *columns)
