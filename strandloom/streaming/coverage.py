"""Coverage and zygosity over streams of segments and SNPs.

Both are associative counts, so the batch expressions hold; state is one number for each window or bin. The
position axis has no event time, so results are kept in update mode and no state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalar import bin_index
from strandloom.operators.coverage import WINDOW
from strandloom.operators.snps import zygosity_counts


def histogram(segments: DataFrame, keys: tuple[str, ...] = ("genome_id", "hp", "chr"), window: int = WINDOW) -> DataFrame:
    """Counts per window as segments arrive; each segment is spread over its windows, as streams have no lead()."""
    wins = F.sequence(bin_index(F.col("start"), window), bin_index(F.col("end"), window))
    return segments.select(*keys, F.explode(wins).alias("win")).groupBy(*keys, "win").agg(F.count("*").alias("depth"))


def zygosity(snps: DataFrame, size: int = 200_000) -> DataFrame:
    """Heterozygous and homozygous counts per bin as SNPs arrive."""
    return zygosity_counts(snps, size)
