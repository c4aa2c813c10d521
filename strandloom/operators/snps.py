"""SNPs: pileups, allele depths, B-allele frequencies, heterozygosity and its loss."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strandloom.functions import intervals as iv
from strandloom.functions.scalar import SENTINEL, allele_depths, bin_index, fold_vaf, is_hom

MIN_SNPS, SNP_BIN, HET_RATIO = 5, 200_000, 0.15
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_INDEL = re.compile(r"[+-](\d+)")


def plain_bases(text: str, ref: str) -> str:
    """A pileup's bases without marks of read ends, qualities and indels; matches become the reference base."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "^":
            at += 2
        elif m := _INDEL.match(text, at):
            at = m.end() + int(m[1])
        else:
            if c != "$":
                out.append(ref if c in ".," else c)
            at += 1
    return "".join(out).upper()


@pandas_udf(StringType())
def _plain(text: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([plain_bases(t or "", r or "N") for t, r in zip(text, ref, strict=True)])


def base_counts(pileup: DataFrame) -> DataFrame:
    """Counts of A, C, G and T from (chr, start, ref, bases). Lengths of indels stand in the text, hence a UDF."""
    clean = pileup.withColumn("__b", _plain(F.col("bases"), F.upper("ref")))
    return clean.select("chr", "start", *((F.length("__b") - F.length(F.replace("__b", F.lit(x), F.lit("")))).alias(x.lower()) for x in "ACGT"))


def count_bases(observed: DataFrame) -> DataFrame:
    """The same counts from one row per read base (chr, start, base, mapq, baseq)."""
    good = observed.where("mapq >= 5 AND baseq >= 1")
    return good.groupBy("chr", "start").agg(*(F.count_if(F.col("base") == x).cast("int").alias(x.lower()) for x in "ACGT"))


def pileup(alignments: DataFrame, positions: DataFrame, bucket: int = 100_000) -> DataFrame:
    """One row per read base at the given positions: chr, start, base, mapq, baseq; for ``count_bases``.

    alignments: ref_id, pos (from 0), cigar, seq, qual, mapq, flag. positions: chr, start (from 1). Reads meet
    positions by an equi-join on (contig, bucket), so a read is copied once for each bucket that it touches, and a
    row holds at most ``bucket`` positions.
    """
    wanted = positions.groupBy(F.col("chr").alias("ref_id"), bin_index(F.col("start") - 1, bucket).alias("__bucket")).agg(F.sort_array(F.collect_set(F.col("start") - 1)).alias("places"))
    used = alignments.where(F.expr("(flag & 1796) = 0")).select("ref_id", "pos", "cigar", "seq", "qual", "mapq")
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    spread = used.withColumn("__bucket", F.explode(F.sequence(bin_index(F.col("pos"), bucket), bin_index(F.col("pos") + F.greatest(span - 1, F.lit(0)), bucket))))
    joined = spread.join(wanted, ["ref_id", "__bucket"]).select("ref_id", "pos", "cigar", "seq", "qual", "mapq", "places")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                at, q, places = r["pos"], 0, r["places"]
                for n, op in ((int(n), op) for n, op in _CIGAR.findall(r["cigar"])):
                    if op in "M=X":
                        for p in places[bisect_left(places, at) : bisect_left(places, at + n)]:
                            i = q + p - at
                            out.append((r["ref_id"], p + 1, r["seq"][i], r["mapq"], r["qual"][i]))
                        at, q = at + n, q + n
                    elif op in "DN":
                        at += n
                    elif op in "IS":
                        q += n
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["chr", "start", "base", "mapq", "baseq"])

    return joined.mapInArrow(run, "chr string, start long, base string, mapq int, baseq int")


def frequencies(het_snps: DataFrame, counts: DataFrame, unphased: bool = False) -> DataFrame:
    """Depth of each haplotype at heterozygous SNPs: an inner equi-join of positions and base counts."""
    both = het_snps.join(counts, ["chr", "start"])
    one, two = allele_depths(F.col("gt"), F.col("ref"), F.col("alt"), {x: F.col(x.lower()) for x in "ACGT"}, unphased)
    return both.select("chr", F.col("start").alias("pos"), one.alias("freq_value_a"), F.lit(1).alias("hp_a"), two.alias("freq_value_b"), F.lit(2).alias("hp_b"))


def vaf_of_depths(a: Column, b: Column) -> Column:
    return F.bround(F.least(a, b) / (a + b + 1e-7), 3)


def bin_vaf(snps: DataFrame, bins: DataFrame, size: int, min_snps: int = MIN_SNPS) -> DataFrame:
    """Mean vaf of SNPs strictly inside each bin, the sentinel where there are fewer than ``min_snps``.

    bins: chr, pos (start). Bin starts are multiples of the size, or one more, so a SNP finds its bin by division.
    """
    inside = snps.where(F.col("vaf").isNotNull() & ~F.isnan("vaf"))
    keyed = bins.withColumn("__bin", bin_index(F.col("pos"), size))
    hits = inside.select("chr", F.col("pos").alias("__pos"), "vaf", bin_index(F.col("pos"), size).alias("__bin")).join(keyed, ["chr", "__bin"]).where((F.col("__pos") > F.col("pos")) & (F.col("__pos") < F.col("pos") + size))
    means = hits.groupBy("chr", "pos").agg(F.count("*").alias("__n"), F.avg("vaf").alias("vaf"))
    joined = bins.select("chr", "pos").join(means, ["chr", "pos"], "left")
    return joined.select("chr", "pos", F.when(F.col("__n") >= min_snps, F.col("vaf")).otherwise(F.lit(float(SENTINEL))).alias("vaf"))


def baf_from_depths(freqs: DataFrame, bins: DataFrame, size: int) -> DataFrame:
    return bin_vaf(freqs.select("chr", "pos", vaf_of_depths(F.col("freq_value_a"), F.col("freq_value_b")).alias("vaf")), bins, size)


def baf_from_vcf(snps: DataFrame, bins: DataFrame, size: int) -> DataFrame:
    """snps: chr, pos, gt, vaf (double). Heterozygous genotypes only; frequencies above a half are folded."""
    return bin_vaf(snps.where(~is_hom(F.col("gt"))).select("chr", "pos", fold_vaf(F.col("vaf")).alias("vaf")), bins, size)


def zygosity_counts(snps: DataFrame, size: int = SNP_BIN) -> DataFrame:
    """Heterozygous and homozygous SNPs per bin; bins start at 1, SNPs on a start belong to none."""
    at = F.col("pos") - 1
    inside = snps.where((at > 0) & (F.pmod(at, F.lit(size)) != 0))
    hom = is_hom(F.col("gt"))
    return inside.groupBy("chr", (bin_index(at, size) * size + 1).alias("start")).agg(F.count_if(~hom).alias("hets"), F.count_if(hom).alias("homs"))


def zygosity_ratios(counts: DataFrame) -> DataFrame:
    total = F.col("hets") + F.col("homs")
    return counts.select("chr", "start", (F.col("hets") / total).alias("hets_ratio"), (F.col("homs") / total).alias("homs_ratio"))


def loh_regions(counts: DataFrame, size: int = SNP_BIN, het_ratio: float = HET_RATIO) -> DataFrame:
    """Runs of bins whose share of heterozygous SNPs is below the threshold; single gaps are bridged."""
    return iv.islands(zygosity_ratios(counts).where(F.col("hets_ratio") < het_ratio), size)


def empty_regions(counts: DataFrame, bins: DataFrame, size: int = SNP_BIN) -> DataFrame:
    """Runs of bins (chr, start) without any SNP: centromeres as the data show them."""
    return iv.islands(bins.select("chr", "start").join(counts, ["chr", "start"], "left_anti"), size)


def region_counts(snps: DataFrame, regions: DataFrame) -> DataFrame:
    """Heterozygous and homozygous SNPs strictly inside each region, as differences of counts up to its ends."""
    hom = is_hom(F.col("gt"))
    events = snps.select("chr", F.col("pos").alias("at"), (~hom).cast("int").alias("hets"), hom.cast("int").alias("homs"))
    found = iv.with_totals(regions.select("chr", "start", "end"), events, F.col("start") + 1, F.col("end"))
    inside = lambda c: F.when(F.col("end") > F.col("start"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    return found.select("chr", "start", "end", F.coalesce(inside("hets"), F.lit(0)).cast("long").alias("hets_count"), F.coalesce(inside("homs"), F.lit(0)).cast("long").alias("homos_count"))


def with_genome_position(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds start_overall, the position along the genome; contigs is one row per contig."""
    return df.join(F.broadcast(contigs.select("chr", "offset")), "chr").withColumn("start_overall", F.col("start") + F.col("offset")).drop("offset")
