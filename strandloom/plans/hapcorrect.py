"""The phase-correction plan: from SNPs and phase sets to corrected coverage, blocks and variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.lineage import checkpoint
from strandloom.operators import coverage, loh, phase, reads, snps
from strandloom.sources.tables import format_value, with_genotype


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, with their usual values."""

    bin_size: int = 50_000
    snp_bin_size: int = 200_000
    min_block: int = 300_000
    het_ratio: float = 0.15
    min_loh: int = 1_000_000
    #: Depths of bins and blocks from alignments instead of SNPs.
    histogram_coverage: bool = False


@dataclass(frozen=True)
class Corrected:
    """What the plan makes: corrected bins and blocks (both with hp1, hp2), blocks before, lost regions, the bins that
    changed sides (``flips``), the depths before correction and the depths of genes."""

    bins: DataFrame
    blocks: DataFrame
    original_blocks: DataFrame
    loh: DataFrame
    flips: DataFrame
    raw_bins: DataFrame
    genes: DataFrame


def blocks_of(positions: DataFrame, settings: Settings) -> DataFrame:
    """Phase blocks from positions with their phase sets: extents, overlaps settled, short ones left out."""
    return phase.long_enough(phase.keep_longer(phase.block_extents(positions)), settings.min_block)


def window_depths(alignments: DataFrame, min_mapq: int = 5, max_error: float = 0.1, min_aligned: int = 1000) -> DataFrame:
    """hp, chr, win, depth: the segments of good reads over windows, by haplotype (0: unphased).

    One pass over the alignments feeds all that asks for depths (bins, blocks, the whole genome): what is kept of them
    are rows by window, not by read.
    """
    kept = reads.without_insertions(reads.filter_reads(reads.segments(alignments), min_mapq, max_error, min_aligned))
    spans = kept.select(F.col("haplotype").alias("hp"), F.col("ref_id").alias("chr"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end"))
    return checkpoint(coverage.histogram(spans, ("hp", "chr")))


def block_depths(snp: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks (chr, start, end) with the medians of their SNPs."""
    return coverage.snp_interval_values(snp, blocks.select("chr", "start", "end"), ("hp1", "hp2"), False)


def run(frequencies: DataFrame, positions: DataFrame, contigs: DataFrame, centromeres: DataFrame, zygosity: DataFrame | None = None, windows: DataFrame | None = None, settings: Settings = Settings(), genes: DataFrame | None = None) -> Corrected:
    """frequencies: chr, pos, freq_value_a, freq_value_b. positions: chr, position, phasesets. zygosity (tumor-only):
    chr, pos, gt. windows: depth of alignments by window (see ``window_depths``), which gives lost regions their whole
    depth, unphased reads included, and with ``histogram_coverage`` bins and blocks as well. genes: chr, start, end, gene.

    Every step holds for all contigs at once; contigs are partitions of windows and keys of joins, never loops. Bins
    carry the number of their swaps, so that variants can follow them whichever step made them.
    """
    size = settings.bin_size
    snp = frequencies.select("chr", "pos", F.col("freq_value_a").cast("double").alias("hp1"), F.col("freq_value_b").cast("double").alias("hp2"))
    # each step reads bins and blocks more than once, so both are cut from their lineage as they change
    fixed = iv.fixed_bins(contigs, size)
    depth = checkpoint(coverage.bin_coverage(windows, fixed)) if windows is not None else None
    of_reads = settings.histogram_coverage and depth is not None
    raw = depth if of_reads else checkpoint(coverage.snp_bin_mean(snp, fixed, size).select("chr", "start", "end", "hp1", "hp2", F.lit(0.0).alias("hp3")))
    values_of = (lambda rows: coverage.bin_coverage(windows, rows).select("chr", "start", "end", "hp1", "hp2")) if of_reads else (lambda rows: block_depths(snp, rows))
    bins = raw.withColumn("swaps", F.lit(0))
    original = checkpoint(blocks_of(positions, settings))
    values = values_of(original)
    lost = contigs.select("chr", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(1).alias("hp")).where("false")
    if zygosity is not None:
        found = snps.loh_regions(snps.zygosity_counts(zygosity, settings.snp_bin_size), settings.snp_bin_size, settings.het_ratio)
        lost = checkpoint(loh.assign_haplotype(loh.long_regions(found, settings.min_loh), bins, size))
        bins = checkpoint(loh.give_to_first(bins, depth if depth is not None else bins, lost))
        values = coverage.index_medians(bins, phase.cut_at_regions(values.select("chr", "start", "end"), lost.select("chr", "start", "end")), size)
    values = checkpoint(phase.clip_centromeres(values, centromeres))
    # switches inside a block break it up, into pieces with medians of their own, before neighbours are compared
    inside = checkpoint(phase.switches_inside(bins, values))
    unsteady = inside.where("unsteady").select("chr", F.col("block").alias("start"), F.col("block_end").alias("end")).distinct()
    bins = checkpoint(phase.align_inside(bins, values.join(unsteady, ["chr", "start", "end"], "left_semi")))
    bins = checkpoint(phase.apply_flips(bins, phase.flips(phase.broken_up(values, inside))).drop("flip"))
    # from here on blocks are whole again, with medians of the bins as they now are
    values = checkpoint(coverage.index_medians(bins, values, size))
    bins = checkpoint(phase.fill_gaps(bins, values))
    merged = phase.flanks(bins, checkpoint(phase.merge_groups(values)), size)
    second = checkpoint(phase.flips(merged, True, ("tail1", "tail2"), ("head1", "head2")))
    bins = checkpoint(phase.apply_flips(bins, second).drop("flip"))
    broken = inside.where("broken").select("chr", F.col("block").alias("start"), F.col("block_end").alias("end"))
    final = checkpoint(phase.regrouped(second, broken))
    bins = checkpoint(phase.align_blockless(bins, coverage.index_medians(bins, final, size), size, lost=lost))
    bare = contigs.join(original.select("chr").distinct(), "chr", "left_anti")
    bins = checkpoint(phase.larger_first(bins, bare))
    if zygosity is not None:
        final = iv.subtract(final, lost)
        lost = checkpoint(loh.assign_haplotype(lost, bins, size))
    blocks = values_of(checkpoint(phase.add_missing(final, original).distinct()))
    at_genes = coverage.snp_interval_values(snp, genes, ("hp1", "hp2"), True) if genes is not None else contigs.selectExpr("chr", "0L AS start", "0L AS end", "'' AS gene", "0D AS hp1", "0D AS hp2").where("false")
    changed = bins.where("swaps % 2 = 1").select("chr", "start", "end")
    return Corrected(bins.select("chr", "start", "end", "hp1", "hp2", "hp3"), blocks, original, lost, changed, raw, at_genes)


def rephased(variants: DataFrame, done: Corrected, settings: Settings = Settings()) -> DataFrame:
    """Variants (schema VARIANTS) with genotypes and phase sets as the corrected bins and blocks have them."""
    rows = variants.withColumns({"gt": F.coalesce(format_value("GT"), F.lit(".")), "ps": format_value("PS").try_cast("bigint")})
    new = phase.rephase(rows, done.flips, done.original_blocks, done.blocks.select("chr", "start", "end"), done.loh, settings.bin_size, settings.min_block)
    return with_genotype(new)
