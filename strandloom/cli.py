"""Command line: ``python -m strandloom.cli hapcorrect|cna|all|sync|migrate --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import schemas
from strandloom.functions import contigs as ct
from strandloom.functions import scalar
from strandloom.operators import breakpoints, loh, profile, snps, sync
from strandloom.operators import copynumber as cn
from strandloom.plans import cna, hapcorrect
from strandloom.sources import bam, plots, sinks, tables, vcf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    p.add_argument("command", choices=("all", "hapcorrect", "cna", "sync", "migrate"))
    p.add_argument("--out", required=True, help="folder for results")
    p.add_argument("--contig-lengths", help="headerless table: contig, length")
    p.add_argument("--contigs", default="chr1-22,chrX")
    p.add_argument("--centromeres", help="BED: contig, start, end")
    p.add_argument("--vcf", help="phased variants (plain or gzip)")
    p.add_argument("--base-counts", help="table of chr, start, a, c, g, t at heterozygous SNPs, comma separated")
    p.add_argument("--bam", help="alignments to count bases in, instead of --base-counts; comma separated")
    p.add_argument("--histogram-coverage", action="store_true", help="depths of bins and blocks from the alignments (--bam), not from SNPs")
    p.add_argument("--min-mapping-quality", type=int, default=5, help="of reads that count for depths")
    p.add_argument("--max-read-error", type=float, default=0.1, help="of reads that count for depths")
    p.add_argument("--min-aligned-length", type=int, default=1000, help="of reads that count for depths")
    p.add_argument("--regions", help="contigs or spans (chr1:1-1000000,chr2) of variants and alignments to read")
    p.add_argument("--compress-vcf", action="store_true", help="write re-phased variants in compressed blocks with an index")
    p.add_argument("--tumor-only", action="store_true", help="the variants are the tumor's: look for lost heterozygosity")
    p.add_argument("--breakpoints", help="VCF of structural variants")
    p.add_argument("--profile", help="copy-number profile for sync")
    p.add_argument("--bin-size", type=int, default=50_000)
    p.add_argument("--bin-size-snps", type=int, default=200_000)
    p.add_argument("--min-phaseblock", type=int, default=300_000)
    p.add_argument("--hets-ratio", type=float, default=0.15)
    p.add_argument("--hets-loh-seg-size", type=int, default=1_000_000)
    p.add_argument("--breakpoints-min-length", type=int, default=10_000)
    p.add_argument("--sv-support", type=float, default=3.0, help="least support of a structural variant")
    p.add_argument("--sv-support-rate", type=float, default=0.2, help="least support as a share of one copy's depth")
    p.add_argument("--use-sv-haplotypes", action="store_true", help="a phased variant cuts its own haplotype where blocks are imbalanced")
    p.add_argument("--change-point-detection-for-cna", action="store_true", help="cut at change points of the depth as well")
    p.add_argument("--cancer-genes", help="headerless table: contig, start, end, gene")
    p.add_argument("--user-input-genes", help="text with a gene's name in each line (or in the fourth column), to pick from --cancer-genes")
    p.add_argument("--genome-name", default="Sample", help="name of the sample in VCFs")
    p.add_argument("--without-phasing", action="store_true", help="cna on the sum of both haplotypes")
    p.add_argument("--hp1", help="migrate: older profile of haplotype 1")
    p.add_argument("--hp2", help="migrate: older profile of haplotype 2")
    p.add_argument("--purity-range", default="0.25-1.0")
    p.add_argument("--ploidy-range", default="1.0-5.5")
    p.add_argument("--confidence-subclonal-score", type=float, default=0.6)
    p.add_argument("--first-copy", type=float, default=0.0)
    p.add_argument("--dna-purity", action="store_true")
    p.add_argument("--cut-mixed-blocks", action="store_true")
    return p


def _range(text: str) -> tuple[float, float]:
    low, high = text.split("-")
    return float(low), float(high)


def _contigs(spark: SparkSession, args) -> DataFrame:
    rows = tables.read_table(spark, args.contig_lengths, schemas.CONTIGS)
    return rows.where(F.col("chr").isin(ct.expand(args.contigs)))


def _centromeres(spark: SparkSession, args) -> DataFrame:
    return tables.read_centromeres(spark, args.centromeres) if args.centromeres else spark.createDataFrame([], schemas.CENTROMERES)


def base_counts(spark: SparkSession, args, positions: DataFrame) -> DataFrame:
    """Base counts at positions (chr, start): from a table, or from the alignments."""
    if args.base_counts:
        return tables.read_table(spark, args.base_counts, schemas.ACGT_COUNTS, ",")
    return snps.count_bases(snps.pileup(bam.read_bam(spark, args.bam, args.regions, bases=True), positions))


def _genes(spark: SparkSession, args) -> DataFrame | None:
    if not args.cancer_genes:
        return None
    names = None
    if args.user_input_genes:  # a list that a person has written
        names = [r.value.split("\t")[3] if "\t" in r.value else r.value.strip() for r in spark.read.text(args.user_input_genes).collect()]
    return tables.read_genes(spark, args.cancer_genes, names)


def _check_naming(*frames: DataFrame) -> None:
    """Stops if some inputs name contigs with the prefix and others without."""
    if not tables.same_naming(*frames):
        raise SystemExit("the inputs name contigs in different ways, with and without the prefix chr")


def run_hapcorrect(spark: SparkSession, args) -> None:
    variants = tables.read_vcf(spark, args.vcf, regions=args.regions)
    if args.histogram_coverage and not args.bam:
        raise SystemExit("--histogram-coverage needs --bam")
    contigs, centromeres, genes = _contigs(spark, args), _centromeres(spark, args), _genes(spark, args)
    _check_naming(variants, tables.read_table(spark, args.contig_lengths, schemas.CONTIGS), *([centromeres] if args.centromeres else []), *([genes] if genes is not None else []))
    header = tables.vcf_header(spark, args.vcf)
    het = tables.het_snps(variants)
    freqs = snps.frequencies(het, base_counts(spark, args, het.select("chr", "start")))
    zygosity = tables.loh_snps(variants, tables.frequency_field(header)) if args.tumor_only else None
    settings = hapcorrect.Settings(args.bin_size, args.bin_size_snps, args.min_phaseblock, args.hets_ratio, args.hets_loh_seg_size, args.histogram_coverage)
    # of a tumor alone the depth of lost regions comes from its reads
    windows = hapcorrect.window_depths(bam.read_bam(spark, args.bam, args.regions), args.min_mapping_quality, args.max_read_error, args.min_aligned_length) if args.bam and (args.histogram_coverage or args.tumor_only) else None
    done = hapcorrect.run(freqs, tables.phaseset_positions(variants), contigs, centromeres, zygosity, windows, settings, genes)
    for name in ("bins", "blocks", "original_blocks", "loh", "flips", "raw_bins", "genes"):
        getattr(done, name).write.mode("overwrite").parquet(f"{args.out}/{name}")
    sinks.write_table(done.bins, f"{args.out}/phase_corrected_coverage")
    sinks.write_table(done.blocks, f"{args.out}/coverage_ps")
    new = hapcorrect.rephased(tables.read_vcf(spark, args.vcf, False, args.regions), done, settings)
    if args.compress_vcf:
        vcf.write_blocks(new, f"{args.out}/rephased.vcf.gz", sinks.with_phase_sets(header), args.genome_name)
    else:
        sinks.write_variants(new, f"{args.out}/rephased.vcf", header, args.genome_name)
    offsets = ct.with_offsets(contigs)
    for name, shown in (("coverage_before", done.raw_bins), ("coverage_after", done.bins)):
        plots.write_genome(f"{args.out}/{name}.svg", offsets, shown, ("hp1", "hp2"), done.blocks, {"hp1": "hp1", "hp2": "hp2"}, title=f"{args.genome_name}: {name.replace('_', ' ')}")
    lines = done.bins.select("chr", F.col("start").alias("pos"))
    if args.tumor_only:
        shares = zygosity.withColumn("vaf", scalar.parse_vaf(F.col("vaf")))
        snps.baf_from_vcf(shares, lines, args.bin_size).write.mode("overwrite").parquet(f"{args.out}/baf")
        bands = shares.select("chr", "pos", F.when(scalar.is_hom(F.col("gt")), "hom").otherwise("het").alias("kind"), F.col("vaf").alias("y"))
        plots.write_snps(f"{args.out}/snps.svg", offsets, bands, f"{args.genome_name}: frequencies of SNPs")
        ratios = snps.zygosity_ratios(snps.zygosity_counts(zygosity, args.bin_size_snps))
        ratios.write.mode("overwrite").parquet(f"{args.out}/snp_ratios")
        loh.region_events(done.loh, "loh").write.mode("overwrite").text(f"{args.out}/loh_events")
    else:
        snps.baf_from_depths(freqs, lines, args.bin_size).write.mode("overwrite").parquet(f"{args.out}/baf")


def run_cna(spark: SparkSession, args) -> None:
    bins = spark.read.parquet(f"{args.out}/bins")
    centromeres = _centromeres(spark, args)
    lost = spark.read.parquet(f"{args.out}/loh")
    lost = None if lost.isEmpty() else lost
    points = spark.createDataFrame([], "chr STRING, pos BIGINT, hp STRING, dv INT, id STRING")
    ids = arcs = None
    settings = cna.Settings(
        args.bin_size, _range(args.purity_range), _range(args.ploidy_range), args.dna_purity, args.first_copy, args.confidence_subclonal_score,
        sv_support_rate=args.sv_support_rate, min_support=args.sv_support, change_points=args.change_point_detection_for_cna,
    )
    if args.breakpoints:
        pairs = breakpoints.junctions(tables.read_vcf(spark, args.breakpoints), ct.expand(args.contigs), args.breakpoints_min_length, args.sv_support)
        if args.use_sv_haplotypes:
            pairs = breakpoints.trusted_haplotypes(pairs, spark.read.parquet(f"{args.out}/blocks"), lost)
        else:
            pairs = pairs.withColumn("hp", F.lit("0|0"))
        points = breakpoints.ends(pairs)
        ids = points.select("chr", "pos", "id")
        arcs = breakpoints.arc_curves(breakpoints.arcs(pairs), ct.with_offsets(_contigs(spark, args)))
        arcs.write.mode("overwrite").parquet(f"{args.out}/arcs")
    lengths = {r.chr: r.len for r in _contigs(spark, args).collect()}  # a row for each contig
    if args.without_phasing:
        whole = bins.select("chr", "start", "end", (F.col("hp1") + F.col("hp2") + F.col("hp3")).alias("coverage"))
        copy = cna.first_copies(whole.select("chr", "start", F.col("coverage").alias("hp1"), F.lit(0.0).alias("hp2")), settings)[0]
        top = float(whole.agg(F.max("coverage").alias("m")).first()["m"] or 0)
        sinks.write_profile(cna.unphased_profile(whole, points, centromeres, [i * copy for i in range(len(cn.centers_up_to(copy, top)))], args.bin_size), f"{args.out}/solution/integer_profile.bed")
        return
    genes = spark.read.parquet(f"{args.out}/genes") if args.cancer_genes else None
    offsets = ct.with_offsets(_contigs(spark, args))
    rows = []
    for found in cna.run(bins, points, centromeres, settings, ids, lost, genes):
        numbers = found.numbers
        folder = f"{args.out}/solution_{numbers['solution_rank']}"
        sinks.write_profile(found.integer, f"{folder}/integer_profile.bed")
        sinks.write_profile(found.subclonal, f"{folder}/subclonal_profile.bed")
        sinks.write_vcf(profile.vcf_records(found.integer), f"{folder}/cna.vcf", lengths, args.genome_name)
        sinks.write_vcf(profile.vcf_records(found.subclonal), f"{folder}/subclonal_cna.vcf", lengths, args.genome_name)
        sinks.write_table(found.loh, f"{folder}/loh_regions")
        title = f"{args.genome_name}: ploidy {numbers['ploidy']:.2f}, purity {numbers['cell_purity']:.2f}, confidence {numbers['confidence']:.2f}"
        for name, shown in (("integer", found.integer), ("subclonal", found.subclonal)):
            depth = {f"hp{h}": f"hp{h}_coverage" for h in (1, 2)}
            plots.write_genome(f"{folder}/{name}_profile.svg", offsets, bins, ("hp1", "hp2"), shown, depth, arcs, title)
        if found.genes is not None:
            sinks.write_genes(found.genes, f"{folder}/genes_copynumber_states.bed")
        rows.append(tuple(numbers[c.split()[0]] for c in schemas.SOLUTIONS.split(", ")))
    sinks.write_solutions(spark.createDataFrame(rows, schemas.SOLUTIONS), f"{args.out}/solutions")


def run_sync(spark: SparkSession, args) -> None:
    variants = tables.read_vcf(spark, args.vcf, False).withColumns({"gt": F.coalesce(tables.format_value("GT"), F.lit(".")), "ps": tables.format_value("PS").try_cast("bigint")})
    usable = sync.exclusion_reason(variants.where(F.col("filter").isin("PASS", "."))).where("reason IS NULL")
    counts = base_counts(spark, args, usable.select("chr", F.col("pos").alias("start")))
    snvs = sync.haplotype_depths(usable, counts).where("reason IS NULL")
    prof = tables.read_profile(spark, args.profile).withColumnsRenamed({"hp1_copynumber_state": "hp1", "hp2_copynumber_state": "hp2"})
    blocks = sync.blocks_of(snvs)
    if args.cut_mixed_blocks:
        blocks = sync.cut_mixed(blocks, prof, snvs)
    decided = sync.decisions(blocks, prof, snvs)
    decided.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{args.out}/sync_report")
    synced = tables.with_genotype(sync.apply_decisions(variants, decided))
    sinks.write_variants(synced, f"{args.out}/synced.vcf", tables.vcf_header(spark, args.vcf), args.genome_name)
    found = sync.diagnostics(decided)
    found.write.mode("overwrite").parquet(f"{args.out}/sync_diagnostics")
    for r in found.orderBy("decision", "reason").collect():  # a row for each decision and reason
        print(f"{r.decision}\t{r.reason}\t{r.blocks} blocks\t{r.snvs} variants")


def run_migrate(spark: SparkSession, args) -> None:
    sinks.write_profile(profile.merged_old(tables.read_profile(spark, args.hp1), tables.read_profile(spark, args.hp2)), args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    need = {"hapcorrect": ("vcf",), "all": ("vcf",), "cna": (), "sync": ("vcf", "profile"), "migrate": ("hp1", "hp2")}[args.command]
    missing = [n for n in need if not getattr(args, n)]
    if args.command not in ("sync", "migrate") and not args.contig_lengths:
        missing.append("contig_lengths")
    if args.command not in ("cna", "migrate") and not (args.base_counts or args.bam):
        missing.append("base_counts (or --bam)")
    if missing:
        raise SystemExit(f"{args.command} needs --" + ", --".join(n.replace("_", "-") for n in missing))
    spark = spark or SparkSession.builder.appName("strandloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("hapcorrect", "all"):
        run_hapcorrect(spark, args)
    if args.command in ("cna", "all"):
        run_cna(spark, args)
    if args.command == "sync":
        run_sync(spark, args)
    if args.command == "migrate":
        run_migrate(spark, args)


if __name__ == "__main__":
    main()
