"""Phase sets against a copy-number profile: votes, decisions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv

MIN_SNVS, MIN_PER_SEGMENT, MIN_EVALUABLE, MIXED = 3, 2, 0.5, 0.15


def exclusion_reason(variants: DataFrame) -> DataFrame:
    """Variants (chr, pos, ref, alt, gt, ps) with the reason why they cannot vote, or null."""
    reason = (
        F.when(~F.col("gt").contains("|"), "not_phased").when(F.col("ps").isNull(), "no_ps").when(F.split("gt", r"\|")[0] == F.split("gt", r"\|")[1], "not_het")
        .when((F.length("ref") != 1) | (F.length("alt") != 1), "not_snv")
    )
    return variants.withColumn("reason", reason)


def haplotype_depths(snvs: DataFrame, counts: DataFrame) -> DataFrame:
    """Depths of both haplotypes at phased variants from base counts (chr, start, a, c, g, t), or a reason."""
    joined = snvs.join(counts.withColumnRenamed("start", "pos"), ["chr", "pos"], "left")

    def depth(base):
        out = F.lit(0)
        for x in "ACGT":
            out = F.when(F.upper(base) == x, F.col(x.lower())).otherwise(out)
        return out

    first = F.split("gt", r"\|")[0] == "0"
    one, two = F.when(first, depth(F.col("ref"))).otherwise(depth(F.col("alt"))), F.when(first, depth(F.col("alt"))).otherwise(depth(F.col("ref")))
    reason = F.when(F.col("a").isNull(), "no_pileup_data").when(one + two == 0, "zero_relevant_depth")
    return joined.select("chr", "pos", "ps", one.alias("hp1_depth"), two.alias("hp2_depth"), reason.alias("reason"))


def blocks_of(snvs: DataFrame) -> DataFrame:
    """Extent (half-open) of each phase set."""
    return snvs.groupBy("chr", "ps").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def profile_in_blocks(blocks: DataFrame, profile: DataFrame) -> DataFrame:
    """Pieces of profile segments within each block, without masked ones: chr, ps, block_start, start, end, sign."""
    plain = profile.where((F.abs("hp1") != 3300) & (F.abs("hp2") != 3300))
    pairs = iv.overlap_join(blocks.select("chr", "ps", "start", "end"), plain.select("chr", "start", "end", "hp1", "hp2"), closed=False)
    cut = pairs.select("chr", "ps", F.col("start").alias("block_start"), F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), (F.col("r_hp1") - F.col("r_hp2")).alias("diff"))
    return cut.where(F.abs("diff") >= 1e-9).withColumn("sign", F.signum("diff").cast("int"))


def votes(blocks: DataFrame, profile: DataFrame, snvs: DataFrame, least: int = MIN_PER_SEGMENT) -> DataFrame:
    """Per piece of profile how many variants it has and whether most agree with it (1) or not (-1)."""
    pieces = profile_in_blocks(blocks, profile)
    inside = iv.point_join(snvs.select("chr", "pos", F.col("ps").alias("v_ps"), F.signum(F.col("hp1_depth") - F.col("hp2_depth")).cast("int").alias("s")), pieces.withColumn("end", F.col("end") - 1).where("end >= start"))
    counted = inside.where("v_ps = r_ps").groupBy("chr", F.col("r_ps").alias("ps"), F.col("r_block_start").alias("block_start"), F.col("r_start").alias("start"), F.col("r_sign").alias("sign")).agg(F.count("*").alias("weight"), F.sum("s").alias("sum"))
    rows = counted.where((F.col("weight") >= least) & (F.col("sum") != 0))
    return rows.select("chr", "ps", "block_start", "start", "weight", F.when(F.signum("sum") == F.col("sign"), 1).otherwise(-1).alias("agreement"))


def decisions(blocks: DataFrame, profile: DataFrame, snvs: DataFrame, min_snvs: int = MIN_SNVS, min_evaluable: float = MIN_EVALUABLE, mixed: float = MIXED) -> DataFrame:
    """One row per block: n_snvs, evaluable_fraction, w_keep, w_flip, minority_fraction, decision, reason."""
    inside = iv.point_join(snvs.select("chr", "pos", F.col("ps").alias("v_ps")), blocks.withColumn("end", F.col("end") - 1)).where("v_ps = r_ps")
    n = inside.groupBy("chr", F.col("r_ps").alias("ps"), F.col("r_start").alias("start")).agg(F.count("*").alias("n_snvs"))
    cast = votes(blocks, profile, snvs).groupBy("chr", "ps", F.col("block_start").alias("start")).agg(F.sum(F.when(F.col("agreement") == 1, F.col("weight")).otherwise(0)).alias("keep"), F.sum(F.when(F.col("agreement") == -1, F.col("weight")).otherwise(0)).alias("flip"))
    rows = blocks.join(n, ["chr", "ps", "start"], "left").join(cast, ["chr", "ps", "start"], "left").na.fill(0, ["n_snvs", "keep", "flip"])
    total = F.col("keep") + F.col("flip")
    evaluable, minority = F.try_divide(total, F.col("n_snvs")), F.try_divide(F.least("keep", "flip"), total)
    reason = F.when(F.col("n_snvs") < min_snvs, "too_few_snvs").when(total == 0, "no_profile_data").when(evaluable < min_evaluable, "insufficient_evaluable_evidence").when(minority > mixed, "mixed_direction")
    seen = F.coalesce(reason, F.lit("")).isin("", "mixed_direction")
    return rows.select(
        F.col("chr").alias("chrom"), F.col("ps").alias("orig_ps"), "start", "end", F.coalesce(F.col("new_ps") if "new_ps" in blocks.columns else F.lit(None), F.col("ps")).alias("new_ps"), "n_snvs",
        F.when(~F.coalesce(reason, F.lit("")).isin("too_few_snvs", "no_profile_data"), F.bround(evaluable, 3)).alias("evaluable_fraction"),
        F.when(seen, F.col("keep")).alias("w_keep"), F.when(seen, F.col("flip")).alias("w_flip"), F.when(seen, F.bround(minority, 3)).alias("minority_fraction"),
        F.when(reason.isNull() & (F.col("flip") > F.col("keep")), "flip").otherwise("keep").alias("decision"), reason.alias("reason"),
    )


def cut_mixed(blocks: DataFrame, profile: DataFrame, snvs: DataFrame) -> DataFrame:
    """Blocks of mixed direction cut where the agreement changes; the first piece keeps the phase set."""
    mixed = decisions(blocks, profile, snvs).where("reason = 'mixed_direction'").select(F.col("chrom").alias("chr"), F.col("orig_ps").alias("ps"))
    order = Window.partitionBy("chr", "ps").orderBy("start")
    cuts = votes(blocks, profile, snvs).withColumn("before", F.lag("agreement").over(order)).where("before <> agreement").groupBy("chr", "ps").agg(F.array_sort(F.collect_set("start")).alias("cuts"))
    rows = blocks.join(mixed.join(cuts, ["chr", "ps"]), ["chr", "ps"], "left")
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda p: (p > F.col("start")) & (p < F.col("end")))
    edges = F.concat(F.array("start"), inner, F.array("end"))
    pieces = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("start"), F.element_at(edges, i + 1).alias("end"), (i == 1).alias("first")))
    out = rows.select("chr", "ps", F.explode(pieces).alias("p"))
    return out.select("chr", "ps", "p.start", "p.end", F.when(F.col("p.first"), F.col("ps")).otherwise(F.col("p.start")).alias("new_ps"))


def apply_decisions(variants: DataFrame, decided: DataFrame) -> DataFrame:
    """Variants (chr, pos, gt, ps) of each decided block, flipped or with a new phase set where decided."""
    spans = decided.select(F.col("chrom").alias("chr"), "start", (F.col("end") - 1).alias("end"), F.col("orig_ps").alias("ps"), "new_ps", "decision")
    hit = iv.point_join(variants.select("chr", "pos", F.col("ps").alias("v_ps")), spans).where("v_ps = r_ps").groupBy("chr", "pos").agg(F.min(F.struct("r_decision", "r_new_ps")).alias("d"))
    rows = variants.join(hit, ["chr", "pos"], "left")
    flipped = F.concat(F.split("gt", r"\|")[1], F.lit("|"), F.split("gt", r"\|")[0])
    gt = F.when((F.col("d.r_decision") == "flip") & F.col("gt").contains("|"), flipped).otherwise(F.col("gt"))
    return rows.select(*(c for c in variants.columns if c not in ("gt", "ps")), gt.alias("gt"), F.coalesce("d.r_new_ps", "ps").alias("ps"))


def diagnostics(decided: DataFrame) -> DataFrame:
    """How many blocks and variants each decision and reason has."""
    return decided.groupBy("decision", F.coalesce("reason", F.lit("compared")).alias("reason")).agg(F.count("*").alias("blocks"), F.sum("n_snvs").cast("long").alias("snvs"))
