"""The copy-number plan: from haplotype coverage bins to ranked solutions and aligned profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.lineage import checkpoint
from strandloom.functions.scalar import is_masked, snap, weighted_mean
from strandloom.operators import copynumber as cn
from strandloom.operators import loh, profile, segments


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, with their usual values."""

    bin_size: int = 50_000
    purity: tuple[float, float] = (0.25, 1.0)
    ploidy: tuple[float, float] = (1.0, 5.5)
    dna_purity: bool = False
    first_copy: float = 0.0
    confidence_subclonal: float = 0.6
    step: float = 0.1
    sv_support_rate: float = 0.2
    min_support: float = 3.0
    change_points: bool = False
    min_loh: int = 2_000_000


def integer_profile(bins: DataFrame, tracks: dict[int, DataFrame], centers: list[float], centromeres: DataFrame | None = None, breakpoints: DataFrame | None = None) -> DataFrame:
    """Tracks of segments (chr, start, end, state) by haplotype as one profile of integer states."""
    sides = []
    for hp in (1, 2):
        rows = cn.segment_scores(tracks[hp].withColumn("depth", F.col("state")), centers)
        if centromeres is not None:
            rows = cn.mask_centromeres(rows, centromeres)
        rows = rows.select("chr", "start", "end", F.bround("depth", 2).alias("coverage"), snap(F.col("state"), centers).alias("copynumber_state"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
        sides.append(rows if breakpoints is None else profile.with_breakpoint_ids(rows, breakpoints))
    return profile.align(sides[0], sides[1], () if breakpoints is None else ("svs_breakpoints_ids",))


def subclonal_profile(bins: DataFrame, tracks: dict[int, DataFrame], centers: list[float], size: int, threshold: float = 0.6) -> DataFrame:
    """The same with fractional states where a segment is far from every center."""
    sides = []
    found = cn.subclonal(tracks, bins, centers, size, threshold)
    for hp in (1, 2):
        state = F.when(F.col("is_subclonal"), snap(F.col("depth"), centers, 2)).otherwise(snap(F.col("state"), centers))
        sides.append(found[hp].select("chr", "start", "end", F.col("depth").alias("coverage"), state.alias("copynumber_state"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("is_subclonal"), "Y").otherwise("N").alias("is_subclonal")))
    return profile.align(sides[0], sides[1], ("is_subclonal",))


def unphased_profile(bins: DataFrame, points: DataFrame, centromeres: DataFrame, centers: list[float], size: int) -> DataFrame:
    """One track (bins: chr, start, end, coverage) between cut points, snapped, with equal neighbours merged."""
    both = bins.select("chr", "start", F.col("coverage").alias("hp1"), F.col("coverage").alias("hp2"))
    rows = segments.snap_segments(tracks_of(both, points.select("chr", "pos", F.lit(None).cast("int").alias("hp")), centromeres, size)[1], centers)
    scored = cn.segment_scores(rows, centers)
    best = scored.select("chr", "start", "confidence")
    merged = segments.merge_runs(scored.select("chr", "start", "end", "depth", "state"), "first").join(best, ["chr", "start"])
    return merged.select("chr", "start", "end", F.bround("depth", 2).alias("coverage"), snap(F.col("state"), centers).alias("copynumber_state"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def tracks_of(bins: DataFrame, points: DataFrame, centromeres: DataFrame, size: int, lost: DataFrame | None = None, sought: bool = False) -> dict[int, DataFrame]:
    """Segments of both haplotypes between cut points (chr, pos, hp: text of both ends' haplotypes, 1, 2 or null for both).

    lost: regions whose ends cut as well. sought: change points of the haplotype's own track join in.
    """
    ends = bins.groupBy("chr").agg(F.max("start").alias("pos"))
    fixed = centromeres.select("chr", F.explode(F.array("start", "end")).alias("pos")).union(ends)
    if lost is not None:
        fixed = fixed.union(lost.select("chr", F.explode(F.array("start", "end"))))
    out = {}
    for hp in (1, 2):
        own = points.where(segments.route_by_haplotype(points, hp)).select("chr", "pos")
        own = segments.first_in_bin(own, size)
        if sought:
            own = own.union(segments.change_points(bins.select("chr", F.lit(hp).alias("hp"), "start", F.col(f"hp{hp}").alias("value")), size).select("chr", "pos"))
        outside = own.join(F.broadcast(centromeres.select("chr", F.col("start").alias("__s"), F.col("end").alias("__e"))), "chr", "left").where("__s IS NULL OR pos NOT BETWEEN __s AND __e").select("chr", "pos")
        out[hp] = checkpoint(segments.cut_segments(bins.select("chr", "start", F.col(f"hp{hp}").alias("value")), outside.union(fixed), size, centromeres.select("chr", "end")))
    return out


def moved(bins: DataFrame, tracks: dict[int, DataFrame], lost: DataFrame | None, normal: float, size: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Bins and segments after the normal cells' depth moved to the lost haplotype of lost regions."""
    if lost is None:
        return bins, tracks
    bins = checkpoint(cn.move_normal(bins, lost, normal, size))
    return bins, {hp: checkpoint(cn.segment_medians(tracks[hp], bins, f"hp{hp}", size, 0.1 if hp == 1 else -1.0)) for hp in tracks}


def moved_depths(bins: DataFrame, tracks: dict[int, DataFrame], lost: DataFrame, grid: DataFrame, size: int) -> DataFrame:
    """(chr, start, hp, normal, depth) of the segments that hold bins of lost regions, for every normal depth of a grid.

    Only the bins of such segments are spread over the grid.
    """
    normals = F.array(*(F.lit(float(r.normal)) for r in grid.collect()))  # a few hundred numbers
    spans = lost.select("chr", F.floor(F.col("start") / size).cast("long").alias("start"), (F.floor(F.col("end") / size) - 1).cast("long").alias("end"), F.col("hp").alias("kept")).where("end >= start")
    hit = iv.point_join(bins.select("chr", F.floor(F.col("start") / size).cast("long").alias("pos"), "start"), spans, bucket=64).groupBy("chr", F.col("start").alias("bin")).agg(F.min("r_kept").alias("kept"))
    out = None
    for hp, track in tracks.items():
        value = bins.select("chr", F.col("start").alias("bin"), F.floor(F.col("start") / size).cast("long").alias("pos"), F.col(f"hp{hp}").alias("value")).join(hit, ["chr", "bin"], "left")
        ranges = track.select("chr", F.floor(F.col("start") / size).cast("long").alias("start"), (F.floor(F.col("end") / size) - 1).cast("long").alias("end"), F.col("start").alias("from")).where("end >= start")
        inside = iv.point_join(value, ranges, bucket=64).select("chr", F.col("r_from").alias("start"), "value", "kept")
        touched = inside.where("kept IS NOT NULL").select("chr", "start").distinct()
        spread = inside.join(touched, ["chr", "start"], "left_semi").withColumn("normal", F.explode(normals))
        here = F.when(F.col("kept").isNull(), F.col("value")).when(F.col("kept") == hp, F.greatest(F.col("value") - F.col("normal"), F.lit(0.0))).otherwise(F.col("value") + F.col("normal"))
        shown = F.when(here > 0.1, here) if hp == 1 else here
        rows = spread.groupBy("chr", "start", "normal").agg(F.coalesce(F.median(shown), F.lit(0.0)).alias("depth")).withColumn("hp", F.lit(hp))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_copies(bins: DataFrame, settings: Settings) -> list[float]:
    """The depth of one copy and, if the histogram has one, an alternative; a given one stands alone."""
    if settings.first_copy:
        return [settings.first_copy]
    one, other = cn.single_copy_coverage(*cn.coverage_histogram(segments.coverage_segments(bins, settings.bin_size)))
    return [x for x in (one, other) if x]


def _both(tracks: dict[int, DataFrame]) -> DataFrame:
    return tracks[1].withColumn("hp", F.lit(1)).unionByName(tracks[2].withColumn("hp", F.lit(2))).withColumn("depth", F.col("state"))


def _totals(tracks: dict[int, DataFrame], lost: DataFrame | None, centromeres: DataFrame | None) -> tuple[float, float]:
    """The mean depth of the segments by length and the largest one, without what is not measured."""
    measured = segments.without_lost_zeros(_both(tracks), *(r for r in (centromeres, lost) if r is not None))
    found = measured.where(~is_masked(F.col("depth"))).agg(weighted_mean(F.col("depth"), F.col("end") - F.col("start")).alias("mean"), F.max("depth").alias("top")).first()
    return float(found["mean"] or 0), float(found["top"] or 0)


def highest_normal(bins: DataFrame, points: DataFrame, centromeres: DataFrame, size: int, lost: DataFrame | None = None, sought: bool = False) -> float:
    """The highest normal depth to try, as a whole number: the mean depth of segments of a first cut, made before the
    depth of one copy is known. All breakpoints cut there, and so do the ends of lost regions, where the depth steps.
    """
    return float(int(_totals(tracks_of(bins, points, centromeres, size, lost, sought), lost, centromeres)[0]))


def scored_grid(bins: DataFrame, tracks: dict[int, DataFrame], copy: float, settings: Settings, lost: DataFrame | None = None, centromeres: DataFrame | None = None, limit: float | None = None) -> DataFrame:
    """The grid of normal depths up to a limit (else the mean depth of the tracks) with confidence, ploidy and purities, for one depth of a copy."""
    both = _both(tracks)
    mean, top = _totals(tracks, lost, centromeres)
    tumor = float(bins.agg(F.avg(F.col("hp1") + F.col("hp2")).alias("t")).first()["t"] or 0)
    grid = cn.grid(bins.sparkSession, float(int(mean)) if limit is None else limit, settings.step)
    depths = moved_depths(bins, tracks, lost, grid, settings.bin_size) if lost is not None else None
    return checkpoint(cn.purity_grid(both, grid, copy, len(cn.centers_up_to(copy, top)), tumor, moved=depths, centromeres=centromeres))


def solutions(grid: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The solutions of a scored grid: local maxima within the ranges, or the best one of all without any."""
    column = "dna_purity" if settings.dna_purity else "cell_purity"
    fit = cn.in_range(grid, settings.purity, settings.ploidy, column).withColumn("ord", F.col("normal"))
    chosen = checkpoint(cn.score_peaks(fit))
    if chosen.isEmpty():
        return grid.withColumn("ord", F.col("normal")).orderBy(F.desc("confidence"), "normal").limit(1)
    return chosen


@dataclass(frozen=True)
class Solution:
    """One solution: its numbers, profiles (subclonal beside integer), lost regions and copy numbers of genes."""

    numbers: dict
    integer: DataFrame
    subclonal: DataFrame
    loh: DataFrame
    genes: DataFrame | None


def run(bins: DataFrame, points: DataFrame, centromeres: DataFrame, settings: Settings = Settings(), breakpoints: DataFrame | None = None, lost: DataFrame | None = None, genes: DataFrame | None = None) -> list[Solution]:
    """points: chr, pos, hp (text of a pair's haplotypes, or null) and dv (support, or null). lost: regions that lost a
    haplotype (chr, start, end, hp). genes: chr, start, end, gene, hp1, hp2.

    Tracks are cut twice: at all breakpoints of enough support and at the ends of lost regions before one copy's depth is
    known, which sets the limit of the grid, and then at the breakpoints whose support is a share of that depth as well.
    """
    size = settings.bin_size
    if "dv" not in points.columns:
        points = points.withColumn("dv", F.lit(None).cast("int"))
    supported = lambda least: points.where(F.col("dv").isNull() | (F.col("dv") >= least))
    limit = highest_normal(bins, supported(settings.min_support), centromeres, size, lost, settings.change_points)
    copies = first_copies(bins, settings)
    halved = min(copies) if len(copies) > 1 else copies[0]
    tracks = tracks_of(bins, supported(max(halved * settings.sv_support_rate, settings.min_support)), centromeres, size, sought=settings.change_points)
    top = max(float(t.agg(F.max("state").alias("m")).first()["m"] or 0) for t in tracks.values())
    found = []
    for copy in copies:
        chosen = solutions(scored_grid(bins, tracks, copy, settings, lost, centromeres, limit), settings)
        found += [(copy, r.asDict()) for r in chosen.orderBy("ord").collect()]  # a few solutions
    rows = [(i, x["confidence"]) for i, (_, x) in enumerate(found)]
    ranks = {r.ord: r.solution_rank for r in cn.ranked(bins.sparkSession.createDataFrame(rows, "ord INT, confidence DOUBLE")).collect()} if rows else {}
    out = []
    for i, (copy, x) in sorted(enumerate(found), key=lambda y: ranks[y[0]]):
        centers = [x["normal"] + k * copy for k in range(len(cn.centers_up_to(copy, top)))]
        here, sides = moved(bins, tracks, lost, x["normal"], size)
        numbers = x | {"solution_rank": ranks[i], "first_copy": copy, "repository_name": f"solution_{x['ploidy']:.2f}_{x['cell_purity']:.2f}_{x['confidence']:.2f}"}
        states = {hp: t.select("chr", "start", "end", snap(F.col("state"), centers).alias("cn")) for hp, t in sides.items()}
        at_genes = cn.gene_states(genes, *(segments.snap_segments(sides[hp], centers) for hp in (1, 2)), centers) if genes is not None else None
        out.append(Solution(numbers, integer_profile(here, sides, centers, centromeres, breakpoints), subclonal_profile(here, sides, centers, size, settings.confidence_subclonal), loh.collect_regions(states[1], states[2], settings.min_loh), at_genes))
    return out
