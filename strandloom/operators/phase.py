"""Phase blocks: building, clipping, flipping, filling gaps, re-phasing variants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.lineage import checkpoint
from strandloom.functions.scalar import bin_index, has_imbalance
from strandloom.operators.coverage import index_medians


def block_extents(positions: DataFrame) -> DataFrame:
    """First and last position of each phase set."""
    return positions.groupBy("chr", "phasesets").agg(F.min("position").alias("start"), F.max("position").alias("end"))


def keep_longer(blocks: DataFrame) -> DataFrame:
    """Greedy: of overlapping blocks, in order of start, the longer one stays. Folds each contig's blocks."""

    def run(track: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in track.assign(length=track["end"] - track["start"]).sort_values(["start", "length", "phasesets"], ascending=[True, False, True]).itertuples(index=False):
            if kept and row.start <= kept[-1].end:
                if row.length > kept[-1].length:
                    kept[-1] = row
            else:
                kept.append(row)
        return pd.DataFrame([(r.chr, r.start, r.end) for r in kept], columns=["chr", "start", "end"])

    return blocks.groupBy("chr").applyInPandas(run, "chr string, start long, end long")


def long_enough(blocks: DataFrame, least: int = 300_000) -> DataFrame:
    return blocks.where(F.col("end") - F.col("start") >= least)


def add_missing(blocks: DataFrame, originals: DataFrame) -> DataFrame:
    """Blocks and those originals that touch none of them."""
    return blocks.select("chr", "start", "end").unionByName(iv.overlap_join(originals.select("chr", "start", "end"), blocks, how="left_anti"))


def clip_centromeres(blocks: DataFrame, centromeres: DataFrame) -> DataFrame:
    """Blocks within a centromere go; those across its start or end are cut there; contigs without one stay.

    There is one centromere per contig, so the table is broadcast.
    """
    c = centromeres.select(F.col("chr"), F.col("start").alias("__cs"), F.col("end").alias("__ce"))
    rows = blocks.join(F.broadcast(c), "chr", "left").where(~F.coalesce((F.col("__cs") < F.col("start")) & (F.col("end") < F.col("__ce")), F.lit(False)))
    across_start = (F.col("start") < F.col("__cs")) & (F.col("__cs") < F.col("end"))
    across_end = (F.col("start") < F.col("__ce")) & (F.col("__ce") < F.col("end"))
    end = F.when(across_start, F.col("__cs")).otherwise(F.col("end"))
    start = F.when(across_end & ~F.coalesce(across_start, F.lit(False)), F.col("__ce")).otherwise(F.col("start"))
    return rows.select(*(start.alias("start") if x == "start" else end.alias("end") if x == "end" else F.col(x) for x in blocks.columns))


def without_loh(blocks: DataFrame, loh: DataFrame) -> DataFrame:
    """Blocks that touch no region of lost heterozygosity, and these regions themselves."""
    rest = iv.overlap_join(blocks, loh, closed=True, how="left_anti")
    return rest.unionByName(loh.select(*(c for c in blocks.columns if c in loh.columns)), allowMissingColumns=True)


def cut_at_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks split at the ends of regions, without the pieces inside one, and the regions as blocks."""
    points = regions.select("chr", F.explode(F.array("start", "end")).alias("pos"))
    pieces = iv.split_at(blocks, points)
    inside = iv.overlap_join(pieces.select("chr", "start", "end"), regions.select("chr", "start", "end"), closed=False).where("start >= r_start AND end <= r_end").select("chr", "start", "end").distinct()
    return pieces.join(inside, ["chr", "start", "end"], "left_anti").unionByName(regions.select("chr", "start", "end"), allowMissingColumns=True)


def flips(blocks: DataFrame, product: bool = False, tail: tuple[str, str] = ("hp1", "hp2"), head: tuple[str, str] = ("hp1", "hp2")) -> DataFrame:
    """Blocks (chr, start, end, hp1, hp2) with ``flip`` after comparing neighbours from left to right.

    The end of a block (columns ``tail``) is compared with the beginning of the next (``head``). Swapping a block
    exchanges its cis and trans distances, so a flip is the parity of the earlier places where trans is less,
    counted anew after each tie: running sums instead of a loop.
    """
    order = Window.partitionBy("chr").orderBy("start", "end")
    p1, p2 = F.lag(tail[0]).over(order), F.lag(tail[1]).over(order)
    h1, h2 = F.col(head[0]), F.col(head[1])
    if product:
        cis, trans = F.abs(p1 - h1) * F.abs(p2 - h2), F.abs(p1 - h2) * F.abs(p2 - h1)
    else:
        cis, trans = F.least(F.abs(p1 - h1), F.abs(p2 - h2)), F.least(F.abs(p1 - h2), F.abs(p2 - h1))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumns({"__tie": F.coalesce((cis == trans).cast("int"), F.lit(0)), "__trans": F.coalesce((trans < cis).cast("int"), F.lit(0))})
    rows = rows.withColumn("__group", F.sum("__tie").over(so_far))
    within = Window.partitionBy("chr", "__group").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("flip", F.sum("__trans").over(within) % 2 == 1).drop("__tie", "__trans", "__group")


def flanks(bins: DataFrame, blocks: DataFrame, size: int, length: int = 5_000_000) -> DataFrame:
    """Blocks with the medians of their first (head1, head2) and last (tail1, tail2) bins, ``length`` bases at most."""
    n = length // size
    spans = blocks.select("chr", bin_index(F.col("start"), size).alias("start"), bin_index(F.col("end"), size).alias("end"), F.col("start").alias("from"), F.col("end").alias("to"))
    inside = iv.point_join(bins.withColumn("pos", bin_index(F.col("start"), size)).select("chr", "pos", "hp1", "hp2"), spans, bucket=64)
    first, last = F.col("pos") < F.col("r_start") + n, F.col("pos") > F.col("r_end") - n
    of = lambda part, c: F.coalesce(F.median(F.when(part, F.col(c))), F.lit(0.0))
    found = inside.groupBy("chr", F.col("r_from").alias("start"), F.col("r_to").alias("end")).agg(*(of(part, f"hp{h}").alias(f"{name}{h}") for name, part in (("head", first), ("tail", last)) for h in (1, 2)))
    return blocks.join(found, ["chr", "start", "end"], "left").na.fill(0.0, ["head1", "head2", "tail1", "tail2"])


def swap(condition: Column, a: str = "hp1", b: str = "hp2") -> dict[str, Column]:
    return {a: F.when(condition, F.col(b)).otherwise(F.col(a)), b: F.when(condition, F.col(a)).otherwise(F.col(b))}


def swapped(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows with their haplotypes exchanged under a condition; a column ``swaps`` counts it."""
    changed = swap(condition)
    if "swaps" in rows.columns:
        changed["swaps"] = F.col("swaps") + condition.cast("int")
    return rows.withColumns(changed)


def apply_flips(bins: DataFrame, flipped: DataFrame) -> DataFrame:
    """Bins with haplotypes swapped where an odd number of flipped blocks holds their start, and ``flip``."""
    hits = iv.point_join(bins.select("chr", F.col("start").alias("pos")), flipped.where("flip").select("chr", "start", "end")).groupBy("chr", F.col("pos").alias("start")).agg((F.count("*") % 2 == 1).alias("flip"))
    rows = bins.join(hits, ["chr", "start"], "left").na.fill(False, ["flip"])
    return swapped(rows, F.col("flip"))


def dominance(a: Column, b: Column) -> Column:
    return F.when(a > b, 1).when(a < b, 2).otherwise(0)


def gaps(blocks: DataFrame) -> DataFrame:
    """Gaps between neighbours of equal dominance: chr, start, end, hp."""
    order = Window.partitionBy("chr").orderBy("start", "end")
    here = dominance(F.col("hp1"), F.col("hp2"))
    rows = blocks.select("chr", F.col("end") + 1, here.alias("hp"), (F.lead("start").over(order) - 1).alias("stop"), F.lead(here).over(order).alias("next"))
    return rows.toDF("chr", "start", "hp", "stop", "next").where("hp = next AND hp <> 0 AND stop >= start").select("chr", "start", F.col("stop").alias("end"), "hp")


def fill_gaps(bins: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bins in such gaps take the neighbours' order of haplotypes."""
    hit = iv.point_join(bins.select("chr", F.col("start").alias("pos")), gaps(blocks)).groupBy("chr", F.col("pos").alias("start")).agg(F.min("r_hp").alias("__hp"))
    rows = bins.join(hit, ["chr", "start"], "left")
    wrong = ((F.col("__hp") == 1) & (F.col("hp1") < F.col("hp2"))) | ((F.col("__hp") == 2) & (F.col("hp1") > F.col("hp2")))
    return swapped(rows, F.coalesce(wrong, F.lit(False))).drop("__hp")


def merge_groups(blocks: DataFrame, shortest: int = 1_000_000) -> DataFrame:
    """Neighbours of equal dominance, both imbalanced and close, as one block; single ones stay if imbalanced and long."""
    order = Window.partitionBy("chr").orderBy("start", "end")
    same = (F.lag("hp1").over(order) < F.lag("hp2").over(order)) == (F.col("hp1") < F.col("hp2"))
    imbalanced = has_imbalance(F.lag("hp1").over(order), F.lag("hp2").over(order)) & has_imbalance(F.col("hp1"), F.col("hp2"))
    lengths = (F.lag("end").over(order) - F.lag("start").over(order) + F.col("end") - F.col("start")) / 2
    near = F.col("start") - F.lag("end").over(order) < lengths
    grouped = iv.groups_by_gap(blocks, ~(same & imbalanced & near))
    out = grouped.groupBy("chr", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.avg("hp1").alias("hp1"), F.avg("hp2").alias("hp2"))
    return out.where((F.col("n") > 1) | (has_imbalance(F.col("hp1"), F.col("hp2")) & (F.col("end") - F.col("start") > shortest))).drop("run", "n")


def larger_first(bins: DataFrame, contigs: DataFrame) -> DataFrame:
    """On contigs without blocks (chr) haplotype 1 is the larger one in every bin."""
    bare = bins.join(F.broadcast(contigs.select("chr", F.lit(True).alias("__bare"))), "chr", "left")
    return swapped(bare, F.coalesce(F.col("__bare"), F.lit(False)) & (F.col("hp1") < F.col("hp2"))).drop("__bare")


def switches_inside(bins: DataFrame, blocks: DataFrame, stable: int = 5, deviation: float = 5.0, apart: float = 6.0) -> DataFrame:
    """Per block that switches phase the pieces with one dominance each: chr, block, block_end, start, end, hp, hp1, hp2
    (medians) and ``broken``.

    A run is of bins (of a block, without its last) of one dominance, ``stable`` of them at least; runs of one
    dominance with less than that between them are one piece. A block has pieces only if it has runs of both kinds.
    It is broken if the runs' medians of either kind vary by less than ``deviation`` and the larger and the
    smaller haplotype of its bins differ by more than ``apart`` on average; then the first piece begins and the last
    one ends with the block. If the medians of both kinds vary more, the block is not broken but to be aligned.
    """
    inside = iv.point_join(bins.withColumn("pos", F.col("start")), blocks.select("chr", "start", "end"))
    inside = inside.select("chr", F.col("r_start").alias("block"), F.col("r_end").alias("block_end"), F.col("start").alias("at"), F.col("end").alias("to"), "hp1", "hp2", dominance(F.col("hp1"), F.col("hp2")).alias("hp"))
    block = Window.partitionBy("chr", "block", "block_end")
    order = block.orderBy("at")
    rows = inside.withColumns({"i": F.row_number().over(order), "m": F.count("*").over(block)}).where("i < m")
    changed = F.coalesce((F.col("hp") != F.lag("hp").over(order)).cast("int"), F.lit(1))
    rows = rows.withColumn("__c", changed).withColumn("run", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")
    key = ["chr", "block", "block_end"]
    last = F.max("i").over(Window.partitionBy(*key, "run"))
    inner = rows.withColumn("inner", F.col("i") < last)
    of = lambda c: F.coalesce(F.median(F.when(F.col("inner") & (F.col(c) != 0), F.col(c))), F.lit(0.0))
    runs = inner.groupBy(*key, "run", "hp").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"), of("hp1").alias("m1"), of("hp2").alias("m2")).where((F.col("n") >= stable) & (F.col("hp") > 0))
    kind = lambda h, c: F.stddev_pop(F.when(F.col("hp") == h, F.col(c)))
    verdict = runs.groupBy(*key).agg(kind(1, "m1").alias("s1"), kind(2, "m2").alias("s2")).where("s1 IS NOT NULL AND s2 IS NOT NULL")
    differ = rows.where("i < m - 1").groupBy(*key).agg((F.avg(F.greatest("hp1", "hp2")) - F.avg(F.least("hp1", "hp2"))).alias("differ"))
    verdict = verdict.join(differ, key).select(*key, ((F.col("s1") < deviation) | (F.col("s2") < deviation)).alias("steady"), (F.col("differ") > apart).alias("wide"))
    gap = F.col("first") - F.lag("last").over(Window.partitionBy(*key, "hp").orderBy("first")) >= stable
    group = F.sum("__new").over(Window.partitionBy(*key, "hp").orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    joined = runs.join(verdict, key).withColumn("__new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("group", group)
    pieces = joined.groupBy(*key, "steady", "wide", "hp", "group").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    bins_of = rows.select(*key, "i", F.col("at"), F.col("to"), "hp1", "hp2")
    within = pieces.join(bins_of, key).where("i BETWEEN first AND last")
    open_end = lambda c: F.coalesce(F.median(F.when((F.col("i") < F.col("last")) & (F.col(c) != 0), F.col(c))), F.lit(0.0))
    out = within.groupBy(*key, "steady", "wide", "hp", "first").agg(F.min("at").alias("start"), F.max("to").alias("end"), open_end("hp1").alias("hp1"), open_end("hp2").alias("hp2"))
    along = Window.partitionBy(*key).orderBy("first")
    out = out.withColumns({"n": F.count("*").over(Window.partitionBy(*key)), "k": F.row_number().over(along)})
    broken = F.col("steady") & F.col("wide") & (F.col("n") > 1)
    start, end = F.when(broken & (F.col("k") == 1), F.col("block")).otherwise(F.col("start")), F.when(broken & (F.col("k") == F.col("n")), F.col("block_end")).otherwise(F.col("end"))
    return out.select(*key, start.alias("start"), end.alias("end"), "hp", "hp1", "hp2", broken.alias("broken"), (~F.col("steady")).alias("unsteady"))


def broken_up(blocks: DataFrame, inside: DataFrame) -> DataFrame:
    """Blocks (chr, start, end, hp1, hp2) with broken ones replaced by their pieces, which have medians of their own."""
    pieces = inside.where("broken")
    whole = pieces.select("chr", F.col("block").alias("start"), F.col("block_end").alias("end")).distinct()
    return blocks.join(whole, ["chr", "start", "end"], "left_anti").select("chr", "start", "end", "hp1", "hp2").unionByName(pieces.select("chr", "start", "end", "hp1", "hp2"))


def regrouped(blocks: DataFrame, broken: DataFrame) -> DataFrame:
    """Blocks that lie within one broken block (chr, start, end) as one block again: chr, start, end."""
    pairs = iv.overlap_join(blocks.select("chr", "start", "end"), broken.select("chr", "start", "end").distinct()).where("start >= r_start AND end <= r_end")
    home = pairs.groupBy("chr", "start", "end").agg(F.min("r_start").alias("home"))
    rows = blocks.select("chr", "start", "end").join(home, ["chr", "start", "end"], "left")
    inner = rows.where("home IS NOT NULL").groupBy("chr", "home").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("home")
    return rows.where("home IS NULL").select("chr", "start", "end").unionByName(inner)


def align_inside(bins: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bins within a block (chr, start, end, hp1, hp2) take the block's order of haplotypes."""
    hit = iv.point_join(bins.select("chr", F.col("start").alias("pos")), blocks.withColumn("hp", dominance(F.col("hp1"), F.col("hp2"))).select("chr", "start", "end", "hp")).groupBy("chr", F.col("pos").alias("start")).agg(F.min("r_hp").alias("__hp"))
    rows = bins.join(hit, ["chr", "start"], "left")
    wrong = ((F.col("__hp") == 1) & (F.col("hp1") < F.col("hp2"))) | ((F.col("__hp") == 2) & (F.col("hp1") > F.col("hp2")))
    return swapped(rows, F.coalesce(wrong, F.lit(False))).drop("__hp")


def blockless(bins: DataFrame, blocks: DataFrame, size: int, least: int = 2) -> DataFrame:
    """Stretches of more than ``least`` bins without a block: before the first block of a contig, between two, behind the
    last one; with the values of the blocks on the left and right (null at the ends) and their own medians.

    A contig with a single block has none at its ends, one without blocks none at all.
    """
    order = Window.partitionBy("chr").orderBy("start", "end")
    value = F.struct("hp1", "hp2")
    none = F.lit(None).cast("struct<hp1:double,hp2:double>")
    rows = blocks.select("chr", "start", "end", value.alias("value"), F.lead("start").over(order).alias("next"), F.lead(value).over(order).alias("right"))
    inner = rows.where(F.col("next") - F.col("end") > least * size).select("chr", (F.col("end") + 1).alias("start"), (F.col("next") - 1).alias("end"), F.col("value").alias("left"), "right")
    along = F.struct("start", "end", value.alias("value"))
    ends = blocks.groupBy("chr").agg(F.count("*").alias("n"), F.min(along).alias("first"), F.max(along).alias("last")).where("n > 1")
    ends = ends.join(bins.groupBy("chr").agg(F.min("start").alias("from"), F.max("start").alias("to")), "chr")
    head = ends.where((F.col("first.start") > F.col("from") + size) & (F.col("first.start") - F.col("from") > least * size)).select("chr", F.col("from").alias("start"), (F.col("first.start") - 1).alias("end"), none.alias("left"), F.col("first.value").alias("right"))
    tail = ends.where(F.col("to") - F.col("last.end") > least * size).select("chr", (F.col("last.end") + 1).alias("start"), F.col("to").alias("end"), F.col("last.value").alias("left"), none.alias("right"))
    gaps = checkpoint(inner.unionByName(head).unionByName(tail))
    return gaps.join(index_medians(bins, gaps, size), ["chr", "start", "end"])


def align_blockless(bins: DataFrame, blocks: DataFrame, size: int, least: int = 2, lost: DataFrame | None = None) -> DataFrame:
    """Stretches without a block (see ``blockless``) are swapped as a whole where their medians ask for it.

    Between two blocks: the blocks have the same larger haplotype and the stretch the other one, or both blocks' first
    haplotype is nearer to the stretch's second one than to its first. At a contig's end: the larger haplotype is not
    that of the only neighbour; there bins in lost regions (chr, start, end) stay.
    """
    larger = lambda a, b: F.signum(a - b)
    left, right, own = (larger(F.col(f"{x}hp1"), F.col(f"{x}hp2")) for x in ("left.", "right.", ""))
    far = lambda side: F.abs(F.col(f"{side}.hp1") - F.col("hp2")) < F.abs(F.col(f"{side}.hp1") - F.col("hp1"))
    against = (left == right) & (left != 0) & (own == -left)
    inner = F.col("left").isNotNull() & F.col("right").isNotNull()
    only = F.coalesce(left, right)
    swap = F.when(inner, against | (far("left") & far("right"))).otherwise((only != 0) & (own == -only))
    turned = blockless(bins, blocks, size, least).where(swap).select("chr", "start", "end", (~inner).alias("outer"))
    hit = iv.point_join(bins.select("chr", F.col("start").alias("pos")), turned).select("chr", F.col("pos").alias("start"), F.col("r_outer").alias("outer"))
    if lost is not None:
        held = iv.point_join(bins.select("chr", F.col("start").alias("pos")), lost.select("chr", "start", "end")).select("chr", F.col("pos").alias("start"), F.lit(True).alias("outer")).distinct()
        hit = hit.join(held, ["chr", "start", "outer"], "left_anti")
    rows = bins.join(hit.select("chr", "start", F.lit(True).alias("__swap")).distinct(), ["chr", "start"], "left")
    return swapped(rows, F.coalesce(F.col("__swap"), F.lit(False))).drop("__swap")


def n50(lengths: DataFrame, rate: float = 0.5) -> DataFrame:
    """The length of the block with which the sum of lengths, longest first, passes ``rate`` of all.

    Lengths are counted first, so the window runs over distinct lengths only.
    """
    counts = lengths.groupBy("length").agg((F.count("*") * F.col("length")).alias("sum"))
    order = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("sum").over(Window.partitionBy())
    return counts.withColumn("so_far", F.sum("sum").over(order)).withColumn("total", total).where(F.col("so_far") > F.col("total") * rate).agg(F.max("length").alias("n50"))


def block_lengths(positions: DataFrame, least: int = 10_000, snps: int = 10) -> DataFrame:
    """Lengths of blocks with enough SNPs."""
    rows = positions.groupBy("chr", "phasesets").agg((F.max("position") - F.min("position")).alias("length"), F.count("*").alias("n"))
    return rows.where((F.col("length") > least) & (F.col("n") >= snps)).select("chr", "phasesets", "length")


def rephase(variants: DataFrame, flip_bins: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame, loh: DataFrame, size: int, least: int = 300_000) -> DataFrame:
    """Variants (chr, pos, gt, ps) with new genotype and phase set.

    A variant takes the start of the new block around it as phase set; one in a short block becomes unphased. Its
    genotype flips where its bin has an odd number of flip events; near a block's start (end) the next (previous)
    bin decides. Unphased 1/1 in a lost region outside of old blocks is phased by the region's haplotype.
    """
    odd = flip_bins.groupBy("chr", bin_index(F.col("start"), size).alias("__bin")).agg((F.count("*") % 2 == 1).alias("odd")).where("odd")
    v = variants.withColumn("__id", F.struct("chr", "pos"))
    within = lambda t, *c: iv.point_join(v.select("chr", "pos"), t).groupBy("chr", "pos").agg(F.min(F.struct("r_start", "r_end", *(f"r_{x}" for x in c))).alias("__hit"))
    new = within(new_blocks.select("chr", "start", "end")).select("chr", "pos", F.col("__hit.r_start").alias("new_start"), F.col("__hit.r_end").alias("new_end"))
    old = within(old_blocks.select("chr", "start", "end")).select("chr", "pos", F.lit(True).alias("in_old"))
    lost = within(loh.select("chr", "start", "end", "hp"), "hp").select("chr", "pos", F.col("__hit.r_start").alias("loh_start"), F.col("__hit.r_hp").alias("loh_hp"))
    rows = v.join(new, ["chr", "pos"], "left").join(old, ["chr", "pos"], "left").join(lost, ["chr", "pos"], "left")
    probe = F.when(F.col("pos") < F.col("new_start") + size, F.col("pos") + size).when(F.col("pos") > F.col("new_end") - size, F.col("pos") - size).otherwise(F.col("pos"))
    rows = rows.withColumn("__bin", bin_index(probe, size)).join(odd, ["chr", "__bin"], "left").na.fill(False, ["odd"])
    short = F.col("new_end") - F.col("new_start") < least
    swapped = F.when(F.col("gt") == "0|1", "1|0").when(F.col("gt") == "1|0", "0|1").otherwise(F.col("gt"))
    phased = F.col("gt").contains("|")
    lost_here = F.col("loh_start").isNotNull() & F.col("in_old").isNull() & (F.col("gt") == "1/1")
    gt = F.when(lost_here, F.when(F.col("loh_hp") == 1, "1|0").otherwise("0|1")).when(phased & short, "0/1").when(phased & F.col("odd"), swapped).otherwise(F.col("gt"))
    ps = F.when(lost_here, F.col("loh_start")).when(phased & F.coalesce(short, F.lit(False)), F.lit(None)).when(phased & F.col("new_start").isNotNull(), F.col("new_start")).otherwise(F.col("ps"))
    return rows.select(*(c for c in variants.columns if c not in ("gt", "ps")), gt.alias("gt"), ps.cast("long").alias("ps"))
