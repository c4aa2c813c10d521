"""Structural variants: filtering, mates, haplotypes, arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.contigs import chr_ord
from strandloom.functions.scalar import mate

#: Support that stands for "the caller does not say".
UNKNOWN_SUPPORT = 999


def info(name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit(";"), F.col("info")), rf";{name}=([^;]*)", 1)


def junctions(variants: DataFrame, contigs: list[str], min_length: int = 10_000, min_support: float = 3.0) -> DataFrame:
    """Pairs of breakpoints from variants (schema VARIANTS): id, svtype, chr1, pos1, chr2, pos2, hp, dv, svlen.

    Insertions and reciprocal inversions are left out; deletions need a length, inversions and duplications have
    any; single breakends pair with the next base; mates come from the bracket notation.
    """
    place = F.array_position(F.split("format", ":"), "DV").cast("int")
    dv = F.coalesce(F.when(place > 0, F.try_element_at(F.split("sample", ":"), place)).try_cast("int"), F.lit(UNKNOWN_SUPPORT))
    svtype, svlen = info("SVTYPE"), F.abs(info("SVLEN").try_cast("bigint"))
    mate_chr, mate_pos = mate(F.col("alt"))
    hp = F.when(F.instr(info("HP"), "|") > 0, info("HP")).otherwise("0|0")
    rows = variants.select("id", "chr", "pos", "filter", svtype.alias("svtype"), svlen.alias("svlen"), dv.alias("dv"), hp.alias("hp"), info("DETAILED_TYPE").alias("detail"), mate_chr.alias("mate_chr"), mate_pos.alias("mate_pos"))
    rows = rows.where((F.col("dv") >= min_support) & (F.col("svtype") != "INS") & ~(F.col("id").contains("INV") & (F.col("detail") == "reciprocal_inv")))
    simple = F.col("svlen").isNotNull() & (F.col("svtype").isin("INV", "DUP") | ((F.col("svtype") == "DEL") & (F.col("svlen") > min_length)))
    single = (F.col("svtype") == "sBND") | F.col("id").contains("sBND")
    paired = (F.col("svtype") == "BND") & (F.col("mate_chr") != "") & F.col("mate_pos").isNotNull() & F.col("mate_chr").isin(contigs)
    chr2 = F.when(simple | single, F.col("chr")).when(paired, F.col("mate_chr"))
    pos2 = F.when(simple, F.col("pos") + F.col("svlen")).when(single, F.col("pos") + 1).when(paired, F.col("mate_pos"))
    out = rows.where(F.col("chr").isin(contigs)).select("id", "svtype", F.col("chr").alias("chr1"), F.col("pos").alias("pos1"), chr2.alias("chr2"), pos2.alias("pos2"), "hp", "dv", "svlen")
    return out.where("chr2 IS NOT NULL")


def ends(pairs: DataFrame) -> DataFrame:
    """Both ends of each pair as rows (id, chr, pos, hp: of that end, dv); a pair of one place is left out."""
    side = lambda k: F.struct(F.col(f"chr{k}").alias("chr"), F.col(f"pos{k}").alias("pos"), F.try_element_at(F.split("hp", r"\|"), F.lit(k)).alias("hp"))
    return pairs.where("NOT (chr1 = chr2 AND pos1 = pos2)").select("id", F.explode(F.array(side(1), side(2))).alias("x"), "dv").select("id", "x.chr", "x.pos", "x.hp", "dv")


def supported(pairs: DataFrame, first_copy: float, rate: float = 0.2, least: float = 3.0) -> DataFrame:
    """Pairs with a support of a share of one copy's depth, and of ``least`` at any rate."""
    return pairs.where(F.col("dv") >= max(first_copy * rate, least))


def trusted_haplotypes(pairs: DataFrame, blocks: DataFrame, lost: DataFrame | None = None, rate: float = 0.3) -> DataFrame:
    """Keeps a pair's haplotypes only if the depths of the blocks (chr, start, end, hp1, hp2) around both ends differ by
    a share of the smaller one, or the end lies in a region that lost a haplotype."""
    points = ends(pairs).select("id", "chr", "pos").distinct()
    key = ["id", "chr", "pos"]
    hit = iv.first_containing(points, blocks.select("chr", "start", "end", "hp1", "hp2"), key)
    one, two = F.col("hit.r_hp1"), F.col("hit.r_hp2")
    good = hit.where(F.abs(one - two) / (F.least(one, two) + 0.0001) > rate).select(*key)
    if lost is not None:
        good = good.union(iv.point_join(points, lost.select("chr", "start", "end")).select(*key))
    good = good.distinct().groupBy("id").agg(F.count("*").alias("__n")).where("__n >= 2").select("id", F.lit(True).alias("__ok"))
    return pairs.join(good, "id", "left").withColumn("hp", F.when(F.col("__ok"), F.col("hp")).otherwise("0|0")).drop("__ok")


def arcs(pairs: DataFrame) -> DataFrame:
    """Pairs with their ends in karyotypic order and the kind of arc, for drawing."""
    a = F.struct(chr_ord(F.col("chr1")).alias("ord"), F.col("chr1").alias("chr"), F.col("pos1").alias("pos"))
    b = F.struct(chr_ord(F.col("chr2")).alias("ord"), F.col("chr2").alias("chr"), F.col("pos2").alias("pos"))
    kind = F.when(F.col("chr1") != F.col("chr2"), "interchromosomal").otherwise(F.col("svtype"))
    return pairs.select("id", F.least(a, b).alias("from"), F.greatest(a, b).alias("to"), kind.alias("kind"), "dv").select("id", F.col("from.chr").alias("chr1"), F.col("from.pos").alias("pos1"), F.col("to.chr").alias("chr2"), F.col("to.pos").alias("pos2"), "kind", "dv")


def arc_curves(arcs_: DataFrame, offsets: DataFrame, n: int = 9, weight: float = 0.5) -> DataFrame:
    """Arcs with ``curve``: n points (x, y) of a rational Bezier curve between their ends along the genome.

    offsets: chr, offset. The control point stands over the middle at the height of an equilateral triangle.
    """
    at = lambda k: offsets.select(F.col("chr").alias(f"chr{k}"), F.col("offset").alias(f"offset{k}"))
    rows = arcs_.join(F.broadcast(at(1)), "chr1").join(F.broadcast(at(2)), "chr2")
    a, b = F.col("pos1") + F.col("offset1"), F.col("pos2") + F.col("offset2")
    rows = rows.withColumns({"x0": a.cast("double"), "x2": b.cast("double"), "x1": (a + b) / 2, "y1": F.abs(b - a) * (3**0.5 / 2)})

    def point(t: Column) -> Column:
        first, middle, last = (1 - t) * (1 - t), 2 * weight * t * (1 - t), t * t
        whole = first + middle + last
        return F.struct(((first * F.col("x0") + middle * F.col("x1") + last * F.col("x2")) / whole).alias("x"), (middle * F.col("y1") / whole).alias("y"))

    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(i / F.lit(float(n - 1))))
    return rows.withColumn("curve", steps).drop("offset1", "offset2", "x0", "x1", "x2", "y1")


def split_blocks(blocks: DataFrame, points: DataFrame, size: int, margin: int = 7) -> DataFrame:
    """Blocks split at breakpoints that lie at least ``margin`` bins from both ends of their block."""
    inner = iv.point_join(points.select("chr", "pos"), blocks.select("chr", "start", "end")).where((F.col("pos") - F.col("r_start") >= margin * size) & (F.col("r_end") - F.col("pos") >= margin * size))
    return iv.split_at(blocks, inner.select("chr", "pos").distinct())
