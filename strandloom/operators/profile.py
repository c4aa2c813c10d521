"""Copy-number profiles: alignment of haplotypes, breakpoint ids, VCF records, older files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.scalar import cna_alt, cna_genotype, cna_type

TRACK = ("coverage", "copynumber_state", "confidence")


def align(one: DataFrame, two: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """Segments of two haplotypes (chr, start, end, TRACK) cut at each other's boundaries, side by side.

    Values are carried from each segment's start to its end by windows over the boundaries, so there is one sort
    per contig and no range join; a side without a segment has zeros. Segments of a haplotype don't overlap.
    """
    columns = (*TRACK, *optional)
    value = F.struct(*columns)

    def events(t: DataFrame, side: str) -> DataFrame:
        t = t.where("end > start")
        other = "b" if side == "a" else "a"
        starts = t.select("chr", F.col("start").alias("at"), F.struct("end", value.alias("v")).alias(side))
        nothing = F.lit(None).cast(starts.schema[side].dataType)
        stops = t.select("chr", F.col("end").alias("at"), nothing.alias(side))
        return starts.unionByName(stops).withColumn(other, nothing)

    rows = events(one, "a").unionByName(events(two, "b")).groupBy("chr", "at").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    along = Window.partitionBy("chr").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("chr", F.col("at").alias("start"), F.lead("at").over(along).alias("end"), F.last("a", True).over(so_far).alias("a"), F.last("b", True).over(so_far).alias("b"))
    alive = lambda s: F.when(F.col(f"{s}.end") > F.col("start"), F.col(f"{s}.v"))
    rows = rows.select("chr", "start", "end", alive("a").alias("a"), alive("b").alias("b")).where("end IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL)")
    out = ["chr", "start", "end"]
    for side, hp in (("a", "hp1"), ("b", "hp2")):
        out += [F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0)).alias(f"{hp}_{c}") for c in TRACK]
    for c in optional:
        if c == "is_subclonal":
            out += [F.coalesce(F.col(f"{s}.{c}"), F.lit("N")).alias(f"{hp}_{c}") for s, hp in (("a", "hp1"), ("b", "hp2"))]
        else:
            empty = F.array().cast("array<string>")
            out.append(F.array_join(F.array_sort(F.array_union(F.coalesce(F.col(f"a.{c}"), empty), F.coalesce(F.col(f"b.{c}"), empty))), ";").alias(c))
    return rows.select(*out)


#: Ids in a batch of rows.
BATCH = 1 << 20


def _ids_of_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a group of ``side_by_side``: the ids of the points of each span. Points are sorted by id once, so what a span takes is sorted."""
    t = pa.Table.from_batches(list(batches))
    spans, points = t.filter(pc.is_valid(t["start"])), t.filter(pc.and_(pc.is_valid(t["pos"]), pc.is_valid(t["id"]))).sort_by("id")
    start, end, pos, ids = spans["start"].to_numpy(), spans["end"].to_numpy(), points["pos"].to_numpy(), points["id"].combine_chunks()
    number = pc.rank(ids, tiebreaker="dense").to_numpy() if len(ids) else np.empty(0, "uint64")  # equal ids are neighbours
    twice = len(number) > 0 and number[-1] < len(number)

    segments = spans["__row"].combine_chunks()

    def batch(first: int, last: int, found: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype("int32")
        taken = pa.ListArray.from_arrays(pa.array(offsets), ids.take(pa.array(np.concatenate(found))))
        return pa.RecordBatch.from_arrays([segments.slice(first, last - first), taken], names=["__row", "svs_breakpoints_ids"])

    found, first, size = [], 0, 0
    for i in range(len(start)):
        at = np.flatnonzero((pos >= start[i]) & (pos <= end[i]))
        if twice and len(at):
            at = at[np.concatenate([[True], number[at[1:]] != number[at[:-1]]])]
        found.append(at)
        size += len(at)
        if size >= BATCH or i + 1 == len(start):
            yield batch(first, i + 1, found)
            found, first, size = [], i + 1, 0


def with_breakpoint_ids(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Adds svs_breakpoints_ids: sorted ids of the breakpoints (chr, pos, id) from start to end, both included.

    Only the result has a row or element for each pair of a segment and a breakpoint; nothing of that size is shuffled.
    """
    from strandloom.functions.intervals import side_by_side

    proper = F.coalesce((F.col("end") >= F.col("start")) & F.col("chr").isNotNull(), F.lit(False))
    row = F.struct(*segments.columns)
    spans = segments.where(proper).select("chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), row.alias("__row"))
    near = side_by_side(points.select("chr", F.col("pos").cast("long").alias("pos"), "id").where("pos IS NOT NULL"), spans, "pos")
    kind = T.StructType([spans.schema["__row"], T.StructField("svs_breakpoints_ids", T.ArrayType(T.StringType()))])
    held = near.groupBy("chr", "__k", "__b").applyInArrow(_ids_of_spans, kind).select("__row.*", "svs_breakpoints_ids")
    return held.unionByName(segments.where(~proper).withColumn("svs_breakpoints_ids", F.array().cast("array<string>")))


def merged_old(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two older files of one haplotype each (as ``read_profile`` reads them) as one profile.

    Their breakpoint ids are written as a set of quoted names, their subclonal column is ``if_subclonal``.
    """
    if set(one.columns) != set(two.columns):
        raise ValueError("the files of both haplotypes have different columns")
    optional = []
    for name, old in (("is_subclonal", "if_subclonal"), ("svs_breakpoints_ids", "svs_breakpoints_ids")):
        if old in one.columns:
            optional.append(name)
    ids = F.regexp_extract_all("svs_breakpoints_ids", F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1))
    value = {"is_subclonal": F.col("if_subclonal").alias("is_subclonal") if "if_subclonal" in one.columns else None, "svs_breakpoints_ids": F.coalesce(ids, F.array().cast("array<string>")).alias("svs_breakpoints_ids")}
    sides = [t.select("chr", "start", "end", *TRACK, *(value[n] for n in optional)) for t in (one, two)]
    return align(sides[0], sides[1], tuple(optional))


def vcf_records(profile: DataFrame) -> DataFrame:
    """Profile rows whose states are not both 1, as VCF records."""
    one, two = F.col("hp1_copynumber_state"), F.col("hp2_copynumber_state")
    rows = profile.where(~((F.bround(one) == 1) & (F.bround(two) == 1)) & (F.abs(one) != 3300) & (F.abs(two) != 3300))
    text = lambda c: F.format_string("%.2f", c)
    sample = F.concat_ws(":", cna_genotype(one, two), (F.bround(one) + F.bround(two)).cast("int").cast("string"), F.bround(one).cast("int").cast("string"), F.bround(two).cast("int").cast("string"), text(F.col("hp1_confidence")), text(F.col("hp2_confidence")), text(F.col("hp1_coverage")), text(F.col("hp2_coverage")))
    svlen = (F.col("end") - F.col("start")).cast("string")
    bps = F.col("svs_breakpoints_ids") if "svs_breakpoints_ids" in profile.columns else F.lit("")
    kind = cna_type(one, two)
    return rows.select(
        "chr", F.col("start").alias("pos"), F.concat_ws("_", F.lit("CNV"), kind, "chr", F.col("start").cast("string")).alias("id"), F.lit("N").alias("ref"), cna_alt(one, two).alias("alt"),
        F.lit(1000).alias("qual"), F.lit("PASS").alias("filter"),
        F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN="), svlen, F.lit(";END="), F.col("end").cast("string"), F.lit(";BPS="), bps).alias("info"),
        F.lit("GT:TCN:CN1:CN2:CNQ1:CNQ2:COV1:COV2").alias("format"), sample.alias("sample"),
    )


def highest_level(segments: DataFrame, copy: float, size: int, least_bins: int = 10) -> DataFrame:
    """Upper limit of a plot: the largest depth among segments of some length, and one copy more."""
    return segments.where((F.col("end") - F.col("start") >= least_bins * size) & (F.abs("depth") != 3300)).agg((F.coalesce(F.max("depth"), F.lit(0.0)) + copy).alias("limit"))
