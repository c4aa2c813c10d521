"""Coverage: histograms, bins, SNP depth on bins and blocks, outliers, smoothing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.lineage import checkpoint
from strandloom.functions.scalar import bin_index, median_nonzero

WINDOW = 500
#: Blocks of SNPs in spans, as times the width of the spans; different spans of which the values are broadcast.
WIDE, FEW = 4, 100_000


def histogram(segments: DataFrame, keys: tuple[str, ...] = ("genome_id", "hp", "chr"), window: int = WINDOW) -> DataFrame:
    """Segments (keys, start, end) counted per window of both ends; windows without segments are left out.

    Each segment is two events, so a long one costs as much as a short one; partial sums are made before the
    shuffle, and only windows in which a depth changes are sorted before they are spread out again.
    """
    first, last = bin_index(F.col("start"), window), bin_index(F.col("end"), window)
    events = segments.select(*keys, F.explode(F.array(F.struct(first.alias("at"), F.lit(1).alias("d")), F.struct((last + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(*keys, "e.at").agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy(*keys).orderBy("at")
    levels = steps.select(*keys, "at", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lead("at").over(along).alias("until"))
    spread = levels.where("depth > 0").withColumn("win", F.explode(F.sequence("at", F.col("until") - 1)))
    return spread.select(*keys, "win", "depth")


def bin_coverage(hist: DataFrame, bins: DataFrame, window: int = WINDOW, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean window depth of each bin as hp1, hp2 and hp3 (unphased): windows of both ends count, missing ones as 0.

    Depths are summed up to both ends of a bin (keys, chr, start, end), so a long bin costs as much as a short one.
    """
    first, last = bin_index(F.col("start"), window), bin_index(F.col("end"), window)
    sides = {"hp1": 1, "hp2": 2, "hp3": 0}
    events = hist.select(*keys, "chr", F.col("win").alias("at"), *(F.when(F.col("hp") == h, F.col("depth")).otherwise(0).cast("long").alias(c) for c, h in sides.items()))
    sums = iv.with_totals(bins.select(*keys, "chr", "start", "end"), events, first, last + 1, (*keys, "chr"))
    n = F.floor(F.col("end") / window) - F.floor(F.col("start") / window) + 1
    inside = lambda c: F.coalesce(F.when(last >= first, F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0))
    return sums.select(*keys, "chr", "start", "end", *(F.bround(inside(c) / n, 2).alias(c) for c in sides))


def snp_bin_mean(snps: DataFrame, bins: DataFrame, size: int, values: tuple[str, ...] = ("hp1", "hp2")) -> DataFrame:
    """Mean depth of the SNPs of each bin, 0 where a bin has none."""
    means = snps.groupBy("chr", bin_index(F.greatest(F.col("pos") - 1, F.lit(0)), size).alias("bin_idx")).agg(*(F.avg(v).alias(v) for v in values))
    return bins.join(means, ["chr", "bin_idx"], "left").na.fill(0.0, list(values))


def _nearest(pos: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The index of the place nearest to each of others in a sorted array, ties to the lower one."""
    up = np.searchsorted(pos, at)
    low, high = np.maximum(up - 1, 0), np.minimum(up, len(pos) - 1)
    return np.where((up < len(pos)) & ((up == 0) | (pos[high] - at < at - pos[low])), up, low)


def _of_spans(values: tuple[str, ...], zeros: bool) -> Callable:
    """For a group of ``side_by_side`` and the SNPs around it: the mean or median of a slice of the SNPs for each of its spans."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        spans, snps = t.filter(pc.is_valid(t["start"])), t.filter(pc.is_valid(t["pos"])).sort_by("pos")
        start, end = (spans[c].to_numpy() for c in ("start", "end"))
        pos = snps["pos"].to_numpy()
        low, high = (_nearest(pos, at) if len(pos) else np.zeros(len(at), np.int64) for at in (start, end))
        out = []
        for v in values:
            x = snps[v].cast(pa.float64())
            known = pc.is_valid(x).to_numpy()
            x = x.to_numpy()
            if not zeros:
                known &= x != 0
            before, x = np.concatenate([[0], np.cumsum(known)]), x[known]  # what counts, and how much of it stands before an SNP
            a, b = before[low], before[high]
            how = np.mean if zeros else np.median
            out.append(pa.array([how(x[i:j]) if j > i else (None if zeros else 0.0) for i, j in zip(a, b)], pa.float64()))
        names = ("chr", "start", "end", *values)
        return pa.Table.from_arrays([pa.repeat(key[0], len(spans)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), *out], names=names)

    return run


def _around(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The last point before and the first one behind those in each group of ``side_by_side``, as further points of the group.

    Blocks of groups are whole pieces of 2^16 places, so the first and the last point of each piece are all that is sorted.
    """
    piece = 1 << 16
    point = F.struct(*(c for c in points.columns if c != "chr"))
    ends = points.groupBy("chr", (F.floor(F.col("pos") / piece) * piece).cast("long").alias("at")).agg(F.max(point).alias("last"), F.min(point).alias("first"))
    width = F.pow(F.lit(2.0), "__k").cast("long")
    sides = F.array(F.struct((F.col("__b") * WIDE * width).alias("at"), F.lit(True).alias("low")), F.struct(((F.col("__b") + 1) * WIDE * width + width).alias("at"), F.lit(False).alias("low")))
    groups = spans.select("chr", "__k", "__b").distinct().select("chr", "__k", "__b", F.explode(sides).alias("s")).select("chr", "__k", "__b", "s.*")
    along = Window.partitionBy("chr").orderBy("at")
    before, behind = F.max("last").over(along.rangeBetween(Window.unboundedPreceding, -1)), F.min("first").over(along.rangeBetween(0, Window.unboundedFollowing))
    rows = groups.unionByName(ends, allowMissingColumns=True).withColumn("p", F.when(F.col("low"), before).otherwise(behind))
    return rows.where("__b IS NOT NULL AND p IS NOT NULL").select("chr", "p.*", "__k", "__b")


def snp_interval_values(snps: DataFrame, intervals: DataFrame, values: tuple[str, ...], zeros: bool) -> DataFrame:
    """Values over the SNPs from the one nearest to an interval's start up to that nearest to its end (excluded).

    zeros: mean of all values (genes), else median of values other than 0 (phase blocks); 0 where there are none. Equal intervals
    share one computation. SNPs are shuffled once beside the spans that hold them, with a quarter of them twice; the nearest
    ones are sought there. So neither disk nor memory grows with pairs of a span and a SNP, and intervals are shuffled
    for one join, or not at all where few of them differ.
    """
    points = snps.select("chr", F.col("pos").cast("long").alias("pos"), *values).where("chr IS NOT NULL AND pos IS NOT NULL")
    spans = intervals.select("chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("chr IS NOT NULL AND end > start").distinct()
    schema = ", ".join(["chr STRING, start BIGINT, end BIGINT", *(f"{v} DOUBLE" for v in values)])
    near = iv.side_by_side(points, spans, "pos", wide=WIDE)
    near = near.unionByName(_around(points, iv.span_blocks(spans, wide=WIDE)), allowMissingColumns=True)
    found = checkpoint(near.groupBy("chr", "__k", "__b").applyInArrow(_of_spans(values, zeros), schema))
    rows = intervals.drop(*values).join(F.broadcast(found) if found.count() <= FEW else found, ["chr", "start", "end"], "left")
    return rows.na.fill(0.0, list(values)).select(*(c for c in intervals.columns if c not in values), *values)


def interval_bin_median(bins: DataFrame, intervals: DataFrame, values: tuple[str, ...] = ("hp1", "hp2")) -> DataFrame:
    """Median of values other than 0 over the bins that start within each interval."""
    pairs = iv.point_join(bins.withColumn("pos", F.col("start")), intervals)
    out = pairs.groupBy("chr", F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(*(median_nonzero(F.col(v)).alias(v) for v in values))
    return intervals.select("chr", "start", "end").distinct().join(out, ["chr", "start", "end"], "left").na.fill(0.0, list(values))


def index_medians(bins: DataFrame, intervals: DataFrame, size: int, values: tuple[str, ...] = ("hp1", "hp2")) -> DataFrame:
    """(chr, start, end) with the median of values other than 0 over the bins from that of the start up to that of the
    end (excluded)."""
    spans = intervals.select("chr", bin_index(F.col("start"), size).alias("start"), (bin_index(F.col("end"), size) - 1).alias("end"), F.col("start").alias("from"), F.col("end").alias("to"))
    pairs = iv.point_join(bins.withColumn("pos", bin_index(F.col("start"), size)).select("chr", "pos", *values), spans.where("end >= start"), bucket=64)
    out = pairs.groupBy("chr", F.col("r_from").alias("start"), F.col("r_to").alias("end")).agg(*(median_nonzero(F.col(v)).alias(v) for v in values))
    return intervals.select("chr", "start", "end").distinct().join(out, ["chr", "start", "end"], "left").na.fill(0.0, list(values))


def tame_outliers(df: DataFrame, value: str, fold: float = 10.0, order_by: str = "start") -> DataFrame:
    """A value of more than ``fold`` times the mean of its neighbours becomes that mean; ends mirror; needs 3 rows."""
    order = Window.partitionBy("chr").orderBy(order_by)
    left, right = F.lag(value).over(order), F.lead(value).over(order)
    mean = (F.coalesce(left, right) + F.coalesce(right, left)) / 2
    enough = F.count("*").over(Window.partitionBy("chr")) >= 3
    return df.withColumn(value, F.when(enough & (mean > 0) & (F.col(value) > fold * mean), mean).otherwise(F.col(value)))


def smooth(df: DataFrame, value: str, degree: int = 5, order_by: str = "start") -> DataFrame:
    """Triangle-weighted moving mean with plateaus at both ends; tracks of ``degree`` rows or fewer stay.

    The weights 0 ... degree ... 0 run over the 2 * degree + 1 values from each row on; the first mean stands at
    row degree + degree / 2 and is repeated before it, the last one is repeated behind.
    """
    rank = F.row_number().over(Window.partitionBy("chr").orderBy(order_by)) - 1
    ranked = df.withColumn("__i", rank).withColumn("__n", F.count("*").over(Window.partitionBy("chr")))
    track = Window.partitionBy("chr").orderBy("__i")
    weights = [*range(degree + 1), *range(degree - 1, -1, -1)]
    lead = int(degree + degree / 2)
    # row i shows the mean that starts at clamp(i - lead) + degree
    total = sum((F.lead(value, k).over(track) * w for k, w in enumerate(weights) if w), F.lit(0.0)) / float(sum(weights))
    means = ranked.select("chr", (F.col("__i") - degree).alias("__j"), total.alias("__mean")).where("__j >= 0")
    shown = F.greatest(F.lit(0), F.least(F.col("__i") - lead, F.col("__n") - 3 * degree - 1)).alias("__j")
    out = ranked.select("*", shown).join(means, ["chr", "__j"], "left")
    return out.withColumn(value, F.when((F.col("__n") > 3 * degree) & F.col("__mean").isNotNull(), F.col("__mean")).otherwise(F.col(value))).select(df.columns)


def mean_of_every(df: DataFrame, value: str, n: int = 20, order_by: str = "start") -> DataFrame:
    """Mean of each n consecutive rows."""
    rank = F.row_number().over(Window.partitionBy("chr").orderBy(order_by)) - 1
    return df.withColumn("part", F.floor(rank / n).cast("long")).groupBy("chr", "part").agg(F.avg(value).alias(value))


def window_medians(df: DataFrame, value: str, per: int = 100) -> DataFrame:
    """Medians of windows of consecutive bins other than 0, without the tenth of windows that vary most."""
    order = Window.partitionBy("chr").orderBy("start")
    rows = df.where(F.col(value) != 0).withColumn("part", F.floor((F.row_number().over(order) - 1) / per).cast("long"))
    stats = rows.groupBy("chr", "part").agg(F.median(value).alias("median"), F.stddev_pop(value).alias("deviation"))
    limit = stats.agg(F.percentile("deviation", F.lit(0.9)).alias("limit"))  # one row
    return stats.join(F.broadcast(limit), F.col("deviation") <= F.col("limit")).select("chr", "part", "median")
