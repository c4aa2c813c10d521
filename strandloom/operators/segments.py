"""Segmentation: cut points, change points, variable bins, merging of segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.scalar import bin_index, center_of, median_nonzero


def middle_distance(values: np.ndarray) -> int:
    """Twice the median of the squared distances of all pairs of whole numbers, without making the pairs.

    Distances up to d are counted in the sorted values; bisection finds the smallest d that enough pairs reach.
    """
    x = np.sort(np.asarray(values, np.int64))
    n = len(x)
    pairs = n * (n - 1) // 2
    if not pairs:
        return 0

    def smallest(rank: int) -> int:
        low, high = 0, int(x[-1] - x[0])
        while low < high:
            mid = (low + high) // 2
            if int(np.searchsorted(x, x + mid, "right").sum()) - n * (n + 1) // 2 > rank:
                high = mid
            else:
                low = mid + 1
        return low

    return smallest((pairs - 1) // 2) ** 2 + smallest(pairs // 2) ** 2


class KernelCosts:
    """Costs of segments of a track under a Gaussian kernel, in memory proportional to its length.

    The scale is one over the median squared distance of the whole track. Of each open segment the kernel's sum is
    kept; when the end moves on, only the sums between the new values and those before it are added, by way of the
    distinct values.
    """

    #: Kernel values at hand at a time.
    AT_ONCE = 1 << 20

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        twice = middle_distance(values)
        self.gamma = 2.0 / twice if twice else 1.0
        self.distinct, self.code = np.unique(values, return_inverse=True)
        self.origins, self.sums, self.seen = np.zeros(1, np.int64), np.zeros(1), 0

    def _towards(self, new: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The kernel's sum between each distinct value of the codes and all new values, by code."""
        out = np.zeros(len(self.distinct))
        met = np.unique(codes)
        far, times = np.unique(new, return_counts=True)
        step = max(1, self.AT_ONCE // max(1, len(far)))
        for at in range(0, len(met), step):
            some = met[at : at + step]
            d = (self.distinct[some][:, None] - self.distinct[far][None, :]).astype(float) ** 2
            out[some] = np.exp(-np.clip(self.gamma * d, 1e-2, 1e2)) @ times
        return out

    def __call__(self, origins: np.ndarray, end: int) -> np.ndarray:
        """Costs of [origin, end); ends rise from call to call, and an origin once left out does not come back."""
        sums = np.zeros(len(origins))
        place = np.minimum(np.searchsorted(self.origins, origins), len(self.origins) - 1)
        known = self.origins[place] == origins
        sums[known] = self.sums[place[known]]
        low, new = int(origins[0]), self.code[self.seen : end]
        towards = self._towards(new, self.code[low:end])
        before = np.append(np.cumsum(towards[self.code[low : self.seen]][::-1])[::-1], 0.0)
        sums += 2 * before[origins - low] + towards[new].sum()
        self.origins, self.sums, self.seen = origins.copy(), sums, end
        return (end - origins) - sums / (end - origins)


def pelt(n: int, costs, penalty: float, jump: int, min_size: int) -> list[int]:
    """Ends of the segments of least total cost plus penalty, on a grid of ``jump``, with pruning.

    ``costs`` gives the costs of segments from several origins to one end. A total and an origin are kept for each
    end, and the segments are traced back from the last.
    """
    best, origin = {0: 0.0}, {}
    open_ = np.zeros(1, np.int64)
    for end in [t for t in range(0, n, jump) if t >= min_size] + [n]:
        value = np.array([best[s] for s in open_.tolist()]) + costs(open_, end) + penalty
        tried = end - open_ >= min_size
        if not tried.any():
            continue
        at = int(np.argmin(np.where(tried, value, np.inf)))
        best[end], origin[end] = float(value[at]), int(open_[at])
        open_ = np.append(open_[~tried | (value <= best[end] + penalty)], end)
    out = [n]
    while origin.get(out[-1], 0):
        out.append(origin[out[-1]])
    return out[::-1]


def rbf_points(values: np.ndarray, penalty: float = 10.0, jump: int = 25, min_size: int = 2) -> list[int]:
    """Change points of a track of whole numbers under the Gaussian kernel cost."""
    if len(values) < 2 * min_size:
        return [len(values)]
    return pelt(len(values), KernelCosts(values), penalty, jump, min_size)


def l2_points(values: np.ndarray, penalty: float, jump: int, min_size: int) -> list[int]:
    """Change points of a track under the cost of squared deviations from the mean."""
    x = np.asarray(values, float)
    if not len(x):
        return []
    s, q = np.pad(x.cumsum(), (1, 0)), np.pad((x * x).cumsum(), (1, 0))
    return pelt(len(x), lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a), penalty, max(1, jump), max(1, min_size))


def change_points(bins: DataFrame, size: int, penalty: float = 10.0, jump: int = 25) -> DataFrame:
    """(chr, hp, pos): change points of every track (chr, hp, start, value), its end among them.

    A track is one task, which needs memory for a few numbers a bin: a contig has no more bins than its length over
    their size, whatever the number of reads or samples. The kernel has one scale for the whole track, so a change is
    found alike in short and long ones. Values are taken as whole numbers: the kernel's scale is a median of squared
    differences, which noise below one must not set. A null counts as 0.
    """

    def run(track: pd.DataFrame) -> pd.DataFrame:
        points = rbf_points(track.sort_values("start")["value"].fillna(0).astype(int).to_numpy(), penalty, jump)
        return pd.DataFrame({"chr": track["chr"].iloc[0], "hp": track["hp"].iloc[0], "pos": np.array(points, "int64") * size})

    return bins.select("chr", "hp", "start", "value").groupBy("chr", "hp").applyInPandas(run, "chr string, hp int, pos long")


def coverage_segments(bins: DataFrame, size: int, min_length: int = 5_000_000, jump: int = 1_000_000) -> DataFrame:
    """(chr, length, coverage) of l2 segments of each contig's haplotypes laid end to end; zero bins left out.

    The penalty comes from the genome's median, one number that one aggregation finds.
    """
    rows = bins.select("chr", "start", F.explode(F.array(F.struct(F.lit(1).alias("hp"), F.col("hp1").alias("value")), F.struct(F.lit(2).alias("hp"), F.col("hp2").alias("value")))).alias("x")).select("chr", "start", "x.*").where("value <> 0")
    median = rows.agg(F.median("value").alias("genome_median"))
    rows = rows.join(F.broadcast(median))

    def run(track: pd.DataFrame) -> pd.DataFrame:
        values = track.sort_values(["hp", "start"])["value"].to_numpy()
        penalty = np.log(max(2, len(values))) * float(track["genome_median"].iloc[0]) ** 2
        ends = l2_points(values, penalty, jump // size, min_length // size)
        starts = [0, *ends[:-1]]
        return pd.DataFrame({"chr": track["chr"].iloc[0], "length": [b - a for a, b in zip(starts, ends, strict=True)], "coverage": [float(np.median(values[a:b])) for a, b in zip(starts, ends, strict=True)]})

    return rows.groupBy("chr").applyInPandas(run, "chr string, length long, coverage double")


def thin(points: DataFrame, pos: str = "pos") -> DataFrame:
    """Points without those that stand 1 after the point before, whether that one stays or not."""
    order = Window.partitionBy("chr").orderBy(pos)
    return points.withColumn("__gap", F.col(pos) - F.lag(pos).over(order)).where("__gap IS NULL OR __gap <> 1").drop("__gap")


def first_in_bin(points: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """The first point of each bin; a point on a shared boundary counts for the bin before as well."""
    touched = F.when(F.pmod(F.col(pos), F.lit(size)) == 0, F.array(bin_index(F.col(pos), size), bin_index(F.col(pos), size) - 1)).otherwise(F.array(bin_index(F.col(pos), size)))
    spread = points.select("chr", pos, F.explode(touched).alias("__bin"))
    return spread.groupBy("chr", "__bin").agg(F.min(pos).alias(pos)).select("chr", pos).distinct()


def cut_segments(bins: DataFrame, points: DataFrame, size: int, masked: DataFrame | None = None) -> DataFrame:
    """Segments between cut points with the median of the bins other than 0; masked ones (by their end) get 0.

    bins: chr, start, value. points: chr, pos. Segment rows are closed: each starts one after the end before.
    """
    cuts = thin(points.select("chr", "pos").distinct()).where("pos >= 2")
    order = Window.partitionBy("chr").orderBy("pos")
    before = F.coalesce(F.lag("pos").over(order), F.lit(0))
    segments = cuts.select("chr", before.alias("from"), F.col("pos").alias("end"))
    index = segments.select("chr", "end", bin_index(F.col("from"), size).alias("start"), (bin_index(F.col("end"), size) - 1).alias("last"))
    pairs = iv.point_join(bins.withColumn("pos", bin_index(F.col("start"), size)), index.where("last >= start").select("chr", "start", F.col("last").alias("end"), F.col("end").alias("cut")), bucket=64)
    medians = pairs.groupBy("chr", F.col("r_cut").alias("end")).agg(median_nonzero(F.col("value")).alias("state"))
    out = segments.join(medians, ["chr", "end"], "left").na.fill(0.0, ["state"])
    if masked is not None:
        hit = masked.select("chr", "end", F.lit(True).alias("__m"))
        out = out.join(F.broadcast(hit), ["chr", "end"], "left").withColumn("state", F.when(F.col("__m"), 0.0).otherwise(F.col("state")))
    start = F.when(F.col("from") == 0, F.lit(0)).otherwise(F.col("from") + 1)
    return out.select("chr", start.cast("long").alias("start"), "end", "state")


def route_by_haplotype(breakpoints: DataFrame, hp: int) -> Column:
    """Whether a breakpoint with the haplotype text of its two ends concerns a haplotype; unknown ones concern both."""
    parts = F.split(breakpoints["hp"].cast("string"), r"\|")
    return F.coalesce(F.array_contains(parts, str(hp)) | F.array_contains(parts, "0"), F.lit(True))


def merge_runs(segments: DataFrame, depth: str = "median") -> DataFrame:
    """Neighbours of equal state as one segment; its depth is the median of theirs or that of the first."""
    numbered = iv.runs(segments, "state")
    value = F.median("depth") if depth == "median" else F.min_by("depth", "start")
    return numbered.groupBy("chr", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), value.alias("depth"), F.first("state").alias("state")).drop("run")


def keep_first_disjoint(intervals: DataFrame) -> DataFrame:
    """Greedy: in order of start an interval stays if it starts after the end of the last one that stayed.

    What stays depends on all before, so a contig's intervals fold in one task; they are segments, not reads.
    """

    def run(track: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], -1
        for row in track.sort_values(["start", "end"]).itertuples(index=False):
            if row.start > last or not kept:
                kept.append(row)
                last = row.end
        return pd.DataFrame(kept, columns=track.columns)

    return intervals.groupBy("chr").applyInPandas(run, intervals.schema)


def snap_segments(segments: DataFrame, centers: list[float]) -> DataFrame:
    """Depth keeps the coverage; the state moves to the nearest center."""
    return segments.withColumn("depth", F.col("state")).withColumn("state", center_of(F.col("state"), centers))


def without_lost_zeros(segments: DataFrame, *regions: DataFrame) -> DataFrame:
    """Segments without those of state 0 that overlap a region (chr, start, end): nothing is measured there."""
    zeros = segments.where("state = 0").select("chr", "start", "end")
    out = segments
    for r in regions:
        hit = iv.overlap_join(zeros, r.select("chr", "start", "end"), closed=False, how="left_semi")
        out = out.join(hit.distinct(), ["chr", "start", "end"], "left_anti")
    return out


def variable_bins(contigs: DataFrame, junctions: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """Bins cut at structural variants: pieces between boundaries of junctions and single points, each then cut
    into bins of at most ``size``; rows that occur twice are left out altogether.

    Boundaries are events on a line and pieces come from ``lead``, so no contig is looped over.
    """
    ends = junctions.select("chr", F.explode(F.array("start", "end")).alias("pos")).union(points.select("chr", "pos"))
    edges = contigs.select("chr", F.explode(F.array(F.lit(0).cast("long"), "len")).alias("pos")).union(ends).distinct()
    inside = edges.join(F.broadcast(contigs.select("chr", "len")), "chr").where("pos >= 0 AND pos <= len").select("chr", "pos")
    order = Window.partitionBy("chr").orderBy("pos")
    pieces = inside.select("chr", F.col("pos").alias("from"), F.lead("pos").over(order).alias("to")).where("to > from")
    cut = pieces.select("chr", "from", "to", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("to") - F.col("from")) / size).cast("long") - 1)).alias("k"))
    first = F.col("from") + F.col("k") * size
    start = F.when(first == 0, first).otherwise(first + 1)
    rows = cut.select("chr", start.alias("start"), F.least(first + size, "to").alias("end"))
    return rows.groupBy("chr", "start", "end").count().where("count = 1").drop("count")
