"""Copy-number states: centers, scores, purity and ploidy, subclonal segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import intervals as iv
from strandloom.functions.contigs import chr_ord
from strandloom.functions.lineage import checkpoint
from strandloom.functions.ordering import beside, numbered
from strandloom.functions.scalar import SENTINEL, bin_index, center_of, dna_purity, snap, two_sided_p, weighted_mean


def centromere_rows(segments: DataFrame, centromeres: DataFrame, how: str = "left_semi") -> DataFrame:
    """Segments that are (left_semi) or are not (left_anti) a centromere: equal end, start equal or one more.

    One row per contig is broadcast.
    """
    c = centromeres.select(F.col("chr").alias("__c"), F.explode(F.array(F.col("start"), F.col("start") + 1)).alias("__s"), F.col("end").alias("__e"))
    return segments.join(F.broadcast(c), (F.col("chr") == F.col("__c")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), how)


def with_centromere_mark(segments: DataFrame, centromeres: DataFrame, name: str) -> DataFrame:
    """The segments with a column that is true where they are a centromere."""
    c = centromeres.select(F.col("chr").alias("__c"), F.explode(F.array(F.col("start"), F.col("start") + 1)).alias("__s"), F.col("end").alias("__e")).distinct()
    same = (F.col("chr") == F.col("__c")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e"))
    return segments.join(F.broadcast(c), same, "left").withColumn(name, F.col("__c").isNotNull()).drop("__c", "__s", "__e")


def mask_centromeres(segments: DataFrame, centromeres: DataFrame) -> DataFrame:
    """Depth and state of centromere segments become the sentinel."""
    hit = centromere_rows(segments, centromeres).select("chr", "start", "end", F.lit(True).alias("__m")).distinct()
    rows = segments.join(F.broadcast(hit), ["chr", "start", "end"], "left")
    masked = F.when(F.col("__m"), F.lit(float(SENTINEL)))
    return rows.withColumns({c: F.coalesce(masked, F.col(c)) for c in ("depth", "state") if c in segments.columns}).select(segments.columns)


def mask_bins(bins: DataFrame, segments: DataFrame, value: str) -> DataFrame:
    """Bins inside masked segments get the sentinel."""
    hit = iv.point_join(bins.select("chr", F.col("start").alias("pos")), segments.where(F.abs("state") == SENTINEL).select("chr", "start", "end")).select("chr", F.col("pos").alias("start"), F.lit(True).alias("__m")).distinct()
    return bins.join(hit, ["chr", "start"], "left").withColumn(value, F.when(F.col("__m"), float(SENTINEL)).otherwise(F.col(value))).drop("__m")


def bin_states(bins: DataFrame, segments: DataFrame, centers: list[float]) -> DataFrame:
    """Bins with the copy number of the first segment that holds their start; 0 where none does."""
    hit = iv.first_containing(bins.select("chr", F.col("start").alias("pos")), segments.select("chr", "start", "end", "state"), ["chr", "pos"])
    states = hit.select("chr", F.col("pos").alias("start"), snap(F.col("hit.r_state"), centers).alias("cn"))
    return bins.join(states, ["chr", "start"], "left").na.fill(0.0, ["cn"])


def without_outliers(df: DataFrame, value: str, by: list[str], fold: float = 5.0) -> DataFrame:
    """Rows within ``fold`` interquartile ranges of the quartiles of their group (linear quantiles).

    Quartiles come from an aggregation and go back by an equi-join, so a large group is never sorted in one task.
    """
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    low, high = F.col("__q")[0], F.col("__q")[1]
    return df.join(q, by).where(F.col(value).between(low - fold * (high - low), high + fold * (high - low))).drop("__q")


def center_pools(bins: DataFrame, segments: DataFrame, value: str) -> DataFrame:
    """For each segment state the mean and median of its bins, outliers left out: state, n, mean, median."""
    pairs = iv.point_join(bins.withColumn("pos", F.col("start")).select("chr", "pos", value), segments.select("chr", "start", "end", "state"))
    trimmed = without_outliers(pairs.select(F.col("r_state").alias("state"), value), value, ["state"])
    return trimmed.groupBy("state").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def unused_centers(pools: DataFrame, centers: list[float]) -> DataFrame:
    """The centers (with their copy number) that no segment's pool has."""
    every = pools.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(centers)], "cn INT, center DOUBLE")
    return every.join(pools.select(F.col("state").cast("int").alias("cn")).distinct(), "cn", "left_anti")


def segment_scores(segments: DataFrame, centers: list[float]) -> DataFrame:
    """Segments with the p-value of their depth's distance to the nearest center as confidence."""
    near = F.array_min(F.transform(F.array(*(F.lit(float(c)) for c in centers)), lambda c, i: F.struct(F.abs(c - F.col("depth")).alias("d"), i.alias("i"), c.alias("c"))))["c"]
    return segments.withColumn("confidence", F.when(F.abs("depth") != SENTINEL, two_sided_p(F.col("depth"), near)))


def genome_score(segments: DataFrame, longest_first: int = 1_000_000, strict: bool = False, bin_size: int = 50_000) -> DataFrame:
    """The genome's confidence: running weighted means of segment p-values by contig, averaged over contigs.

    strict: the length test multiplies the start by the bin size, as files of older runs have it.
    """
    length = F.col("end") - F.col("start") * bin_size if strict else F.col("end") - F.col("start")
    rows = segments.withColumn("counts", (length > longest_first) & (F.col("confidence") > 0))
    weight = F.when(F.col("counts"), F.col("end") - F.col("start")).otherwise(0)
    product = F.when(F.col("counts"), F.bround(F.col("confidence") * weight, 3)).otherwise(0.0)
    sums = rows.groupBy("chr").agg(F.sum(product).alias("p"), F.sum(weight).alias("w")).withColumn("ord", chr_ord(F.col("chr")))
    so_far = Window.orderBy("ord", "chr").rowsBetween(Window.unboundedPreceding, 0)  # one row per contig
    running = sums.withColumns({"p": F.sum("p").over(so_far), "w": F.sum("w").over(so_far)})
    return running.agg(F.avg(F.when(F.col("w") == 0, 0.0).otherwise(F.col("p") / F.col("w"))).alias("confidence"))


def ploidy(segments: DataFrame) -> DataFrame:
    """Length-weighted mean copy number of each haplotype (hp, cn), summed."""
    means = segments.groupBy("hp").agg(weighted_mean(F.col("cn"), F.col("end") - F.col("start")).alias("mean"))
    return means.agg(F.sum("mean").alias("ploidy"))


def grid(spark: SparkSession, limit: float, step: float = 0.1) -> DataFrame:
    """Normal coverages from one step up to the limit."""
    n = max(0, int(np.ceil(limit / step - 1e-9)) - 1)
    return spark.range(1, n + 1).select((F.col("id") * step).alias("normal"))


def purity_grid(segments: DataFrame, grid_rows: DataFrame, copy: float, n_centers: int, tumor: float, least_length: int = 1_000_000, moved: DataFrame | None = None, centromeres: DataFrame | None = None) -> DataFrame:
    """Confidence, ploidy, DNA and cell purity for every normal coverage of a grid, in one aggregation.

    Segments that are a centromere have no copy number of their own, so they are left out of the ploidy.

    segments: chr, start, end, depth, hp. The grid has at most a few hundred rows of one number, known before the
    plan is made, so it is an array in each row rather than the side of a join. Snapping, p-values and the sums by
    contig need one shuffle of (grid, contig) rows. moved (chr, start, hp, normal, depth): depths that depend on the
    normal coverage, in place of a segment's own.
    """
    points = [float(r.normal) for r in grid_rows.collect()]
    rows = segments.withColumn("normal", F.explode(F.array(*(F.lit(p) for p in points)))) if points else segments.withColumn("normal", F.lit(None).cast("double")).where("false")
    if moved is not None:
        rows = rows.join(moved.withColumnRenamed("depth", "__moved"), ["chr", "start", "hp", "normal"], "left").withColumn("depth", F.coalesce("__moved", "depth")).drop("__moved")
    rows = rows.withColumn("__out", F.lit(False)) if centromeres is None else with_centromere_mark(rows, centromeres, "__out")
    raw = (F.col("depth") - F.col("normal")) / copy
    cn = F.greatest(F.lit(0.0), F.bround(F.abs(raw))) if n_centers > 1 else F.lit(0.0)
    cn = F.when(F.col("depth") < F.col("normal"), 0.0).otherwise(cn)
    near = F.col("normal") + cn * copy
    length = F.col("end") - F.col("start")
    p = two_sided_p(F.col("depth"), near)
    counts = (length > least_length) & (p > 0)
    rows = rows.select("normal", "chr", F.when(~F.col("__out"), F.col("hp")).alias("hp"), length.alias("w"), cn.alias("cn"), F.when(counts, F.bround(p * length, 3)).otherwise(0.0).alias("pw"), F.when(counts, length).otherwise(0).alias("wp"))
    by_contig = rows.groupBy("normal", "chr").agg(
        F.sum("pw").alias("pw"), F.sum("wp").alias("wp"),
        *(F.sum(F.when(F.col("hp") == h, F.bround(F.col("cn") * F.col("w"), 3))).alias(f"c{h}") for h in (1, 2)),
        *(F.sum(F.when(F.col("hp") == h, F.col("w"))).alias(f"w{h}") for h in (1, 2)),
    ).withColumn("ord", chr_ord(F.col("chr")))
    so_far = Window.partitionBy("normal").orderBy("ord", "chr").rowsBetween(Window.unboundedPreceding, 0)
    running = by_contig.withColumn("score", F.coalesce(F.try_divide(F.sum("pw").over(so_far), F.sum("wp").over(so_far)), F.lit(0.0)))
    mean = lambda h: F.coalesce(F.try_divide(F.sum(f"c{h}"), F.sum(f"w{h}")), F.lit(0.0))
    out = running.groupBy("normal").agg(F.avg("score").alias("confidence"), (mean(1) + mean(2)).alias("ploidy")).where("ploidy >= 0.1")
    diploid = F.col("normal") * 2
    tumor_cells = (F.lit(tumor) - diploid) / F.col("ploidy")
    return out.select("normal", "confidence", "ploidy", dna_purity(F.lit(tumor), diploid).alias("dna_purity"), (tumor_cells / (diploid / 2 + tumor_cells)).alias("cell_purity"))


def in_range(solutions: DataFrame, purity: tuple[float, float] = (0.25, 1.0), ploidy_: tuple[float, float] = (1.0, 5.5), column: str = "cell_purity") -> DataFrame:
    return solutions.where(F.col(column).between(*purity) & F.col("ploidy").between(*ploidy_))


def score_peaks(solutions: DataFrame) -> DataFrame:
    """Of the rows of a grid (ord, confidence), the local maxima of the confidence.

    Runs of equal confidence count as one row. A row is a maximum if its confidence is that of any run above both of
    its neighbours; the first row is one if the confidence falls there. Of maxima side by side every second one
    stays.
    """
    rows = checkpoint(beside(numbered(solutions, [F.asc("ord")], "at"), "at", "confidence", "before", "next"))
    runs = numbered(rows.where("before IS NULL OR before <> confidence").select("at", "confidence"), [F.asc("at")], "place")
    tops = beside(runs, "place", "confidence", "left", "right").where("left < confidence AND confidence > right").select(F.col("confidence").alias("top")).distinct()
    found = rows.join(tops, F.col("confidence") == F.col("top"), "left").where("top IS NOT NULL OR (before IS NULL AND (next IS NULL OR confidence > next))")
    # places side by side differ from their number by the same
    side = numbered(found, [F.asc("at")], "nth").withColumn("run", F.col("at") - F.col("nth"))
    first = side.groupBy("run").agg(F.min("at").alias("first"))
    return side.join(first, "run").where((F.col("at") - F.col("first")) % 2 == 0).select(*solutions.columns)


def ranked(solutions: DataFrame) -> DataFrame:
    """Solutions with their rank by confidence; ties keep the order of ``ord``."""
    return numbered(solutions, [F.desc("confidence"), F.asc("ord")], "solution_rank")


def pivot_scores(solutions: DataFrame) -> DataFrame:
    """Mean confidence by purity (rows) and ploidy (columns), both to 2 digits; gaps take the least value."""
    rows = solutions.select(F.bround("cell_purity", 2).alias("purity"), F.format_number(F.bround("ploidy", 2), 2).alias("p"), "confidence")
    wide = rows.groupBy("purity").pivot("p").agg(F.avg("confidence"))
    least = rows.agg(F.min("confidence").alias("least"))
    names = [c for c in wide.columns if c != "purity"]
    return wide.join(F.broadcast(least)).select("purity", *(F.coalesce(F.col(f"`{c}`"), F.col("least")).alias(c) for c in names))


def segment_bins(segments: DataFrame, bins: DataFrame, value: str, size: int) -> DataFrame:
    """(chr, start, value): the bins of each segment, from that of its start up to that of its end (excluded)."""
    spans = segments.select("chr", bin_index(F.col("start"), size).alias("start"), (bin_index(F.col("end"), size) - 1).alias("end"), F.col("start").alias("from")).where("end >= start")
    return iv.point_join(bins.select("chr", bin_index(F.col("start"), size).alias("pos"), F.col(value).alias("value")), spans, bucket=64).select("chr", F.col("r_from").alias("start"), "value")


def pool_means(tracks: dict[int, DataFrame], bins: DataFrame, centers: list[float], size: int) -> list[float]:
    """For each center the mean of the bins of both haplotypes' segments whose state it is, outliers left out; the
    center itself where there are fewer than two. What reaches the driver is a number for each center."""
    pooled = None
    for hp, segments in tracks.items():
        rows = segment_bins(segments, bins, f"hp{hp}", size).join(segments.select("chr", "start", center_of(F.col("state"), centers).alias("center")), ["chr", "start"]).select("center", "value")
        pooled = rows if pooled is None else pooled.unionByName(rows)
    counts = pooled.groupBy("center").agg(F.count("*").alias("n"))
    means = without_outliers(pooled, "value", ["center"]).groupBy("center").agg(F.avg("value").alias("mean")).join(counts, "center").where(F.col("n") >= 2)
    found = {r.center: r["mean"] for r in means.where(F.col("center").isin([float(c) for c in centers])).collect()}
    return [found.get(float(c), float(c)) for c in centers]


def subclonal(tracks: dict[int, DataFrame], bins: DataFrame, centers: list[float], size: int, threshold: float = 0.6, gap: float = 2.0) -> dict[int, DataFrame]:
    """Segments (chr, start, end, state) of each haplotype with depth, state, confidence and is_subclonal.

    The depth is the median of a segment's bins without outliers, the confidence the p-value of its distance to the
    nearest pool mean. A segment below the threshold keeps its depth as state, others their center; those above the
    last center are as they are. Neighbours that all keep their depths, none of which stands off by more than
    ``gap`` from the next in size, share the median of all but the last of them.
    """
    bins, tracks = checkpoint(bins), {hp: checkpoint(t) for hp, t in tracks.items()}  # each is read several times
    means = pool_means(tracks, bins, centers, size)
    out = {}
    for hp, segments in tracks.items():
        inside = without_outliers(segment_bins(segments, bins, f"hp{hp}", size), "value", ["chr", "start"]).groupBy("chr", "start").agg(F.median("value").alias("seen"))
        rows = segments.select("chr", "start", "end", center_of(F.col("state"), centers).alias("state")).join(inside, ["chr", "start"], "left").na.fill(0.0, ["seen"])
        near = F.array_min(F.transform(F.array(*(F.lit(m) for m in means)), lambda m, i: F.struct(F.abs(m - F.col("seen")).alias("d"), i.alias("i"), m.alias("m"))))["m"]
        high = F.col("state") > float(centers[-1])
        rows = rows.withColumn("confidence", F.when(high, 1.0).otherwise(two_sided_p(F.col("seen"), near)))
        rows = rows.withColumn("is_subclonal", ~high & (F.col("confidence") < threshold)).withColumn("depth", F.when(high, F.col("state")).otherwise(F.col("seen")))
        rows = rows.withColumn("state", F.when(F.col("is_subclonal"), F.col("seen")).otherwise(F.col("state")))
        rows = rows.withColumn("own", F.col("is_subclonal") & ~F.col("state").isin([float(c) for c in centers]) & (F.col("state") <= float(centers[-1])))
        numbered = iv.runs(rows, "own")
        run = Window.partitionBy("chr", "run")
        off = F.col("depth") - F.lag("depth").over(run.orderBy("depth", "start")) > gap
        own = numbered.where("own").withColumns({"n": F.count("*").over(run), "last": F.max("start").over(run), "off": F.coalesce(off, F.lit(False))})
        own = own.withColumn("apart", F.max("off").over(run)).where("n > 1 AND NOT apart")
        shared = without_outliers(own.where("start < last").select("chr", "run", "state"), "state", ["chr", "run"]).groupBy("chr", "run").agg(F.median("state").alias("shared"))
        rows = numbered.join(shared, ["chr", "run"], "left").withColumn("shared", F.when(F.col("own"), F.col("shared")))
        state, depth = F.coalesce("shared", "state"), F.coalesce("shared", "depth")
        out[hp] = rows.select("chr", "start", "end", F.bround(depth, 2).alias("depth"), F.greatest(F.signum(state) * F.floor(F.abs(state)), F.lit(float(int(centers[0])))).alias("state"), "confidence", "is_subclonal")
    return out


def move_normal(bins: DataFrame, loh: DataFrame, normal: float, size: int) -> DataFrame:
    """In lost regions (chr, start, end, hp) the normal cells' coverage moves from the kept haplotype to the other."""
    spans = loh.select("chr", bin_index(F.col("start"), size).alias("start"), (bin_index(F.col("end"), size) - 1).alias("end"), "hp").where("end >= start")
    hit = iv.point_join(bins.withColumn("pos", bin_index(F.col("start"), size)), spans, bucket=64).groupBy("chr", F.col("pos")).agg(F.count_if(F.col("r_hp") == 1).alias("one"), F.count_if(F.col("r_hp") != 1).alias("two"))
    rows = bins.withColumn("pos", bin_index(F.col("start"), size)).join(hit, ["chr", "pos"], "left").drop("pos")
    first, second = F.coalesce(F.col("one"), F.lit(0)) > 0, F.coalesce(F.col("two"), F.lit(0)) > 0
    less = lambda c: F.greatest(F.col(c) - normal, F.lit(0.0))
    hp1 = F.when(first, less("hp1")).when(second, F.col("hp1") + normal).otherwise(F.col("hp1"))
    hp2 = F.when(first, F.col("hp2") + normal).when(second, less("hp2")).otherwise(F.col("hp2"))
    return rows.withColumns({"hp1": hp1, "hp2": hp2}).drop("one", "two")


def segment_medians(segments: DataFrame, bins: DataFrame, value: str, size: int, least: float = -1.0) -> DataFrame:
    """Segments with the median of their bins (from start // B to end // B, excluded) above ``least`` as state."""
    medians = segment_bins(segments, bins, value, size).groupBy("chr", "start").agg(F.coalesce(F.median(F.when(F.col("value") > least, F.col("value"))), F.lit(0.0)).alias("__state"))
    return segments.join(medians, ["chr", "start"], "left").withColumn("state", F.coalesce("__state", F.lit(0.0))).drop("__state").select(segments.columns)


def gene_states(genes: DataFrame, one: DataFrame, two: DataFrame, centers: list[float]) -> DataFrame:
    """Genes with the state of the first segment of each haplotype that holds their start; 0 where none does."""
    out = genes.withColumn("pos", F.col("start"))
    for hp, segments in ((1, one), (2, two)):
        hit = iv.first_containing(genes.select("chr", "gene", F.col("start").alias("pos")), segments.select("chr", "start", "end", "state"), ["chr", "gene"])
        out = out.join(hit.select("chr", "gene", F.col("hit.r_state").alias(f"adjusted_coverage_hp{hp}")), ["chr", "gene"], "left")
    out = out.na.fill(0.0, ["adjusted_coverage_hp1", "adjusted_coverage_hp2"]).drop("pos")
    return out.withColumns({f"copynumber_hp{hp}_state": snap(F.col(f"adjusted_coverage_hp{hp}"), centers) for hp in (1, 2)})


def coverage_histogram(segments: DataFrame, parts: int = 100) -> tuple[np.ndarray, float, float]:
    """Weighted histogram of segment coverages from 0 to twice their median: counts, width, weighted mean.

    Two aggregations; what reaches the driver is ``parts`` numbers.
    """
    stats = segments.agg(F.percentile("coverage", F.lit(0.5)).alias("median"), weighted_mean(F.col("coverage"), F.col("length")).alias("mean")).first()
    width = float(stats["median"] or 0) * 2 / parts
    out = np.zeros(parts)
    if width:
        for r in segments.groupBy(F.floor(F.col("coverage") / width).cast("int").alias("b")).agg(F.sum("length").alias("w")).where(f"b BETWEEN 0 AND {parts}").collect():
            out[min(r.b, parts - 1)] += float(r.w)
    return out, width, float(stats["mean"] or 0)


def smooth_cubic(x: np.ndarray) -> np.ndarray:
    """Five-point cubic least squares smoothing, ends fitted by the polynomial of the first and last five points."""
    if len(x) < 5:
        return x.astype(float)
    t = np.arange(-2.0, 3.0)
    fit = np.linalg.pinv(np.vander(t, 4))
    mid = np.convolve(x, (np.vander([0.0], 4) @ fit)[0][::-1], "valid")
    head, tail = np.vander(t[:2], 4) @ fit @ x[:5], np.vander(t[3:], 4) @ fit @ x[-5:]
    return np.concatenate([head, mid, tail])


def peaks_of(x: np.ndarray, distance: int = 5) -> dict[int, float]:
    """Local maxima at least ``distance`` apart, higher ones first, with their prominences."""
    tops = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1]]
    kept: list[int] = []
    for i in sorted(tops, key=lambda i: -x[i]):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = {}
    for i in sorted(kept):
        higher_left = next((j for j in range(i - 1, -1, -1) if x[j] > x[i]), -1)
        higher_right = next((j for j in range(i + 1, len(x)) if x[j] > x[i]), len(x))
        out[i] = float(x[i] - max(x[higher_left + 1 : i + 1].min(), x[i:higher_right].min()))
    return out


def single_copy_coverage(histogram: np.ndarray, width: float, mean: float, haplotypes: int = 1) -> tuple[float, float | None]:
    """Coverage of one copy, and an alternative, from the peaks of the histogram's autocorrelation.

    Without a local minimum below the mean coverage, or without a peak that stands out, the histogram's maximum is
    taken. About a hundred numbers, so this runs on the driver.
    """
    observed = histogram.copy()
    observed[0] = 0
    observed = smooth_cubic(observed)
    fallback = float(np.argmax(observed)) * width / haplotypes
    corr = smooth_cubic(np.correlate(observed, observed, "full")[len(observed) - 1 :])
    minima = [i for i in range(1, len(corr) - 1) if corr[i] < corr[i - 1] and corr[i] < corr[i + 1]]
    if not minima or minima[0] * width >= mean:
        return fallback, None
    least = float(np.argmax(observed)) / haplotypes * 0.25
    tops = {i: p for i, p in peaks_of(corr).items() if i > max(minima[0], least) and p / corr[i] > 0.25}
    if not tops:
        return fallback, None
    best = max(tops, key=lambda i: corr[i])
    height = max(corr[best] * 0.5, corr[minima[0] :].max() * 0.2)
    high = [i for i in sorted(tops) if corr[i] > height]
    if not high:
        return fallback, None
    return best * width, None if high[0] == best else high[0] * width


def centers_up_to(copy: float, highest: float) -> list[float]:
    return [i * copy for i in range(int(highest // copy + 1) + 1)] if copy > 0 else [0.0]
