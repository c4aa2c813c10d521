"""Relational operators over genomic intervals, as equi-joins, windows and array expressions.

Range predicates are never joined on alone: both sides get the numbers of the buckets that they touch, the join is
on (chr, bucket), and a pair is kept in the bucket where its overlap begins, so no pair comes twice and nothing
has to be de-duplicated. Where only sums over the other side are asked for, there are no pairs at all: sums up to both
ends of an interval are subtracted (``with_totals``), so the cost doesn't grow with the number of overlaps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of join buckets in base pairs, unless the caller knows the lengths better.
BUCKET = 1_000_000
#: Width of the pieces of a contig in which running aggregates are made.
PIECE = 4096


def fixed_bins(contigs: DataFrame, size: int) -> DataFrame:
    """chr, bin_idx, start, end: [0, B], then [kB + 1, (k + 1)B], the last one cut at the contig's length."""
    n = F.ceil(F.col("len") / F.lit(size)).cast("long")
    rows = contigs.where("len > 0").select("chr", "len", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin_idx"))
    start = F.when(F.col("bin_idx") == 0, 0).otherwise(F.col("bin_idx") * size + 1)
    return rows.select("chr", "bin_idx", start.cast("long").alias("start"), F.least((F.col("bin_idx") + 1) * size, "len").alias("end"))


def _buckets(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    first, last = (F.floor(F.col(c) / F.lit(size)).cast("long") for c in (start, end))
    return df.withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, closed: bool = True, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Pairs of intervals of (chr, start, end) that overlap; right columns get the prefix ``r_``.

    how: inner, left, left_semi or left_anti. A left join of k columns costs one more equi-join by row content.
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    r = _buckets(r, "r_start", "r_end", bucket)
    touch = (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")) if closed else (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    at = (F.col("l.chr") == F.col("r.r_chr")) & (F.col("l.__bucket") == F.col("r.__bucket")) & touch
    columns = left.columns
    l = _buckets(left, "start", "end", bucket)  # noqa: E741
    if how == "inner":
        once = F.floor(F.greatest("start", "r_start") / F.lit(bucket)).cast("long") == F.col("l.__bucket")
        return l.alias("l").join(r.alias("r"), at & once).drop("__bucket")
    # a semi join in the buckets, so that a row which meets many is not multiplied, and one by row content
    hits = l.alias("l").join(r.alias("r"), at, "left_semi").select(*(F.col(c).alias(f"__k_{c}") for c in ("chr", "start", "end"))).distinct()
    same = (F.col("chr") == F.col("__k_chr")) & (F.col("start") == F.col("__k_start")) & (F.col("end") == F.col("__k_end"))
    if how == "left_semi":
        return left.join(hits, same, "left_semi")
    lonely = left.join(hits, same, "left_anti")
    if how == "left_anti":
        return lonely
    inner = overlap_join(left, right, closed, "inner", bucket)
    return inner.select(*columns, *(c for c in inner.columns if c.startswith("r_"))).unionByName(lonely, allowMissingColumns=True)


def point_join(points: DataFrame, intervals: DataFrame, pos: str = "pos", strict: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Points inside intervals (closed, or open if strict); interval columns get the prefix ``r_``."""
    r = _buckets(intervals.select(*(F.col(c).alias(f"r_{c}") for c in intervals.columns)), "r_start", "r_end", bucket)
    p = points.withColumn("__bucket", F.floor(F.col(pos) / F.lit(bucket)).cast("long"))
    inside = (F.col(pos) > F.col("r_start")) & (F.col(pos) < F.col("r_end")) if strict else F.col(pos).between(F.col("r_start"), F.col("r_end"))
    return p.alias("p").join(r.alias("r"), (F.col("p.chr") == F.col("r.r_chr")) & (F.col("p.__bucket") == F.col("r.__bucket")) & inside).drop("__bucket")


def first_containing(points: DataFrame, intervals: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Of the intervals that hold a point the one that starts first.

    An interval can be the first one only behind the largest end of those before it, so each has a range of its own, these
    ranges don't overlap, and a point meets one interval at most.
    """
    hit = F.min(F.struct(*(F.col(c).alias(f"r_{c}") for c in ("start", "end", *(c for c in intervals.columns if c not in ("chr", "start", "end")))))).alias("hit")
    places = intervals.where("end >= start").groupBy("chr", "start", "end").agg(hit)
    own = _before(places, {"end": F.max}, ("chr",), "start", ("start", "end")).where("__before_end IS NULL OR end > __before_end")
    ranges = own.select(F.col("chr").alias("r_chr"), F.greatest("start", "__before_end").alias("__from"), F.col("start").alias("__start"), F.col("end").alias("__to"), F.col("__before_end").alias("__after"), "hit")
    r = _buckets(ranges, "__from", "__to", PIECE)
    p = points.withColumn("__bucket", F.floor(F.col(pos) / F.lit(PIECE)).cast("long"))
    inside = F.col(pos).between(F.col("__start"), F.col("__to")) & (F.col("__after").isNull() | (F.col(pos) > F.col("__after")))
    pairs = p.alias("p").join(r.alias("r"), (F.col("p.chr") == F.col("r.r_chr")) & (F.col("p.__bucket") == F.col("r.__bucket")) & inside)
    return pairs.groupBy(*key).agg(F.min("hit").alias("hit"))


def _before(rows: DataFrame, how: dict[str, Callable], by: Sequence[str], at: str, order: Sequence[str]) -> DataFrame:
    """Adds for each column of ``how`` its aggregate (sum or max) over the rows of a contig before this one, ``__before_<column>``.

    A running window in each piece of a contig, and one over the aggregates of the pieces: no task has a whole contig's rows.
    """
    rows = rows.withColumn("__piece", F.floor(F.col(at) / F.lit(PIECE)).cast("long"))
    inside = Window.partitionBy(*by, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*by, "__piece").agg(*(f(c).alias(f"__whole_{c}") for c, f in how.items()))
    whole = whole.select(*by, "__piece", *(f(f"__whole_{c}").over(pieces).alias(f"__whole_{c}") for c, f in how.items()))
    both = rows.withColumns({f"__before_{c}": f(c).over(inside) for c, f in how.items()}).join(whole, [*by, "__piece"])
    one = lambda c, f: F.greatest(f"__before_{c}", f"__whole_{c}") if f is F.max else F.coalesce(f"__before_{c}", F.lit(0)) + F.coalesce(f"__whole_{c}", F.lit(0))
    return both.select(*rows.columns, *(one(c, f).alias(f"__before_{c}") for c, f in how.items())).drop("__piece")


def with_totals(intervals: DataFrame, events: DataFrame, low: Column, high: Column, by: Sequence[str] = ("chr",)) -> DataFrame:
    """Adds the sums of the columns of ``events`` (by, at and whole numbers) over the events before ``low`` and before ``high``,
    as lo_<column> and hi_<column>. Differences are what lies from low up to high (excluded).
    """
    names = [c for c in events.columns if c not in (*by, "at")]
    keyed = intervals.withColumns({"__lo": low, "__hi": high})
    probes = keyed.select(*by, F.explode(F.array("__lo", "__hi")).alias("at")).withColumn("__probe", F.lit(1))
    rows = events.where("at IS NOT NULL").groupBy(*by, "at").agg(*(F.sum(n).alias(n) for n in names)).unionByName(probes.where("at IS NOT NULL").distinct(), allowMissingColumns=True)
    places = rows.groupBy(*by, "at").agg(*(F.sum(n).alias(n) for n in names), F.max("__probe").alias("__probe"))
    sums = _before(places, {n: F.sum for n in names}, by, "at", ("at",)).where("__probe = 1")
    for side in ("lo", "hi"):
        keyed = keyed.join(sums.select(*by, F.col("at").alias(f"__{side}"), *(F.col(f"__before_{n}").alias(f"{side}_{n}") for n in names)), [*by, f"__{side}"], "left")
    return keyed.select(*intervals.columns, *(f"{side}_{n}" for side in ("lo", "hi") for n in names))


def overlap_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds to the intervals of ``left`` (closed, whole numbers) how many of ``right`` overlap them (n) and the sum of what is shared.

    With starts and ends of ``right`` counted and summed up to a place, this is arithmetic on both ends of an interval. Intervals
    that end before they start don't fit it; they are joined.
    """
    proper = F.col("end") >= F.col("start")
    event = lambda c, s, e: right.where(proper).select("chr", F.col(c).alias("at"), F.lit(s).alias("s"), (F.col(c) * s).alias("s_at"), F.lit(e).alias("e"), (F.col(c) * e).alias("e_at"))
    found = with_totals(left.where(proper), event("start", 1, 0).union(event("end", 0, 1)), F.col("start"), F.col("end") + 1)
    here = lambda c: F.coalesce(F.col(c), F.lit(0))
    covered = lambda side, x: x * (here(f"{side}_s") - here(f"{side}_e")) - here(f"{side}_s_at") + here(f"{side}_e_at")
    sums = found.select(*left.columns, (here("hi_s") - here("lo_e")).alias("n"), (covered("hi", F.col("end")) - covered("lo", F.col("start"))).alias("shared"))
    odd = overlap_join(left.where(proper), right.where(~proper)).unionByName(overlap_join(left.where(~proper), right))
    pairs = odd.select(*left.columns, F.lit(1).cast("long").alias("n"), (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))
    return sums.unionByName(pairs).where("n > 0")


def span_blocks(spans: DataFrame, least: int = 16, wide: int = 1) -> DataFrame:
    """Adds to spans (chr, start, end; closed) the class of their length and the block in which they start (__k, __b); see ``side_by_side``."""
    spans = spans.where("end >= start")
    spans = spans.withColumn("__k", F.greatest(F.length(F.bin(F.col("end") - F.col("start"))), F.lit(least)))
    return spans.withColumn("__b", F.floor(F.col("start") / (F.pow(F.lit(2.0), "__k") * wide)).cast("long"))


def side_by_side(points: DataFrame, spans: DataFrame, pos: str, least: int = 16, wide: int = 1) -> DataFrame:
    """Points (chr, pos, ...) and the spans (chr, start, end; closed) that hold them, in common groups (chr, __k, __b).

    Spans of up to 2^k places start in block b of ``wide`` times 2^k places, and points come to their own block and, if they are among
    the first 2^k places of it, to the one before, so a span's points are all in its group and no pair of a span and a point is
    ever a row. Spans have a null ``pos``, points a null start.
    """
    spans = span_blocks(spans, least, wide)
    width = F.pow(F.lit(2.0), "__k")
    own = F.floor(F.col(pos) / (width * wide)).cast("long")
    classes = spans.select("__k").distinct()  # at most 64 rows
    both = F.when(F.col(pos) - own * wide * width < width, F.array(own, own - 1)).otherwise(F.array(own)) if wide > 1 else F.array(own, own - 1)
    near = points.crossJoin(F.broadcast(classes)).withColumn("__b", F.explode(both))
    return near.unionByName(spans, allowMissingColumns=True)


def nearest(probes: DataFrame, marks: DataFrame, probe: str = "pos", mark: str = "pos") -> DataFrame:
    """Probes with the nearest mark of their contig (``near``); ties take the lower position.

    Both tables are laid over each other and two running windows carry the marks before and after, so the cost is
    one sort, not a join of ranges.
    """
    keep = [c for c in probes.columns if c != "chr"]
    rows = probes.select("chr", F.col(probe).alias("__at"), F.struct(*keep).alias("__row"), F.lit(None).cast("long").alias("__mark")).unionByName(
        marks.select("chr", F.col(mark).alias("__at"), F.col(mark).cast("long").alias("__mark")).distinct(), allowMissingColumns=True
    )
    before = Window.partitionBy("chr").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("chr").orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)
    down, up = F.max("__mark").over(before), F.min("__mark").over(after)
    found = rows.withColumns({"__down": down, "__up": up}).where("__row IS NOT NULL")
    pick = F.when(F.col("__up").isNull() | (F.col("__at") - F.col("__down") <= F.col("__up") - F.col("__at")), F.col("__down")).otherwise(F.col("__up"))
    return found.select("chr", "__row.*", pick.alias("near"))


def fragments(*tables: DataFrame) -> DataFrame:
    """The pieces between consecutive boundaries of all intervals of a contig (half-open)."""
    points = None
    for t in tables:
        p = t.select("chr", F.explode(F.array("start", "end")).alias("start"))
        points = p if points is None else points.union(p)
    following = F.lead("start").over(Window.partitionBy("chr").orderBy("start"))
    return points.distinct().withColumn("end", following).where("end IS NOT NULL")


def sweep(**tables: DataFrame) -> DataFrame:
    """chr, start, end and for each named table how many of its intervals cover the piece (half-open).

    One sort per contig, whatever the number of intervals that overlap.
    """
    rows = None
    for name, t in tables.items():
        t = t.where("start < end")
        e = t.select("chr", F.col("start").alias("at"), F.lit(1).alias(name)).union(t.select("chr", F.col("end").alias("at"), F.lit(-1).alias(name)))
        rows = e if rows is None else rows.unionByName(e, allowMissingColumns=True)
    names = list(tables)
    steps = rows.groupBy("chr", "at").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    along = Window.partitionBy("chr").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    pieces = steps.select("chr", F.col("at").alias("start"), F.lead("at").over(along).alias("end"), *(F.sum(n).over(so_far).cast("long").alias(n) for n in names))
    return pieces.where("end IS NOT NULL")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What intervals of ``a`` cover and those of ``b`` don't, interval by interval of a contig; equal sets leave nothing."""
    covered = sweep(a=a, b=b).where("a > 0 AND b = 0").select("chr", "start", "end")
    return covered


def split_at(intervals: DataFrame, points: DataFrame, pos: str = "pos") -> DataFrame:
    """Intervals cut at the points inside them; pieces share the cut.

    Points meet the intervals that hold them by a join on buckets, so an interval carries its own points only.
    """
    others = [c for c in intervals.columns if c not in ("start", "end")]
    own = F.struct(*(F.col(f"r_{c}") for c in intervals.columns)).alias("__own")
    numbered = intervals.withColumn("__copy", F.row_number().over(Window.partitionBy(*intervals.columns).orderBy("start")))  # equal rows are cut one by one
    inner = point_join(points.select("chr", F.col(pos).alias("__at")).distinct(), numbered.where("end > start"), "__at", strict=True).select(own, F.col("r___copy").alias("__copy"), "__at")
    edges = numbered.select(F.struct(*(F.col(c).alias(f"r_{c}") for c in intervals.columns)).alias("__own"), "__copy", F.explode(F.array("start", "end")).alias("__at")).unionByName(inner)
    cuts = edges.groupBy("__own", "__copy").agg(F.array_sort(F.collect_set("__at")).alias("__cuts"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__cuts") - 1, F.lit(1))), lambda i: F.struct(F.element_at("__cuts", i).alias("start"), F.element_at("__cuts", F.least(i + 1, F.size("__cuts"))).alias("end")))
    rows = cuts.select(*(F.col(f"__own.r_{c}").alias(c) for c in others), F.explode(pairs).alias("__piece"))
    return rows.select(*others, "__piece.start", "__piece.end").select(*intervals.columns)


def islands(flagged: DataFrame, size: int, bridge: int = 1, trim: int = 1) -> DataFrame:
    """Runs of flagged bins (chr, start) of one size: chr, start, end.

    A gap of ``bridge`` bins is bridged; ``trim`` bins go at the start of a run; a run ends with its last bin.
    """
    order = Window.partitionBy("chr").orderBy("start")
    gap = F.col("start") - F.lag("start").over(order) > F.lit((1 + bridge) * size)
    runs = flagged.select("chr", "start").distinct().withColumn("__new", F.coalesce(gap, F.lit(True)).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("chr", "__run").agg((F.min("start") + trim * size).alias("start"), (F.max("start") + size - 1).alias("end")).drop("__run")


def runs(df: DataFrame, value: str, order_by: str = "start", name: str = "run") -> DataFrame:
    """Numbers the runs of equal values along a contig."""
    order = Window.partitionBy("chr").orderBy(order_by)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(order))).cast("int")
    first = F.row_number().over(order) == 1
    marked = df.withColumn("__change", F.when(first, 1).otherwise(change))
    return marked.withColumn(name, F.sum("__change").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def groups_by_gap(df: DataFrame, breaks: Column, order_by: str = "start", name: str = "run") -> DataFrame:
    """Numbers groups of consecutive rows; ``breaks`` says (with lag) where a new one begins."""
    order = Window.partitionBy("chr").orderBy(order_by)
    marked = df.withColumn("__new", F.coalesce(breaks, F.lit(True)).cast("int"))
    return marked.withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_touching(df: DataFrame, gap: int = 1) -> DataFrame:
    """Merges rows that begin ``gap`` after the end of the row before."""
    order = Window.partitionBy("chr").orderBy("start")
    grouped = groups_by_gap(df, F.col("start") - F.lag("end").over(order) != gap)
    return grouped.groupBy("chr", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
