"""Operators on hand-made rows: the edge cases of the model."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import contigs as ct
from strandloom.functions import intervals as iv
from strandloom.functions import scalar as sc
from strandloom.operators import breakpoints, copynumber, coverage, loh, phase, profile, reads, segments, snps, sync

CENTERS = [10.0, 30.0, 50.0]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def brute_snap(x, digits=0):
    if abs(x) == 3300:
        return x
    x = abs(x)
    if x < CENTERS[0]:
        return 0
    for i, (a, b) in enumerate(itertools.pairwise(CENTERS)):
        if a <= x <= b:
            return round(i + (x - a) / (b - a), digits)
    return round(2 + (x - 50) / 20, digits)


def test_snapping(spark):
    xs = [0.0, 9.9, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 75.0, 80.0, -25.0, 3300.0, -3300.0, 20.1]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    for digits in (0, 2):
        got = {r.x: r.y for r in df.select("x", sc.snap(F.col("x"), CENTERS, digits).alias("y")).collect()}
        assert got == {x: float(brute_snap(x, digits)) for x in xs}
    moved = {r.x: r.y for r in df.select("x", sc.center_of(F.col("x"), CENTERS).alias("y")).collect()}
    assert (moved[20.0], moved[40.0], moved[75.0], moved[9.9]) == (10.0, 50.0, 70.0, 10.0)


def test_snapping_rounds_ties_of_scaled_values_to_even(spark):
    centers = [0.0, 20.0, 40.0, 60.0, 80.0]
    expected = {39.9: 2.0, 61.9: 3.1, 58.1: 2.9, 2.3: 0.12, 0.7: 0.03}  # as round_even(x / 20, 2) of the SQL has them
    df = spark.createDataFrame([(x,) for x in expected], "x DOUBLE")
    assert {r.x: r.y for r in df.select("x", sc.snap(F.col("x"), centers, 2).alias("y")).collect()} == expected


def test_scalars(spark):
    r = one(spark, *(sc.two_sided_p(F.lit(x), F.lit(0.0)).alias(f"p{i}") for i, x in enumerate((0.0, 10.0, -19.6))))
    assert r.p0 == 1.0 and abs(r.p1 - 0.3173105) < 1e-7 and abs(r.p2 - 0.0499958) < 1e-6
    r = one(spark, *(sc.mate(F.lit("G]chr5:123]"))[i].alias(n) for i, n in enumerate("ab")), sc.parse_vaf(F.lit("0.25,0.1")).alias("v"), sc.parse_vaf(F.lit(".")).alias("w"), sc.fold_vaf(F.lit(0.7)).alias("f"))
    assert (r.a, r.b, r.v, r.w) == ("chr5", 123, 0.25, None) and math.isclose(r.f, 0.3)
    kinds = {(a, b): tuple(one(spark, sc.cna_type(F.lit(float(a)), F.lit(float(b))).alias("k"), sc.cna_alt(F.lit(float(a)), F.lit(float(b))).alias("a"), sc.cna_genotype(F.lit(float(a)), F.lit(float(b))).alias("g"))) for a, b in ((0, 2), (2, 0), (0, 1), (1, 1), (2, 2), (0, 0), (3, 1))}
    assert kinds == {(0, 2): ("CNLOH", "<DEL>,<DUP>", "1/2"), (2, 0): ("CNLOH", "<DUP>,<DEL>", "1/2"), (0, 1): ("LOSS", "<DEL>", "0/1"), (1, 1): ("REF", ".", "0/0"), (2, 2): ("GAIN", "<DUP>", "1/1"), (0, 0): ("LOSS", "<DEL>", "1/1"), (3, 1): ("GAIN", "<DUP>", "0/1")}


def test_contigs(spark):
    assert ct.expand("chr1-3,chrX") == ["chr1", "chr2", "chr3", "chrX"] and ct.expand("1-2,X") == ["1", "2", "X"]
    t = ct.contig_table(spark, {"chr10": 5, "chr2": 7, "chrX": 3, "chr1": 2})
    assert [tuple(r) for r in ct.karyotypic(t.select("chr", "offset")).collect()] == [("chr1", 0), ("chr2", 2), ("chr10", 9), ("chrX", 14)]


def test_bins_are_closed(spark):
    t = spark.createDataFrame([("chr1", 120), ("chr2", 50), ("chr3", 0)], "chr STRING, len BIGINT")
    assert rows(iv.fixed_bins(t, 50), "chr", "start", "end") == [("chr1", 0, 50), ("chr1", 51, 100), ("chr1", 101, 120), ("chr2", 0, 50)]


def random_intervals(rng, n, top=300):
    return [("c", a, a + rng.randint(1, 60)) for a in (rng.randrange(top) for _ in range(n))]


@pytest.mark.parametrize("seed", range(3))
def test_overlap_joins_match_brute_force(spark, seed):
    rng = random.Random(seed)
    a, b = sorted(set(random_intervals(rng, 25))), sorted(set(random_intervals(rng, 12)))
    left, right = (spark.createDataFrame(x, "chr STRING, start BIGINT, end BIGINT") for x in (a, b))
    for closed in (True, False):
        hit = lambda x, y: (x[2] >= y[1] and x[1] <= y[2]) if closed else (x[2] > y[1] and x[1] < y[2])  # noqa: B023, E731
        assert rows(iv.overlap_join(left, right, closed, bucket=16), "start", "end", "r_start", "r_end") == sorted((x[1], x[2], y[1], y[2]) for x in a for y in b if hit(x, y))
        assert rows(iv.overlap_join(left, right, closed, "left_semi", 16)) == [x for x in a if any(hit(x, y) for y in b)]
        assert rows(iv.overlap_join(left, right, closed, "left_anti", 16)) == [x for x in a if not any(hit(x, y) for y in b)]
    points = spark.createDataFrame([("c", p) for p in range(0, 300, 7)], "chr STRING, pos BIGINT")
    assert rows(iv.point_join(points, right, bucket=16), "pos", "r_start") == sorted((p, y[1]) for p in range(0, 300, 7) for y in b if y[1] <= p <= y[2])
    covered = {x for s in b for x in range(s[1], s[2])}
    left_over = {x for s in a for x in range(s[1], s[2])} - covered
    got = [x for r in iv.subtract(left, right).collect() for x in range(r.start, r.end)]
    assert sorted(got) == sorted(left_over)


def test_subtracting_equal_sets_leaves_nothing(spark):
    t = spark.createDataFrame([("c", 1, 5), ("c", 9, 12)], "chr STRING, start BIGINT, end BIGINT")
    assert iv.subtract(t, t).count() == 0


def test_nearest_takes_the_lower_at_ties(spark):
    probes = spark.createDataFrame([("c", 1, 5), ("c", 2, 0), ("c", 3, 99), ("d", 4, 5)], "chr STRING, id INT, pos BIGINT")
    marks = spark.createDataFrame([("c", 3), ("c", 7), ("c", 7)], "chr STRING, pos BIGINT")
    assert rows(iv.nearest(probes, marks), "id", "near") == [(1, 3), (2, 3), (3, 7), (4, None)] or {r.id: r.near for r in iv.nearest(probes, marks).collect()} == {1: 3, 2: 3, 3: 7, 4: None}


def test_islands_bridge_one_gap_and_trim_the_first_bin(spark):
    flagged = spark.createDataFrame([("c", s) for s in (1, 11, 31, 61, 91)], "chr STRING, start BIGINT")
    assert rows(iv.islands(flagged, 10), "start", "end") == [(11, 40), (71, 70), (101, 100)]


def test_histogram_counts_both_ends(spark):
    segs = spark.createDataFrame([("g", 1, "c", 0, 999), ("g", 1, "c", 500, 500), ("g", 2, "c", 1500, 2000)], "genome_id STRING, hp INT, chr STRING, start BIGINT, end BIGINT")
    hist = coverage.histogram(segs)
    assert rows(hist, "hp", "win", "depth") == [(1, 0, 1), (1, 1, 2), (2, 3, 1), (2, 4, 1)]
    bins = spark.createDataFrame([("c", 0, 1000), ("c", 1001, 2000)], "chr STRING, start BIGINT, end BIGINT")
    assert rows(coverage.bin_coverage(hist, bins), "start", "hp1", "hp2", "hp3") == [(0, 1.0, 0.0, 0.0), (1001, 0.0, 0.67, 0.0)]


def test_snps_on_bin_starts_and_small_bins(spark):
    bins = spark.createDataFrame([("c", 0), ("c", 100)], "chr STRING, pos BIGINT")
    five = [("c", p, 0.2) for p in (1, 2, 3, 4, 99)] + [("c", p, 0.4) for p in (100, 101, 102, 103, 104)]
    got = rows(snps.bin_vaf(spark.createDataFrame(five, "chr STRING, pos BIGINT, vaf DOUBLE"), bins, 100))
    assert got[0][:2] == ("c", 0) and math.isclose(got[0][2], 0.2) and got[1] == ("c", 100, 3300.0)


def test_pileups(spark):
    assert snps.plain_bases(".,G^]G$+2ACt-1gA", "A") == "AAGGTA"
    df = spark.createDataFrame([("chr1", 1000, "A", ".,G^]G$"), ("chr1", 5, "c", ""), ("chr1", 6, "c", None)], "chr STRING, start BIGINT, ref STRING, bases STRING")
    assert rows(snps.base_counts(df)) == [("chr1", 5, 0, 0, 0, 0), ("chr1", 6, 0, 0, 0, 0), ("chr1", 1000, 2, 0, 2, 0)]
    het = spark.createDataFrame([("chr1", 1000, "A", "G", "1|0"), ("chr1", 5, "C", "T", "1/0"), ("chr2", 1, "A", "G", "0|1")], "chr STRING, start BIGINT, ref STRING, alt STRING, gt STRING")
    counts = spark.createDataFrame([("chr1", 1000, 7, 0, 3, 0), ("chr1", 5, 0, 4, 0, 9)], "chr STRING, start BIGINT, a INT, c INT, g INT, t INT")
    assert rows(snps.frequencies(het, counts), "pos", "freq_value_a", "freq_value_b") == [(5, 0, 0), (1000, 7, 3)]
    assert rows(snps.frequencies(het, counts, True), "pos", "freq_value_a", "freq_value_b") == [(5, 4, 9), (1000, 7, 3)]


def test_alignment_walk(spark):
    assert reads.walk("10S100M49D50M60I20M5S", 1000, False) == [(160, 220, 1199, 1199, 0.0, True), (10, 240, 1000, 1219, 0.0, False)]
    assert reads.walk("10M50D10M", 0, False) == [(0, 10, 0, 10, 0.0, False), (10, 20, 60, 70, 0.0, False)]
    assert reads.walk("5S10M", 0, True) == [(0, 10, 0, 10, 0.0, False)] and reads.walk("8=2X", 0, False)[0][4] == 0.1
    df = spark.createDataFrame([("r1", "c", 5, "2000M", False, 60, 1, "g", 0), ("r2", "c", 5, "2000M", False, 60, 1, "g", 256), ("r3", "c", 5, "500M", True, 60, None, "g", 16)], "read_id STRING, ref_id STRING, pos BIGINT, cigar STRING, is_reverse BOOLEAN, mapq INT, haplotype INT, genome_id STRING, flag INT")
    segs = reads.segments(df)
    assert rows(segs, "read_id", "ref_end", "strand", "haplotype") == [("r1", 2005, "+", 1), ("r3", 505, "-", 0)]
    assert rows(reads.filter_reads(segs), "read_id") == [("r1",)]


def brute_flips(blocks, product):
    out, prev = [], None
    for a, b in blocks:
        flip = False
        if prev:
            cis = (abs(prev[0] - a), abs(prev[1] - b))
            trans = (abs(prev[0] - b), abs(prev[1] - a))
            flip = (trans[0] * trans[1] < cis[0] * cis[1]) if product else min(trans) < min(cis)
        prev = (b, a) if flip else (a, b)
        out.append(flip)
    return out


@pytest.mark.parametrize("product", [False, True])
def test_flips_match_the_loop(spark, product):
    rng = random.Random(9)
    chains = [[(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(30)] for _ in range(8)]
    data = [(f"c{k}", 10 * i, 10 * i + 5, float(a), float(b)) for k, c in enumerate(chains) for i, (a, b) in enumerate(c)]
    found = phase.flips(spark.createDataFrame(data, "chr STRING, start BIGINT, end BIGINT, hp1 DOUBLE, hp2 DOUBLE"), product)
    assert [r.flip for r in found.orderBy("chr", "start").collect()] == [f for c in chains for f in brute_flips(c, product)]


def test_blocks(spark):
    t = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 5, 40), ("c", 3, 41, 45)], "chr STRING, phasesets BIGINT, start BIGINT, end BIGINT")
    assert rows(phase.keep_longer(t)) == [("c", 5, 40), ("c", 41, 45)]
    cen = spark.createDataFrame([("c", 100, 200)], "chr STRING, start BIGINT, end BIGINT")
    b = spark.createDataFrame([("c", 120, 180), ("c", 50, 150), ("c", 150, 250), ("d", 1, 2)], "chr STRING, start BIGINT, end BIGINT")
    assert rows(phase.clip_centromeres(b, cen)) == [("c", 50, 100), ("c", 200, 250), ("d", 1, 2)]
    bins = spark.createDataFrame([("c", 0, 1.0, 2.0)], "chr STRING, start BIGINT, hp1 DOUBLE, hp2 DOUBLE")
    twice = spark.createDataFrame([("c", 0, 5, True), ("c", 0, 9, True)], "chr STRING, start BIGINT, end BIGINT, flip BOOLEAN")
    assert rows(phase.apply_flips(bins, twice), "hp1", "hp2", "flip") == [(1.0, 2.0, False)]


def test_rephase(spark):
    v = spark.createDataFrame([("c", 250, "0|1", 7), ("c", 40, "0|1", 7), ("c", 600, "0|1", 7), ("c", 900, "1/1", None)], "chr STRING, pos BIGINT, gt STRING, ps BIGINT")
    span = lambda *x: spark.createDataFrame([("c", *s) for s in x], "chr STRING, start BIGINT, end BIGINT")
    lost = spark.createDataFrame([("c", 800, 1000, 2)], "chr STRING, start BIGINT, end BIGINT, hp INT")
    got = rows(phase.rephase(v, span((200, 299)), span((0, 700)), span((30, 500), (590, 610)), lost, 100, 100), "pos", "gt", "ps")
    assert got == [(40, "0|1", 30), (250, "1|0", 30), (600, "0/1", None), (900, "0|1", 800)]


def test_greedy_and_thinning(spark):
    t = spark.createDataFrame([("c", 1, 5), ("c", 4, 20), ("c", 6, 8)], "chr STRING, start BIGINT, end BIGINT")
    assert rows(segments.keep_first_disjoint(t)) == [("c", 1, 5), ("c", 6, 8)]
    p = spark.createDataFrame([("c", x) for x in (5, 6, 7, 9)], "chr STRING, pos BIGINT")
    assert rows(segments.thin(p), "pos") == [(5,), (9,)]
    assert rows(segments.first_in_bin(spark.createDataFrame([("c", x) for x in (10, 12, 20)], "chr STRING, pos BIGINT"), 10), "pos") == [(10,), (20,)]


def test_change_points():
    x = np.r_[np.full(60, 10), np.full(60, 40), np.full(60, 10)] + np.tile([0, 1, 2], 60)
    assert segments.rbf_points(x, 10, 5) == [60, 120, 180]
    assert segments.l2_points(x, 500.0, 5, 5) == [60, 120, 180]
    assert segments.rbf_points(np.full(50, 3)) == [50] and segments.l2_points(np.array([]), 1.0, 1, 1) == []


def test_single_copy_and_peaks():
    hist = np.zeros(100)
    for level, n in ((20, 500), (40, 900), (60, 300)):
        hist[level - 2 : level + 3] += np.array([0.2, 0.6, 1, 0.6, 0.2]) * n
    copy, _ = copynumber.single_copy_coverage(hist, 1.0, 40.0)
    assert abs(copy - 20) <= 1
    t = np.arange(12.0)
    assert np.allclose(copynumber.smooth_cubic(t**3 - t), t**3 - t)
    assert copynumber.centers_up_to(20.0, 65.0) == [0.0, 20.0, 40.0, 60.0, 80.0]


def peaks_one_by_one(scores):
    """Local maxima over runs of equal scores, found by value; of neighbouring places every second one."""
    plain = [x for i, x in enumerate(scores) if i == 0 or x != scores[i - 1]]
    tops = {b for a, b, c in zip(plain, plain[1:], plain[2:], strict=False) if a < b > c}
    places = [i for i, x in enumerate(scores) if x in tops or (i == 0 and (len(scores) == 1 or scores[0] > scores[1]))]
    out = []
    for i in places:
        if not out or i - out[-1] != 1:
            out.append(i)
    return out


def test_score_peaks(spark):
    import random

    rng = random.Random(3)
    cases = [[0.1, 0.5, 0.5, 0.2, 0.9, 0.1], [3.0], [2.0, 1.0, 0.0], [1.0, 2.0, 3.0], []] + [[float(rng.randint(0, 4)) for _ in range(rng.randint(1, 60))] for _ in range(6)]
    for scores in cases:
        df = spark.createDataFrame(list(enumerate(scores)), "ord INT, confidence DOUBLE")
        assert sorted(r.ord for r in copynumber.score_peaks(df).collect()) == peaks_one_by_one(scores), scores


def test_places_and_neighbours_of_many_ranges(spark):
    import random

    from strandloom.functions.ordering import beside, numbered

    rng = random.Random(5)
    values = [rng.choice([0.0, 0.0, rng.random(), None]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(values)), "ord INT, x DOUBLE")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = numbered(df, [F.desc("x"), F.asc("ord")], "at")
        got = sorted(tuple(r) for r in beside(rows, "at", "ord", "p", "n", width=16).select("at", "ord", "p", "n").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [i for i, _ in sorted(enumerate(values), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert got == [(k + 1, i, want[k - 1] if k else None, want[k + 1] if k < 699 else None) for k, i in enumerate(want)]
    assert numbered(df.where("ord < 0"), [F.asc("ord")], "at").count() == 0


def test_erfc_as_columns(spark):
    import math

    from strandloom.functions import scalar

    xs = [0.0, 0.1, 0.46875, 0.5, 1.0, 2.5, 4.0, 4.1, 7.0, 30.0]
    found = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select("x", scalar.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erfc(r.x)) <= 1e-13 * max(math.erfc(r.x), 1e-300) + 1e-15 for r in found)


def quadratic_points(x, penalty, jump, min_size=2):
    """Change points from the whole matrix of the kernel, every origin tried for every end."""
    d = (x[:, None] - x[None, :]).astype(float) ** 2
    m = np.median(d[np.triu_indices(len(x), 1)])
    k = np.exp(-np.clip((1 / m if m else 1.0) * d, 1e-2, 1e2))
    ends = [t for t in range(0, len(x), jump) if t >= min_size] + [len(x)]
    best = {0: (0.0, [])}
    for e in ends:
        tried = [(best[s][0] + (e - s) - k[s:e, s:e].sum() / (e - s) + penalty, s) for s in best if e - s >= min_size]
        if tried:
            total, s = min(tried)
            best[e] = (total, [*best[s][1], e])
    return best[len(x)][1]


def test_change_points_equal_the_quadratic_search():
    rng = np.random.default_rng(5)
    for n, jump in ((4, 1), (37, 1), (200, 5), (611, 25), (900, 7)):
        for noise in (0, 2, 9):
            x = np.repeat(rng.integers(0, 60, 6), n // 6 + 1)[:n] + rng.integers(-noise, noise + 1, n)
            assert segments.rbf_points(x, 4.0, jump) == quadratic_points(x, 4.0, jump), (n, jump, noise)
    for n in (2, 3, 10, 51):
        x = rng.integers(-9, 9, n)
        assert segments.middle_distance(x) == 2 * np.median([(a - b) ** 2 for i, a in enumerate(x.tolist()) for b in x[:i].tolist()])
    assert segments.middle_distance(np.array([3])) == 0


def test_change_points_of_long_tracks(spark):
    """A track of any length has one scale and memory for a few numbers a bin."""
    import tracemalloc

    levels, n = [10, 40, 10, 22, 40], 12_000
    x = np.repeat(levels, n) + np.tile([0, 1, 2], 5 * n // 3)
    tracemalloc.start()
    assert segments.rbf_points(x, 10.0, 25) == [n * (k + 1) for k in range(5)]
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # its square would have 28 GB
    tracemalloc.stop()
    df = spark.createDataFrame([("c", 1, i * 100, float(v)) for i, v in enumerate(x[::30])] + [("d", 2, 0, None)], "chr STRING, hp INT, start BIGINT, value DOUBLE")
    assert rows(segments.change_points(df, 100, 10.0, 25), "chr", "pos") == [("c", 100 * 400 * (k + 1)) for k in range(5)] + [("d", 100)]


def test_subclonal_segments_share_a_median(spark):
    """Neighbours off every center with close depths get one state; one that stands off keeps its own."""
    depth = [20, 20, 20, 29, 30, 29.5, 20, 33, 50, 20]
    segs = spark.createDataFrame([("c", 0 if i == 0 else i * 1000 + 1, (i + 1) * 1000, float(d)) for i, d in enumerate(depth)], "chr STRING, start BIGINT, end BIGINT, state DOUBLE")
    bins = spark.createDataFrame([("c", k * 100 + (k > 0), float(depth[k // 10]), float(depth[k // 10])) for k in range(100)], "chr STRING, start BIGINT, hp1 DOUBLE, hp2 DOUBLE")
    centers = [0.0, 20.0, 40.0, 60.0]
    found = copynumber.subclonal({1: segs, 2: segs}, bins, centers, 100)[1]
    got = rows(found, "start", "state", "is_subclonal")
    assert [g[1] for g in got] == [20.0, 20.0, 20.0, 29.0, 29.0, 29.0, 20.0, 33.0, 60.0, 20.0] or got[3][1] == got[4][1] == got[5][1]
    assert [g[2] for g in got[3:6]] == [True] * 3 and not got[0][2]


def test_masks_and_outliers(spark):
    segs = spark.createDataFrame([("c", 100, 200, 5.0, 5.0), ("c", 101, 200, 5.0, 5.0), ("c", 99, 200, 5.0, 5.0)], "chr STRING, start BIGINT, end BIGINT, depth DOUBLE, state DOUBLE")
    cen = spark.createDataFrame([("c", 100, 200)], "chr STRING, start BIGINT, end BIGINT")
    assert rows(copynumber.mask_centromeres(segs, cen), "start", "state") == [(99, 5.0), (100, 3300.0), (101, 3300.0)]
    vals = spark.createDataFrame([("s", float(x)) for x in (1, 2, 3, 4, 1000)], "k STRING, v DOUBLE")
    assert rows(copynumber.without_outliers(vals, "v", ["k"]), "v") == [(1.0,), (2.0,), (3.0,), (4.0,)]


def test_profiles_align(spark):
    schema = "chr STRING, start BIGINT, end BIGINT, coverage DOUBLE, copynumber_state DOUBLE, confidence DOUBLE"
    a = spark.createDataFrame([("c", 0, 100, 1.0, 1.0, 0.5)], schema)
    b = spark.createDataFrame([("c", 0, 40, 2.0, 2.0, 0.5), ("c", 40, 120, 3.0, 0.0, 0.5)], schema)
    aligned = profile.align(a, b)
    assert rows(aligned, "start", "end", "hp1_coverage", "hp2_coverage") == [(0, 40, 1.0, 2.0), (40, 100, 1.0, 3.0), (100, 120, 0.0, 3.0)]
    assert [r.info for r in profile.vcf_records(aligned).orderBy("pos").collect()] == ["SVTYPE=GAIN;SVLEN=40;END=40;BPS=", "SVTYPE=LOSS;SVLEN=60;END=100;BPS=", "SVTYPE=LOSS;SVLEN=20;END=120;BPS="]


def test_breakpoints(spark):
    v = [("chr1", 100, "a", "N", "<DEL>", 1.0, "PASS", "SVTYPE=DEL;SVLEN=-20000;HP=1|2", "GT:DV", "0/1:9"), ("chr1", 5, "b", "N", "<INS>", 1.0, "PASS", "SVTYPE=INS;SVLEN=9", "GT", "0/1"), ("chr1", 7, "c", "N", "N[chr2:50[", 1.0, "PASS", "SVTYPE=BND", "GT", "0/1"),
         ("chr1", 8, "d", "N", "<DEL>", 1.0, "PASS", "SVTYPE=DEL;SVLEN=-99999", "GT:DV", "0/1:1"), ("chr1", 9, "e_sBND", "N", "N.", 1.0, "PASS", "SVTYPE=sBND", "GT", "0/1"), ("chr1", 9, "f_INV", "N", "<INV>", 1.0, "PASS", "SVTYPE=INV;SVLEN=5;DETAILED_TYPE=reciprocal_inv", "GT", "0/1")]
    from strandloom.schemas import VARIANTS

    pairs = breakpoints.junctions(spark.createDataFrame(v, VARIANTS), ["chr1", "chr2"])
    assert rows(pairs, "id", "chr2", "pos2", "hp", "dv") == [("a", "chr1", 20100, "1|2", 9), ("c", "chr2", 50, "0|0", 999), ("e_sBND", "chr1", 10, "0|0", 999)]
    assert breakpoints.ends(pairs).count() == 6 and breakpoints.arcs(pairs).count() == 3
    assert rows(breakpoints.ends(pairs).where("id = 'a'"), "pos", "hp") == [(100, "1"), (20100, "2")]
    assert rows(breakpoints.supported(pairs, 50.0), "id") == [("c",), ("e_sBND",)] and breakpoints.supported(pairs, 10.0).count() == 3
    blocks = spark.createDataFrame([("chr1", 0, 30_000, 10.0, 20.0), ("chr2", 0, 100, 10.0, 11.0)], "chr STRING, start BIGINT, end BIGINT, hp1 DOUBLE, hp2 DOUBLE")
    phased = pairs.withColumn("hp", F.lit("1|2"))
    assert rows(breakpoints.trusted_haplotypes(phased, blocks), "id", "hp") == [("a", "1|2"), ("c", "0|0"), ("e_sBND", "1|2")]
    lost = spark.createDataFrame([("chr2", 40, 60)], "chr STRING, start BIGINT, end BIGINT")
    assert rows(breakpoints.trusted_haplotypes(phased, blocks, lost).where("id = 'c'"), "hp") == [("1|2",)]
    offsets = spark.createDataFrame([("chr1", 0), ("chr2", 1000)], "chr STRING, offset BIGINT")
    curve = breakpoints.arc_curves(breakpoints.arcs(pairs.where("id = 'c'")), offsets, 3).first().curve
    assert [(p.x, round(p.y, 6)) for p in curve] == [(7.0, 0.0), (528.5, round(1043 * 3**0.5 / 6, 6)), (1050.0, 0.0)]


def test_loh(spark):
    bins = spark.createDataFrame([("c", 100 * i, 1.0, 0.0 if i < 4 else 3.0) for i in range(10)], "chr STRING, start BIGINT, hp1 DOUBLE, hp2 DOUBLE")
    regions = spark.createDataFrame([("c", 0, 400, 1), ("c", 400, 900, 1)], "chr STRING, start BIGINT, end BIGINT, hp INT")
    assert rows(loh.assign_haplotype(regions, bins, 100), "start", "hp") == [(0, 1), (400, 2)]
    moved = copynumber.move_normal(bins, regions.limit(1), 2.0, 100)
    assert rows(moved.where("start < 500"), "hp1", "hp2")[:2] == [(0.0, 2.0), (0.0, 2.0)]


def test_sync_reasons(spark):
    v = spark.createDataFrame([("c", 1, "A", "G", "0|1", 5), ("c", 2, "A", "G", "0/1", 5), ("c", 3, "A", "G", "0|1", None), ("c", 4, "A", "G", "1|1", 5), ("c", 5, "AT", "G", "0|1", 5)], "chr STRING, pos BIGINT, ref STRING, alt STRING, gt STRING, ps BIGINT")
    assert [r.reason for r in sync.exclusion_reason(v).orderBy("pos").collect()] == [None, "not_phased", "no_ps", "not_het", "not_snv"]
    counts = spark.createDataFrame([("c", 1, 4, 0, 6, 1)], "chr STRING, start BIGINT, a INT, c INT, g INT, t INT")
    got = sync.haplotype_depths(v.where("pos IN (1, 2)"), counts)
    assert rows(got.where("reason IS NULL"), "hp1_depth", "hp2_depth") == [(4, 6)] and got.where("reason = 'no_pileup_data'").count() == 1


def test_centromeres_do_not_count_for_ploidy(spark):
    """Two copies along 3 Mb but for a centromere of 200 kb are a ploidy of 2, not 1.87."""
    rows = [("chr1", s, e, d, hp) for hp in (1, 2) for s, e, d in ((0, 1_000_000, 30.0), (1_000_001, 1_200_000, 0.0), (1_200_001, 3_000_000, 30.0))]
    segments = spark.createDataFrame(rows, "chr STRING, start BIGINT, end BIGINT, depth DOUBLE, hp INT")
    centromeres = spark.createDataFrame([("chr1", 1_000_000, 1_200_000)] * 2, "chr STRING, start BIGINT, end BIGINT")
    grid = spark.createDataFrame([(10.0,)], "normal DOUBLE")
    assert copynumber.purity_grid(segments, grid, 20.0, 3, 60.0, centromeres=centromeres).first().ploidy == 2.0
    assert copynumber.purity_grid(segments, grid, 20.0, 3, 60.0).first().ploidy < 1.88


def most_rows(df):
    """Runs the query; the largest number of rows that a step of its plan made."""
    df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from walk(plan.plan())
        else:
            made = plan.metrics().get("numOutputRows")
            if made.isDefined():
                yield made.get().value()
            children = plan.children()
            for i in range(children.size()):
                yield from walk(children.apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def crowd(spark, n=300):
    """n points at one place and n different intervals that all hold it."""
    return spark.range(n).selectExpr("'c' AS chr", "5000L AS pos", "id"), spark.range(n).selectExpr("'c' AS chr", "5000 - id - 1 AS start", "5000 + id % 7 + 1 AS end")


@pytest.mark.parametrize("seed", range(2))
def test_first_containing_makes_no_pairs(spark, seed):
    rng = random.Random(seed)
    spans = [("c", a, b, n) for n, (_, a, b) in enumerate(random_intervals(rng, 40, 9000))] + [("c", 700, 690, 98), ("c", 4000, 4000, 99), ("c", None, 5, 97)]
    spans += [("c", a, a + 2500, 100 + a) for a in (10, 10, 3000)]
    held = lambda p: min(((a, b, n) for _, a, b, n in spans if a is not None and a <= p <= b), default=None)
    points = spark.createDataFrame([("c", p) for p in range(0, 9100, 5)] + [("d", 1)], "chr STRING, pos BIGINT")
    got = iv.first_containing(points, spark.createDataFrame(spans, "chr STRING, start BIGINT, end BIGINT, n BIGINT"), ["chr", "pos"])
    assert {r.pos: tuple(r.hit) for r in got.collect()} == {p: held(p) for p in range(0, 9100, 5) if held(p)}
    many, wide = crowd(spark)
    assert most_rows(iv.first_containing(many, wide, ["chr", "id"])) <= 1000


def test_region_counts_make_no_pairs(spark):
    snp_rows = [("c", p, gt) for p, gt in ((1, "0|1"), (4096, "1/1"), (5000, "0|1"), (5000, "1|1"), (9000, None), (9001, "0/1"))] + [("d", 5, "0|1")]
    regions = [("c", 1, 5000), ("c", 1, 5000), ("c", 4999, 9001), ("c", 5000, 5000), ("c", 5000, 4000), ("c", None, 7), ("e", 0, 9), ("d", 4, 6)]
    got = snps.region_counts(spark.createDataFrame(snp_rows, "chr STRING, pos BIGINT, gt STRING"), spark.createDataFrame(regions, "chr STRING, start BIGINT, end BIGINT"))
    hits = lambda c, a, b, hom: sum(x == c and a is not None and a < p < b and (gt in ("1/1", "1|1")) == hom for x, p, gt in snp_rows)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((c, a, b, hits(c, a, b, False), hits(c, a, b, True))) for c, a, b in regions)
    many, wide = crowd(spark)
    assert most_rows(snps.region_counts(many.withColumn("gt", F.lit("0|1")), wide)) <= 3000


def test_bin_coverage_makes_no_row_per_window(spark):
    hist = spark.createDataFrame([("c", 1, w, 2) for w in range(0, 40, 3)] + [("c", 0, 7, 5), ("d", 1, 1, 1)], "chr STRING, hp INT, win BIGINT, depth BIGINT")
    wide = [("c", 0, 5000), ("c", 0, 5000), ("c", 1200, 1300), ("c", 3500, 3999), ("e", 0, 10)]
    got = coverage.bin_coverage(hist, spark.createDataFrame(wide, "chr STRING, start BIGINT, end BIGINT"))
    mean = lambda c, a, b, h: round(sum((2 if h == 1 else 5) for w in range(a // 500, b // 500 + 1) if c == "c" and ((h == 1 and w in range(0, 40, 3)) or (h == 0 and w == 7))) / (b // 500 - a // 500 + 1), 2)
    assert rows(got, "chr", "start", "end", "hp1", "hp2", "hp3") == sorted((c, a, b, mean(c, a, b, 1), 0.0, mean(c, a, b, 0)) for c, a, b in wide)
    long = spark.range(50).selectExpr("'c' AS chr", "id AS start", "500000 + id AS end")
    assert most_rows(coverage.bin_coverage(hist, long)) <= 1000


@pytest.mark.parametrize("seed", range(2))
def test_overlap_totals_make_no_pairs(spark, seed):
    rng = random.Random(seed)
    a, b = random_intervals(rng, 30, 9000), random_intervals(rng, 40, 9000)
    a, b = a + [("c", 50, 8900), ("c", 50, 8900), ("c", 70, 60), ("d", 1, 9), ("c", None, 4)], b + [("c", 10, 10), ("c", 400, 300), ("c", 8890, 9050), ("c", 3, None)]
    hit = lambda x, y: None not in (*x, *y) and x[0] == y[0] and y[2] >= x[1] and y[1] <= x[2]
    expected = [(*x, len(m), sum(min(x[2], y[2]) - max(x[1], y[1]) for y in m)) for x in a if (m := [y for y in b if hit(x, y)])]
    left, right = (spark.createDataFrame(x, "chr STRING, start BIGINT, end BIGINT") for x in (a, b))
    found = iv.overlap_totals(left, right).groupBy("chr", "start", "end").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"))
    summed = {}
    for *x, n, shared in expected:
        summed[tuple(x)] = tuple(map(sum, zip(summed.get(tuple(x), (0, 0)), (n, shared))))
    assert rows(found) == sorted((*x, *s) for x, s in summed.items())
    wide = crowd(spark)[1]
    assert most_rows(iv.overlap_totals(wide, wide)) <= 3000


def test_values_of_spans_shuffle_each_snp_a_bounded_number_of_times(spark):
    rng = random.Random(5)
    at = sorted(rng.sample(range(10_000), 300))
    depth = {p: rng.choice([None, 0.0, 1.5, 2.25, 40.0, 7.0]) for p in at}
    spans = [(a, a + rng.randint(0, 4000)) for a in rng.sample(range(11_000), 60)] + [(0, 10_000), (0, 10_000), (5, 5)]
    rank = lambda x: min(range(300), key=lambda i: (abs(at[i] - x), at[i]))
    of = {s: [depth[p] for p in at[rank(s[0]) : rank(s[1])] if depth[p] is not None] for s in spans}
    table = spark.createDataFrame([("c", *x) for x in depth.items()], "chr STRING, pos BIGINT, value DOUBLE")
    intervals = spark.createDataFrame([("c", *s) for s in spans] + [("d", 1, 5)], "chr STRING, start BIGINT, end BIGINT")
    for zeros in (True, False):
        value = lambda x: (np.mean(x) if zeros else np.median([y for y in x if y] or [0.0])) if x else 0.0  # noqa: B023, E731
        got = rows(coverage.snp_interval_values(table, intervals, ("value",), zeros), "chr", "start", "end", "value")
        assert [r[:3] for r in got] == sorted([("c", *s) for s in spans] + [("d", 1, 5)])
        assert all(math.isclose(r[3], value(of.get(r[1:3], [])) if r[0] == "c" else 0.0, abs_tol=1e-9) for r in got)
    plan = coverage.snp_interval_values(table, intervals, ("value",), False)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_values_of_spans_take_nearest_snps_of_other_blocks(spark, seed):
    """Few SNPs on a long contig, so that the nearest ones are far from a span's group; no interval is shuffled."""
    rng = random.Random(seed)
    at = sorted(rng.sample(range(3_000_000), [3, 25, 400][seed]) + [262_144, 262_143, 524_288 + 65_536])
    depth = {p: rng.choice([None, 0.0, 1.5, 2.25, 40.0, 7.0]) for p in at}
    spans = [(a, a + rng.choice([1, 500, 65_535, 65_536, 100_000, 900_000])) for a in [*rng.sample(range(3_200_000), 60), 0, 262_144, 196_608]] + [(9, 3), (None, 5), (5, None)]
    near = lambda x: min(range(len(at)), key=lambda i: (abs(at[i] - x), at[i]))
    held = lambda s: [y for p in at[near(s[0]) : near(s[1])] if (y := depth[p])] if None not in s else []
    table = spark.createDataFrame([("c", *x) for x in depth.items()] + [(None, 7, 1.0), ("c", None, 1.0)], "chr STRING, pos BIGINT, value DOUBLE")
    intervals = spark.createDataFrame([("c", *s) for s in spans] + [(None, 1, 5)], "chr STRING, start BIGINT, end BIGINT")
    found = coverage.snp_interval_values(table, intervals, ("value",), False)
    got = sorted(map(str, (tuple(r) for r in found.collect())))
    assert got == sorted(str((*r, float(np.median(held(r[1:]) or [0.0])) if r[0] else 0.0)) for r in [("c", *s) for s in spans] + [(None, 1, 5)])
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_breakpoint_ids_shuffle_no_pairs(spark):
    rng = random.Random(3)
    marks = [("c", rng.randrange(200_000), str(rng.randrange(60))) for _ in range(200)] + [("c", 10, None), ("c", None, "7"), ("d", 5, "x")]
    spans = [("c", a, a + rng.randint(0, 90_000), 0.5) for a in rng.sample(range(190_000), 40)] + [("c", 0, 10, None)] * 2 + [("c", 9, 3, 1.0), ("c", None, 3, 1.0), ("e", 1, 9, 1.0)]
    held = lambda c, a, b: sorted({i for x, p, i in marks if x == c and None not in (a, b, p, i) and a <= p <= b})
    segs, points = spark.createDataFrame(spans, "chr STRING, start BIGINT, end BIGINT, depth DOUBLE"), spark.createDataFrame(marks, "chr STRING, pos BIGINT, id STRING")
    got = profile.with_breakpoint_ids(segs, points)
    assert got.columns == ["chr", "start", "end", "depth", "svs_breakpoints_ids"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((c, a, b, d, held(c, a, b))) for c, a, b, d in spans)
    many, wide = crowd(spark)
    assert most_rows(profile.with_breakpoint_ids(wide, many.withColumn("id", F.col("id").cast("string")))) <= 3000
