"""The queries of the genomic operators over the supplied tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import contigs as ct
from strandloom.functions import intervals as iv
from strandloom.functions import scalar as sc
from strandloom.operators import breakpoints as bp
from strandloom.operators import copynumber as cn
from strandloom.operators import coverage as cov
from strandloom.operators import loh, phase, profile, reads, segments, snps, sync
from strandloom.plans import views as v
from strandloom.sources import plots

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
B = v.BIN
CENTERS = [0.0, 20.0, 40.0, 60.0, 80.0]


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query under its function's name; the SQL sees the views of plans/views.py."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{v.SQL.strip()}"
            _SQL[f.__name__] = sql if sql.startswith("WITH ") else f"{head}{sql}" if sql.lstrip().startswith(",") else f"{head}\n{sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    from strandloom.plans import records  # noqa: F401  (registers its queries here)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: copy-number profile of all contigs."""
    return _QUERIES["cna_profile"](spark, sf_dir)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


# --- bins, coverage -----------------------------------------------------------------------------------------


@query(f"SELECT chr, pos // {B} AS bin_idx, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, count(*) AS n FROM snp GROUP BY 1, 2")
def bin_mean_median(spark, sf_dir):
    return v.snp(spark, sf_dir).groupBy("chr", sc.bin_index(F.col("pos"), B).alias("bin_idx")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.median("value"), 6).alias("median_value"), F.count("*").alias("n"))


@query(f"""SELECT chr, b AS bin_idx, CASE WHEN b = 0 THEN 0 ELSE b * {B} + 1 END AS "start", (b + 1) * {B} AS "end", round(coalesce(avg(value), 0), 6) AS value
FROM contigs CROSS JOIN range(0, {v.LENGTH // B}) g(b) LEFT JOIN snp USING (chr) WHERE FALSE GROUP BY ALL
UNION ALL SELECT c.chr, b, CASE WHEN b = 0 THEN 0 ELSE b * {B} + 1 END, (b + 1) * {B}, round(coalesce(m, 0), 6) FROM contigs c CROSS JOIN range(0, {v.LENGTH // B}) g(b)
LEFT JOIN (SELECT chr, greatest(pos - 1, 0) // {B} AS b, avg(value) AS m FROM snp GROUP BY 1, 2) x USING (chr, b)""")
def snp_bin_mean(spark, sf_dir):
    bins = iv.fixed_bins(v.contigs(spark, sf_dir), B)
    return cov.snp_bin_mean(v.snp(spark, sf_dir), bins, B, ("value",)).select("chr", "bin_idx", "start", "end", _r("value"))


@query("SELECT hp, chr, win, count(*) AS depth FROM read, unnest(generate_series(\"start\" // 500, \"end\" // 500)) AS u(win) GROUP BY 1, 2, 3")
def coverage_hist(spark, sf_dir):
    return cov.histogram(v.read(spark, sf_dir), ("hp", "chr")).select("hp", "chr", "win", F.col("depth").cast("long").alias("depth"))


@query(f""", h AS (SELECT hp, chr, win, count(*) AS depth FROM read, unnest(generate_series("start" // 500, "end" // 500)) AS u(win) GROUP BY 1, 2, 3),
w AS (SELECT c.chr, CASE WHEN b = 0 THEN 0 ELSE b * {B} + 1 END AS s, least((b + 1) * {B}, len) AS e FROM contigs c CROSS JOIN range(0, {v.LENGTH // B}) g(b)),
x AS (SELECT w.chr, s, e, hp, sum(depth) AS d FROM w JOIN h ON w.chr = h.chr AND h.win BETWEEN s // 500 AND e // 500 GROUP BY 1, 2, 3, 4)
SELECT w.chr, w.s AS "start", w.e AS "end", {", ".join(f"round_even(CAST(coalesce(max(CASE WHEN hp = {k} THEN d END), 0) AS DOUBLE) / (w.e // 500 - w.s // 500 + 1), 2) AS {c}" for k, c in ((1, "hp1"), (2, "hp2"), (0, "hp3")))}
FROM w LEFT JOIN x ON w.chr = x.chr AND w.s = x.s GROUP BY 1, 2, 3""")
def bin_coverage(spark, sf_dir):
    hist = cov.histogram(v.read(spark, sf_dir), ("hp", "chr"))
    return cov.bin_coverage(hist, iv.fixed_bins(v.contigs(spark, sf_dir), B))


@query(""", h AS (SELECT hp, chr, win, count(*) AS depth FROM read, unnest(generate_series("start" // 500, "end" // 500)) AS u(win) GROUP BY 1, 2, 3), w AS (SELECT DISTINCT chr, "start" AS s, "end" AS e FROM gene),
x AS (SELECT w.chr, s, e, hp, sum(depth) AS d FROM w JOIN h ON w.chr = h.chr AND h.win BETWEEN s // 500 AND e // 500 GROUP BY 1, 2, 3, 4)
SELECT w.chr, w.s AS "start", w.e AS "end", """ + ", ".join(f"round_even(CAST(coalesce(max(CASE WHEN hp = {k} THEN d END), 0) AS DOUBLE) / (w.e // 500 - w.s // 500 + 1), 2) AS {c}" for k, c in ((1, "hp1"), (2, "hp2"), (0, "hp3"))) + " FROM w LEFT JOIN x ON w.chr = x.chr AND w.s = x.s AND w.e = x.e GROUP BY 1, 2, 3")
def block_coverage(spark, sf_dir):
    """Depths of blocks (genes stand for them) from the same windows as those of bins."""
    hist = cov.histogram(v.read(spark, sf_dir), ("hp", "chr"))
    return cov.bin_coverage(hist, v.gene(spark, sf_dir).select("chr", "start", "end").distinct())


@query("""SELECT rid, count(*) AS kept, CAST(sum("end" - "start") AS BIGINT) AS aligned FROM (SELECT *, row_number() OVER (PARTITION BY rid, "start" ORDER BY chr, "end", hp) AS k FROM read) WHERE k = 1 GROUP BY rid HAVING count(*) <= 10""")
def read_dedup(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("rid", "start").orderBy("chr", "end", "hp"))
    rows = v.read(spark, sf_dir).repartition("rid").withColumn("k", place).where("k = 1")
    return rows.groupBy("rid").agg(F.count("*").alias("kept"), F.sum(F.col("end") - F.col("start")).alias("aligned")).where("kept <= 10")


@query(f""", seg AS (SELECT rid AS read_id, chr AS ref_id, "start" AS ref_start, "end" - "start" AS len, "start" % 7 AS mapq, hp, row_number() OVER () AS u FROM read),
good AS (SELECT *, row_number() OVER (PARTITION BY read_id, ref_start ORDER BY ref_id, len, hp) AS k, count(*) OVER (PARTITION BY read_id) AS raw FROM seg QUALIFY TRUE),
pass AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id, ref_start ORDER BY ref_id, ref_start, len) AS j FROM good WHERE mapq > 1 AND len > 100) WHERE j = 1)
SELECT read_id, count(*) AS segments, CAST(sum(len) AS BIGINT) AS aligned FROM pass GROUP BY read_id, raw HAVING sum(len) >= 1000 AND sum(len) / 20000.0 >= 0.5 AND raw <= 10""")
def filter_reads(spark, sf_dir):
    r = v.read(spark, sf_dir)
    length = F.col("end") - F.col("start")
    rows = r.select(
        F.col("start").alias("read_start"), F.col("start").alias("ref_start"), (F.col("start") + length).alias("ref_end"), F.col("rid").alias("read_id"), F.col("chr").alias("ref_id"),
        F.lit(20000).cast("long").alias("read_length"), length.alias("segment_length"), (F.col("start") % 7).alias("mapq"), F.lit(0.01).alias("mismatch_rate"), F.lit(False).alias("is_insertion"),
    )
    kept = reads.without_insertions(reads.filter_reads(rows, min_mapq=1))
    return kept.groupBy("read_id").agg(F.count("*").alias("segments"), F.sum("segment_length").alias("aligned"))


@query(f""", n AS (SELECT *, lag(hp1) OVER w AS l, lead(hp1) OVER w AS r FROM bins WINDOW w AS (PARTITION BY chr ORDER BY "start"))
SELECT chr, "start", round(CASE WHEN (coalesce(l, r) + coalesce(r, l)) / 2 > 0 AND hp1 > 1.5 * (coalesce(l, r) + coalesce(r, l)) / 2 THEN (coalesce(l, r) + coalesce(r, l)) / 2 ELSE hp1 END, 6) AS hp1 FROM n""")
def tame_outliers(spark, sf_dir):
    return cov.tame_outliers(v.bins(spark, sf_dir), "hp1", 1.5).select("chr", "start", _r("hp1"))


@query(f""", i AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY "start") - 1 AS i FROM bins),
m AS (SELECT a.chr, a.i - 5 AS j, sum(b.hp1 * (5 - abs(b.i - a.i - 5))) / 25.0 AS m FROM i a JOIN i b ON a.chr = b.chr AND b.i BETWEEN a.i AND a.i + 10 GROUP BY 1, 2)
SELECT i.chr, "start", round(m, 6) AS hp1 FROM i JOIN m ON i.chr = m.chr AND m.j = greatest(0, least(i.i - 7, {v.LENGTH // B} - 16))""")
def smooth(spark, sf_dir):
    return cov.smooth(v.bins(spark, sf_dir), "hp1").select("chr", "start", _r("hp1"))


@query("""SELECT chr, k AS part, round(avg(hp1), 6) AS hp1 FROM (SELECT chr, hp1, (row_number() OVER (PARTITION BY chr ORDER BY "start") - 1) // 20 AS k FROM bins) GROUP BY 1, 2""")
def mean_of_every(spark, sf_dir):
    return cov.mean_of_every(v.bins(spark, sf_dir), "hp1").select("chr", "part", _r("hp1"))


@query("SELECT round(avg(hp1 + hp2), 6) AS mean_depth, count(*) AS n FROM bins")
def mean_depth(spark, sf_dir):
    return v.bins(spark, sf_dir).agg(F.round(F.avg(F.col("hp1") + F.col("hp2")), 6).alias("mean_depth"), F.count("*").alias("n"))


# --- SNPs ---------------------------------------------------------------------------------------------------


def _genotyped(spark, sf_dir):
    gt = F.when(F.col("et") == "purchase", "1/1").when(F.col("et") == "click", "0|1").otherwise("1|0")
    return v.snp(spark, sf_dir).select("chr", "pos", "value", gt.alias("gt"))


_ZYG = """, z AS (SELECT chr, (pos - 1) // 200000 * 200000 + 1 AS "start", count(*) FILTER (WHERE et <> 'purchase') AS hets, count(*) FILTER (WHERE et = 'purchase') AS homs FROM snp WHERE pos > 1 AND (pos - 1) % 200000 <> 0 GROUP BY 1, 2)"""


@query(_ZYG + """ SELECT chr, "start", hets, homs, round(hets / (hets + homs), 6) AS hets_ratio, round(homs / (hets + homs), 6) AS homs_ratio FROM z""")
def zygosity(spark, sf_dir):
    counts = snps.zygosity_counts(_genotyped(spark, sf_dir))
    return counts.join(snps.zygosity_ratios(counts), ["chr", "start"]).select("chr", "start", "hets", "homs", _r("hets_ratio"), _r("homs_ratio"))


@query(_ZYG + """, f AS (SELECT chr, "start", "start" - lag("start") OVER (PARTITION BY chr ORDER BY "start") AS gap FROM z WHERE hets / (hets + homs) < 0.8),
g AS (SELECT chr, "start", sum(CASE WHEN gap <= 400000 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY "start") AS run FROM f)
SELECT chr, min("start") + 200000 AS "start", max("start") + 199999 AS "end" FROM g GROUP BY chr, run""")
def loh_islands(spark, sf_dir):
    return snps.loh_regions(snps.zygosity_counts(_genotyped(spark, sf_dir)), het_ratio=0.8)


@query(_ZYG + """, f AS (SELECT c.chr, b * 200000 + 1 AS "start" FROM contigs c CROSS JOIN range(0, 15) g(b) WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.chr = c.chr AND z."start" = b * 200000 + 1)),
l AS (SELECT chr, "start", "start" - lag("start") OVER (PARTITION BY chr ORDER BY "start") AS gap FROM f),
g AS (SELECT chr, "start", sum(CASE WHEN gap <= 400000 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY "start") AS run FROM l)
SELECT chr, min("start") + 200000 AS "start", max("start") + 199999 AS "end" FROM g GROUP BY chr, run""")
def empty_regions(spark, sf_dir):
    bins = v.contigs(spark, sf_dir).select("chr", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2_800_001).cast("long"), F.lit(200_000).cast("long"))).alias("start"))
    return snps.empty_regions(snps.zygosity_counts(_genotyped(spark, sf_dir)), bins)


@query(f""", p AS (SELECT chr, pos, round_even(least(floor(value), floor(value * 0.6)) / (floor(value) + floor(value * 0.6) + 1e-7), 3) AS vaf FROM snp),
b AS (SELECT chr, "start" AS pos FROM bins)
SELECT b.chr, b.pos, round(CASE WHEN count(p.vaf) >= 5 THEN avg(p.vaf) ELSE 3300 END + 1e-9, 5) AS vaf FROM b LEFT JOIN p ON p.chr = b.chr AND p.pos > b.pos AND p.pos < b.pos + {B} GROUP BY 1, 2""")
def baf_bins(spark, sf_dir):
    freqs = v.snp(spark, sf_dir).select("chr", "pos", F.floor("value").alias("freq_value_a"), F.floor(F.col("value") * 0.6).alias("freq_value_b"))
    return snps.baf_from_depths(freqs, v.bins(spark, sf_dir).select("chr", F.col("start").alias("pos")), B).select("chr", "pos", F.round(F.col("vaf") + 1e-9, 5).alias("vaf"))


@query(f""", b AS (SELECT chr, "start" AS pos FROM bins)
SELECT b.chr, b.pos, round(CASE WHEN count(p.x) >= 5 THEN avg(p.x) ELSE 3300 END, 6) AS vaf FROM b LEFT JOIN (SELECT chr, pos, CASE WHEN value / 100 > 0.5 THEN 1 - value / 100 ELSE value / 100 END AS x FROM snp WHERE et <> 'purchase') p ON p.chr = b.chr AND p.pos > b.pos AND p.pos < b.pos + {B} GROUP BY 1, 2""")
def baf_from_vcf(spark, sf_dir):
    rows = _genotyped(spark, sf_dir).withColumn("vaf", F.col("value") / 100)
    return snps.baf_from_vcf(rows, v.bins(spark, sf_dir).select("chr", F.col("start").alias("pos")), B).select("chr", "pos", _r("vaf"))


@query("""SELECT g.chr, g."start", g."end", count(*) FILTER (WHERE s.et <> 'purchase' AND s.pos IS NOT NULL) AS hets_count, count(*) FILTER (WHERE s.et = 'purchase') AS homos_count FROM (SELECT DISTINCT chr, "start", "end" FROM gene) g
LEFT JOIN snp s ON s.chr = g.chr AND s.pos > g."start" AND s.pos < g."end" GROUP BY 1, 2, 3""")
def region_counts(spark, sf_dir):
    return snps.region_counts(_genotyped(spark, sf_dir), v.gene(spark, sf_dir).select("chr", "start", "end").distinct())


@query("""SELECT chr, pos, CASE WHEN et = 'click' THEN a2 ELSE a1 END AS freq_value_a, CASE WHEN et = 'click' THEN a1 ELSE a2 END AS freq_value_b FROM
(SELECT chr, pos, et, CAST(floor(value) AS BIGINT) AS a1, CAST(floor(value * 2) AS BIGINT) AS a2 FROM snp WHERE et <> 'purchase')""")
def allele_depths(spark, sf_dir):
    rows = _genotyped(spark, sf_dir).where("gt <> '1/1'")
    counts = {"A": F.floor("value").cast("long"), "C": F.floor(F.col("value") * 2).cast("long"), "G": F.lit(0), "T": F.lit(0)}
    one, two = sc.allele_depths(F.col("gt"), F.lit("A"), F.lit("C"), counts)
    return rows.select("chr", "pos", one.cast("long").alias("freq_value_a"), two.cast("long").alias("freq_value_b"))


@query("""SELECT chr, pos, count(*) FILTER (WHERE b = 'A') AS a, count(*) FILTER (WHERE b = 'C') AS c, count(*) FILTER (WHERE b = 'G') AS g, count(*) FILTER (WHERE b = 'T') AS t
FROM (SELECT chr, pos // 1000 AS pos, CASE et WHEN 'view' THEN 'A' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'G' ELSE 'T' END AS b FROM snp WHERE value >= 5) GROUP BY 1, 2""")
def base_counts(spark, sf_dir):
    base = F.when(F.col("et") == "view", "A").when(F.col("et") == "click", "C").when(F.col("et") == "purchase", "G").otherwise("T")
    rows = v.snp(spark, sf_dir).select("chr", F.floor(F.col("pos") / 1000).alias("start"), base.alias("base"), F.floor("value").alias("mapq"), F.lit(30).alias("baseq"))
    return snps.count_bases(rows).select("chr", F.col("start").alias("pos"), *(F.col(x).cast("long").alias(x) for x in "acgt"))


# --- intervals ----------------------------------------------------------------------------------------------


@query(""", s AS (SELECT DISTINCT chr, pos FROM snp), d AS (SELECT b.chr, b.ps, b."start" AS pos, s.pos AS near, row_number() OVER (PARTITION BY b.chr, b.ps ORDER BY abs(s.pos - b."start"), s.pos) AS k FROM blk b JOIN s ON s.chr = b.chr)
SELECT chr, ps, pos, near FROM d WHERE k = 1""")
def nearest_asof(spark, sf_dir):
    return iv.nearest(v.blk(spark, sf_dir).select("chr", "ps", F.col("start").alias("pos")), v.snp(spark, sf_dir)).where("near IS NOT NULL").select("chr", "ps", "pos", "near")


_RANKED = """, r AS (SELECT chr, pos, value, row_number() OVER (PARTITION BY chr ORDER BY pos, value) AS rank FROM snp QUALIFY row_number() OVER (PARTITION BY chr, pos ORDER BY value) = 1),
rr AS (SELECT chr, pos, value, row_number() OVER (PARTITION BY chr ORDER BY pos) AS rank FROM r),
n1 AS (SELECT t.chr, t.key, arg_min(rr.rank, abs(rr.pos - t."start") * 10000000 + rr.pos) AS a, arg_min(rr.rank, abs(rr.pos - t."end") * 10000000 + rr.pos) AS b FROM {t} t JOIN rr ON rr.chr = t.chr GROUP BY 1, 2)
SELECT t.chr, t.key AS {key}, round(coalesce({agg}, 0), 6) AS value FROM {t} t LEFT JOIN n1 ON n1.chr = t.chr AND n1.key = t.key LEFT JOIN rr ON rr.chr = t.chr AND rr.rank >= n1.a AND rr.rank < n1.b GROUP BY 1, 2"""


def _one_per_place(spark, sf_dir):
    return v.snp(spark, sf_dir).groupBy("chr", "pos").agg(F.min("value").alias("value"))


@query(_RANKED.format(t="(SELECT *, gene AS key FROM gene)", key="gene", agg="avg(rr.value)"))
def gene_snp_mean(spark, sf_dir):
    return cov.snp_interval_values(_one_per_place(spark, sf_dir), v.gene(spark, sf_dir), ("value",), True).select("chr", "gene", _r("value"))


@query(_RANKED.format(t="(SELECT chr, ps AS key, \"start\", \"start\" + 100000 AS \"end\" FROM blk)", key="ps", agg="median(CASE WHEN rr.value <> 0 THEN rr.value END)"))
def block_snp_median(spark, sf_dir):
    blocks = v.blk(spark, sf_dir).select("chr", "ps", "start", (F.col("start") + 100_000).alias("end"))
    return cov.snp_interval_values(_one_per_place(spark, sf_dir), blocks, ("value",), False).select("chr", "ps", _r("value"))


@query(""", a AS (SELECT chr, "start", "end" FROM blk WHERE ps % 2 = 0), b AS (SELECT chr, "start", "end" FROM blk WHERE ps % 2 = 1),
p AS (SELECT DISTINCT chr, x FROM (SELECT chr, "start" AS x FROM blk UNION ALL SELECT chr, "end" FROM blk)),
f AS (SELECT chr, x AS s, lead(x) OVER (PARTITION BY chr ORDER BY x) AS e FROM p)
SELECT chr, s AS "start", e AS "end" FROM f WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.chr = f.chr AND a."start" <= s AND a."end" >= e) AND NOT EXISTS (SELECT 1 FROM b WHERE b.chr = f.chr AND b."start" <= s AND b."end" >= e)""")
def interval_subtract(spark, sf_dir):
    blocks = v.blk(spark, sf_dir).select("chr", "start", "end", "ps")
    return iv.subtract(blocks.where("ps % 2 = 0"), blocks.where("ps % 2 = 1"))


@query("""SELECT g.chr, g.gene, g."start", g."end" FROM gene g WHERE NOT EXISTS (SELECT 1 FROM blk b WHERE b.chr = g.chr AND b."end" >= g."start" AND b."start" <= g."end")
UNION ALL SELECT chr, 'blk' || CAST(ps AS VARCHAR), "start", "end" FROM blk""")
def add_missing(spark, sf_dir):
    blocks = v.blk(spark, sf_dir).select("chr", F.concat(F.lit("blk"), F.col("ps").cast("string")).alias("gene"), "start", "end")
    lonely = iv.overlap_join(v.gene(spark, sf_dir).select("chr", "gene", "start", "end"), blocks.select("chr", "start", "end"), how="left_anti", bucket=100_000)
    return blocks.unionByName(lonely)


@query("""SELECT g.chr, g.gene, g."start", g."end" FROM gene g WHERE EXISTS (SELECT 1 FROM blk b WHERE b.chr = g.chr AND b."end" > g."start" AND b."start" < g."end")""")
def overlap_semi(spark, sf_dir):
    return iv.overlap_join(v.gene(spark, sf_dir).select("chr", "gene", "start", "end"), v.blk(spark, sf_dir).select("chr", "start", "end"), closed=False, how="left_semi", bucket=100_000)


@query("""SELECT g.chr, g.gene, count(*) AS n, CAST(sum(least(g."end", b."end") - greatest(g."start", b."start")) AS BIGINT) AS shared FROM gene g JOIN blk b ON b.chr = g.chr AND b."end" >= g."start" AND b."start" <= g."end" GROUP BY 1, 2""")
def overlap_length(spark, sf_dir):
    found = iv.overlap_totals(v.gene(spark, sf_dir), v.blk(spark, sf_dir).select("chr", "start", "end"))
    return found.groupBy("chr", "gene").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared"))


@query("""SELECT s.chr, s.pos, min(g."start") AS "start" FROM (SELECT DISTINCT chr, pos FROM snp) s JOIN gene g ON g.chr = s.chr AND s.pos BETWEEN g."start" AND g."end" GROUP BY 1, 2""")
def first_containing(spark, sf_dir):
    hit = iv.first_containing(v.snp(spark, sf_dir).select("chr", "pos").distinct(), v.gene(spark, sf_dir).select("chr", "start", "end", "gene"), ["chr", "pos"])
    return hit.select("chr", "pos", F.col("hit.r_start").alias("start"))


@query(""", p AS (SELECT chr, "start" AS x FROM cen UNION SELECT chr, "end" FROM cen), e AS (SELECT g.gene, g.chr, x FROM gene g JOIN p ON p.chr = g.chr AND x > g."start" AND x < g."end" UNION SELECT gene, chr, "start" FROM gene UNION SELECT gene, chr, "end" FROM gene),
l AS (SELECT chr, gene, x AS "start", lead(x) OVER (PARTITION BY gene ORDER BY x) AS "end" FROM e)
SELECT chr, gene, "start", "end" FROM l WHERE "end" IS NOT NULL""")
def split_at(spark, sf_dir):
    points = v.centromeres(spark, sf_dir).select("chr", F.explode(F.array("start", "end")).alias("pos"))
    return iv.split_at(v.gene(spark, sf_dir).where("end > start"), points).select("chr", "gene", "start", "end")


@query(""", d AS (SELECT DISTINCT chr, "start" // 1000 AS d FROM blk), l AS (SELECT chr, d, d - lag(d) OVER (PARTITION BY chr ORDER BY d) AS gap FROM d),
g AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY d) AS run FROM l) SELECT chr, min(d) * 1000 AS "start", max(d) * 1000 + 999 AS "end" FROM g GROUP BY chr, run""")
def merge_touching(spark, sf_dir):
    """Days with a block, as intervals of 1000."""
    days = v.blk(spark, sf_dir).select("chr", F.floor(F.col("start") / 1000).alias("d")).distinct()
    return iv.merge_touching(days.select("chr", (F.col("d") * 1000).alias("start"), (F.col("d") * 1000 + 999).alias("end")))


@query(""", s AS (SELECT chr, "start", "end", floor(hp1 / 25) AS state, hp1 AS depth FROM bins), l AS (SELECT *, lag(state) OVER (PARTITION BY chr ORDER BY "start") AS p FROM s),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> state THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY "start") AS run FROM l)
SELECT chr, min("start") AS "start", max("end") AS "end", round(median(depth), 6) AS depth, CAST(min(state) AS DOUBLE) AS state FROM g GROUP BY chr, run""")
def run_merge(spark, sf_dir):
    rows = v.bins(spark, sf_dir).select("chr", "start", "end", F.floor(F.col("hp1") / 25).cast("double").alias("state"), F.col("hp1").alias("depth"))
    return segments.merge_runs(rows).select("chr", "start", "end", _r("depth"), "state")


@query(""", e AS (SELECT chr, max("end") AS len FROM read GROUP BY chr), n AS (SELECT chr, CAST(replace(chr, 'chr', '') AS BIGINT) AS ord, len FROM e) SELECT chr, ord, len, CAST(sum(len) OVER (ORDER BY ord) - len AS BIGINT) AS "offset" FROM n""")
def contig_offsets(spark, sf_dir):
    """Contigs as long as their reads reach."""
    return ct.with_offsets(v.read(spark, sf_dir).groupBy("chr").agg(F.max("end").alias("len"))).select("chr", F.col("chr_ord").cast("long").alias("ord"), "len", "offset")


# --- segments -----------------------------------------------------------------------------------------------


@query(""", p AS (SELECT DISTINCT chr, "start" // 1000 AS pos FROM blk), l AS (SELECT chr, pos, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos) AS gap FROM p) SELECT chr, pos FROM l WHERE gap IS NULL OR gap <> 1""")
def thin_points(spark, sf_dir):
    return segments.thin(v.blk(spark, sf_dir).select("chr", F.floor(F.col("start") / 1000).alias("pos")).distinct())


@query(f""", p AS (SELECT chr, "start" AS pos FROM blk), t AS (SELECT chr, pos, pos // {B} AS b FROM p UNION ALL SELECT chr, pos, pos // {B} - 1 FROM p WHERE pos % {B} = 0) SELECT DISTINCT chr, min(pos) AS pos FROM t GROUP BY chr, b""")
def first_in_bin(spark, sf_dir):
    return segments.first_in_bin(v.blk(spark, sf_dir).select("chr", F.col("start").alias("pos")), B)


_POINTS = f""", p AS (SELECT chr, "start" AS pos FROM blk WHERE "start" > 0 AND "start" NOT BETWEEN 1000000 AND 1199999 UNION SELECT chr, {v.LENGTH} FROM contigs UNION SELECT chr, "start" FROM cen UNION SELECT chr, "end" FROM cen),
q AS (SELECT chr, pos, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos) AS gap FROM p),
c AS (SELECT chr, coalesce(lag(pos) OVER (PARTITION BY chr ORDER BY pos), 0) AS f, pos AS e FROM q WHERE (gap IS NULL OR gap <> 1) AND pos >= 2)"""


def _seg(name: str, value: str) -> str:
    """Segments between the cut points with the median of one haplotype."""
    return f""",
{name} AS (SELECT c.chr, CASE WHEN f = 0 THEN 0 ELSE f + 1 END AS "start", e AS "end", CASE WHEN e = 1199999 THEN 0 ELSE coalesce(median(CASE WHEN {value} <> 0 THEN {value} END), 0) END AS state
  FROM c LEFT JOIN bins ON bins.chr = c.chr AND bins."start" // {B} >= f // {B} AND bins."start" // {B} < e // {B} GROUP BY c.chr, f, e)"""


_CUTS = _POINTS + _seg("seg", "hp1")


def _segments(spark, sf_dir, value="hp1"):
    """Segments between all block starts."""
    points = v.blk(spark, sf_dir).where("start > 0 AND start NOT BETWEEN 1000000 AND 1199999").select("chr", F.col("start").alias("pos")).distinct()
    cen = v.centromeres(spark, sf_dir)
    points = points.union(v.contigs(spark, sf_dir).select("chr", F.col("len").alias("pos"))).union(cen.select("chr", F.explode(F.array("start", "end"))))
    return segments.cut_segments(v.bins(spark, sf_dir).select("chr", "start", F.col(value).alias("value")), points, B, cen.select("chr", "end"))


#: A state of four digits, or a little more, so that no rounding to two digits meets a tie.
_STEADY = "CASE WHEN state = 0 THEN 0 ELSE round(state + 1e-9, 4) + 0.00001 END"
_BOTH = _POINTS + _seg("raw1", "hp1") + _seg("raw2", "hp2") + "".join(f""",
s{h} AS (SELECT chr, "start", "end", {_STEADY} AS state FROM raw{h})""" for h in (1, 2))


def _steady(spark, sf_dir, hp):
    state = F.when(F.col("state") == 0, 0.0).otherwise(F.round(F.col("state") + 1e-9, 4) + 0.00001)
    return _segments(spark, sf_dir, f"hp{hp}").withColumn("state", state)


def _sql_horner(x: str, coefficients) -> str:
    out = f"({coefficients[0]!r} * {x} + {coefficients[1]!r})"
    for c in coefficients[2:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _sql_p(z: str) -> str:
    """The two-sided p-value where z is the distance in deviations over the root of 2."""
    low = f"1 - {z} * {_sql_horner(f'({z} * {z})', sc.ERFC_LOW[0])} / {_sql_horner(f'({z} * {z})', sc.ERFC_LOW[1])}"
    middle = f"exp(-({z} * {z})) * {_sql_horner(z, sc.ERFC_MIDDLE[0])} / {_sql_horner(z, sc.ERFC_MIDDLE[1])}"
    r = f"(1.0 / ({z} * {z}))"
    high = f"exp(-({z} * {z})) * (0.5641895835477563 - {r} * {_sql_horner(r, sc.ERFC_HIGH[0])} / {_sql_horner(r, sc.ERFC_HIGH[1])}) / {z}"
    return f"CAST(round_even(CASE WHEN {z} <= 0.46875 THEN {low} WHEN {z} <= 4 THEN {middle} ELSE {high} END, 7) AS DOUBLE)"


def _sql_near(x: str) -> str:
    return f"CASE WHEN {x} <= 10 THEN 0 WHEN {x} <= 30 THEN 20 WHEN {x} <= 50 THEN 40 WHEN {x} <= 70 THEN 60 ELSE 80 END"


@query(_CUTS + ' SELECT chr, "start", "end", round(state, 6) AS state FROM seg')
def cut_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("chr", "start", "end", _r("state"))


@query(f""", e AS (SELECT chr, 0 AS x FROM contigs UNION SELECT chr, len FROM contigs UNION SELECT chr, "start" FROM gene UNION SELECT chr, "end" FROM gene UNION SELECT chr, "start" FROM blk),
l AS (SELECT chr, x AS f, lead(x) OVER (PARTITION BY chr ORDER BY x) AS t FROM e WHERE x <= {v.LENGTH}),
k AS (SELECT chr, CASE WHEN f + k * {B} = 0 THEN 0 ELSE f + k * {B} + 1 END AS "start", least(f + (k + 1) * {B}, t) AS "end" FROM l, range(0, {v.LENGTH // B + 1}) g(k) WHERE t > f AND k < ceil((t - f) / {B}))
SELECT chr, "start", "end" FROM k GROUP BY ALL HAVING count(*) = 1""")
def variable_bins(spark, sf_dir):
    points = v.blk(spark, sf_dir).select("chr", F.col("start").alias("pos"))
    return segments.variable_bins(v.contigs(spark, sf_dir), v.gene(spark, sf_dir).select("chr", "start", "end"), points, B)


@query(f""", x AS (SELECT chr, "start" // {B} AS i, CAST(trunc(hp1) AS DOUBLE) AS x FROM bins),
d AS (SELECT a.chr, a.i, b.i AS j, (a.x - b.x) * (a.x - b.x) AS d FROM x a JOIN x b ON a.chr = b.chr),
gm AS (SELECT chr, CASE WHEN median(d) > 0 THEN 1 / median(d) ELSE 1 END AS gamma FROM d WHERE i < j GROUP BY chr),
g AS (SELECT d.chr, i // 5 AS u, j // 5 AS w, sum(exp(-greatest(0.01, least(100, gamma * d)))) AS k FROM d JOIN gm USING (chr) GROUP BY 1, 2, 3),
co AS (SELECT g.chr, e, s, (e - s) * 5 - sum(k) / ((e - s) * 5) AS cost FROM g, range(1, 13) r(e), range(0, 12) q(s) WHERE s < e AND u >= s AND u < e AND w >= s AND w < e GROUP BY g.chr, e, s),
cl AS (SELECT chr, e, list(cost ORDER BY s) AS costs FROM co GROUP BY chr, e),
dp(chr, k, best, origin) AS (SELECT chr, 0, [CAST(0 AS DOUBLE)], [-1] FROM gm
  UNION ALL SELECT chr, k + 1, list_append(best, list_min(tried)), list_append(origin, list_position(tried, list_min(tried)) - 1)
  FROM (SELECT dp.chr, k, best, origin, list_transform(costs, lambda c, i: best[i] + c + 3.0) AS tried FROM dp JOIN cl ON cl.chr = dp.chr AND cl.e = dp.k + 1)),
bt(chr, k, origin) AS (SELECT chr, 12, origin FROM dp WHERE k = 12 UNION ALL SELECT chr, origin[k + 1], origin FROM bt WHERE origin[k + 1] > 0)
SELECT chr, 1 AS hp, k * 5 * {B} AS pos FROM bt""", recursive=True)
def change_points(spark, sf_dir):
    bins = v.bins(spark, sf_dir)
    return segments.change_points(bins.select("chr", F.lit(1).alias("hp"), "start", F.col("hp1").alias("value")), B, penalty=3.0, jump=5)


@query(f""", z AS (SELECT chr, 1 AS hp, "start", hp1 AS x FROM bins WHERE hp1 <> 0 UNION ALL SELECT chr, 2, "start", hp2 FROM bins WHERE hp2 <> 0),
gm AS (SELECT median(x) AS m FROM z),
y AS (SELECT chr, x, row_number() OVER (PARTITION BY chr ORDER BY hp, "start") AS i, count(*) OVER (PARTITION BY chr) AS n FROM z),
cs AS (SELECT chr, i, n, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM y WINDOW w AS (PARTITION BY chr ORDER BY i) UNION ALL SELECT chr, 0, n, 0, 0 FROM y WHERE i = 1),
en AS (SELECT chr, i, s, q, n, row_number() OVER (PARTITION BY chr ORDER BY i) - 1 AS k FROM cs WHERE i = 0 OR i = n OR (i % 2 = 0 AND i >= 10)),
co AS (SELECT b.chr, b.k AS e, list(CASE WHEN b.i - a.i >= 10 OR (a.k = 0 AND b.i = b.n) THEN b.q - a.q - (b.s - a.s) * (b.s - a.s) / (b.i - a.i) ELSE 1e300 END ORDER BY a.k) AS costs FROM en b JOIN en a ON a.chr = b.chr AND a.k < b.k GROUP BY 1, 2),
pe AS (SELECT chr, max(k) AS last, ln(greatest(2, max(n))) * max(m) * max(m) AS pen FROM en, gm GROUP BY chr),
dp(chr, k, best, origin) AS (SELECT chr, CAST(0 AS BIGINT), [CAST(0 AS DOUBLE)], [CAST(-1 AS BIGINT)] FROM pe
  UNION ALL SELECT chr, k + 1, list_append(best, list_min(tried)), list_append(origin, CAST(list_position(tried, list_min(tried)) - 1 AS BIGINT))
  FROM (SELECT dp.chr, dp.k, best, origin, list_transform(costs, lambda c, j: best[j] + c + pen) AS tried FROM dp JOIN co ON co.chr = dp.chr AND co.e = dp.k + 1 JOIN pe ON pe.chr = dp.chr)),
bt(chr, k, origin) AS (SELECT dp.chr, k, origin FROM dp JOIN pe ON pe.chr = dp.chr AND dp.k = pe.last UNION ALL SELECT chr, origin[k + 1], origin FROM bt WHERE origin[k + 1] > 0),
pt AS (SELECT bt.chr, en.i AS e, coalesce(lag(en.i) OVER (PARTITION BY bt.chr ORDER BY en.i), 0) AS s FROM bt JOIN en ON en.chr = bt.chr AND en.k = bt.k)
SELECT pt.chr, pt.e - pt.s AS length, round(median(y.x) + 1e-9, 5) AS coverage FROM pt JOIN y ON y.chr = pt.chr AND y.i > pt.s AND y.i <= pt.e GROUP BY pt.chr, pt.s, pt.e""", recursive=True)
def coverage_segments(spark, sf_dir):
    return segments.coverage_segments(v.bins(spark, sf_dir), B, 500_000, 100_000).select("chr", "length", F.round(F.col("coverage") + 1e-9, 5).alias("coverage"))


@query(""", o AS (SELECT chr, "start", "end", row_number() OVER (PARTITION BY chr ORDER BY "start", "end") AS i FROM gene),
f(chr, i, "start", "end", reach, kept) AS (SELECT chr, i, "start", "end", "end", TRUE FROM o WHERE i = 1
  UNION ALL SELECT o.chr, o.i, o."start", o."end", CASE WHEN o."start" > f.reach THEN o."end" ELSE f.reach END, o."start" > f.reach FROM f JOIN o ON o.chr = f.chr AND o.i = f.i + 1)
SELECT chr, "start", "end" FROM f WHERE kept""", recursive=True)
def keep_first_disjoint(spark, sf_dir):
    return segments.keep_first_disjoint(v.gene(spark, sf_dir).select("chr", "start", "end"))


@query(""", w AS (SELECT chr, (row_number() OVER (PARTITION BY chr ORDER BY "start") - 1) // 10 AS part, hp1 FROM bins WHERE hp1 <> 0), m AS (SELECT chr, part, median(hp1) AS m, stddev_pop(hp1) AS d FROM w GROUP BY 1, 2)
SELECT chr, part, round(m + 1e-9, 5) AS median FROM m WHERE d <= (SELECT quantile_cont(d, 0.9) + 1e-9 FROM m)""")
def window_medians(spark, sf_dir):
    return cov.window_medians(v.bins(spark, sf_dir), "hp1", 10).select("chr", "part", F.round(F.col("median") + 1e-9, 5).alias("median"))


# --- phase --------------------------------------------------------------------------------------------------


@query("""SELECT chr, ps % 40 AS phasesets, min("start") AS "start", max("start") AS "end" FROM blk GROUP BY 1, 2 HAVING max("start") - min("start") >= 300000""")
def phaseset_minmax(spark, sf_dir):
    positions = v.blk(spark, sf_dir).select("chr", F.col("start").alias("position"), (F.col("ps") % 40).alias("phasesets"))
    return phase.long_enough(phase.block_extents(positions))


@query(""", o AS (SELECT chr, "start", "end", row_number() OVER (PARTITION BY chr ORDER BY "start", "end" - "start" DESC, ps) AS i FROM blk),
f(chr, i, s, e, fresh) AS (SELECT chr, i, "start", "end", TRUE FROM o WHERE i = 1
  UNION ALL SELECT o.chr, o.i, CASE WHEN o."start" > f.e OR o."end" - o."start" > f.e - f.s THEN o."start" ELSE f.s END, CASE WHEN o."start" > f.e OR o."end" - o."start" > f.e - f.s THEN o."end" ELSE f.e END, o."start" > f.e
  FROM f JOIN o ON o.chr = f.chr AND o.i = f.i + 1),
n AS (SELECT chr, s, e, lead(fresh) OVER (PARTITION BY chr ORDER BY i) AS next FROM f) SELECT chr, s AS "start", e AS "end" FROM n WHERE coalesce(next, TRUE)""", recursive=True)
def keep_longer(spark, sf_dir):
    return phase.keep_longer(v.blk(spark, sf_dir).select("chr", F.col("ps").alias("phasesets"), "start", "end"))


_BLOCKS = """, g AS (SELECT chr, ps % 25 AS k, CAST(floor(avg(hp1)) AS DOUBLE) AS hp1, CAST(floor(avg(hp2)) AS DOUBLE) AS hp2 FROM blk GROUP BY 1, 2),
b AS (SELECT chr, k * 100000 AS "start", k * 100000 + 80000 AS "end", hp1, hp2 FROM g)"""


def _blocks(spark, sf_dir):
    """Blocks side by side, one for each of 25 places of a contig."""
    k = F.col("ps") % 25
    rows = v.blk(spark, sf_dir).groupBy("chr", k.alias("k")).agg(F.floor(F.avg("hp1")).cast("double").alias("hp1"), F.floor(F.avg("hp2")).cast("double").alias("hp2"))
    return rows.select("chr", (F.col("k") * 100_000).alias("start"), (F.col("k") * 100_000 + 80_000).alias("end"), "hp1", "hp2")


_FLIP = _BLOCKS + """, o AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY "start") AS i FROM b),
f(chr, i, "start", "end", hp1, hp2, flip) AS (SELECT chr, i, "start", "end", hp1, hp2, FALSE FROM o WHERE i = 1
  UNION ALL SELECT o.chr, o.i, o."start", o."end", CASE WHEN t < c THEN o.hp2 ELSE o.hp1 END, CASE WHEN t < c THEN o.hp1 ELSE o.hp2 END, t < c
  FROM (SELECT f.chr, f.i, least(abs(f.hp1 - o.hp1), abs(f.hp2 - o.hp2)) AS c, least(abs(f.hp1 - o.hp2), abs(f.hp2 - o.hp1)) AS t FROM f JOIN o ON o.chr = f.chr AND o.i = f.i + 1) x JOIN o ON o.chr = x.chr AND o.i = x.i + 1)"""


@query(_FLIP + ' SELECT chr, "start", "end", flip FROM f', recursive=True)
def flip_parity(spark, sf_dir):
    return phase.flips(_blocks(spark, sf_dir)).select("chr", "start", "end", "flip")


@query(_FLIP + """ SELECT bins.chr, bins."start", CASE WHEN f.flip THEN bins.hp2 ELSE bins.hp1 END AS hp1, CASE WHEN f.flip THEN bins.hp1 ELSE bins.hp2 END AS hp2, coalesce(f.flip, FALSE) AS flip
FROM bins LEFT JOIN f ON f.chr = bins.chr AND f.flip AND bins."start" BETWEEN f."start" AND f."end\"""", recursive=True)
def flipped_bins(spark, sf_dir):
    return phase.apply_flips(v.bins(spark, sf_dir), phase.flips(_blocks(spark, sf_dir))).select("chr", "start", "hp1", "hp2", "flip")


_GAPS = _BLOCKS + """, l AS (SELECT chr, "end" + 1 AS s, lead("start") OVER w - 1 AS e, CASE WHEN hp1 > hp2 THEN 1 WHEN hp1 < hp2 THEN 2 ELSE 0 END AS d, lead(CASE WHEN hp1 > hp2 THEN 1 WHEN hp1 < hp2 THEN 2 ELSE 0 END) OVER w AS n FROM b WINDOW w AS (PARTITION BY chr ORDER BY "start")),
gap AS (SELECT chr, s AS "start", e AS "end", d AS hp FROM l WHERE d = n AND d <> 0 AND e >= s)"""


@query(_GAPS + ' SELECT chr, "start", "end", hp FROM gap')
def phase_gaps(spark, sf_dir):
    return phase.gaps(_blocks(spark, sf_dir))


@query(_GAPS + """ SELECT bins.chr, bins."start", CASE WHEN (hp = 1 AND hp1 < hp2) OR (hp = 2 AND hp1 > hp2) THEN hp2 ELSE hp1 END AS hp1, CASE WHEN (hp = 1 AND hp1 < hp2) OR (hp = 2 AND hp1 > hp2) THEN hp1 ELSE hp2 END AS hp2
FROM bins LEFT JOIN gap ON gap.chr = bins.chr AND bins."start" BETWEEN gap."start" AND gap."end\"""")
def fill_gaps(spark, sf_dir):
    return phase.fill_gaps(v.bins(spark, sf_dir), _blocks(spark, sf_dir)).select("chr", "start", "hp1", "hp2")


@query(_BLOCKS + """, l AS (SELECT *, lag(hp1) OVER w AS p1, lag(hp2) OVER w AS p2, lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM b WINDOW w AS (PARTITION BY chr ORDER BY "start")),
m AS (SELECT *, sum(CASE WHEN p1 IS NOT NULL AND (p1 < p2) = (hp1 < hp2) AND abs(p1 - p2) > least(0.3 * least(p1, p2), 10) AND abs(hp1 - hp2) > least(0.3 * least(hp1, hp2), 10) AND "start" - pe < (pe - ps + "end" - "start") / 2 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY "start") AS run FROM l)
SELECT chr, min("start") AS "start", max("end") AS "end", round(avg(hp1), 6) AS hp1, round(avg(hp2), 6) AS hp2 FROM m GROUP BY chr, run
HAVING count(*) > 1 OR (abs(avg(hp1) - avg(hp2)) > least(0.3 * least(avg(hp1), avg(hp2)), 10) AND max("end") - min("start") > 50000)""")
def merge_groups(spark, sf_dir):
    return phase.merge_groups(_blocks(spark, sf_dir), 50_000).select("chr", "start", "end", _r("hp1"), _r("hp2"))


@query(_BLOCKS + """ SELECT b.chr, CASE WHEN b."start" < cen."end" AND cen."end" < b."end" AND NOT (b."start" < cen."start" AND cen."start" < b."end") THEN cen."end" ELSE b."start" END AS "start",
CASE WHEN b."start" < cen."start" AND cen."start" < b."end" THEN cen."start" ELSE b."end" END AS "end", hp1, hp2 FROM b LEFT JOIN (SELECT chr, "start" + 30000 AS "start", "end" FROM cen) cen ON cen.chr = b.chr WHERE NOT coalesce(cen."start" < b."start" AND b."end" < cen."end", FALSE)""")
def clip_centromeres(spark, sf_dir):
    cen = v.centromeres(spark, sf_dir).withColumn("start", F.col("start") + 30_000)
    return phase.clip_centromeres(_blocks(spark, sf_dir), cen).select("chr", "start", "end", "hp1", "hp2")


@query(""", t AS (SELECT CAST("end" - "start" AS BIGINT) AS length FROM blk), c AS (SELECT length, sum(length) OVER (ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS s, sum(length) OVER () AS t FROM t) SELECT max(length) AS n50 FROM c WHERE s > t * 0.5""")
def n50(spark, sf_dir):
    return phase.n50(v.blk(spark, sf_dir).select((F.col("end") - F.col("start")).alias("length")))


@query(""", bare AS (SELECT chr FROM contigs WHERE chr NOT IN (SELECT chr FROM gene GROUP BY chr HAVING count(*) > (SELECT count(*) / 22 FROM gene)))
SELECT bins.chr, "start", CASE WHEN bare.chr IS NULL THEN hp1 ELSE greatest(hp1, hp2) END AS hp1, CASE WHEN bare.chr IS NULL THEN hp2 ELSE least(hp1, hp2) END AS hp2 FROM bins LEFT JOIN bare ON bare.chr = bins.chr""")
def larger_first(spark, sf_dir):
    """Contigs with more genes than the mean count as those with blocks."""
    genes = v.gene(spark, sf_dir)
    many = genes.groupBy("chr").count().where(F.col("count") > genes.count() / 22)
    return phase.larger_first(v.bins(spark, sf_dir), v.contigs(spark, sf_dir).join(many, "chr", "left_anti")).select("chr", "start", "hp1", "hp2")


_SWITCHES = _BLOCKS + f""", l AS (SELECT chr, "start", "start" + 1200000 AS "end", hp1, hp2 FROM b),
inb AS (SELECT l.chr, l."start" AS block, l."end" AS block_end, bins."start" AS beg, bins."end" AS till, bins.hp1, bins.hp2, CASE WHEN bins.hp1 > bins.hp2 THEN 1 WHEN bins.hp1 < bins.hp2 THEN 2 ELSE 0 END AS hp,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY l.chr, l."start") AS m FROM l JOIN bins ON bins.chr = l.chr AND bins."start" BETWEEN l."start" AND l."end" WINDOW w AS (PARTITION BY l.chr, l."start" ORDER BY bins."start")),
ch AS (SELECT *, CASE WHEN hp = lag(hp) OVER (PARTITION BY chr, block ORDER BY i) THEN 0 ELSE 1 END AS c FROM inb WHERE i < m),
rn AS (SELECT *, sum(c) OVER (PARTITION BY chr, block ORDER BY i) AS run FROM ch),
rl AS (SELECT *, max(i) OVER (PARTITION BY chr, block, run) AS last_i FROM rn),
ru AS (SELECT chr, block, block_end, run, hp, min(i) AS f, max(i) AS t, coalesce(median(CASE WHEN i < last_i AND hp1 <> 0 THEN hp1 END), 0) AS m1, coalesce(median(CASE WHEN i < last_i AND hp2 <> 0 THEN hp2 END), 0) AS m2 FROM rl GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2 AND hp > 0),
ve AS (SELECT chr, block, stddev_pop(CASE WHEN hp = 1 THEN m1 END) < 9 OR stddev_pop(CASE WHEN hp = 2 THEN m2 END) < 9 AS steady FROM ru GROUP BY 1, 2 HAVING count(DISTINCT hp) = 2),
di AS (SELECT chr, block, avg(greatest(hp1, hp2)) - avg(least(hp1, hp2)) > 20 AS wide FROM rn WHERE i < m - 1 GROUP BY 1, 2),
gr AS (SELECT ru.*, steady, wide, CASE WHEN f - lag(t) OVER (PARTITION BY ru.chr, ru.block, hp ORDER BY f) < 2 THEN 0 ELSE 1 END AS n FROM ru JOIN ve USING (chr, block) JOIN di USING (chr, block)),
gs AS (SELECT *, sum(n) OVER (PARTITION BY chr, block, hp ORDER BY f) AS g FROM gr),
pc AS (SELECT chr, block, block_end, steady, wide, hp, g, min(f) AS f, max(t) AS t FROM gs GROUP BY ALL),
pm AS (SELECT pc.chr, pc.block, pc.block_end, steady, wide, pc.hp, f, min(beg) AS s, max(till) AS e, coalesce(median(CASE WHEN i < t AND hp1 <> 0 THEN hp1 END), 0) AS hp1, coalesce(median(CASE WHEN i < t AND hp2 <> 0 THEN hp2 END), 0) AS hp2
  FROM pc JOIN rn ON rn.chr = pc.chr AND rn.block = pc.block AND rn.i BETWEEN f AND t GROUP BY 1, 2, 3, 4, 5, 6, 7),
pk AS (SELECT *, count(*) OVER (PARTITION BY chr, block) AS n, row_number() OVER (PARTITION BY chr, block ORDER BY f) AS k FROM pm),
sw AS (SELECT chr, block, CASE WHEN steady AND wide AND n > 1 AND k = 1 THEN block ELSE s END AS "start", CASE WHEN steady AND wide AND n > 1 AND k = n THEN block_end ELSE e END AS "end", hp, round(hp1 + 1e-9, 5) AS hp1, round(hp2 + 1e-9, 5) AS hp2, steady AND wide AND n > 1 AS broken, NOT steady AS unsteady FROM pk)"""


def _switches(spark, sf_dir):
    long = _blocks(spark, sf_dir).withColumn("end", F.col("start") + 1_200_000)
    return long, phase.switches_inside(v.bins(spark, sf_dir), long, stable=2, deviation=9.0, apart=20.0)


@query(_SWITCHES + " SELECT * FROM sw")
def switches_inside(spark, sf_dir):
    _, found = _switches(spark, sf_dir)
    return found.select("chr", "block", "start", "end", "hp", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("hp1", "hp2")), "broken", "unsteady")


@query(_SWITCHES + """ SELECT chr, "start", "end", hp1, hp2 FROM l WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.chr = l.chr AND sw.block = l."start" AND broken) UNION ALL SELECT chr, "start", "end", hp1, hp2 FROM sw WHERE broken""")
def broken_up(spark, sf_dir):
    long, found = _switches(spark, sf_dir)
    return phase.broken_up(long, found).select("chr", "start", "end", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("hp1", "hp2")))


@query(_BLOCKS + """, big AS (SELECT chr, "start", "start" + 450000 AS "end" FROM b WHERE ("start" // 100000) % 5 = 0), h AS (SELECT b.chr, b."start", b."end", min(big."start") AS home FROM b LEFT JOIN big ON big.chr = b.chr AND b."start" >= big."start" AND b."end" <= big."end" GROUP BY 1, 2, 3)
SELECT chr, "start", "end" FROM h WHERE home IS NULL UNION ALL SELECT chr, min("start"), max("end") FROM h WHERE home IS NOT NULL GROUP BY chr, home""")
def regrouped(spark, sf_dir):
    """All blocks, put together again inside every fifth of their places."""
    blocks = _blocks(spark, sf_dir)
    broken = blocks.where("floor(start / 100000) % 5 = 0").select("chr", "start", (F.col("start") + 450_000).alias("end"))
    return phase.regrouped(blocks, broken)


_FLANKS = _BLOCKS + f""", x AS (SELECT b.chr, b."start", b."end", bins.hp1, bins.hp2, bins."start" // {B} < b."start" // {B} + 1 AS head, bins."start" // {B} > b."end" // {B} - 1 AS tail FROM b JOIN bins ON bins.chr = b.chr AND bins."start" // {B} BETWEEN b."start" // {B} AND b."end" // {B}),
fl AS (SELECT chr, "start", "end", coalesce(median(CASE WHEN head THEN hp1 END), 0) AS h1, coalesce(median(CASE WHEN head THEN hp2 END), 0) AS h2, coalesce(median(CASE WHEN tail THEN hp1 END), 0) AS t1, coalesce(median(CASE WHEN tail THEN hp2 END), 0) AS t2 FROM x GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY "start") AS i FROM fl),
f(chr, i, "start", "end", t1, t2, flip) AS (SELECT chr, i, "start", "end", t1, t2, FALSE FROM o WHERE i = 1
  UNION ALL SELECT o.chr, o.i, o."start", o."end", CASE WHEN t < c THEN o.t2 ELSE o.t1 END, CASE WHEN t < c THEN o.t1 ELSE o.t2 END, t < c
  FROM (SELECT f.chr, f.i, abs(f.t1 - o.h1) * abs(f.t2 - o.h2) AS c, abs(f.t1 - o.h2) * abs(f.t2 - o.h1) AS t FROM f JOIN o ON o.chr = f.chr AND o.i = f.i + 1) x JOIN o ON o.chr = x.chr AND o.i = x.i + 1)"""


@query(_FLANKS + ' SELECT chr, "start", "end", flip FROM f', recursive=True)
def flank_flips(spark, sf_dir):
    """Blocks flipped by the product of distances between their flanks of one bin."""
    blocks = phase.flanks(v.bins(spark, sf_dir), _blocks(spark, sf_dir), B, B)
    return phase.flips(blocks, True, ("tail1", "tail2"), ("head1", "head2")).select("chr", "start", "end", "flip")


@query(_BLOCKS + f""" SELECT b.chr, b."start", b."end", round(coalesce(median(CASE WHEN bins.hp1 <> 0 THEN bins.hp1 END), 0) + 1e-9, 5) AS hp1, round(coalesce(median(CASE WHEN bins.hp2 <> 0 THEN bins.hp2 END), 0) + 1e-9, 5) AS hp2
FROM b LEFT JOIN bins ON bins.chr = b.chr AND bins."start" // {B} >= b."start" // {B} AND bins."start" // {B} < b."end" // {B} GROUP BY 1, 2, 3""")
def index_medians(spark, sf_dir):
    return cov.index_medians(v.bins(spark, sf_dir), _blocks(spark, sf_dir), B).select("chr", "start", "end", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("hp1", "hp2")))


@query(_FLIP + f""", fb AS (SELECT DISTINCT bins.chr, bins."start" // {B} AS i FROM bins JOIN f ON f.chr = bins.chr AND f.flip AND bins."start" BETWEEN f."start" AND f."end"),
va AS (SELECT chr, pos, min(CASE et WHEN 'purchase' THEN '1/1' WHEN 'click' THEN '0|1' ELSE '1|0' END) AS gt FROM snp GROUP BY 1, 2),
pl AS (SELECT va.chr, va.pos, gt, b."start" AS s, b."end" AS e, cen."start" AS ls FROM va LEFT JOIN b ON b.chr = va.chr AND va.pos BETWEEN b."start" AND b."end" LEFT JOIN cen ON cen.chr = va.chr AND va.pos BETWEEN cen."start" AND cen."end"),
pr AS (SELECT *, (CASE WHEN pos < s + {B} THEN pos + {B} WHEN pos > e - {B} THEN pos - {B} ELSE pos END) // {B} AS i, ls IS NOT NULL AND s IS NULL AND gt = '1/1' AS lost FROM pl)
SELECT pr.chr, pos, CASE WHEN lost THEN '1|0' WHEN gt LIKE '%|%' AND e - s < 50000 THEN '0/1' WHEN gt LIKE '%|%' AND fb.i IS NOT NULL THEN CASE gt WHEN '0|1' THEN '1|0' ELSE '0|1' END ELSE gt END AS gt,
CAST(CASE WHEN lost THEN ls WHEN gt LIKE '%|%' AND e - s < 50000 THEN NULL WHEN gt LIKE '%|%' AND s IS NOT NULL THEN s ELSE 1 END AS BIGINT) AS ps FROM pr LEFT JOIN fb ON fb.chr = pr.chr AND fb.i = pr.i""", recursive=True)
def rephase(spark, sf_dir):
    variants = _genotyped(spark, sf_dir).groupBy("chr", "pos").agg(F.min("gt").alias("gt")).withColumn("ps", F.lit(1).cast("long"))
    blocks = _blocks(spark, sf_dir).select("chr", "start", "end")
    flips = phase.apply_flips(v.bins(spark, sf_dir), phase.flips(_blocks(spark, sf_dir))).where("flip").select("chr", "start")
    lost = v.centromeres(spark, sf_dir).withColumn("hp", F.lit(1))
    return phase.rephase(variants, flips, blocks, blocks, lost, B, 50_000).select("chr", "pos", "gt", "ps")


# --- copy number --------------------------------------------------------------------------------------------

_SNAP = "CASE WHEN x < 0 THEN 0 WHEN x <= 80 THEN round_even(x / 20, {d}) ELSE round_even(4 + (x - 80) / 20, {d}) END"


@query(f""", m AS (SELECT chr, pos // {B} AS bin_idx, round(avg(value), 4) + 0.00001 AS x FROM snp GROUP BY 1, 2) SELECT chr, bin_idx, CAST({_SNAP.format(d=0)} AS DOUBLE) AS cn, CAST({_SNAP.format(d=2)} AS DOUBLE) AS fraction, CAST(20 * {_SNAP.format(d=0)} AS DOUBLE) AS center FROM m""")
def cn_snap(spark, sf_dir):
    rows = v.snp(spark, sf_dir).groupBy("chr", sc.bin_index(F.col("pos"), B).alias("bin_idx")).agg((F.round(F.avg("value"), 4) + 0.00001).alias("x"))
    x = F.col("x")
    return rows.select("chr", "bin_idx", sc.snap(x, CENTERS).alias("cn"), sc.snap(x, CENTERS, 2).alias("fraction"), sc.center_of(x, CENTERS).alias("center"))


@query("""SELECT chr, round(CASE WHEN sum("end" - "start") = 0 THEN 0 ELSE sum(round_even(hp1 * ("end" - "start"), 3)) / sum("end" - "start") END, 6) AS mean FROM bins GROUP BY chr""")
def weighted_mean(spark, sf_dir):
    return v.bins(spark, sf_dir).groupBy("chr").agg(F.round(sc.weighted_mean(F.col("hp1"), F.col("end") - F.col("start")), 6).alias("mean"))


@query(f""", q AS (SELECT chr, quantile_cont(hp2, 0.25) AS a, quantile_cont(hp2, 0.75) AS b FROM bins GROUP BY chr) SELECT bins.chr, "start", hp2 FROM bins JOIN q ON q.chr = bins.chr WHERE hp2 BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)""")
def without_outliers(spark, sf_dir):
    return cn.without_outliers(v.bins(spark, sf_dir), "hp2", ["chr"], 0.5).select("chr", "start", "hp2")


@query(_CUTS + ' SELECT chr, "start", "end", CASE WHEN "end" = 1199999 THEN 3300 ELSE round(state, 6) END AS state FROM seg')
def mask_centromeres(spark, sf_dir):
    return cn.mask_centromeres(_segments(spark, sf_dir), v.centromeres(spark, sf_dir)).select("chr", "start", "end", _r("state"))


@query(_CUTS + f""", x AS (SELECT round(state + 1e-9, 4) AS x, seg.* FROM seg), s AS (SELECT g.gene, g.chr, arg_min(x.x, x."start") AS x FROM gene g LEFT JOIN x ON x.chr = g.chr AND g."start" BETWEEN x."start" AND x."end" GROUP BY 1, 2)
SELECT chr, gene, coalesce(x, 0) AS coverage, CAST(CASE WHEN x IS NULL THEN 0 ELSE {_SNAP.format(d=0)} END AS DOUBLE) AS cn FROM s""")
def gene_states(spark, sf_dir):
    segs = _segments(spark, sf_dir).withColumn("state", F.round(F.col("state") + 1e-9, 4))
    return cn.gene_states(v.gene(spark, sf_dir), segs, segs, CENTERS).select("chr", "gene", F.col("adjusted_coverage_hp1").alias("coverage"), F.col("copynumber_hp2_state").alias("cn"))


@query(f"""SELECT bins.chr, bins."start", CASE WHEN cen.chr IS NULL THEN hp1 ELSE greatest(hp1 - 5, 0) END AS hp1, CASE WHEN cen.chr IS NULL THEN hp2 ELSE hp2 + 5 END AS hp2 FROM bins LEFT JOIN cen ON cen.chr = bins.chr AND bins."start" // {B} >= cen."start" // {B} AND bins."start" // {B} < cen."end" // {B}""")
def move_normal(spark, sf_dir):
    return cn.move_normal(v.bins(spark, sf_dir), v.centromeres(spark, sf_dir).withColumn("hp", F.lit(1)), 5.0, B).select("chr", "start", "hp1", "hp2")


_WEIGHTED = "CASE WHEN sum(w) = 0 THEN 0 ELSE sum(round_even(cn * w, 3)) / sum(w) END"


@query(_CUTS + f""", n AS (SELECT k * 0.5 AS normal FROM range(1, 20) g(k)), gc AS (SELECT normal, "end" - "start" AS w, CASE WHEN st < normal THEN 0 ELSE round_even((st - normal) / 20, 0) END AS cn FROM n CROSS JOIN (SELECT *, round(state + 1e-9, 4) AS st FROM seg WHERE NOT EXISTS (SELECT 1 FROM cen WHERE cen.chr = seg.chr AND cen."end" = seg."end" AND seg."start" - cen."start" IN (0, 1))))
SELECT CAST(normal AS DOUBLE) AS normal, round(2 * {_WEIGHTED}, 6) AS ploidy FROM gc GROUP BY normal HAVING 2 * {_WEIGHTED} >= 0.1""")
def ploidy_grid(spark, sf_dir):
    segs = _segments(spark, sf_dir).select("chr", "start", "end", F.round(F.col("state") + 1e-9, 4).alias("depth"))
    both = segs.withColumn("hp", F.explode(F.array(F.lit(1), F.lit(2))))
    return cn.purity_grid(both, cn.grid(spark, 10.0, 0.5), 20.0, 5, 100.0, centromeres=v.centromeres(spark, sf_dir)).select("normal", _r("ploidy"))


@query(_BOTH + f""", tw AS (SELECT 1 AS hp, * FROM s1 UNION ALL SELECT 2, * FROM s2), gr AS (SELECT CAST(i AS DOUBLE) * 0.1 AS normal FROM range(1, 300) r(i)),
cn AS (SELECT normal, tw.chr, CASE WHEN EXISTS (SELECT 1 FROM cen WHERE cen.chr = tw.chr AND cen."end" = tw."end" AND tw."start" - cen."start" IN (0, 1)) THEN NULL ELSE hp END AS hp, "end" - "start" AS w, state, CASE WHEN state < normal THEN 0 ELSE greatest(0, round_even(abs((state - normal) / 20.0), 0)) END AS cn FROM tw CROSS JOIN gr),
zz AS (SELECT *, abs((state - (normal + cn * 20.0)) / 10.0) / 1.4142135623730951 AS z FROM cn),
pp AS (SELECT *, {_sql_p("z")} AS p FROM zz),
bc AS (SELECT normal, CAST(replace(chr, 'chr', '') AS INTEGER) AS o, sum(CASE WHEN w > 200000 AND p > 0 THEN round_even(p * w, 3) ELSE 0 END) AS pw, sum(CASE WHEN w > 200000 AND p > 0 THEN w ELSE 0 END) AS wp,
  sum(CASE WHEN hp = 1 THEN round_even(cn * w, 3) END) AS c1, sum(CASE WHEN hp = 2 THEN round_even(cn * w, 3) END) AS c2, sum(CASE WHEN hp = 1 THEN w END) AS w1, sum(CASE WHEN hp = 2 THEN w END) AS w2 FROM pp GROUP BY 1, 2),
ru AS (SELECT *, CASE WHEN sum(wp) OVER k = 0 THEN 0 ELSE sum(pw) OVER k / sum(wp) OVER k END AS score FROM bc WINDOW k AS (PARTITION BY normal ORDER BY o)),
ag AS (SELECT normal, avg(score) AS confidence, coalesce(sum(c1) / nullif(sum(w1), 0), 0) + coalesce(sum(c2) / nullif(sum(w2), 0), 0) AS ploidy FROM ru GROUP BY normal)
SELECT round(normal, 4) AS normal, round(confidence, 6) AS confidence, round(ploidy, 6) AS ploidy, round((100 - 2 * normal) / 100 + 1e-9, 6) AS dna_purity, round(((100 - 2 * normal) / ploidy) / (normal + (100 - 2 * normal) / ploidy) + 1e-9, 6) AS cell_purity FROM ag WHERE ploidy >= 0.1""")
def purity_grid(spark, sf_dir):
    rows = [_steady(spark, sf_dir, h).select("chr", "start", "end", F.col("state").alias("depth"), F.lit(h).alias("hp")) for h in (1, 2)]
    out = cn.purity_grid(rows[0].union(rows[1]), cn.grid(spark, 30.0), 20.0, 6, 100.0, 200_000, centromeres=v.centromeres(spark, sf_dir))
    return out.select(_r("normal", 4), _r("confidence"), _r("ploidy"), *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("dna_purity", "cell_purity")))


@query(_BOTH + f""", s AS (SELECT chr, CAST(replace(chr, 'chr', '') AS INTEGER) AS o, sum(CASE WHEN "end" - "start" > 200000 AND c > 0 THEN round_even(c * ("end" - "start"), 3) ELSE 0 END) AS p, sum(CASE WHEN "end" - "start" > 200000 AND c > 0 THEN "end" - "start" ELSE 0 END) AS w FROM (SELECT *, {_sql_p("z")} AS c FROM (SELECT *, abs((state - ({_sql_near("state")})) / 10.0) / 1.4142135623730951 AS z FROM s1)) GROUP BY 1, 2),
r AS (SELECT sum(p) OVER (ORDER BY o) AS p, sum(w) OVER (ORDER BY o) AS w FROM s) SELECT round(avg(CASE WHEN w = 0 THEN 0 ELSE p / w END), 6) AS confidence FROM r""")
def genome_score(spark, sf_dir):
    rows = cn.segment_scores(_steady(spark, sf_dir, 1).withColumn("depth", F.col("state")), CENTERS)
    return cn.genome_score(rows, 200_000).select(_r("confidence"))


@query("""SELECT o_orderkey, round(2 * (1 - p) / (2 * (1 - p) + l * p) + 1e-9, 6) AS normal_share, round(c * (1 - p) / (2 * (1 - p) + l * p) + 1e-9, 6) AS per_haplotype, round(2 * p / (l + 2 * p - p * l) + 1e-9, 6) AS cell_purity FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS p, o_orderkey % 5 + 1.0 AS l, o_totalprice / 1000 AS c FROM orders)""")
def purity_arithmetic(spark, sf_dir):
    p, pl = F.col("o_orderkey") % 100 / 100.0, F.col("o_orderkey") % 5 + 1.0
    parts = sc.normal_parts(p, pl, F.col("o_totalprice") / 1000)
    return v.table(spark, sf_dir, "orders").select("o_orderkey", F.round(parts["normal_share"] + 1e-9, 6).alias("normal_share"), F.round(parts["per_haplotype"] + 1e-9, 6).alias("per_haplotype"), F.round(sc.cell_purity(p, pl) + 1e-9, 6).alias("cell_purity"))


@query("""SELECT chr, bin_start, kind, alt, gt FROM (SELECT chr, "start" AS bin_start, round_even(hp1 / 20, 0) AS a, round_even(hp2 / 20, 0) AS b,
CASE WHEN (a = 0 AND b > 1) OR (b = 0 AND a > 1) THEN 'CNLOH' WHEN (a > 1 AND b > 0) OR (a > 0 AND b > 1) THEN 'GAIN' WHEN a = 1 AND b = 1 THEN 'REF' ELSE 'LOSS' END AS kind,
CASE kind WHEN 'LOSS' THEN '<DEL>' WHEN 'GAIN' THEN '<DUP>' WHEN 'REF' THEN '.' ELSE CASE WHEN a = 0 AND b > 1 THEN '<DEL>,<DUP>' ELSE '<DUP>,<DEL>' END END AS alt,
CASE WHEN a = 1 AND b = 1 THEN '0/0' WHEN a = 1 OR b = 1 THEN '0/1' WHEN (a > 1 AND b > 1) OR (a = 0 AND b = 0) THEN '1/1' ELSE '1/2' END AS gt FROM bins)""")
def vcf_class(spark, sf_dir):
    a, b = F.bround(F.col("hp1") / 20, 0), F.bround(F.col("hp2") / 20, 0)
    return v.bins(spark, sf_dir).select("chr", F.col("start").alias("bin_start"), sc.cna_type(a, b).alias("kind"), sc.cna_alt(a, b).alias("alt"), sc.cna_genotype(a, b).alias("gt"))


@query("""SELECT chr, ps, confidence, CAST(row_number() OVER (ORDER BY confidence DESC, ps) AS BIGINT) AS solution_rank FROM (SELECT chr, ps, hp1 AS confidence FROM blk)""")
def rank_first(spark, sf_dir):
    rows = v.blk(spark, sf_dir).select("chr", "ps", F.col("hp1").alias("confidence"), F.col("ps").alias("ord"))
    return cn.ranked(rows).select("chr", "ps", "confidence", F.col("solution_rank").cast("long").alias("solution_rank"))


@query(_BOTH + f""" SELECT chr, "start", "end", round(state, 5) AS state, {_sql_p("z")} AS confidence FROM (SELECT *, abs((state - ({_sql_near("state")})) / 10.0) / 1.4142135623730951 AS z FROM s1)""")
def segment_scores(spark, sf_dir):
    return cn.segment_scores(_steady(spark, sf_dir, 1).withColumn("depth", F.col("state")), CENTERS).select("chr", "start", "end", _r("state", 5), "confidence")


def _sql_trimmed(table: str, by: str, value: str) -> str:
    """The rows of a table within five interquartile ranges of the quartiles of their group."""
    on = " AND ".join(f"t.{c} = k.{c}" for c in by.split(", "))
    return f"SELECT t.* FROM {table} t JOIN (SELECT {by}, quantile_cont({value}, 0.25) AS a, quantile_cont({value}, 0.75) AS b FROM {table} GROUP BY {by}) k ON {on} WHERE t.{value} BETWEEN a - 5 * (b - a) AND b + 5 * (b - a)"


#: The state of a segment as the center of its copy number.
_CENTER = f"CAST(20 * {_SNAP.format(d=0).replace('x', 'state')} AS DOUBLE)"
_SUBCLONAL = _BOTH + f""", tw AS (SELECT 1 AS hp, *, {_CENTER} AS center FROM s1 UNION ALL SELECT 2, *, {_CENTER} FROM s2),
sb AS (SELECT hp, t.chr, t."start", center, CASE WHEN hp = 1 THEN hp1 ELSE hp2 END AS v, CASE WHEN v = 0 THEN 0 ELSE v + 0.0000123 END AS x FROM tw t JOIN bins ON bins.chr = t.chr AND bins."start" // {B} >= t."start" // {B} AND bins."start" // {B} < t."end" // {B}),
nc AS (SELECT center, count(*) AS n FROM sb GROUP BY center), tc AS ({_sql_trimmed("sb", "center", "x")}), me AS (SELECT center, avg(x) AS m FROM tc JOIN nc USING (center) WHERE n >= 2 GROUP BY center),
ce AS (SELECT i, coalesce(m, i * 20.0) AS m FROM range(0, 5) r(i) LEFT JOIN me ON center = i * 20.0),
ts AS ({_sql_trimmed("sb", 'hp, chr, "start"', "x")}), se AS (SELECT hp, chr, "start", median(x) AS seen FROM ts GROUP BY 1, 2, 3),
z AS (SELECT t.*, coalesce(seen, 0) AS seen, abs((coalesce(seen, 0) - (SELECT arg_min(m, (abs(m - coalesce(seen, 0)), i)) FROM ce)) / 10.0) / 1.4142135623730951 AS z FROM tw t LEFT JOIN se USING (hp, chr, "start")),
pv AS (SELECT *, CASE WHEN center > 80 THEN 1.0 ELSE {_sql_p("z")} END AS confidence FROM z),
su AS (SELECT *, center <= 80 AND confidence < 0.6 AS sub, CASE WHEN center > 80 THEN center ELSE seen END AS depth, CASE WHEN center <= 80 AND confidence < 0.6 THEN seen ELSE center END AS st FROM pv),
ow AS (SELECT *, sub AND st NOT IN (0, 20, 40, 60, 80) AND st <= 80 AS own FROM su),
lg AS (SELECT *, CASE WHEN own = lag(own) OVER (PARTITION BY hp, chr ORDER BY "start") THEN 0 ELSE 1 END AS n FROM ow),
rn AS (SELECT *, sum(n) OVER (PARTITION BY hp, chr ORDER BY "start") AS run FROM lg),
of AS (SELECT hp, chr, run, "start", st, depth - lag(depth) OVER (PARTITION BY hp, chr, run ORDER BY depth, "start") > 2 AS off, max("start") OVER (PARTITION BY hp, chr, run) AS last, count(*) OVER (PARTITION BY hp, chr, run) AS size FROM rn WHERE own),
ok AS (SELECT hp, chr, run FROM of GROUP BY 1, 2, 3 HAVING count(*) > 1 AND NOT bool_or(coalesce(off, FALSE))),
sh AS (SELECT of.hp, of.chr, of.run, st FROM of JOIN ok USING (hp, chr, run) WHERE "start" < last), tr AS ({_sql_trimmed("sh", "hp, chr, run", "st")}), md AS (SELECT hp, chr, run, median(st) AS m FROM tr GROUP BY 1, 2, 3),
fin AS (SELECT rn.hp, rn.chr, "start", "end", round_even(coalesce(CASE WHEN own THEN m END, depth), 2) AS depth, greatest(CAST(trunc(coalesce(CASE WHEN own THEN m END, st)) AS DOUBLE), 0) AS state, confidence, sub AS is_subclonal FROM rn LEFT JOIN md ON md.hp = rn.hp AND md.chr = rn.chr AND md.run = rn.run)"""


def _grained(spark, sf_dir):
    """Bins with a little added to values other than 0, so that no median of two meets a tie in rounding."""
    return v.bins(spark, sf_dir).select("chr", "start", "end", *(F.when(F.col(c) == 0, 0.0).otherwise(F.col(c) + 0.0000123).alias(c) for c in ("hp1", "hp2")))


@query(_SUBCLONAL + ' SELECT hp, chr, "start", "end", depth, state, confidence, is_subclonal FROM fin')
def subclonal_states(spark, sf_dir):
    found = cn.subclonal({h: _steady(spark, sf_dir, h) for h in (1, 2)}, _grained(spark, sf_dir), CENTERS, B)
    return found[1].withColumn("hp", F.lit(1)).unionByName(found[2].withColumn("hp", F.lit(2))).select("hp", "chr", "start", "end", "depth", "state", "confidence", "is_subclonal")


@query(_CUTS + """, r AS (SELECT state AS c, "end" - "start" AS l FROM seg WHERE state > 0),
st AS (SELECT quantile_cont(c, 0.5) * 2 / 100 AS w, sum(round_even(c * l, 3)) / sum(l) AS m FROM r),
hb AS (SELECT least(CAST(floor(c / w) AS INTEGER), 99) AS b, sum(l) AS l FROM r, st WHERE floor(c / w) BETWEEN 0 AND 100 GROUP BY 1),
h AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE coalesce(l, 0) END AS y FROM range(0, 100) g(i) LEFT JOIN hb ON b = i),
wt AS (SELECT i, i + d AS j, [-3, 12, 17, 12, -3][d + 3] / 35.0 AS w FROM range(2, 98) g(i), range(-2, 3) q(d) UNION ALL SELECT 0, k, [69, 4, -6, 4, -1][k + 1] / 70.0 FROM range(0, 5) q(k) UNION ALL SELECT 1, k, [2, 27, 12, -8, 2][k + 1] / 35.0 FROM range(0, 5) q(k)
  UNION ALL SELECT 98, 95 + k, [2, -8, 12, 27, 2][k + 1] / 35.0 FROM range(0, 5) q(k) UNION ALL SELECT 99, 95 + k, [-1, 4, -6, 4, 69][k + 1] / 70.0 FROM range(0, 5) q(k)),
o AS (SELECT wt.i, sum(w * y) AS y FROM wt JOIN h ON h.i = j GROUP BY wt.i),
rc AS (SELECT b.i - a.i AS i, sum(a.y * b.y) AS y FROM o a JOIN o b ON b.i >= a.i GROUP BY 1), ac AS (SELECT wt.i, sum(w * y) AS y FROM wt JOIN rc ON rc.i = j GROUP BY wt.i),
n AS (SELECT i, y, lag(y) OVER (ORDER BY i) AS l, lead(y) OVER (ORDER BY i) AS r FROM ac),
mi AS (SELECT min(i) AS i FROM n WHERE y < l AND y < r), fb AS (SELECT min(i) AS i FROM o WHERE y = (SELECT max(y) FROM o)),
tp AS (SELECT i, row_number() OVER (ORDER BY y DESC, i) AS k FROM n WHERE y > l AND y > r),
gr(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT gr.k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - tp.i) < 5)) = 0 THEN list_append(kept, tp.i) ELSE kept END FROM gr JOIN tp ON tp.k = gr.k + 1),
kp AS (SELECT unnest(kept) AS i FROM gr WHERE k = (SELECT max(k) FROM gr)), ky AS (SELECT kp.i, ac.y FROM kp JOIN ac ON ac.i = kp.i),
lb AS (SELECT ky.i, ky.y, coalesce(max(CASE WHEN q.i < ky.i THEN q.i END), -1) AS a, coalesce(min(CASE WHEN q.i > ky.i THEN q.i END), 100) AS b FROM ky LEFT JOIN ac q ON q.y > ky.y GROUP BY 1, 2),
pm AS (SELECT lb.i, lb.y, lb.y - greatest(min(CASE WHEN ac.i <= lb.i THEN ac.y END), min(CASE WHEN ac.i >= lb.i THEN ac.y END)) AS p FROM lb JOIN ac ON ac.i > a AND ac.i < b GROUP BY 1, 2),
tops AS (SELECT pm.i, pm.y FROM pm, mi, fb WHERE pm.i > greatest(mi.i, fb.i * 0.25) AND p / pm.y > 0.25), be AS (SELECT arg_max(i, y) AS i, max(y) AS y FROM tops),
ru AS (SELECT max(ac.y) AS y FROM ac, mi WHERE ac.i >= mi.i), hi AS (SELECT min(tops.i) AS i FROM tops, be, ru WHERE tops.y > greatest(be.y * 0.5, ru.y * 0.2)),
ok AS (SELECT mi.i IS NOT NULL AND mi.i * w < m AND hi.i IS NOT NULL AS ok FROM mi, st, hi)
SELECT round(CASE WHEN ok THEN be.i * w ELSE fb.i * w END, 4) AS cn_one, round(CASE WHEN ok AND hi.i <> be.i THEN hi.i * w END, 4) AS cn_one_alt FROM ok, be, fb, hi, st""", recursive=True)
def single_copy(spark, sf_dir):
    rows = _segments(spark, sf_dir).select(F.col("state").alias("coverage"), (F.col("end") - F.col("start")).alias("length")).where("coverage > 0")
    one, other = cn.single_copy_coverage(*cn.coverage_histogram(rows))
    return spark.createDataFrame([(one, other)], "cn_one DOUBLE, cn_one_alt DOUBLE").select(_r("cn_one", 4), _r("cn_one_alt", 4))


# --- profiles, breakpoints, synchronisation -----------------------------------------------------------------


def _track(spark, sf_dir, hp, step):
    """Segments of ``step`` bins with the rounded mean of a haplotype."""
    part = F.floor(F.col("start") / (step * B))
    rows = v.bins(spark, sf_dir).groupBy("chr", part.alias("k")).agg(F.round(F.avg(hp) + 1e-7, 2).alias("coverage"))
    start = F.col("k") * step * B
    return rows.select("chr", start.alias("start"), (start + step * B).alias("end"), "coverage", sc.snap(F.col("coverage"), CENTERS).alias("copynumber_state"), F.lit(1.0).alias("confidence"))


@query(f""", a AS (SELECT chr, k * 7 * {B} AS s, (k + 1) * 7 * {B} AS e, c FROM (SELECT chr, "start" // (7 * {B}) AS k, round(avg(hp1) + 1e-7, 2) AS c FROM bins GROUP BY 1, 2)),
b AS (SELECT chr, k * 5 * {B} AS s, (k + 1) * 5 * {B} AS e, c FROM (SELECT chr, "start" // (5 * {B}) AS k, round(avg(hp2) + 1e-7, 2) AS c FROM bins GROUP BY 1, 2)),
p AS (SELECT chr, s AS x FROM a UNION SELECT chr, e FROM a UNION SELECT chr, s FROM b UNION SELECT chr, e FROM b), f AS (SELECT chr, x AS s, lead(x) OVER (PARTITION BY chr ORDER BY x) AS e FROM p)
SELECT f.chr, f.s AS "start", f.e AS "end", coalesce(a.c, 0) AS hp1_coverage, coalesce(b.c, 0) AS hp2_coverage FROM f LEFT JOIN a ON a.chr = f.chr AND a.s <= f.s AND a.e > f.s LEFT JOIN b ON b.chr = f.chr AND b.s <= f.s AND b.e > f.s WHERE f.e IS NOT NULL AND (a.c IS NOT NULL OR b.c IS NOT NULL)""")
def boundary_fragments(spark, sf_dir):
    return profile.align(_track(spark, sf_dir, "hp1", 7), _track(spark, sf_dir, "hp2", 5)).select("chr", "start", "end", "hp1_coverage", "hp2_coverage")


@query("""SELECT g.chr, g."start", g."end", coalesce(string_agg(DISTINCT CAST(b.ps AS VARCHAR), ';' ORDER BY CAST(b.ps AS VARCHAR)), '') AS ids FROM (SELECT DISTINCT chr, "start", "end" FROM gene) g LEFT JOIN blk b ON b.chr = g.chr AND b."start" BETWEEN g."start" AND g."end" GROUP BY 1, 2, 3""")
def breakpoint_ids(spark, sf_dir):
    points = v.blk(spark, sf_dir).select("chr", F.col("start").alias("pos"), F.col("ps").cast("string").alias("id"))
    rows = profile.with_breakpoint_ids(v.gene(spark, sf_dir).select("chr", "start", "end").distinct(), points)
    return rows.select("chr", "start", "end", F.array_join("svs_breakpoints_ids", ";").alias("ids"))


@query("""SELECT id, svtype, chr1, pos1, CASE WHEN svtype = 'BND' THEN 'chr' || CAST(k % 22 + 1 AS VARCHAR) ELSE chr1 END AS chr2, CASE WHEN svtype = 'BND' THEN k * 10 ELSE pos1 + l END AS pos2, CAST(dv AS BIGINT) AS dv FROM
(SELECT 'sv' || CAST(ps AS VARCHAR) AS id, ['DEL', 'DUP', 'INV', 'BND', 'INS'][ps % 5 + 1] AS svtype, chr AS chr1, "start" AS pos1, ("end" - "start") * 100 AS l, ps AS k, ps % 13 AS dv FROM blk)
WHERE svtype <> 'INS' AND dv >= 3 AND (svtype <> 'DEL' OR l > 10000)""")
def sv_junctions(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("DEL", "DUP", "INV", "BND", "INS"))), (F.col("ps") % 5 + 1).cast("int"))
    length = ((F.col("end") - F.col("start")) * 100).cast("string")
    alt = F.concat(F.lit("N[chr"), (F.col("ps") % 22 + 1).cast("string"), F.lit(":"), (F.col("ps") * 10).cast("string"), F.lit("["))
    rows = v.blk(spark, sf_dir).select(
        "chr", F.col("start").alias("pos"), F.concat(F.lit("sv"), F.col("ps").cast("string")).alias("id"), F.lit("N").alias("ref"), F.when(kind == "BND", alt).otherwise(kind).alias("alt"), F.lit(1.0).alias("qual"), F.lit("PASS").alias("filter"),
        F.concat(F.lit("SVTYPE="), kind, F.lit(";SVLEN=-"), length).alias("info"), F.lit("GT:DV").alias("format"), F.concat(F.lit("0/1:"), (F.col("ps") % 13).cast("string")).alias("sample"),
    )
    out = bp.junctions(rows, ct.expand("chr1-22"))
    return out.select("id", "svtype", "chr1", "pos1", "chr2", "pos2", F.col("dv").cast("long").alias("dv"))


_SYNC = f""", snv AS (SELECT chr, pos, max(CASE WHEN et = 'view' THEN 10 ELSE 20 END) AS d1, 15 AS d2, pos // 200000 AS ps FROM snp GROUP BY chr, pos),
blo AS (SELECT chr, ps, min(pos) AS s, max(pos) + 1 AS e FROM snv GROUP BY 1, 2),
pro AS (SELECT chr, "start" AS s, "start" + {B} AS e, sign(hp1 - hp2) AS g FROM bins WHERE hp1 <> hp2),
pc AS (SELECT b.chr, b.ps, greatest(b.s, p.s) AS s, least(b.e, p.e) AS e, g FROM blo b JOIN pro p ON p.chr = b.chr AND p.s < b.e AND p.e > b.s),
vo AS (SELECT pc.chr, pc.ps, pc.s, g, count(*) AS w, sum(sign(d1 - d2)) AS t FROM pc JOIN snv ON snv.chr = pc.chr AND snv.ps = pc.ps AND snv.pos >= pc.s AND snv.pos < pc.e GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND sum(sign(d1 - d2)) <> 0),
su AS (SELECT chr, ps, sum(CASE WHEN sign(t) = g THEN w ELSE 0 END) AS k, sum(CASE WHEN sign(t) <> g THEN w ELSE 0 END) AS f FROM vo GROUP BY 1, 2),
al AS (SELECT b.*, (SELECT count(*) FROM snv WHERE snv.chr = b.chr AND snv.ps = b.ps) AS n, coalesce(k, 0) AS k, coalesce(f, 0) AS f FROM blo b LEFT JOIN su ON su.chr = b.chr AND su.ps = b.ps),
re AS (SELECT *, CASE WHEN n < 3 THEN 'too_few_snvs' WHEN k + f = 0 THEN 'no_profile_data' WHEN (k + f) / n < 0.5 THEN 'insufficient_evaluable_evidence' WHEN least(k, f) / (k + f) > 0.15 THEN 'mixed_direction' END AS reason FROM al)"""


@query(_SYNC + """ SELECT chr AS chrom, ps AS orig_ps, s AS "start", e AS "end", n AS n_snvs, CASE WHEN reason IS NULL AND f > k THEN 'flip' ELSE 'keep' END AS decision, coalesce(reason, '') AS reason FROM re""")
def sync_decisions(spark, sf_dir):
    snvs, prof = _sync_inputs(spark, sf_dir)
    out = sync.decisions(sync.blocks_of(snvs), prof, snvs)
    return out.select("chrom", "orig_ps", "start", "end", "n_snvs", "decision", F.coalesce("reason", F.lit("")).alias("reason"))


def _sync_inputs(spark, sf_dir):
    depth = F.max(F.when(F.col("et") == "view", 10).otherwise(20))
    snvs = v.snp(spark, sf_dir).groupBy("chr", "pos").agg(depth.alias("hp1_depth")).withColumns({"hp2_depth": F.lit(15), "ps": F.floor(F.col("pos") / 200_000)})
    return snvs, v.bins(spark, sf_dir).select("chr", "start", (F.col("start") + B).alias("end"), "hp1", "hp2")


@query(_SYNC + """, vg AS (SELECT chr, ps, s, CASE WHEN sign(t) = g THEN 1 ELSE -1 END AS a FROM vo), vl AS (SELECT *, lag(a) OVER (PARTITION BY chr, ps ORDER BY s) AS before FROM vg),
ct AS (SELECT vl.chr, vl.ps, vl.s AS x FROM vl JOIN re ON re.chr = vl.chr AND re.ps = vl.ps AND re.reason = 'mixed_direction' AND vl.s > re.s AND vl.s < re.e WHERE before <> a),
ed AS (SELECT chr, ps, s AS x FROM re UNION SELECT chr, ps, e FROM re UNION SELECT * FROM ct), le AS (SELECT chr, ps, x, lead(x) OVER (PARTITION BY chr, ps ORDER BY x) AS y, row_number() OVER (PARTITION BY chr, ps ORDER BY x) AS k FROM ed)
SELECT chr, ps, x AS "start", y AS "end", CASE WHEN k = 1 THEN ps ELSE x END AS new_ps FROM le WHERE y IS NOT NULL""")
def sync_cut_blocks(spark, sf_dir):
    snvs, prof = _sync_inputs(spark, sf_dir)
    return sync.cut_mixed(sync.blocks_of(snvs), prof, snvs)


_SNAP_STATE = _SNAP.replace("x", "state")


def _sql_sides(one: str, two: str, extra: str = "") -> str:
    """Two tracks (chr, s, e, c, k, q) cut at each other's boundaries."""
    more = ", ".join([*(f"coalesce({t}.c, 0) AS hp{h}_coverage, coalesce({t}.k, 0) AS hp{h}_copynumber_state, coalesce({t}.q, 0) AS hp{h}_confidence" for h, t in ((1, "a"), (2, "b")))])
    return f""", pt AS (SELECT chr, s AS x FROM {one} WHERE e > s UNION SELECT chr, e FROM {one} WHERE e > s UNION SELECT chr, s FROM {two} WHERE e > s UNION SELECT chr, e FROM {two} WHERE e > s),
fr AS (SELECT chr, x AS s, lead(x) OVER (PARTITION BY chr ORDER BY x) AS e FROM pt),
profile AS (SELECT fr.chr, fr.s AS "start", fr.e AS "end", {more}{extra} FROM fr LEFT JOIN {one} a ON a.chr = fr.chr AND a.s <= fr.s AND a.e > fr.s LEFT JOIN {two} b ON b.chr = fr.chr AND b.s <= fr.s AND b.e > fr.s
  WHERE fr.e IS NOT NULL AND (a.chr IS NOT NULL OR b.chr IS NOT NULL))"""


def _sql_scored(h: int) -> str:
    return f""", m{h} AS (SELECT *, "end" = 1199999 AND "start" IN (1000000, 1000001) AS cen, abs((state - ({_sql_near("state")})) / 10.0) / 1.4142135623730951 AS z FROM s{h}),
t{h} AS (SELECT chr, "start" AS s, "end" AS e, CASE WHEN cen THEN 3300 ELSE round_even(state, 2) END AS c, CASE WHEN cen THEN 3300 ELSE {_SNAP_STATE.format(d=0)} END AS k, {_sql_p("z")} AS q FROM m{h})"""


_PROFILE = _BOTH + _sql_scored(1) + _sql_scored(2) + _sql_sides("t1", "t2")


@query(_PROFILE + " SELECT * FROM profile")
def cna_profile(spark, sf_dir):
    """Segments of both haplotypes, snapped, scored, masked and aligned."""
    from strandloom.plans.cna import integer_profile

    return integer_profile(v.bins(spark, sf_dir), {h: _steady(spark, sf_dir, h) for h in (1, 2)}, CENTERS, v.centromeres(spark, sf_dir))


@query(_PROFILE + """, r AS (SELECT *, round_even(hp1_copynumber_state, 0) AS a, round_even(hp2_copynumber_state, 0) AS b FROM profile),
k AS (SELECT *, CASE WHEN (a = 0 AND b > 1) OR (b = 0 AND a > 1) THEN 'CNLOH' WHEN (a > 1 AND b > 0) OR (a > 0 AND b > 1) THEN 'GAIN' WHEN a = 1 AND b = 1 THEN 'REF' ELSE 'LOSS' END AS kind,
CASE WHEN a = 1 AND b = 1 THEN '0/0' WHEN a = 1 OR b = 1 THEN '0/1' WHEN (a > 1 AND b > 1) OR (a = 0 AND b = 0) THEN '1/1' ELSE '1/2' END AS gt FROM r WHERE NOT (a = 1 AND b = 1) AND a <> 3300 AND b <> 3300)
SELECT chr, "start" AS pos, 'CNV_' || kind || '_' || chr || '_' || CAST("start" AS VARCHAR) AS id, 'N' AS ref, CASE kind WHEN 'LOSS' THEN '<DEL>' WHEN 'GAIN' THEN '<DUP>' WHEN 'REF' THEN '.' ELSE CASE WHEN a = 0 THEN '<DEL>,<DUP>' ELSE '<DUP>,<DEL>' END END AS alt,
1000 AS qual, 'PASS' AS filter, 'SVTYPE=' || kind || ';SVLEN=' || CAST("end" - "start" AS VARCHAR) || ';END=' || CAST("end" AS VARCHAR) || ';BPS=' AS info, 'GT:TCN:CN1:CN2:CNQ1:CNQ2:COV1:COV2' AS format,
gt || ':' || CAST(CAST(a + b AS INTEGER) AS VARCHAR) || ':' || CAST(CAST(a AS INTEGER) AS VARCHAR) || ':' || CAST(CAST(b AS INTEGER) AS VARCHAR) || printf(':%.2f:%.2f:%.2f:%.2f', hp1_confidence, hp2_confidence, CAST(hp1_coverage AS DOUBLE), CAST(hp2_coverage AS DOUBLE)) AS sample FROM k""")
def cna_vcf(spark, sf_dir):
    return profile.vcf_records(cna_profile(spark, sf_dir))


@query(_BOTH + f""", z1 AS (SELECT chr, "start", "end" FROM s1 WHERE {_SNAP_STATE.format(d=0)} = 0 AND "end" - "start" > 150000), z2 AS (SELECT chr, "start", "end" FROM s2 WHERE {_SNAP_STATE.format(d=0)} = 0 AND "end" - "start" > 150000),
al AS (SELECT * FROM z1 UNION ALL SELECT * FROM z2 WHERE NOT EXISTS (SELECT 1 FROM z1 WHERE z1.chr = z2.chr AND z1."start" = z2."start") AND NOT EXISTS (SELECT 1 FROM z1 WHERE z1.chr = z2.chr AND z1."end" = z2."end")),
o AS (SELECT chr, "start", "end", row_number() OVER (PARTITION BY chr ORDER BY "start", "end") AS i FROM al),
f(chr, i, "start", "end", reach, kept) AS (SELECT chr, i, "start", "end", "end", TRUE FROM o WHERE i = 1
  UNION ALL SELECT o.chr, o.i, o."start", o."end", CASE WHEN o."start" > f.reach THEN o."end" ELSE f.reach END, o."start" > f.reach FROM f JOIN o ON o.chr = f.chr AND o.i = f.i + 1),
lk AS (SELECT chr, "start", "end", CASE WHEN "start" - lag("end") OVER (PARTITION BY chr ORDER BY "start") = 1 THEN 0 ELSE 1 END AS n FROM f WHERE kept), lr AS (SELECT *, sum(n) OVER (PARTITION BY chr ORDER BY "start") AS run FROM lk)
SELECT chr, min("start") AS "start", max("end") AS "end" FROM lr GROUP BY chr, run""", recursive=True)
def loh_collect(spark, sf_dir):
    rows = {h: _steady(spark, sf_dir, h).select("chr", "start", "end", sc.snap(F.col("state"), CENTERS).alias("cn")) for h in (1, 2)}
    return loh.collect_regions(rows[1], rows[2], 150_000)


# --- further operators ----------------------------------------------------------------------------------------


@query("""SELECT bins.chr, bins."start", CASE WHEN cen.chr IS NULL THEN hp1 ELSE 3300 END AS hp1 FROM bins LEFT JOIN cen ON cen.chr = bins.chr AND bins."start" BETWEEN cen."start" AND cen."end\"""")
def mask_bins(spark, sf_dir):
    return cn.mask_bins(v.bins(spark, sf_dir), v.centromeres(spark, sf_dir).withColumn("state", F.lit(3300.0)), "hp1").select("chr", "start", "hp1")


@query(_CUTS + f""", x AS (SELECT chr, "start" AS s, "end" AS e, round(state + 1e-9, 4) AS x FROM seg), f AS (SELECT bins.chr, bins."start", arg_min(x, s) AS x FROM bins LEFT JOIN x ON x.chr = bins.chr AND bins."start" BETWEEN s AND e GROUP BY 1, 2)
SELECT chr, "start", CAST(CASE WHEN x IS NULL THEN 0 ELSE {_SNAP.format(d=0)} END AS DOUBLE) AS cn FROM f""")
def bin_states(spark, sf_dir):
    segs = _segments(spark, sf_dir).withColumn("state", F.round(F.col("state") + 1e-9, 4))
    return cn.bin_states(v.bins(spark, sf_dir), segs, CENTERS).select("chr", "start", "cn")


@query(_BLOCKS + """ SELECT b.chr, b."start", b."end", round(coalesce(median(CASE WHEN bins.hp1 <> 0 THEN bins.hp1 END), 0), 6) AS hp1, round(coalesce(median(CASE WHEN bins.hp2 <> 0 THEN bins.hp2 END), 0), 6) AS hp2
FROM (SELECT chr, "start", "start" + 250000 AS "end" FROM b) b LEFT JOIN bins ON bins.chr = b.chr AND bins."start" BETWEEN b."start" AND b."end" GROUP BY 1, 2, 3""")
def interval_bin_median(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).select("chr", "start", (F.col("start") + 250_000).alias("end"))
    return cov.interval_bin_median(v.bins(spark, sf_dir), blocks).select("chr", "start", "end", _r("hp1"), _r("hp2"))


@query(f"""SELECT cen.chr, cen."start", cen."end", CASE WHEN avg(hp2) > 0.0001 THEN 2 ELSE 1 END AS hp FROM cen LEFT JOIN bins ON bins.chr = cen.chr AND bins."start" // {B} BETWEEN cen."start" // {B} + 1 AND cen."end" // {B} - 2 GROUP BY 1, 2, 3""")
def loh_haplotype(spark, sf_dir):
    return loh.assign_haplotype(v.centromeres(spark, sf_dir).withColumn("hp", F.lit(1)), v.bins(spark, sf_dir), B)


@query("""SELECT bins.chr, bins."start", CASE WHEN cen.chr IS NULL THEN hp1 ELSE round(hp1 + hp2, 6) END AS hp1, CASE WHEN cen.chr IS NULL THEN hp2 ELSE 0.0001 END AS hp2 FROM bins LEFT JOIN cen ON cen.chr = bins.chr AND bins."start" BETWEEN cen."start" AND cen."end\"""")
def loh_coverage(spark, sf_dir):
    bins = v.bins(spark, sf_dir).withColumn("hp3", F.lit(0.0))
    return loh.give_to_first(bins, bins, v.centromeres(spark, sf_dir)).select("chr", "start", _r("hp1"), "hp2")


@query("""SELECT bins.chr, "start", hp1, (ord - 1) * len + "start" AS start_overall FROM bins JOIN contigs ON contigs.chr = bins.chr""")
def genome_track(spark, sf_dir):
    return snps.with_genome_position(v.bins(spark, sf_dir), ct.with_offsets(v.contigs(spark, sf_dir))).select("chr", "start", "hp1", "start_overall")


@query("""SELECT CASE WHEN et = 'view' THEN 'het' ELSE 'hom' END AS kind, CAST(((ord - 1) * len + pos) * 800 // (SELECT sum(len) FROM contigs) AS INTEGER) AS "column",
CAST(least(floor((value - floor(value)) * 100), 99) AS INTEGER) AS "row", count(*) AS n FROM snp JOIN contigs USING (chr) WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def snp_raster(spark, sf_dir):
    kind = F.when(F.col("et") == "view", "het").otherwise("hom").alias("kind")
    points = v.snp(spark, sf_dir).select("chr", "pos", kind, (F.col("value") - F.floor("value")).alias("y"))
    return plots.raster(points, ct.with_offsets(v.contigs(spark, sf_dir)), 22 * v.LENGTH)


@query("""SELECT chr, ps % 40 AS phasesets, max("start") - min("start") AS length FROM blk GROUP BY 1, 2 HAVING max("start") - min("start") > 10000 AND count(*) >= 10""")
def block_lengths(spark, sf_dir):
    return phase.block_lengths(v.blk(spark, sf_dir).select("chr", F.col("start").alias("position"), (F.col("ps") % 40).alias("phasesets")))


@query(_BLOCKS + """ SELECT chr, "start", "end" FROM b WHERE NOT EXISTS (SELECT 1 FROM cen WHERE cen.chr = b.chr AND cen."end" >= b."start" AND cen."start" <= b."end") UNION ALL SELECT chr, "start", "end" FROM cen""")
def blocks_without_loh(spark, sf_dir):
    return phase.without_loh(_blocks(spark, sf_dir).select("chr", "start", "end"), v.centromeres(spark, sf_dir))


@query(_BLOCKS + f""", s AS (SELECT chr, "start" + 250000 AS "start", "start" + 260000 AS "end", hp1, hp2 FROM b),
o AS (SELECT *, lead("start") OVER w AS n, lead(hp1) OVER w AS n1, lead(hp2) OVER w AS n2, row_number() OVER w AS i, count(*) OVER (PARTITION BY chr) AS c FROM s WINDOW w AS (PARTITION BY chr ORDER BY "start")),
gp AS (SELECT chr, "end" + 1 AS f, n - 1 AS t, hp1 AS l1, hp2 AS l2, n1 AS r1, n2 AS r2 FROM o WHERE n - "end" > {B} UNION ALL SELECT chr, 0, "start" - 1, NULL, NULL, hp1, hp2 FROM o WHERE i = 1 AND c > 1 AND "start" > {B}
  UNION ALL SELECT chr, "end" + 1, {v.LENGTH - B}, hp1, hp2, NULL, NULL FROM o WHERE i = c AND c > 1 AND {v.LENGTH - B} - "end" > {B}),
gm AS (SELECT gp.chr, f, t, max(l1) AS l1, max(l2) AS l2, max(r1) AS r1, max(r2) AS r2, coalesce(median(CASE WHEN hp1 <> 0 THEN hp1 END), 0) AS m1, coalesce(median(CASE WHEN hp2 <> 0 THEN hp2 END), 0) AS m2
  FROM gp LEFT JOIN bins ON bins.chr = gp.chr AND bins."start" // {B} >= f // {B} AND bins."start" // {B} < t // {B} GROUP BY gp.chr, f, t),
sw AS (SELECT chr, f, t, l1 IS NULL OR r1 IS NULL AS at_end FROM gm WHERE CASE WHEN l1 IS NOT NULL AND r1 IS NOT NULL THEN (sign(l1 - l2) = sign(r1 - r2) AND l1 <> l2 AND sign(m1 - m2) = -sign(l1 - l2)) OR (abs(l1 - m2) < abs(l1 - m1) AND abs(r1 - m2) < abs(r1 - m1))
  ELSE coalesce(l1, r1) <> coalesce(l2, r2) AND sign(m1 - m2) = -sign(coalesce(l1, r1) - coalesce(l2, r2)) END),
hit AS (SELECT DISTINCT bins.chr, bins."start" FROM bins JOIN sw ON sw.chr = bins.chr AND bins."start" BETWEEN f AND t WHERE NOT (at_end AND EXISTS (SELECT 1 FROM gene WHERE gene.chr = bins.chr AND bins."start" BETWEEN gene."start" AND gene."end")))
SELECT bins.chr, bins."start", CASE WHEN hit.chr IS NULL THEN hp1 ELSE hp2 END AS hp1, CASE WHEN hit.chr IS NULL THEN hp2 ELSE hp1 END AS hp2 FROM bins LEFT JOIN hit ON hit.chr = bins.chr AND hit."start" = bins."start\"""")
def align_blockless(spark, sf_dir):
    """Stretches between blocks and at both ends of contigs; genes stand for lost regions."""
    blocks = _blocks(spark, sf_dir).withColumns({"start": F.col("start") + 250_000, "end": F.col("start") + 260_000})
    return phase.align_blockless(v.bins(spark, sf_dir), blocks, B, 1, v.gene(spark, sf_dir)).select("chr", "start", "hp1", "hp2")


@query(_SYNC + """ SELECT snv.chr, snv.pos, CASE WHEN re.reason IS NULL AND re.f > re.k THEN '1|0' ELSE '0|1' END AS gt, snv.ps FROM snv JOIN re ON re.chr = snv.chr AND re.ps = snv.ps""")
def sync_variants(spark, sf_dir):
    data, prof = _sync_inputs(spark, sf_dir)
    variants = data.select("chr", "pos", F.lit("0|1").alias("gt"), "ps")
    return sync.apply_decisions(variants, sync.decisions(sync.blocks_of(data), prof, data)).select("chr", "pos", "gt", "ps")


@query("""SELECT id, CASE WHEN (o1, p1) <= (o2, p2) THEN c1 ELSE c2 END AS chr1, least((o1, p1), (o2, p2))[2] AS pos1, CASE WHEN (o1, p1) <= (o2, p2) THEN c2 ELSE c1 END AS chr2, greatest((o1, p1), (o2, p2))[2] AS pos2 FROM
(SELECT 'sv' || CAST(ps AS VARCHAR) AS id, chr AS c1, "start" AS p1, CAST(replace(chr, 'chr', '') AS BIGINT) AS o1, 'chr' || CAST(ps % 22 + 1 AS VARCHAR) AS c2, ps * 10 AS p2, ps % 22 + 1 AS o2 FROM blk)""")
def sv_arcs(spark, sf_dir):
    pairs = v.blk(spark, sf_dir).select(
        F.concat(F.lit("sv"), F.col("ps").cast("string")).alias("id"), F.lit("BND").alias("svtype"), F.col("chr").alias("chr1"), F.col("start").alias("pos1"),
        F.concat(F.lit("chr"), (F.col("ps") % 22 + 1).cast("string")).alias("chr2"), (F.col("ps") * 10).alias("pos2"), F.lit("0|0").alias("hp"), F.lit(9).alias("dv"),
    )
    return bp.arcs(pairs).select("id", "chr1", "pos1", "chr2", "pos2")


@query(_BLOCKS + """, pt AS (SELECT b.chr, b."start" AS s, b."end" AS e, x FROM b JOIN (SELECT chr, "start" AS x FROM cen UNION SELECT chr, "end" FROM cen) c ON c.chr = b.chr AND x > b."start" AND x < b."end"),
ed AS (SELECT chr, "start" AS s, "start" AS x FROM b UNION SELECT chr, "start", "end" FROM b UNION SELECT chr, s, x FROM pt), pc AS (SELECT chr, x AS "start", lead(x) OVER (PARTITION BY chr, s ORDER BY x) AS "end" FROM ed)
SELECT chr, "start", "end" FROM pc WHERE "end" IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cen WHERE cen.chr = pc.chr AND pc."start" >= cen."start" AND pc."end" <= cen."end") UNION ALL SELECT chr, "start", "end" FROM cen""")
def cut_at_regions(spark, sf_dir):
    return phase.cut_at_regions(_blocks(spark, sf_dir).select("chr", "start", "end"), v.centromeres(spark, sf_dir))


_SUB_SIDES = "".join(f""", u{h} AS (SELECT chr, "start" AS s, "end" AS e, depth AS c, CASE WHEN is_subclonal THEN {_SNAP.replace("x", "depth").format(d=2)} ELSE {_SNAP_STATE.format(d=0)} END AS k, confidence AS q, CASE WHEN is_subclonal THEN 'Y' ELSE 'N' END AS y FROM fin WHERE hp = {h})""" for h in (1, 2))


@query(_SUBCLONAL + _SUB_SIDES + _sql_sides("u1", "u2", ", coalesce(a.y, 'N') AS hp1_is_subclonal, coalesce(b.y, 'N') AS hp2_is_subclonal") + " SELECT * FROM profile")
def subclonal_profile(spark, sf_dir):
    from strandloom.plans.cna import subclonal_profile as make

    return make(_grained(spark, sf_dir), {h: _steady(spark, sf_dir, h) for h in (1, 2)}, CENTERS, B)


_POOLS = _BOTH + f""", sn AS (SELECT chr, "start", "end", CAST({_SNAP_STATE.format(d=0)} AS DOUBLE) AS state FROM s1), pb AS (SELECT sn.state, hp1 FROM sn JOIN bins ON bins.chr = sn.chr AND bins."start" BETWEEN sn."start" AND sn."end"),
pr AS ({_sql_trimmed("pb", "state", "hp1")}), pools AS (SELECT state, count(*) AS n, round(avg(hp1), 6) AS mean, round(median(hp1) + 1e-9, 5) AS median FROM pr GROUP BY state)"""


@query(_POOLS + " SELECT * FROM pools")
def center_pools(spark, sf_dir):
    return _pools(spark, sf_dir).select("state", "n", _r("mean"), F.round(F.col("median") + 1e-9, 5).alias("median"))


def _pools(spark, sf_dir):
    return cn.center_pools(v.bins(spark, sf_dir), _steady(spark, sf_dir, 1).withColumn("state", sc.snap(F.col("state"), CENTERS)), "hp1")


@query(_POOLS + " SELECT i AS cn, CAST(i * 20 AS DOUBLE) AS center FROM range(0, 12) r(i) WHERE i NOT IN (SELECT CAST(state AS INTEGER) FROM pools)")
def unused_centers(spark, sf_dir):
    """Centers up to copy number 11 that no segment has."""
    return cn.unused_centers(_pools(spark, sf_dir), [20.0 * i for i in range(12)])


@query(""", o AS (SELECT chr, ps, hp1 AS confidence, ps AS ord FROM blk), a AS (SELECT *, lag(confidence) OVER (ORDER BY ord) AS p, lead(confidence) OVER (ORDER BY ord) AS n, row_number() OVER (ORDER BY ord) AS nr FROM o),
u AS (SELECT *, lag(confidence) OVER (ORDER BY ord) AS l, lead(confidence) OVER (ORDER BY ord) AS r FROM a WHERE p IS NULL OR p <> confidence), t AS (SELECT DISTINCT confidence FROM u WHERE l < confidence AND confidence > r),
f AS (SELECT *, nr - row_number() OVER (ORDER BY nr) AS run FROM a WHERE confidence IN (SELECT confidence FROM t) OR (p IS NULL AND (n IS NULL OR confidence > n))),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nr) AS k FROM f) SELECT ord, confidence FROM s WHERE k % 2 = 1""")
def score_peaks(spark, sf_dir):
    """Local maxima along the orders."""
    return cn.score_peaks(v.blk(spark, sf_dir).select(F.col("ps").alias("ord"), F.col("hp1").alias("confidence")))


@query("""SELECT chr, ps, hp1, hp2 FROM blk WHERE hp1 BETWEEN 5 AND 20 AND hp2 BETWEEN 10 AND 40""")
def in_range(spark, sf_dir):
    """Blocks as solutions with purity and ploidy in a range."""
    rows = v.blk(spark, sf_dir).select("chr", "ps", F.col("hp1").alias("cell_purity"), F.col("hp2").alias("ploidy"))
    return cn.in_range(rows, (5.0, 20.0), (10.0, 40.0)).select("chr", "ps", F.col("cell_purity").alias("hp1"), F.col("ploidy").alias("hp2"))


@query(""", r AS (SELECT hp2 % 3 AS ploidy, hp1 AS purity, ps % 1000 / 1000.0 AS c FROM blk), m AS (SELECT min(c) AS l FROM r),
w AS (SELECT purity, avg(c) FILTER (WHERE ploidy = 0) AS a, avg(c) FILTER (WHERE ploidy = 1) AS b, avg(c) FILTER (WHERE ploidy = 2) AS d FROM r GROUP BY purity)
SELECT purity, round(coalesce(a, l), 6) AS p0, round(coalesce(b, l), 6) AS p1, round(coalesce(d, l), 6) AS p2 FROM w, m""")
def pivot_scores(spark, sf_dir):
    """Scores by purity and ploidy, from blocks as solutions."""
    rows = v.blk(spark, sf_dir).select((F.col("hp2") % 3).alias("ploidy"), F.col("hp1").alias("cell_purity"), (F.col("ps") % 1000 / 1000.0).alias("confidence"))
    wide = cn.pivot_scores(rows)
    return wide.select("purity", *(F.round(F.col(f"`{i}.00`"), 6).alias(f"p{i}") for i in range(3)))


@query(_CUTS + f""" SELECT seg.chr, seg."start", seg."end", round(coalesce(median(CASE WHEN hp2 > 0.1 THEN hp2 END), 0) + 1e-9, 5) AS state FROM seg LEFT JOIN bins ON bins.chr = seg.chr AND bins."start" // {B} >= seg."start" // {B} AND bins."start" // {B} < seg."end" // {B} GROUP BY 1, 2, 3""")
def segment_medians(spark, sf_dir):
    """Segments of one haplotype with the medians of the other."""
    found = cn.segment_medians(_segments(spark, sf_dir), v.bins(spark, sf_dir), "hp2", B, 0.1)
    return found.select("chr", "start", "end", F.round(F.col("state") + 1e-9, 5).alias("state"))


@query(""", k AS (SELECT chr, "start" AS pos, ['0|0', '1|0', '2|1', '1|2', '0|2'][ps % 5 + 1] AS hp FROM blk)
SELECT chr, pos, hp, split_part(hp, '|', 1) = '1' OR split_part(hp, '|', 2) = '1' OR hp LIKE '%0%' AS one, split_part(hp, '|', 1) = '2' OR split_part(hp, '|', 2) = '2' OR hp LIKE '%0%' AS two FROM k""")
def route_by_haplotype(spark, sf_dir):
    """Which haplotypes' segments a breakpoint cuts."""
    hp = F.element_at(F.array(*(F.lit(x) for x in ("0|0", "1|0", "2|1", "1|2", "0|2"))), (F.col("ps") % 5 + 1).cast("int"))
    rows = v.blk(spark, sf_dir).select("chr", F.col("start").alias("pos"), hp.alias("hp"))
    return rows.select("chr", "pos", "hp", segments.route_by_haplotype(rows, 1).alias("one"), segments.route_by_haplotype(rows, 2).alias("two"))


_PAIRS = """, pr AS (SELECT 'sv' || CAST(ps AS VARCHAR) AS id, chr AS chr1, "start" AS pos1, chr AS chr2, "start" + ps % 7 * 90000 + 1 AS pos2, '1|2' AS hp FROM blk)"""


def _pairs(spark, sf_dir):
    return v.blk(spark, sf_dir).select(
        F.concat(F.lit("sv"), F.col("ps").cast("string")).alias("id"), F.col("chr").alias("chr1"), F.col("start").alias("pos1"), F.col("chr").alias("chr2"),
        (F.col("start") + F.col("ps") % 7 * 90_000 + 1).alias("pos2"), F.lit("1|2").alias("hp"), F.lit(9).alias("dv"),
    )


@query(_BLOCKS + _PAIRS + """, en AS (SELECT id, chr1 AS chr, pos1 AS pos FROM pr UNION SELECT id, chr2, pos2 FROM pr), h AS (SELECT en.id, en.pos, arg_min(hp1, "start") AS a, arg_min(hp2, "start") AS b FROM en JOIN b ON b.chr = en.chr AND en.pos BETWEEN b."start" AND b."end" GROUP BY 1, 2),
gd AS (SELECT id FROM h WHERE abs(a - b) / (least(a, b) + 0.0001) > 0.3 GROUP BY id HAVING count(*) >= 2) SELECT pr.id, CASE WHEN gd.id IS NULL THEN '0|0' ELSE hp END AS hp FROM pr LEFT JOIN gd USING (id)""")
def trusted_haplotypes(spark, sf_dir):
    return bp.trusted_haplotypes(_pairs(spark, sf_dir), _blocks(spark, sf_dir)).select("id", "hp")


@query(_BLOCKS + f""", bl AS (SELECT chr, "start", "start" + 900000 AS "end" FROM b), pt AS (SELECT DISTINCT bl.chr, bl."start" AS s, k."start" AS x FROM bl JOIN blk k ON k.chr = bl.chr AND k."start" - bl."start" >= 7 * {B} AND bl."end" - k."start" >= 7 * {B}),
ix AS (SELECT DISTINCT chr, x FROM pt), ed AS (SELECT chr, "start" AS s, "start" AS x FROM bl UNION SELECT chr, "start", "end" FROM bl UNION SELECT bl.chr, bl."start", ix.x FROM bl JOIN ix ON ix.chr = bl.chr AND ix.x > bl."start" AND ix.x < bl."end"),
le AS (SELECT chr, x AS "start", lead(x) OVER (PARTITION BY chr, s ORDER BY x) AS "end" FROM ed) SELECT chr, "start", "end" FROM le WHERE "end" IS NOT NULL""")
def split_blocks(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).select("chr", "start", (F.col("start") + 900_000).alias("end"))
    return bp.split_blocks(blocks, v.blk(spark, sf_dir).select("chr", F.col("start").alias("pos")), B)


@query(_BOTH + f""" SELECT round(max(CASE WHEN "end" - "start" >= 100000 AND abs(state) <> 3300 THEN state ELSE 0 END) + 20, 5) AS "limit" FROM s1""")
def highest_level(spark, sf_dir):
    return profile.highest_level(_steady(spark, sf_dir, 1).withColumn("depth", F.col("state")), 20.0, B, 2).select(_r("limit", 5))


@query(_BOTH + f""" SELECT chr, "start", "end", round(state, 5) AS depth, {_CENTER} AS state FROM s1""")
def snap_segments(spark, sf_dir):
    return segments.snap_segments(_steady(spark, sf_dir, 1), CENTERS).select("chr", "start", "end", _r("depth", 5), "state")


@query("""SELECT 'chr' || c AS chr, s AS "start", e AS "end", g AS gene FROM (SELECT replace(chr, 'chr', '') AS c, "start" AS s, "end" AS e, gene AS g FROM gene)""")
def cosmic_genes(spark, sf_dir):
    from strandloom.sources.tables import cosmic_genes as make

    return make(v.gene(spark, sf_dir).select(F.replace(F.col("chr"), F.lit("chr"), F.lit("")).alias("chromosome"), F.col("start").alias("genome_start"), F.col("end").alias("genome_stop"), F.col("gene").alias("gene_symbol")))


@query("""SELECT id, chr1, pos1, chr2, pos2, round((x0 + x2) / 2, 3) AS middle_x, round(y1 / 3, 3) AS middle_y FROM
(SELECT *, CAST(p1 + (o1 - 1) * 3000000 AS DOUBLE) AS x0, CAST(p2 + (o2 - 1) * 3000000 AS DOUBLE) AS x2, abs(x2 - x0) * 0.8660254037844386 AS y1 FROM
(SELECT 'sv' || CAST(ps AS VARCHAR) AS id, ps, chr AS chr1, "start" AS pos1, "start" AS p1, CAST(replace(chr, 'chr', '') AS BIGINT) AS o1, chr AS chr2, "start" + ps % 7 * 90000 + 1 AS pos2, "start" + ps % 7 * 90000 + 1 AS p2, CAST(replace(chr, 'chr', '') AS BIGINT) AS o2 FROM blk))""")
def arc_curves(spark, sf_dir):
    """The middle of each pair's arc along the genome."""
    pairs = _pairs(spark, sf_dir).withColumn("svtype", F.lit("DEL"))
    rows = bp.arc_curves(bp.arcs(pairs), ct.with_offsets(v.contigs(spark, sf_dir)), 3)
    middle = F.element_at("curve", 2)
    return rows.select("id", "chr1", "pos1", "chr2", "pos2", F.round(middle["x"], 3).alias("middle_x"), F.round(middle["y"], 3).alias("middle_y"))
