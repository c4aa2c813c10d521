"""Queries of variants, reads, pileups, files and reports over the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import contigs as ct
from strandloom.functions import intervals as iv
from strandloom.functions import scalar as sc
from strandloom.operators import breakpoints as bp
from strandloom.operators import copynumber as cn
from strandloom.operators import profile, reads, segments, snps, sync
from strandloom.plans import cna
from strandloom.plans import registry as base
from strandloom.plans import views as v
from strandloom.plans.registry import B, CENTERS, query
from strandloom.sources import sinks, tables

# --- variants -----------------------------------------------------------------------------------------------

_VARIANTS = """, vr AS (SELECT chr, pos, min(et) AS et, min(CAST(floor(value) AS BIGINT)) AS n FROM snp GROUP BY 1, 2),
va AS (SELECT chr, pos, CASE WHEN et = 'view' THEN 'A' ELSE 'C' END AS ref, CASE et WHEN 'error' THEN 'GT' ELSE 'G' END AS alt, CASE et WHEN 'purchase' THEN '1/1' WHEN 'click' THEN '0|1' WHEN 'view' THEN '1|0' ELSE '0/1' END AS gt,
  CASE WHEN et = 'view' THEN NULL ELSE pos // 200000 END AS ps, n, CAST(n AS DOUBLE) AS qual FROM vr)"""


def _variants(spark, sf_dir):
    """Variants with samples like those of a file: GT, PS (not on all), DP and AF."""
    et = F.col("et")
    rows = v.snp(spark, sf_dir).groupBy("chr", "pos").agg(F.min("et").alias("et"), F.min(F.floor("value").cast("long")).alias("n"))
    gt = F.when(et == "purchase", "1/1").when(et == "click", "0|1").when(et == "view", "1|0").otherwise("0/1")
    ps = F.when(et != "view", F.floor(F.col("pos") / 200_000).cast("long"))
    n = F.col("n").cast("string")
    return rows.select(
        "chr", "pos", F.lit(".").alias("id"), F.when(et == "view", "A").otherwise("C").alias("ref"), F.when(et == "error", "GT").otherwise("G").alias("alt"), F.col("n").cast("double").alias("qual"), F.lit("PASS").alias("filter"), F.lit(".").alias("info"),
        F.when(ps.isNull(), "GT:DP:AF").otherwise("GT:PS:DP:AF").alias("format"), F.concat_ws(":", gt, ps.cast("string"), n, F.concat(F.lit("0."), n, F.lit(",1"))).alias("sample"),
    )


@query(_VARIANTS + """ SELECT chr, pos, qual, gt, CAST(n AS VARCHAR) AS dp, '0.' || CAST(n AS VARCHAR) || ',1' AS vaf FROM va""")
def loh_snps(spark, sf_dir):
    return tables.loh_snps(_variants(spark, sf_dir), "AF")


@query(_VARIANTS + """ SELECT chr, pos AS position, ps AS phasesets FROM va WHERE ps > 1""")
def phaseset_positions(spark, sf_dir):
    return tables.phaseset_positions(_variants(spark, sf_dir))


@query(_VARIANTS + """ SELECT chr, pos AS "start", ref, alt, gt FROM va WHERE gt <> '1/1' AND length(alt) = 1""")
def het_snps(spark, sf_dir):
    return tables.het_snps(_variants(spark, sf_dir))


@query(_VARIANTS + """ SELECT chr, pos, round(CAST('0.' || CAST(n AS VARCHAR) AS DOUBLE), 9) AS vaf FROM va""")
def parse_vaf(spark, sf_dir):
    rows = tables.loh_snps(_variants(spark, sf_dir), "AF")
    return rows.select("chr", "pos", F.round(sc.parse_vaf(F.col("vaf")), 9).alias("vaf"))


_COUNTS = """, ct AS (SELECT chr, pos AS "start", n AS a, n * 2 AS c, n + 3 AS g, 1 AS t FROM va WHERE n % 3 <> 0)"""


def _counts(spark, sf_dir):
    """Base counts at two thirds of the positions, as a pileup leaves out what no read covers."""
    rows = _variants(spark, sf_dir)
    n = F.col("qual").cast("int")
    return rows.where(n % 3 != 0).select("chr", F.col("pos").alias("start"), n.alias("a"), (n * 2).alias("c"), (n + 3).alias("g"), F.lit(1).alias("t"))


@query(_VARIANTS + _COUNTS + """ SELECT va.chr, pos, CASE gt WHEN '1|0' THEN r WHEN '0|1' THEN al ELSE 0 END AS freq_value_a, 1 AS hp_a, CASE gt WHEN '1|0' THEN al WHEN '0|1' THEN r ELSE 0 END AS freq_value_b, 2 AS hp_b
FROM (SELECT va.*, CASE ref WHEN 'A' THEN a ELSE c END AS r, g AS al FROM va JOIN ct ON ct.chr = va.chr AND ct."start" = va.pos WHERE gt <> '1/1' AND length(alt) = 1) va""")
def snp_frequencies(spark, sf_dir):
    het = tables.het_snps(_variants(spark, sf_dir))
    return snps.frequencies(het, _counts(spark, sf_dir))


@query(_VARIANTS + _COUNTS + """ SELECT va.chr, pos, CASE gt WHEN '1|0' THEN r ELSE al END AS freq_value_a, 1 AS hp_a, CASE gt WHEN '1|0' THEN al ELSE r END AS freq_value_b, 2 AS hp_b
FROM (SELECT va.*, CASE ref WHEN 'A' THEN a ELSE c END AS r, g AS al FROM va JOIN ct ON ct.chr = va.chr AND ct."start" = va.pos WHERE gt <> '1/1' AND length(alt) = 1) va""")
def snp_frequencies_unphased(spark, sf_dir):
    het = tables.het_snps(_variants(spark, sf_dir))
    return snps.frequencies(het, _counts(spark, sf_dir), unphased=True)


@query(_VARIANTS + """ SELECT chr, pos, CASE WHEN ps IS NULL THEN 'GT:DP:AF:PS' ELSE 'GT:PS:DP:AF' END AS format,
CASE WHEN ps IS NULL THEN '1|1:' || CAST(n AS VARCHAR) || ':0.' || CAST(n AS VARCHAR) || ',1:7' ELSE '1|1:7:' || CAST(n AS VARCHAR) || ':0.' || CAST(n AS VARCHAR) || ',1' END AS sample FROM va""")
def with_genotype(spark, sf_dir):
    rows = _variants(spark, sf_dir).withColumns({"gt": F.lit("1|1"), "ps": F.lit(7).cast("long")})
    return tables.with_genotype(rows).select("chr", "pos", "format", "sample")


def _phased(spark, sf_dir):
    return _variants(spark, sf_dir).withColumns({"gt": tables.format_value("GT"), "ps": tables.format_value("PS").try_cast("bigint")})


_REASON = "CASE WHEN gt NOT LIKE '%|%' THEN 'not_phased' WHEN ps IS NULL THEN 'no_ps' WHEN length(alt) <> 1 THEN 'not_snv' END"


@query(_VARIANTS + f" SELECT chr, pos, {_REASON} AS reason FROM va")
def exclusion_reason(spark, sf_dir):
    return sync.exclusion_reason(_phased(spark, sf_dir)).select("chr", "pos", "reason")


@query(_VARIANTS + _COUNTS + f""", us AS (SELECT *, CASE ref WHEN 'A' THEN a ELSE c END AS r, g AS al, ct.chr IS NULL AS none FROM va LEFT JOIN ct ON ct.chr = va.chr AND ct."start" = va.pos WHERE {_REASON} IS NULL)
SELECT chr, pos, ps, CASE WHEN gt LIKE '0|%' THEN coalesce(r, 0) ELSE coalesce(al, 0) END AS hp1_depth, CASE WHEN gt LIKE '0|%' THEN coalesce(al, 0) ELSE coalesce(r, 0) END AS hp2_depth, CASE WHEN none THEN 'no_pileup_data' WHEN r + al = 0 THEN 'zero_relevant_depth' END AS reason FROM us""")
def haplotype_depths(spark, sf_dir):
    usable = sync.exclusion_reason(_phased(spark, sf_dir)).where("reason IS NULL").drop("reason")
    out = sync.haplotype_depths(usable, _counts(spark, sf_dir))
    return out.select("chr", "pos", "ps", F.coalesce("hp1_depth", F.lit(0)).alias("hp1_depth"), F.coalesce("hp2_depth", F.lit(0)).alias("hp2_depth"), "reason")


@query("""SELECT chr, ps AS "start", k % 5 + j % 3 + 1 AS a, j % 3 + 2 AS c, k % 5 AS g, j % 7 AS t FROM (SELECT chr, ps, ps AS k, "start" // 1000 + 4000 AS j FROM blk)""")
def pileup_text(spark, sf_dir):
    """Bases of pileups with marks of read ends, indels and matches."""
    k, j = F.col("ps") % 5, F.floor(F.col("start") / 1000) + 4000
    many = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    text = F.concat(many(".", k), many("a", j % 3), F.lit("^]"), many(",", F.lit(1)), F.lit("+12ACGTACGTACGT"), many("C", j % 3 + 1), F.lit("c$*"), many("G", k), F.lit("-2gg"), many("t", j % 7))
    rows = v.blk(spark, sf_dir).select("chr", F.col("ps").alias("start"), F.lit("a").alias("ref"), text.alias("bases"))
    return snps.base_counts(rows).select("chr", "start", *(F.col(c).cast("long").alias(c) for c in "acgt"))


# --- reads --------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS read_id, CAST(l_partkey AS BIGINT) AS p, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 2 = 0 AS rev FROM lineitem),
y AS (SELECT *, q + 110 AS m, 2 * q + 200 AS k, q + 300 AS n, 5 + q + 110 + 2 * q + 200 + 70 + q + 300 + 3 AS length FROM x),
z AS (SELECT read_id, rev, length, 5 AS a, 5 + m AS b, p AS c, p + m AS d, 0 AS ins FROM y UNION ALL SELECT read_id, rev, length, 5 + m + k, 5 + m + k + 70, p + m + 60 + k, p + m + 60 + k, 1 FROM y
  UNION ALL SELECT read_id, rev, length, 5 + m, 5 + m + k + 70 + n, p + m + 60, p + m + 60 + k + n, 0 FROM y)
SELECT read_id, CASE WHEN rev THEN length - b ELSE a END AS read_start, CASE WHEN rev THEN length - a ELSE b END AS read_end, c AS ref_start, d AS ref_end, length AS read_length, b - a AS segment_length, ins = 1 AS is_insertion, CAST(0 AS DOUBLE) AS mismatch_rate FROM z""")
def read_segments(spark, sf_dir):
    """Alignments with clips, a long deletion and a long insertion, walked into segments."""
    q = F.col("l_quantity").cast("long")
    text = F.concat(F.lit("5S"), (q + 110).cast("string"), F.lit("M60D"), (2 * q + 200).cast("string"), F.lit("M70I"), (q + 300).cast("string"), F.lit("M3H"))
    rows = v.table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("read_id"), F.lit("chr1").alias("ref_id"), F.col("l_partkey").cast("long").alias("pos"), text.alias("cigar"),
        (F.col("l_linenumber") % 2 == 0).alias("is_reverse"), F.lit(60).alias("mapq"), F.lit(1).alias("haplotype"), F.lit("g").alias("genome_id"), F.lit(0).alias("flag"),
    )
    found = reads.segments(rows)
    return found.select("read_id", "read_start", "read_end", "ref_start", "ref_end", "read_length", "segment_length", "is_insertion", F.round("mismatch_rate", 6).alias("mismatch_rate"))


@query("""SELECT chr, ps, CASE WHEN abs(x) = 3300 THEN NULL ELSE x END AS x FROM (SELECT chr, ps, CASE WHEN ps % 3 = 0 THEN 3300 WHEN ps % 3 = 1 THEN -3300 ELSE hp1 END AS x FROM blk)""")
def sentinel_to_null(spark, sf_dir):
    x = F.when(F.col("ps") % 3 == 0, 3300.0).when(F.col("ps") % 3 == 1, -3300.0).otherwise(F.col("hp1"))
    return v.blk(spark, sf_dir).select("chr", "ps", x.alias("x")).select("chr", "ps", sc.sentinel_to_null(F.col("x")).alias("x"))


@query("""SELECT c || s AS chr, CASE WHEN s <> '' THEN CASE WHEN c LIKE 'chrX%' THEN 3000 ELSE k + 2000 END WHEN c = 'chrX' THEN 1000 ELSE k END AS ord FROM
(SELECT CASE WHEN k = 23 THEN 'chrX' ELSE 'chr' || CAST(k AS VARCHAR) END AS c, s, k FROM (SELECT DISTINCT p_size % 23 + 1 AS k, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_alt' END AS s FROM part))""")
def contig_order(spark, sf_dir):
    """Names of contigs, plain and with suffixes, by their place in karyotypic order."""
    k = F.col("p_size") % 23 + 1
    name = F.concat(F.when(k == 23, "chrX").otherwise(F.concat(F.lit("chr"), k.cast("string"))), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("_alt"))
    rows = v.table(spark, sf_dir, "part").select(name.alias("chr")).distinct()
    return rows.select("chr", ct.chr_ord(F.col("chr")).cast("long").alias("ord"))


@query("""SELECT DISTINCT chr, CAST(replace(chr, 'chr', '') AS BIGINT) AS place FROM blk""")
def contig_list(spark, sf_dir):
    """The contigs of blocks that an expression names, with their places in it."""
    names = ct.expand("chr1-22,chrX")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("chr"))
    return v.blk(spark, sf_dir).where(F.col("chr").isin(names)).select("chr", place.cast("long").alias("place")).distinct()


# --- segments, profiles -------------------------------------------------------------------------------------


@query(base._ZYG + """, f AS (SELECT chr, "start", "start" - lag("start") OVER (PARTITION BY chr ORDER BY "start") AS gap FROM z WHERE hets / (hets + homs) < 0.8),
g AS (SELECT chr, "start", sum(CASE WHEN gap <= 200000 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY "start") AS run FROM f)
SELECT chr, min("start") AS "start", max("start") + 199999 AS "end" FROM g GROUP BY chr, run""")
def untrimmed_islands(spark, sf_dir):
    """Runs of bins with few heterozygous SNPs, no gap bridged and no bin left out."""
    ratios = snps.zygosity_ratios(snps.zygosity_counts(base._genotyped(spark, sf_dir)))
    return iv.islands(ratios.where("hets_ratio < 0.8"), snps.SNP_BIN, bridge=0, trim=0)


@query(base._CUTS + """ SELECT chr, "start", "end", round(state, 6) AS state FROM seg WHERE NOT (state = 0 AND EXISTS (SELECT 1 FROM cen WHERE cen.chr = seg.chr AND seg."start" < cen."end" AND seg."end" > cen."start"))""")
def without_lost_zeros(spark, sf_dir):
    found = segments.without_lost_zeros(base._segments(spark, sf_dir), v.centromeres(spark, sf_dir))
    return found.select("chr", "start", "end", base._r("state"))


_UNPHASED = base._POINTS + base._seg("raw", "hp1") + f""", sg AS (SELECT chr, "start", "end", {base._STEADY} AS st FROM raw),
sn AS (SELECT *, CAST(20 * {base._SNAP.format(d=0).replace("x", "st")} AS DOUBLE) AS state FROM sg), ss AS (SELECT *, abs((st - ({base._sql_near("st")})) / 10.0) / 1.4142135623730951 AS z FROM sn), sp AS (SELECT *, {base._sql_p("z")} AS p FROM ss),
lg AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY chr ORDER BY "start") THEN 0 ELSE 1 END AS n FROM sp), rn AS (SELECT *, sum(n) OVER (PARTITION BY chr ORDER BY "start") AS run FROM lg)"""


@query(_UNPHASED + """ SELECT chr, min("start") AS "start", max("end") AS "end", round_even(arg_min(st, "start"), 2) AS coverage, round(min(state) / 20, 6) AS copynumber_state, arg_min(p, "start") AS confidence FROM rn GROUP BY chr, run""")
def merged_track(spark, sf_dir):
    """One track snapped, scored and merged, as in a run without phasing."""
    scored = cn.segment_scores(segments.snap_segments(base._steady(spark, sf_dir, 1), CENTERS), CENTERS)
    merged = segments.merge_runs(scored.select("chr", "start", "end", "depth", "state"), "first").join(scored.select("chr", "start", "confidence"), ["chr", "start"])
    return merged.select("chr", "start", "end", F.bround("depth", 2).alias("coverage"), F.round(F.col("state") / 20, 6).alias("copynumber_state"), "confidence")


_OLD = f""", a AS (SELECT chr, k * 7 * {B} AS s, (k + 1) * 7 * {B} AS e, c, CASE WHEN k % 2 = 0 THEN 'Y' ELSE 'N' END AS y, 'x' || CAST(k AS VARCHAR) AS i FROM (SELECT chr, "start" // (7 * {B}) AS k, round(avg(hp1) + 1e-7, 2) AS c FROM bins GROUP BY 1, 2)),
b AS (SELECT chr, k * 5 * {B} AS s, (k + 1) * 5 * {B} AS e, c, CASE WHEN k % 2 = 0 THEN 'Y' ELSE 'N' END AS y, 'x' || CAST(k AS VARCHAR) AS i FROM (SELECT chr, "start" // (5 * {B}) AS k, round(avg(hp2) + 1e-7, 2) AS c FROM bins GROUP BY 1, 2)),
p AS (SELECT chr, s AS x FROM a UNION SELECT chr, e FROM a UNION SELECT chr, s FROM b UNION SELECT chr, e FROM b), f AS (SELECT chr, x AS s, lead(x) OVER (PARTITION BY chr ORDER BY x) AS e FROM p)"""


def _old(spark, sf_dir, hp, step):
    rows = base._track(spark, sf_dir, hp, step)
    k = F.floor(F.col("start") / (step * B))
    return rows.withColumns({"if_subclonal": F.when(k % 2 == 0, "Y").otherwise("N"), "svs_breakpoints_ids": F.concat(F.lit("{'x"), k.cast("string"), F.lit("'}"))})


@query(_OLD + """ SELECT f.chr, f.s AS "start", f.e AS "end", coalesce(a.c, 0) AS hp1_coverage, coalesce(b.c, 0) AS hp2_coverage, coalesce(a.y, 'N') AS hp1_is_subclonal, coalesce(b.y, 'N') AS hp2_is_subclonal,
CASE WHEN a.i IS NULL THEN coalesce(b.i, '') WHEN b.i IS NULL OR a.i = b.i THEN a.i ELSE least(a.i, b.i) || ';' || greatest(a.i, b.i) END AS svs_breakpoints_ids
FROM f LEFT JOIN a ON a.chr = f.chr AND a.s <= f.s AND a.e > f.s LEFT JOIN b ON b.chr = f.chr AND b.s <= f.s AND b.e > f.s WHERE f.e IS NOT NULL AND (a.c IS NOT NULL OR b.c IS NOT NULL)""")
def merged_old(spark, sf_dir):
    """Older profiles of one haplotype each as one, breakpoint ids united."""
    found = profile.merged_old(_old(spark, sf_dir, "hp1", 7), _old(spark, sf_dir, "hp2", 5))
    return found.select("chr", "start", "end", "hp1_coverage", "hp2_coverage", "hp1_is_subclonal", "hp2_is_subclonal", "svs_breakpoints_ids")


@query("""SELECT '#gene: name' AS value UNION ALL SELECT '#chr' || chr(9) || 'start' || chr(9) || 'end' || chr(9) || 'gene' UNION ALL
SELECT gene.chr || chr(9) || CAST("start" AS VARCHAR) || chr(9) || CAST("end" AS VARCHAR) || chr(9) || gene FROM gene""")
def lines_with_header(spark, sf_dir):
    return sinks.lines_with_header(v.gene(spark, sf_dir).select("chr", "start", "end", "gene"), ["#gene: name", "#chr\tstart\tend\tgene"])


@query(base._SYNC + """ SELECT CASE WHEN reason IS NULL AND f > k THEN 'flip' ELSE 'keep' END AS decision, coalesce(reason, 'compared') AS reason, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS snvs FROM re GROUP BY 1, 2""")
def sync_diagnostics(spark, sf_dir):
    data, prof = base._sync_inputs(spark, sf_dir)
    return sync.diagnostics(sync.decisions(sync.blocks_of(data), prof, data))


@query("""SELECT 'sv' || CAST(ps AS VARCHAR) AS id, CAST(ps % 13 AS BIGINT) AS dv FROM blk WHERE ps % 13 >= 5""")
def supported_junctions(spark, sf_dir):
    """Pairs with the support of a fifth of a copy of 25."""
    pairs = v.blk(spark, sf_dir).select(F.concat(F.lit("sv"), F.col("ps").cast("string")).alias("id"), (F.col("ps") % 13).cast("long").alias("dv"))
    return bp.supported(pairs, 25.0, 0.2)


@query("""SELECT 'sv' || CAST(ps AS VARCHAR) AS id, chr, "start" AS pos, '1' AS hp FROM blk UNION ALL SELECT 'sv' || CAST(ps AS VARCHAR), chr, "start" + ps % 7 * 90000 + 1, '2' FROM blk""")
def junction_ends(spark, sf_dir):
    return bp.ends(base._pairs(spark, sf_dir)).select("id", "chr", "pos", "hp")


_LOST = base._CUTS + f""", gr AS (SELECT CAST(i AS DOUBLE) * 2.5 AS normal FROM range(1, 4) r(i)), lo AS (SELECT chr, 400000 AS s, 1600000 AS e FROM contigs),
ib AS (SELECT seg.chr, seg."start", hp1 AS x, EXISTS (SELECT 1 FROM lo WHERE lo.chr = bins.chr AND bins."start" // {B} >= s // {B} AND bins."start" // {B} < e // {B}) AS lost FROM seg JOIN bins ON bins.chr = seg.chr AND bins."start" // {B} >= seg."start" // {B} AND bins."start" // {B} < seg."end" // {B}),
tc AS (SELECT DISTINCT chr, "start" FROM ib WHERE lost), mv AS (SELECT ib.chr, ib."start", normal, CASE WHEN lost THEN greatest(x - normal, 0) ELSE x END AS y FROM ib JOIN tc USING (chr, "start") CROSS JOIN gr)"""


@query(_LOST + """ SELECT chr, "start", normal, round(coalesce(median(CASE WHEN y > 0.1 THEN y END), 0) + 1e-9, 5) AS depth FROM mv GROUP BY 1, 2, 3""")
def moved_depths(spark, sf_dir):
    """Depths of the first haplotype's segments in a lost region for some normal coverages."""
    lost = v.contigs(spark, sf_dir).select("chr", F.lit(400_000).cast("long").alias("start"), F.lit(1_600_000).cast("long").alias("end"), F.lit(1).alias("hp"))
    grid = spark.range(1, 4).select((F.col("id") * 2.5).alias("normal"))
    found = cna.moved_depths(v.bins(spark, sf_dir), {1: base._segments(spark, sf_dir)}, lost, grid, B)
    return found.select("chr", "start", "normal", F.round(F.col("depth") + 1e-9, 5).alias("depth"))
