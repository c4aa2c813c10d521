"""Sources, sinks, the plans from end to end, streams and the command line, on generated files."""

import bisect
import gzip
import itertools
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom import cli, schemas
from strandloom.operators import coverage, reads, snps
from strandloom.plans import cna, hapcorrect
from strandloom.sources import bam, plots, sinks, tables
from strandloom.streaming import coverage as streams

LENGTH = 3_000_000


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, ref, pos, cigar, flag=0, hp=None, mapq=60):
    ops = [(n, "MIDNSHP=X".index(c)) for n, c in cigar]
    bases = sum(n for n, c in cigar if c in "MIS=X")
    tags = b"NMi\x05\0\0\0" + (b"HPC" + bytes([hp]) if hp is not None else b"") + b"RGZgroup\0"
    text = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(text), mapq, 0, len(ops), flag, bases, -1, -1, 0) + text + struct.pack(f"<{len(ops)}I", *(n << 4 | c for n, c in ops)) + bytes((bases + 1) // 2) + b"\x1e" * bases + tags
    return struct.pack("<i", len(body)) + body


def write_bam(path, records, size=700):
    names = [("chr1", LENGTH), ("chr2", LENGTH)]
    head = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in names) + b"".join(records)
    with open(path, "wb") as f:
        for a in range(0, len(data), size):
            f.write(block(data[a : a + size]))
        f.write(block(b""))


@pytest.mark.parametrize("step", [1 << 25, 3000, 900])
def test_bam_ranges_read_every_record_once(spark, tmp_path, step):
    rng = random.Random(3)
    want, some = [], []
    for i in range(300):
        n, hp = rng.randint(50, 900), rng.choice([None, 1, 2])
        some.append(record(f"read{i}", i % 2, i * 10, [(n, "M")], 16 * (i % 3 == 0), hp))
        want.append((f"read{i}", f"chr{i % 2 + 1}", i * 10, f"{n}M", i % 3 == 0, hp or 0))
    path = str(tmp_path / "a.bam")
    write_bam(path, some)
    spark.dataSource.register(bam.BamSource)
    df = spark.read.format("bam").option("rangebytes", step).load(path)
    got = [(r.read_id, r.ref_id, r.pos, r.cigar, r.is_reverse, r.haplotype) for r in df.collect()]
    assert sorted(got) == sorted(want)
    hist = coverage.histogram(reads.segments(df).select("genome_id", F.col("haplotype").alias("hp"), F.col("ref_id").alias("chr"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end")))
    assert hist.agg(F.sum("depth")).first()[0] > 300


def test_bases_at_positions(spark, tmp_path):
    path = str(tmp_path / "b.bam")
    write_bam(path, [record("a", 0, 99, [(2, "S"), (10, "M"), (3, "D"), (5, "I"), (10, "M")]), record("b", 0, 104, [(20, "M")], 1024), record("c", 1, 99_995, [(10, "M")])])
    spark.dataSource.register(bam.BamSource)
    df = spark.read.format("bam").option("bases", "true").load(path)
    assert [len(r.seq) for r in df.orderBy("read_id").collect()] == [27, 20, 10] and df.first().qual[0] == 30
    rng = random.Random(1)
    letters = "".join(rng.choice("ACGT") for _ in range(27))
    df = df.withColumn("seq", F.lit(letters))
    places = [("chr1", p) for p in (99, 100, 109, 110, 112, 113, 122, 123)] + [("chr2", 99_996), ("chr2", 100_001), ("chr2", 100_006)]
    got = {(r.chr, r.start): r.base for r in snps.pileup(df, spark.createDataFrame(places, "chr STRING, start BIGINT")).collect()}
    assert got == {("chr1", 100): letters[2], ("chr1", 109): letters[11], ("chr1", 113): letters[17], ("chr1", 122): letters[26], ("chr2", 99_996): letters[0], ("chr2", 100_001): letters[5]}
    counts = snps.count_bases(snps.pileup(df, spark.createDataFrame(places, "chr STRING, start BIGINT")))
    args = cli.parser().parse_args(["hapcorrect", "--out", "x", "--contig-lengths", "y", "--bam", path])
    assert cli.base_counts(spark, args, spark.createDataFrame(places, "chr STRING, start BIGINT")).count() == 6
    assert counts.count() == 6 and counts.agg(F.sum(F.col("a") + F.col("c") + F.col("g") + F.col("t"))).first()[0] == 6


VCF = """##fileformat=VCFv4.2
##FORMAT=<ID=VAF,Number=1,Type=Float,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS
chr1\t1000\t.\tA\tG\t30\tPASS\t.\tGT:PS:VAF\t0|1:900:0.4
chr1\t2000\t.\tAT\tG\t.\t.\t.\tGT:VAF\t1/1:0.9,0.1
chr1\t3000\t.\tC\tT\t5\tLOWQ\t.\tGT\t0/1
"""


def test_vcf_and_tables(spark, tmp_path):
    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress(VCF.encode()))
    path = str(tmp_path / "a.vcf.gz")
    v = tables.read_vcf(spark, path)
    assert v.count() == 2 and tables.read_vcf(spark, path, False).count() == 3
    head = tables.vcf_header(spark, path)
    assert tables.frequency_field(head) == "VAF" and tables.declares(head, "VAF") and not tables.declares(head, "AF")
    assert [tuple(r) for r in tables.het_snps(v).collect()] == [("chr1", 1000, "A", "G", "0|1")]
    assert [tuple(r) for r in tables.phaseset_positions(v).collect()] == [("chr1", 1000, 900)]
    assert [r.vaf for r in tables.loh_snps(v, "VAF").orderBy("pos").collect()] == ["0.4", "0.9,0.1"]
    (tmp_path / "c.bed").write_text("chr13\t1\t100\nchr2\t5\t9\n")
    (tmp_path / "empty.bed").write_text("")
    assert [tuple(r) for r in tables.read_centromeres(spark, str(tmp_path / "c.bed")).collect()] == [("chr13", 0, 100), ("chr2", 5, 9)]
    assert tables.read_table(spark, str(tmp_path / "empty.bed"), schemas.GENES).count() == 0
    assert [r.chr for r in tables.read_sorted(spark, str(tmp_path / "c.bed"), schemas.CENTROMERES).collect()] == ["chr2", "chr13"]
    assert tables.same_naming(v, v) and not tables.same_naming(v, spark.createDataFrame([("1",)], "chr STRING"))


def test_profiles_are_written_and_read(spark, tmp_path):
    rows = [("chr10", 0, 5, 1.0, 1.0, 0.5, 2.0, 2.0, 0.5), ("chr2", 0, 5, 1.0, 1.0, 0.5, 2.0, 2.0, 0.5)]
    df = spark.createDataFrame(rows, schemas.PROFILE)
    path = str(tmp_path / "p.bed")
    for _ in range(2):
        sinks.write_profile(df, path)
    back = tables.read_profile(spark, path)
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(rows)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sum(x.startswith("#") for x in lines) == len(sinks.PROFILE_COMMENTS) + 1


def sample(spark, seed=1):
    """SNPs of a genome with two levels, switched in every second block, and their phase sets."""
    rng = random.Random(seed)
    freqs, positions = [], []
    for c in ("chr1", "chr2"):
        for pos in range(1000, LENGTH, 4000):
            block = pos // 500_000
            a, b = (20, 40) if block % 2 == 0 else (40, 20)
            freqs.append((c, pos, a + rng.randint(-1, 1), b + rng.randint(-1, 1)))
            positions.append((c, pos, block * 500_000 + 2))
    return spark.createDataFrame(freqs, "chr STRING, pos BIGINT, freq_value_a INT, freq_value_b INT"), spark.createDataFrame(positions, schemas.PHASESET_POSITIONS)


def test_phase_correction_and_copy_numbers(spark):
    freqs, positions = sample(spark)
    contigs = spark.createDataFrame([("chr1", LENGTH), ("chr2", LENGTH)], schemas.CONTIGS)
    cen = spark.createDataFrame([("chr1", 1_000_000, 1_049_999)], schemas.CENTROMERES)
    done = hapcorrect.run(freqs, positions, contigs, cen)
    bins = [r for r in done.bins.collect() if r.hp1 > 1]
    for c in ("chr1", "chr2"):
        above = [r.hp1 > r.hp2 for r in bins if r.chr == c]
        assert max(above.count(True), above.count(False)) / len(above) > 0.95
    assert done.original_blocks.count() == 12 and done.flips.count() > 0 and done.loh.count() == 0
    points = spark.createDataFrame([("chr1", 1_500_100, None), ("chr2", 700_000, "1")], "chr STRING, pos BIGINT, hp STRING")
    found = cna.run(done.bins, points, cen, cna.Settings(first_copy=20.0, purity=(0.0, 1.0), ploidy=(0.1, 9.0)))
    best = found[0]
    assert best.numbers["solution_rank"] == 1 and 0 < best.numbers["confidence"] <= 1 and best.genes is None
    assert best.integer.where("hp1_copynumber_state = 3300").count() == 1 and best.subclonal.count() >= 4
    assert [f.numbers["solution_rank"] for f in found] == [*range(1, len(found) + 1)]


def test_figure_of_snps_keeps_bands_apart(spark, tmp_path):
    offsets = spark.createDataFrame([("chr1", 800, 0), ("chr2", 800, 800)], "chr STRING, len BIGINT, offset BIGINT")
    snps_ = [("chr1", 10, "het", 0.5)] * 3 + [("chr1", 11, "het", 0.1), ("chr2", 0, "hom", 1.0), ("chr2", 5, "hom", None), ("chr2", 5, "hom", 1.5), ("chrX", 5, "hom", 0.5)]
    points = spark.createDataFrame(snps_, "chr STRING, pos BIGINT, kind STRING, y DOUBLE")
    found = sorted(tuple(r) for r in plots.raster(points, offsets, 1600).collect())
    assert found == [("het", 5, 10, 1), ("het", 5, 50, 3), ("hom", 400, 99, 1)]
    plots.write_snps(f"{tmp_path}/svg", offsets, points, "a & b")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/svg").collect())
    assert text.count("<rect") == 3 and text.rstrip().endswith("</svg>") and "a &amp; b" in text


def test_lost_regions_cut_before_one_copy_is_known(spark):
    """The grid's limit comes from a first cut at the ends of lost regions, where the depth steps without a breakpoint."""
    bins = spark.createDataFrame([("chr1", k * 100, 10.0 if k < 30 else 60.0, 20.0) for k in range(100)], "chr STRING, start BIGINT, hp1 DOUBLE, hp2 DOUBLE")
    none = spark.createDataFrame([], "chr STRING, pos BIGINT, hp STRING")
    cen = spark.createDataFrame([], schemas.CENTROMERES)
    lost = spark.createDataFrame([("chr1", 0, 3000, 2)], "chr STRING, start BIGINT, end BIGINT, hp INT")
    assert cna.highest_normal(bins, none, cen, 100) == 40.0
    first = ((10 * 3000 + 60 * 6899) / 9899 + 20) / 2
    assert cna.highest_normal(bins, none, cen, 100, lost) == int(first) == 32
    assert cna.highest_normal(bins.where("false"), none, cen, 100, lost.where("false")) == 0.0


def test_a_switch_inside_a_block_is_undone(spark):
    """One block of a contig switches sides in its middle: bins, blocks and variants end on one side."""
    contigs = spark.createDataFrame([("chr1", LENGTH)], schemas.CONTIGS)
    cen = spark.createDataFrame([], schemas.CENTROMERES)
    rng = random.Random(6)
    freqs, positions, lines = [], [], []
    for pos in range(1000, LENGTH, 2500):
        a, b = (15, 45) if pos < 1_100_000 else (45, 15)
        freqs.append(("chr1", pos, a + rng.randint(-1, 1), b + rng.randint(-1, 1)))
        positions.append(("chr1", pos, 900))
        lines.append(("chr1", pos, ".", "A", "G", 30.0, "PASS", ".", "GT:PS:DP", "0|1:900:60"))
    done = hapcorrect.run(spark.createDataFrame(freqs, "chr STRING, pos BIGINT, freq_value_a INT, freq_value_b INT"), spark.createDataFrame(positions, schemas.PHASESET_POSITIONS), contigs, cen)
    bins = sorted((r.start, r.hp1 > r.hp2) for r in done.bins.collect() if r.hp1 > 1)
    assert len({above for _, above in bins}) == 1 and len(bins) == 60
    switched = {r.start for r in done.flips.collect()}
    assert switched in ({s for s, _ in bins if s < 1_100_000}, {s for s, _ in bins if s >= 1_100_000})
    assert [(r.start, r.end) for r in done.blocks.collect()] == [(1000, LENGTH - 1500)]
    out = hapcorrect.rephased(spark.createDataFrame(lines, schemas.VARIANTS), done).orderBy("pos").collect()
    # a variant in the first (last) bin of a block is judged by the next (previous) bin
    side = lambda gt: {r.pos for r in out if r.sample.startswith(gt)}
    first = {r.pos for r in out if r.pos < 1_100_000}
    assert {frozenset(side("0|1")), frozenset(side("1|0"))} == {frozenset(first), frozenset(r.pos for r in out) - first}
    assert {r.sample.split(":", 1)[1] for r in out} == {"1000:60"} and out[0].format == "GT:PS:DP"


def test_normal_cells_are_moved_in_lost_regions(spark):
    """Depths of a grid for segments with lost bins, against moving bins and taking medians one by one."""
    bins = spark.createDataFrame([("c", k * 100 + (k > 0), 30.0 + k % 3, 2.0 + k % 2) for k in range(40)], "chr STRING, start BIGINT, hp1 DOUBLE, hp2 DOUBLE")
    tracks = {h: spark.createDataFrame([("c", 0, 1500, 1.0), ("c", 1501, 4000, 1.0)], "chr STRING, start BIGINT, end BIGINT, state DOUBLE") for h in (1, 2)}
    lost = spark.createDataFrame([("c", 0, 900, 1)], "chr STRING, start BIGINT, end BIGINT, hp INT")
    grid = spark.createDataFrame([(2.0,), (5.5,)], "normal DOUBLE")
    found = {(r.start, r.hp, r.normal): r.depth for r in cna.moved_depths(bins, tracks, lost, grid, 100).collect()}
    assert {k[0] for k in found} == {0}
    for normal in (2.0, 5.5):
        _, sides = cna.moved(bins, tracks, lost, normal, 100)
        for hp in (1, 2):
            assert found[0, hp, normal] == sides[hp].where("start = 0").first().state


def test_unphased_profile(spark):
    bins = spark.createDataFrame([("c", k * 100 + (k > 0), 21.0 if k < 10 else 41.0) for k in range(30)], "chr STRING, start BIGINT, coverage DOUBLE")
    points = spark.createDataFrame([("c", 1000), ("c", 2000)], "chr STRING, pos BIGINT")
    cen = spark.createDataFrame([], schemas.CENTROMERES)
    found = cna.unphased_profile(bins, points, cen, [0.0, 20.0, 40.0, 60.0], 100)
    assert [(r.start, r.copynumber_state, r.coverage) for r in found.orderBy("start").collect()] == [(0, 1.0, 21.0), (1001, 2.0, 41.0)]
    assert found.columns == [f.split()[0] for f in schemas.PROFILE_UNPHASED.split(", ")]


def test_genotypes_are_written_into_samples(spark):
    rows = [("c", 1, ".", "A", "G", 1.0, "PASS", ".", "GT:DP", "0|1:5", "1|0", 7), ("c", 2, ".", "A", "G", 1.0, "PASS", ".", "GT:PS:DP", "0|1:3:5", "0/1", None), ("c", 3, ".", "A", "G", None, ".", ".", None, None, ".", None), ("c", 4, ".", "A", "G", 1.0, "PASS", ".", "GT:DP:PS", "0|1", "0|1", 9)]
    df = spark.createDataFrame(rows, schemas.VARIANTS + ", gt STRING, ps BIGINT")
    got = [(r.format, r.sample) for r in tables.with_genotype(df).orderBy("pos").collect()]
    assert got == [("GT:DP:PS", "1|0:5:7"), ("GT:PS:DP", "0/1:.:5"), (None, None), ("GT:DP:PS", "0|1:.:9")]


def test_headers_are_read_from_the_start(spark, tmp_path):
    """Long headers, marks further down, and several partitions."""
    text = ["##x"] * 1500 + ["#CHROM\tPOS", *(f"chr1\t{i}\t.\tA\tG\t1\tPASS\t.\tGT\t0/1" for i in range(500)), "##late"]
    (tmp_path / "h.vcf").write_text("\n".join(text) + "\n")
    assert len(tables.vcf_header(spark, str(tmp_path / "h.vcf"))) == 1500
    (tmp_path / "p.bed").write_text("#a: x\ty\n#chr\tstart\tend\tcoverage\nchr1\t0\t5\t1.5\n#chr\tother\tnames\tlate\n")
    assert tables.read_profile(spark, str(tmp_path / "p.bed")).columns == ["chr", "start", "end", "coverage"]


def test_older_profiles_are_merged(spark, tmp_path):
    head = "#chr: contig\n#chr\tstart\tend\tcoverage\tcopynumber_state\tconfidence\tif_subclonal\tsvs_breakpoints_ids\n"
    (tmp_path / "one.bed").write_text(head + "chr1\t0\t100\t20.5\t1\t0.9\tN\t{'a', 'b'}\n")
    (tmp_path / "two.bed").write_text(head + "chr1\t0\t40\t41.0\t2\t0.8\tY\tset()\nchr1\t40\t100\t0.0\t0\t1.0\tN\t{'b', \"c\"}\n")
    cli.main(["migrate", "--hp1", str(tmp_path / "one.bed"), "--hp2", str(tmp_path / "two.bed"), "--out", str(tmp_path / "merged.bed")], spark)
    back = tables.read_profile(spark, str(tmp_path / "merged.bed")).orderBy("start").collect()
    assert [(r.start, r.end, r.hp1_coverage, r.hp2_copynumber_state, r.hp2_is_subclonal, r.svs_breakpoints_ids) for r in back] == [(0, 40, 20.5, 2.0, "Y", "a;b"), (40, 100, 20.5, 0.0, "N", "a;b;c")]


def test_streams_agree_with_batches(spark, tmp_path):
    df = spark.createDataFrame([("g", 1, "c", 0, 1200), ("g", 1, "c", 400, 600), ("g", 2, "c", 9, 10)], "genome_id STRING, hp INT, chr STRING, start BIGINT, end BIGINT")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.histogram(live).writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, coverage.histogram(df).collect()))
    assert streams.zygosity(spark.createDataFrame([("c", 5, "0/1")], "chr STRING, pos BIGINT, gt STRING")).first().hets == 1


def test_command_line(spark, tmp_path):
    freqs, positions = sample(spark, 2)
    lines = ["##fileformat=VCFv4.2"]
    counts = []
    for f, p in zip(freqs.orderBy("chr", "pos").collect(), positions.orderBy("chr", "position").collect(), strict=True):
        lines.append(f"{f.chr}\t{f.pos}\t.\tA\tC\t9\tPASS\t.\tGT:PS\t1|0:{p.phasesets}")
        counts.append(f"{f.chr},{f.pos},{f.freq_value_a},{f.freq_value_b},0,0")
    for name, text in (("a.vcf", lines), ("counts.csv", counts), ("len.tsv", [f"chr{i}\t{LENGTH}" for i in (1, 2)]), ("cen.bed", ["chr1\t1000000\t1049999"])):
        (tmp_path / name).write_text("\n".join(text) + "\n")
    (tmp_path / "genes.tsv").write_text("chr1\t100000\t200000\tG1\nchr2\t900000\t990000\tG2\nchr2\t5\t9\tG3\n")
    (tmp_path / "names.txt").write_text("G1\nG2\n")
    (tmp_path / "sv.vcf").write_text("chr1\t1500100\tx\tN\t<DEL>\t1\tPASS\tSVTYPE=DEL;SVLEN=-90000\tGT:DV\t0/1:9\n")
    at = lambda n: str(tmp_path / n)
    common = ["--out", at("out"), "--contig-lengths", at("len.tsv"), "--contigs", "chr1-2", "--centromeres", at("cen.bed"), "--vcf", at("a.vcf"), "--base-counts", at("counts.csv")]
    common += ["--cancer-genes", at("genes.tsv"), "--user-input-genes", at("names.txt"), "--genome-name", "T1"]
    cli.main(["all", *common, "--use-sv-haplotypes", "--change-point-detection-for-cna", "--breakpoints", at("sv.vcf"), "--first-copy", "20", "--purity-range", "0-1", "--ploidy-range", "0.1-9"], spark)
    best = spark.read.parquet(at("out/solutions")).where("solution_rank = 1")
    assert best.count() == 1
    prof = at("out/solution_1/integer_profile.bed")
    assert tables.read_profile(spark, prof).where("svs_breakpoints_ids = 'x'").count() >= 1
    from xml.etree import ElementTree

    figure = ElementTree.fromstring("\n".join(r.value for r in spark.read.text(at("out/solution_1/integer_profile.svg")).collect()))
    kinds = [e.get("class") for e in figure]
    assert kinds.count("arc") == 1 and kinds.count("segment hp1") >= 2 and 20 < kinds.count("hp1") <= 1600
    assert len(spark.read.text(at("out/coverage_after.svg")).collect()) > 50
    genes = tables.read_profile(spark, at("out/solution_1/genes_copynumber_states.bed"))
    assert sorted(r.gene for r in genes.collect()) == ["G1", "G2"] and genes.where("adjusted_coverage_hp1 > 0").count() == 2
    assert spark.read.text(at("out/solution_1/subclonal_cna.vcf")).where("value LIKE '#CHROM%T1'").count() == 1
    again = tables.read_vcf(spark, at("out/rephased.vcf"))
    assert again.count() == freqs.count() and again.where("sample LIKE '0|1:%'").count() > 0 and again.where("sample LIKE '1|0:%'").count() > 0
    assert tables.vcf_header(spark, at("out/rephased.vcf"))[0] == "##fileformat=VCFv4.2"
    assert spark.read.parquet(at("out/baf")).where("vaf <> 3300").count() > 100 and spark.read.parquet(at("out/arcs")).count() == 1
    cli.main(["sync", *common, "--profile", prof], spark)
    assert tables.read_vcf(spark, at("out/synced.vcf")).count() == freqs.count()
    report = spark.read.option("header", True).option("sep", "\t").csv(at("out/sync_report"))
    assert report.count() == 12 and set(report.columns) >= {"chrom", "orig_ps", "decision", "reason"}
    cli.main(["cna", *common, "--without-phasing", "--first-copy", "20"], spark)
    assert "copynumber_state" in tables.read_profile(spark, at("out/solution/integer_profile.bed")).columns
    with pytest.raises(SystemExit):
        cli.main(["sync", "--out", "x", "--contig-lengths", "y"], spark)
    (tmp_path / "len.tsv").write_text(f"1\t{LENGTH}\n")
    with pytest.raises(SystemExit, match="name contigs"):
        cli.main(["hapcorrect", *common], spark)


def index_bam(path, names=("chr1", "chr2")):
    """An index made record by record, from the file alone."""
    from strandloom.sources import bgzf

    contigs = [bgzf.ContigIndex() for _ in names]
    with open(path, "rb") as f:
        found = list(bgzf.blocks(f, 0, True))
    plain = b"".join(data for _, data in found)
    begins = list(itertools.accumulate((len(data) for _, data in found), initial=0))
    at = bam.parse_header(plain)[1]

    def virtual(i):
        k = bisect.bisect_right(begins, i) - 1
        return found[k][0] << 16 | i - begins[k] if k < len(found) else found[-1][0] + 1 << 16

    while at < len(plain):
        size, ref, pos, name, _, _, ops = struct.unpack_from("<iiiBBHH", plain, at)
        cigar = struct.unpack_from(f"<{ops}I", plain, at + 36 + name)
        end = pos + sum(v >> 4 for v in cigar if v & 15 in (0, 2, 3, 7, 8))
        contigs[ref].add(pos, end, virtual(at), virtual(at + 4 + size))
        at += 4 + size
    with open(path + ".bai", "wb") as f:
        f.write(bgzf.alignment_index(contigs))


@pytest.mark.parametrize("step", [1 << 25, 2000])
def test_a_region_reads_only_its_blocks(spark, tmp_path, monkeypatch, step):
    rng = random.Random(5)
    placed = sorted((rng.randrange(2), rng.randrange(2_500_000), rng.randint(50, 40_000)) for _ in range(3000))
    path = str(tmp_path / "a.bam")
    write_bam(path, [record(f"r{i}", c, p, [(n // 2, "M"), (n // 2, "N"), (1, "M")]) for i, (c, p, n) in enumerate(placed)])
    index_bam(path)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            data = self.f.read(n)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(bam, "open_file", lambda p: Counted(open(p, "rb")))
    for region, (c, a, b) in {"chr1:1000001-1050000": (0, 1_000_000, 1_050_000), "chr2:2400001-2500000": (1, 2_400_000, 2_500_000), "chr2:1-10": (1, 0, 10)}.items():
        want = sorted(f"r{i}" for i, (k, p, n) in enumerate(placed) if k == c and p < b and p + n // 2 * 2 + 1 > a)
        read.clear()
        reader = bam.BamReader({"path": path, "regions": region, "rangebytes": str(step)})
        parts = reader.partitions()
        got = sorted(x for part in parts for batch in reader.read(part) for x in batch.column(0).to_pylist())
        assert got == want and all(p.virtual for p in parts)
        size = (tmp_path / "a.bam").stat().st_size
        headers = 1 + len(parts)
        assert sum(read) - headers * (1 << 20) < 0.25 * size + len(parts) * (1 << 18)
    spark.dataSource.register(bam.BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = bam.read_bam(spark, path, rangebytes=step).where("ref_id = 'chr2' AND pos >= 1000000 AND pos < 1200000")
    pushed = bam.PushedBamReader({"path": path, "rangebytes": str(step)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(pushed.pushFilters([EqualTo(("ref_id",), "chr2"), GreaterThan(("pos",), 2_000_000)]))) == 2 and all(p.virtual for p in pushed.partitions())
    assert sorted(r.read_id for r in df.collect()) == sorted(f"r{i}" for i, (k, p, _) in enumerate(placed) if k == 1 and 1_000_000 <= p < 1_200_000)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    both = bam.read_bam(spark, path, "chr1:1-300000,chr1:200001-400000,chr3")
    assert sorted(r.read_id for r in both.collect()) == sorted(f"r{i}" for i, (k, p, _) in enumerate(placed) if k == 0 and p < 400_000)
    (tmp_path / "a.bam.bai").unlink()
    assert both.count() == sum(k == 0 and p < 400_000 for k, p, _ in placed)


def test_bins_and_regions():
    from strandloom.sources import bgzf

    rng = random.Random(2)
    for _ in range(2000):
        a = rng.randrange(1 << 28)
        b = a + rng.choice([1, 100, 20_000, 5_000_000])
        lo = rng.randrange(1 << 28)
        hi = lo + rng.choice([1, 50_000, 10_000_000])
        if a < hi and b > lo:
            assert bgzf.bin_of(a, b) in bgzf.bins_over(lo, hi)
    assert bgzf.bin_of(0, 1) == 4681 and bgzf.bin_of(0, 1 << 29) == 0 and bgzf.bins_over(0, 1) == [4681, 585, 73, 9, 1, 0]
    assert bgzf.regions_of("chr1:101-200,chr2") == [bgzf.Region("chr1", 100, 200), bgzf.Region("chr2")]


def variants_of(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["chr1", "chr2", "chr10", "chrX"]), rng.randint(1, 900_000), ".", "A" * rng.choice([1, 1, 30]), "G", rng.choice([None, 30.0, 7.5]), "PASS", "." if rng.random() < 0.9 else "X" * 70_000 * (rng.random() < 0.02) or "DP=3", "GT:PS:AD", f"0|1:{i}:3") for i in range(n)]
    return rows


@pytest.mark.parametrize("step", [1 << 25, 5000, 700])
def test_blocks_of_variants_come_back(spark, tmp_path, step):
    from strandloom.sources import bgzf, vcf

    rows = variants_of(2500)
    path = str(tmp_path / "a.vcf.gz")
    df = spark.createDataFrame(rows, schemas.VARIANTS)
    vcf.write_blocks(df, path, ["##fileformat=VCFv4.2", "##note=" + "y" * 100_000], partitions=5)
    text = gzip.decompress((tmp_path / "a.vcf.gz").read_bytes()).decode()
    places = [("chr1 chr2 chr10 chrX".split().index(line.split("\t")[0]), int(line.split("\t")[1])) for line in text.splitlines() if line[0] != "#"]
    assert places == sorted(places) and len(places) == len(rows) and text.startswith("##fileformat") and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a.vcf.gz", "a.vcf.gz.tbi"]
    back = vcf.read_blocks(spark, path, rangebytes=step)
    plain = lambda x: sorted(map(repr, map(tuple, x)))
    assert plain(back.collect()) == plain(rows) and (step > 5000 or back.rdd.getNumPartitions() > 3)
    assert tables.read_vcf(spark, path).count() == len(rows)
    # split at any byte of the file, every line is read once
    with bgzf.open_file(path) as f:
        size = bgzf.file_size(path)
        want = text.encode().split(b"\n")[:-1]
        for cut in random.Random(step).sample(range(1, size), 12):
            assert [*vcf.lines_from(f, vcf.Lines(path, 0, cut)), *vcf.lines_from(f, vcf.Lines(path, cut, size))] == want, cut
    first = {c: min(r[1] for r in rows if r[0] == c) for c in ("chr1", "chr2", "chr10", "chrX")}
    for region in (*(f"{c}:1-{p}" for c, p in first.items()), "chr2:1000-200000", "chr10:500000-500100,chr10:500050-900000,chrX", "chr1:1-1", "chr7"):
        spans = bgzf.regions_of(region)
        expected = [r for r in rows if any(r[0] == s.contig and r[1] - 1 < s.end and r[1] - 1 + len(r[3]) > s.start for s in spans)]
        got = vcf.read_blocks(spark, path, region, rangebytes=step)
        assert plain(got.collect()) == plain(expected)
        assert plain(tables.read_vcf(spark, path, regions=region).collect()) == plain(expected)
    reader = vcf.VcfReader({"path": path, "regions": "chr2:1000-2000"})
    assert all(p.virtual for p in reader.partitions()) and sum((p.end >> 16) - (p.start >> 16) for p in reader.partitions()) < 0.4 * size
    short = vcf.read_blocks(spark, path, fields="PS,GT", sample="Sample")
    assert short.columns == [*vcf.FIXED, "PS", "GT"] and {r.PS for r in short.collect()} == {str(i) for i in range(2500)}


def test_a_repeated_task_leaves_one_copy(tmp_path):
    import pyarrow as pa

    from strandloom.sources import bgzf, vcf

    path = str(tmp_path / "a.vcf.gz")
    writer = vcf.VcfWriter({"path": path, "header": "##x\n"})
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(["chr1"] * (b - a)), pa.array(list(range(a, b))), pa.array([x + 1 for x in range(a, b)]), pa.array([f"chr1\t{x + 1}\t.\tA\tC" for x in range(a, b)])], ["chr", "start", "end", "value"])

    def broken():
        yield batch(0, 50)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(broken())
    first, again = writer.write(iter([batch(0, 60), batch(60, 100)])), writer.write(iter([batch(100, 130)]))
    writer.write(iter([batch(0, 100)]))  # an attempt that nobody reports
    again.partition = 1
    writer.commit([again, first, None])
    lines = gzip.decompress((tmp_path / "a.vcf.gz").read_bytes()).decode().splitlines()
    assert [int(x.split("\t")[1]) for x in lines[1:]] == list(range(1, 131))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.vcf.gz", "a.vcf.gz.tbi"]
    index = bgzf.read_text_index(path + ".tbi")["chr1"]
    assert index.chunks(120, 121) and not bgzf.ContigIndex().chunks(0, 5)
    other = vcf.VcfWriter({"path": path, "header": ""})
    other.write(iter([batch(0, 5)]))
    other.abort([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.vcf.gz", "a.vcf.gz.tbi"]
    empty = vcf.VcfWriter({"path": str(tmp_path / "b.vcf.gz"), "header": "##x\n"})
    empty.commit([empty.write(iter([]))])
    assert gzip.decompress((tmp_path / "b.vcf.gz").read_bytes()) == b"##x\n"


def test_depth_from_alignments_reaches_the_plan(spark, tmp_path):
    """Reads of both haplotypes and unphased ones give bins, blocks and lost regions their depth."""
    records, lines, counts = [], ["##fileformat=VCFv4.2", '##FORMAT=<ID=VAF,Number=1,Type=Float,Description="x">'], []
    spans = [(2000, "M"), *((40, "D"), (40, "M")) * 225]  # deletions below 50 bases do not split: 20,000 bases
    for start in range(0, 2_900_000, 10_000):
        for copy, hp in enumerate([1, 1, 2, None]):
            records.append(record(f"r{start}-{copy}", 0, start, spans, hp=hp))
        records.append(record(f"bad{start}", 0, start, spans, hp=1, mapq=1))
    for pos in range(5_001, 2_990_000, 5_000):
        lost = 1_000_000 <= pos < 2_400_000
        lines.append(f"chr1\t{pos}\t.\tA\tC\t9\tPASS\t.\tGT:PS:VAF\t" + ("1/1:.:1.0" if lost else f"1|0:{5_001 if pos < 1_500_000 else 2_400_001}:0.5"))
        counts.append(f"chr1,{pos},8,4,0,0")
    path = str(tmp_path / "a.bam")
    write_bam(path, records, 60_000)
    index_bam(path)
    for name, text in (("a.vcf", lines), ("counts.csv", counts), ("len.tsv", [f"chr1\t{LENGTH}"])):
        (tmp_path / name).write_text("\n".join(text) + "\n")
    at = lambda n: str(tmp_path / n)
    common = ["hapcorrect", "--contig-lengths", at("len.tsv"), "--contigs", "chr1", "--vcf", at("a.vcf"), "--base-counts", at("counts.csv"), "--bam", path]
    cli.main([*common, "--out", at("one"), "--histogram-coverage", "--compress-vcf", "--regions", "chr1"], spark)
    raw = spark.read.parquet(at("one/raw_bins")).where("start BETWEEN 100000 AND 2800000")
    low = raw.agg(*(F.min(c).alias(c) for c in ("hp1", "hp2", "hp3"))).first()
    assert low.hp3 > 1.5 and low.hp2 > 1.5 and low.hp1 > 3.5 and raw.agg(F.max("hp1")).first()[0] < 5
    assert spark.read.parquet(at("one/blocks")).where("hp1 > hp2 AND hp2 > 1").count() >= 1
    assert tables.read_vcf(spark, at("one/rephased.vcf.gz"), regions="chr1:1-100000").count() == 19
    # of a tumor alone: the lost region has the whole depth, unphased reads too
    cli.main([*common, "--out", at("two"), "--tumor-only"], spark)
    lost = spark.read.parquet(at("two/loh"))
    assert lost.count() == 1
    row = spark.read.parquet(at("two/bins")).where("start BETWEEN 1500000 AND 2000000").agg(F.min(F.greatest("hp1", "hp2")).alias("all")).first()
    assert row["all"] > 7.5
    with pytest.raises(SystemExit, match="needs --bam"):
        cli.main([*common[:-2], "--out", at("three"), "--histogram-coverage"], spark)
