"""Text tables: headerless TSV, BED with comment headers, VCF."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.contigs import karyotypic
from strandloom.schemas import CENTROMERES, GENES, VARIANTS

from . import vcf


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A headerless text table; an empty file is an empty table."""
    return spark.read.schema(schema).option("sep", sep).csv(path)


def read_sorted(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """The same in karyotypic order of its first column and then of the second."""
    df = read_table(spark, path, schema, sep)
    return karyotypic(df.withColumnRenamed(df.columns[0], "chr"), df.columns[1])


def read_centromeres(spark: SparkSession, path: str) -> DataFrame:
    """Centromeres, with a start of 1 as 0. One row per contig."""
    return read_table(spark, path, CENTROMERES).withColumn("start", F.when(F.col("start") == 1, 0).otherwise(F.col("start")))


def leading_lines(spark: SparkSession, path: str, mark: str) -> list[str]:
    """The lines that begin with a mark at the beginning of a text, in the order of the file.

    Only as many lines as the header has reach the driver (at most ten times more), from the first partitions.
    """
    n = 1000
    while True:
        lines = [r.value for r in spark.read.text(path).take(n)]
        head = next((i for i, line in enumerate(lines) if not line.startswith(mark)), len(lines))
        if head < len(lines) or len(lines) < n:
            return lines[:head]
        n *= 10


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A BED with comments; the last comment line with tabs before the rows names the columns."""
    head = [line for line in leading_lines(spark, path, "#") if "\t" in line]
    names = (head[-1] if head else "#chr\tstart\tend").lstrip("#").split("\t")
    text = {"chr", "chromosome", "svs_breakpoints_ids", "gene", "is_subclonal", "if_subclonal", "hp1_is_subclonal", "hp2_is_subclonal"}
    kinds = [T.StructField(n, T.StringType() if n in text else T.LongType() if n in ("start", "end") else T.DoubleType()) for n in names]
    return spark.read.schema(T.StructType(kinds)).option("sep", "\t").option("comment", "#").csv(path)


def read_vcf(spark: SparkSession, path: str, passed: bool = True, regions: str | None = None) -> DataFrame:
    """Variants of the first sample, of all contigs or of some regions (``chr1:101-200,chr2``).

    A file of compressed blocks is read in ranges side by side, and by its index where there is one; other gzip
    files are one task, plain text is split as Spark does.
    """
    if "," not in path and vcf.bgzf.is_blocks(path):
        out = vcf.read_blocks(spark, path, regions)
        return out.where(F.col("filter").isin("PASS", ".")) if passed else out
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    at = lambda i: F.try_element_at(cells, F.lit(i + 1))
    out = rows.select(at(0).alias("chr"), at(1).cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("double").alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("format"), at(9).alias("sample"))
    assert [f.split()[0] for f in VARIANTS.split(", ")] == out.columns
    if regions:
        end = F.col("pos") - 1 + F.length("ref")
        spans = [(F.col("chr") == r.contig) & (F.col("pos") <= r.end) & (end > r.start) for r in vcf.bgzf.regions_of(regions)]
        out = out.where(reduce(or_, spans))
    return out.where(F.col("filter").isin("PASS", ".")) if passed else out


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """The lines of a VCF before the line of column names."""
    return [line for line in leading_lines(spark, path, "#") if line.startswith("##")]


def declares(header: list[str], field: str) -> bool:
    return any(line.startswith(f"##FORMAT=<ID={field},") for line in header)


def frequency_field(header: list[str]) -> str | None:
    """The declared field of allele frequencies."""
    return next((f for f in ("AF", "VAF") if declares(header, f)), None)


def format_value(name: str, format_: str = "format", sample: str = "sample"):
    """A sample's value of a FORMAT field, null if absent."""
    place = F.array_position(F.split(F.col(format_), ":"), name).cast("int")
    return F.when(place > 0, F.try_element_at(F.split(F.col(sample), ":"), place))


def with_genotype(variants: DataFrame) -> DataFrame:
    """Variants (VARIANTS and gt, ps) with both written into their samples; a phase set of none is a dot, and a field PS
    is added where there is a phase set and no such field."""
    names, values = F.split("format", ":"), F.split("sample", ":")
    ps = F.coalesce(F.col("ps").cast("string"), F.lit("."))
    new = F.transform(names, lambda n, i: F.when(n == "GT", F.col("gt")).when(n == "PS", ps).otherwise(F.coalesce(F.try_element_at(values, i + 1), F.lit("."))))
    missing = F.col("ps").isNotNull() & ~F.array_contains(names, "PS")
    sample = F.array_join(F.when(missing, F.array_append(new, ps)).otherwise(new), ":")
    form = F.when(missing, F.concat(F.col("format"), F.lit(":PS"))).otherwise(F.col("format"))
    has = F.col("format").isNotNull() & F.col("sample").isNotNull()
    out = variants.withColumns({"sample": F.when(has, sample).otherwise(F.col("sample")), "format": F.when(has, form).otherwise(F.col("format"))})
    return out.select(*(f.split()[0] for f in VARIANTS.split(", ")))


def het_snps(variants: DataFrame) -> DataFrame:
    """Heterozygous variants of single bases: chr, start, ref, alt, gt."""
    gt = format_value("GT")
    return variants.select("chr", F.col("pos").alias("start"), "ref", "alt", gt.alias("gt")).where(F.col("gt").isin("0|1", "1|0", "0/1", "1/0") & (F.length("ref") == 1) & (F.length("alt") == 1))


def phaseset_positions(variants: DataFrame) -> DataFrame:
    return variants.select("chr", F.col("pos").alias("position"), format_value("PS").try_cast("bigint").alias("phasesets")).where("phasesets > 1")


def loh_snps(variants: DataFrame, frequency: str | None = "AF") -> DataFrame:
    """chr, pos, qual, gt, dp, vaf; a dot where the file declares no such field."""
    value = lambda n: F.coalesce(format_value(n), F.lit(".")) if n else F.lit(".")
    return variants.select("chr", "pos", "qual", format_value("GT").alias("gt"), value("DP").alias("dp"), value(frequency).alias("vaf"))


def read_genes(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A table of genes (chr, start, end, gene); of them the named ones, if names are given."""
    rows = read_table(spark, path, GENES)
    return rows.where(F.col("gene").isin(names)) if names else rows


def cosmic_genes(rows: DataFrame) -> DataFrame:
    """Gene table with prefixed contigs from (chromosome, genome_start, genome_stop, gene_symbol)."""
    return rows.select(F.concat(F.lit("chr"), "chromosome").alias("chr"), F.col("genome_start").cast("long").alias("start"), F.col("genome_stop").cast("long").alias("end"), F.col("gene_symbol").alias("gene"))


def same_naming(*tables: DataFrame) -> bool:
    """Whether all tables name contigs with the prefix, or all without."""
    seen = {bool(r.p) for t in tables for r in t.select(F.col("chr").startswith("chr").alias("p")).distinct().collect()}
    return len(seen) <= 1
