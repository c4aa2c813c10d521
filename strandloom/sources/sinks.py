"""Writers: tables, profiles with comment headers, VCF. Each overwrites what a run before has left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.contigs import chr_ord

PROFILE_COMMENTS = (
    "#chr: contig", "#start: start of the segment", "#end: end of the segment", "#coverage: median coverage of the segment's bins",
    "#copynumber_state: copy number of the segment (3300: masked)", "#confidence: closeness of the coverage to a copy number's center, from 0 to 1",
)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Headerless text, overwritten; files keep the partitioning of the rows."""
    df.write.mode("overwrite").option("sep", sep).csv(path)


def lines_with_header(df: DataFrame, header: list[str]) -> DataFrame:
    """Header lines and then tab-separated rows in karyotypic order, as a column of text.

    Order is kept by a range partitioning, so parts written side by side read in order.
    """
    spark = df.sparkSession
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    body = df.select(chr_ord(F.col("chr")).alias("o"), F.col("chr").alias("c"), F.col(df.columns[1]).cast("long").alias("p"), F.concat_ws("\t", *cells).alias("value"))
    head = spark.createDataFrame([(-1, "", i, line) for i, line in enumerate(header)], "o INT, c STRING, p BIGINT, value STRING")
    return head.unionByName(body).orderBy("o", "c", "p").select("value")


def write_profile(df: DataFrame, path: str) -> None:
    """A profile BED: comments, a line of column names, rows."""
    lines_with_header(df, [*PROFILE_COMMENTS, "#" + "\t".join(df.columns)]).write.mode("overwrite").text(path)


def vcf_header_lines(contigs: dict[str, int], sample: str = "Sample") -> list[str]:
    infos = {"SVTYPE": "String", "SVLEN": "Integer", "END": "Integer", "BPS": "String"}
    formats = {"GT": "String", "TCN": "Integer", "CN1": "Integer", "CN2": "Integer", "CNQ1": "Float", "CNQ2": "Float", "COV1": "Float", "COV2": "Float"}
    return [
        "##fileformat=VCFv4.2", *(f"##contig=<ID={c},length={n}>" for c, n in contigs.items()),
        *(f'##ALT=<ID={a},Description="{d}">' for a, d in (("DEL", "Loss"), ("DUP", "Gain"))),
        *(f'##INFO=<ID={k},Number=1,Type={t},Description="{k}">' for k, t in infos.items()),
        *(f'##FORMAT=<ID={k},Number=1,Type={t},Description="{k}">' for k, t in formats.items()),
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample,
    ]


def write_vcf(records: DataFrame, path: str, contigs: dict[str, int], sample: str = "Sample") -> None:
    lines_with_header(records, vcf_header_lines(contigs, sample)).write.mode("overwrite").text(path)


def with_phase_sets(header: list[str]) -> list[str]:
    """Header lines that declare phase sets."""
    declared = any(line.startswith("##FORMAT=<ID=PS,") for line in header)
    return [*header] if declared else [*header, '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">']


def write_variants(variants: DataFrame, path: str, header: list[str], sample: str = "Sample") -> None:
    """Variants (schema VARIANTS) as VCF under the header lines of the file they come from."""
    lines = with_phase_sets(header)
    names = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample
    rows = variants.withColumn("qual", F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit(".")))
    lines_with_header(rows, [*(lines or ["##fileformat=VCFv4.2"]), names]).write.mode("overwrite").text(path)


GENE_COMMENTS = (
    "#chr: contig", "#start: start of the gene", "#end: end of the gene", "#gene: name of the gene", "#actual_coverage: depth of a haplotype's SNPs in the gene",
    "#adjusted_coverage: depth of the segment's copy number", "#copynumber_state: copy number of the segment",
)


def write_genes(genes: DataFrame, path: str) -> None:
    """Copy numbers of genes: comments, a line of column names, rows with depths of two digits."""
    depth = lambda name, column: F.bround(column, 2).alias(name)
    genes = genes.select(
        "chr", "start", "end", "gene", *(depth(f"actual_coverage_hp{h}", f"hp{h}") for h in (1, 2)),
        *(depth(f"adjusted_coverage_hp{h}", f"adjusted_coverage_hp{h}") for h in (1, 2)), *(f"copynumber_hp{h}_state" for h in (1, 2)),
    )
    lines_with_header(genes, [*GENE_COMMENTS, "#" + "\t".join(genes.columns)]).write.mode("overwrite").text(path)


def write_solutions(df: DataFrame, path: str) -> None:
    """Solutions partitioned by rank, so each rank has a folder of its own."""
    df.write.mode("overwrite").partitionBy("solution_rank").parquet(path)
