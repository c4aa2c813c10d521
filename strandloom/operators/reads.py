"""Read segments: alignment walk, filters, flattening."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.schemas import READ_SEGMENTS

_OP = re.compile(r"(\d+)([MIDNSHP=X])")
#: Insertions and deletions of this length split an alignment; filters on reads.
SPLIT, MIN_SEGMENT, MAX_SEGMENTS, MIN_ALIGNED_RATE = 50, 100, 10, 0.5


def walk(cigar: str, start: int, reverse: bool, split: int = SPLIT) -> list[tuple[int, int, int, int, float, bool]]:
    """Pieces of one alignment: (read_start, read_end, ref_start, ref_end, mismatch rate, is insertion).

    Deletions of ``split`` bases and more end a piece, insertions as long are pieces of their own; skipped
    reference counts as a deletion. Read coordinates of reverse alignments count from the read's other end.
    """
    ops = [(int(n), op) for n, op in _OP.findall(cigar)]
    length = sum(n for n, op in ops if op in "MIS=XH")
    read = ops[0][0] if ops and ops[0][1] in "SH" else 0
    at, first_read, first_ref, bases, mismatches = start, read, start, 0, 0
    out: list[tuple[int, int, int, int, float, bool]] = []

    def close() -> None:
        if bases:
            out.append((first_read, read, first_ref, at, mismatches / bases, False))

    for n, op in ops:
        if op in "M=X":
            read, at, bases = read + n, at + n, bases + n
            mismatches += op == "X"
        elif op in "DN":
            if n >= split:
                close()
                at += n
                first_read, first_ref, bases, mismatches = read, at, 0, 0
            else:
                at += n
        elif op == "I":
            if n >= split:
                out.append((read, read + n, at, at, 0.0, True))
            read += n
    close()
    if reverse:
        out = [(length - b, length - a, c, d, m, ins) for a, b, c, d, m, ins in out]
    return out


def segments(alignments: DataFrame, split: int = SPLIT) -> DataFrame:
    """Alignments (read_id, ref_id, pos, cigar, is_reverse, mapq, haplotype, genome_id, flag) as read segments.

    Secondary and unmapped alignments are left out before the walk; the walk is row-local.
    """
    rows = alignments.where(F.expr("(flag & 260) = 0")).select("read_id", "ref_id", "pos", "cigar", "is_reverse", "mapq", "haplotype", "genome_id")
    names = [x.split()[0] for x in READ_SEGMENTS.split(", ")]

    def run(batches):
        for batch in batches:
            # pieces are columns of numbers; what a read's pieces share is taken from the batch by index
            of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cigars, reverse = of["cigar"].to_pylist(), of["is_reverse"].to_pylist()
            found = [walk(c, p, r, split) for c, p, r in zip(cigars, of["pos"].to_pylist(), reverse, strict=True)]
            owner = np.repeat(np.arange(len(found)), list(map(len, found)))
            flat = [x for pieces in found for x in pieces]
            a, b, c, d = (np.array([x[i] for x in flat], np.int64) for i in range(4))
            length = np.array([sum(int(n) for n, op in _OP.findall(x) if op in "MIS=XH") for x in cigars], np.int64)
            take = lambda column: column.take(pa.array(owner))
            strand = pa.array(np.where(np.array(reverse, bool), "-", "+")[owner], pa.string())
            columns = {
                "read_start": a, "read_end": b, "ref_start": c, "ref_end": d, "read_id": take(of["read_id"]), "ref_id": take(of["ref_id"]), "strand": strand, "read_length": length[owner], "segment_length": b - a,
                "haplotype": pc.fill_null(take(of["haplotype"]).cast(pa.int8()), 0), "mapq": take(of["mapq"]).cast(pa.int32()), "genome_id": take(of["genome_id"]),
                "mismatch_rate": np.array([x[4] for x in flat], np.float64), "is_insertion": np.array([x[5] for x in flat], bool),
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[n]) if isinstance(columns[n], np.ndarray) else columns[n] for n in names], names)

    return rows.mapInArrow(run, READ_SEGMENTS)


def filter_reads(df: DataFrame, min_mapq: int = 5, max_error: float = 0.1, min_aligned: int = 1000) -> DataFrame:
    """The segments of good reads: one passing segment per read_start, reads aligned well enough and not too split.

    One shuffle by read serves the de-duplication and the sums.
    """
    good = (F.col("mapq") > min_mapq) & (F.col("is_insertion") | ((F.col("segment_length") > MIN_SEGMENT) & (F.col("mismatch_rate") < max_error)))
    by_read = Window.partitionBy("read_id")
    at_start = by_read.partitionBy("read_id", "read_start").orderBy("ref_id", "ref_start", "ref_end")
    rows = df.repartition("read_id").withColumn("__count", F.count("*").over(by_read)).where(good).withColumn("__place", F.row_number().over(at_start)).where("__place = 1")
    aligned = F.sum(F.when(~F.col("is_insertion"), F.col("segment_length")).otherwise(0)).over(by_read)
    rows = rows.withColumn("__aligned", aligned)
    kept = (F.col("__aligned") >= min_aligned) & (F.col("__aligned") / F.col("read_length") >= MIN_ALIGNED_RATE) & (F.col("__count") <= MAX_SEGMENTS)
    return rows.where(kept).drop("__count", "__place", "__aligned")


def without_insertions(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_insertion"))
