"""Alignments from BAM files as a Spark data source, without native libraries.

A file is cut into byte ranges that tasks read side by side. A range starts at the first block and the first
record that look right from there on; a reader goes on past its end until the record it has begun is complete.

Where a region is asked for (option ``regions``, or filters on ref_id and pos) and the file has an index (``.bai``), only
the blocks that may hold its records are read, in pieces that begin at records. Records come in Arrow batches.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bgzf import Pushed, Region, block_at, blocks, file_size, inflate, open_file, pieces, read_alignment_index, regions_of

SCHEMA = "read_id STRING, ref_id STRING, pos BIGINT, cigar STRING, is_reverse BOOLEAN, mapq INT, haplotype TINYINT, genome_id STRING, flag INT"
#: With the option ``bases``: the read's bases and their qualities.
BASES_SCHEMA = SCHEMA + ", seq STRING, qual BINARY"
_OPS = "MIDNSHP=X"
_PAIRS = [a + b for a in "=ACMGRSVTWYHKDBN" for b in "=ACMGRSVTWYHKDBN"]
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def looks_like_record(data: bytes, at: int, n_refs: int) -> int:
    """The place behind a plausible record, or 0."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fixed = 32 + name + 4 * ops + (bases + 1) // 2 + bases
    good = 32 <= fixed <= size < 1 << 26 and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name > 1 and bases >= 0
    if not good or at + 36 + name > len(data):
        return 0
    text = data[at + 36 : at + 36 + name]
    return at + 4 + size if text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else 0


def haplotype(tags: bytes) -> int:
    """The value of the tag HP; 0 if there is none."""
    at = 0
    while at + 3 <= len(tags):
        tag, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(0, at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(tags[at])] * struct.unpack_from("<I", tags, at + 1)[0]
        else:
            if tag == b"HP":
                return int.from_bytes(tags[at : at + _SIZES[kind]], "little")
            at += _SIZES[kind]
    return 0


def parse_header(data: bytes) -> tuple[list[tuple[str, int]], int]:
    """Contigs with their lengths, and where the records begin."""
    text = struct.unpack_from("<i", data, 4)[0]
    at = 8 + text
    n = struct.unpack_from("<i", data, at)[0]
    at += 4
    out = []
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        name = data[at + 4 : at + 3 + size].decode()
        out.append((name, struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    return out, at


def read_header(path: str) -> tuple[list[tuple[str, int]], int]:
    with open_file(path) as f:
        raw, plain, at = f.read(1 << 20), b"", 0
        while True:
            size = block_at(raw, at)
            if size and at + size <= len(raw):
                plain += inflate(raw, at, size)
                at += size
                try:
                    return parse_header(plain)
                except (struct.error, IndexError):
                    continue
            more = f.read(1 << 20)
            if not more:
                raise ValueError(f"{path} has no complete header")
            raw += more


@dataclass
class Range(InputPartition):
    """Bytes of a file, or the records between two virtual places; those of some regions where they are given."""

    path: str
    start: int
    end: int
    virtual: bool = False
    regions: tuple[Region, ...] | None = None


#: Records of an Arrow batch.
BATCH = 4096
_TYPES = {"STRING": pa.string(), "BIGINT": pa.int64(), "BOOLEAN": pa.bool_(), "INT": pa.int32(), "TINYINT": pa.int8(), "BINARY": pa.binary()}
_CONSUMES = re.compile(r"(\d+)[MDN=X]")


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["path"].split(",")
        self.step = int(options.get("rangebytes", 32 << 20))
        self.genome = options.get("genome_id")
        self.bases = options.get("bases", "false").lower() == "true"
        self.asked = regions_of(options["regions"]) if options.get("regions") else None
        self.pushed = Pushed("ref_id", "pos", 0)

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            names = [c for c, _ in read_header(path)[0]] if self.asked or self.pushed.contigs is not None or self.pushed.start or self.pushed.end < 1 << 29 else []
            pushed = self.pushed.regions(names)
            wanted = self.asked if pushed is None else pushed if self.asked is None else [
                Region(a.contig, max(a.start, b.start), min(a.end, b.end)) for a in self.asked for b in pushed if a.contig == b.contig and max(a.start, b.start) < min(a.end, b.end)
            ]
            index = next((p for p in (f"{path}.bai", path.removesuffix(".bam") + ".bai") if file_size(p) is not None), None) if wanted is not None else None
            asked = tuple(self.asked) if self.asked else None
            if index is None:
                size = file_size(path)
                out += [Range(path, a, min(a + self.step, size), False, asked) for a in range(0, size, self.step)]
                continue
            contigs, by = read_alignment_index(index), {}
            for r in wanted:
                if r.contig in names:
                    by.setdefault(names.index(r.contig), []).append(r)
            for number, regions in by.items():
                # chunks of several regions may share blocks; each record is read once
                chunks: list[tuple[int, int]] = []
                for a, b in sorted(c for r in regions for c in contigs[number].chunks(r.start, r.end)):
                    if chunks and a <= chunks[-1][1]:
                        chunks[-1] = (chunks[-1][0], max(b, chunks[-1][1]))
                    else:
                        chunks.append((a, b))
                out += [Range(path, a, b, True, asked) for a, b in pieces(chunks, contigs[number].linear, self.step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is nothing to read
            return
        fields = [f.split() for f in (BASES_SCHEMA if self.bases else SCHEMA).split(", ")]
        rows: list[tuple] = []
        for row in self._between(part) if part.virtual else self._range(part):
            if part.regions is None or self._inside(row, part.regions):
                rows.append(row)
            if len(rows) == BATCH:
                yield self._batch(rows, fields)
                rows = []
        if rows:
            yield self._batch(rows, fields)

    @staticmethod
    def _batch(rows: list[tuple], fields: list[list[str]]) -> pa.RecordBatch:
        columns = [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

    @staticmethod
    def _inside(row: tuple, regions: tuple[Region, ...]) -> bool:
        """Whether an alignment overlaps a region."""
        contig, start = row[1], row[2]
        end = start + max(1, sum(map(int, _CONSUMES.findall(row[3]))))
        return any(contig == r.contig and start < r.end and end > r.start for r in regions)

    def _between(self, part: Range) -> Iterator[tuple]:
        """Records from one virtual place up to another."""
        names = [c for c, _ in read_header(part.path)[0]]
        with open_file(part.path) as f:
            plain, starts = b"", []  # where the blocks that are held begin: place in plain, offset in the file
            p = -1
            for offset, data in blocks(f, part.start >> 16, True):
                if p < 0:
                    p = part.start & 0xFFFF
                else:
                    plain, starts, p = plain[p:], [(a - p, o) for a, o in starts], 0
                starts.append((len(plain), offset))
                plain += data
                while p + 4 <= len(plain):
                    at, offset_ = next((a, o) for a, o in reversed(starts) if a <= p)
                    if offset_ << 16 | p - at >= part.end:
                        return
                    length = struct.unpack_from("<i", plain, p)[0]
                    if p + 4 + length > len(plain):
                        break
                    yield self._record(plain[p + 4 : p + 4 + length], names, part.path)
                    p += 4 + length
                if offset >= part.end >> 16 and not plain[p:]:
                    return

    def _range(self, part: Range) -> Iterator[tuple]:
        """Records that begin in a range of bytes."""
        contigs, first = read_header(part.path)
        names = [c for c, _ in contigs]
        with open_file(part.path) as f:
            f.seek(part.start)
            raw, at = f.read(self.step + (1 << 17)), 0
            offset = part.start
            while at < len(raw) - 18 and not ((size := block_at(raw, at)) and (at + size >= len(raw) - 18 or block_at(raw, at + size))):
                at += 1
            plain, p, synced = b"", 0, part.start == 0
            skip = first if synced else 0
            while True:
                inside = offset + at < part.end
                if not inside and not plain[p:]:
                    return
                while at + (size := block_at(raw, at)) > len(raw) or (not size and at < len(raw)):
                    more = f.read(1 << 20)
                    if not more:
                        break
                    raw += more
                if not size or at + size > len(raw):
                    more = f.read(1 << 20)
                    if not more:
                        return
                    raw += more
                    continue
                starts_inside = inside
                plain = plain[p:] + inflate(raw, at, size)
                p = 0
                at += size
                if skip:
                    cut = min(skip, len(plain))
                    p, skip = cut, skip - cut
                if not synced and starts_inside:
                    while p < len(plain) - 36:
                        q, chain = p, 0
                        while chain < 3 and (q := looks_like_record(plain, q, len(names))):
                            chain += 1
                            if q >= len(plain) - 36:
                                chain = 3
                        if chain >= 3:
                            synced = True
                            break
                        p += 1
                if not synced:
                    continue
                while p + 4 <= len(plain):
                    length = struct.unpack_from("<i", plain, p)[0]
                    if p + 4 + length > len(plain):
                        break
                    yield self._record(plain[p + 4 : p + 4 + length], names, part.path)
                    p += 4 + length
                    if not starts_inside:
                        return
                if not starts_inside and p == len(plain):
                    return

    def _record(self, r: bytes, names: list[str], path: str) -> tuple:
        ref, pos, name, mapq, _, ops, flag, bases = struct.unpack_from("<iiBBHHHi", r, 0)
        at = 32 + name
        cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{ops}I", r, at))
        packed = at + 4 * ops
        quality = packed + (bases + 1) // 2
        tags = r[quality + bases :]
        more = ("".join(map(_PAIRS.__getitem__, r[packed:quality]))[:bases], r[quality : quality + bases]) if self.bases else ()
        return (r[32 : 31 + name].decode(), names[ref] if ref >= 0 else None, pos, cigar, bool(flag & 16), mapq, haplotype(tags), self.genome or path.rsplit("/", 1)[-1], flag, *more)


class PushedBamReader(BamReader):
    """Takes filters as well; Spark refuses such a reader unless pushing is enabled."""

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        """Filters narrow what is read; Spark applies them once more, as a piece has records beside those."""
        for f in filters:
            self.pushed.take(f)
            yield f


class BamSource(DataSource):
    """``spark.dataSource.register(BamSource)``; then ``spark.read.format("bam").load("a.bam,b.bam")``.

    Options: rangebytes, genome_id, bases, regions (``chr1:101-200,chr2``: alignments that overlap them), pushdown (filters
    on ref_id and pos narrow what is read; needs ``spark.sql.python.filterPushdown.enabled``). Paths are local, or URIs of a store that Arrow opens;
    executors read their ranges themselves.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return BASES_SCHEMA if dict(self.options).get("bases", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> BamReader:
        options = dict(self.options)
        return (PushedBamReader if options.get("pushdown", "false").lower() == "true" else BamReader)(options)


def read_bam(spark, paths: str, regions: str | None = None, bases: bool = False, **options) -> DataFrame:
    """Alignments of files (comma separated), or of some regions of them; filters are pushed where the session allows it."""
    spark.dataSource.register(BamSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    given = {"bases": str(bases).lower(), "pushdown": pushes} | ({"regions": regions} if regions else {}) | {k: str(v) for k, v in options.items()}
    return spark.read.format("bam").options(**given).load(paths)
