"""Block-compressed VCF as a Spark data source: split where blocks begin, read by region, written with an index.

Reading: a file is cut into byte ranges. A range skips to the first line that begins in it behind a line end, and goes on
past its end to the next one, so each line is read once. Where regions are asked for and the file has a tabix index
(``.tbi``), only the blocks that may hold their lines are read. Of the columns of samples only the one asked for is
kept, and with the option ``fields`` only some of its FORMAT fields, each as a column.

Writing: rows come in range partitions, sorted. A task writes its lines as compressed blocks into a part of its own,
named for the attempt, and reports the part with the index of its lines; the commit appends the parts that were reported
for each partition to one file, block by block as they are, and merges the indexes. Parts of attempts that failed or were
repeated are not in any report that is committed, so they leave nothing behind. The target appears by a rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandloom.functions.contigs import chr_ord
from strandloom.schemas import VARIANTS

from . import bgzf
from .bgzf import ContigIndex, Pushed, Region

#: Lines of an Arrow batch; bytes that the commit copies at once.
BATCH, COPIED = 8192, 8 << 20
FIXED = ("chr", "pos", "id", "ref", "alt", "qual", "filter", "info")
LINES = "chr STRING, start BIGINT, end BIGINT, value STRING"


@dataclass
class Lines(InputPartition):
    """Lines that begin in a byte range, or between two virtual places; those of some regions where they are given."""

    path: str
    start: int
    end: int
    virtual: bool = False
    regions: tuple[Region, ...] | None = None


def lines_from(f, part: Lines) -> Iterator[bytes]:
    """The lines of a part, without their ends."""
    held, fresh = b"", part.virtual or part.start == 0
    place = []  # of each piece of held: where it begins there, the block's offset, the place in the block
    skipping = part.start & 0xFFFF if part.virtual else 0
    for offset, data in bgzf.blocks(f, part.start >> 16 if part.virtual else part.start, part.virtual):
        inside = True if part.virtual else offset < part.end
        data, skipped, skipping = data[skipping:], skipping, 0
        if not fresh:  # behind the end of the line that the range before reads
            if not inside:
                return
            cut = data.find(b"\n") + 1
            if not cut:
                continue
            # this line end belongs to the range before even where it is the last byte of a block
            data, fresh, skipped = data[cut:], True, skipped + cut
        place.append((len(held), offset, skipped))
        held += data
        at = 0
        while (end := held.find(b"\n", at)) >= 0:
            begun, block, shift = next(x for x in reversed(place) if x[0] <= at)
            if part.virtual and (block << 16 | shift + at - begun) >= part.end:
                return
            yield held[at:end].rstrip(b"\r")
            at = end + 1
            if not part.virtual and not inside:
                return
        if at:
            last = max(i for i, x in enumerate(place) if x[0] <= at)
            held, place = held[at:], [(max(0, b - at), o, s + max(0, at - b)) for b, o, s in place[last:]]
        if part.virtual and offset >= part.end >> 16 and not held:
            return
    if held and fresh:  # the last line of a file may have no end
        yield held


class VcfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rangebytes", 32 << 20))
        self.sample, self.fields = options.get("sample"), [f for f in options.get("fields", "").split(",") if f]
        self.asked = bgzf.regions_of(options["regions"]) if options.get("regions") else None
        self.pushed = Pushed("chr", "pos", 1)

    def partitions(self) -> list[Lines]:
        index = f"{self.path}.tbi" if bgzf.file_size(f"{self.path}.tbi") is not None else None
        contigs = bgzf.read_text_index(index) if index else {}
        pushed = self.pushed.regions(list(contigs)) if index else None
        wanted = pushed if self.asked is None else self.asked
        asked = tuple(self.asked) if self.asked else None
        if index is None or wanted is None:
            size = bgzf.file_size(self.path)
            return [Lines(self.path, a, min(a + self.step, size), False, asked) for a in range(0, size, self.step)]
        by: dict[str, list[tuple[int, int]]] = {}
        for r in wanted:
            if r.contig in contigs:
                by.setdefault(r.contig, []).extend(contigs[r.contig].chunks(r.start, r.end))
        out = []
        for contig, chunks in by.items():
            whole: list[tuple[int, int]] = []
            for a, b in sorted(chunks):
                if whole and a <= whole[-1][1]:
                    whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
                else:
                    whole.append((a, b))
            out += [Lines(self.path, a, b, True, asked) for a, b in bgzf.pieces(whole, contigs[contig].linear, self.step)]
        return out

    def _column(self) -> int:
        """The place of the sample that is asked for, by its name; the first one else."""
        if not self.sample:
            return 9
        with bgzf.open_file(self.path) as f:
            for line in lines_from(f, Lines(self.path, 0, 1 << 62)):
                if line.startswith(b"#CHROM"):
                    return line.decode().split("\t").index(self.sample)
                if not line.startswith(b"#"):
                    break
        raise ValueError(f"{self.path} has no sample {self.sample}")

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is nothing to read
            return
        column, rows = self._column(), []
        with bgzf.open_file(part.path) as f:
            for line in lines_from(f, part):
                if not line or line[:1] == b"#":
                    continue
                cells = line.decode().split("\t")
                if part.regions is not None:
                    start = int(cells[1]) - 1
                    if not any(cells[0] == r.contig and start < r.end and start + len(cells[3]) > r.start for r in part.regions):
                        continue
                cell = lambda i: cells[i] if i < len(cells) else None
                head = [cell(0), int(cells[1]), *map(cell, range(2, 5)), _number(cell(5)), cell(6), cell(7)]
                if self.fields:
                    values = dict(zip((cell(8) or "").split(":"), (cell(column) or "").split(":"), strict=False))
                    rows.append((*head, *map(values.get, self.fields)))
                else:
                    rows.append((*head, cell(8), cell(column)))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [*FIXED, *(self.fields or ("format", "sample"))]
        kinds = [pa.int64() if n == "pos" else pa.float64() if n == "qual" else pa.string() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class PushedVcfReader(VcfReader):
    """Takes filters on chr and pos as well; Spark refuses such a reader unless pushing is enabled."""

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            self.pushed.take(f)
            yield f


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its file, its bytes and the index of its lines, from the part's beginning."""

    partition: int
    file: str | None
    size: int
    contigs: dict[str, ContigIndex]


class VcfWriter(DataSourceArrowWriter):
    """Writes rows of LINES."""

    def __init__(self, options: dict[str, str]):
        self.path, self.header, self.folder = options["path"], options.get("header", ""), f"{options['path']}.parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId() if context else 0
        system, folder = bgzf.place(self.folder)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{number:06d}-{uuid.uuid4().hex}"
        contigs: dict[str, ContigIndex] = {}
        held, written, pending = bytearray(), 0, []
        with system.open_output_stream(name, compression=None) as out:

            def flush() -> None:
                nonlocal written
                data = bgzf.deflated(bytes(held))
                out.write(data)
                written += len(data)
                held.clear()

            def virtual() -> int:
                return written << 16 | len(held)

            for batch in batches:
                for chr_, start, end, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    line = value.encode() + b"\n"
                    first = virtual()
                    for a in range(0, len(line), bgzf.PLAIN):
                        piece = line[a : a + bgzf.PLAIN]
                        if len(held) + len(piece) > bgzf.PLAIN:
                            room = bgzf.PLAIN - len(held)
                            held.extend(piece[:room])
                            flush()
                            piece = piece[room:]
                        held.extend(piece)
                    pending.append((chr_, start, end, first, virtual()))
                    if len(pending) > 1:
                        self._add(contigs, pending.pop(0))
            if held:
                flush()
        for x in pending:
            self._add(contigs, (*x[:4], written << 16))
        return Part(number, name, written, contigs)

    @staticmethod
    def _add(contigs: dict[str, ContigIndex], record: tuple) -> None:
        chr_, start, end, first, last = record
        contigs.setdefault(chr_, ContigIndex()).add(start, end, first, last)

    def commit(self, messages: list[Part | None]) -> None:
        system, path = bgzf.place(self.path)
        # one part for each partition, whatever the number of attempts
        parts = {m.partition: m for m in messages if m is not None}
        contigs: dict[str, ContigIndex] = {}
        header = self.header.encode()
        head = b"".join(bgzf.deflated(header[a : a + bgzf.PLAIN]) for a in range(0, len(header), bgzf.PLAIN))
        at = len(head)
        with system.open_output_stream(f"{path}.new", compression=None) as out:
            out.write(head)
            for number in sorted(parts):
                part = parts[number]
                with system.open_input_stream(part.file, compression=None) as f:
                    while data := f.read(COPIED):
                        out.write(data)
                for name, index in part.contigs.items():
                    contigs.setdefault(name, ContigIndex()).merged(index, at)
                at += part.size
            out.write(bgzf.END)
        system.move(f"{path}.new", path)
        with system.open_output_stream(f"{path}.tbi", compression=None) as out:
            out.write(bgzf.text_index(contigs))
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, folder = bgzf.place(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class VcfSource(DataSource):
    """``spark.read.format("vcf")``. Options: path, rangebytes, regions (``chr1:101-200,chr2``), sample (its name), fields (FORMAT
    fields, comma separated, each a column), pushdown (needs ``spark.sql.python.filterPushdown.enabled``).

    Writes rows of LINES with the option ``header``; see ``write_vcf``.
    """

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        fields = [f for f in dict(self.options).get("fields", "").split(",") if f]
        return VARIANTS if not fields else ", ".join([*VARIANTS.split(", ")[:8], *(f"`{f}` STRING" for f in fields)])

    def reader(self, schema) -> VcfReader:
        options = dict(self.options)
        return (PushedVcfReader if options.get("pushdown", "false").lower() == "true" else VcfReader)(options)

    def writer(self, schema, overwrite: bool) -> VcfWriter:
        return VcfWriter(dict(self.options))


def read_blocks(spark: SparkSession, path: str, regions: str | None = None, **options) -> DataFrame:
    """Variants of a block-compressed VCF, or those that overlap some regions."""
    spark.dataSource.register(VcfSource)
    given = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | ({"regions": regions} if regions else {})
    return spark.read.format("vcf").options(**given, **{k: str(v) for k, v in options.items()}).load(path)


def write_blocks(variants: DataFrame, path: str, header: list[str], sample: str = "Sample", partitions: int | None = None) -> None:
    """Variants (schema VARIANTS) as one sorted, block-compressed VCF with a tabix index beside it."""
    spark = variants.sparkSession
    spark.dataSource.register(VcfSource)
    names = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample
    qual = F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit("."))
    cells = [F.coalesce(qual if c == "qual" else F.col(c).cast("string"), F.lit(".")) for c in (*FIXED, "format", "sample")]
    start = F.col("pos") - 1
    rows = variants.select(F.col("chr"), start.alias("start"), (start + F.greatest(F.length("ref"), F.lit(1))).alias("end"), F.concat_ws("\t", *cells).alias("value"), chr_ord(F.col("chr")).alias("__o"))
    keys = ["__o", "chr", "start", "value"]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    lines = dealt.sortWithinPartitions(*keys).select("chr", "start", "end", "value")
    lines.write.format("vcf").option("header", "\n".join([*(header or ["##fileformat=VCFv4.2"]), names]) + "\n").mode("overwrite").save(path)
