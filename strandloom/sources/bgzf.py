"""Files of compressed blocks (BGZF) and their indexes: bins with chunks, linear offsets, virtual places.

A virtual place is the file offset of a block times 65,536 plus a place in the block's plain data. An index has, for
each contig, the chunks of virtual places of the records in each bin (a bin is one of 1, 8, 64 ... 32,768 equal parts of
2**29 bases; a record is in the smallest one that holds it), and for each 16,384 bases the first record that reaches
into them. The formats are those of the public SAM and tabix specifications.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Plain bytes of a block that is written; the empty block that ends a file; bases of a linear window, as bits.
PLAIN, WINDOW = 65_280, 14
#: Levels of bins: the first bin's number, and the bits of a bin's length, from the smallest.
LEVELS = tuple(((8**k - 1) // 7, 29 - 3 * k) for k in range(5, -1, -1))
#: A bin of this number holds statistics in indexes of alignments, no records.
STATISTICS = 37_450


def block_at(data: bytes, at: int) -> int:
    """Size of the compressed block that starts here, or 0."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or at + 18 > len(data):
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    p, end = at + 12, at + 12 + extra
    while p + 4 <= end and p + 6 <= len(data):
        size = struct.unpack_from("<H", data, p + 2)[0]
        if data[p : p + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", data, p + 4)[0] + 1
        p += 4 + size
    return 0


def inflate(data: bytes, at: int, size: int) -> bytes:
    extra = struct.unpack_from("<H", data, at + 10)[0]
    return zlib.decompress(data[at + 12 + extra : at + size - 8], -15)


def deflated(plain: bytes) -> bytes:
    """One block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(plain), len(plain))


END = deflated(b"")


def place(path: str):
    """The file system and path of a file: local, or any that a URI names and Arrow knows (s3, gs, abfs, hdfs)."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def open_file(path: str):
    """A file to read from and to seek in."""
    system, at = place(path)
    return system.open_input_file(at)


def file_size(path: str) -> int | None:
    """Bytes of a file; none without one."""
    from pyarrow import fs

    system, at = place(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def is_blocks(path: str) -> bool:
    """Whether a path is one file of compressed blocks."""
    if file_size(path) is None:
        return False
    with open_file(path) as f:
        return block_at(f.read(64), 0) > 0


def blocks(f, start: int, exact: bool, step: int = 1 << 17) -> Iterator[tuple[int, bytes]]:
    """Blocks from a place of a file on: their offsets and plain data, read as they are asked for.

    exact: a block starts there; else the first one is looked for, which is one that another follows.
    """
    f.seek(start)
    raw, at, offset, ended = b"", 0, start, False

    def more(need: int) -> bool:
        nonlocal raw, at, offset, ended
        while len(raw) - at < need and not ended:
            got = f.read(step)
            ended = not got
            raw, offset, at = raw[at:] + got, offset + at, 0
        return len(raw) - at >= need

    while not exact:
        more(1 << 17)
        if len(raw) - at < 18:
            return
        at = raw.find(b"\x1f\x8b\x08\x04", at)
        if at < 0:
            if ended:
                return
            raw, offset, at = raw[-3:], offset + len(raw) - 3, 0
            continue
        more(1 << 17)
        size = block_at(raw, at)
        if size and (at + size == len(raw) and ended or block_at(raw, at + size)):
            break
        at += 1
    while more(18):
        size = block_at(raw, at)
        if not size or not more(size):
            return
        here = offset + at
        data = inflate(raw, at, size)
        at += size
        yield here, data


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds the bases from start up to end (excluded)."""
    return next(first + (start >> bits) for first, bits in LEVELS if start >> bits == max(start, end - 1) >> bits or not first)


def bins_over(start: int, end: int) -> list[int]:
    """All bins that overlap these bases."""
    return [b for first, bits in LEVELS for b in range(first + (start >> bits), first + (min(max(start, end - 1), (1 << 29) - 1) >> bits) + 1)]


@dataclass
class ContigIndex:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)

    def add(self, start: int, end: int, first: int, last: int) -> None:
        """A record of some bases at some virtual places; records come in order."""
        chunks = self.bins.setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] == first:
            chunks[-1] = (chunks[-1][0], last)
        else:
            chunks.append((first, last))
        window = max(start, end - 1) >> WINDOW
        self.linear += [-1] * (window + 1 - len(self.linear))  # -1: no record yet; a part's first record is at 0
        for w in range(start >> WINDOW, window + 1):
            if self.linear[w] < 0:
                self.linear[w] = first

    def chunks(self, start: int, end: int) -> list[tuple[int, int]]:
        """Virtual places that hold all records of these bases, merged where one block ends the one and begins the next."""
        window = start >> WINDOW
        least = self.linear[window] if window < len(self.linear) else 0
        found = sorted(c for b in bins_over(start, end) for c in self.bins.get(b, ()) if c[1] > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def merged(self, other: ContigIndex, by: int) -> None:
        """Takes in the index of what was written behind, moved on by some bytes."""
        for b, chunks in other.bins.items():
            self.bins.setdefault(b, []).extend((x + (by << 16), y + (by << 16)) for x, y in chunks)
        self.linear += [-1] * (len(other.linear) - len(self.linear))
        for w, first in enumerate(other.linear):
            if self.linear[w] < 0 <= first:
                self.linear[w] = first + (by << 16)


def _read_contigs(data: bytes, at: int, n: int) -> list[ContigIndex]:
    out = []
    for _ in range(n):
        index, n_bins = ContigIndex(), struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", data, at)
            chunks = struct.unpack_from(f"<{2 * n_chunks}Q", data, at + 8)
            at += 8 + 16 * n_chunks
            if number != STATISTICS:
                index.bins[number] = list(zip(chunks[::2], chunks[1::2], strict=True))
        n_windows = struct.unpack_from("<i", data, at)[0]
        index.linear = list(struct.unpack_from(f"<{n_windows}Q", data, at + 4))
        at += 4 + 8 * n_windows
        out.append(index)
    return out


def _written_contigs(contigs: list[ContigIndex]) -> bytes:
    out = []
    for c in contigs:
        out.append(struct.pack("<i", len(c.bins)))
        for number, chunks in sorted(c.bins.items()):
            out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(x for chunk in chunks for x in chunk)))
        linear = list(c.linear)
        for w, first in enumerate(linear):  # a window without records has the offset of the one before
            if first < 0:
                linear[w] = linear[w - 1] if w else 0
        out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
    return b"".join(out)


def read_alignment_index(path: str) -> list[ContigIndex]:
    """The index of alignments, by number of the contig."""
    with open_file(path) as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{path} is no index of alignments")
    return _read_contigs(data, 8, struct.unpack_from("<i", data, 4)[0])


def alignment_index(contigs: list[ContigIndex]) -> bytes:
    return b"BAI\1" + struct.pack("<i", len(contigs)) + _written_contigs(contigs)


def read_text_index(path: str) -> dict[str, ContigIndex]:
    """The index of a sorted text, by contig."""
    with open_file(path) as f:
        data = b"".join(plain for _, plain in blocks(f, 0, True))
    if data[:4] != b"TBI\1":
        raise ValueError(f"{path} is no index of a text")
    n, size = struct.unpack_from("<i", data, 4)[0], struct.unpack_from("<i", data, 32)[0]
    names = data[36 : 36 + size].split(b"\0")[:n]
    return dict(zip((x.decode() for x in names), _read_contigs(data, 36 + size, n), strict=True))


def text_index(contigs: dict[str, ContigIndex]) -> bytes:
    """The index of a VCF, in blocks."""
    names = b"".join(c.encode() + b"\0" for c in contigs)
    plain = b"TBI\1" + struct.pack("<8i", len(contigs), 2, 1, 2, 0, ord("#"), 0, len(names)) + names + _written_contigs(list(contigs.values()))
    return b"".join(deflated(plain[a : a + PLAIN]) for a in range(0, len(plain), PLAIN)) + END


@dataclass(frozen=True)
class Region:
    """Bases of a contig from start up to end (excluded), both from 0."""

    contig: str
    start: int = 0
    end: int = 1 << 29


def regions_of(text: str) -> list[Region]:
    """``chr1:101-200,chr2``: first and last base from 1."""
    out = []
    for part in text.split(","):
        contig, _, span = part.partition(":")
        first, _, last = span.replace("_", "").partition("-")
        out.append(Region(contig, int(first) - 1 if first else 0, int(last) if last else 1 << 29))
    return out


class Pushed:
    """What filters on a contig and a position leave to be read."""

    def __init__(self, contig: str, position: str, base: int):
        #: base: the number of the first position.
        self.contig, self.position, self.base = contig, position, base
        self.contigs: set[str] | None = None
        self.start, self.end = 0, 1 << 29

    def take(self, filter_) -> None:
        name, column = type(filter_).__name__, getattr(filter_, "attribute", ("",))
        if column == (self.contig,) and name in ("EqualTo", "In"):
            found = {filter_.value} if name == "EqualTo" else set(filter_.value)
            self.contigs = found if self.contigs is None else self.contigs & found
        elif column == (self.position,) and name in ("EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"):
            at = int(filter_.value) - self.base
            if name in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                self.start = max(self.start, at + (name == "GreaterThan"))
            if name in ("EqualTo", "LessThan", "LessThanOrEqual"):
                self.end = min(self.end, at + (name != "LessThan"))

    def regions(self, contigs: list[str]) -> list[Region] | None:
        """Regions to be read; none for all."""
        if self.contigs is None and (self.start, self.end) == (0, 1 << 29):
            return None
        return [Region(c, self.start, self.end) for c in contigs if (self.contigs is None or c in self.contigs) and self.start < self.end]


def pieces(chunks: list[tuple[int, int]], linear: list[int], step: int) -> list[tuple[int, int]]:
    """Chunks cut, where records of a linear window begin, into pieces of about a number of bytes."""
    out = []
    for first, last in chunks:
        at = first
        for cut in sorted({x for x in linear if first < x < last}):
            if (cut >> 16) - (at >> 16) >= step:
                out.append((at, cut))
                at = cut
        out.append((at, last))
    return out
