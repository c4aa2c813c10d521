"""Suffix-array dedup: longest-previous-factor arrays tell which bytes repeat an earlier string.

A byte is removed if a string of ``LEAST`` bytes that covers it also starts earlier: in a document of a smaller
id, or earlier in the same one. All documents together are one text far too long for one suffix array, so it is
cut into places that can match at all, and suffix arrays are made for what these hold:

1. Each string of LEAST bytes has an anchor, the ``GRAM``-byte gram of the smallest hash in it. Equal strings
   have equal anchors at equal places, so they can be found among the contexts (all strings with that anchor) of
   equal anchors. Contexts are named by 128-bit digests. One that occurred before as a whole is removed as a
   whole, first within a batch and then across the table, so a hot passage sends one row for each batch and
   different context. An anchor with one context only needs no more.
2. Of the others the bytes are fetched, and whole groups of equal anchors share a suffix array (``Suffixes``). In
   suffix order the previous and the next suffix of a smaller place in the text (``previous_factors``) have the
   longest prefixes that occur earlier; the longer of both is the longest previous factor. Strings start earlier
   where it has LEAST bytes.
3. The contexts of an anchor with more than ``SPLIT`` of them are cut into ``SLICES`` overlapping slices, dealt
   by the part that all strings of a slice have in common. Slices that are still more than ``HOT`` for one task
   are settled string by string with an aggregation (``_hot_strings``).

Rows are told apart by id and, where several rows share an id, by a 128-bit digest of their text.

Cases: null and empty texts have no bytes. Rows that repeat id and text are one document stored twice and do not
match each other; rows that share an id but not the text are ordered by their digests. A null id counts as
smaller than all others. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, bitmap_for, checkpoint, id_and_text, in_bitmap, map_batches, staged, texts

LEAST, GRAM = 100, 32
REACH = LEAST - GRAM
#: Bytes of a context at most; bytes of contexts in one suffix array; bytes of texts whose places are found at once.
WIDEST, ARRAY, PIECE = LEAST + REACH, 1 << 20, 16 << 20
#: Contexts of one anchor, and slices of one key, that one task may hold; slices of a context and their step.
SPLIT, HOT, SLICES, STEP = 1_000, 20_000, 4, 18
#: Lengths for which strings are ranked: seven symbols of nine bits fit a number, then each doubles the one before.
WIDTHS = (7, 14, 28, 56, 112)
_NO_ID = -(1 << 63)
_RANDOM = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A row's key.
ROW = ["doc", "m1", "m2"]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place, by doubling."""
    h, width = _RANDOM[data], 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = (h[:-width] * _ODD) ^ (h[width:] >> np.uint64(7)) ^ h[width:]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            width *= 2
    return h


def _extreme(values: np.ndarray, width: int, choose) -> np.ndarray:
    """The smallest (largest) value of each ``width`` consecutive ones."""
    have = 1
    while have * 2 <= width:
        values = choose(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return choose(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in a text of LEAST bytes or more, and their hashes."""
    h = gram_hashes(data)
    lowest = _extreme(h, REACH + 1, np.minimum)
    padded = np.concatenate([np.zeros(REACH, np.uint64), lowest, np.zeros(REACH, np.uint64)])
    at = np.flatnonzero(_extreme(padded, REACH + 1, np.maximum) == h)
    return at, h[at]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """128-bit digests as two columns of numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)


def _marks(ids: np.ndarray, bodies: list[bytes], shared: np.ndarray) -> np.ndarray:
    """What tells apart texts under one id; zeros where the bitmap of shared ids knows an id to be one row's."""
    out = np.zeros((len(bodies), 2), np.int64)
    several = np.flatnonzero(in_bitmap(shared, ids))
    if len(several):
        out[several] = digests([bodies[i] for i in several])
    return out


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the different rows of some columns in their order, and where each occurs first."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def _spans(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans joined within each (numbered) row."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    same = rows[1:] == rows[:-1]
    block = np.cumsum(np.concatenate([[True], ~same])) if len(rows) else np.empty(0, int)
    reach = np.maximum.accumulate(ends + block * (1 << 40)) - block * (1 << 40)
    new = np.ones(len(rows), bool)
    new[1:] = ~same | (starts[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return rows[first], starts[first], np.maximum.reduceat(ends, first) if len(first) else ends


# A place's row has in ``at`` its context's start, the bytes before the anchor and the length; where these are 0 the
# row is a covered span, whose end is in ``c1``.
_SCHEMA = "key long, c1 long, c2 long, doc long, m1 long, m2 long, at long"


def _at(start, left, length):
    return start << 16 | left << 8 | length


def _places(docs: DataFrame, shared) -> DataFrame:
    """Rows of _SCHEMA: the first place of each context in a piece of a batch, and what is covered within the piece."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, bodies = batch.column(0).to_numpy(zero_copy_only=False), texts(batch)
        long = [i for i, t in enumerate(bodies) if len(t) >= LEAST]
        if not long:
            return None
        ids, bodies = ids[long], [bodies[i] for i in long]
        marks = _marks(ids, bodies, shared.value)
        number, first = _numbered(ids, marks[:, 0], marks[:, 1])
        keys, ctx, row, at = [], [], [], []
        for i in first.tolist():  # rows in the order of the text; one that is stored twice counts once
            text = bodies[i]
            p, h = anchors(np.frombuffer(text, np.uint8))
            left = np.minimum(p, REACH)
            start, length = p - left, left + np.minimum(len(text) - p, LEAST)
            ctx.append(digests(text[a:b] for a, b in zip(start.tolist(), (start + length).tolist(), strict=True)))
            keys.append(h)
            row.append(np.full(len(p), number[i]))
            at.append(_at(start, left, length))
        ctx, key, row, at = np.concatenate(ctx), np.concatenate(keys).view(np.int64), np.concatenate(row), np.concatenate(at)
        order = np.argsort(ctx[:, 0], kind="stable")  # within equal contexts the order of the text remains
        new = np.concatenate([[True], np.any(ctx[order][1:] != ctx[order][:-1], axis=1)])
        heads, later = order[new], order[~new]
        start = at[later] >> 16
        r, s, e = _spans(row[later], start, start + (at[later] & 0xFF))
        holder = np.concatenate([first[row[heads]], first[r]])
        with np.errstate(over="ignore"):
            spread = (ids[first[r]].astype(np.uint64) * _ODD).view(np.int64)
        columns = [
            np.concatenate([key[heads], spread]), np.concatenate([ctx[heads, 0], e]), np.concatenate([ctx[heads, 1], np.zeros(len(r), np.int64)]),
            ids[holder], marks[holder, 0], marks[holder, 1], np.concatenate([at[heads], s << 16]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", "c1", "c2", *ROW, "at"])

    return map_batches(docs, run, _SCHEMA, rows=None, size=PIECE)  # copies collapse within a piece


_FOUND = "key long, doc long, m1 long, m2 long, at long, stop long"


def _sift(batches):
    """Over rows in the order of key, context and text: what is covered (stop), and places that need their bytes.

    Of a key's first context the row is held back until a second one comes.
    """
    key = ctx = origin = held = None  # what the batch before ended with; ``held``: the only context of its key so far
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)  # as _SCHEMA
        span = (rows[:, 6] & 0xFFFF) == 0
        out = [(np.zeros(span.sum(), np.int64), rows[span, 3:6], rows[span, 6], rows[span, 1])]
        rows = rows[~span]
        if n := len(rows):
            keys, contexts, places = rows[:, 0], rows[:, 1:3], rows[:, 3:7]
            new_key = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            new_ctx = new_key.copy()
            new_ctx[0] |= ctx is None or bool(np.any(contexts[0] != ctx))
            new_ctx[1:] |= np.any(contexts[1:] != contexts[:-1], axis=1)
            source = np.maximum.accumulate(np.where(new_ctx, np.arange(n), -1))
            firsts = places[source]
            if origin is not None:
                firsts[source < 0] = origin
            copy = ~new_ctx & np.any(places != firsts, axis=1)
            start = places[copy, 3] >> 16
            out.append((np.zeros(copy.sum(), np.int64), places[copy, :3], start << 16, start + (places[copy, 3] & 0xFF)))
            heads = np.flatnonzero(new_ctx)
            group = np.cumsum(new_key)  # 0: the key carried over
            counts = np.bincount(group[heads], minlength=group[-1] + 1)
            if counts[0] and held is not None:
                out.append((held[:1], held[None, 3:6], held[6:7], np.full(1, -1)))
                held = None
            many = counts > 1
            many[0] = counts[0] > 0
            wanted = heads[many[group[heads]]]
            out.append((keys[wanted], places[wanted, :3], places[wanted, 3], np.full(len(wanted), -1)))
            if new_key.any():
                last = heads[group[heads] == group[-1]]
                held = rows[last[0]] if len(last) == 1 else None
            key, ctx, origin = keys[-1], contexts[-1], firsts[-1]
        columns = [np.concatenate([x[0] for x in out]), *np.concatenate([x[1] for x in out]).T, np.concatenate([x[2] for x in out]), np.concatenate([x[3] for x in out])]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", *ROW, "at", "stop"])


def dense(values: np.ndarray) -> np.ndarray:
    """Ranks without gaps; equal values get equal ranks."""
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


class Suffixes:
    """The suffixes of some strings of at most WIDEST bytes, in lexicographic order, with their common prefixes.

    Strings are laid end to end with a symbol of its own between them; ranks of ever longer strings come from
    prefix doubling, and common prefixes from the ranks of falling lengths.
    """

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.offset = np.cumsum(self.lengths + 1) - self.lengths - 1
        data = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.symbols = np.zeros(len(data) + 2 * WIDEST, np.int64)
        self.symbols[: len(data)] = data
        self.symbols[: len(data)] += 1
        self.symbols[self.offset + self.lengths] = 0
        n = len(self.symbols)
        code = np.zeros(n - WIDTHS[0] + 1, np.int64)
        for i in range(WIDTHS[0]):
            code = code << 9 | self.symbols[i : len(code) + i]
        self.ranks = {WIDTHS[0]: dense(code)}
        for width, twice in zip(WIDTHS, WIDTHS[1:], strict=False):
            rank = self.ranks[width]
            self.ranks[twice] = dense(rank[:-width] << 31 | rank[width:])

    def order(self, starts: np.ndarray) -> np.ndarray:
        """The suffix array of some places: their order by the WIDEST symbols from each."""
        long, short = self.ranks[WIDTHS[-1]], self.ranks[WIDEST - WIDTHS[-1]]
        return np.argsort(long[starts] << 31 | short[starts + WIDTHS[-1]])

    def share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes from a and b share LEAST bytes, pair by pair."""
        half = self.ranks[56]
        rest = LEAST - 56
        return (half[a] == half[b]) & (half[a + rest] == half[b + rest])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes that share LEAST bytes, pair by pair."""
        n = np.full(len(a), LEAST)
        for width in WIDTHS[-2::-1]:
            n += width * (self.ranks[width][a + n] == self.ranks[width][b + n])
        for _ in range(WIDTHS[0] - 1):
            n += self.symbols[a + n] == self.symbols[b + n]
        return np.minimum(n, WIDEST)


def previous_factors(places: list[int], common: list[int]) -> tuple[list[int], list[int], list[int]]:
    """In suffix order: where the previous and the next smaller place stand (-1, n: none), and the longest previous factor.

    ``common[i]`` is the longest common prefix of the suffixes i - 1 and i. Places that wait for a smaller one are on
    a stack with the prefix that they share with the one below, so each is put there and taken off once.
    """
    n = len(places)
    previous, following, longest = [-1] * n, [n] * n, [0] * n
    stack: list[tuple[int, int, int]] = []
    for i, (place, shared) in enumerate(zip(places, common, strict=True)):
        while stack and stack[-1][0] > place:
            _, at, below = stack.pop()
            following[at] = i
            if shared > below:
                longest[at] = shared
                shared = below
            else:
                longest[at] = below
        if stack:
            previous[i] = stack[-1][1]
        stack.append((place, i, shared if stack else 0))
    for _, at, below in stack:
        longest[at] = below
    return previous, following, longest


def earlier(contexts: list[bytes], rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of contexts, offsets in them and longest previous factors where these have LEAST bytes or more.

    Contexts begin at ``begins`` of (numbered) rows; any number of groups may be mixed, and what is the same place
    of the text in several contexts counts once.
    """
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    room = np.maximum(lengths - LEAST + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), room)
    inside = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    if not len(owner):
        return owner, inside, inside
    where = rows[owner] << 40 | begins[owner] + inside
    text_order = np.argsort(where)
    where = where[text_order]
    text_order = text_order[np.concatenate([[True], where[1:] != where[:-1]])]
    owner, inside = owner[text_order], inside[text_order]  # from here on a place is its index in the text's order
    suffixes = Suffixes(contexts)
    starts = suffixes.offset[owner] + inside
    order = suffixes.order(starts)
    near = suffixes.share(starts[order[:-1]], starts[order[1:]])
    # a suffix that shares less with both neighbours has no factor of LEAST bytes: only runs of others are of use
    run = np.concatenate([[False], near]) | np.concatenate([near, [False]])
    places = order[run]
    common = np.zeros(len(order), np.int64)
    linked = np.flatnonzero(near) + 1
    common[linked] = suffixes.common(starts[order[linked - 1]], starts[order[linked]])
    _, _, longest = previous_factors(places.tolist(), common[run].tolist())
    factor = np.minimum(np.array(longest, np.int64), lengths[owner[places]] - inside[places])
    found = factor >= LEAST
    return owner[places[found]], inside[places[found]], factor[found]


def _match(batches):
    """Over contexts in the order of key: the spans that occur earlier, group of keys by group of keys."""
    held: list[tuple] = []
    size = 0

    def settle():
        key = [np.array([r[i] for r in held], np.int64) for i in (1, 2, 3)]
        # several anchors may share one suffix array: strings that are equal match, whatever their anchor
        number, first = _numbered(*key)
        begins = np.array([r[4] for r in held], np.int64)
        owner, inside, factor = earlier([r[5] for r in held], number, begins)
        starts = begins[owner] + inside
        row, s, e = _spans(number[owner], starts, starts + factor)
        columns = [*(k[first[row]] for k in key), s << 16, e]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(s), np.int64)), *map(pa.array, columns)], ["key", *ROW, "at", "stop"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= ARRAY and row[0] != held[-1][0]:
                yield settle()
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield settle()


def _bodies(docs: DataFrame, wanted: DataFrame, shared) -> DataFrame:
    """(doc, m1, m2, body) of the documents in ``wanted``; a bitmap keeps most others where they are."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_for(wanted, "doc"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        chosen = pa.array(np.flatnonzero(in_bitmap(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))
        if not len(chosen):
            return None
        some = batch.take(chosen)
        bodies = texts(some)
        marks = _marks(some.column(0).to_numpy(zero_copy_only=False), bodies, shared.value)
        return pa.RecordBatch.from_arrays([some.column(0), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(bodies, pa.binary())], [*ROW, "body"])

    return map_batches(docs, run, "doc long, m1 long, m2 long, body binary", size=PIECE)


def _contexts(docs: DataFrame, places: DataFrame, shared) -> DataFrame:
    """(key, doc, m1, m2, at, body) with the bytes of each place's context."""
    by_doc = places.groupBy(*ROW).agg(F.collect_list(F.struct("key", "at")).alias("places"))
    found = _bodies(docs, places.select("doc").distinct(), shared)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for *row, body, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for x in some:
                start = x["at"] >> 16
                rows.append((x["key"], *row, x["at"], body[start : start + (x["at"] & 0xFF)]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 5 else pa.int64()) for i in range(6)], ["key", *ROW, "at", "body"])

    # a repeated row comes twice, with the same places
    return map_batches(found.join(by_doc, ROW).select(*ROW, "body", "places"), run, "key long, doc long, m1 long, m2 long, at long, body binary", rows=100)


def _slices(contexts: DataFrame) -> DataFrame:
    """(key, doc, m1, m2, start, body) of the contexts of anchors with many of them, cut so that a hot anchor is dealt out.

    A string of LEAST bytes begins from 0 to REACH bytes before its anchor; the slice of its range of STEP such
    distances holds it, and all strings of a slice hold the same part of it, whose hash is the new key.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, *row, at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start, left = at >> 16, at >> 8 & 0xFF
            for k in range(SLICES):
                least, most = k * STEP, min(k * STEP + STEP - 1, REACH)
                a, b = max(0, left - most), min(len(body), left - least + LEAST)
                if left >= least and b - a >= LEAST:
                    part = body[left - least : left + LEAST - most]
                    rows.append((xxhash.xxh3_64_intdigest(part, seed=(key + k) % (1 << 64)) - (1 << 63), *row, start + a, body[a:b]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 5 else pa.int64()) for i in range(6)], ["key", *ROW, "start", "body"])

    return map_batches(contexts, run, "key long, doc long, m1 long, m2 long, start long, body binary")


def _hot_strings(slices: DataFrame) -> DataFrame:
    """Covered spans of slices that are too many for one task: every string of LEAST bytes is a row, the first place
    of each comes from an aggregation with partial results, and a join finds the later places."""
    strings = slices.withColumn("o", F.explode(F.sequence(F.lit(0), F.length("body") - LEAST))).select(*ROW, (F.col("start") + F.col("o")).alias("start"), F.substring(F.col("body"), F.col("o") + 1, F.lit(LEAST)).alias("s"))
    place = F.struct(*ROW, "start")
    first = checkpoint(strings.groupBy("s").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    later = strings.join(first, "s").where(place > F.col("first"))
    return later.select(*ROW, F.shiftleft("start", 16).alias("at"), (F.col("start") + LEAST).alias("stop"))


def repeated_spans(rows: DataFrame, shared, split: int = SPLIT, hot: int = HOT) -> DataFrame:
    """(doc, m1, m2, at, stop): covered spans of rows as ``_rows`` gives them; ``at >> 16`` is the start."""
    columns = [*ROW, "at", "stop"]
    sifted = staged(_places(rows, shared).repartition("key").sortWithinPartitions("key", "c1", "c2", *ROW, "at").mapInArrow(_sift, _FOUND))
    places = sifted.where("stop < 0").select("key", *ROW, "at").distinct()
    crowded = checkpoint(places.groupBy("key").count().where(F.col("count") > split).select("key"))
    spans = sifted.where("stop >= 0").select(columns)
    contexts = _contexts(rows, places, shared)
    start = F.shiftright("at", 16).alias("start")
    if crowded.isEmpty():
        few = contexts.select("key", *ROW, start, "body")
    else:
        contexts = staged(contexts)
        slices = staged(_slices(contexts.join(crowded, "key", "left_semi")))
        few = contexts.join(crowded, "key", "left_anti").select("key", *ROW, start, "body")
        hottest = checkpoint(slices.groupBy("key").count().where(F.col("count") > hot).select("key"))
        if hottest.isEmpty():
            few = few.union(slices)
        else:
            spans = spans.union(_hot_strings(slices.join(hottest, "key", "left_semi")).select(columns))
            few = few.union(slices.join(hottest, "key", "left_anti").select(few.columns))
    matched = few.repartition("key").sortWithinPartitions("key").mapInArrow(_match, _FOUND)
    return spans.union(matched.select(columns))


def _rows(docs: DataFrame, id_col: str, text_col: str):
    """Ids and texts, a null id as the smallest number, and a broadcast bitmap of the ids that several rows share."""
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select(F.coalesce(ID, F.lit(_NO_ID).cast("long")).alias(ID), TEXT)
    several = checkpoint(rows.groupBy(F.col(ID).alias("doc")).count().where("count > 1").select("doc"))
    return rows, docs.sparkSession.sparkContext.broadcast(bitmap_for(several, "doc"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (spans of bytes), kept (what is left, as bytes)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    rows, shared = _rows(docs, id_col, text_col)
    spans = repeated_spans(rows, shared, split, hot)
    spans = staged(spans.groupBy(*ROW).agg(F.collect_list(F.struct(F.shiftright("at", 16).alias("start"), "stop")).alias("spans")))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_for(spans.select("doc").distinct(), "doc"))
    schema = "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"

    def result(ids, bodies, found) -> pa.RecordBatch:
        kept, gone = [], []
        for body, some in zip(bodies, found, strict=True):
            some = joined([(x["start"], x["stop"]) for x in some or ()])
            at, parts = 0, []
            for a, b in some:
                parts.append(body[at:a])
                at = b
            kept.append(b"".join([*parts, body[at:]]) if some else body)
            gone.append([{"start": a, "stop": b} for a, b in some])
        plain = [None if i == _NO_ID else i for i in ids.to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(plain, pa.int64()), pa.array(map(len, bodies), pa.int64()), pa.array(gone, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    def untouched(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        chosen = pa.array(np.flatnonzero(~in_bitmap(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))
        some = batch.take(chosen)
        return result(some.column(0), texts(some), [None] * len(chosen)) if len(chosen) else None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return result(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    touched = _bodies(rows, spans.select("doc").distinct(), shared).join(spans, ROW, "left").select("doc", "body", "spans")
    return map_batches(rows, untouched, schema, size=PIECE).union(map_batches(touched, cut, schema))


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """What stays of every document when repeated strings are removed."""
    from .common import table

    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT doc_id, h, unnest(generate_series(0, CAST(length(h) / 2 AS BIGINT) - 100)) AS i FROM d WHERE length(h) >= 200),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM u),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM f WHERE again),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM r),
j AS (SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(b) AS last FROM d JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""
