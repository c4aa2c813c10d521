"""Phrase collocation mining over compressed position bitmaps (SPAM).

In a shard of text of one language every frequent word has a compressed bitmap
of its positions: the blocks of 64 positions that hold any, with their bits. A phrase's bitmap marks where its last
word stands; shifted by one position and ANDed with a word's bitmap it becomes that of the longer phrase, and its
popcount is the phrase's count in the shard. Phrases grow depth-first, with batches of siblings shifted, ANDed and
counted at once; places between pieces are positions of their own, so no phrase crosses them. Popcounts are summed over all shards.

What may be extended is known before: words are counted first, then pairs, triples and quadruples of frequent words
by hash, in shards of a few megabytes of a task's text. Hashes of frequent ones reach the shards as bitmaps of at most 16 MB whatever the
corpus; one that lets too much pass costs a few empty ANDs and rows, never a result, as counts of phrases are sums over their own words.

Shards in which phrases grow are not stretches of text, as every frequent phrase has places in most of these and would be counted in each. The
text is projected on pairs first: of each place where a pair passes, the words as far as longer phrases pass go to the
group of that pair. A phrase grows in its pair's group alone, in one shard or, where the group is large, in a few.

A phrase scores by its worst cut, floor(1000 * f(phrase) * n / (f(left) * f(right))); one that is inside a longer
candidate with ``covered`` per cent of its occurrences goes. (If any longer one covers it, so does one with a single
word more, as that one occurs at least as often and is a candidate too.)

Cases: null texts are empty, null languages ``und``. Repeated rows count each. Tied cuts go to the shortest left part,
tied phrases to byte order. Longer texts than a shard are cut between pieces, or inside a piece with the four words
that follow, of which no phrase starts twice. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, bitmap, in_bitmap, pieces, staged

#: Words of a phrase; occurrences of a candidate; rows kept of a language; per cent of occurrences in a longer one.
LONGEST, LEAST, TOP, COVERED = 5, 100, 2000, 100
#: Words of the longest phrases that are counted by hash first; bits of a bitmap for each of them, up to 2 to the ``WIDEST``.
KNOWN, BITS, WIDEST = 4, 256, 27
#: Words that are tried at once after the phrases of a batch, and blocks that are looked up at once for them.
TRIES, LOOKUPS = 1 << 18, 1 << 19
#: A bitmap with bits in more than this part of all blocks is kept plain.
DENSE = 8
#: Bytes of text in a shard, and of all languages' texts that wait for one.
SHARD, WAITING = 8 << 20, 32 << 20
#: Words of text for which there is a group of pairs; most groups; positions in a shard of one.
GROUP, GROUPS, POSITIONS = 1 << 20, 1 << 12, 1 << 20
#: Shares into which a language's phrases are dealt before they are ranked together; languages that are broadcast.
SHARES, FEW = 64, 100_000
#: Bytes as in LOWER; what ends a piece becomes a newline, a tab becomes a blank.
PIECES = bytes(10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else LOWER[c] for c in range(256))
TURN = np.uint64(31)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text that went through PIECES, with a newline between pieces."""
    return [w for w in text.replace(b"\n", b" \n ").split(b" ") if w]


def stretches(text: bytes, size: int = SHARD) -> Iterator[tuple[bytes, bytes]]:
    """A text that went through PIECES in stretches of about a size, each with the up to four words that follow it in
    a piece that is cut."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(b"\n", at, at + size) + 1
        if end:
            yield text[at:end], b""
        else:
            end = text.rfind(b" ", at, at + size) + 1
            if not end:  # a single word of this size
                ends = [e for e in (text.find(b" ", at + size), text.find(b"\n", at + size)) if e >= 0]
                end = min(ends) + 1 if ends else len(text)
            until, words_ = end, 0
            if text[end - 1 : end] == b" ":
                while until < len(text) and words_ < LONGEST - 1 and text[until] != 10:
                    after = [e for e in (text.find(b" ", until), text.find(b"\n", until)) if e >= 0]
                    stop = min(after) if after else len(text)
                    words_ += stop > until
                    until = stop + (stop < len(text) and text[stop] == 32)
            yield text[at:end], text[end:until]
        at = end
    yield text[at:], b""


def hashes_of(lang: str, words_: list[bytes]) -> np.ndarray:
    start = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(start + w) for w in words_), np.uint64, len(words_))


class Shard:
    """Words of a stretch of text of one language, by numbers; -1 stands between pieces."""

    def __init__(self, lang: str, own: bytes, tail: bytes):
        text = pa.array([(own + tail).replace(b"\n", b" \n ")], pa.large_binary())
        encoded = pc.split_pattern(text, pattern=b" ").flatten().dictionary_encode()
        ids, self.vocabulary = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()
        empty, gap = (pc.index(encoded.dictionary, pa.scalar(w, pa.large_binary())).as_py() for w in (b"", b"\n"))
        ids = ids[ids != empty]
        ids[ids == gap] = -1
        self.lang, self.ids, self.own = lang, ids, len(ids) - len(tokens(tail))
        self.hashes = hashes_of(lang, self.vocabulary)
        self.starts = np.arange(len(ids)) < self.own  # where phrases start

    def keep(self, frequent: np.ndarray) -> None:
        """Words that are not frequent become gaps."""
        known = np.append(in_bitmap(frequent, self.hashes.view(np.int64)), False)  # the last is for -1
        self.ids = np.where(known[self.ids], self.ids, -1)


def shards(batches: Iterable[pa.RecordBatch], size: int = SHARD, waiting: int = WAITING) -> Iterator[Shard]:
    """The shards of a task's batches of (language, text). Texts of a language are gathered until they fill a shard; of too
    many languages those go first that have most."""
    by: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}

    def cut(lang: str) -> Iterator[Shard]:
        del held[lang]
        for own, tail in stretches(b"\n".join(by.pop(lang)).translate(PIECES), size):
            yield Shard(lang, own, tail)

    for batch in batches:
        for piece in pieces(batch, max(1, batch.num_rows), size):
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if lang in by and held[lang] + len(text) >= size:
                    yield from cut(lang)
                by.setdefault(lang, []).append(text)
                held[lang] = held.get(lang, 0) + len(text) + 1
            while sum(held.values()) > waiting:
                yield from cut(max(held, key=held.get))
    for lang in list(by):
        yield from cut(lang)


def chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first words and of the last."""
    x = ((before << TURN) | (before >> (np.uint64(64) - TURN))) * np.uint64(0x9E3779B97F4A7C15) ^ word
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def steps(shard: Shard, bitmaps: list[np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 to n frequent words: where phrases of so many start that pass the bitmaps (of pairs, triples and so on), as do
    their shorter parts, and their hashes."""
    ids, h = shard.ids, np.append(shard.hashes, np.uint64(0))
    at, found = np.flatnonzero(ids >= 0), h[ids[ids >= 0]]
    for k in range(2, n + 1):
        more = at + k - 1 < len(ids)
        at, found = at[more], found[more]
        more = ids[at + k - 1] >= 0
        at, found = at[more], found[more]
        found = chain(found, h[ids[at + k - 1]])
        if k - 2 < len(bitmaps):
            passes = in_bitmap(bitmaps[k - 2], found.view(np.int64))
            at, found = at[passes], found[passes]
        yield at, found
        starts = np.zeros(len(ids) + 1, bool)
        starts[at] = True
        # the last words of the next longer phrase have to pass as well
        keep = starts[at + 1]
        at, found = at[keep], found[keep]


def runs(shard: Shard, bitmaps: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of n frequent words start in a shard that pass the bitmaps, as do their shorter parts, and their hashes."""
    *_, (at, found) = steps(shard, bitmaps, n)
    return at[at < shard.own], found[at < shard.own]


def projected(shard: Shard, bitmaps: list[np.ndarray], longest: int, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each group of pairs in a shard: its number, its words joined by blanks, and the numbers of these words (int32) for each place where
    such a pair starts, as far as longer phrases pass, with -1 behind each."""
    reach = np.zeros(len(shard.ids), np.int64)
    for k, (at, found) in enumerate(steps(shard, bitmaps, longest), 2):
        if k == 2:
            pairs, hashes = at[at < shard.own], found[at < shard.own]
        reach[at] = k
    if not len(pairs):
        return
    order = np.argsort(hashes)
    pairs, size = pairs[order], reach[pairs[order]] + 1
    group = ((hashes[order] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    ends = np.cumsum(size)
    _, at = spread(pairs, size)
    ids = np.append(shard.ids, -1)[at]
    ids[ends - 1] = -1
    names, number = np.array(shard.vocabulary, object), np.empty(len(shard.vocabulary) + 1, np.int32)
    borders = np.flatnonzero(np.diff(group, prepend=-1))
    for i, j in zip(borders, [*borders[1:], len(group)], strict=True):
        own = ids[ends[i] - size[i] : ends[j - 1]]
        used = np.flatnonzero(np.bincount(own + 1, minlength=len(number))[1:])
        number[used], number[-1] = np.arange(len(used)), -1
        yield int(group[i]), b" ".join(names[used].tolist()), number[own].tobytes()


def gathered(lang: str, parts: list[tuple[bytes, bytes]]) -> Shard:
    """A shard of parts of groups of pairs, in which phrases start only where these pairs do."""
    vocabularies = pc.split_pattern(pa.array([names for names, _ in parts], pa.large_binary()), pattern=b" ")
    encoded, of = vocabularies.flatten().dictionary_encode(), vocabularies.offsets.to_pylist()
    number = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = [np.array([-1])]
    for a, b, (_, numbers) in zip(of, of[1:], parts, strict=False):
        ids.append(np.append(number[a:b], -1)[np.frombuffer(numbers, np.int32)])
    shard = object.__new__(Shard)
    shard.lang, shard.ids, shard.vocabulary = lang, np.concatenate(ids), encoded.dictionary.to_pylist()
    shard.own, shard.hashes = len(shard.ids), hashes_of(lang, shard.vocabulary)
    shard.starts = np.append(False, shard.ids[:-1] < 0) & (shard.ids >= 0)
    return shard


def shifted(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps moved on by one position."""
    over = bits >> np.uint64(63) != 0
    if not over.any():
        return keys, bits << np.uint64(1)
    every = np.concatenate([keys, keys[over] + 1])
    moved = np.concatenate([bits << np.uint64(1), np.ones(int(over.sum()), np.uint64)])
    order = np.argsort(every, kind="stable")
    every, moved = every[order], moved[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[starts], np.bitwise_or.reduceat(moved, starts)


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of places: the number of the range, and the place, of every place in them."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + starts[of]


class Bitmaps:
    """Compressed bitmaps of the positions of many things, words or phrases: one sorted array of keys, the number of the
    thing times ``span`` and the block of 64 positions, and the block's bits."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, span: int, n: int):
        self.keys, self.bits, self.span = keys, bits, span
        self.of = np.searchsorted(keys, np.arange(n + 1) * span)
        # those that have a bit in many blocks as plain bitmaps, found by place: at most DENSE times the size of all
        sizes = np.diff(self.of)
        many = np.flatnonzero(sizes * DENSE > span)
        self.row, self.plain = np.full(n, -1), np.zeros((len(many), span), np.uint64)
        self.row[many] = np.arange(len(many))
        of, at = spread(self.of[many], sizes[many])
        self.plain[of, keys[at] % span] = bits[at]

    def bits_at(self, which: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The bits of blocks of some things, 0 where a thing has no such block."""
        out, row = np.zeros(len(which), np.uint64), self.row[which]
        dense = np.flatnonzero(row >= 0)
        out[dense] = self.plain[row[dense], block[dense]]
        rest = np.flatnonzero(row < 0)
        if len(rest) and len(self.keys):
            keys = which[rest] * self.span + block[rest]
            at = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
            out[rest] = np.where(self.keys[at] == keys, self.bits[at], np.uint64(0))
        return out

    @classmethod
    def of_words(cls, ids: np.ndarray, n_words: int) -> Bitmaps:
        span = (len(ids) >> 6) + 2
        at = np.flatnonzero(ids >= 0)
        key = ids[at] * span + (at >> 6)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(at) else at
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), starts) if len(at) else np.empty(0, np.uint64)
        return cls(key[starts], bits, span, n_words)

    def chosen(self, which: np.ndarray, before: int | None = None) -> Bitmaps:
        """The bitmaps of some things, numbered anew; only of positions before one, if it is given."""
        of, at = spread(self.of[which], self.of[which + 1] - self.of[which])
        block, bits = self.keys[at] % self.span, self.bits[at]
        if before is not None:
            inside = block << 6 < before
            of, block, bits = of[inside], block[inside], bits[inside]
            last = block == before >> 6
            bits = np.where(last, bits & ((np.uint64(1) << np.uint64(before & 63)) - np.uint64(1)), bits)
            of, block, bits = of[bits != 0], block[bits != 0], bits[bits != 0]
        return Bitmaps(of * self.span + block, bits, self.span, len(which))


@dataclass
class Batch:
    """Phrases of one length: their words, the hashes of their last word, last two words and so on, their bitmaps."""

    words: np.ndarray
    ends: list[np.ndarray]
    places: Bitmaps

    def some(self, which: np.ndarray) -> Batch:
        return Batch(self.words[which], [e[which] for e in self.ends], self.places.chosen(which))


def extended(batch: Batch, words_: Bitmaps, hashes: np.ndarray, bitmaps: list[np.ndarray], of: np.ndarray, behind: np.ndarray) -> tuple[Batch, np.ndarray]:
    """All phrases of a batch with every word that may follow (``of``, ``behind``: followers by word), and their counts."""
    last, places = batch.words[:, -1], batch.places
    who, at = spread(of[last], of[last + 1] - of[last])
    word = behind[at]
    longer = [hashes[word]]
    for k, end in enumerate(batch.ends):
        longer.append(chain(end[who], longer[0]))
        if k:  # pairs are frequent already
            passes = np.flatnonzero(in_bitmap(bitmaps[k], longer[-1].view(np.int64)))
            who, word, longer = who[passes], word[passes], [x[passes] for x in longer]
    moved = Bitmaps(*shifted(places.keys, places.bits), places.span, len(last))
    # the blocks of the shorter bitmap are looked up in the longer one
    own, other = moved.of[who + 1] - moved.of[who], words_.of[word + 1] - words_.of[word]
    found = []
    for mine, theirs, number, counterpart, picked in ((moved, words_, who, word, own <= other), (words_, moved, word, who, own > other)):
        picked = np.flatnonzero(picked)
        # a word has at most ``span`` blocks, so a slice has at most that many above LOOKUPS; what is found is at most
        # a place for each word of the shard, as siblings share none
        blocks = np.cumsum(np.minimum(own, other)[picked])
        borders = np.searchsorted(blocks, np.arange(0, blocks[-1] if len(blocks) else 0, LOOKUPS), "left")
        for pick in np.split(picked, borders[1:]):
            i, place = spread(mine.of[number[pick]], mine.of[number[pick] + 1] - mine.of[number[pick]])
            block = mine.keys[place] - number[pick][i] * mine.span
            bits = mine.bits[place] & theirs.bits_at(counterpart[pick][i], block)
            some = np.flatnonzero(bits)
            found.append((pick[i[some]] * places.span + block[some], bits[some]))
    keys, bits = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")
    both = Bitmaps(keys[order], bits[order], places.span, len(who))
    counts = np.bincount(both.keys // both.span, np.bitwise_count(both.bits), len(who)).astype(np.int64)
    some = np.flatnonzero(counts)
    words_of = np.column_stack([batch.words[who[some]], word[some]])
    return Batch(words_of, [x[some] for x in longer[: len(bitmaps)]], both.chosen(some)), counts[some]


def mine(shard: Shard, bitmaps: list[np.ndarray], longest: int = LONGEST, tries: int = TRIES) -> Iterator[tuple[list[bytes], int, np.ndarray]]:
    """Phrases of 2 and more words, their number of words and their occurrences in a shard, in batches.

    ``bitmaps`` hold the hashes of pairs, and of triples and longer ones where given, that may be frequent: a word is
    tried after a phrase if it makes such a pair, triple and so on with the last words. Siblings are extended side
    by side, as many as have about ``tries`` words to try; what comes of them goes before the rest.
    """
    n = len(shard.vocabulary)
    # a phrase may end among the words that follow a stretch
    at, _ = next(steps(shard, bitmaps[:1], 2))
    pairs = shard.ids[at] * n + shard.ids[at + 1]

    def followers(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ahead, behind = np.divmod(np.unique(pairs), max(1, n))
        return np.searchsorted(ahead, np.arange(n + 1)), behind

    begin, inner = followers(pairs[shard.starts[at]]), followers(pairs)
    words_, names = Bitmaps.of_words(shard.ids, n), np.array(shard.vocabulary, object)
    first = np.flatnonzero(np.diff(begin[0]))
    starting = Bitmaps.of_words(np.where(shard.starts, shard.ids, -1), n)
    stack = [Batch(first[:, None], [shard.hashes[first]], starting.chosen(first))] if len(first) else []
    while stack:
        batch = stack.pop()
        last, (of, behind) = batch.words[:, -1], begin if batch.words.shape[1] == 1 else inner
        upto = max(1, int(np.searchsorted(np.cumsum(of[last + 1] - of[last]), tries, "right")))
        if upto < len(last):
            stack.append(batch.some(np.arange(upto, len(last))))
            batch = batch.some(np.arange(upto))
        found, counts = extended(batch, words_, shard.hashes, bitmaps, of, behind)
        if len(counts):
            yield list(map(b" ".join, names[found.words].tolist())), found.words.shape[1], counts
            if found.words.shape[1] < longest:
                stack.append(found)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    text = lambda c: docs[c].cast("string")
    return docs.select(F.coalesce(text(lang_col), F.lit("und")).alias("lang"), F.coalesce(text(text_col), F.lit("")).alias("text"))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase (a word), h (its hash) and f of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            ids = shard.ids[: shard.own]
            seen = np.bincount(ids[ids >= 0], minlength=1)
            at = np.flatnonzero(seen)
            columns = [pa.array([shard.lang] * len(at), pa.string()), _strings([shard.vocabulary[i] for i in at]), pa.array(shard.hashes[at].view(np.int64)), pa.array(seen[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "h", "f"])

    rows = _texts(docs, lang_col, text_col).mapInArrow(run, "lang string, phrase string, h long, f long")
    return rows.groupBy("lang", "phrase").agg(F.min("h").alias("h"), F.sum("f").alias("f"))


def _frequent_runs(texts_: DataFrame, words_, bitmaps: list, n: int, least: int) -> np.ndarray:
    """A bitmap of the hashes of phrases of n frequent words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            shard.keep(words_.value)
            found, counts = np.unique(runs(shard, [b.value for b in bitmaps], n)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "f"])

    sums = texts_.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    return _sized(staged(sums.where(F.col("f") >= least).select("h")))


def _sized(hashes: DataFrame) -> np.ndarray:
    return bitmap(hashes, "h", max(16, min(WIDEST, (BITS * hashes.count()).bit_length())))


def phrase_counts(docs: DataFrame, words_: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, size (its words) and f of every phrase of 2 to ``longest`` words that occurs ``least`` times;
    ``words_`` are the frequent words with their hashes."""
    share = docs.sparkSession.sparkContext.broadcast
    texts_ = _texts(docs, lang_col, text_col)
    groups = min(GROUPS, (words_.agg(F.sum("f")).first()[0] or 0) // GROUP + 1)
    words_, bitmaps = share(_sized(words_)), []
    for n in range(2, min(KNOWN, longest) + 1):
        bitmaps.append(share(_frequent_runs(texts_, words_, bitmaps, n, least)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            shard.keep(words_.value)
            if rows := list(projected(shard, [b.value for b in bitmaps], longest, groups)):
                group, names, numbers = zip(*rows, strict=True)
                columns = [pa.array([shard.lang] * len(rows)), pa.array(group, pa.int32()), pa.array(names, pa.binary()), pa.array(numbers, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "group", "names", "numbers"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _by_language(batches):
            for names, size, counts in mine(shard, [b.value for b in bitmaps], longest):
                columns = [pa.array([shard.lang] * len(names), pa.string()), _strings(names), pa.array([size] * len(names), pa.int32()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "f"])

    places = texts_.mapInArrow(project, "lang string, group int, names binary, numbers binary")
    # any dealing gives the same sums; by groups, a phrase is in few shards
    places = places.repartition(max(groups, docs.sparkSession.sparkContext.defaultParallelism), "lang", "group").sortWithinPartitions("lang", "group")
    rows = places.mapInArrow(grow, "lang string, phrase string, size int, f long")
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _by_language(batches: Iterable[pa.RecordBatch], size: int = POSITIONS) -> Iterator[Shard]:
    """The shards of a task's rows of ``project``, sorted by language and group."""
    lang, parts, held = None, [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            its, _, names, numbers = (column[at].as_py() for column in batch.columns)
            if parts and (its != lang or held + len(numbers) // 4 > size):
                yield gathered(lang, parts)
                parts, held = [], 0
            lang, held = its, held + len(numbers) // 4
            parts.append((names, numbers))
    if parts:
        yield gathered(lang, parts)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    every = staged(word_counts(docs, lang_col, text_col))
    sizes = staged(every.groupBy("lang").agg(F.sum("f").alias("n")))
    words_ = every.where(F.col("f") >= least)
    phrases = staged(phrase_counts(docs, words_, least, longest, lang_col, text_col))
    counts = words_.select("lang", "phrase", "f").union(phrases.select("lang", "phrase", "f"))

    parts = F.split("phrase", " ")
    text = lambda a, n: F.array_join(F.slice(F.col("words"), a, n), " ")
    cut = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), parts.alias("words")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    one = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    two = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    of_lang = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    cut = cut.join(one, ["lang", "left"]).join(two, ["lang", "right"]).join(of_lang, "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.select("lang", "phrase", "a", "k", "l", "r", "n", (whole("a") * whole("n") * F.lit(1000).cast("decimal(4,0)")).alias("over"), (whole("l") * whole("r")).alias("under"))
    worst = cut.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")

    longer = phrases.where("size > 2").select("lang", "f", "size", parts.alias("words"))
    inside = longer.select("lang", "f", F.explode(F.array(text(F.lit(1), F.col("size") - 1), text(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that at most SHARES * top rows of a language meet
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of documents."""
    from .common import table

    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s, (SELECT unnest(range(1, 6)) AS k) ks WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 100),
x AS (SELECT lang, phrase, k, f, unnest(range(1, k)) AS cut, ws FROM c),
y AS (SELECT lang, phrase, k, f, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:k], ' ') AS rp FROM x),
z AS (SELECT y.lang, y.phrase, y.k, y.f AS a, a.f AS l, b.f AS r, n.n, CAST((1000::HUGEINT * y.f * n.n) // (a.f::HUGEINT * b.f) AS BIGINT) AS score, cut
  FROM y JOIN g a ON a.lang = y.lang AND a.phrase = lp AND a.k = cut JOIN g b ON b.lang = y.lang AND b.phrase = rp AND b.k = y.k - cut JOIN n ON n.lang = y.lang),
m AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = m.lang AND c.k > m.k AND c.f >= m.a AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' '))),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000
"""
