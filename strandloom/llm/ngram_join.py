"""N-gram Jaccard join: T-occurrence search with DivideSkip, distributed.

A document's set holds its distinct 5-word shingles (64-bit hashes; two sets are compared pair by pair, so a
chance collision would have to occur within one pair). Two documents link at a Jaccard similarity of 0.8 or more.

A T-occurrence search merges the short inverted lists of a query and probes the long ones for what the merge
finds. Across the cluster this is done so:

1. Equal sets become one record (``fingerprints``). Shingles are ordered by how many documents have their
   bucket, counted over all documents in an array of a fixed size; of its n - ceil(0.8 n) + COMMON rarest shingles a
   set of n shares COMMON with any partner. Only these short lists are shuffled.
2. Of each short list the record that shares the largest part of its shingles is the head. A record is compared
   with the head it shares most lists with; links found so make clusters, of which the distance of each record to its root is known.
   A group of thousands of near copies is one cluster after this, at one comparison for each copy.
3. Records in different clusters that share a short list are still to be compared, unless too few elements are
   left from there on. Jaccard distance is a metric,
   so the comparison of two roots settles most pairs of clusters at once; of the others the members of one are
   queries to the members of the other, unless the distances to their roots rule a link out.
4. Comparisons run in blocks: the records to be compared with one query form inverted lists; the short ones are
   heap-merged, the long ones binary-probed (``divide_skip``).

So no link between different clusters is lost, and no pairs within a cluster are enumerated.

Cases: null and empty texts have no shingles and link with nothing; a text of one to four words is one shingle.
Rows without an id take no part (component null). Repeated rows are equal sets. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, LOWER, TEXT, bitmap_for, checkpoint, fresh, id_and_text, in_bitmap, map_batches, staged, texts

WIDTH = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Buckets of the frequency array, in so many slots; bytes whose words are hashed at once; records compared
#: with one query at once, and in one block of a cluster's index.
BUCKET_BITS, SLOTS, PIECE, BLOCK, INDEX = 20, 16, 1 << 17, 64, 256
#: Elements of short lists that linked sets share at least, unless they share fewer.
COMMON = 3
#: Bytes of texts of which a worker holds the sets at once; queries that one task asks of a block; rings of distances
#: from a root; clashes of 64 bits, of which 10 ** 12 different sets have some 30,000.
TEXTS, QUERIES, RINGS, MAX_CLASHES = 16 << 20, 256, 50, 100_000
BASE = 0xD1342543DE82EF95
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ODD = np.random.default_rng(9).integers(0, 1 << 63, 5, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        step = np.array([base], np.uint64)
        while len(out) < PIECE:
            out = np.concatenate([out, out * step])
            step = step * step
    return out[:PIECE]


class WordHashes:
    """Hashes of all words of a text at once: sums of random numbers of the bytes times powers of an odd base.

    A word's sum is the difference of two running sums, moved to the word's start by the base's inverse. Texts are
    taken in pieces that end at white space, so the tables of powers have a fixed length; the sum of a word that is
    longer than a piece is put together from those of its pieces.
    """

    def __init__(self):
        self.letters = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.space = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
        self.up, self.down, self.whole = _powers(BASE), _powers(pow(BASE, -1, 1 << 64)), pow(BASE, PIECE, 1 << 64)

    @staticmethod
    def _finish(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = sums ^ lengths.astype(np.uint64) * _P
        out *= _MIX[0]
        out ^= out >> np.uint64(32)
        return out

    def _piece(self, data: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.space[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=sums[1:])
        return self._finish((sums[ends] - sums[starts]) * self.down[starts], ends - starts)

    def _long(self, word: np.ndarray) -> np.ndarray:
        """The hash of one word of any length."""
        total, shift = 0, 1
        for at in range(0, len(word), PIECE):
            part = word[at : at + PIECE]
            total += int((self.letters[part] * self.up[: len(part)]).sum(dtype=np.uint64)) * shift
            shift = shift * self.whole % (1 << 64)
        return self._finish(np.array([total % (1 << 64)], np.uint64), np.array([len(word)]))

    def __call__(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        if len(data) <= PIECE:
            return self._piece(data)
        out, at = [], 0
        while at < len(data):
            piece = data[at : at + PIECE]
            if at + PIECE < len(data):
                last = np.flatnonzero(self.space[piece])
                if not len(last):
                    rest = np.flatnonzero(self.space[data[at + PIECE :]])
                    piece = data[at : at + PIECE + rest[0]] if len(rest) else data[at:]
                    out.append(self._long(piece))
                    at += len(piece)
                    continue
                piece = piece[: last[-1] + 1]
            out.append(self._piece(piece))
            at += len(piece)
        return np.concatenate(out) if out else np.empty(0, np.uint64)


@cache
def _hashes() -> WordHashes:
    """A worker's tables of powers."""
    return WordHashes()


def shingles(text: bytes, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes (uint64) of a whole text."""
    with np.errstate(over="ignore"):
        h = hashes(text.translate(LOWER))
        n = len(h)
        if not n:
            return h
        k = min(n, width)
        out = h[: n - k + 1] * _ODD[0]
        for i in range(1, k):
            out += h[i : n - k + 1 + i] * _ODD[i]
        out += np.uint64(k)
        out ^= out >> np.uint64(32)
        out *= _MIX[1]
        out ^= out >> np.uint64(29)
    out.sort()
    if len(out) > 1:
        new = np.empty(len(out), bool)
        new[0] = True
        np.not_equal(out[1:], out[:-1], out=new[1:])
        out = out[new]
    return out


def prints_of(found: np.ndarray) -> tuple[int, int]:
    """A set's fingerprint as two signed 64-bit numbers."""
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def key_of(found: np.ndarray, clashes: frozenset[int]) -> int:
    """A set's key: the first half of its fingerprint, or the second where several sets have the first (``Keys``)."""
    first, second = prints_of(found)
    return second if first in clashes else first


def need(a: int, b: int, similarity: float = SIMILARITY / 100) -> int:
    """The smallest intersection that sets of a and b elements need."""
    return max(1, math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9))


def prefix_length(n: int) -> int:
    """Of how many rarest elements of a set both it and a linked partner have ``COMMON`` (or all that they share) among
    theirs."""
    return min(n, n - -(-SIMILARITY * n // 100) + COMMON)


def divide_skip(query: np.ndarray, records: list[np.ndarray], needed: list[int]) -> list[int]:
    """How many elements each record shares with the query; 0 where this is below what the record needs.

    The inverted lists of the query's elements are divided into long and short ones. A record that reaches T
    is on at least T - L of the short lists if L are long, so these are heap-merged with T - L as the bar, and
    the records that pass are looked up in the long lists by binary search.
    """
    out = [0] * len(records)
    if not len(query) or not records:
        return out
    tokens = np.concatenate(records)
    owner = np.repeat(np.arange(len(records)), [len(r) for r in records])
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    shared = query[at] == tokens
    at, owner = at[shared], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    ends = np.flatnonzero(np.diff(at, append=-1)) + 1
    lists = [x.tolist() for x in np.split(owner, ends[:-1])] if len(at) else []
    lists.sort(key=len)
    bar = min(needed)
    if len(lists) < bar:
        return out
    longest = len(lists[-1])
    n_long = min(bar - 1, int(bar / (0.0085 * math.log2(longest + 1) + 1)))
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for record, places in groupby(heapq.merge(*short)):
        count = sum(1 for _ in places)
        if count >= needed[record] - n_long:
            for probed, some in enumerate(long_):
                if count + n_long - probed < needed[record]:
                    break
                i = bisect_left(some, record)
                count += i < len(some) and some[i] == record
            if count >= needed[record]:
                out[record] = count
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, key, key2) of every row, and the frequency class (0 to 255) of every bucket of shingles.

    Counts are made where the documents lie, one array for each partition, and summed in two steps.
    """
    per_slot = (1 << BUCKET_BITS) // SLOTS

    def run(batches):
        hashes, total = WordHashes(), np.zeros(1 << BUCKET_BITS, np.int64)
        part = 0
        for batch in batches:
            sets = [shingles(t, hashes) for t in texts(batch)]
            keys = [prints_of(s) for s in sets]
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
                part = keys[0][0] % 64
                yield _rows(batch.column(0), list(map(len, sets)), keys)
        if total.any():
            yield _slots(total, part)

    def _rows(ids, n, keys):
        none = pa.nulls(len(n), pa.int32())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), none, none, pa.nulls(len(n), pa.binary())], names)

    def _slots(total, part):
        packed = [zlib.compress(x.tobytes(), 1) for x in total.reshape(SLOTS, per_slot)]
        nulls = [pa.nulls(SLOTS, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*nulls, pa.array(range(SLOTS), pa.int32()), pa.array([part] * SLOTS, pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "n", "key", "key2", "slot", "part", "counts"]
    schema = "doc_id long, n int, key long, key2 long, slot int, part int, counts binary"
    both = checkpoint(id_and_text(docs, id_col, text_col).mapInArrow(run, schema))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(zlib.decompress(packed), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["slot", "counts"])

    slots = both.where("slot IS NOT NULL")
    half = slots.repartition("slot", "part").select("slot", "counts").mapInArrow(add, "slot int, counts binary")
    counts = np.zeros((SLOTS, per_slot), np.int64)
    for row in half.repartition("slot").mapInArrow(add, "slot int, counts binary").collect():  # SLOTS rows
        counts[row.slot] += np.frombuffer(zlib.decompress(row.counts), np.int64)
    classes = np.minimum(255, 4 * np.log2(1 + counts.ravel())).astype(np.uint8)
    return both.where("slot IS NULL").select("doc_id", "n", "key", "key2"), classes


def distinct_records(sets: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """One record (doc_id, key, n) for each different set, with a key of 64 bits, and the first halves that clash.

    Sets are told apart by both halves of their fingerprints. Some 2 ** 32 sets have a pair with the same first half;
    these few are found by an aggregation and take the second half as key.
    """
    found = checkpoint(sets.groupBy("n", "key", "key2").agg(F.min("doc_id").alias("doc_id")))
    several = lambda t: t.groupBy("key").count().where("count > 1").select("key")
    clashes = frozenset(r.key for r in several(found).limit(MAX_CLASHES + 1).collect())
    records = found.select("doc_id", F.when(F.col("key").isin(list(clashes)), F.col("key2")).otherwise(F.col("key")).alias("key"), "n")
    if len(clashes) > MAX_CLASHES or clashes and not several(records).isEmpty():
        raise RuntimeError("fingerprints of different sets are equal far more often than 128 random bits are")
    return records, clashes


def _postings(docs: DataFrame, classes: np.ndarray, clashes: frozenset[int], id_col: str, text_col: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(token, key, n, room, share): the short lists; equal sets within a batch are posted once.

    ``room`` is how many elements a set has from the token on, in the order of frequency: if the token is among the
    first COMMON that two sets share, they share no more than the smaller room and COMMON - 1. Of the tokens a bitmap can name the wanted;
    ``share`` is the part of the set that is among these (or seems to be, as the bitmap has it), and sets with too few of
    them for any link are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((classes, clashes, wanted))  # bounded: 2 ** BUCKET_BITS bytes, MAX_CLASHES, a bitmap

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        classes, clashes, wanted = shared.value
        hashes = _hashes()
        seen: set = set()
        tokens, keys, sizes = [], [], []
        for t in texts(batch):
            found = shingles(t, hashes)
            if not len(found) or (key := key_of(found, clashes)) in seen:
                continue
            seen.add(key)
            rank = classes[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
            ranked = (rank << np.uint64(56)) | (found & np.uint64((1 << 56) - 1))
            p = prefix_length(len(found))
            tokens.append(np.sort(np.partition(ranked, p - 1)[:p]))
            keys.append(key)
            sizes.append(len(found))
        if not tokens:
            return None
        lengths = [len(x) for x in tokens]
        columns = [
            np.concatenate(tokens).view(np.int64), np.repeat(np.array(keys, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths),
            np.concatenate([np.arange(n, n - k, -1, dtype=np.int32) for n, k in zip(sizes, lengths, strict=True)]),
        ]
        columns.append(np.ones(len(columns[0]), np.float32))
        if wanted is not None:
            some = in_bitmap(wanted, columns[0])
            owner = np.repeat(np.arange(len(sizes)), lengths)
            named, n = np.bincount(owner, some, len(sizes)), np.array(sizes)
            # a set with fewer of them than a link takes links with nothing
            some &= (named >= np.minimum(COMMON, -(-SIMILARITY * n // 100)))[owner]
            columns = [c[some] for c in [*columns[:4], (named / n).astype(np.float32)[owner]]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["token", "key", "n", "room", "share"])

    rows = id_and_text(docs, id_col, text_col).where(F.col(ID).isNotNull())
    return map_batches(rows, run, "token long, key long, n int, room int, share float", rows=None, size=TEXTS)


def _record_texts(docs: DataFrame, wanted: DataFrame, clashes: frozenset[int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, body) of the wanted doc_ids, and of some others: a bitmap of the ids keeps most texts in place."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap_for(wanted, "doc_id"), clashes))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bits, clashes = shared.value
        chosen = np.flatnonzero(in_bitmap(bits, batch.column(0).to_numpy(zero_copy_only=False)))
        if not len(chosen):
            return None
        some = batch.take(pa.array(chosen))
        keys = [key_of(shingles(t, _hashes()), clashes) for t in texts(some)]
        return pa.RecordBatch.from_arrays([some.column(0), pa.array(keys, pa.int64()), some.column(1).cast(pa.binary())], ["doc_id", "key", "body"])

    return map_batches(id_and_text(docs, id_col, text_col).where(F.col(ID).isNotNull()), run, "doc_id long, key long, body binary", size=TEXTS)


def compare(docs: DataFrame, records: DataFrame, clashes: frozenset[int], pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, n_a, n_b, shared) for pairs of keys (a, b, floor), where the similarity reaches the floor.

    Many b may come for one a: they are compared with it in blocks. Texts are shuffled once, by key and id, and both
    joins read the same exchange.
    """
    side = lambda c: records.select(F.col("key").alias(c), F.col("doc_id").alias(f"doc_{c}"))
    pairs = checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "doc_a", "b", "doc_b", "floor"))
    bodies = _record_texts(docs, pairs.select(F.col("doc_a").alias("doc_id")).union(pairs.select("doc_b")).distinct(), clashes, id_col, text_col)
    body = lambda c: bodies.select(F.col("key").alias(c), F.col("doc_id").alias(f"doc_{c}"), F.col("body").alias(f"body_{c}"))
    joined = pairs.join(body("b"), ["b", "doc_b"]).join(body("a"), ["a", "doc_a"])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = []
            for a, some in groupby(rows, key=lambda r: r[0]):
                query = None
                some = list(some)
                for begin in range(0, len(some), BLOCK):
                    block = some[begin : begin + BLOCK]
                    if query is None:
                        query = shingles(block[0][3], hashes)
                    sets = [shingles(r[4], hashes) for r in block]
                    found = divide_skip(query, sets, [need(len(query), len(s), r[2]) for r, s in zip(block, sets, strict=True)])
                    out += [(a, r[1], len(query), len(s), n) for r, s, n in zip(block, sets, found, strict=True) if n]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["a", "b", "n_a", "n_b", "shared"])

    return joined.select("a", "b", "floor", "body_a", "body_b").mapInArrow(run, "a long, b long, n_a long, n_b long, shared long")


def _linked() -> Column:
    return F.expr(f"100 * shared >= {SIMILARITY} * (n_a + n_b - shared)")


def _reachable(a: Column, b: Column, room: Column) -> Column:
    """Whether sets of a and b elements can link if a token with this ``room`` is among the first COMMON they share."""
    return (room + (COMMON - 1)) * (100 + SIMILARITY) >= SIMILARITY * (a + b)


def _distance() -> Column:
    return F.expr("1.0D - shared / (n_a + n_b - shared)")


def roots(parents: DataFrame) -> DataFrame:
    """(key, root, distance) from (key, parent, distance), a forest, by pointer jumping."""
    done = parents.select("key", F.col("parent").alias("root"), "distance")
    while True:
        up = done.select(F.col("key").alias("root"), F.col("root").alias("next"), F.col("distance").alias("more"))
        jumped = checkpoint(done.join(up, "root", "left").select("key", F.coalesce("next", "root").alias("root"), (F.col("distance") + F.coalesce("more", F.lit(0.0))).alias("distance"), F.col("next").isNotNull().alias("moved")))
        done = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return done


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component as label, from edges (a, b)."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label"))
    while True:
        labels = checkpoint(labels)
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = checkpoint(lower.join(jump, "low").select("node", F.least("low", "jump").alias("label"), "old"))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _search_clusters(docs: DataFrame, records: DataFrame, clashes: frozenset[int], clusters: DataFrame, open_: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): pairs of clusters (a, b, apart) of which any members link.

    The members of the smaller cluster are queries to the larger one. Each is first compared with the larger one's
    root. The members of that are dealt to rings by their distance from it, and a query goes only to rings where the
    triangle inequality leaves a link possible. A ring is an index in blocks, and so are the queries to it, so tasks
    share out both; a record is shipped once for each block that it meets.
    """
    roots_ = open_.select(F.col("a").alias("root")).union(open_.select("b")).distinct()
    members = clusters.join(roots_, "root", "left_semi").select("key", "root", "distance").union(roots_.select(F.col("root").alias("key"), "root", F.lit(0.0)))
    members = checkpoint(members.withColumn("ring", F.least(F.floor(F.col("distance") * RINGS), F.lit(RINGS)).cast("int")))
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.max("distance").alias("radius"))
    side = lambda c: sizes.select(F.col("root").alias(c), F.struct("size", F.col("root").alias("root"), "radius").alias(f"side_{c}"))
    asked = open_.join(side("a"), "a").join(side("b"), "b").select(F.greatest("side_a", "side_b").alias("index"), F.least("side_a", "side_b").alias("query"), "apart")
    asked = asked.select(F.col("index.root").alias("root"), F.col("index.radius").alias("radius"), F.col("query.root").alias("other"), "apart")
    slack = (100 - SIMILARITY) / 100 + 1e-9
    queries = members.select("key", F.col("root").alias("other"), "distance").join(asked, "other").where(F.col("distance") + F.col("radius") + slack >= F.col("apart"))
    queries = checkpoint(queries.select("root", "key", "other", F.greatest(F.lit(0.0), 1 - slack - F.col("radius")).alias("floor")))
    near = compare(docs, records, clashes, queries.select(F.col("root").alias("a"), F.col("key").alias("b"), "floor"), id_col, text_col)
    near = near.select(F.col("a").alias("root"), F.col("b").alias("key"), _distance().alias("off")).distinct()
    # without a floor those that share nothing with the root are left as well
    queries = queries.join(near, ["root", "key"], "left").where("off IS NOT NULL OR floor <= 0").select("root", "key", "other", F.coalesce("off", F.lit(1.0)).alias("off"))
    rings = members.groupBy("root", "ring").agg(F.ceil(F.count("*") / INDEX).cast("int").alias("blocks"))
    within = (F.col("ring") >= RINGS) | ((F.col("ring") + 1) / RINGS + slack >= F.col("off"))
    queries = checkpoint(queries.join(rings, "root").where(within))
    parts = checkpoint(queries.groupBy("root", "ring", "blocks").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("key", F.lit(1)), "parts").cast("int").alias("part")
    block = F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = members.join(parts, ["root", "ring"]).select("root", "ring", block, numbers("parts").alias("part"), F.lit(0).alias("kind"), "key", F.col("root").alias("other"))
    queries = queries.join(parts, ["root", "ring", "blocks"]).select("root", "ring", numbers("blocks").alias("block"), part, F.lit(1).alias("kind"), "key", "other")
    rows = checkpoint(index.union(queries).join(records.select("key", "doc_id"), "key"))
    bodies = _record_texts(docs, rows.select("doc_id").distinct(), clashes, id_col, text_col)
    unit = ["root", "ring", "block", "part"]
    placed = rows.join(bodies, ["key", "doc_id"]).select(*unit, "kind", "other", "body").repartition(*unit).sortWithinPartitions(*unit, "kind")

    def run(batches):
        at, held = None, []
        for batch in batches:
            found = set()
            for *here, kind, other, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != here:
                    at, held = here, []
                own = shingles(body, _hashes())
                if kind == 0:
                    held.append(own)
                    continue
                if (here[0], other) in found:
                    continue
                fit = [s for s in held if 100 * min(len(s), len(own)) >= SIMILARITY * max(len(s), len(own))]
                if any(divide_skip(own, fit, [need(len(own), len(s)) for s in fit])):
                    found.add((here[0], other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long").distinct()


def _lists(docs: DataFrame, classes: np.ndarray, clashes: frozenset[int], id_col: str, text_col: str) -> DataFrame:
    """The short lists of more than one record.

    Which tokens these are is an aggregation, whose partial results shrink a hot list where it lies; the lists
    themselves are then made again with a bitmap of these tokens, and the join that removes what is left of others is
    one that can be split at a hot token.
    """
    ends = _postings(docs, classes, clashes, id_col, text_col).select("token", "key").groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("last"))
    several = staged(ends.where("low <> last").select("token"))
    rows = _postings(docs, classes, clashes, id_col, text_col, bitmap_for(several, "token"))
    return staged(rows.join(several, "token"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    prints, classes = fingerprints(docs, id_col, text_col)
    sets = prints.where("doc_id IS NOT NULL AND n > 0")
    records, clashes = distinct_records(sets)
    lists = _lists(docs, classes, clashes, id_col, text_col)

    # the head of a list is the record with the largest share of its rarest shingles on lists of several records:
    # what others were copied from, rather than a copy with changes of its own
    heads = lists.groupBy("token").agg(F.max(F.struct("share", "key", "n", "room")).alias("head"))
    led = lists.join(heads, "token").where((F.col("key") != F.col("head.key")) & _reachable(F.col("n"), F.col("head.n"), F.least("room", "head.room")))
    led = led.where(F.struct("share", "key") < F.struct("head.share", "head.key"))
    best = led.groupBy("key", F.col("head.key").alias("head")).agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "head")).alias("x"))
    # two lists in common at least; of those that are not tried here links are found below
    tries = best.where("x.c > 1").select(F.col("x.head").alias("a"), F.col("key").alias("b"), F.lit(SIMILARITY / 100).alias("floor"))
    first = checkpoint(compare(docs, records, clashes, checkpoint(tries), id_col, text_col).where(_linked()).select(F.col("b").alias("key"), F.col("a").alias("parent"), _distance().alias("distance")).distinct())
    clusters = roots(first)

    placed = lists.join(clusters, "key", "left").select("token", "key", "n", "room", F.coalesce("root", "key").alias("root"))
    units = placed.groupBy("token", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room"))
    mixed = units.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    units = checkpoint(units.join(mixed, "token").select("token", "root", "low", "high", "room"))
    ratio = SIMILARITY / 100
    # of two that can still link, the smaller one has room for a link with one of its own size: few have on a common token
    a, b = units.where(_reachable(F.col("low"), F.col("low"), F.col("room"))).alias("a"), units.alias("b")
    close = (F.col("a.low") * ratio <= F.col("b.high")) & (F.col("b.low") * ratio <= F.col("a.high")) & _reachable(F.col("a.low"), F.col("b.low"), F.least("a.room", "b.room"))
    smaller = F.struct("a.low", "a.root") < F.struct(F.col("b.low").alias("low"), F.col("b.root").alias("root"))
    met_at = a.join(b, (F.col("a.token") == F.col("b.token")) & smaller & close)
    met_at = met_at.groupBy(F.least("a.root", "b.root").alias("a"), F.greatest("a.root", "b.root").alias("b")).agg(F.count("*").alias("c"), F.min(F.col("a.low") + F.col("b.low")).alias("low"))
    fewest = F.ceil(F.col("low") * SIMILARITY / (100 + SIMILARITY) - 1e-9)
    pairs = met_at.where(F.col("c") >= F.least(F.lit(COMMON), fewest)).select("a", "b")
    radius = clusters.groupBy("root").agg(F.max("distance").alias("radius"))
    reach = lambda c: radius.select(F.col("root").alias(c), F.col("radius").alias(f"radius_{c}"))
    pairs = pairs.join(reach("a"), "a", "left").join(reach("b"), "b", "left").na.fill(0.0, ["radius_a", "radius_b"])
    pairs = checkpoint(pairs.withColumn("floor", F.greatest(F.lit(0.0), ratio - F.col("radius_a") - F.col("radius_b") - 1e-9)))
    met = checkpoint(compare(docs, records, clashes, pairs.select("a", "b", "floor"), id_col, text_col).distinct())
    edges = met.where(_linked()).select("a", "b")

    # Pairs of clusters whose roots do not link but whose members may; a floor of 0 asks for no shared element.
    far = pairs.where("floor <= 0").select("a", "b").join(met.select("a", "b"), ["a", "b"], "left_anti").withColumn("apart", F.lit(1.0))
    open_ = checkpoint(met.where(~_linked()).select("a", "b", _distance().alias("apart")).union(far))
    if not open_.isEmpty():
        edges = edges.union(_search_clusters(docs, records, clashes, clusters, open_, id_col, text_col))

    labels = connected(edges)
    rooted = clusters.select("key", "root").union(clusters.select(F.col("root").alias("key"), "root").distinct())
    place = rooted.join(labels.select(F.col("node").alias("root"), "label"), "root", "left").select("key", F.coalesce("label", "root").alias("label"))
    alone = labels.join(rooted.select("key"), F.col("node") == F.col("key"), "left_anti").select(F.col("node").alias("key"), "label")
    place = place.union(alone)
    second = F.col("key").isin(list(clashes))
    sets = sets.select("doc_id", "n", F.when(second, F.col("key2")).otherwise(F.col("key")).alias("key"), F.when(second, F.col("key")).otherwise(F.col("key2")).alias("key2"))
    named = sets.join(place, "key", "left").select("doc_id", "n", "key", "key2", F.coalesce("label", "key").alias("label"), F.col("label").isNull().alias("single"))
    # records without links are told apart by the whole fingerprint
    group = ["label", F.when(F.col("single"), F.col("key2")).alias("rest"), F.when(F.col("single"), F.col("n")).alias("size")]
    named = checkpoint(named.select("doc_id", "n", *group))
    smallest = checkpoint(named.groupBy("label", "rest", "size").agg(F.min("doc_id").alias("component_id")))
    p, q = named.alias("p"), smallest.alias("q")
    linked = p.join(q, (F.col("p.label") == F.col("q.label")) & F.col("p.rest").eqNullSafe(F.col("q.rest")) & F.col("p.size").eqNullSafe(F.col("q.size"))).select("p.doc_id", F.col("p.n").cast("long").alias("n_shingles"), "component_id")
    rest = prints.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with all their columns; rows without id stay."""
    found = checkpoint(components(docs, id_col, text_col))
    (name,) = fresh(docs, "gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The component of every document."""
    from .common import table

    return components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') || len(w[i : i + least(5, len(w)) - 1]) AS s FROM w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
