"""Exact dedup by composable polynomial fingerprints.

A text (A-Z lower-cased, null as empty) has the fingerprint sum(byte[i] * base ** (n - 1 - i)) modulo two
primes. Fingerprints of chunks combine by length-shifted arithmetic: h(ab) = h(a) * base ** len(b) + h(b). Texts of
more than ``HUGE`` bytes are dealt out in parts, so that tasks share out their hashing, and the parts' fingerprints
are combined (``combined``). Rows with equal fingerprints and lengths are then compared part by part with the row
that stays: parts are rows, so no task holds two whole texts; groups in which a comparison fails are split by digest.

Cases: null and empty texts equal each other. Null ids count as smaller than all others. Rows that repeat an
id and its text are one document stored twice: they share one decision and ``drop_copies`` keeps one of them.
An empty table gives an empty result; further columns are ignored, or carried along by ``drop_copies``.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, LOWER, TEXT, bitmap_for, checkpoint, fresh, id_and_text, in_bitmap, map_batches, staged, texts

#: Two primes below 2**31, so that byte * power sums over a chunk stay within 63 bits.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
CHUNK = 1 << 16
#: Bytes of a text that is hashed in parts, and of a part; parts that one task combines.
HUGE, PART, FOLDED = 8 << 20, 1 << 20, 1024


def _powers(base: int, modulus: int) -> np.ndarray:
    """base ** (CHUNK - 1), ..., base, 1, by doubling."""
    out = np.ones(1, np.int64)
    step = base
    while len(out) < CHUNK:
        out = np.concatenate([out * step % modulus, out])
        step = step * step % modulus
    return out


class Polynomial:
    """Fingerprints of byte strings; weak moduli can be given to force collisions in tests."""

    def __init__(self, moduli: tuple[int, int] = MODULI):
        self.moduli = moduli
        self.powers = [_powers(b % m, m) for b, m in zip(BASES, moduli, strict=True)]

    def chunk(self, data: np.ndarray) -> tuple[int, int]:
        """The pair for at most CHUNK bytes."""
        wide = data.astype(np.int64)
        return tuple(int(wide @ p[CHUNK - len(wide) :]) % m for p, m in zip(self.powers, self.moduli, strict=True))

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        """The pair for a concatenation."""
        return tuple((a * pow(base, right_length, m) + b) % m for a, b, base, m in zip(left, right, BASES, self.moduli, strict=True))

    def __call__(self, data: bytes) -> tuple[int, int]:
        whole = np.frombuffer(data, np.uint8)
        out = (0, 0)
        for at in range(0, len(whole), CHUNK):
            part = whole[at : at + CHUNK]
            out = self.combine(out, self.chunk(part), len(part)) if at else self.chunk(part)
        return out


def pack(pair: tuple[int, int]) -> int:
    """Both residues in one non-negative long."""
    return pair[0] << 31 | pair[1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", polynomial: Polynomial | None = None, huge: int = HUGE, part: int = PART) -> DataFrame:
    """doc_id, fp (long), n_bytes, digest (SHA-256 in hex) of each normalised text."""
    poly = polynomial or Polynomial()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            low = t.translate(LOWER)
            digest = hashlib.sha256(low).hexdigest()
            rows.append((i, pack(poly(low)) if len(low) <= huge else None, len(low), digest, None, None))
            if len(low) > huge:
                rows += [(None, None, None, digest, at // part, low[at : at + part]) for at in range(0, len(low), part)]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "fp", "n_bytes", "digest", "part", "body"])

    found = checkpoint(map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long, n_bytes long, digest string, part long, body binary"))
    whole = found.where("part IS NULL").select("doc_id", "fp", "n_bytes", "digest")
    parts = found.where("part IS NOT NULL").select("digest", "part", "body")
    if parts.isEmpty():
        return whole
    late = combined(hashed(parts.repartition("digest", "part").dropDuplicates(["digest", "part"]), poly), poly)
    return whole.join(late.withColumnsRenamed({"fp": "late"}).drop("n_bytes"), "digest", "left").select("doc_id", F.coalesce("fp", "late").alias("fp"), "n_bytes", "digest")


def hashed(parts: DataFrame, poly: Polynomial) -> DataFrame:
    """(digest, part, body) as (digest, part, a, b, n): the pair and length of each part, where it lies."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column(2).to_pylist()
        pairs = [poly(t) for t in bodies]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(map(len, bodies), pa.int64())], ["digest", "part", "a", "b", "n"])

    return map_batches(parts.select("digest", "part", "body"), run, "digest string, part long, a long, b long, n long")


def combined(parts: DataFrame, poly: Polynomial) -> DataFrame:
    """(digest, fp, n_bytes) from the pairs of parts; runs of FOLDED parts are combined first, then their results."""
    schema = "digest string, part long, a long, b long, n long"

    def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for digest, run, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pair, n = reduce(lambda x, y: (poly.combine(x[0], (y["a"], y["b"]), y["n"]), x[1] + y["n"]), sorted(some, key=lambda y: y["part"]), ((0, 0), 0))
            out.append((digest, run, *pair, n))
        kinds = [pa.string()] + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["digest", "part", "a", "b", "n"])

    for width in (FOLDED, 1 << 62):
        runs = parts.groupBy("digest", F.floor(F.col("part") / width).cast("long").alias("run")).agg(F.collect_list(F.struct("part", "a", "b", "n")).alias("some"))
        parts = map_batches(runs, fold, schema)
    return parts.select("digest", (F.shiftleft("a", 31).bitwiseOR(F.col("b"))).alias("fp"), F.col("n").alias("n_bytes"))


def _false_groups(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, poly: Polynomial, part: int) -> DataFrame:
    """fp, n_bytes of the groups that hold a text other than that of the row that stays.

    Only texts of groups of two and more are taken up, in parts: a bitmap of their fingerprints keeps most others in
    place. Both joins read plain exchanges, so a hot group can be split among tasks.
    """
    shared = checkpoint(groups.where("n > 1").select("fp", "n_bytes", "keeper"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_for(shared, "fp"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            low = t.translate(LOWER)
            fp = pack(poly(low))
            if in_bitmap(bits.value, np.array([fp], np.int64))[0]:
                digest = hashlib.sha256(low).hexdigest()
                rows += [(i, fp, len(low), digest, at // part, low[at : at + part]) for at in range(0, max(1, len(low)), part)]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "fp", "n_bytes", "digest", "part", "body"]) if rows else None

    members = staged(map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long, n_bytes long, digest string, part long, body binary"))
    keepers = (
        members.join(shared, ["fp", "n_bytes"])
        .where(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("digest") == F.col("keeper.digest")))
        .groupBy("fp", "n_bytes", "part").agg(F.first("body").alias("kept_body"))
    )
    pairs = members.select("fp", "n_bytes", "part", "body").join(checkpoint(keepers), ["fp", "n_bytes", "part"])
    return pairs.where("body <> kept_body").select("fp", "n_bytes").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", polynomial: Polynomial | None = None, huge: int = HUGE, part: int = PART) -> DataFrame:
    """One row per document: doc_id, fp, n_bytes, digest, keep_id (largest id of its text), group_size, kept."""
    poly = polynomial or Polynomial()
    prints = checkpoint(fingerprints(docs, id_col, text_col, poly, huge, part))
    keeper = F.max(F.struct("doc_id", "digest")).alias("keeper")
    groups = checkpoint(prints.groupBy("fp", "n_bytes").agg(keeper, F.count("*").alias("n")))
    split = checkpoint(_false_groups(docs, groups, id_col, text_col, poly, part))
    if split.isEmpty():
        found = prints.join(groups, ["fp", "n_bytes"])
    else:
        sound = prints.join(groups.join(split, ["fp", "n_bytes"], "left_anti"), ["fp", "n_bytes"])
        mixed = prints.join(split, ["fp", "n_bytes"], "left_semi")
        keys = ["fp", "n_bytes", "digest"]
        found = sound.unionByName(mixed.join(mixed.groupBy(*keys).agg(keeper, F.count("*").alias("n")), keys).select(sound.columns))
    return found.select(
        "doc_id", "fp", "n_bytes", "digest", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    found = checkpoint(exact_groups(docs, id_col, text_col))
    here, same, sha, number = fresh(docs, "here", "same", "sha", "number")
    kept = found.where("kept")
    out = docs.join(kept.select(F.col("doc_id").alias(here)).distinct(), docs[id_col].cast("long").eqNullSafe(F.col(here)), "left_semi")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return out
    # ids that stand for several rows: tell these apart by digest, and keep one of those that are stored twice
    low = F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = out.withColumns({sha: F.sha2(low.cast("binary"), 256), number: F.col(id_col).cast("long")})
    stay = kept.select(F.col("doc_id").alias(here), F.col("digest").alias(same)).distinct()
    out = out.join(stay, F.col(number).eqNullSafe(F.col(here)) & (F.col(sha) == F.col(same)), "left_semi")
    return out.dropDuplicates([number, sha]).select(*docs.columns)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays."""
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
