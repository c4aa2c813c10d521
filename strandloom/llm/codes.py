"""Vector code compression: product codes from integer k-means with Exponion searches.

Components become integers, floor(1024 * x); a vector is cut into equal consecutive parts, each with a codebook of its
own that starts as that part of the first kept vectors. A round assigns every part to the nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by the floored mean of its parts.

Exponion search: each entry has a list of all entries sorted by their distance from it. A part starts at its entry
of the round before, at distance u. By the triangle inequality no entry farther than 2u from that one can be
nearer than it, nor tie with it, so the scan of the list ends there; it goes in steps of doubling length, and
after each only parts whose bound (2u as it was, or what their best distance so far leaves of it) reaches further go on. Distances
are exact integers: doubles where all products fit 53 bits, Python's integers beyond.

Rounds pass over rows staged in the shared folder with their codes; what reaches the driver in a round are sums of
``parts`` times ``entries`` groups, in limbs of 30 bits, so they are exact for any components and rows.

Cases: null vectors and such with null or non-finite components are dropped, and so are vectors of another length than
the most frequent one (the longest of tied ones). A length that the parts do not divide is filled up with zeros.
With fewer kept rows than entries the codebook has that many. Repeated ids and rows count each; equal ids start
codebooks in the order of their components, null ids come last. Unused entries stay as they are. An empty table gives no rows.
Errors beyond 18 digits are null. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a limb of a sum; components of so many bits have exact products in doubles; labels that are broadcast; salt of labels beyond.
LIMB, EXACT, FEW, SALT = 30, 21, 100_000, 32


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as doubles where that is exact and as Python's integers where it may not be."""
    scaled = np.floor(values.astype(np.float64) * scale)  # a power of two: exact unless it overflows
    if np.isfinite(scaled).all() and (not scaled.size or np.abs(scaled).max() < 2.0**EXACT):
        return scaled
    return np.array([int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()], object).reshape(values.shape)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    if x.dtype == object or entries.dtype == object:
        x, entries = x.astype(object), entries.astype(object)
        return np.array([[sum((a - b) ** 2 for a, b in zip(r, e, strict=True)) for e in entries.tolist()] for r in exact(x)], object).reshape(len(x), len(entries))
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)


def exact(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in row] for row in x.tolist()]


class Book:
    """A codebook with the neighbours of each entry, sorted by distance and index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.between = squares(entries, entries)
        self.near = np.array([sorted(range(len(entries)), key=lambda j, row=row: (row[j], j)) for row in self.between], np.int64).reshape(len(entries), len(entries))
        self.reach = np.take_along_axis(self.between, self.near, 1)

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row the nearest entry and its squared distance, from the entry before; and the distances computed."""
        wide = x.dtype == object or self.entries.dtype == object
        best, least, computed = before.copy(), np.zeros(len(x), object if wide else np.float64), 0
        order = np.argsort(before, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(before[order])) + 1):
            if not len(rows):
                continue
            start = int(before[rows[0]])
            least[rows] = squares(x[rows], self.entries[start : start + 1])[:, 0]
            computed += len(rows)
            # entries at most 2u from the start, u being the distance there: squared, 4 u^2
            bound = 4 * least[rows]
            upto = np.searchsorted(self.reach[start], bound, "right")
            at, step = 0, 4
            while len(rows):
                going = upto > at
                rows, upto, bound = rows[going], upto[going], bound[going]
                if not len(rows):
                    break
                some = self.near[start, at : at + step]
                found = squares(x[rows], self.entries[some])
                computed += found.size
                here = found.min(1)
                # of equal distances the lowest index
                entry = np.where(found == here[:, None], some, len(self.entries)).min(1).astype(np.int64)
                better = (here < least[rows]) | ((here == least[rows]) & (entry < best[rows]))
                best[rows], least[rows] = np.where(better, entry, best[rows]), np.where(better, here, least[rows])
                at, step = at + step, step * 2
                # an entry at distance d from the start is at least d - u from the row: useful while d <= u + best
                if not wide:
                    closer = np.searchsorted(self.reach[start], (np.sqrt(bound) / 2 + np.sqrt(least[rows])) ** 2 * (1 + 1e-9) + 1, "right")
                    upto = np.minimum(upto, closer)
        return best, least, computed


def rows_of(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The vectors of a batch, whose column ``v`` holds lists of n numbers."""
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)


def cut(x: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """Equal consecutive parts of vectors, which are filled up with zeros."""
    width = -(-x.shape[1] // parts)
    if x.shape[1] < width * parts:
        x = np.concatenate([x, np.zeros((len(x), width * parts - x.shape[1]), x.dtype)], 1)
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def limbs(value: int, n: int) -> list[int]:
    """A whole number in n limbs, the highest with its sign."""
    return [(value >> (LIMB * i)) & ((1 << LIMB) - 1) if i < n - 1 else value >> (LIMB * i) for i in range(n)]


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """vec_id, label and v (doubles) of the rows that count, and their length."""
    v = vectors[vector_col].cast("array<double>")
    label = vectors[label_col] if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    n = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return (rows.where(F.size("v") == n[0].n), n[0].n) if n else (rows, 0)


def books_of(rows: DataFrame, n: int, entries: int = ENTRIES, parts: int = PARTS) -> list[Book]:
    """Codebooks of the first rows by id."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    return [Book(x) for x in cut(integers(np.array([r.v for r in first], np.float64).reshape(len(first), n)), parts)]


def assigned(rows: DataFrame, books: list[Book], n: int, keys: list[str]) -> DataFrame:
    """The rows with ``code`` (an entry for each part) and ``error``, searched from the code that they have, if any."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # parts * entries vectors and their distances
    types = dict(rows.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("code")
        before = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.int64) if at >= 0 else np.zeros((batch.num_rows, len(shared.value)), np.int64)
        found = [book.nearest(x, before[:, p]) for p, (book, x) in enumerate(zip(shared.value, cut(integers(rows_of(batch, n)), len(shared.value)), strict=True))]
        codes = np.stack([f[0] for f in found], 1).astype(np.uint16)
        errors = [int(e) for e in sum(f[1].astype(object) for f in found)]
        columns = [batch.column(batch.schema.get_field_index(k)) for k in (*keys, "v")]
        columns += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([e if e < 10**18 else None for e in errors], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*keys, "v", "code", "error"])

    return map_batches(rows, run, ", ".join(f"{k} {types[k]}" for k in (*keys, "v")) + ", code binary, error long")


def moved(rows: DataFrame, books: list[Book], n: int) -> list[Book]:
    """Codebooks whose entries are the floored means of what is assigned to them."""
    parts, width = len(books), books[0].entries.shape[1]
    most = max((abs(int(x)) for r in rows.agg(F.min(F.array_min("v")).alias("a"), F.max(F.array_max("v")).alias("b")).collect() for x in (r.a or 0, r.b or 0)), default=0) * SCALE + SCALE
    n_limbs = -(-(most.bit_length() + 1) // LIMB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("code")).to_pylist()), np.uint16).reshape(batch.num_rows, parts)
            for p, x in enumerate(cut(integers(rows_of(batch, n)), parts)):
                for entry in np.unique(codes[:, p]).tolist():
                    mine = x[codes[:, p] == entry]
                    total = sums.setdefault((p, entry), [0, [0] * width])
                    total[0] += len(mine)
                    # a batch's sums of exact doubles are exact as well
                    total[1] = [a + int(b) for a, b in zip(total[1], mine.sum(0).tolist(), strict=True)]
        if sums:
            keys = sorted(sums)
            spread = [[piece for value in sums[k][1] for piece in limbs(value, n_limbs)] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array(spread, pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    partial = rows.select("v", "code").mapInArrow(run, "part int, entry int, n long, s array<long>")
    totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width * n_limbs)]).collect()
    out = [exact(b.entries) for b in books]
    for r in totals:
        out[r.part][r.entry] = [sum(r[f"s{d * n_limbs + i}"] << (LIMB * i) for i in range(n_limbs)) // r.n for d in range(width)]
    return [Book(_numbers(entries, width)) for entries in out]


def _numbers(entries: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(v) < 2**EXACT for e in entries for v in e)
    return np.array(entries, np.float64 if small else object).reshape(len(entries), width)


def digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in exact(b.entries) for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[Book]]:
    """vec_id, label, v, code (two bytes a part) and error of every kept row, and the codebooks."""
    rows, n = kept(vectors, id_col, vector_col, label_col)
    books = books_of(rows, n, entries, parts)
    for _ in range(rounds):
        if not len(books[0].entries):
            break
        rows = staged(assigned(rows, books, n, ["vec_id", "label"]))
        books = moved(rows, books, n)
    return assigned(rows, books, n, ["vec_id", "label"]), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """The rows with the sum of errors over their label, nulls together."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    at = F.col("label").isNotNull().cast("int")  # a null label joins as one
    none = F.when(F.col("label").isNull(), 0).otherwise(F.col("label"))
    if sums.count() <= FEW:
        right = F.broadcast(sums.select(none.alias("l"), at.alias("known"), "label_error"))
        return rows.withColumn("l", none).withColumn("known", at).join(right, ["l", "known"], "left").drop("l", "known")
    right = sums.select(none.alias("l"), at.alias("known"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), "label_error")
    return rows.withColumns({"l": none, "known": at, "salt": F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int")}).join(right, ["l", "known", "salt"], "left").drop("l", "known", "salt")


def op13_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    from .common import table

    rows, books = compress(table(spark, sf_dir, "embeddings"))
    text = F.lower(F.hex("code"))  # two bytes a part, low one first
    code = F.concat(*[F.substring(text, 4 * p + 1, 2) for p in range(PARTS)])
    return with_label_error(staged(rows.drop("v"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same over vectors whose length the parts divide."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT rid, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT s.rid, s.p, b.e, CAST(list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM s JOIN b{k} b ON b.p = s.p) GROUP BY rid, p)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT a.p, a.e, i, CAST(floor(sum(s.v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM a{k} a JOIN s ON s.rid = a.rid AND s.p = a.p, unnest(range(1, len(s.v) + 1)) AS u(i) GROUP BY a.p, a.e, i)""")
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM m{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    last = ROUNDS
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT rid, p, list_transform(v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})], lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM k, (SELECT unnest(range({PARTS})) AS p) q),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM s WHERE rid <= {ENTRIES}),
{", ".join(x for x in steps)},
r AS (SELECT k.rid, vec_id, label, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM a{last} a JOIN k ON k.rid = a.rid GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h
"""


OP13_SQL = _sql()
