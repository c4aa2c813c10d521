import hashlib
import math
import random

import numpy as np
import pytest

from strandloom.llm import codes as c


def brute(rows, entries=256, parts=4, rounds=4):
    """Codes by comparing every part with every entry, in Python's integers."""
    good = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in good]
    if not good:
        return [], None
    n = max(set(lengths), key=lambda k: (lengths.count(k), k))
    good = sorted((r for r in good if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-n // parts)
    whole = [[math.floor(int(x) * 1024 if abs(x) >= 2**53 else x * 1024) for x in v] + [0] * (width * parts - n) for _, v, _ in good]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        at = [[near(x[p], books[p])[1] for x in cut] for p in range(parts)]
        for p in range(parts):
            for j in set(at[p]):
                mine = [x[p] for x, k in zip(cut, at[p], strict=True) if k == j]
                books[p][j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = []
    for (i, _, lab), x in zip(good, cut, strict=True):
        found = [near(x[p], books[p]) for p in range(parts)]
        out.append((i, lab, tuple(j for _, j in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def run(spark, rows, entries=256, kind="float", **more):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], f"vec_id BIGINT, embedding ARRAY<{kind.upper()}>, label INT, code INT, v STRING").repartition(3)
    found, books = c.compress(df, entries, **more)
    out = [(r.vec_id, r.label, tuple(np.frombuffer(bytes(r.code), np.uint16).tolist()), r.error) for r in found.collect()]
    return out, c.digest(books)


def key(r):
    return (r[0] is None, r[0] or 0, str(r[1]), r[2], r[3] or 0)


def vectors(seed, n, length=8, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, length)) * spread
    x = (centers[rng.integers(0, 5, n)] + rng.normal(size=(n, length)) * 0.2).astype(np.float32)
    return [(int(i), [float(v) for v in row], int(i) % 3 if i % 5 else None) for i, row in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize(("entries", "length", "rounds"), [(16, 8, 4), (7, 8, 2), (300, 4, 4), (16, 10, 1)])
def test_equals_brute_force(spark, entries, length, rounds):
    rows = vectors(entries, 200, length)
    found, sha = run(spark, rows, entries, rounds=rounds)
    want, wanted = brute(rows, entries, rounds=rounds)
    assert sorted(found, key=key) == sorted(want, key=key) and sha == wanted


def test_ties_copies_and_odd_rows(spark):
    rows = [(5, [0.0, 0.0, 1.0, 1.0], 1), (1, [0.0] * 4, 1), (1, [0.0] * 4, 1), (2, [1.0, 0.0, 0.0, 1.0], None), (None, [0.5] * 4, None), (3, None, 2), (4, [1.0, None, 0.0, 0.0], 2), (6, [float("nan")] * 4, 2), (7, [float("inf"), 0.0, 0.0, 0.0], 2), (8, [1.0], 2), (9, [], 2)]
    rows += [(20 + i, [float(i % 3), 0.5, -0.0001, -2.0], i % 2) for i in range(12)]
    found, sha = run(spark, rows, 6)
    want, wanted = brute(rows, 6)
    assert sorted(found, key=key) == sorted(want, key=key) and sha == wanted
    assert run(spark, [])[0] == [] and run(spark, [(1, None, 1)])[0] == []


def test_huge_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e30, -1e30, 3e8, 1e-3, 12345.678, 2.0**40]) * rng.random() for _ in range(4)], 0) for i in range(60)]
    found, sha = run(spark, rows, 8, kind="double")
    want, wanted = brute(rows, 8)
    assert sha == wanted and sorted((r[0], r[2]) for r in found) == sorted((r[0], r[2]) for r in want)
    assert all(r[3] is None or r[3] == {w[0]: w[3] for w in want}[r[0]] for r in found)


def test_searches_skip_most_entries():
    """From the entry of the round before, far fewer distances than entries times rows."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 4)) * 1024)
    book = c.Book(x[:256])
    best, least, first = book.nearest(x, np.zeros(4000, np.int64))
    again, same, computed = book.nearest(x, best)
    full = c.squares(x, book.entries)
    assert (best == full.argmin(1)).all() and (again == best).all() and (least == full.min(1)).all() and (same == least).all()
    assert computed < 0.35 * full.size and computed < first


def test_label_errors(spark):
    df = spark.createDataFrame([(1, 1, 5, b"a"), (2, 1, 6, b"a"), (3, None, 7, b"a"), (4, None, 1, b"b"), (5, 0, 2, b"b")], "vec_id BIGINT, label INT, error BIGINT, code BINARY")
    want = {1: 11, 2: 11, 3: 8, 4: 8, 5: 2}
    assert {r.vec_id: r.label_error for r in c.with_label_error(df).collect()} == want
    few, c.FEW = c.FEW, 0
    try:
        assert {r.vec_id: r.label_error for r in c.with_label_error(df).collect()} == want
    finally:
        c.FEW = few


def test_query_has_its_columns(spark, tmp_path):
    rows = vectors(3, 300, 8)
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, sha = brute(rows)
    by: dict = {}
    for r in want:
        by[r[1]] = by.get(r[1], 0) + r[3]
    found = sorted(tuple(r) for r in c.op13_codes(spark, str(tmp_path)).collect())
    assert found == sorted((r[0], "".join(f"{j:02x}" for j in r[2]), r[3], by[r[1]], sha) for r in want)
