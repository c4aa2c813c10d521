import random

from pyspark.sql import functions as F

from strandloom.llm import exact_dedup as x

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return {(i, (t or "").translate(LOWER)): (max(g for g in groups[(t or "").translate(LOWER)]), len(groups[(t or "").translate(LOWER)])) for i, t in rows}


def rows_of(found):
    return {r.doc_id: (r.keep_id, r.group_size) for r in found.collect()}


def test_groups_match_brute_force(make_docs):
    random.seed(1)
    rows = [(i, "".join(random.choice("aAbB É") for _ in range(random.randint(0, 4)))) for i in range(120)] + [(200, None)]
    want = {i: v for (i, _), v in brute(rows).items()}
    assert rows_of(x.exact_groups(make_docs(rows))) == want


def test_collisions_are_split_by_comparison(make_docs):
    rows = [(i, t) for i, t in enumerate(["ab", "ba", "ab", "AB", "bb", "xy", "ba"])]
    weak = x.Polynomial((1, 1))  # every fingerprint is 0
    assert rows_of(x.exact_groups(make_docs(rows), polynomial=weak)) == {i: v for (i, _), v in brute(rows).items()}


def test_fingerprints_compose():
    poly, data = x.Polynomial(), bytes(random.Random(2).randbytes(200_000))
    cut = 77_777
    assert poly.combine(poly(data[:cut]), poly(data[cut:]), len(data) - cut) == poly(data)
    value = 0
    for b in data[:500]:
        value = (value * x.BASES[0] + b) % x.MODULI[0]
    assert poly(data[:500])[0] == value


def test_huge_texts_are_hashed_and_compared_in_parts(make_docs, monkeypatch):
    """Parts of any length give the fingerprints of whole texts, and the same groups."""
    monkeypatch.setattr(x, "FOLDED", 2)
    long = "Some Text É " * 2_000
    rows = [(1, long), (2, long.upper().replace("É", "é")), (3, long[:-1] + "!"), (4, long), (4, long), (5, "short"), (6, ""), (7, None), (8, long.lower())]
    whole = {(r.doc_id, r.digest, r.fp, r.n_bytes) for r in x.fingerprints(make_docs(rows)).collect()}
    groups = sorted(map(tuple, x.exact_groups(make_docs(rows)).collect()))
    for part in (1000, 4096, 30_000):
        assert {(r.doc_id, r.digest, r.fp, r.n_bytes) for r in x.fingerprints(make_docs(rows), huge=100, part=part).collect()} == whole
        assert sorted(map(tuple, x.exact_groups(make_docs(rows), huge=100, part=part).collect())) == groups


def test_collisions_of_huge_texts_are_split(make_docs):
    rows = [(i, t * 300) for i, t in enumerate(["ab", "ba", "ab", "AB", "bb", "xy", "ba"])]
    weak = x.Polynomial((1, 1))
    assert rows_of(x.exact_groups(make_docs(rows), polynomial=weak, huge=10, part=64)) == {i: v for (i, _), v in brute(rows).items()}


def test_odd_rows(odd_docs):
    found = x.exact_groups(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r.doc_id: r.keep_id for r in found if r.n_bytes == 0} == {1: 2, 2: 2}
    kept = x.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    left = sorted((r.doc_id or 0, (r.text or "")[:10]) for r in kept.collect())
    assert len(left) == len(set(left)) == 8 and (1, "") not in left


def test_clashing_names(odd_docs, make_docs):
    names = "here same sha number stay gone digest fp n_bytes part body kept keeper n __stay __gone __digest __sha __n __id __text".split()
    clashing = odd_docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    want = sorted(map(str, x.drop_copies(odd_docs).select("doc_id", "text").collect()))
    for docs in (clashing, clashing.where("doc_id IN (1, 2, 3, 5)")):  # with ids of several rows and without
        left = x.drop_copies(docs)
        assert left.columns == clashing.columns and {tuple(r[c] for c in names) for r in left.collect()} == {tuple(range(len(names)))}
    assert sorted(map(str, x.drop_copies(clashing).select("doc_id", "text").collect())) == want


def test_empty_table(make_docs):
    assert x.exact_groups(make_docs([])).count() == 0
    assert x.drop_copies(make_docs([])).count() == 0
