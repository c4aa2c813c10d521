import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import ngram_join as j


def sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    found = {i: sets(t) for i, t in rows}
    label = {i: i for i in found}
    ids = sorted(found)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                n = len(found[a] & found[b])
                if n and 100 * n >= 80 * (len(found[a]) + len(found[b]) - n) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(found[i]), label[i]) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def family(seed):
    """Copies with more and more edits, chains, passages that many share, short texts, exact copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [edited(rng, base, k % 6) for k in range(40)]
    chain = base[:]
    for _ in range(12):
        chain[rng.randrange(len(chain))] = f"c{rng.randrange(10**6)}"
        rows.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(15)]
    rows += [" ".join(base), " ".join(base).upper(), "one two", "ONE two", "one two three four five six", "one two three four five six seven"]
    rows += [edited(rng, base[:60], k) for k in range(4)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(make_docs, seed):
    rows = family(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in j.components(make_docs(rows)).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("limits", [{"INDEX": 3, "BLOCK": 2, "QUERIES": 2}, {"INDEX": 1, "QUERIES": 1, "RINGS": 3}])
def test_small_blocks_lose_nothing(make_docs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(j, name, value)
    rows = family(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.components(make_docs(rows)).collect()} == brute(rows)


def bridged(seed):
    """Groups around centers that do not link, with members in between that do, or nearly."""
    rng = random.Random(seed)
    rows = []
    for _ in range(4):
        left = [f"l{rng.randrange(10**6)}" for _ in range(150)]
        right = left[:]
        for at in rng.sample(range(150), 7):
            right[at] = f"r{rng.randrange(10**6)}"
        for center in (left, right):
            rows += [" ".join(center)] + [edited(rng, center, rng.randint(1, 3)) for _ in range(12)]
        mixed = left[:]
        for at in rng.sample([i for i in range(150) if left[i] != right[i]], rng.randint(0, 5)):
            mixed[at] = right[at]
        rows.append(" ".join(mixed))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_whose_roots_do_not_link(make_docs, monkeypatch, seed):
    monkeypatch.setattr(j, "INDEX", 4)
    rows = bridged(seed)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.components(make_docs(rows)).collect()} == brute(rows)


def test_sets_with_equal_halves_of_fingerprints_are_told_apart(spark, make_docs, monkeypatch):
    sets_ = spark.createDataFrame([(1, 5, 7, 1), (2, 5, 7, 2), (3, 5, 7, 2), (4, 6, 9, 3)], "doc_id long, n int, key long, key2 long")
    records, clashes = j.distinct_records(sets_)
    assert clashes == {7} and {(r.doc_id, r.key) for r in records.collect()} == {(1, 1), (2, 2), (4, 9)}
    with pytest.raises(RuntimeError):
        j.distinct_records(spark.createDataFrame([(1, 5, 7, 9), (2, 5, 7, 2), (4, 6, 9, 3)], sets_.schema))

    def all_clash(found):
        rows = found.groupBy("n", "key", "key2").agg({"doc_id": "min"}).toDF("n", "key", "key2", "doc_id")
        return rows.select("doc_id", rows["key2"].alias("key"), "n"), frozenset(r.key for r in rows.collect())

    monkeypatch.setattr(j, "distinct_records", all_clash)
    rows = family(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.components(make_docs(rows)).collect()} == brute(rows)


def test_one_list_for_a_common_passage(make_docs):
    """Hundreds of documents that share most of their shingles and of which few link."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(100))
    rows = list(enumerate(" ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.choice([5, 12, 18, 30]))) + " " + passage for _ in range(150)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.components(make_docs(rows)).collect()} == brute(rows)


def test_divide_skip_matches_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        universe = range(rng.choice([20, 60, 300]))
        query = np.array(sorted(rng.sample(universe, rng.randint(1, len(universe)))), np.uint64)
        records = []
        for _ in range(rng.randint(0, 9)):
            r = set(query.tolist())
            r -= set(rng.sample(sorted(r), rng.randint(0, len(r) // 3)))
            r |= set(rng.sample(universe, rng.randint(0, len(universe) // 5)))
            records.append(np.array(sorted(r), np.uint64))
        needed = [j.need(len(query), len(r)) for r in records]
        want = [n if (n := len(np.intersect1d(query, r))) >= k else 0 for r, k in zip(records, needed, strict=True)]
        assert j.divide_skip(query, records, needed) == want


def test_need_is_exact():
    for a in range(1, 60):
        for b in range(1, 60):
            n = j.need(a, b)
            assert 100 * n >= 80 * (a + b - n) or n == 1
            assert n == 1 or 100 * (n - 1) < 80 * (a + b - n + 1)


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    text = ("Alpha beta\tgamma\n" * 50 + "x" * 300 + " delta").encode()
    whole = j.WordHashes()(text)
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(j, "PIECE", 128)
    assert (j.WordHashes()(text) == whole).all()


@pytest.mark.parametrize("length", [j.PIECE - 1, j.PIECE, j.PIECE + 1, 2 * j.PIECE - 1, 2 * j.PIECE, 2 * j.PIECE + 1])
def test_long_words_are_hashed_alike_wherever_they_stand(length):
    hashes, word = j.WordHashes(), b"a" * length
    texts = [word, word + b" ", b" " + word, word + b" b", b"b " + word, b"c" * 40_000 + b"  " + word + b"\n" + word]
    found = [hashes(t).tolist() for t in texts]
    h = found[0][0]
    assert [f.count(h) for f in found] == [1, 1, 1, 1, 1, 2] and [len(f) for f in found] == [1, 1, 1, 2, 2, 3]
    assert hashes(word + b"a")[0] != h


def test_long_words_link(make_docs):
    rows = [(k, t) for k, t in enumerate(["a" * j.PIECE, "a" * j.PIECE + " ", " " + "a" * j.PIECE, "a" * (j.PIECE + 1)])]
    assert {r.doc_id: r.component_id for r in j.components(make_docs(rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_odd_rows(odd_docs, make_docs):
    found = j.components(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in found}
    assert by[1, 0] == 1 and by[2, 0] == 2 and by[4, 1] == 4 and by[5, 1] == 5
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert j.keep_first(odd_docs).columns == odd_docs.columns
    assert j.components(make_docs([])).count() == 0
    assert j.components(make_docs(["only one text of six words"])).first().component_id == 0
    names = "gone key key2 n token room root doc body a b doc_id_ component_id label rest size single".split()
    clashing = odd_docs.drop("key").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    assert sorted((r.component_id or -1, r.n_shingles) for r in j.components(clashing).collect()) == sorted((r.component_id or -1, r.n_shingles) for r in found)
    kept = j.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.count() == j.keep_first(odd_docs).count() and {r.gone for r in kept.collect()} == {0}
