import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import collocations as c


def brute(rows, least, longest=5, top=2000, covered=100):
    out = []
    counts = {}
    for lang, text in rows:
        mine = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            mine.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        good = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in good.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and covered * a <= 100 * b and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def sentences(seed, n, words="a b c dd é".split()):
    rng = random.Random(seed)
    return ["".join(rng.choice([*words, "A", "\t", ".", "\n", "!", " "]) + rng.choice([" ", " ", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id BIGINT, text STRING, lang STRING, phrase INT, f STRING")


@pytest.mark.parametrize(("least", "covered"), [(3, 100), (12, 100), (2, 60)])
def test_equals_brute_force(spark, least, covered):
    rows = [(random.Random(i).choice(["en", "fr", None]), t) for i, t in enumerate(sentences(least, 80))]
    found = sorted(tuple(r) for r in c.collocations(table(spark, rows).repartition(5), least=least, covered=covered).collect())
    assert found and found == brute(rows, least, covered=covered)


def test_cover_below_all_occurrences(spark):
    rows = [("en", "x y z. " * 7 + "x y. " * 3 + "p q r. " * 5 + "p q. " * 5)]
    found = {r.phrase for r in c.collocations(table(spark, rows), least=3, covered=60).collect()}
    assert "x y" not in found and "x y z" in found and "p q" in found


def test_top_ties_and_odd_rows(spark):
    rows = [("en", "a b. c d. " * 5), (None, None), ("fr", ""), (None, "u v " * 4), ("en", "a b. c d. " * 5)]
    found = [tuple(r) for r in c.collocations(table(spark, rows), least=3, top=2).collect()]
    assert sorted(found) == brute(rows, 3, top=2)
    assert c.collocations(table(spark, []), least=1).count() == 0


def test_a_hot_phrase_and_a_long_text(spark):
    rows = [("en", "of the " * 20_000)] + [("en", "of the of. ")] * 3000
    found = [tuple(r) for r in c.collocations(table(spark, rows), least=100).collect()]
    assert sorted(found) == brute(rows, 100)


def counted(text, size, tries=50):
    """Phrases of all stretches of a text."""
    total = Counter()
    full = np.full(1 << 10, ~np.uint64(0))
    for own, tail in c.stretches(text.translate(c.PIECES), size):
        shard = c.Shard("en", own, tail)
        for phrases, k, counts in c.mine(shard, [full, full], tries=tries):
            assert all(len(p.split(b" ")) == k for p in phrases)
            for phrase, n in zip(phrases, counts.tolist(), strict=True):
                total[phrase] += n
    return total


@pytest.mark.parametrize("size", [1, 2, 7, 20, 64, 1 << 20])
def test_stretches_lose_and_repeat_nothing(size):
    for seed in range(12):
        text = " ".join(sentences(seed, 4)).encode() if seed % 2 else ("w" * 50 + " a b c a b  c" * 9).encode()
        want = Counter()
        for piece in text.translate(c.PIECES).split(b"\n"):
            w = [x for x in piece.split(b" ") if x]
            want.update(b" ".join(w[i : i + k]) for k in range(2, 6) for i in range(len(w) - k + 1))
        assert counted(text, size) == want


@pytest.mark.parametrize("lookups", [1, 2, 5, 1 << 19])
def test_slices_of_lookups(monkeypatch, lookups):
    text = " ".join(sentences(9, 40)).encode()
    want = counted(text, 1 << 20)
    monkeypatch.setattr(c, "LOOKUPS", lookups)
    assert counted(text, 1 << 20) == want and want


def test_bitmaps():
    rng = np.random.default_rng(1)
    ids = rng.integers(-1, 4, 3000)
    maps = c.Bitmaps.of_words(ids, 4)

    def at(m, w):
        a, b = m.of[w], m.of[w + 1]
        return [int(k % m.span) * 64 + i for k, x in zip(m.keys[a:b], m.bits[a:b], strict=True) for i in range(64) if int(x) >> i & 1]

    moved = c.Bitmaps(*c.shifted(maps.keys, maps.bits), maps.span, 4)
    cut = maps.chosen(np.array([2, 0]), 1000)
    for w in range(4):
        assert at(maps, w) == np.flatnonzero(ids == w).tolist()
        assert at(moved, w) == (np.flatnonzero(ids == w) + 1).tolist()
    assert at(cut, 0) == np.flatnonzero(ids[:1000] == 2).tolist() and at(cut, 1) == np.flatnonzero(ids[:1000] == 0).tolist()
    for m in (maps, c.Bitmaps.of_words(np.where(rng.random(3000) < 0.01, ids, -1), 4)):
        assert (m.bits_at(m.keys // m.span, m.keys % m.span) == m.bits).all() and (m is maps) == (m.row >= 0).all()


def test_prunes_only_what_cannot_be_frequent(spark):
    """A bitmap that lets everything pass gives the same counts."""
    rows = [("en", t) for t in sentences(5, 60)]
    df = table(spark, rows)
    words = c.word_counts(df).where("f >= 4")
    found = {r.phrase: r.f for r in c.phrase_counts(df, words, 4).collect()}
    assert found == {p.decode(): n for p, n in sum((counted(t.encode(), 1 << 20) for _, t in rows), Counter()).items() if n >= 4}


@pytest.mark.parametrize(("size", "groups", "positions"), [(7, 1, 1 << 20), (50, 3, 1 << 20), (400, 9, 60)])
def test_phrases_grow_in_their_pairs_groups(size, groups, positions):
    """A phrase that has places in every stretch is counted in one shard, or in a few of a large group."""
    text = " ".join(sentences(3, 40)).encode()
    full = np.full(1 << 10, ~np.uint64(0))
    rows = []
    for own, tail in c.stretches(text.translate(c.PIECES), size):
        shard = c.Shard("en", own, tail)
        rows += [("en", group, names, numbers) for group, names, numbers in c.projected(shard, [full, full], 5, groups)]
    rows.sort(key=lambda r: r[1])
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 5], strict=True)], ["lang", "group", "names", "numbers"]) for i in range(0, len(rows), 5)]
    total, times = Counter(), Counter()
    for shard in c._by_language(batches, positions):
        for phrases, _, counts in c.mine(shard, [full, full], tries=50):
            times.update(phrases)
            total.update(dict(zip(phrases, counts.tolist(), strict=True)))
    assert total == counted(text, 1 << 20) and total
    assert positions == 60 or set(times.values()) == {1}


def test_texts_of_a_language_share_shards():
    rows = [("en", "a b"), ("fr", "c d"), ("en", "e f"), ("de", "g"), ("fr", "h")]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 2], strict=True)], ["lang", "text"]) for i in range(0, 5, 2)]
    found = lambda **how: sorted((s.lang, sorted(set(s.vocabulary) - {b"\n"})) for s in c.shards(batches, **how))
    assert found() == [("de", [b"g"]), ("en", [b"a", b"b", b"e", b"f"]), ("fr", [b"c", b"d", b"h"])]
    every = sum((words for _, words in found(size=5, waiting=6)), [])
    assert sorted(every) == [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"]
