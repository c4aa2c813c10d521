import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import repeats as r


def brute(rows):
    """Kept bytes of each different (id, text); null ids first, texts of one id in the order of their digests."""
    keys = {(-(1 << 63) if i is None else i, t or "") for i, t in rows}
    several = {i for i, _ in keys if sum(j == i for j, _ in keys) > 1}
    mark = lambda t: tuple(np.frombuffer(xxhash.xxh3_128_digest(t.encode()), np.int64))
    seen, out = set(), {}
    for i, t in sorted(keys, key=lambda x: (x[0], mark(x[1]) if x[0] in several else ())):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - r.LEAST + 1):
            s = b[p : p + r.LEAST]
            if s in seen:
                hit[p : p + r.LEAST] = True
            seen.add(s)
        out[None if i == -(1 << 63) else i, len(b), bytes(np.frombuffer(b, np.uint8)[~hit])] = 1
    return sorted(out, key=str)


def kept(df, **limits):
    return sorted({(x.doc_id, x.n_bytes, bytes(x.kept)) for x in r.remove_repeats(df, **limits).collect()}, key=str)


def texts(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    line, passage = prose(130), prose(260)
    rows = [prose(rng.randint(0, 500)) for _ in range(10)]
    rows += [prose(150) + passage + prose(rng.randint(0, 90)) for _ in range(6)] + [passage[30:200], passage[:99], passage[:100]]
    rows += [line + prose(20) + line + line, "ab" * 400, "x" * 350, "x" * 99, "xyz " * 100, rows[0], rows[0], None, ""]
    rows += [rows[11][:200] + "CHANGED" + rows[11][200:]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limits", [{}, {"split": 1}, {"split": 1, "hot": 1}])
def test_kept_bytes_match_brute_force(make_docs, seed, limits):
    rows = texts(seed)
    assert kept(make_docs(rows), **limits) == brute(rows)


def test_null_and_repeated_ids(make_docs):
    """Thousands of rows without an id, ids of several rows: none takes another one's repeats for its own."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = [(None, prose(130)) for _ in range(2000)]
    for k in range(8):
        own = prose(150)
        rows += [(None, own + prose(100) + own), (k % 3, prose(90) + own[:110]), (k % 3, prose(400))]
    rows += rows[:3] + rows[-3:]
    assert kept(make_docs(rows)) == brute(rows)


def test_texts_under_one_id_are_told_apart_by_whole_digests(make_docs):
    """Many texts of one id, of which each second one repeats a passage of its own."""
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for k in range(600):
        own = prose(120)
        rows.append((7, own + prose(40) + own if k % 2 else own + prose(160)))
    assert kept(make_docs(rows)) == brute(rows)


def test_colliding_anchors_and_digests_of_grams(make_docs, monkeypatch):
    """Equal hashes of different grams only share a suffix array; strings are compared byte by byte there."""
    monkeypatch.setattr(r, "gram_hashes", lambda data: np.zeros(len(data) - r.GRAM + 1, np.uint64) + np.uint64(3))
    rows = texts(4)[:14]
    bodies = [(t or "").encode() for _, t in rows]
    n = [max(0, len(b) - r.LEAST + 1) for b in bodies]
    contexts = [(i, s) for i, b in enumerate(bodies) if n[i] for s in range(0, len(b) - r.LEAST + 1, 20)]
    owner, inside, factor = r.earlier([bodies[i][s : s + r.WIDEST] for i, s in contexts], np.array([i for i, _ in contexts]), np.array([s for _, s in contexts]))
    found = {(contexts[o][0], contexts[o][1] + int(i)) for o, i in zip(owner, inside, strict=True)}
    seen, want = set(), set()
    for i, b in enumerate(bodies):
        for p in range(n[i]):
            if b[p : p + r.LEAST] in seen:
                want.add((i, p))
            seen.add(b[p : p + r.LEAST])
    assert found == want and (factor >= r.LEAST).all()


def test_previous_and_next_smaller_places():
    rng = random.Random(10)
    for n in (0, 1, 2, 50, 300):
        places = rng.sample(range(n), n)
        common = [0] + [rng.randint(0, 9) for _ in range(n - 1)] if n else []
        previous, following, longest = r.previous_factors(places, common)
        for i in range(n):
            p = next((j for j in range(i - 1, -1, -1) if places[j] < places[i]), -1)
            q = next((j for j in range(i + 1, n) if places[j] < places[i]), n)
            both = [min(common[p + 1 : i + 1])] if p >= 0 else []
            both += [min(common[i + 1 : q + 1])] if q < n else []
            assert (previous[i], following[i], longest[i]) == (p, q, max(both, default=0))


def test_longest_previous_factors_of_a_text():
    """Against the definition: the longest prefix from each place that also starts earlier."""
    rng = random.Random(11)
    text = bytes(rng.choices(b"ab", k=60)) * 3 + bytes(rng.choices(b"abc", k=80)) + b"a" * 120
    text = text[: r.WIDEST - 30] + text[:100]
    parts = [text[i : i + r.WIDEST] for i in range(0, len(text), 40)]
    owner, inside, factor = r.earlier(parts, np.zeros(len(parts), np.int64), np.arange(0, len(text), 40))
    for o, i, f in zip(owner, inside, factor, strict=True):
        p = 40 * int(o) + int(i)
        limit = 40 * int(o) + len(parts[o])
        best = max(next((n for n in range(limit - p + 1) if p + n >= limit or text[j + n] != text[p + n]), 0) for j in range(p))
        assert f <= best and (f == best or f >= r.LEAST)


def test_suffix_order_and_common_prefixes():
    rng = random.Random(12)
    strings = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, r.WIDEST))) for _ in range(30)] + [b"a" * r.WIDEST] * 3
    s = r.Suffixes(strings)
    starts = np.concatenate([s.offset[i] + np.arange(len(x)) for i, x in enumerate(strings)])
    laid = np.concatenate([np.concatenate([np.frombuffer(x, np.uint8).astype(int) + 1, [0]]) for x in strings] + [np.zeros(400, int)])
    windows = [tuple(laid[p : p + r.WIDEST]) for p in starts[s.order(starts)]]
    assert windows == sorted(windows)
    a, b = s.offset[-1], s.offset[-2]
    assert s.share(np.array([a]), np.array([b]))[0] and s.common(np.array([a]), np.array([b]))[0] == r.WIDEST


def test_every_string_has_an_anchor():
    data = np.frombuffer(bytes(random.Random(6).choices(b"abc ", k=3000)), np.uint8)
    at, _ = r.anchors(data)
    gaps = np.diff(at)
    assert gaps.max() <= r.REACH + 1 and at[0] <= r.REACH


def test_odd_rows(odd_docs, make_docs):
    found = r.remove_repeats(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {x.n_bytes for x in found if x.doc_id in (1, 2)} == {0}
    assert {len(x.kept) for x in found if x.doc_id == 4} == {8}
    long = next(x for x in found if x.doc_id == 5)
    assert bytes(long.kept) == b"word " and len(long.removed) == 1
    assert sum(x.doc_id is None for x in found) == 1
    assert r.remove_repeats(make_docs([])).count() == 0
    clashing = odd_docs.withColumns({c: F.lit(1) for c in ("doc", "m1", "m2", "at", "stop", "body", "spans", "start")})
    assert r.remove_repeats(clashing).count() == len(found)
