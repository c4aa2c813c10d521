import math
import random
import re
import zlib
from collections import Counter

import regex
from pyspark.sql import functions as F

from strandloom.llm import language, urls
from strandloom.llm.quality import held_out

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ein", "ung"], "cc": ["ción", "os", "lla"]}


def corpus(n=240):
    rng = random.Random(1)
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(n)]
    return [" ".join("".join(rng.choice(SYLLABLES[x]) for _ in range(rng.randint(1, 4))) for _ in range(20)) for x in langs], langs


def test_held_out_accuracy(make_docs):
    texts, langs = corpus()
    docs = make_docs(texts, langs)
    model = language.train(docs.where(~held_out(docs["doc_id"], 4, 2)))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    held = [r.doc_id for r in docs.where(held_out(docs["doc_id"], 4, 2)).collect()]
    assert len(held) > 30 and sum(found[i][0] == langs[i] for i in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for _, s in found.values())


def test_unseen_words_back_off():
    model = language.Backoff(["aa", "bb"], {"kato": {"aa": 5}, "schein": {"bb": 5}, "x": {"aa": 1, "bb": 1}})
    assert model.predict("katokato")[0] == "aa" and model.predict("scheinschein")[0] == "bb"
    assert (model.vector("ato") == model.part_logs[4][model.parts[4]["ato$"]]).all() and language.ORDER == 5
    assert model.vector("ωωω").tolist() == [0.0, 0.0] or model.predict("ωωω")[0] == "aa"


def test_blocks_and_memory_change_nothing(monkeypatch):
    counts = {"kato": {"aa": 5}, "schein": {"bb": 3}}
    text = "kato schein unseen katoka " * 400
    want = language.Backoff(["aa", "bb"], counts).predict(text)
    monkeypatch.setattr(language, "BLOCK", 10)
    monkeypatch.setattr(language, "REMEMBERED", 1)
    got = language.Backoff(["aa", "bb"], counts).predict(text)
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-6


def brute_language(texts, langs, text):
    """Language and score by counting in plain dictionaries, word by word."""
    words_of = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    names = sorted({x for t, x in zip(texts, langs, strict=True) if x is not None and words_of(t)})
    known = {x: Counter(w for t, y in zip(texts, langs, strict=True) if y == x for w in words_of(t)) for x in names}
    vocabulary = {w for c in known.values() for w in c}
    parts = {n: {x: Counter() for x in names} for n in range(1, 6)}
    for x in names:
        for w, k in known[x].items():
            marked = f"^{w}$"
            for n in range(1, 6):
                for i in range(len(marked) - n + 1):
                    parts[n][x][marked[i : i + n]] += k

    def log(counts, total, size):
        return math.log((counts + 0.5) / (total + 0.5 * size))

    sums, found = dict.fromkeys(names, 0.0), words_of(text)
    for w in found:
        if w in vocabulary:
            for x in names:
                sums[x] += log(known[x][w], sum(known[x].values()), len(vocabulary))
            continue
        marked = f"^{w}$"
        for n in range(min(5, len(marked)), 0, -1):
            every = {g for x in names for g in parts[n][x]}
            if some := [g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in every]:
                for x in names:
                    sums[x] += sum(log(parts[n][x][g], sum(parts[n][x].values()), len(every)) for g in some) / len(some)
                break
    if not found or not names:
        return "und", 0.0
    best = max(names, key=lambda x: (sums[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(found))) for s in sums.values())


def test_query_matches_brute_force(spark, tmp_path, make_docs):
    """op10 over a small table, held-out rows and all, against plain counting."""
    texts, langs = corpus(90)
    texts += ["katoka unseen", "ungsch mi", "", None, "123 !", "to to", "Łódź été", "KA ka Ka", "\u0301ka"]
    langs += [None] * 5 + ["aa", "bb", None, "cc"]
    docs = make_docs(texts, langs).withColumn("lang_pred", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in language.op10_language(spark, str(tmp_path)).collect()}
    taught = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2 and langs[i] is not None]
    for i, t in enumerate(texts):
        want = brute_language([texts[k] for k in taught], [langs[k] for k in taught], t)
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert rows[i].lang_pred == want[0] and abs(rows[i].score - want[1]) < 1e-4, (t, rows[i], want)


def test_ties_between_languages_and_very_long_texts(make_docs):
    model = language.Backoff(["bb", "aa"], {"kato": {"aa": 5, "bb": 5}, "mi": {"aa": 2, "bb": 2}})
    assert model.predict("kato mi ato") == ("aa", 0.5)
    text = "kato mi " * 110_000  # beyond 800,000 characters
    assert model.predict(text)[0] == "aa" and abs(model.predict(text)[1] - 0.5) < 1e-6
    model = language.Backoff(["aa", "bb"], {"kato": {"aa": 5}, "schein": {"bb": 5}})
    assert model.predict("schein " * 130_000 + "kato " * 1000)[0] == "bb"
    long = "k" * 300_000
    assert {r.lang_pred for r in language.identify(make_docs([long, text]), model).collect()} == {"aa"}


def test_rows_that_teach_are_bounded(make_docs):
    texts, langs = corpus(200)
    docs = make_docs([(k % 150, t) for k, t in enumerate(texts)], langs)  # some ids stand for two texts
    model = language.train(docs, max_docs=5)
    assert model.languages == sorted(SYLLABLES) and len(model.known) <= 3 * 5 * 20 * 2


def test_language_of_odd_rows(odd_docs, make_docs):
    model = language.train(odd_docs)
    found = {(r.doc_id, r.lang_pred) for r in language.identify(odd_docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= found
    empty = language.train(make_docs([]))
    assert {r.lang_pred for r in language.identify(odd_docs, empty).collect()} == {"und"}
    assert language.identify(make_docs([]), model).count() == 0


def brute_rule(host, path):
    fits = [(h + p, verdict) for verdict, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=None)


def pages(spark, some):
    return spark.createDataFrame([(i, u, "<html>", "clash") for i, u in enumerate(some)], "page_id BIGINT, url STRING, html STRING, verdict STRING")


URLS = [
    "http://A.Example.org/es/1", "https://example.org/en/1?x", "https://example.org/en/2", "http://example.org", "http://x.com/fr/", "http://x.com/de/1#a", "com://com/de/", None, "", "no scheme", "http://", "http://org/?/",
    "http://notexample.org/es/", "http://cheappills.example.net/a", "http://spam-farm.example.net/en/1", "http://news-blog.example.net/en/1", "http://h?://k/x", "http://U.net#/es/", "http://" + "z" * 500 + ".net/",
]


def test_rules_and_verdicts(spark):
    table = pages(spark, URLS * 3)
    rows = urls.judge(table, *urls.train(table)).collect()
    assert len(rows) == len(URLS) * 3
    for r in rows:
        u = URLS[r.page_id % len(URLS)]
        if u is None or "://" not in u:
            assert (r.host, r.path, r.rule) == ("", "", None)
            continue
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        want = brute_rule(host.lower(), path)
        assert (r.host, r.path) == (host.lower(), path)
        assert (r.rule, r.verdict) == (want or (None, r.verdict))
    by = {URLS[r.page_id]: r.verdict for r in rows if r.page_id < len(URLS)}
    assert by["http://cheappills.example.net/a"] == by["http://spam-farm.example.net/en/1"] == "block"
    assert by["http://news-blog.example.net/en/1"] == by[None] == "allow"


def test_segmentation_is_best(spark):
    import itertools

    s = urls.Segmenter({"cheap": 5, "pills": 4, "ap": 50, "che": 2, "pill": 1})
    for name in ("cheappills", "pillsap", "xcheapx"):
        cuts = [c for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k)]
        best = min(sum(s.cost(name[a:b]) for a, b in zip((0, *c), (*c, len(name)), strict=True)) for c in cuts)
        assert abs(sum(map(s.cost, s(name))) - best) < 1e-9
    assert "".join(s("q" * 200)) == "q" * 200


def test_long_words_are_found(spark):
    word = "internationalisationally"
    s = urls.Segmenter({word: 3, "international": 5, "isation": 5, "ally": 5, "buy": 9})
    assert s("buy" + word) == ["buy", word] and s("buy" * 19 + word) == ["buy"] * 19 + [word]
    assert s("y" * 300) == ["y" * 300]


def test_long_names_are_segmented_whole(spark):
    s = urls.Segmenter({"newspaper": 5, "cheap": 5, "pills": 5})
    assert s("newspaper" * 7 + "cheappills") == ["newspaper"] * 7 + ["cheap", "pills"]
    long = "pills" * 30
    s = urls.Segmenter({long: 5, "pills": 1, "cheap": 2})
    assert s("cheap" + long) == ["cheap", long]
    table = pages(spark, ["http://" + "newspaper" * 7 + "cheappills.example.net/"] + ["http://cheap-pills.example.net/newspaper"] * 3 + ["http://" + "casino" * 4000 + ".net/" + "a/" * 20_000])
    rows = {r.page_id: r for r in urls.judge(table, *urls.train(table)).collect()}
    assert rows[0].words[-3:] == ["newspaper", "cheap", "pills"] and rows[4].verdict == "block" and len(rows[4].words) == 24_000


def brute_bayes(some, texts=()):
    """Probability of block of each url, by naive Bayes and rounds of expectation-maximisation in plain dictionaries."""
    lexicon = Counter()
    for u in some:
        host, path = urls.split_url(u)
        for label in host.split("."):
            parts = re.findall(r"[a-z\u0080-\U0010ffff]+", label)
            lexicon.update(parts if len(parts) > 1 else [])
        lexicon.update(re.findall(r"[a-z\u0080-\U0010ffff]+", path.lower()))
    for text in texts:
        lexicon.update(re.findall(r"[a-z\u0080-\U0010ffff]+", re.sub("<[^>]*>", " ", (text or "").lower())))
    kinds = {w: k for k, words in urls.SEEDS.items() for w in words}
    share = max(1, sum(lexicon.values()) // 1000)
    for w in kinds:
        lexicon[w] += share
    total = sum(lexicon.values()) + 1

    def cut(name):
        cost = lambda w: math.log(total / lexicon[w]) if w in lexicon else math.log(total) + 2.5 * len(w)
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            best.append(min(((best[a][0] + cost(name[a:end]), best[a][1] + [name[a:end]]) for a in range(end)), key=lambda x: x[0]))
        return best[-1][1]

    def words(u):
        host, path = urls.split_url(u)
        out = [w for name in re.findall(r"[a-z\u0080-\U0010ffff]+", host) if name not in urls.COMMON for w in cut(name)]
        return out + [w for w in re.findall(r"[a-z\u0080-\U0010ffff]+", path.lower()) if w not in urls.COMMON]

    cuts = [words(u) for u in some]
    before = None
    for _ in range(urls.ROUNDS + 1):
        counts, n = {k: Counter({w: 1 for w in words_}) for k, words_ in urls.SEEDS.items()}, Counter()
        for i, found in enumerate(cuts):
            votes = Counter(kinds[w] for w in found if w in kinds)
            if votes["block"] != votes["allow"]:
                share = {"block": 1.0} if votes["block"] > votes["allow"] else {"allow": 1.0}
            elif before is None or not found:
                continue
            else:
                part = round(1024 * before[i]) / 1024
                share = {"block": part, "allow": 1 - part}
            for kind, part in share.items():
                n[kind] += part
                for w in found:
                    counts[kind][w] += part
        vocabulary = {w for c in counts.values() for w in c if c[w] > 0}
        out = []
        for found in cuts:
            log = {k: math.log((n[k] + 1) / (n["block"] + n["allow"] + 2)) for k in counts}
            for w in found:
                if w in vocabulary:
                    for k in counts:
                        log[k] += math.log((counts[k][w] + 1) / (sum(counts[k].values()) + len(vocabulary) + 1))
            out.append(1 / (1 + math.exp(log["allow"] - log["block"])))
        before = out
    return [(p, bool(found)) for p, found in zip(out, cuts, strict=True)]


def test_query_matches_brute_force_bayes(spark, tmp_path):
    rng = random.Random(4)
    pool = "cheap pills casino bonus news paper school garden river lamp spam farm track museum gold".split()
    some = URLS + ["http://" + "".join(rng.sample(pool, rng.randint(1, 3))) + rng.choice([".example.net", ".net", "-shop.org", ".com"]) + "/" + "/".join(rng.sample(pool, rng.randint(0, 3))) for _ in range(120)]
    some += [f"http://{a}-{b}.net/" for a in pool for b in pool[:4]]
    pages(spark, some).write.parquet(f"{tmp_path}/pages.parquet")
    texts = ["The River and the lamp; <b>museum</b> gold", None, "", "gardens of Gold"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.page_id: r for r in urls.op8_urls(spark, str(tmp_path)).collect()}
    for i, (u, (p, any_)) in enumerate(zip(some, brute_bayes(some, texts), strict=True)):
        rule = brute_rule(rows[i].host, rows[i].path) if u and "://" in u else None
        assert abs(rows[i].p_block - p) < 1e-9, u
        assert rows[i].verdict == (rule[1] if rule else "block" if any_ and p > 0.5 else "allow")


def test_models_are_bounded_and_count_all_rows(spark):
    """Words with less than their share of the letters are not held, but count; no url is left out."""
    letters = "abcdefghij"
    table = pages(spark, [f"http://cheap-w{letters[k % 10]}{letters[k // 10 % 10]}.net/river" for k in range(1000)])
    segmenter, bayes = urls.train(table)
    assert sum(w.startswith("w") and len(w) == 3 and w != "win" for w in segmenter.counts) == 100 and segmenter.counts["river"] == 1000
    small, few = urls.train(table, letters=30)  # cheap and river have a third of 3,000 occurrences each
    assert {w for w in small.counts if w not in urls.SEEDS["block"] + urls.SEEDS["allow"]} == {"river"} and small.counts["river"] == 1000
    assert small.total == segmenter.total and few.weight["cheap"] > 0


def test_names_split_by_words_of_pages(spark):
    """Names that no url spells out are split by words of texts; classes of words without a seed are learned from all urls."""
    from pyspark.sql import functions as F

    bad, good, open_ = ["veltun", "tuntunvel"], ["kasmora", "moramorakas"], ["velvelvel", "tunveltun", "kaskaskas", "morakasmora"]
    some = [f"http://{h}.net/casino" for h in bad * 5] + [f"http://{h}.net/library" for h in good * 5] + [f"http://{h}.net/" for h in open_]
    texts = spark.createDataFrame([("<p class='x'>Vel mora</p> tun " * 4,), ("kas vel",), (None,), ("<" * 5000,)], "text STRING")
    table = pages(spark, some)
    segmenter, bayes = urls.train(table, words_of=texts)
    found = {r.host: r for r in urls.judge(table, segmenter, bayes).collect()}
    assert found["tuntunvel.net"].words == ["tun", "tun", "vel", "casino"] and found["morakasmora.net"].words == ["mora", "kas", "mora"]
    assert [found[f"{h}.net"].verdict for h in bad + open_[:2] + good + open_[2:]] == ["block"] * 4 + ["allow"] * 4
    none, prior = urls.train(table.where(F.lit(False)), words_of=texts.where("false"))
    assert set(none.counts) == set(urls.SEEDS["block"] + urls.SEEDS["allow"]) and prior.block([]) == 0.5


def test_prior_is_learned(spark):
    blocked, allowed = ["http://spam.example.net/"] * 8, ["http://news.example.net/"]
    for some, prior in ((blocked + allowed, 9 / 11), (blocked[:1] + allowed * 98, 2 / 101)):
        table = pages(spark, [*some, None])
        rows = {r.page_id: r for r in urls.judge(table, *urls.train(table)).collect()}
        assert abs(rows[len(some)].p_block - prior) < 1e-9 and rows[len(some)].verdict == "allow"


def test_empty_pages(spark):
    table = pages(spark, [])
    assert urls.judge(table, *urls.train(table)).count() == 0
