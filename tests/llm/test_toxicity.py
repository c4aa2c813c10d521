import random
import zlib

import numpy as np
import pytest

from strandloom.llm import toxicity as t

BAD = ["idiot", "scumbag", "worthless"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 8)))
    labels = [int(rng.random() < 0.3) for _ in range(n)]
    out = []
    for y in labels:
        words = [word() for _ in range(rng.randint(20, 60))]
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice([*BAD, "vequ" + word()]))
        elif rng.random() < 0.5:
            words += ["worthless", "coupon"]
        out.append(" ".join(words) + ".")
    return out, labels


@pytest.mark.parametrize(
    ("text", "want"),
    [("An 1d10t!", " an idiot "), ("ѕtupіd", " stupid "), ("ＩＤＩＯＴ, îdïôt", " idiot idiot "), ("year 2041, 100%", " year 2041 100 "), ("what a m0r0n!!", " what a moron "), ("a|b || c", " alb c "), ("", "  "), ("$cum @nd tr4$h", " scum and trash ")],
)
def test_fold(text, want):
    assert t.fold(text) == want


def plain_hits(lexicon, folded):
    """Every word against every entry; words inside an exception do not count."""
    out, at = {}, 0
    excused = [(i, i + len(e) - 1) for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(e, i)]
    for word in folded.split():
        weights = [w for e, w in lexicon.weights.items() if (e == f" {word} " if e.endswith(" ") else word.startswith(e[1:]))]
        if weights and not any(a <= at < b for a, b in excused):
            out[at] = max(weights)
        at += len(word) + 1
    return out


def test_scan_equals_plain_search():
    rng = random.Random(3)
    lexicon = t.Lexicon({" ab": 1.0, " abc ": 2.0, " b ": 0.5, " cab ": 3.0}, {" b cab ", " abc abc "})
    for _ in range(300):
        folded = t.fold(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))))
        assert lexicon.hits(folded) == plain_hits(lexicon, folded)


def test_held_out_accuracy_and_entries(spark, make_docs):
    texts, labels = corpus()
    docs = make_docs(texts)
    labelled = spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, toxic INT")
    model = t.train(docs, labelled.where(~t.held_out(labelled["doc_id"], 5, 0)))
    assert {" idiot ", " scumbag ", " vequ"} <= set(model.lexicon.weights)
    assert " worthless coupon " in model.lexicon.exceptions or " worthless " not in model.lexicon.weights
    rows = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(rows[i] >= 0.5) == labels[i] for i in held]) > 0.95
    # disguised words count as the plain ones
    a, b = model.score(["you 1D10T and ѕcumbag"]), model.score(["you idiot and scumbag"])
    assert a == b and a[0] > 0.5 > model.score(["an entirely clean text"])[0]


def test_longer_texts_need_more():
    model = t.Model(t.Lexicon({" idiot ": 5.0}), -4.0, (1.0, 30.0))
    one = model.score(["idiot " + "word " * 10, "idiot " + "word " * 500])
    assert one[0] > 0.5 > one[1]


def test_exceptions_are_learned(spark, make_docs):
    texts = ["such trash here"] * 20 + ["the trash can stands there"] * 10 + ["nothing to see"] * 30
    labels = [1] * 20 + [0] * 40
    model = t.train(make_docs(texts), spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, toxic INT"), lexicon=t.Lexicon({" trash ": 3.0}))
    assert " trash can " in model.lexicon.exceptions and " such trash " not in model.lexicon.exceptions
    good, bad = model.score(["a trash can", "such trash"])
    assert good < 0.5 < bad


def test_without_labels_and_odd_rows(spark, odd_docs, make_docs):
    for rows in ([], [(4, None), (None, 1), (99, 1)], [(4, 1), (5, 1)], [(4, 1), (5, 0), (5, 0), (7, 1)]):
        model = t.train(odd_docs, spark.createDataFrame(rows, "doc_id BIGINT, toxic INT"))
        found = t.score(odd_docs, model).collect()
        assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert t.score(make_docs([]), model).count() == 0


def test_query(spark, tmp_path):
    texts, labels = corpus(200, 2)
    spark.createDataFrame([(i, x, "en", "s", "clash") for i, x in enumerate(texts)] + [(900, None, None, None, None), (901, "", None, None, None)], "doc_id BIGINT, text STRING, lang STRING, source STRING, score STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in t.op12_toxicity(spark, str(tmp_path)).collect()}
    assert len(rows) == 202 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    # an independent walk: entries and logistic by plain loops
    labelled = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if zlib.crc32(str(i).encode()) % 5], "doc_id BIGINT, toxic INT")
    model = t.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labelled)
    for i, x in [*enumerate(texts), (900, ""), (901, "")]:
        folded = t.fold(x)
        total = sum(plain_hits(model.lexicon, folded).values())
        z = model.start + model.slopes[0] * np.log1p(total) + model.slopes[1] * total / max(1, len(folded.split()))
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
