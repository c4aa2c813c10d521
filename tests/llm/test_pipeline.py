import random

import pytest

import corpus_pipeline as c
from strandloom.llm import queries
from tests.llm.test_ngram_join import brute as near_groups
from tests.llm.test_quality import corpus

TEN = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts, labels = corpus(150, 7)
    rng = random.Random(2)
    rows = list(enumerate(texts))
    good = [t for t, y in zip(texts, labels, strict=True) if y]
    rows += [(500 + i, good[i]) for i in range(5)]
    near = [w if k else w + "x" for k, w in enumerate(good[6].split())]
    rows += [(600, " ".join(near)), (700, f"{good[8]} {TEN} {good[9]}")]
    rng.shuffle(rows)
    make_docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*enumerate(labels)], "doc_id BIGINT, quality INT").selectExpr("*", "0 AS toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, TEN)], "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, texts, labels


def test_stages(spark, folder):
    path, rows, texts, labels = folder
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    text_of = dict(rows)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = c.drop_poor(spark, docs, path)
    bad = {i for i, y in enumerate(labels) if not y}
    assert one.columns == docs.columns and len(bad & set(ids(one))) <= 2 and set(range(500, 505)) <= set(ids(one))
    two = c.drop_copies(spark, one, path)
    last = {}
    for i in ids(one):
        last[text_of[i].lower()] = i
    assert ids(two) == sorted(last.values()) and two.columns == docs.columns
    three = c.drop_near_copies(spark, two, path)
    groups = near_groups([(i, text_of[i]) for i in ids(two)])
    assert ids(three) == sorted(i for i, (_, first) in groups.items() if i == first) and 600 not in ids(three)
    four = c.drop_contaminated(spark, three, path)
    assert ids(four) == [i for i in ids(three) if i != 700] and four.columns == docs.columns
    five = c.encode(spark, four, path)
    assert ids(five) == ids(four) and five.where("not round_trip").count() == 0
    assert ids(c.run(spark, path)) == ids(four)
    assert columns is None


def test_every_query_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert [len(s) for s in c.STAGES] == [2] * 5
