import random

from pyspark.sql import functions as F

from strandloom.llm import decontaminate as d


def brute(items, doc, window):
    hit, names = set(), set()
    for name, item in items:
        w = min(window, len(item))
        for i in range(len(item) - w + 1 if w else 0):
            for j in range(len(doc) - w + 1):
                if doc[j : j + w] == item[i : i + w]:
                    hit |= set(range(j, j + w))
                    names.add(name)
    return hit, names


def test_automaton_matches_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        window, letters = rng.choice([2, 3, 4]), [b"a", b"b", b"c"][: rng.choice([2, 3])]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(0, 4))]
        doc = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 25))]
        spans, names, longest = d.Automaton(items, window).match(doc)
        assert ({p for a, b in spans for p in range(a, b)}, names) == brute(items, doc, window)
        runs = [k for _, it in items for i in range(len(it)) for k in range(1, len(it) - i + 1) if any(doc[j : j + k] == it[i : i + k] for j in range(len(doc)))]
        assert longest == max(runs, default=0)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id BIGINT, text STRING")


TEN = "one two three four five six seven eight nine ten"


def test_documents(spark, make_docs):
    items = items_of(spark, [(7, TEN + " eleven"), (12, "Short, item"), (3, None), (4, "...")])
    docs = make_docs([f"Before {TEN.upper()} after", "short item short item", "one two three four five six seven eight nine", "", None, f"x {TEN} eleven short-item"])
    found = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in d.find_items(docs, items).collect()}
    assert found == {0: (12, 10, ["7"]), 1: (4, 4, ["12"]), 2: (9, 0, []), 3: (0, 0, []), 4: (0, 0, []), 5: (14, 13, ["12", "7"])}


def test_several_blocks_and_passes_agree(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    some = [(i, " ".join(rng.choice("abcde") for _ in range(15))) for i in range(20)]
    docs = make_docs([" ".join(rng.choice("abcde") for _ in range(60)) for _ in range(30)])
    rows = lambda **k: sorted(map(tuple, d.find_items(docs, items_of(spark, some), window=4, **k).collect()))
    whole = rows()
    assert rows(group=60) == whole and rows(group=200, block=40) == whole and rows(block=40) == whole
    assert len(list(d._passes(items_of(spark, some), 4, "item_id", 200, 40))) > 1
    assert [len(b.blocks) for b in d._passes(items_of(spark, some), 4, "item_id", 10**6, 40)] == [20]
    monkeypatch.setattr(d, "HELD", 300)
    assert rows(block=40) == whole


def test_an_automaton_is_made_once_for_many_rows(spark, make_docs):
    """Blocks take turns over the rows that are held, not for each batch."""
    bench = d.Benchmark([(str(i), f"{TEN} w{i}") for i in range(6)], block=60)
    made = []
    real = bench.block
    bench.block = lambda k: made.append(k) or real(k)
    assert len(bench.blocks) == 6
    for _ in range(2):
        for k in range(6):
            bench.block(k).match(TEN.encode().split())
    assert made == [*range(6)] * 2


def test_cutting_and_dropping(spark, make_docs):
    items = items_of(spark, [(1, TEN)])
    docs = make_docs([f"Keep this, {TEN}! And this.", "clean", TEN])
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, items, max_coverage=0.9).collect()}
    assert cut == {0: "Keep this, ! And this.", 1: "clean"}
    assert [r.doc_id for r in d.decontaminate(docs, items, max_coverage=0.0).collect()] == [1]
    assert {r.doc_id: r.text for r in d.decontaminate(docs, items, max_words=10).collect()}[2] == TEN


def test_odd_rows_and_empty_tables(spark, odd_docs, make_docs):
    none = items_of(spark, [])
    assert d.find_items(odd_docs, none).where("n_hit > 0").count() == 0
    names = "n_words longest spans items n_hit __n_words __longest __spans __items __n_hit __id __text N_HIT".split()[:-1]
    clashing = odd_docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for coverage in (0, 0.5):
        left = d.decontaminate(clashing, items_of(spark, [(1, "word " * 12)]), max_coverage=coverage)
        assert left.columns == clashing.columns and left.count() == odd_docs.count() - 1
        assert {tuple(r[c] for c in names) for r in left.collect()} == {tuple(range(len(names)))}
    assert d.find_items(clashing, none).count() == odd_docs.count()
    assert d.decontaminate(odd_docs, none).columns == odd_docs.columns
    assert d.decontaminate(odd_docs, none, max_coverage=0).count() == odd_docs.count()
    assert d.find_items(make_docs([]), items_of(spark, [(1, TEN)])).count() == 0
    assert d.find_items(odd_docs, items_of(spark, [(None, "word " * 12)])).where("n_hit > 0").collect()[0].item_ids == [""]
