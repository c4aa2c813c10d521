"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised to words (A-Z lower-cased). The automaton holds every word sequence of the
items; a document's words are streamed through it while the length of the longest match is tracked. Where at
least ``window`` words match, all of them are hit; an item of fewer words hits where it occurs as a whole.
Spans longer than ``max_words`` are removed from the text, and documents of which more than ``max_coverage`` is
hit are removed as a whole.

Items are held in blocks of at most ``BLOCK`` bytes of text, each with an automaton of its own (a match never
crosses items, so blocks are independent). What is broadcast is the raw text of at most ``GROUP`` bytes of
items; a larger benchmark takes several passes over the documents, one after the other, with what each has found
written to the shared folder. A worker holds one automaton at a time; with several blocks it makes each of them
once for ``HELD`` bytes of documents, so that making them is a small part of the work.

Cases: null and empty texts have no words and are clean; items without words match nothing; repeated items and
item ids count once in n_items. An empty table of items leaves every document clean. Items with a null id match
and are named "". Very long texts are streamed word by word. Rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ID, TEXT, WORDS, fresh, id_and_text, map_batches, pieces, staged, texts, words

WINDOW = 10
#: Bytes of items in one automaton, and in one pass over the documents.
BLOCK, GROUP = 1 << 20, 32 << 20
#: Bytes of documents that wait in a worker while the blocks take turns.
HELD = 24 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """A generalised suffix automaton over words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        prefixes = []
        for name, item in items:
            if item:
                last, states = 0, []
                for w in item:
                    last = self._extend(last, w)
                    states.append(last)
                prefixes.append((name, item, states))
                self.shortest = min(self.shortest, len(item))
        n = len(self.length)
        order = sorted(range(n), key=self.length.__getitem__)
        #: For each state the ancestor (or itself) that stands for the last ``window`` words, or -1.
        self.full = [-1] * n
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.full[v] = v if self.length[up] < window else self.full[up]
        #: Names of the items that hold a state's last ``window`` words; items that end as a whole at a state.
        self.names: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for name, item, states in prefixes:
            if len(item) >= window:
                for v in self._walk(item)[window - 1 :]:
                    self.names.setdefault(self.full[v], set()).add(name)
            else:
                whole.setdefault(states[-1], set()).add(name)
        #: For each state the longest whole short item among its suffixes, as (state, length), or None.
        self.short: list[int] = [-1] * n
        for v in order[1:]:
            self.short[v] = v if v in whole else self.short[self.link[v]]
        self.whole = whole
        self.has_short = bool(whole)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _walk(self, item: list[bytes]) -> list[int]:
        """States after each word of a sequence that the automaton holds."""
        v, out = 0, []
        for w in item:
            v = self.next[v][w]
            out.append(v)
        return out

    def match(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of hit words (start, end; ascending, disjoint), names of items found, longest match."""
        nxt, link, length, window, root = self.next, self.link, self.length, self.window, self.next[0]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        short: set[int] = set()
        v = n = longest = 0
        i = -1
        has_short, shortest, full = self.has_short, self.shortest, self.full

        def mark(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                a, b = spans.pop()
                start, end = min(a, start), max(b, end)
            spans.append((start, end))

        for w in text_words:
            i += 1
            if n:
                if (to := nxt[v].get(w)) is None:
                    if n > longest:
                        longest = n
                    while (v := link[v]) >= 0 and (to := nxt[v].get(w)) is None:
                        pass
                    if to is None:
                        v = n = 0
                        continue
                    n = length[v] + 1
                else:
                    n += 1
                v = to
            elif (to := root.get(w)) is not None:
                v, n = to, 1
            else:
                continue
            if n >= shortest:
                if n >= window:
                    found.add(full[v])
                    mark(i - n + 1, i + 1)
                if has_short:
                    u = v if n == length[v] else link[v]
                    u = self.short[u]
                    while u > 0:
                        short.add(u)
                        mark(i - length[u] + 1, i + 1)
                        u = self.short[link[u]]
        names: set[str] = set()
        for u in found:
            names |= self.names[u]
        for u in short:
            names |= self.whole[u]
        return spans, names, max(longest, n)


class Benchmark:
    """Items in blocks, and the automaton of the block in use."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, block: int = BLOCK):
        self.window, self.blocks, room = window, [], 0  # without items there is one empty block
        for name, text in items:
            room -= (size := len(text.encode()))
            if room < 0:
                self.blocks.append([])
                room = block - size
            self.blocks[-1].append((name, text))
        self.at, self.automaton = -1, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"at": -1, "automaton": None}

    def block(self, k: int) -> Automaton:
        if self.at != k:
            self.at, self.automaton = k, None
            self.automaton = Automaton([(name, words(text.encode())) for name, text in (self.blocks[k] if self.blocks else ())], self.window)
        return self.automaton


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between two removed words goes with them."""
    if not spans:
        return text
    keep, at, k, i = [], 0, 0, -1
    begin = 0
    for i, m in enumerate(_WORD.finditer(text.translate(WORDS))):
        if i == spans[k][0]:
            begin = m.start()
        if i == spans[k][1] - 1:
            keep.append(text[at:begin])
            at = m.end()
            k += 1
            if k == len(spans):
                break
    return b"".join(keep) + text[at:]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: What a scan adds: words, longest match, spans of hit words, names of the items found.
FOUND = {"n_words": T.LongType(), "longest": T.LongType(), "spans": SPAN, "items": T.ArrayType(T.StringType())}
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _passes(items: DataFrame, window: int, item_col: str, group: int, block: int) -> Iterator[Benchmark]:
    """The items of each pass; the driver holds those of one pass at a time."""
    part, room = [], group
    for row in items.select(F.coalesce(items[item_col].cast("string"), F.lit("")).alias("name"), F.coalesce(items["text"], F.lit("")).alias("text")).toLocalIterator():
        if (room := room - len(row.text.encode())) < 0 and part:
            yield Benchmark(part, window, block)
            part, room = [], group - len(row.text.encode())
        part.append((row.name, row.text))
    yield Benchmark(part, window, block)


def scan(docs: DataFrame, items: DataFrame, carry: list[str], names: list[str], window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """The columns ``carry`` of every document, and beside them under ``names`` what FOUND says and the number of hit
    words. Nothing is shuffled: each pass adds to what the pass before it has found in the same row.
    """
    *added, n_hit = names
    none = dict(zip(added, (F.lit(0).cast("long"), F.lit(0).cast("long"), F.array().cast(SPAN), F.array().cast("array<string>")), strict=True))
    out, before = docs.select(*dict.fromkeys([*carry, text_col])).withColumns(none), None
    passes = _passes(items, window, item_col, group, block)
    bench = next(passes)
    while bench is not None:
        following = next(passes, None)
        columns = carry if following is None else [*dict.fromkeys([*carry, text_col])]
        shared = docs.sparkSession.sparkContext.broadcast(bench)
        out = _scan_pass(out, shared, len(bench.blocks) > 1, columns, added, T.StructType([*docs.select(*columns).schema.fields, *(T.StructField(n, t) for n, t in zip(added, FOUND.values(), strict=True))]), text_col)
        if following is not None:
            out = staged(out)
            shared.destroy()
        bench = following
    return out.withColumn(n_hit, F.aggregate(added[2], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def _scan_pass(rows: DataFrame, shared, several: bool, columns: list[str], added: list[str], schema: T.StructType, text_col: str) -> DataFrame:
    """One pass over the documents."""

    def look(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        of = lambda name: batch.column(batch.schema.get_field_index(name))
        n_words, longest_, spans_, items_ = added
        split = [t or b"" for t in texts(batch, text_col)]
        counts, longest = [0] * len(split), of(longest_).to_pylist()
        spans = [[(x["start"], x["end"]) for x in s] for s in of(spans_).to_pylist()]
        names = [set(x) for x in of(items_).to_pylist()]
        for block in range(len(bench.blocks) or 1):
            automaton = bench.block(block)
            for i, t in enumerate(split):
                w = words(t)
                counts[i] = len(w)
                new, found, n = automaton.match(w)
                if new:
                    spans[i] = merged(spans[i] + new)
                    names[i] |= found
                longest[i] = max(longest[i], n)
        yield pa.RecordBatch.from_arrays(
            [
                *map(of, columns), pa.array(counts, pa.int64()), pa.array(longest, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _ARROW_SPAN),
                pa.array([sorted(x) for x in names], pa.list_(pa.string())),
            ],
            [*columns, *added],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for piece in pieces(batch, 1000, HELD):
                held.append(piece)
                if not several or sum(p.nbytes for p in held) >= HELD:
                    yield from look(held)
                    held = []
        if held:
            yield from look(held)

    return rows.mapInArrow(run, schema)


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, longest, spans, item_ids, n_hit."""
    found = scan(id_and_text(docs, id_col, text_col), items, [ID], [*FOUND, "n_hit"], window, TEXT, item_col, group, block)
    return found.select(F.col(ID).alias("doc_id"), "n_words", "longest", "spans", "n_hit", F.col("items").alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, max_words: int = 0, max_coverage: float = 1.0, window: int = WINDOW, text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The documents without spans of more than ``max_words`` hit words, and without those documents of whose
    words more than the share ``max_coverage`` is hit. All columns stay; the text is rewritten where it is cut.
    """
    columns = docs.columns
    names = fresh(docs, *FOUND, "n_hit")
    n_words, _, spans, _, n_hit = names
    found = scan(docs, items, columns, names, window, text_col, group=group)
    kept = found.where(F.col(n_hit) <= F.col(n_words) * F.lit(float(max_coverage)))
    if max_coverage <= 0:
        return kept.select(*columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        out = []
        for t, s in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
            gone = [(x["start"], x["end"]) for x in s if x["end"] - x["start"] > max_words]
            out.append(cut(t.encode(), gone).decode() if gone else t)
        return pa.RecordBatch.from_arrays([pa.array(out, c.type) if i == at else c for i, c in enumerate(batch.columns[: len(columns)])], columns)

    return map_batches(kept.select(*columns, spans), run, docs.schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and benchmark items."""
    from .common import table

    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM item, unnest(generate_series(1, greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
cand AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM doc, lens, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT c.doc_id, c.i, c.n, win.item_id FROM cand c JOIN win ON c.n = win.n AND c.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) h, unnest(generate_series(i, i + n - 1)) AS u(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
