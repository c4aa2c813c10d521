"""Language identification by word-first backoff.

A known word counts with its log frequency in each language. An unseen word is cut into character n-grams (with
marks for its ends), the longest ones first; the longest length of which any n-gram is known gives the word's
mean log frequency in each language. A text's language has the largest sum over its words.

The model is fitted on at most ``MAX_DOCS`` documents of each language in the training fold, those with the
smallest hash of their id (fewer where there are more than ``MAX_ROWS`` / ``MAX_DOCS`` languages); it holds all
words of these and all n-grams of the words.

Cases: a null text, a text without letters and every text without a model is ``und`` with score 0. Null
languages teach nothing. Ties go to the language that sorts first. Very long texts are scored in blocks of words.
Rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, checkpoint, id_and_text, map_batches, only, smallest_hashes, texts
from .quality import held_out

MAX_DOCS, MAX_ROWS = 1_000, 16_000
#: Longest n-gram; words remembered by a worker; words scored at once.
ORDER, REMEMBERED, BLOCK = 5, 300_000, 100_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Backoff(dict):
    """word -> row of ``rows`` with its log frequencies by language; unseen words are added as they come.

    The log frequencies of known words and of n-grams are tables of numbers, and dictionaries hold their rows.
    """

    def __init__(self, languages: list[str], counts: dict[str, dict[str, int]]):
        super().__init__()
        self.languages = sorted(languages)
        at = {lang: i for i, lang in enumerate(self.languages)}
        words_ = sorted(counts)
        rows = np.zeros((len(words_), len(at)))
        for i, word in enumerate(words_):
            for lang, n in counts[word].items():
                rows[i, at[lang]] = n
        self.known = {w: i for i, w in enumerate(words_)}
        self.logs, self.parts, self.part_logs = self._logs(rows), [{}], [np.empty((0, len(at)), np.float32)]
        for n in range(1, ORDER + 1):
            numbers: dict[str, int] = {}
            gram, word = [], []
            for i, w in enumerate(words_):
                for g in grams(w, n):
                    gram.append(numbers.setdefault(g, len(numbers)))
                    word.append(i)
            sums = np.stack([np.bincount(gram, rows[word, k], len(numbers)) for k in range(len(at))], axis=1) if at and numbers else np.zeros((len(numbers), len(at)))
            self.parts.append(numbers)
            self.part_logs.append(self._logs(sums))
        self._start()

    def _logs(self, table: np.ndarray) -> np.ndarray:
        return np.log((table + 0.5) / (table.sum(0) + 0.5 * len(table))).astype(np.float32) if len(table) else table.astype(np.float32)

    def _start(self) -> None:
        self.clear()
        self.rows = np.empty((1024, len(self.languages)), np.float32)

    def __reduce__(self):
        return _rebuild, (self.languages, self.known, self.logs, self.parts, self.part_logs)

    def vector(self, word: str) -> np.ndarray:
        if (found := self.known.get(word)) is not None:
            return self.logs[found]
        for n in range(min(ORDER, len(word) + 2), 0, -1):
            if some := [i for g in grams(word, n) if (i := self.parts[n].get(g)) is not None]:
                return self.part_logs[n][some].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[n] = self.vector(word)
        self[word] = n
        return n

    def predict(self, text: str) -> tuple[str, float]:
        """The language and the share of the evidence that it has, from 0 to 1."""
        total, n = np.zeros(len(self.languages)), 0
        found = (m.group() for m in WORD.finditer(text.lower())) if len(text) > 8 * BLOCK else iter(WORD.findall(text.lower()))
        while some := list(islice(found, BLOCK)):
            if len(self) > REMEMBERED:
                self._start()
            rows = list(map(self.__getitem__, some))
            total += self.rows[rows].sum(0, dtype=np.float64)
            n += len(some)
        if not n or not self.languages:
            return "und", 0.0
        weights = np.exp((total - total.max()) / np.sqrt(n))
        return self.languages[int(total.argmax())], float(weights.max() / weights.sum())


def _rebuild(languages, known, logs, parts, part_logs) -> Backoff:
    out = Backoff([], {})
    out.languages, out.known, out.logs, out.parts, out.part_logs = languages, known, logs, parts, part_logs
    out._start()
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_rows: int = MAX_ROWS) -> Backoff:
    """Fits on the rows given (the training fold), bounded as the module says; what reaches the driver are their words."""
    ids = docs.select(docs[id_col].cast("long").alias(ID), docs[lang_col].cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col(ID).isNotNull())
    many = ids.agg(F.approx_count_distinct("lang").alias("n")).first()["n"]
    chosen = checkpoint(smallest_hashes(ids.distinct(), ID, max(1, min(max_docs, max_rows // max(1, many))), "lang"))
    rows = only(id_and_text(docs, id_col, text_col), chosen, ID)
    # of several texts under one id the smallest teaches
    rows = rows.groupBy(ID).agg(F.min(TEXT).alias(TEXT)).join(chosen.select(F.col(ID).alias("chosen"), "lang"), F.col(ID) == F.col("chosen")).select(TEXT, "lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text, lang in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            counts.update((w, lang) for w in WORD.findall(text.decode().lower()))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "lang", "n"])

    by_word = map_batches(rows, run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for word, lang, n in zip(*(by_word.column(c).to_pylist() for c in ("word", "lang", "n")), strict=True):
        counts.setdefault(word, {})[lang] = n
    return Backoff(list({lang for by in counts.values() for lang in by}), counts)


def identify(docs: DataFrame, model: Backoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of MAX_ROWS documents

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t.decode()) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the documents outside the held-out fold."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(docs["doc_id"], 4, 2)))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
