"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding undoes disguises before anything is learned or matched: letters are lower-cased and lose their accents,
letters of other scripts that look like Latin ones become these, and digits and signs inside words become the letters
they stand for (``1d10t``); numbers without letters stay. What is neither letter nor digit separates words.

The lexicon is learned from labelled rows. Candidates are words and beginnings of words (a stem with any ending);
one is taken if documents that have it are toxic far more often than others, beyond what chance gives among so many
candidates, and none that it begins with, or that begins with it, was taken before it. A beginning whose every
place is of one longer entry gives way to that one. A weight is the log ratio of its frequencies. A phrase of two words
around an entry that clean documents have and toxic ones never is an exception: entries inside it do not count.
Each word counts once, with its largest weight. A text's score is the logistic of two sums of weights, by
logarithm and by word, fitted on the same rows.

At most ``MAX_LABELS`` labelled rows are read, those with the smallest hash of their id, and at most ``MAX_ENTRIES``
candidates and ``MAX_EXCEPTIONS`` phrases reach the driver, the ones with the most toxic (clean) documents.

Cases: null and empty texts have no entries and score like any text without. Null labels and labels without a document
teach nothing; repeated labels count as often as they stand, and so do documents that share an id. Without labels, or
with labels of one class only, every score is the smoothed share of label 1. Rows are scored one by one, whole texts
at any length; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, checkpoint, id_and_text, map_batches, only, smallest_hashes, texts
from .quality import held_out

MAX_LABELS, MAX_ENTRIES, MAX_EXCEPTIONS = 20_000, 200_000, 20_000
THRESHOLD = 0.5
#: Characters of a stem; documents that an entry needs; how many times more frequent it is in toxic ones; clean documents of an exception.
STEMS, LEAST, RATIO, EXCUSED = range(4, 9), 3, 10.0, 3
#: Share of the toxic documents that an entry needs; how far its evidence is beyond chance (natural logarithm).
SHARE, MARGIN = 0.005, 2.0
# Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_LOOKALIKES = str.maketrans(LOOKALIKES | {chr(c): None for c in range(0x300, 0x370)})
_SIGNS = str.maketrans(SIGNS)
_MIXED = re.compile(r"(?<![\w@$!|])[\w@$!|]*[0134578@$!|][\w@$!|]*")
_GAPS = re.compile(r"[\W_]+")


def _spelled(found: re.Match) -> str:
    """A run of letters, digits and signs with its letters restored; signs at its end are punctuation."""
    word = found[0]
    core = word.rstrip("!|")
    return core.translate(_SIGNS) + " " if any(c.isalpha() for c in core) else word


def fold(text: str) -> str:
    """Folded words, with one blank before, between and after them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LOOKALIKES)
    return " " + _GAPS.sub(" ", _MIXED.sub(_spelled, text)).strip() + " "


class Lexicon:
    """Entries (`` stem`` or `` word ``) with weights, and exception phrases (`` two words ``)."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] | frozenset = frozenset()):
        self.weights, self.exceptions, self._automaton = dict(weights), set(exceptions), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for key in self.weights.keys() | self.exceptions:
                self._automaton.add_word(key, (len(key), self.weights.get(key), key in self.exceptions))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Where words with an entry begin (their blank before them), and their weight."""
        if not self.weights:
            return {}
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight, exception) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is not None:
                found[start] = max(weight, found.get(start, weight))
            if exception:
                excused.append((start, end))
        for start, end in excused:
            for at in [p for p in found if start <= p < end] if len(found) < end - start else [p for p in range(start, end) if p in found]:
                del found[at]
        return found

    def measure(self, folded: str) -> tuple[float, float]:
        """The sum of weights by logarithm and by word."""
        total = sum(self.hits(folded).values())
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), total / words


class Model:
    """A lexicon and the logistic of its two measures."""

    def __init__(self, lexicon: Lexicon, start: float, slopes: tuple[float, float] = (0.0, 0.0)):
        self.lexicon, self.start, self.slopes = lexicon, start, slopes

    def score(self, rows: list[str]) -> np.ndarray:
        x = np.array([self.lexicon.measure(fold(t)) for t in rows], np.float64).reshape(len(rows), 2)
        return 1 / (1 + np.exp(-np.clip(self.start + x @ np.array(self.slopes), -500, 500)))


def entries_of(folded: str) -> Counter:
    """The words and beginnings of words of a folded text, counted."""
    out: Counter = Counter()
    for word, n in Counter(folded.split()).items():
        out[f" {word} "] += n
        for k in STEMS:
            if k <= len(word):
                out[" " + word[:k]] += n
    return out


def chosen_entries(rows: list[tuple[str, int, int, int, int]], toxic: int, clean: int, toxic_words: int, clean_words: int) -> dict[str, float]:
    """Entries with weights from (candidate, documents and places in toxic texts, the same in clean ones)."""
    if not rows or not toxic or not clean:
        return {}
    # a beginning gives way to a longer candidate with all its places
    counts = {r[0]: r[1:] for r in rows}
    for key, c in list(counts.items()):
        word = key.strip()
        shorter = " " + (word[: min(len(word), STEMS[-1])] if key.endswith(" ") else word[:-1])
        if shorter in counts and shorter != key and counts[shorter] == c:
            counts[shorter] = None
    names = [k for k, c in counts.items() if c]
    n = np.array([counts[k] for k in names], np.float64)
    share, ratio = toxic / (toxic + clean), (n[:, 0] + 0.5) / (toxic + 1) * (clean + 1) / (n[:, 2] + 0.5)
    of = n[:, 0] / (n[:, 0] + n[:, 2])
    # the exponent of the bound on the chance of so large a share of toxic documents
    evidence = (n[:, 0] + n[:, 2]) * (of * np.log(of / share) + np.where(of < 1, (1 - of) * np.log(np.maximum(1 - of, 1e-300) / (1 - share)), 0))
    weights = np.log((n[:, 1] + 0.5) / (toxic_words + 1)) - np.log((n[:, 3] + 0.5) / (clean_words + 1))
    good = (evidence > np.log(len(rows)) + MARGIN) & (n[:, 0] >= SHARE * toxic) & (ratio >= RATIO) & (weights > 0) & (of > share)
    out: dict[str, float] = {}
    beginnings: set[str] = set()
    for i in sorted(np.flatnonzero(good), key=lambda i: (-evidence[i], names[i])):
        key = names[i]
        if key in beginnings or any(key[:k] in out for k in range(2, len(key))):
            continue
        out[key] = float(weights[i])
        beginnings.update(key[:k] for k in range(2, len(key) + 1))
    return out


def contexts(folded: str, lexicon: Lexicon) -> set[str]:
    """The phrases of two words that have an entry."""
    out = set()
    for at in lexicon.hits(folded):
        end = folded.index(" ", at + 1)
        if at > 0:
            out.add(folded[folded.rindex(" ", 0, at) : end + 1])
        if end + 1 < len(folded):
            out.add(folded[at : folded.index(" ", end + 1) + 1])
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, tuple[float, float]]:
    """A logistic regression on two measures by Newton's steps."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), (float(w[1]), float(w[2]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = MAX_LABELS, lexicon: Lexicon | None = None) -> Model:
    """Learns lexicon, exceptions and logistic from labelled rows; a lexicon given keeps its entries beside those learned."""
    known = labels.select(labels[id_col].cast("long").alias("label_id"), labels[label_col].cast("int").alias("y")).where("label_id IS NOT NULL AND y IN (0, 1)")
    chosen = checkpoint(smallest_hashes(known.withColumn("all", F.lit(1)), "label_id", max_labels, "all").drop("all"))
    rows = only(id_and_text(docs, id_col, text_col), chosen, "label_id")
    read = checkpoint(rows.join(chosen, rows[ID] == chosen["label_id"]).select("label_id", F.col(TEXT).alias("text"), "y"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, list[int]] = {}
        totals = [0, 0, 0, 0]
        for text, y in zip(strings(batch, "text"), batch.column(2).to_pylist(), strict=True):
            folded, at = fold(text), 0 if y else 2
            totals[at] += 1
            totals[at + 1] += max(0, folded.count(" ") - 1)
            for key, n in entries_of(folded).items():
                c = seen.setdefault(key, [0, 0, 0, 0])
                c[at] += 1
                c[at + 1] += n
        seen[""] = totals  # no candidate is empty
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4))], ["entry", "a", "b", "c", "d"])

    counts = checkpoint(map_batches(read, count, "entry string, a long, b long, c long, d long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in "abcd"]))
    totals = counts.where("entry = ''").collect()
    toxic, toxic_words, clean, clean_words = (tuple(totals[0])[1:]) if totals else (0, 0, 0, 0)
    start = float(np.log((toxic + 0.5) / (clean + 0.5)))
    if not toxic or not clean:
        return Model(lexicon or Lexicon({}), start)
    rate = F.lit(float(clean + 1) / (toxic + 1))
    near = counts.where((F.col("entry") != "") & (F.col("a") >= LEAST) & ((F.col("a") + 0.5) * rate >= (F.col("c") + 0.5) * RATIO))
    strongest = near.orderBy(F.desc("a"), "c", "entry").limit(MAX_ENTRIES).collect()
    learned = chosen_entries([tuple(r) for r in strongest], toxic, clean, toxic_words, clean_words)
    found = Lexicon(learned | (lexicon.weights if lexicon else {}), lexicon.exceptions if lexicon else ())
    found.exceptions |= _exceptions(read, found)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [shared.value.measure(fold(t)) for t in strings(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], ["label_id", "y", "p", "q"])

    # two numbers of at most max_labels rows, and of documents that share their ids
    measured = map_batches(read, measure, "label_id long, y int, p double, q double").groupBy("y", "p", "q").count().collect()
    measured = sorted((r.y, r.p, r.q, r["count"]) for r in measured)
    x = np.repeat(np.array([[r[1], r[2]] for r in measured]), [r[3] for r in measured], 0)
    y = np.repeat(np.array([r[0] for r in measured], np.float64), [r[3] for r in measured])
    return Model(found, *fitted(x, y))


def _exceptions(read: DataFrame, lexicon: Lexicon) -> set[str]:
    """Phrases of two words around an entry that only clean documents have."""
    shared = read.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, list[int]] = {}
        for text, y in zip(strings(batch, "text"), batch.column(2).to_pylist(), strict=True):
            for phrase in contexts(fold(text), shared.value):
                seen.setdefault(phrase, [0, 0])[1 - y] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in (0, 1))], ["phrase", "toxic", "clean"])

    sums = map_batches(read, run, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = sums.where((F.col("toxic") == 0) & (F.col("clean") >= EXCUSED)).orderBy(F.desc("clean"), "phrase").limit(MAX_EXCEPTIONS).collect()
    return {r.phrase for r in rows}


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts(batch, name)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_ENTRIES entries

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(strings(batch, batch.schema.names[1])))], ["doc_id", "score"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, score double")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a lexicon of the labels outside the held-out fold."""
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(labels["doc_id"], 5, 0)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
