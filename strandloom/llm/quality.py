"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one binned feature at a time are boosted in cycles over the features, so each feature ends as a
lookup table; then trees with one cut on each of two features are boosted for the pairs that explain most of
what remains. A score is the logistic of the sum of the tables' entries, added for a whole batch at once.

Features are shares and lengths that any text has; language, source and ids are no features. Labels are read
from rows of the training fold only; at most ``MAX_LABELS`` of them are used, those with the smallest hash of
their id, and no other document's text is read for training.

Cases: null and empty texts have features (zeros) and thus a score. Null labels and labels without a document
teach nothing; repeated labels count as often as they stand; of several documents under one id the one with the
smallest features teaches. Without labels, or with labels of one class only,
every score is the smoothed share of label 1. Rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, id_and_text, map_batches, only, smallest_hashes, texts

#: Labelled rows that a model is fitted on, at most.
MAX_LABELS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "upper", "digit", "blank", "newline", "full_stop", "comma", "mark", "symbol", "rule", "control", "non_ascii",
    "word_length", "longest_word", "short_words", "distinct_words", "top_word", "same_next", "distinct_pairs", "distinct_lines", "line_length", "end_symbols", "capital_words",
)
_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "blank": b" \t", "newline": b"\n\r", "full_stop": b".", "comma": b",;:",
    "mark": b"!?", "symbol": b"\"#$%&'()*+-/<=>@[\\]^_`{}~", "rule": b"|", "control": bytes([*range(9), *range(14, 32), 127]), "non_ascii": bytes(range(128, 256)),
}
_MASKS = np.stack([np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for v in _CLASSES.values()]).astype(np.float64)


def features(text: bytes) -> list[float]:
    """The values of FEATURES for a whole text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    shares = _MASKS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    tokens = text.split()
    k = max(1, len(tokens))
    counts = Counter(tokens)
    lines = text.split(b"\n")
    lengths = list(map(len, tokens))
    pairs = list(zip(tokens, tokens[1:], strict=False))
    return [
        np.log1p(n), *shares,
        sum(lengths) / k, min(200, max(lengths, default=0)), sum(x <= 3 for x in lengths) / k,
        len(counts) / k ** 0.8, max(counts.values(), default=0) / k, sum(a == b for a, b in pairs) / k, len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(not t[-1:].isalnum() and t[-1] < 128 for t in tokens) / k, sum(t[:1].isupper() for t in tokens) / k,
    ]


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, bins: int = 24, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.1, ridge: float = 1.0):
        self.bins, self.pair_bins, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.ridge = bins, pair_bins, rounds, pair_rounds, pairs, rate, ridge

    def _value(self, g, h):
        return g / (h + self.ridge)

    def _gain(self, g, h):
        return g * g / (h + self.ridge)

    def _shallow(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Steps of a tree of at most three leaves over the bins of one feature."""
        cuts = [0, len(g)]
        for _ in range(2):
            best = (1e-9, None)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                    gains = self._gain(cg[:-1], ch[:-1]) + self._gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - self._gain(cg[-1], ch[-1])
                    if gains.max() > best[0]:
                        best = (gains.max(), a + 1 + int(gains.argmax()))
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = self._value(g[a:b].sum(), h[a:b].sum())
        return out

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best tree with one cut on each of two features: its gain and its steps."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

        def four(c):
            a, all_ = c[:-1, :-1], c[-1, -1]
            top, left = c[:-1, -1:], c[-1:, :-1]
            return a, top - a, left - a, all_ - top - left + a

        parts = list(zip(four(cg), four(ch), strict=True))
        gains = sum(self._gain(x, y) for x, y in parts) - self._gain(cg[-1, -1], ch[-1, -1])
        i, j = np.unravel_index(int(gains.argmax()), gains.shape)
        values = [self._value(x[i, j], y[i, j]) for x, y in parts]
        out = np.empty_like(g)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
        return float(gains[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, k = x.shape
        share = (y.sum() + 0.5) / (n + 1)
        self.start = float(np.log(share / (1 - share)))
        cut = lambda column, bins: np.unique(np.quantile(column, np.arange(1, bins) / bins)) if n else np.empty(0)
        self.edges = [cut(x[:, f], self.bins) for f in range(k)]
        self.coarse = [cut(x[:, f], self.pair_bins) for f in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if n == 0 or y.min() == y.max():
            return self
        fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
        score = np.full(n, self.start)

        def slopes():
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f in range(k):
                g, h = slopes()
                step = self.rate * self._shallow(np.bincount(fine[f], g, len(self.tables[f])), np.bincount(fine[f], h, len(self.tables[f])))
                self.tables[f] += step
                score += step[fine[f]]
        shape = lambda a, b: (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
        cells = lambda a, b: wide[a] * shape(a, b)[1] + wide[b]
        grid = lambda a, b, w: np.bincount(cells(a, b), w, shape(a, b)[0] * shape(a, b)[1]).reshape(shape(a, b))
        g, h = slopes()
        ranked = sorted(((self._quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(k), 2) if min(shape(a, b)) > 1), reverse=True)
        self.pairs = [(a, b) for _, a, b in ranked[: self.n_pairs]]
        self.pair_tables = [np.zeros(shape(a, b)) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for m, (a, b) in enumerate(self.pairs):
                g, h = slopes()
                step = self.rate * self._quadrants(grid(a, b, g), grid(a, b, h))[1]
                self.pair_tables[m] += step
                score += step[wide[a], wide[b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: table entries of every feature and pair, added."""
        out = np.full(len(x), self.start)
        for f, (edges, entries) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += entries[np.searchsorted(edges, x[:, f], "right")]
        for (a, b), entries in zip(self.pairs, self.pair_tables, strict=True):
            out += entries[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def matrix(rows: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in rows], np.float64).reshape(len(rows), len(FEATURES))


def held_out(id_col, parts: int, held: int):
    """Whether crc32 of the id as text leaves the given remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == held, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> AdditiveModel:
    """Fits on the labelled rows given, or on ``max_labels`` of them by hash of their id.

    What reaches the driver are at most ``max_labels`` rows of features and labels.
    """
    known = labels.select(labels[id_col].cast("long").alias("label_id"), labels[label_col].cast("int").alias("y")).where("label_id IS NOT NULL AND y IN (0, 1)")
    chosen = checkpoint(smallest_hashes(known.withColumn("all", F.lit(1)), "label_id", max_labels, "all").drop("all"))
    rows = only(id_and_text(docs, id_col, text_col), chosen, "label_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(matrix(texts(batch)).tolist(), pa.list_(pa.float64()))], ["label_id", "x"])

    described = map_batches(rows, run, "label_id long, x array<double>").groupBy("label_id").agg(F.min("x").alias("x"))
    found = sorted((r.label_id, r.y, r.x) for r in described.join(chosen, "label_id").collect())
    x = np.array([r[2] for r in found], np.float64).reshape(len(found), len(FEATURES))
    return AdditiveModel().fit(x, np.array([r[1] for r in found], np.float64))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tables of a few dozen entries

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(matrix(texts(batch))))], ["doc_id", "score"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns; decided in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        good = shared.value.score(matrix([t or b"" for t in texts(batch, text_col)])) >= threshold
        return batch.filter(pa.array(good)) if good.any() else None

    return map_batches(docs, run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model of the labels outside the held-out fold."""
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(labels["doc_id"], 5, 0)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
