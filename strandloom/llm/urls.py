"""URL filters: rules first, then naive Bayes over segmented host and path words.

A unigram Viterbi search splits a host's concatenated names into words of a lexicon; multinomial naive Bayes
scores these and the words of the path. Both are counted over all rows. The lexicon has the words that stand alone in
urls (parts of hyphenated names, words of paths) and those of the texts that are given with them. Naive Bayes starts
from the seed words of each class and the urls that hold one, each with the class that most of its seed words give;
then ``ROUNDS`` rounds of expectation-maximisation count every url with words: those with a class as before, the others
in parts of ``1 / PARTS`` for both classes as the model of the round before has it. Parts are whole numbers, so sums
do not depend on their order.

A model's words have at most ``LETTERS`` letters together, whatever the number of rows: a word is held if its share of
all occurrences is at least its share of these letters. Words below that are rarer than one in eight million letters;
their occurrences count in the totals of the lexicon and of their classes.

Cases: a null url and one without ``://`` has an empty host and path; urls without words take the prior and
are allowed whatever it is. The prior is the share of block among urls with words (one is added to each
class). Equal urls get equal verdicts; of rules that fit, the longest wins (ties: the one that sorts first).
Names of any length are segmented whole, with words of every length that the lexicon has. Without rows the seeds
alone make the model.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, checkpoint, map_batches, texts

#: Letters that the words of a model have together, at most; names that a worker remembers.
LETTERS, REMEMBERED = 8 << 20, 50_000
#: Rounds of expectation-maximisation; parts of a url that are dealt out to the classes.
ROUNDS, PARTS = 3, 1 << 10
#: The query's rules: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that stand for a class before any counting.
SEEDS = {
    "block": "ads adult bet bonus casino cheap click crack credit deal discount farm free gambling lottery loan payday pharma pills poker porn promo replica spam slots track tracker viagra warez win xxx".split(),
    "allow": "about academy archive article blog book college community data docs edu forum gov guide health help history journal library museum news paper press research school science story support university wiki".split(),
}
#: Cost of a letter of an unknown word.
UNKNOWN = 2.5
#: Words of every host that say nothing.
COMMON = frozenset("www com net org http https html htm php example m".split())
_NAMES = re.compile(r"[a-z\u0080-\U0010ffff]+")
#: A tag, from its sign to the next one.
_TAG = re.compile(rb"<[^<>]*>?")
#: A-Z lower-cased; all ASCII characters but letters are blanks.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _low(text: str) -> str:
    return text.translate(_ASCII_LOW)


_ASCII_LOW = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return _low(host), slash + path


class Rules:
    """Rules by host, looked up by every suffix of a host's labels."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for some in self.by_host.values():
            some.sort(key=lambda x: (-len(x[0]), x[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while True:
            for prefix, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix):
                    if best is None or (-len(host + prefix), host + prefix) < (-len(best[0]), best[0]):
                        best = (host + prefix, verdict)
                    break
            _, dot, host = host.partition(".")
            if not dot:
                return best


@dataclass
class Segmenter:
    """Unigram Viterbi segmentation with a memory of names that is bounded."""

    counts: dict[str, int]
    rest: int = 0  # occurrences of words that are not held
    memory: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        self.total = sum(self.counts.values()) + self.rest + 1
        self.lengths = sorted({len(w) for w in self.counts}, reverse=True)

    def cost(self, word: str) -> float:
        n = self.counts.get(word)
        return math.log(self.total / n) if n else math.log(self.total) + UNKNOWN * len(word)

    def _best(self, name: str) -> list[str]:
        # an unknown word costs as much for each letter, and something more for each word, so it is never worth cutting
        best: list[tuple[float, int]] = [(0.0, 0)]
        unknown = math.log(self.total)
        open_ = (unknown, 0)  # the cheapest way to be within an unknown word, and where it began
        for end in range(1, len(name) + 1):
            open_ = (open_[0] + UNKNOWN, open_[1])
            known = [(best[a][0] + self.cost(name[a:end]), a) for a in (end - n for n in self.lengths if n <= end) if name[a:end] in self.counts]
            best.append(min([open_, *known]))
            open_ = min(open_, (best[end][0] + unknown, end))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def __call__(self, name: str) -> list[str]:
        if (found := self.memory.get(name)) is None:
            found = self._best(name)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[name] = found
        return found


def url_words(host: str, path: str, segment) -> list[str]:
    """Segmented words of the host and words of the path."""
    out = [w for name in _NAMES.findall(host) if name not in COMMON for w in segment(name)]
    return out + [w for w in _NAMES.findall(_low(path)) if w not in COMMON]


class Bayes:
    """Multinomial naive Bayes over the classes allow and block; ``rest`` are occurrences of words that are not held."""

    def __init__(self, counts: dict[str, dict[str, float]], prior: float, rest: dict[str, float] | None = None):
        words_ = {w for c in counts.values() for w in c}
        total = {k: sum(counts.get(k, {}).values()) + (rest or {}).get(k, 0) + len(words_) + 1 for k in SEEDS}
        self.weight = {w: math.log((counts["block"].get(w, 0) + 1) / total["block"]) - math.log((counts["allow"].get(w, 0) + 1) / total["allow"]) for w in words_}
        self.prior = math.log(prior / (1 - prior))

    def block(self, words_: list[str]) -> float:
        """The probability of block."""
        x = self.prior + sum(self.weight.get(w, 0.0) for w in words_)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _count(urls: DataFrame, tokens) -> DataFrame:
    """Rows (kind, word, n) over all urls (one column), counted in each batch before they are shuffled.

    ``tokens`` gives (kind, word) and how often of a url.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for url in batch.column(0).to_pylist():
            for key, n in tokens(url):
                counts[key] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "word", "n"])

    return map_batches(urls, run, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _held(counted: DataFrame, letters: int) -> tuple[dict[str, dict[str, int]], dict[str, int]]:
    """Counts by kind of the words that a model holds, and of all others together; "" as a word is always held.

    A word is held if n / total >= its length / letters, so those held have at most that many letters.
    """
    counted = checkpoint(counted)
    totals = {r.kind: r.n for r in counted.where("word <> ''").groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # a row for each kind
    every = counted.groupBy("word").agg(F.sum("n").cast("double").alias("all"))
    high = every.where((F.col("word") == "") | (F.col("all") * letters >= F.length("word") * F.lit(float(sum(totals.values())))))
    held = counted.join(high, "word", "left_semi")
    out: dict[str, dict[str, int]] = {}
    for batch in held.select("kind", "word", "n").toArrow().to_batches():
        for kind, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.setdefault(kind, {})[word] = n
    return out, {k: n - sum(c for w, c in out.get(k, {}).items() if w) for k, n in totals.items()}


def page_words(text: bytes) -> list[bytes]:
    """Words of a text or of a page without its tags, for the lexicon."""
    return (_TAG.sub(b" ", text) if b"<" in text else text).translate(_LETTERS).split()


def _count_pages(pages: DataFrame) -> DataFrame:
    """Rows (kind, word, n) of the words of all texts or pages (one column), counted in each batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text in texts(batch):
            counts.update(page_words(text))
        return pa.RecordBatch.from_arrays([pa.array([""] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "word", "n"])

    some = pages.select(F.coalesce(F.col(pages.columns[0]).cast("string"), F.lit("")).alias(TEXT))
    return map_batches(some, run, "kind string, word string, n long")


def _alone(url: str | None):
    host, path = split_url(url)
    for label in host.split("."):
        parts = _NAMES.findall(label)
        if len(parts) > 1:
            yield from ((("", w), 1) for w in parts)
    yield from ((("", w), 1) for w in _NAMES.findall(_low(path)))


def train(
    pages: DataFrame, url_col: str = "url", seeds: dict[str, list[str]] | None = None, words_of: DataFrame | None = None, letters: int = LETTERS, rounds: int = ROUNDS
) -> tuple[Segmenter, Bayes]:
    """The lexicon and the classifier, from all urls and the words of all texts given (one column: texts or pages in HTML).

    What reaches the driver in each round are words of at most ``letters`` letters together.
    """
    seeds = seeds or SEEDS
    every_seed = {w: k for k, some in seeds.items() for w in some}
    urls = pages.select(pages[url_col].cast("string").alias("url"))
    alone = _count(urls, _alone)
    if words_of is not None:
        alone = alone.unionByName(_count_pages(words_of)).groupBy("kind", "word").agg(F.sum("n").alias("n"))
    found, rest = _held(alone, letters)
    lexicon, rest = Counter(found.get("", {})), rest.get("", 0)
    lexicon.update(dict.fromkeys(every_seed, max(1, (sum(lexicon.values()) + rest) // 1000)))
    segmenter = Segmenter(dict(lexicon), rest)
    context = pages.sparkSession.sparkContext
    bayes = None
    for _ in range(rounds + 1):
        shared = context.broadcast((segmenter, bayes))  # words of at most ``letters`` letters each

        def by_class(url: str | None, shared=shared):
            segment, model = shared.value
            found = url_words(*split_url(url), segment)
            votes = Counter(every_seed[w] for w in found if w in every_seed)
            if votes["block"] != votes["allow"]:
                block = PARTS if votes["block"] > votes["allow"] else 0
            elif model is None or not found:
                return
            else:
                block = round(PARTS * model.block(found))
            for kind, n in (("block", block), ("allow", PARTS - block)):
                if n:
                    yield (kind, ""), n
                    yield from (((kind, w), n) for w in found)

        found, rest = _held(_count(urls, by_class), letters)
        mass = {k: found.get(k, {}).pop("", 0) / PARTS for k in seeds}
        counts = {k: dict.fromkeys(words_, 1.0) for k, words_ in seeds.items()}
        for kind, some in found.items():
            for w, n in some.items():
                counts[kind][w] = counts[kind].get(w, 0.0) + n / PARTS
        bayes = Bayes(counts, (mass["block"] + 1) / (sum(mass.values()) + 2), {k: n / PARTS for k, n in rest.items()})
        shared.unpersist()
    return segmenter, bayes


def judge(pages: DataFrame, segmenter: Segmenter, bayes: Bayes, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (of naive Bayes) and words of every url."""
    shared = pages.sparkSession.sparkContext.broadcast((segmenter, bayes, Rules(rules)))  # words of at most LETTERS letters each, and the rules given

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        segment, model, ruled = shared.value
        out = []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            found = url_words(host, path, segment)
            p = model.block(found)
            rule = ruled.find(host, path)
            out.append((host, path, rule and rule[0], rule[1] if rule else "block" if found and p > 0.5 else "allow", p, found))
        kinds = [pa.string()] * 4 + [pa.float64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], ["page_id", "host", "path", "rule", "verdict", "p_block", "words"])

    return map_batches(pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url")), run, "page_id long, host string, path string, rule string, verdict string, p_block double, words array<string>")


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    words_of = pages.select(F.col("html").cast("string").alias("text")).unionByName(table(spark, sf_dir, "documents").select(F.col("text").cast("string")))
    return judge(pages, *train(pages, words_of=words_of)).select("page_id", "host", "path", "rule", "verdict", "p_block")
