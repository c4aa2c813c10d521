"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pretoken's symbols lie in a linked list. Leaf i of the tree holds the rank of the pair that begins at symbol
i, so the root names the leftmost pair of lowest rank; each merge changes three leaves and their paths to the
root, until the root says that no pair can be merged. Nodes have ``WAYS`` children, so that the tree of a usual word
is its root.

Cases: a null text is an empty one and has no tokens. Special tokens of the vocabulary file are found in the
text as the tokenizers library finds them. Rows are judged one by one, so repeated rows get equal results and an
empty table an empty result; further columns are ignored. Texts of any length are encoded in blocks of
pretokens; a pretoken of any length takes n log n steps.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches, texts

#: Fixed value: the pattern that byte-level vocabularies split text by; white space by its Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
NONE, WAYS = 1 << 62, 16
#: Pretokens at once, pretokens of a generation that a worker remembers, and characters of the longest one remembered.
BLOCK, REMEMBERED, LONGEST = 200_000, 250_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, mapped to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _levels(leaves: list[int]) -> list[list[int]]:
    """A segment tree of WAYS children a node: the leaves, then the smallest of each node's children, up to one node."""
    levels = [leaves]
    while len(levels[-1]) > WAYS:
        below = levels[-1]
        levels.append([min(below[x : x + WAYS]) for x in range(0, len(below), WAYS)])
    return levels


def _update(levels: list[list[int]], x: int) -> None:
    """Carries a changed leaf up to the children of the root."""
    for below, above in zip(levels, levels[1:], strict=False):
        x //= WAYS
        if x < len(above):
            above[x] = min(below[x * WAYS : x * WAYS + WAYS])


class _Memory(dict):
    """Token ids of short pretokens, of a bounded number: a full generation becomes the old one, from which what is
    used again is taken over."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, pretoken: str) -> list[int]:
        ids = self.old.get(pretoken)
        if ids is None:
            ids = self.encoder.merge(pretoken.encode())
        if len(pretoken) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[pretoken] = ids
        return ids


class Encoder:
    """A vocabulary with its merges; what a worker remembers of pretokens lasts as long as the worker."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, n in vocab.items():
            self.bytes_of[n] = bytes(alphabet[c] for c in token)
        for token, n in self.special.items():
            self.bytes_of[n] = token.encode()
        self.byte_ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rank, self.made = {}, []
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 20 | vocab[right]] = n << 32
            self.made.append(vocab[left + right])
        # leaves of the pairs of two bytes
        self.first = [self.rank.get(a << 20 | b, NONE) for a in self.byte_ids for b in self.byte_ids]
        self.decimal = [str(n) for n in range(len(self.bytes_of))]
        self._start()

    def _start(self) -> None:
        self.find = regex.compile(PATTERN)
        self.find_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.memory = _Memory(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "find_special", "memory")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    @classmethod
    def load(cls, path: str) -> Encoder:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, pretoken: bytes) -> list[int]:
        """The token ids of one pretoken."""
        n = len(pretoken)
        ids = [self.byte_ids[b] for b in pretoken]
        if n < 2:
            return ids
        get, made, first = self.rank.get, self.made, self.first
        leaves = [first[a << 8 | b] | i for i, (a, b) in enumerate(zip(pretoken, pretoken[1:], strict=False))]
        levels = _levels(leaves)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := min(levels[-1])) < NONE:
            i = best & 0xFFFFFFFF
            j = after[i]
            ids[i] = new = made[best >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                leaves[i] = get(new << 20 | ids[k], NONE) | i
                leaves[j] = NONE
            else:
                leaves[i] = NONE
                if j < n - 1:
                    leaves[j] = NONE
            p = before[i]
            if p >= 0:
                leaves[p] = get(ids[p] << 20 | new, NONE) | p
            if len(levels) > 1:
                for x in {p, i, j} if p >= 0 else {i, j}:
                    _update(levels, x)
        return [x for x in ids if x >= 0]

    def _pieces(self, text: str) -> Iterator[str | int]:
        """Stretches without special tokens, and ids of special tokens."""
        at = 0
        if self.find_special and any(x in text for x in self.special):
            for m in self.find_special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()]
                yield self.special[m.group()]
                at = m.end()
        if at < len(text):
            yield text[at:] if at else text

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Token ids, a bounded number of pretokens at a time."""
        for piece in self._pieces(text):
            if isinstance(piece, int):
                yield [piece]
            elif len(piece) <= BLOCK:
                yield list(chain.from_iterable(map(self.memory.__getitem__, self.find.findall(piece))))
            else:
                found = (m.group() for m in self.find.finditer(piece))
                while some := list(islice(found, BLOCK)):
                    yield list(chain.from_iterable(map(self.memory.__getitem__, some)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw if raw.isascii() else raw.decode("utf-8", "replace").encode()


def default_path() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shared(docs: DataFrame, path: str | None):
    """The vocabulary as a broadcast; its size is that of one vocabulary file, whatever the documents."""
    return docs.sparkSession.sparkContext.broadcast(Encoder.load(path or default_path()))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token_ids array<int> of every document."""
    shared = _shared(docs, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = shared.value.encode
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array((encode(t.decode()) for t in texts(batch)), pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, token_ids array<int>")


def encode_checked(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip: whether decoding gives the text back."""
    shared = _shared(docs, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, bodies = shared.value, texts(batch)
        ids = [encoder.encode(t.decode()) for t in bodies]
        same = [encoder.decode(i) == t for i, t in zip(ids, bodies, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_documents(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text; null token_ids decode to an empty text, ids that the vocabulary lacks are an error."""
    shared = _shared(tokens, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = shared.value.decode
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(ids or []).decode() for ids in batch.column(1).to_pylist()])], ["doc_id", "text"])

    return map_batches(tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")), run, "doc_id long, text string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    shared = _shared(docs, None)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = shared.value
        counts, of_ids, of_text = [], [], []
        for text in texts(batch):
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in encoder.blocks(text.decode()):
                if ids:
                    ids_hash.update((("," if n else "") + ",".join(map(encoder.decimal.__getitem__, ids))).encode())
                    text_hash.update(encoder.decode(ids))
                    n += len(ids)
            counts.append(n)
            of_ids.append(ids_hash.hexdigest())
            of_text.append(text_hash.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(id_and_text(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
