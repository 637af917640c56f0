"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token can end its encoding: the one that,
of all tokens that are suffixes of the prefix (found by an automaton over the vocabulary), is
compatible with the last token of what stands before it. Two tokens are compatible if the
merge rules, run over their bytes, give the two back. So the last token of each prefix is
stored, and back-pointers from the end give the ids, in time linear in the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import lean

# The published pattern that cuts text into pieces before byte-level merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces and pairs whose answers a worker keeps; a full store is emptied, which costs only time.
KEPT_PIECES, KEPT_PAIRS, LONGEST_KEPT = 200_000, 200_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Known(dict):
    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, key):
        found = self.find(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = found
        return found


class Encoder:
    """Encodes and decodes with the vocabulary of a tokenizers file (byte-level BPE, no normaliser)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: A token's order: bytes are 0 to 255, then the merges as they are ranked.
        order = {c: b for c, b in letters.items()}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        names = sorted(letters, key=letters.get)
        for a, b in merges:
            pair = (order[a], order[b])
            if a + b not in order:
                order[a + b] = len(self.halves)
                self.halves.append(pair)
                names.append(a + b)
            self.pairs.setdefault(pair, order[a + b])
        self.ids = np.array([vocab.get(name, -1) for name in names], "<u4")
        self.automaton = ahocorasick.Automaton()
        for k, name in enumerate(names):
            raw = "".join(chr(letters[c]) for c in name)
            self.automaton.add_word(raw, (k, len(raw)))
        self.automaton.make_automaton()
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for name, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in name)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(PIECES)
        self.known, self.fitting = _Known(self._piece), {}

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when a stands before b.

        Undo merges at the seam, the latest first; if what then meets there could merge
        earlier than the merge just undone, the seam would not survive. Of equal merges the
        left one comes first.
        """
        before = len(self.halves)
        while True:
            merged = self.pairs.get((a, b))
            if merged is not None and merged < before:
                return False
            if max(a, b) < 256:
                return True
            if a > b:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode().decode("latin-1")
        last = [-1] * (len(raw) + 1)
        size = [0] * (len(raw) + 1)
        fitting = self.fitting
        if len(fitting) > KEPT_PAIRS:
            fitting.clear()
        for end, (token, length) in self.automaton.iter(raw):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                pair = (last[start], token)
                fits = fitting.get(pair)
                if fits is None:
                    fits = fitting[pair] = self._fit(*pair)
                if not fits:
                    continue
            last[end], size[end] = token, length
        found, end = [], len(raw)
        while end:
            found.append(last[end])
            end -= size[end]
        return self.ids[found[::-1]].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        known = self.known.__getitem__
        if self.added_pattern is None or not any(x in text for x in self.added):
            return b"".join(map(known, self.pieces.findall(text)))
        parts = self.added_pattern.split(text)
        return b"".join(self.added[p] if p in self.added else b"".join(map(known, self.pieces.findall(p))) for p in parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, column: str = "text", decoded: bool = True) -> DataFrame:
    """Token ids of every whole text, and what they decode to.

    Reads doc_id and ``column`` of ``docs``; other columns are ignored. Returns doc_id as it is,
    ids (binary, little-endian unsigned 32-bit integers), n_tokens (long) and, if asked for,
    decoded (string, equal to the text). A null text is an empty one: no ids. Strings of
    added tokens in a text become those tokens. Repeated rows are kept; no row gives none.
    ``path`` names the vocabulary file on every machine that runs Python workers.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids = [coder.encode(t.as_py() or "") for t in part.column(1)]
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array(map(coder.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "decoded"][: len(columns)])
        # a worker that goes on to other work should not hold the vocabulary
        _encoders.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(column).cast("string").alias("text")).mapInArrow(lambda it: lean(work(it)), f"doc_id {kind}, ids binary, n_tokens long" + ", decoded string" * decoded)
