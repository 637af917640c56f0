"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams (1 to 3 bytes,
letters in lower case) predicts each of its bits. Decoding weighs the classifiers' losses: the
language whose codeword costs least is chosen, and a small gap to the next one flags the
document as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import crc_fold, give_back, lean
from tidepanel.llm.textkernel import slices

#: Hashed features of a text.
FEATURES = 4096
#: Labelled documents of a language that the classifiers are fitted on, at most.
#: All languages together get at most FIT_ROWS documents, but each LEAST_ROWS if it has them.
PER_LANGUAGE, FIT_ROWS, LEAST_ROWS = 400, 2000, 5
#: Strength of the ridge penalty.
RIDGE = 0.3
#: A document is ambiguous if its score is below.
AMBIGUOUS = 0.6
#: Steepness of the loss of a classifier's output.
STEEP = 3.0

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _FOLD[_c - 32] = _c
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def codewords(languages: int) -> np.ndarray:
    """(languages x bits) of -1 and 1: all splits of up to 6 languages, else a fixed dense code."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 6:
        bits = range(1, 1 << (languages - 1))
        return np.array([[1 if bit >> k & 1 else -1 for bit in bits] for k in range(languages)], float)
    draw = np.random.default_rng(0)
    bits = 15 * math.ceil(math.log2(languages))
    best = max((draw.choice([-1.0, 1.0], (languages, bits)) for _ in range(max(2, min(50, 10**8 // languages**2)))), key=lambda code: -np.max(code @ code.T - np.diag(np.full(languages, bits + 1))))
    return best[:, np.abs(best.sum(axis=0)) < languages]


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts x FEATURES) square roots of the shares of hashed 1- to 3-grams."""
    rows, low = len(at) - 1, _FOLD[raw]
    if len(raw) > 1:  # capitals of Latin letters with marks, U+00C0 to U+00DE
        marked = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
        low[1:][marked] += 0x20
    owner = np.repeat(np.arange(rows), np.diff(at))
    # runs of other bytes count as one space
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0x20) | (low[:-1] != 0x20) | (owner[1:] != owner[:-1])
    low, owner = low[keep].astype(np.uint32), owner[keep]
    found = np.zeros(rows * FEATURES)
    for n in (1, 2, 3):
        m = len(low) - n + 1
        if m <= 0:
            continue
        gram = np.full(m, n, np.uint32)
        for i in range(n):
            gram = gram << np.uint32(8) | low[i : m + i]
        within = owner[:m] == owner[n - 1 :]
        slot = (gram * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
        found += np.bincount((owner[:m] * FEATURES + slot)[within], minlength=rows * FEATURES)
    found = found.reshape(rows, FEATURES)
    return np.sqrt(found / np.maximum(found.sum(axis=1, keepdims=True), 1))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, at in slices(batch.column(1), 1 << 18):
            x = features(raw, at).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "place", "x"])


class Model:
    """Ridge classifiers of the codewords' bits, every language weighing the same. ``x`` is overwritten."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        self.w, self.shift = np.zeros((FEATURES, self.code.shape[1])), np.zeros(self.code.shape[1])
        if not len(x):
            return
        mean, goal = x.mean(axis=0), self.code[y]
        weight = np.sqrt(len(y) / len(languages) / np.bincount(y, minlength=len(languages))[y])[:, None]
        level = np.average(goal, axis=0, weights=weight[:, 0] ** 2)
        x -= mean
        x *= weight
        goal = (goal - level) * weight
        if len(x) <= FEATURES:
            self.w = x.T @ np.linalg.solve(x @ x.T + RIDGE * np.eye(len(x)), goal)
        else:  # the same weights from the smaller system
            self.w = np.linalg.solve(x.T @ x + RIDGE * np.eye(FEATURES), x.T @ goal)
        self.shift = level - mean @ self.w

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the chosen language, score): loss-weighted decoding."""
        out = x @ self.w + self.shift
        plus = self.code > 0
        loss = (np.logaddexp(0, -2 * STEEP * out) @ plus.T + np.logaddexp(0, 2 * STEEP * out) @ ~plus.T) / self.code.shape[1]
        share = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        return share.argmax(axis=1), share.max(axis=1)


def fit(docs: DataFrame, parts: int = 4, held: int = 2) -> Model:
    """Fit on at most PER_LANGUAGE documents a language: those of least hash among the learning fold. A repeated row counts once."""
    rows = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        (crc_fold(F.col("d"), parts) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    top = 1 << 30
    keyed = rows.withColumn("k", F.xxhash64("d", "text")).withColumn("h", F.pmod("k", F.lit(top)))
    sizes = {r.lang: max(1, r.n) for r in keyed.groupBy("lang").agg(F.approx_count_distinct("k").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, FEATURES)), np.zeros(0, int))
    most = min(PER_LANGUAGE, max(LEAST_ROWS, FIT_ROWS // len(languages)))
    # a language's share of the hash range leaves somewhat more than are wanted; sizes are known to some 5 %
    cuts = docs.sparkSession.createDataFrame([(k, int(min(1.0, 1.3 * (most + 6 * math.sqrt(most) + 6) / n) * top)) for k, n in sizes.items()], "of string, cut long")
    chosen = keyed.join(F.broadcast(cuts), F.col("lang") == F.col("of")).where(F.col("h") < F.col("cut"))
    once = chosen.groupBy("lang", "k").agg(F.any_value("text").alias("text"), F.any_value("h").alias("h"))
    # only what is fitted on is sent: a language has at most so many rows here as its cut leaves
    least = once.withColumn("place", F.expr("row_number() over (partition by lang order by h, k)")).where(F.col("place") <= most)
    got = least.select("lang", "text", "place").mapInArrow(lambda it: lean(_sampled(it)), "lang string, place int, x binary").toArrow()
    number = {k: i for i, k in enumerate(languages)}
    order = sorted(range(len(got)), key=list(zip(got["lang"].to_pylist(), got["place"].to_pylist(), strict=True)).__getitem__)
    x, y = np.empty((len(got), FEATURES)), np.array([number[got["lang"][i].as_py()] for i in order], int)
    for row, i in enumerate(order):
        x[row] = np.frombuffer(got["x"][i].as_buffer(), "<f4")
    del got
    model = Model(languages, x, y)
    del x
    give_back(docs.sparkSession)
    return model


def _predicted(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, "und"], object)
    for batch in batches:
        for first, end, raw, at in slices(batch.column(1), 1 << 20):
            total = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int64)])
            letters = total[at[1:]] > total[at[:-1]]
            for i in np.flatnonzero(~letters).tolist():
                letters[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
            if model.languages:
                which, score = model(features(raw, at))
            else:
                which, score = np.zeros(len(at) - 1, int), np.zeros(len(at) - 1)
                letters[:] = False
            which[~letters], score[~letters] = len(model.languages), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(names[which].tolist(), pa.string()), pa.array(score)], ["row", "lang_pred", "score"])


def identify(docs: DataFrame, parts: int = 4, held: int = 2, ambiguous: float = AMBIGUOUS, carry: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text.

    Reads doc_id, text and lang of ``docs``; learns only from text and non-null lang of rows with
    crc32(doc_id as text) mod ``parts`` not ``held``. Returns doc_id, held_out (false for a null
    doc_id), lang_pred, score (0 to 1) and ambiguous (lang_pred is ``und`` or the score is low), a
    row for each row, and carried, a struct of the columns of ``carry`` as they are. A text that is null or without a letter, and every text if nothing
    could be learned, is ``und`` with score 0. Every language with a document to learn from can be predicted. Other
    columns are ignored; repeated rows are kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, parts, held))
    carry = carry or []
    row = F.struct(F.col("doc_id").alias("doc_id"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    named = rows.mapInArrow(lambda it: lean(_predicted(it, model.value)), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return named.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(crc_fold(F.col("row.doc_id"), parts) == held, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        ((F.col("lang_pred") == "und") | (F.col("score") < ambiguous)).alias("ambiguous"),
        *([F.struct(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(carry))).alias("carried")] if carry else []),
    )
