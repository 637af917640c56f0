"""Quality rules: counts of every text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte 4-grams: one of trusted target texts,
one of the raw corpus. It is divided by the number of 4-grams, and a document is kept if
that is not below a threshold. The threshold is what all but a small share of trusted documents
reach that the target was not made of: nothing is drawn at random. The raw counts cover every
document, the target's every trusted one that is not held out, and the threshold every one that is.
Trusted ids stay in tables: only bins reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import crc_fold, lean, materialize
from tidepanel.llm.textkernel import SPACE, fold, mix, slices, word_bounds, word_hashes

_U = np.uint64
#: Length of the hashed n-grams in bytes, and bits of their hash.
GRAM, BITS = 4, 16
#: Weight, in 4-grams, of the corpus as prior of the target; and what each bin of the corpus starts from.
PRIOR, LEAST = 65536.0, 0.01
#: Neighbouring bins whose counts share a row, so that a task gives a thousand rows and not one for each bin.
CELLS = [f"c{i}" for i in range(64)]
#: Words of 64 marks that tell texts which may be trusted from most others before any is shuffled; exact joins follow.
WORDS = 1 << 19
#: Share of held-out trusted documents that the threshold keeps; those with crc32(doc_id as text) mod HELD_PARTS = HELD are held out.
KEEP, HELD_PARTS, HELD = 0.98, 4, 2
#: The threshold at most, and without held-out trusted documents: as likely in the target as in the corpus.
THRESHOLD = 0.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _bins(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the 4-gram that starts at each byte, and whether it ends in the same text."""
    if len(raw) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    n = len(raw) - GRAM + 1
    gram = np.zeros(n, np.uint32)
    for i in range(GRAM):
        gram = gram << np.uint32(8) | raw[i : n + i]
    gram *= np.uint32(2654435761)
    inside = np.ones(n, bool)
    for edge in range(1, GRAM):  # starts within three bytes of a text's end
        last = at[1:] - edge
        inside[last[(last >= 0) & (last < n)]] = False
    return gram >> np.uint32(32 - BITS), inside


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, _, raw, at in slices(batch.column(0)):
            bins, inside = _bins(raw, at)
            total += np.bincount(bins[inside], minlength=1 << BITS)
    total = total.reshape(-1, len(CELLS))
    seen = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(total[seen, i]) for i in range(len(CELLS)))], ["block", *CELLS])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """4-grams of all ``texts`` by bin."""
    counts = texts.select("text").mapInArrow(lambda it: lean(_counted(it)), "block long, " + ", ".join(f"{c} long" for c in CELLS))
    rows = counts.groupBy("block").agg(*(F.sum(c).alias(c) for c in CELLS)).toPandas()  # 2 ** BITS counts
    total = np.zeros(((1 << BITS) // len(CELLS), len(CELLS)), np.int64)
    total[rows["block"].to_numpy(np.int64)] = rows[CELLS].to_numpy(np.int64)
    return total.ravel()


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers in the order of the doubles, and back."""
    return bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)


def _ranged(batches: Iterable[pa.RecordBatch], shift: int, within: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _ordered(batch.column(0).to_numpy(zero_copy_only=False).view(np.int64))
        if within is not None:
            keys = keys[keys >> (shift + 16) == within]
        bins, n = np.unique(keys >> shift, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n.astype(np.int64))], ["bin", "n"])


def reached_by(scores: DataFrame, share: float) -> float | None:
    """The greatest value that ``share`` of the rows of a column of doubles reach; None without rows.

    Exact: four rounds count the next 16 bits of the values that share the bits found before.
    """
    within = below = None
    for shift in (48, 32, 16, 0):
        counts = scores.mapInArrow(lambda it, s=shift, w=within: _ranged(it, s, w), "bin long, n long")
        rows = counts.groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")  # 2 ** 16 rows at most
        bins, n = rows["bin"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        if below is None:  # rows below the value
            if not len(bins):
                return None
            below = int(n.sum()) - max(1, math.ceil(share * int(n.sum())))
        ends = np.cumsum(n)
        at = int(np.searchsorted(ends, below, "right"))
        within, below = int(bins[at]), below - int(ends[at] - n[at])
    return float(_ordered(np.array([within], np.int64)).view(np.float64)[0])


def base_counts(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, first = word_bounds(raw, at)
    rows = len(at) - 1
    owner = np.repeat(np.arange(rows), np.diff(first)).astype(_U)
    found = {
        "n_words": np.diff(first),
        "word_chars": _row_sums((~SPACE[raw] & ((raw & 0xC0) != 0x80)).astype(np.int64), at),
        "n_symbols": _row_sums(_SYMBOL[raw].astype(np.int64), at),
    }

    # lines end at \n and at the end of their text
    breaks = np.flatnonzero(raw == 0x0A)
    line_start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    line_end = np.append(line_start[1:], len(raw))
    filled = np.searchsorted(start, line_end, "left") > np.searchsorted(start, line_start, "left")
    line_start, line_end = line_start[filled], line_end[filled]
    ends_in_break = (line_end > line_start) & (raw[line_end - 1] == 0x0A) if len(raw) else np.zeros(0, bool)
    of = (np.searchsorted(at, line_start, "right") - 1).astype(_U)
    keys = mix(word_hashes(raw, line_start, line_end - ends_in_break, lower=False) ^ mix(of + _U(1)))
    _, one = np.unique(keys, return_index=True)
    count = lambda owners: np.bincount(owners.astype(np.int64), minlength=rows)
    found["n_dup_lines"] = count(of) - count(of[one])

    windows = fold(word_hashes(raw, start, end, lower=False), 3)
    within = owner[: len(windows)] == owner[2:] if len(windows) else np.zeros(0, bool)
    place = np.flatnonzero(within)
    _, which, times = np.unique(mix(windows[place] ^ mix(owner[place] + _U(1))), return_inverse=True, return_counts=True)
    again = place[times[which] > 1]
    covered = np.zeros(len(start), bool)
    for i in range(3):
        covered[again + i] = True
    found["n_repeat_words"] = count(owner[covered])
    return {k: v.astype(np.int64) for k, v in found.items()}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(batches: Iterable[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, at in slices(batch.column(1)):
            counts = base_counts(raw, at)
            bins, inside = _bins(raw, at)
            score = np.zeros(len(raw))
            score[: len(bins)][inside] = weights[bins[inside]]
            total = np.array([score[a:b].sum() for a, b in zip(at[:-1], at[1:], strict=True)])
            grams = np.maximum(np.diff(at) - GRAM + 1, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), *(pa.array(counts[c]) for c in COUNTS), pa.array(total / grams)],
                ["doc_id", *COUNTS, "score"],
            )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all trusted documents: quality 1 in all their labels."""
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least")).where("least = 1 and doc_id is not null").select("doc_id")


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose doc_id is one of ``ids``.

    Only rows whose hash is marked by an id are shuffled: all that have one, and of the others a
    quarter with 10 million ids, more with more of them.
    """
    word, mark = f"xxhash64(doc_id) & {WORDS - 1}L", "shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), 58) as int))"
    marks = ids.groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or({mark})").alias("marks"))  # WORDS rows at most
    # a semi-join: the next one would be moved in front of an inner one
    likely = texts.join(F.broadcast(marks), F.expr(f"word = ({word}) and (marks & {mark}) != 0"), "left_semi")
    return likely.join(ids.hint("merge"), "doc_id", "left_semi")


def quality(docs: DataFrame, labels: DataFrame, threshold: float | None = None, keep: float = KEEP) -> DataFrame:
    """Rule counts and verdict for every document.

    Reads doc_id (long) and text of ``docs`` and doc_id and quality of ``labels``; other columns
    are ignored. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 50 words, or over half of them in repeated 3-word windows), score
    (mean log-likelihood ratio of its 4-grams; 0 for texts of less than 4 bytes) and kept
    (not base_failed and score >= threshold), a row for each row. Where no ``threshold`` is given, it is
    the greatest score that ``keep`` of the held-out trusted documents reach that pass the base rules, but THRESHOLD at most and if
    there are none: what is likelier in the target than in the corpus is never dropped for its score. A null text is empty, and so fails the base rules. Without any trusted document all scores are 0. A null doc_id is
    kept as null. Repeated rows count as often as they stand there.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # written, so that the joins can be dealt anew on their other side
    trusted = materialize(trusted_ids(labels))
    held = crc_fold(F.col("doc_id"), HELD_PARTS) == HELD
    corpus = gram_counts(texts) + LEAST
    corpus /= corpus.sum()
    target = gram_counts(of_ids(texts.where(~held), trusted.where(~held)))
    # without a target the ratio is 1 throughout
    weights = spark.sparkContext.broadcast(np.log((target + PRIOR * corpus) / (target.sum() + PRIOR)) - np.log(corpus))
    scored = texts.mapInArrow(lambda it: lean(_scored(it, weights.value)), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = scored.select("doc_id", *COUNTS, failed.alias("base_failed"), "score")
    if threshold is None:
        judged = materialize(judged)
        passed = judged.where(~F.col("base_failed") & held).groupBy("doc_id").agg(F.min("score").alias("score"))
        reached = reached_by(materialize(passed.join(trusted, "doc_id", "left_semi").select("score")), keep)
        threshold = THRESHOLD if reached is None else min(THRESHOLD, reached)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
