"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and unigrams and a uniform one. The
mixture weights depend on how frequent the context is (buckets by powers of two), and
expectation-maximisation learns them on part of the training documents, each event judged by
counts from which that part is deleted.

Counting and looking up are one exchange. Documents are dealt into blocks of about BLOCK_BYTES.
A block asks for its distinct n-grams, sorted, one row for each range of n-gram hashes; a range
adds up what all blocks have sent and answers every one in its own order, so that no n-gram
is sent back and a frequent one costs a block one entry. The answers go back to their blocks,
where the texts are read again and leave the counts of each of their tokens. There are as many ranges as blocks,
but a block sends to 2 ** STEP_BITS at most: beyond that, what as many blocks have sent to one range is added up
as if it were a block's, and sent on to parts of the range, and the answers come back the same way. So rows grow in
proportion to the blocks, as an exchange more is made for each factor of 2 ** STEP_BITS, and every task holds about a block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import crc_fold, lean, materialize, release
from tidepanel.llm.textkernel import mix, slices, word_bounds, word_hashes

_U = np.uint64
#: Bytes of text in a block; bits of an n-gram's hash that choose its range in one exchange, at most.
BLOCK_BYTES, STEP_BITS = 8 << 20, 12
#: One in so many training documents teaches the mixture weights.
FOLD = 10
#: Buckets of context frequency, bins an octave of the probabilities that weights are learned from, rounds of learning.
BUCKETS, BINS, ROUNDS = 16, 8, 60
#: Least weight of the uniform estimate.
LEAST = 1e-4

#: Bytes of a hash that are sent, of tokens and of pairs; its leading bits are known from the range.
_WIDTH = (7, 6)
_BEGIN, _END = _U(0x6A09E667F3BCC909), _U(0xBB67AE8584CAA73B)
_ASKED = "block long, kind int, part long, keys binary, train binary, learn binary"
_ANSWERS = "block long, kind int, part long, train binary, learn binary, v long, n long"
_STREAM = "block long, doc_id long, fold int, times long, n_tokens long, n_known long, tokens binary, pairs binary, fold_tokens binary, fold_pairs binary, ends long, fold_ends long, v long, n long"
_STREAM_NAMES = [c.split(" ")[0] for c in _STREAM.split(", ")]
_OUT, _TRAIN, _LEARN = 0, 1, 2


class _Text:
    """Tokens of some documents: distinct ones and distinct pairs, sorted, and where each token is among them."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        words, counts = [], []
        for _, _, raw, at in slices(texts):
            start, end, first = word_bounds(raw, at)
            words.append(word_hashes(raw, start, end, lower=True))
            counts.append(np.diff(first))
        counts = np.concatenate(counts) + 1  # each document's words and its end
        rows = np.arange(len(counts))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        token = np.empty(int(counts.sum()), _U)
        ends = self.first[1:] - 1
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner], token[ends] = np.concatenate(words), _END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first[:-1]] = _BEGIN
        self.owner = np.repeat(rows, np.diff(self.first))
        self.keys = [np.unique(token, return_inverse=True), np.unique(mix(before * _U(0x9E3779B97F4A7C15) + token), return_inverse=True)]


def _cut(keys: np.ndarray, bits: int, top: int = 64) -> list[tuple[int, int, int]]:
    """(range, first, end) of keys, sorted by their lowest ``top`` bits, by the leading ``bits`` of these."""
    parts = (keys >> _U(top - bits) & _U((1 << bits) - 1)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]]) if len(parts) else np.zeros(1, int)
    return [(int(parts[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


#: Widths of counts, each for those that do not fit the one before.
_WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as single bytes; the full byte stands for those that follow as 2, then as 4, then as 8 bytes. Bytes of
    equal weight stand together, which compresses well."""
    found, rest = [], counts
    for kind in _WIDTHS:
        most = min(np.iinfo(kind).max, np.iinfo(np.int64).max)
        found.append(np.minimum(rest, most).astype(kind).view(np.uint8).reshape(len(rest), np.dtype(kind).itemsize).T.tobytes())
        rest = rest[rest >= most]
    return b"".join(found)


def _wide(data: bytes, n: int) -> np.ndarray:
    found, at = [], 0
    for kind in _WIDTHS:
        size = np.dtype(kind).itemsize
        part = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        found.append(part)
        at += n * size
        n = int((part == np.iinfo(kind).max).sum())
    value = np.zeros(0, np.int64)
    for part in found[::-1]:
        out = part.astype(np.int64)
        out[part == np.iinfo(part.dtype).max] = value
        value = out
    return value


def _pressed(counts: np.ndarray) -> bytes:
    return zlib.compress(_narrow(counts), 1)


def _freed(data: bytes, n: int) -> np.ndarray:
    return _wide(zlib.decompress(data), n)


def _table(columns: list[list], names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [c.split(" ") for c in names.split(", ")]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, types, strict=True)], [n for n, _ in types])


def _requests(node: int, kind: int, part: int, keys: np.ndarray, counts: list[np.ndarray], bits: int, top: int) -> list[tuple]:
    """A row of _ASKED for each of the ranges of ``part`` that sorted ``keys`` fall into."""
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _WIDTH[kind]]
    return [(node, kind, part << bits | sub, raw[a:b].tobytes(), *(_pressed(c[a:b]) for c in counts)) for sub, a, b in _cut(keys, bits, top)]


def _ask(docs: pa.Table, bits: int) -> pa.Table:
    """Requests of a block. Tokens send 56 bits, pairs 48, besides those of their range."""
    rows: list[tuple] = []
    if len(docs):
        text = _Text(docs["text"])
        fold, times = (docs[c].to_numpy()[text.owner] for c in ("fold", "times"))
        for kind, (keys, where) in enumerate(text.keys):
            counts = [np.bincount(where, times * of, len(keys)).astype(np.int64) for of in (fold != _OUT, fold == _LEARN)]
            rows += _requests(docs["block"][0].as_py(), kind, 0, keys, counts, bits, 64)
    return _table([[r[i] for r in rows] for i in range(6)], _ASKED)


def _summed(asked: pa.Table) -> tuple[int, list[int], np.ndarray, np.ndarray, list[np.ndarray]]:
    """(kind, keys a row, distinct keys, where each row's keys are among them, sums of their counts) of requests to one range."""
    kind = asked["kind"][0].as_py()
    parts = [np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, _WIDTH[kind]) for k in asked["keys"]]
    sizes = [len(p) for p in parts]
    padded = np.zeros((sum(sizes), 8), np.uint8)
    np.concatenate(parts, out=padded[:, : _WIDTH[kind]])
    keys, where = np.unique(padded.view("<u8").ravel(), return_inverse=True)
    found = []
    for name in ("train", "learn"):
        counts = np.concatenate([_freed(c.as_py(), n) for c, n in zip(asked[name], sizes, strict=True)])
        found.append(np.bincount(where, counts, len(keys)).astype(np.int64))
    return kind, sizes, keys, where, found


def _replies(asked: pa.Table, sizes: list[int], where: np.ndarray, found: list[np.ndarray]) -> list[list]:
    """Columns of _ANSWERS: sums for each row of ``asked``, in its own order."""
    ends = np.cumsum(sizes)
    out = [[_pressed(total[where[e - n : e]]) for e, n in zip(ends, sizes, strict=True)] for total in found]
    zero = [0] * len(sizes)
    return [*(asked[c].to_pylist() for c in ("block", "kind", "part")), *out, zero, list(zero)]


def _answer(asked: pa.Table) -> pa.Table:
    """Sums of a range, for each that asked; for tokens a row of totals, too."""
    kind, sizes, _, where, found = _summed(asked)
    columns = _replies(asked, sizes, where, found)
    if not kind:
        for column, value in zip(columns, (-1, 0, asked["part"][0].as_py(), b"", b"", int((found[0] > 0).sum()), int(found[0].sum())), strict=True):
            column.append(value)
    return _table(columns, _ANSWERS)


def _pass_on(asked: pa.Table, bits: int, top: int) -> pa.Table:
    """Requests of a bundle of nodes to parts of the range that they asked."""
    kind, _, keys, _, found = _summed(asked)
    rows = _requests(asked["bundle"][0].as_py(), kind, asked["part"][0].as_py(), keys, found, bits, top)
    return _table([[r[i] for r in rows] for i in range(6)], _ASKED)


def _bring_back(asked: pa.Table, answers: pa.Table, bits: int, used: int) -> pa.Table:
    """Answers to the nodes of a bundle from the answers to it; totals as they are."""
    if not len(asked):
        return answers.select([c.split(" ")[0] for c in _ANSWERS.split(", ")])
    kind, sizes, keys, where, _ = _summed(asked)
    at = {p: i for i, p in enumerate(answers["part"].to_pylist())}
    part = asked["part"][0].as_py()
    found = [
        np.concatenate([_freed(answers[name][at[part << bits | sub]].as_py(), b - a) for sub, a, b in _cut(keys, bits, 8 * _WIDTH[kind] - used)])
        for name in ("train", "learn")
    ]
    return _table(_replies(asked, sizes, where, found), _ANSWERS)


def _answers(asked: DataFrame, before: int, steps: list[int], used: int = 0) -> DataFrame:
    """Answers to ``asked``, which was cut by ``before`` bits, over as many more exchanges as there are ``steps``."""
    if not steps:
        return asked.groupBy("kind", "part").applyInArrow(_answer, _ANSWERS)
    bits = steps[0]
    bundled = asked.withColumn("bundle", F.shiftright("block", before))
    own = bundled.groupBy("kind", "part", "bundle")
    tops = [8 * w - used for w in _WIDTH]
    passed = own.applyInArrow(lambda t: _pass_on(t, bits, tops[t["kind"][0].as_py()]), _ASKED)
    found = _answers(passed, bits, steps[1:], used + bits).withColumn("parent", F.shiftright("part", bits))
    return own.cogroup(found.groupBy("kind", "parent", "block")).applyInArrow(lambda a, f: _bring_back(a, f, bits, used), _ANSWERS)


def _steps(blocks: int, most: int) -> list[int]:
    """Bits of each exchange, as equal as can be and none above ``most``, that lead to about as many ranges as ``blocks``."""
    bits = math.ceil(math.log2(blocks))
    n = max(1, -(-bits // most))
    return [bits // n + (i < bits % n) for i in range(n)]


def _stream(docs: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """Counts of each token and of each pair of a block's documents, in the order of the text."""
    columns: list[list] = [[] for _ in _STREAM_NAMES]
    if not len(docs):  # the totals
        for column, value in zip(columns, (-1, None, -1, 0, 0, 0, b"", b"", b"", b"", 0, 0, sum(answers["v"].to_pylist()), sum(answers["n"].to_pylist())), strict=True):
            column.append(value)
    else:
        text = _Text(docs["text"])
        block = docs["block"][0].as_py()
        ids, fold, times = (docs[c].to_pylist() for c in ("doc_id", "fold", "times"))
        at = {(k, p): i for i, (k, p) in enumerate(zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), strict=True))}
        counts: list[list[np.ndarray]] = []
        end = int(np.searchsorted(text.keys[0][0], _END))
        ends = []
        for name in ("train", "learn"):
            row = []
            for kind, (keys, where) in enumerate(text.keys):
                total = np.concatenate([_freed(answers[name][at[kind, part]].as_py(), b - a) for part, a, b in _cut(keys, bits)])
                if not kind:
                    ends.append(int(total[end]))
                row.append(total[where])
            counts.append(row)
        known = np.bincount(text.owner, counts[0][0] > 0, len(ids)).astype(np.int64)
        for i, (a, b) in enumerate(zip(text.first[:-1], text.first[1:], strict=True)):
            learn = [_narrow(c[a:b]) for c in counts[1]] if fold[i] == _LEARN else [b"", b""]
            row = (block, ids[i], fold[i], times[i], int(b - a), int(known[i]), *(_narrow(c[a:b]) for c in counts[0]), *learn, *ends, 0, 0)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
    release()
    return _table(columns, _STREAM)


def _contexts(tokens: np.ndarray, begin: int) -> np.ndarray:
    """How often what stands before each token does: a text's begin as often as ends."""
    return np.concatenate([[begin], tokens[:-1]])


def _bucket(contexts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(contexts + 1).astype(np.int64), BUCKETS - 1)


def _bins(batches: Iterable[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """Events of the learning part by bucket and by the logarithms of their two estimates."""
    for batch in batches:
        parts, weights = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
        for row in batch.to_pylist():
            n = row["n_tokens"]
            tokens, pairs, minus_tokens, minus_pairs = (_wide(row[c], n) for c in ("tokens", "pairs", "fold_tokens", "fold_pairs"))
            context = _contexts(tokens - minus_tokens, row["ends"] - row["fold_ends"])
            places = [_bucket(context)]
            for count, of in ((pairs - minus_pairs, context), (tokens - minus_tokens, np.full(n, max(total, 1)))):
                place = np.zeros(n, np.int64)
                some = (count > 0) & (of > 0)
                place[some] = 1 + np.round(np.log2(of[some] / count[some]) * BINS).astype(np.int64).clip(0)
                places.append(place)
            parts.append(np.stack(places, 1))
            weights.append(np.full(n, row["times"]))
        found, where = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        times = np.bincount(where.ravel(), np.concatenate(weights), len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(3)), pa.array(times)], ["bucket", "two", "one", "times"])


def learn_weights(bins: np.ndarray, uniform: float) -> np.ndarray:
    """(BUCKETS x 3) weights of pair, token and uniform estimate by expectation-maximisation over
    rows (bucket, bin of the pair's estimate, bin of the token's, times). Buckets without events take all events' weights."""
    value = lambda b: np.where(b > 0, 2.0 ** (-(b - 1) / BINS), 0.0)

    def learned(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        estimates = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), uniform)], 1)
        weights = start
        for _ in range(ROUNDS):
            shares = estimates * weights
            shares /= shares.sum(axis=1, keepdims=True)
            weights = (shares * rows[:, 3:]).sum(axis=0)
            weights /= weights.sum()
            weights = np.maximum(weights, [0, LEAST, LEAST])
            weights /= weights.sum()
        return weights

    start = np.array([0.3, 0.6, 0.1])
    if len(bins):
        start = learned(bins, start)
    return np.stack([learned(own, start) if len(own := bins[bins[:, 0] == b]) else start for b in range(BUCKETS)])


def _scored(batches: Iterable[pa.RecordBatch], weights: np.ndarray, total: int, kinds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, score = [], []
        for n, tokens, pairs, ends in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "tokens", "pairs", "ends")), strict=True):
            tokens, pairs = _wide(tokens, n), _wide(pairs, n)
            context = _contexts(tokens, ends)
            two, one, none = weights[_bucket(context)].T
            mixed = two * pairs / np.maximum(context, 1) + one * tokens / max(total, 1) + none / (kinds + 1)
            base.append(float(np.log10((tokens + 1) / (total + kinds + 1)).sum()))
            score.append(float(np.log10(mixed).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("fold"), batch.column("times"), batch.column("n_tokens"), batch.column("n_known"), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
            ["doc_id", "fold", "times", "n_tokens", "n_known", "base_score", "score"],
        )


def score_texts(docs: DataFrame, parts: int = 7, held: int = 2, block_bytes: int = BLOCK_BYTES, step_bits: int = STEP_BITS) -> DataFrame:
    """log10 probabilities of every whole text under a model of the training documents.

    Reads doc_id (long) and text of ``docs``; other columns are ignored. Training documents are
    those with crc32(doc_id as text) mod ``parts`` not ``held``. Returns doc_id, held_out, n_tokens
    (words after lower-casing A-Z, and one end), n_known, train_tokens, base_score (unigrams, add
    one) and score, a row for each row. A null text is empty: its only token is the end. A row with a
    null doc_id is scored, teaches nothing and is not held out. Repeated rows teach as often as they
    stand there, and are held once. Without training tokens all probability is uniform. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    first, *steps = _steps(blocks, step_bits)
    train = F.coalesce(crc_fold(F.col("doc_id"), parts) != held, F.lit(False))
    fold = F.when(~train, _OUT).when(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLD)) == 0, _LEARN).otherwise(_TRAIN).cast("int")
    sent = texts.select("doc_id", "text", fold.alias("fold"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition("block")
    # equal rows, however many, are one row of their block: they meet without another exchange
    dealt = sent.groupBy("block", "doc_id", "fold", "text").agg(F.count("*").alias("times")).select("doc_id", "text", "fold", "times", "block")

    asked = dealt.groupBy("block").applyInArrow(lambda t: _ask(t, first), _ASKED)
    answers = _answers(asked, first, steps)
    stream = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _stream(d, a, first), _STREAM)
    stream = materialize(stream, compression="zstd")

    totals = stream.agg(F.sum("v"), F.sum("n"), F.sum(F.when(F.col("fold") == _LEARN, F.col("n_tokens") * F.col("times")))).first()
    kinds, total, learning = (x or 0 for x in totals)
    counted = (
        stream.where(F.col("fold") == _LEARN)
        .mapInArrow(lambda it: lean(_bins(it, total - learning)), "bucket long, two long, one long, times long")
        .groupBy("bucket", "two", "one")
        .agg(F.sum("times").alias("times"))
        .toPandas()  # at most BUCKETS x (bins of either estimate)
    )
    weights = learn_weights(counted.to_numpy(np.int64), 1 / (kinds + 1)) if total else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    scored = stream.where("block >= 0").mapInArrow(
        lambda it: lean(_scored(it, weights, total, kinds)), "doc_id long, fold int, times long, n_tokens long, n_known long, base_score double, score double"
    )
    run = 4096  # a row for each that stands there, in runs of bounded length
    scored = scored.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(run).cast("long"))))
    scored = scored.withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + run, F.col("times")) - 1)))
    held_out = (F.col("fold") == _OUT) & F.col("doc_id").isNotNull()
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
