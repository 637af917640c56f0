"""Mixing sources to target weights by blocks.

The words of each source, in a fixed order of its documents, are packed into blocks of
BLOCK words. Every output shard draws how many slots each source gets: the whole part of a source's
expectation is given, and the slots left over are a multinomial draw by the fractional parts (residual
sampling), so that a source comes near its target whatever the number of shards. Sources may be many: they stay in
a table, and a shard draws from a tree of groups of FAN. A source's slots are numbered through, and a pseudorandom
permutation of its block indices maps slot to block: each block comes once before any comes
again. Slots and blocks are then joined by index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import lean, materialize
from tidepanel.llm.textkernel import mix, slices, word_bounds

_U = np.uint64
#: Words of a block.
BLOCK = 128
#: Weights of the sources in order, repeating; the mix is so many times all words; a source gives so many times its words at most.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Slots of an output shard, about.
SHARD_SLOTS = 8192
#: Sources, or groups of them, that one draw chooses from; bits of their probabilities.
FAN, BITS = 1024, 32
#: Sources that one task numbers, and slots that one task makes, about.
NUMBERED, MADE = 100_000, 1 << 18
#: Documents whose places are counted together.
RUN = 4096
SEED = 20240229

WORD = r"[^\x20\x09-\x0D]+"


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ...) with their numbers s: by code point, null last. Sorted in ranges, which are counted."""
    spark = sources.sparkSession
    ranges = max(1, -(-sources.count() // NUMBERED))
    at = [F.col("source").isNull(), F.col("source")]
    ordered = materialize(sources.repartitionByRange(ranges, *at).sortWithinPartitions(*at).withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    first, rows = 0, []
    for p, n in sorted((r.part, r["count"]) for r in ordered.groupBy(part.alias("part")).count().collect()):  # a row for each range
        rows.append((p, first))
        first += n
    return ordered.join(F.broadcast(spark.createDataFrame(rows, "part long, first long")), part == F.col("part")).withColumn("s", F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id", "part", "first")


def targeted(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> DataFrame:
    """``sources`` (s, size, ...) with target, the words that each is to give: by weight, none more than ``most`` times its size, the excess reshared.

    What is left is shared by weight; sources above their most are closed, until none is. A round is one sum over the sources.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("s") % len(weights) + 1).cast("int"))
    top = F.col("size") * F.lit(most)
    size, open_, n = sources.agg(F.sum("size"), F.sum(weight), F.count("*")).first()
    left = share * (size or 0)
    level, closed = left / open_ if n else 0.0, 0
    while True:
        above = F.lit(level) * weight > top
        given, weighing, count = sources.agg(F.sum(F.when(above, top)), F.sum(F.when(~above, weight)), F.count(F.when(above, 1))).first()
        if count == closed or count == n:
            break
        closed, level = count, (left - (given or 0)) / weighing
    return sources.withColumn("target", F.least(F.lit(level) * weight, top.cast("double")))


def permuted(k: np.ndarray, size: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1: a Feistel network, walked until it is in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    rounds = [_U(seed * 4 + r & 0xFFFFFFFF) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> _U(half), x & mask
        for r in rounds[::-1] if inverse else rounds:
            if inverse:
                a, b = b ^ (mix(a ^ r << _U(32)) & mask), a
            else:
                a, b = b, a ^ (mix(b ^ r << _U(32)) & mask)
        return a << _U(half) | b

    x = once(k.astype(_U))
    while len(out := np.flatnonzero(x >= _U(size))):
        x[out] = once(x[out])
    return x.astype(np.int64)


def _drawn(batches: Iterable[pa.RecordBatch], level: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Draw n slots of a shard among the children of a node: (shard, node, n) of those that get any."""
    for batch in batches:
        out: list[list[int]] = [[], [], []]
        for shard, node, n, children in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            p = np.array([c["p"] for c in children], float)
            got = np.random.default_rng([seed, level, shard, node]).multinomial(n, p / p.sum())
            for i in np.flatnonzero(got).tolist():
                for column, value in zip(out, (shard, children[i]["id"], int(got[i])), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["shard", "node", "n"])


def drawn(sources: DataFrame, shards: int, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """(shard, s, n): slots that each of ``shards`` shards gives to each source, none without any.

    ``sources``: s and expected, the slots a source is to have in all. A shard gives the whole part of expected / shards
    and draws the rest, as many as the fractional parts add up to, from a multinomial over the fractional parts: by
    groups of ``fan`` sources, groups of groups, and so on up to one. Probabilities are whole numbers, so that sums of
    them agree between reruns.
    """
    spark = sources.sparkSession
    unit = 1 << BITS
    each = F.col("expected") / F.lit(shards)
    parts = sources.select("s", F.floor(each).alias("whole"), F.round((each - F.floor(each)) * F.lit(float(unit))).cast("long").alias("p"))
    total, count = parts.agg(F.sum("p"), F.max("s")).first()
    whole = parts.where("whole > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("s").cast("long").alias("s"), F.col("whole").alias("n"))
    if not total:
        return whole
    levels, nodes, top = [], parts.where("p > 0").select(F.col("s").cast("long").alias("id"), "p"), count
    while True:
        groups = nodes.groupBy(F.floor(F.col("id") / F.lit(fan)).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("children"), F.sum("p").alias("p"))
        levels.append(materialize(groups))
        top //= fan
        if not top:
            break
        nodes = levels[-1].select(F.col("parent").alias("id"), "p")
    # the left-over slots of all shards up to one are the whole part of what they add up to
    upto = lambda k: F.floor((k.cast("decimal(38,0)") * F.lit(total).cast("decimal(20,0)")) / F.lit(unit)).cast("long")
    rows = spark.range(shards).select(F.col("id").alias("shard"), F.shiftright("id", 62).alias("node"), (upto(F.col("id") + 1) - upto(F.col("id"))).alias("n")).where("n > 0")
    for level in range(len(levels) - 1, -1, -1):
        kids = levels[level].select(F.col("parent").alias("node"), "children")
        joined = rows.join(kids, "node").select("shard", "node", "n", "children")
        rows = joined.mapInArrow(lambda it, level=level: lean(_drawn(it, level, seed)), "shard long, node long, n long")
    return whole.union(rows.select("shard", F.col("node").alias("s"), "n")).groupBy("shard", "s").agg(F.sum("n").alias("n"))


def _mapped(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """(shard, s, slot, block, epoch) of each slot; epoch: how often its source's blocks have all been given before."""
    for batch in batches:
        source, slot, blocks = (batch.column(c).to_numpy() for c in (1, 2, 3))
        found, epoch = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
        for s in np.unique(source).tolist():
            own = np.flatnonzero(source == s)
            n = int(blocks[own[0]])
            epoch[own], place = np.divmod(slot[own], n)
            found[own] = permuted(place, n, seed + s)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found), pa.array(epoch)], ["shard", "s", "slot", "block", "epoch"])


class Mix:
    """The plan of a mix: ``documents`` (a row for each document, with its place in its source) and ``segments``."""

    def __init__(self, documents: DataFrame, segments: DataFrame) -> None:
        self.documents, self.segments = documents, segments


def content_key(docs: DataFrame) -> Column:
    names = [c for c in ("text", "source", "lang", "n_chars") if c in docs.columns]
    return F.xxhash64(*(F.col(c) for c in names))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> Mix:
    """Plan a mix of ``docs`` (doc_id, text, source; other columns are ignored).

    Sources come by code point, null last, and weigh ``weights`` in turn. documents: doc_id, key,
    s (number of the source), start (place of its first word), size (words; null text: 0),
    source_size and target. segments: a row for each block that a slot takes of a document:
    shard, s, slot, block, epoch, start of the document, and the words ``low`` to ``high`` (exclusive) of the document. A
    document without words gives nothing; repeated rows are documents of their own; ties in
    order are between equal rows. Slots beyond REPEATS rounds over a source's blocks are not given, so that no
    document exceeds so many times its size. Reruns give the same mix; another ``seed`` gives another.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        content_key(docs).alias("key"),
    )
    rows = materialize(rows)
    totals = materialize(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    blocks = F.ceil(F.col("size") / F.lit(block))
    known = targeted(materialize(numbered(totals)), weights, share).select(
        "source",
        "s",
        "target",
        F.col("size").alias("source_size"),
        blocks.alias("blocks"),
        F.when(F.col("size") > 0, F.col("target") * blocks / F.col("size")).otherwise(F.lit(0.0)).alias("expected"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(RUN))).alias("runs"),
    )
    known = materialize(known)

    # places: sums of the documents before, within runs of about RUN documents and over runs
    placed = rows.join(known.select("source", "s", "source_size", "target", "runs"), rows["source"].eqNullSafe(known["source"])).drop("source")
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "key"), F.col("runs")))
    placed = materialize(placed.withColumn("upto", F.expr("sum(size) over (partition by s, run order by doc_id, key, size rows unbounded preceding)")))
    before = materialize(
        placed.groupBy("s", "run").agg(F.sum("size").alias("n")).withColumn("base", F.expr("sum(n) over (partition by s order by run rows unbounded preceding)") - F.col("n")).select("s", "run", "base")
    )
    documents = materialize(
        placed.join(before, ["s", "run"]).select("doc_id", "key", "s", (F.col("base") + F.col("upto") - F.col("size")).alias("start"), "size", "source_size", "target")
    )
    pieces = (
        documents.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        .select(
            "s",
            "block",
            "start",
            F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("low"),
            F.least("size", (F.col("block") + 1) * block - F.col("start")).alias("high"),
        )
    )

    total = known.agg(F.sum(F.ceil("expected"))).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    counts = materialize(drawn(known.select("s", "expected"), shards, seed))
    # the slots of a source's shards follow each other
    counts = counts.withColumn("first", F.expr("sum(n) over (partition by s order by shard rows unbounded preceding)") - F.col("n")).join(known.select("s", "blocks"), "s")
    counts = counts.withColumn("end", F.least(F.col("first") + F.col("n"), F.col("blocks") * REPEATS)).where("end > first")
    step = 1 << 14
    slots = (
        counts.withColumn("from", F.explode(F.sequence(F.col("first"), F.col("end") - 1, F.lit(step).cast("long"))))
        .repartition(max(1, -(-total // MADE)), "shard", "s", "from")
        .select("shard", "s", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + step, F.col("end")) - 1)).alias("slot"), "blocks")
        .mapInArrow(lambda it: lean(_mapped(it, seed)), "shard long, s long, slot long, block long, epoch long")
    )
    segments = (
        slots.hint("merge")  # its size cannot be told from that of the drawn counts
        .join(pieces, ["s", "block"])
        .select("shard", "s", "slot", "block", "epoch", "start", "low", "high")
    )
    return Mix(documents, segments)


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of each row of ``docs``."""
    made = plan(docs, **options)
    sums = made.segments.groupBy("s", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken")).withColumn("some", F.lit(True))
    return (
        made.documents.withColumn("some", F.col("size") > 0)
        .join(sums.hint("merge"), ["s", "start", "some"], "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of column 1 that the ranges of column 2 name, in the text's own spacing where they adjoin."""
    for batch in batches:
        ranges = batch.column(2).to_pylist()
        for first, end, raw, at in slices(batch.column(1)):
            start, stop, index = word_bounds(raw, at)
            texts = []
            for i in range(end - first):
                own, most, joined = index[i], int(index[i + 1] - index[i]), []
                for r in ranges[first + i]:
                    if joined and joined[-1][1] == r["low"]:
                        joined[-1][1] = r["high"]
                    else:
                        joined.append([r["low"], r["high"]])
                cuts = (raw[at[i] if low == 0 else start[own + low] : at[i + 1] if high == most else stop[own + high - 1]] for low, high in joined)
                texts.append(b"\n".join(c.tobytes() for c in cuts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(texts, pa.string())], ["row", "text"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each document and time that words of it are taken.

    text holds those words, in the text's own spacing, and n_chars, if there is one, its length;
    the other columns are the document's. What nothing is taken of has no row.
    """
    made = plan(docs, **options)
    parts = made.segments.groupBy("s", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("parts"))
    chosen = made.documents.where("size > 0").join(parts.hint("merge"), ["s", "start"]).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "parts")
    columns = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), content_key(docs).alias("_hash"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.dropDuplicates(["_id", "_hash"])  # equal rows have a row of ``chosen`` each
    joined = chosen.hint("merge").join(rows, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash"))).select("row", "text", "parts")
    cut = joined.mapInArrow(lambda it: lean(_cut(it)), f"row {joined.schema['row'].dataType.simpleString()}, text string")
    value = {c: F.col(f"row.c{i}") for i, c in enumerate(columns) if c != "text"} | {"text": F.col("text")}
    if "n_chars" in value:
        value["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(value[c].alias(c) for c in columns))
