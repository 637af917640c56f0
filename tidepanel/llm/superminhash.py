"""Near-duplicates by SuperMinHash.

Signatures in which the elements' ranks are correlated by one permutation an element (so
their variance is below that of independent hashes), computed with early stopping; bands of
the signature propose candidates; candidates are confirmed on the full shingle sets; and
union-find groups what is linked.

Documents with equal sets are one class and only its first document goes on. In a bucket
every member is compared with the bucket's first one (a star, not all pairs). A member that
is linked with it needs no more comparison with others that are. The rest are compared
inside tasks, bucket by bucket in blocks of bounded size, leaving out pairs already known to
be connected and pairs that the distances to the bucket's first member rule out (Jaccard
distance is a metric); a task returns links, never the pairs it looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import give_back, lean, materialize, rows_by_key
from tidepanel.llm.graph import UnionFind, connected_components
from tidepanel.llm.textkernel import mix, shingle_sets, slices

_U = np.uint64

#: 32 bands of 3: two sets at similarity 0.75 miss all bands with a chance of 2e-8.
ROWS, BANDS = 3, 32
#: Members of a bucket, and elements of their sets, that one task compares with as many others.
BLOCK, ELEMENTS = 2048, 1 << 21
#: Comparisons on 32-bit elements decide outside this margin, on 64-bit elements inside.
MARGIN = 0.005
#: Estimates of SuperMinHash (standard error 0.044 at 0.75 for 96 slots) rule a pair out below: over five
#: standard errors, a chance below 1e-8 for a pair at the threshold.
LEAST_ESTIMATE = 0.5


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash values (len(sets) x m, uint64) of sets of distinct 64-bit elements.

    Every element draws a random permutation of the m slots, one position a round, and
    offers round + fraction to the slot at that position; a slot keeps its least offer.
    After round j no later offer is below j + 1, so a set leaves as soon as all its slots
    hold less: early stopping. A value is (round << 32) + fraction. Empty sets keep the
    largest value in all slots.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.full(len(sets) * m, ~_U(0), _U)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for j in range(m):
        if not len(element):
            break
        x = mix(element + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((x & _U(0xFFFFFFFF)) * _U(m - j) >> _U(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            row = np.arange(len(element))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, j]
            order[row, j] = slot
        np.minimum.at(values, owner * m + slot, _U(j << 32) + (x >> _U(32)))
        if j + 1 == m:
            break
        grid = values.reshape(-1, m)
        open_sets = np.zeros(len(sets), bool)
        live = np.unique(owner)
        open_sets[live] = grid[live].max(axis=1) >= _U((j + 1) << 32)
        keep = open_sets[owner]
        element, owner = element[keep], owner[keep]
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(element), 1))
            row, pick = np.arange(len(element)), pick[keep]
            order[row, pick] = 0
            order[row, 0] = pick
        else:
            order = order[keep]
    return values.reshape(-1, m)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """(sets x bands) hashes of runs of ``rows`` slots."""
    bands = values.shape[1] // rows
    keys = np.empty((len(values), bands), _U)
    for b in range(bands):
        key = np.full(len(values), b + 1, _U)
        for i in range(rows):
            key = mix(key * _U(0x9E3779B97F4A7C15 | 1) + values[:, b * rows + i])
        keys[:, b] = key
    return keys


def _signed(batches: Iterable[pa.RecordBatch], n: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, at in slices(batch.column(1)):
            sets = shingle_sets(raw, at, n)
            keys = band_keys(signatures(sets, rows * bands), rows).view(np.int64)
            prints = np.array([(int(np.bitwise_xor.reduce(s)), int(mix(s).sum(dtype=_U))) if len(s) else (0, 0) for s in sets], _U).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints[:, 0]),
                    pa.array(prints[:, 1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )


def _sets(batches: Iterable[pa.RecordBatch], n: int, wide: bool) -> Iterator[pa.RecordBatch]:
    kind = _U if wide else np.uint32
    for batch in batches:
        for first, end, raw, at in slices(batch.column(1)):
            found = [(s if wide else np.unique(s.astype(np.uint32))).astype(kind).tobytes() for s in shingle_sets(raw, at, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(found, pa.binary())], ["id", "elements"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _compared(batches: Iterable[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    """Overlap and sizes of the two sets of each row."""
    kind = _U if wide else np.uint32
    for batch in batches:
        counts = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
            both = _overlap(x, y)
            counts.append((both, len(x) + len(y) - both))
        both, union = np.array(counts, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(union)], ["a", "b", "both", "all"])


def _confirmed(pairs: DataFrame, sets: DataFrame, wide: bool) -> DataFrame:
    """(a, b, both, all) of (a, b); a row of ``sets`` is joined to each pair that needs it."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lambda it: lean(_compared(it, wide)), "a long, b long, both long, all long")


def _portions(sets: list[np.ndarray], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """``sets`` in order, about ``most`` elements at a time: a signature's scratch space is 96 bytes an element."""
    part, size = [], 0
    for s in sets:
        part.append(s)
        size += len(s)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _within(batches: Iterable[pa.RecordBatch], threshold: float, m: int) -> Iterator[pa.RecordBatch]:
    """Candidates for links between the members of a block, or of two, of one bucket.

    Members that are known to be linked share ``comp``. Distances are those of 32-bit sets, so all they rule out
    is beyond the margin that collisions may cost.
    """
    reach = 1 - threshold + MARGIN
    for (_, _, i, j), group in rows_by_key(batches, ["key", "kind", "i", "j"]):
        ids, comp, far = (group.column(c).to_numpy() for c in ("id", "comp", "far"))
        side, band = group.column("side").to_numpy(), int(group.column("band")[0].as_py())
        keys = np.stack(group.column("bands").to_numpy(zero_copy_only=False)) if len(ids) else None
        sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("elements")]
        values, size = np.concatenate([signatures([s.astype(_U) for s in part], m) for part in _portions(sets)]), np.array([len(s) for s in sets])
        joined, found = UnionFind(), []
        tops, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if i == j:
            others = np.arange(len(ids))
        for p in tops.tolist():
            q = others if i != j else others[(others > p) | (side[others] == 1)]
            q = q[(comp[q] != comp[p]) & (np.abs(far[q] - far[p]) <= reach)]
            q = q[np.minimum(size[q], size[p]) >= (threshold - MARGIN) * np.maximum(size[q], size[p])]
            if band and len(q):
                q = q[~(keys[q, :band] == keys[p, :band]).any(axis=1)]
            if len(q):
                q = q[(values[q] == values[p]).mean(axis=1) >= LEAST_ESTIMATE]
            for r in q.tolist():
                c, d = int(comp[p]), int(comp[r])
                if joined.find(c) == joined.find(d):
                    continue
                both = _overlap(sets[p], sets[r])
                share = both / (size[p] + size[r] - both)
                if share >= threshold - MARGIN:
                    found.append((min(ids[p], ids[r]), max(ids[p], ids[r])))
                    if share >= threshold + MARGIN:
                        joined.union(c, d)
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK, elements: int = ELEMENTS) -> DataFrame:
    """Group documents whose sets of n-word shingles have 100 * overlap >= percent * union.

    Reads doc_id (long) and text of ``docs``; other columns, whatever their names, are ignored.
    Returns doc_id, n_shingles, component_id (least doc_id reachable by links) and kept
    (doc_id = component_id), a row for each row. Words are ``[^\\x20\\x09-\\x0D]+`` after
    lower-casing A-Z. A null or empty text, or one without words, has an empty set and is a
    component of its own. Repeated rows are kept. A null doc_id gets nulls for component_id and
    kept, and joins no group. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(lambda it: lean(_signed(it, n, rows, bands)), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    # one row for each class: a repeated doc_id can have several rows
    reps = materialize(
        full.select("doc_id", "n_shingles", "f1", "f2", "bands")
        .join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"])
        .dropDuplicates(["doc_id", "f1", "f2"])
        .select(F.col("doc_id").alias("id"), "n_shingles", "bands")
    )
    banded = reps.select("id", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "key"))
    buckets = materialize(banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    members = materialize(banded.join(buckets, "key"))
    stars = materialize(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    give_back(docs.sparkSession)

    def sets_of(ids: DataFrame, wide: bool) -> DataFrame:
        return materialize(
            texts.join(ids.distinct(), F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"]).mapInArrow(lambda it: lean(_sets(it, n, wide)), "id long, elements binary")
        )

    def exact(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
        return _confirmed(pairs, sets_of(ids, True), True).where(F.lit(100) * F.col("both") >= F.lit(percent) * F.col("all")).select("a", "b")

    sets = sets_of(members.select("id"), False)
    at, share = percent / 100, F.col("both") / F.col("all")
    judged = materialize(_confirmed(stars, sets, False).select("a", "b", (F.lit(1.0) - share).alias("far"), (F.abs(share - F.lit(at)) < F.lit(MARGIN)).alias("close")))
    linked = judged.where(~F.col("close") & (F.col("far") < F.lit(1 - at))).select("a", "b").union(exact(judged.where("close").select("a", "b")))
    groups = materialize(connected_components(linked))
    give_back(docs.sparkSession)

    placed = materialize(
        members.join(judged.select(F.col("a").alias("hub"), F.col("b").alias("id"), "far"), ["hub", "id"], "left")
        .join(groups, "id", "left")
        .select("key", "band", "id", "size", F.coalesce("component", "id").alias("comp"), F.coalesce("far", F.lit(0.0)).alias("far"))
    )
    reach = F.lit(1 - at + 1e-9)  # of links; what it rules out keeps a margin
    open_buckets = materialize(
        placed.groupBy("key")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.when(F.col("far") > reach - F.lit(MARGIN), F.col("far"))).alias("least"), F.count("*").alias("n"))
        .where("c0 < c1 and least is not null")
        .select("key", "least", "n")
    )
    rest = placed.join(open_buckets, "key").where(F.col("far") >= F.col("least") - reach - F.lit(MARGIN))
    # only sets of similar size can be linked: in a large bucket a member stays in its size class and visits the one below
    large = F.col("n") > F.lit(block)
    rest = (
        rest.withColumn("kind", F.when(large, F.floor(F.ln("size") / F.lit(math.log(1 / at)) + F.lit(1e-9)).cast("int")).otherwise(F.lit(0)))
        .withColumn("visit", F.explode(F.when(large, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("key", (F.col("kind") - F.col("visit")).alias("kind"), "visit", "id", "size", "comp", "far", "band")
    )
    rest = materialize(rest)
    give_back(docs.sparkSession)
    split = (
        rest.groupBy("key", "kind")
        .agg(
            F.min("comp").alias("c0"),
            F.max("comp").alias("c1"),
            F.max("far").alias("most"),
            *(
                F.ceil(F.greatest(F.count(F.when(F.col("visit") == v, 1)) / F.lit(block), F.coalesce(F.sum(F.when(F.col("visit") == v, F.col("size"))), F.lit(0)) / F.lit(elements))).cast("int").alias(name)
                for v, name in ((0, "homes"), (1, "visits"))
            ),
        )
        .where((F.col("homes") > 0) & (F.col("c0") < F.col("c1")) & (F.col("most") > reach - F.lit(MARGIN)))
        .select("key", "kind", "homes", "visits")
    )
    # tasks (i, i): members of block i among themselves and with the first block of visitors;
    # (i, j): members of block i with another block, of members or of visitors
    own = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.when(F.col("visit") == 0, F.col("homes")).otherwise(F.col("visits")))).cast("int")
    own = own + F.when((F.col("visit") == 1) & (own > 0), F.col("homes") - 1).otherwise(F.lit(0))
    met = F.when(F.col("visit") == 0, F.col("homes") + F.greatest(F.col("visits") - 1, F.lit(0))).otherwise(F.col("homes"))
    first = (F.col("visit") == 1) & (F.col("own") == 0)
    rest = (
        rest.join(materialize(split), ["key", "kind"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
        .select(
            "key",
            "kind",
            F.when(first, F.col("other")).otherwise(F.least("own", "other")).alias("i"),
            F.when(first, F.col("other")).otherwise(F.greatest("own", "other")).alias("j"),
            F.when(F.col("visit") == 1, F.lit(1)).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
            "id",
            "comp",
            "far",
            "band",
        )
        .join(reps.select("id", "bands"), "id")
        .join(sets, "id")
    )
    more = (
        rest.repartition("key", "kind", "i", "j")
        .sortWithinPartitions("key", "kind", "i", "j")
        .select("key", "kind", "i", "j", "side", "id", "comp", "far", "band", "bands", "elements")
        .mapInArrow(lambda it: lean(_within(it, at, rows * bands)), "a long, b long")
    )
    edges = groups.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(exact(more.distinct()))
    components = connected_components(edges)
    placed_classes = materialize(
        classes.join(components, F.col("rep") == F.col("id"), "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    )
    return (
        signed.join(placed_classes, ["f1", "f2", "n_shingles"], "left")
        .withColumn("component_id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )
