"""Exact metric range join of vectors by cosine.

The angle between vectors is a metric. A few pivots a label partition its vectors: each has
its home in the cell of its nearest pivot. If x with home i and y with home j are within the
angle r, then d(x, p_j) <= d(y, p_j) + r <= d(y, p_i) + r <= d(x, p_i) + 2r, so x is also sent,
as a guest, to every cell j before its own for which that holds. A cell is cut into rings about its pivot, r wide: of
cell j, x only visits the rings that meet distances from d(x, p_j) - r to d(x, p_i) + r (y is no farther from p_j than
from p_i, so than d(x, p_i) + r), and of its own cell the ring within its own. Each ring then joins its own members and
its guests, without any other; a large ring does so in blocks of bounded size. A task
returns for each vector how many others it found and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import lean, materialize, rows_by_key
from tidepanel.llm.graph import connected_components

#: Vectors of a ring, and numbers in them, that one task compares with as many others.
BLOCK, NUMBERS = 8192, 1 << 20
#: Vectors of a label for each pivot, so that cells cost no more copies than blocks do; a label has no more than the square root of its
#: vectors. The pivots of all labels are sent to every task: at most MAX_PIVOTS vectors. A label that gets none is one cell.
PER_PIVOT, MAX_PIVOTS = 8192, 4096

#: What a task joins, and the tolerance of angles that decide who visits whom.
AT, SLACK = ["label", "dim", "cell", "ring", "i", "j"], 1e-7


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length one, in double precision."""
    rows = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    x = np.array(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(batches: Iterable[pa.RecordBatch], pivots: dict[tuple, np.ndarray], angle: float) -> Iterator[pa.RecordBatch]:
    """Rows (label, dim, cell, ring, guest, id, n, vector): where a vector is at home, and the rings that it visits."""
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for key in set(zip(labels, dims, strict=True)):
            at = np.array([i for i, k in enumerate(zip(labels, dims, strict=True)) if k == key])
            near = pivots.get(key)
            if near is None:  # a label beyond the most pivots: one cell, joined in blocks
                distance = np.zeros((len(at), 1))
            else:
                distance = np.arccos(np.clip(_matrix(batch.column(4).take(pa.array(at))) @ near.T, -1, 1))
            home, near_by = distance.argmin(axis=1), distance.min(axis=1)
            own = np.floor(near_by / angle).astype(np.int64)
            first = np.maximum(np.floor((distance - angle - SLACK) / angle), 0).astype(np.int64)
            last = np.floor((near_by + angle + SLACK) / angle).astype(np.int64)[:, None] + np.zeros_like(first)
            row = np.arange(len(at))
            last[row, home] = own - 1
            last[np.arange(distance.shape[1])[None, :] > home[:, None]] = -1  # pairs of cells meet in the first of both
            times = np.maximum(last - first + 1, 0)
            guest_row, cell = np.nonzero(times)
            times = times[guest_row, cell]
            start = np.repeat(first[guest_row, cell] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            out[0].append(at[np.concatenate([row, np.repeat(guest_row, times)])])
            out[1].append(np.concatenate([home, np.repeat(cell, times)]))
            out[2].append(np.concatenate([own, start + np.arange(len(start))]))
            out[3].append(np.arange(len(row) + len(start)) >= len(row))
        if not out[0]:
            continue
        row, cell, ring, guest = (np.concatenate(x) for x in out)
        kept = batch.take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [kept.column(0), kept.column(1), pa.array(cell.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(guest), kept.column(2), kept.column(3), kept.column(4)],
            ["label", "dim", "cell", "ring", "guest", "id", "n", "vector"],
        )


def _joined(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(id, root, links): vectors found near id, counting copies, and an edge of the task's forest."""
    for (*_, i, j), group in rows_by_key(batches, AT):
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        x, side = _matrix(group.column("vector")), group.column("side").to_numpy()
        tops, others = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if i != j else (np.arange(len(ids)),) * 2
        links, part = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for first in range(0, len(tops), 512):
            top = tops[first : first + 512]
            near = x[top] @ x[others].T >= least
            near &= top[:, None] != others[None, :]
            links[top] += near @ n[others]
            if i != j:
                links[others] += n[top] @ near
            for p, row in zip(top.tolist(), near, strict=True):
                meet = np.unique(part[np.append(others[row], p)])
                if len(meet) > 1:
                    part[np.isin(part, meet)] = meet[0]
        found = np.flatnonzero(links)
        roots = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(roots, part, ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(roots[part[found]]), pa.array(links[found])], ["id", "root", "links"])


def range_join(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK, per_pivot: int = PER_PIVOT) -> DataFrame:
    """Link vectors of equal label whose cosine, in double precision, is at least ``cosine``.

    Reads vec_id (long), embedding (array of numbers) and label of ``vectors``; other columns
    are ignored. Returns vec_id, n_links (other rows linked directly, copies included),
    component_id (least vec_id reachable, itself included) and kept (vec_id = component_id), a
    row for each row. A null label, and a vector that is null, empty, zero or holds a null or
    non-finite component, links with nothing; so do vectors of different length. Rows with equal
    label and vector, repeated rows included, are linked with each other. A null vec_id
    gets nulls. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    value = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), value.alias("vector"))
    fine = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    rows = rows.withColumn("vector", F.when(fine, F.col("vector")))
    rows = rows.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    valid = rows.where("vector is not null").withColumn("dim", F.size("vector"))
    key = ["label", "dim", "k1", "k2"]
    classes = materialize(valid.groupBy(*key, "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    wanted = F.least(F.ceil(F.sqrt("size")), F.ceil(F.col("size") / F.lit(per_pivot)))
    sample = (
        classes.join(sizes, ["label", "dim"])
        .where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * (wanted + 8) / F.col("size"))
        .orderBy(F.xxhash64("id"))
        .select("label", "dim", "vector", wanted.alias("wanted"))
        .limit(MAX_PIVOTS)
    )
    taken: dict[tuple, list] = {}
    for r in sample.collect():
        if len(taken.setdefault((r.label, r.dim), [])) < r.wanted:
            taken[r.label, r.dim].append(r.vector)
    pivots = spark.sparkContext.broadcast({k: _matrix(pa.array(v)) for k, v in taken.items()})
    angle = math.acos(cosine)

    cells = materialize(
        classes.select("label", "dim", "id", "n", "vector").mapInArrow(
            lambda it: lean(_cells(it, pivots.value, angle)), "label string, dim int, cell int, ring int, guest boolean, id long, n long, vector array<double>"
        )
    )
    part = AT[:-2]
    size = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / F.col("dim"))))
    split = cells.groupBy(*part).agg(*(F.count(F.when(F.col("guest") == g, 1)).alias(name) for g, name in ((False, "homes"), (True, "guests"))))
    split = split.where("homes > 0").select(*part, *(F.ceil(F.col(x) / size).cast("int").alias(x) for x in ("homes", "guests")))
    split = materialize(split)
    own = F.when(F.col("guest"), F.col("homes") + F.pmod(F.xxhash64("id"), F.greatest("guests", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.greatest("homes", F.lit(1)))).cast("int")
    # a member meets every block of its cell, a guest those of members only
    last = F.when(F.col("guest"), F.col("homes") - 1).otherwise(F.col("homes") + F.col("guests") - 1)
    tasks = (
        cells.join(split, part)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select(*part, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "vector")
    )
    found = materialize(tasks.repartition(*AT).sortWithinPartitions(*AT).mapInArrow(lambda it: lean(_joined(it, cosine)), "id long, root long, links long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = materialize(
        classes.join(links, "id", "left").join(components, "id", "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    return (
        rows.withColumn("dim", F.when(F.col("vector").isNotNull(), F.size("vector")))
        .select("vec_id", *(F.when(F.col("vector").isNotNull(), F.col(k)).alias(k) for k in key))
        .join(placed, key, "left")
        .withColumn("component_id", F.coalesce("component", "vec_id"))
        .select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    )
