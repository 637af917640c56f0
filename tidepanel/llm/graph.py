"""Connected components over a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import give_back, lean, materialize


class UnionFind:
    """Disjoint sets of arbitrary integers; the root of a set is its least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of edges by stars that connect the same ids: no more edges than ids."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        pairs = [(x, root) for x in list(sets.parent) if (root := sets.find(x)) != x]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b: long); component is the least id reachable.

    Union-find inside batches thins the edges; alternating large-star and small-star rounds
    join what is left. Each round only aggregates by key (with partial sums) and joins two
    written tables, so that a hot id is split by adaptive execution; no group is collected.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a is not null and b is not null and a != b")
        .select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .mapInArrow(lambda it: lean(_forest(it)), "a long, b long")
    )
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct())
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        small = large.join(down, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(down.select("u", "m")).distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if found == mark:
            break
        mark = found
        give_back(spark)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
