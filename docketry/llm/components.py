"""Connected components of an edge table, by alternating large and small stars.

Each round joins the edges with their nodes' least neighbours; rounds go on until the edges stand still, after
about the logarithm of the longest chain. Before that each partition replaces its edges by a spanning
star. Hot nodes take part in ordinary joins with per-node minima, which combine before the exchange
and whose large partitions adaptive execution splits; no neighbour list is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidy

class UnionFind:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


@tidy
def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uf, limit = UnionFind(), 1_000_000

    def out() -> pa.RecordBatch:
        pairs = [(x, uf.find(x)) for x in list(uf.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            uf.union(a, b)
        if len(uf.up) > limit:  # memory stays bounded; the rounds do the rest
            yield out()
            uf = UnionFind()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long, not null. Returns node, component: the least node of each node's component."""
    edges = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_local_stars, "a long, b long").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        old, edges = edges, materialise(small, "stars")
        discard(old)
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen["n"], seen["x"]) == last:
            break
        last = (seen["n"], seen["x"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
