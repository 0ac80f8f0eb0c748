"""Near-duplicate embeddings: a small-world graph for each shard, every shard queried by every vector.

Equal vectors collapse to one point with a count. Points are dealt by a hash to shards of at most about SHARD
points; each shard builds its graph once and stores it. Every point queries every shard, in blocks of
queries: a task gets one shard's graph and one block. The task draws queries by a fixed permutation and finds their
links by brute force (the distance along a few axes rules most pairs out), until AUDIT of them have one to MANY - 1 neighbours other than themselves and AUDIT have more;
a block with too few of either is drawn whole, and so exact. Beams for the rest are audited on those probes: beam and
slack double until each of the two classes has a mean recall per probe of at least RECALL (where a beam of MAX_BEAM
still fails the audit, the rest meets the whole shard). `embedding_audit` reports the recall and beam of each task.

Candidates are verified: a cosine in single precision decides where it is further from the threshold than its
rounding error can be, one in double precision decides the others. Found pairs are counted and united a few hundred
queries at a time, so memory does not grow with the size of a group of near copies; a query whose beam meets
REGION points meets the whole shard instead of walking its group. A task returns each query's link count and only
those links that connect (a spanning forest), so a group of near copies does not travel as pairs. Components of the
forests and of the copies give the result.

Scale: n vectors make n * n / (SHARD * QUERIES) tasks, as every shard is queried; a task reads one graph and one block,
both of fixed size, in single precision where the input is.

Defined results: null, empty or zero vectors, and vectors with null or non-finite components, link with
nothing; vectors of different lengths are apart; rows of one id are one node of the components, and each row counts
the links of its own vector; a null id has component null and links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read, tidy
from .components import components
from .hnsw import Graph

THRESHOLD, SHARD, QUERIES, LEAST_SHARDS, AUDIT, RECALL, MAX_BEAM, MANY, REGION, PART, AXES = 0.95, 40_000, 20_000, 6, 256, 0.995, 512, 10, 1000, 128, 14

Hits = tuple[np.ndarray, np.ndarray]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@tidy
def _build(table: pa.Table) -> pa.Table:
    """The graph of one (dimension, shard)."""
    graph = Graph(table.column("k1").to_numpy().astype(np.int64), _matrix(table.column("embedding")))
    cnt = dict(zip(table.column("k1").to_pylist(), table.column("cnt").to_pylist()))
    buf = io.BytesIO()
    np.savez(buf, cnt=np.array([cnt[i] for i in graph.ids.tolist()]), **graph.state())
    return pa.Table.from_arrays([table.column("dim").slice(0, 1), table.column("shard").slice(0, 1), pa.array([buf.getvalue()], pa.binary())], ["dim", "shard", "graph"])


class Search:
    """One block of queries against one shard's graph."""

    def __init__(self, graph: Graph, q: np.ndarray, ids: np.ndarray | None = None, threshold: float = THRESHOLD, recall: float = RECALL, audit: int = AUDIT) -> None:
        """ids: the queries' ids; a query's own point in the graph is no evidence of recall."""
        self.graph, self.threshold, self.recall, self.audit = graph, threshold, recall, audit
        self.q = q.astype(np.float64, copy=False)
        self.norm = np.linalg.norm(self.q, axis=1)
        self.unit = (self.q / self.norm[:, None]).astype(np.float32)
        # a dot product of d rounded products errs by less than about d + 2 roundings of 2**-24
        self.margin = max(1e-5, 4.0 * (q.shape[1] + 2) * 2.0**-24)
        self.itself = np.full(len(q), -1)
        if ids is not None:
            order = np.argsort(graph.ids)
            at = order[np.minimum(np.searchsorted(graph.ids, ids, sorter=order), len(order) - 1)]
            self.itself = np.where(graph.ids[at] == ids, at, -1)
        self.audited, self.beam, self.probes = 1.0, 0, 0
        # the distance along some axes is at most the whole one: AXES of them rule most pairs out. With two more columns the
        # product of two rows is (|difference|**2 along the axes) / -2
        axes = np.argsort(-graph.unit.var(axis=0), kind="stable")[:AXES]
        short = lambda x, y, flip: np.concatenate([x[:, axes], *[c[:, None] for c in (y, np.full(len(x), -1, dtype=np.float32))[::flip]]], axis=1)
        half = lambda x: (x[:, axes] ** 2).sum(axis=1) / 2
        self.short_q, self.short_p = short(self.unit, half(self.unit), 1), short(graph.unit, half(graph.unit), -1)

    def verified(self, rows: np.ndarray, points: np.ndarray, sims: np.ndarray) -> Hits:
        ok = sims >= self.threshold
        for lo in range(0, len(open_ := np.flatnonzero(np.abs(sims - self.threshold) <= self.margin)), 1 << 15):
            at = open_[lo : lo + (1 << 15)]
            r, p = rows[at], points[at]
            ok[at] = np.einsum("nd,nd->n", self.q[r], self.graph.raw[p].astype(np.float64)) / (self.norm[r] * self.graph.norm[p]) >= self.threshold
        return rows[ok], points[ok]

    def whole(self, pick: np.ndarray) -> Iterator[Hits]:
        """All links of the picked queries, a part of them at a time."""
        for lo in range(0, len(pick), PART):
            part = pick[lo : lo + PART]
            near = self.short_q[part] @ self.short_p.T >= self.threshold - 1 - 2 * self.margin
            if np.count_nonzero(near) * 20 < near.size:
                r, p = np.divmod(np.flatnonzero(near), near.shape[1])
                sims = np.concatenate([np.zeros(0, dtype=np.float32), *[np.einsum("nd,nd->n", self.unit[part[r[k : k + 4096]]], self.graph.unit[p[k : k + 4096]]) for k in range(0, len(r), 4096)]])
                r, p, sims = (x[sims >= self.threshold - self.margin] for x in (r, p, sims))
            else:
                every = self.unit[part] @ self.graph.unit.T
                r, p = np.nonzero(every >= self.threshold - self.margin)
                sims = every[r, p]
            yield self.verified(part[r], p, sims)

    def beams(self, pick: np.ndarray, ef: int, slack: float) -> Iterator[Hits]:
        for lo in range(0, len(pick), 4 * PART):
            part = pick[lo : lo + 4 * PART]
            r, p, wide = self.graph.near(self.unit[part], self.threshold, ef, slack, REGION)
            yield self.verified(part[r], p, np.einsum("nd,nd->n", self.unit[part[r]], self.graph.unit[p]))
            yield from self.whole(part[wide])

    def __iter__(self) -> Iterator[Hits]:
        """(query rows, points) that link, in parts; then `audited` is the recall of the worst class, and `beam` what it took (0: none, all exact)."""
        draw = np.random.default_rng(0).permutation(len(self.q))
        drawn, kinds = 0, [[], []]
        truth: list[Hits] = []
        while drawn < len(draw) and min(map(len, kinds)) < self.audit:
            part = draw[drawn : drawn + PART]
            for r, p in self.whole(part):
                other = p != self.itself[r]
                n = np.bincount(r[other], minlength=len(self.q))[part]
                new = [part[(n > 0) & (n < MANY)][: self.audit - len(kinds[0])], part[n >= MANY][: self.audit - len(kinds[1])]]
                for k, x in zip(kinds, new):
                    k += x.tolist()
                # at most REGION of a probe's links are evidence
                mine = np.flatnonzero(other & np.isin(r, np.concatenate(new)))
                begin = np.concatenate([[0], np.flatnonzero(np.diff(r[mine])) + 1, [len(mine)]])
                mine = mine[np.arange(len(mine)) - np.repeat(begin[:-1], np.diff(begin)) < REGION]
                truth.append((r[mine], p[mine]))
                yield r, p
            drawn += len(part)
        rest = draw[drawn:]
        self.probes = sum(map(len, kinds))
        if not len(rest):
            return
        asked, want = (np.concatenate(x).astype(np.int64) for x in zip(*truth))
        want = asked * len(self.graph.ids) + want
        size = np.bincount(asked, minlength=len(self.q))
        pick = np.concatenate([np.array(k, dtype=np.int64) for k in kinds])
        ef, slack = 32, 0.01
        while True:
            hit = np.zeros(len(want), dtype=bool)
            for r, p in self.beams(pick, ef, slack):
                hit |= np.isin(want, r.astype(np.int64) * len(self.graph.ids) + p)
            share = np.bincount(asked[hit], minlength=len(self.q)) / np.maximum(size, 1)
            self.audited, self.beam = min(float(share[np.array(k, dtype=np.int64)].mean()) for k in kinds), ef
            if self.audited >= self.recall or ef >= min(MAX_BEAM, len(self.graph.ids)):
                break
            ef, slack = 2 * ef, 2 * slack
        # beams that cannot pass the audit: these queries meet the whole shard
        yield from self.beams(rest, ef, slack) if self.audited >= self.recall else self.whole(rest)


def search_shard(graph: Graph, q: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL, audit: int = AUDIT, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """All of a Search at once: (query rows, points) that link, the audited recall, and the beam."""
    search = Search(graph, q, ids, threshold, recall, audit)
    hits = list(search)
    rows, points = (np.concatenate(x).astype(np.int64) for x in zip(*hits)) if hits else (np.zeros(0, dtype=np.int64),) * 2
    return rows, points, search.audited, search.beam


class Forest:
    """Components of nodes 0, 1, ... and the links that made them; links come in large parts, most of them inside a component."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.up[a], self.up[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        pair, at = np.unique(np.minimum(x, y)[apart] * len(self.up) + np.maximum(x, y)[apart], return_index=True)
        up = self.up
        for k in apart[at].tolist():
            x, y = int(up[a[k]]), int(up[b[k]])
            while up[x] != x:
                x = int(up[x])
            while up[y] != y:
                y = int(up[y])
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((int(a[k]), int(b[k])))
        while True:  # all nodes point at their roots again
            nxt = up[up]
            if (nxt == up).all():
                return
            up[:] = nxt


LINKS = "a long, b long, w long, shard int, block int, queries long, probes long, recall double, beam int"
_LINK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]


@tidy
def _query(left: pa.Table, right: pa.Table) -> pa.Table:
    """Between one shard's graph and one block of queries: counts (a, null, w), connecting links (a, b), and one row about the audit. Points go by k1."""
    rows: list[tuple] = []
    if left.num_rows and right.num_rows:
        state = np.load(io.BytesIO(left.column("graph")[0].as_py()))
        graph, cnt = Graph.restored(state), state["cnt"]
        right = right.sort_by("k1")  # audits, and so beams, do not depend on the order of arrival
        ids = right.column("k1").to_numpy().astype(np.int64)
        search = Search(graph, _matrix(right.column("embedding")), ids)
        weight = np.zeros(len(ids), dtype=np.int64)
        # nodes: the graph's points, then the queries that are none of them
        node = np.where(search.itself >= 0, search.itself, len(graph.ids) + np.arange(len(ids)))
        name = np.concatenate([graph.ids, ids])
        forest = Forest(len(name))
        for r, p in search:
            other = p != search.itself[r]
            r, p = r[other], p[other]
            weight += np.bincount(r, weights=cnt[p], minlength=len(ids)).astype(np.int64)
            forest.add(node[r], p)
        rows += [(int(ids[i]), None, int(weight[i])) for i in np.flatnonzero(weight)]
        rows += [(int(name[x]), int(name[y]), None) for x, y in forest.links]
        rows = [(*r, None, None, None, None, None, None) for r in rows]
        rows.append((None, None, None, left.column("shard")[0].as_py(), right.column("block")[0].as_py(), len(ids), search.probes, search.audited, search.beam))
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_LINK_TYPES)], [x.split()[0] for x in LINKS.split(", ")])


def _points(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the keys of their vector, one point for each distinct usable vector)."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    zero = F.lit(0.0).cast("float" if kind == "array<float>" else "double")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    # x + 0 makes -0 and 0 one value
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: x + zero)).alias("embedding"))
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(7), "embedding"))
    usable_rows = rows.where("embedding IS NOT NULL AND vec_id IS NOT NULL")
    points = usable_rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cnt"), F.any_value("embedding").alias("embedding"))
    return rows, materialise(points.withColumn("dim", F.size("embedding")), "points")


def _links(points: DataFrame) -> DataFrame:
    """LINKS of all tasks: every shard's graph with every block of queries."""
    n = points.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD)), max(2, -(-n // QUERIES))
    seat = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "k1"), F.lit(m)).cast("int")
    graphs = points.withColumn("shard", seat(1, shards)).groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, graph binary")
    graphs = materialise(graphs, "graphs")
    every = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = points.withColumn("block", seat(2, blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", "block", "k1", "embedding")
    at = ["dim", "shard", "block"]
    links = materialise(every.groupBy(*at).cogroup(queries.groupBy(*at)).applyInArrow(_query, LINKS), "links")
    discard(graphs)
    return links


def embedding_audit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """shard, block, queries, probes, recall, beam: what the audit of each task found (beam 0: the task was exact)."""
    return _links(_points(vectors, id_col, vector_col)[1]).where("shard IS NOT NULL").select("shard", "block", "queries", "probes", "recall", "beam")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each input row; ids are long."""
    rows, points = _points(vectors, id_col, vector_col)
    links = _links(points)
    key = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()

    # one id may have several vectors, and one vector several ids: both join
    ids = rows.where(key).join(points.select("k1", "k2", "rep", "cnt"), ["k1", "k2"]).select("vec_id", "k1", "k2", "rep", "cnt")
    same = ids.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    name = points.select("k1", "rep")
    joined = links.where("b IS NOT NULL").select(F.col("a").alias("k1"), "b").join(name, "k1").select(F.col("rep").alias("a"), F.col("b").alias("k1")).join(name, "k1").select("a", F.col("rep").alias("b"))
    label = components(joined.unionByName(same))
    count = links.where("w IS NOT NULL").groupBy(F.col("a").alias("k1")).agg(F.sum("w").alias("w"))
    per_point = points.select("k1", "k2", "cnt").join(count, "k1", "left").select("k1", "k2", (F.col("cnt") - 1 + F.coalesce("w", F.lit(0))).alias("n"))
    k = F.when(key, F.col("k1")).alias("k1")
    out = rows.select("vec_id", k, "k2").join(per_point, ["k1", "k2"], "left").join(label, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read(spark, sf_dir, "embeddings"))


OP1_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
