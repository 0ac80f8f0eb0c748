"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Rows are dealt by a hash of the row and its copy number to packing shards of about SHARD_WORDS words, each packed
alone (a source, cluster, length or repeated row cannot overload a shard). A shard orders its bins by residual
space. Bins of one residual are grouped by the bitmap of what they refuse: sources of which they are full, and large
duplicate clusters that they hold; smaller clusters are a sparse bitmap of each bin. Successor search walks the
residuals upward from the piece's length, leaves out groups whose bitmap refuses the piece, and takes the first bin that
admits it: the tightest compatible bin. Pieces go longest first. A document longer than a bin is cut into full
bins and a rest.

Conflicts: two pieces of one duplicate cluster never share a bin (unless of the same document, which full bins make
impossible), and a bin holds at most a limit of documents of one source: MAX_SAME_SOURCE, or MORE_THAN_SHARE
times the number that the source's share of the shard's documents would put into a bin, if that is more.

Defined results: a document without words is in no bin (bin_id null, one row, n_words 0); null source
and null cluster conflict with nothing; repeated rows are packed each, as copies of one cluster; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_REGEX, materialise, read, text_of, tidy

CAPACITY, SHARD_WORDS, MAX_SAME_SOURCE, MORE_THAN_SHARE, LARGE_CLUSTER = 4096, 1 << 20, 6, 1.5, 32


class Packer:
    """Best fit into bins by residual and by what they refuse."""

    def __init__(self, capacity: int = CAPACITY, max_same_source: int = MAX_SAME_SOURCE, limits: dict | None = None, large: set | frozenset = frozenset()) -> None:
        """limits: source -> most documents of it in a bin, where that is not max_same_source; large: clusters with a bit of their own."""
        self.capacity, self.most, self.limits, self.large = capacity, max_same_source, limits or {}, large
        #: residual -> bitmap of refusals -> bins, in the order in which they came there
        self.groups: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]
        self.present = 0  # bit r: some bin has residual r
        self.residual: list[int] = []
        self.refusal: list[int] = []
        self.counts: list[dict] = []  # for each bin, documents of each source
        self.clusters: list[set] = []  # for each bin, its small clusters
        self.bits: dict[tuple, int] = {}

    def bit(self, kind: str, key) -> int:
        return 0 if key is None else 1 << self.bits.setdefault((kind, key), len(self.bits))

    def add(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset in the bin)."""
        wide = cluster in self.large
        mine = self.bit("source", source) | (self.bit("cluster", cluster) if wide else 0)
        sparse = None if wide else cluster
        fits, residual = self.present >> size, size
        while fits:
            step = (fits & -fits).bit_length() - 1
            residual += step
            for refusal, bins in self.groups[residual].items():
                if refusal & mine:
                    continue
                b = next((b for b in bins if sparse is None or sparse not in self.clusters[b]), None)
                if b is not None:
                    self._take(b, size, source, cluster, wide)
                    return b, self.capacity - residual
            fits >>= step + 1
            residual += 1
        b = len(self.residual)
        self.residual.append(self.capacity)
        self.refusal.append(0)
        self.counts.append({})
        self.clusters.append(set())
        self._put(b, self.capacity, 0)
        self._take(b, size, source, cluster, wide)
        return b, 0

    def _put(self, b: int, residual: int, refusal: int) -> None:
        self.residual[b], self.refusal[b] = residual, refusal
        self.groups[residual].setdefault(refusal, {})[b] = None
        self.present |= 1 << residual

    def _take(self, b: int, size: int, source, cluster, wide: bool) -> None:
        old, refusal = self.residual[b], self.refusal[b]
        group = self.groups[old][refusal]
        del group[b]
        if not group:
            del self.groups[old][refusal]
            if not self.groups[old]:
                self.present &= ~(1 << old)
        if source is not None:
            n = self.counts[b][source] = self.counts[b].get(source, 0) + 1
            if n >= self.limits.get(source, self.most):
                refusal |= self.bit("source", source)
        if wide:
            refusal |= self.bit("cluster", cluster)
        elif cluster is not None:
            self.clusters[b].add(cluster)
        self._put(b, old - size, refusal)


def source_limits(rows: list[tuple[int, int, object, object]], capacity: int, max_same_source: int) -> dict:
    """Limits above max_same_source, for sources whose share of the documents puts more into a bin."""
    total, n = sum(r[1] for r in rows), {}
    for _, words, source, _ in rows:
        if source is not None and words:
            n[source] = n.get(source, 0) + 1
    each = {s: int(MORE_THAN_SHARE * capacity * k / total) + 1 for s, k in n.items()} if total else {}
    return {s: k for s, k in each.items() if k > max_same_source}


def pack_rows(rows: list[tuple[int, int, object, object]], capacity: int = CAPACITY, max_same_source: int = MAX_SAME_SOURCE, limits: dict | None = None) -> list[tuple[int, int, int, int, int]]:
    """rows: (row, words, source, cluster) -> (row, piece, words, bin, offset), longest pieces first, ties by row."""
    pieces, copies = [], {}
    for row, words, source, cluster in rows:
        copies[cluster] = copies.get(cluster, 0) + 1
        for k in range(-(-words // capacity)):
            pieces.append((-min(capacity, words - k * capacity), row, k, source, cluster))
    pieces.sort(key=lambda p: p[:3])
    large = {c for c, n in copies.items() if n > LARGE_CLUSTER and c is not None}
    packer = Packer(capacity, max_same_source, limits, large)
    return [(row, k, -neg, *packer.add(-neg, source, cluster)) for neg, row, k, source, cluster in pieces]


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS, max_same_source: int = MAX_SAME_SOURCE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, piece, n_words, shard, bin, bin_offset; cluster: a column of duplicate clusters (default: same words, letter case apart)."""
    # one normal form of the text gives the words and the default cluster
    flat = F.trim(F.regexp_replace(F.lower(text_of(F.col(text_col))), WS_REGEX, " "))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), flat.alias("flat"), (F.lit(None) if cluster is None else cluster).cast("string").alias("given"))
    words = F.when(F.col("flat") == "", 0).otherwise(F.octet_length("flat") - F.octet_length(F.replace("flat", F.lit(" "), F.lit(""))) + 1)
    rows = rows.select("doc_id", words.cast("long").alias("words"), "source", F.when(F.col("flat") != "", F.xxhash64("flat").cast("string") if cluster is None else F.col("given")).alias("cluster"))
    rows = materialise(rows, "pack")
    total = rows.agg(F.sum("words")).first()[0] or 0
    shards = max(16, -(-int(total) // shard_words))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # a repeated row is a counted row until its copies are dealt
    each = rows.groupBy("doc_id", "words", "source", "cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    dealt = each.withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "cluster", "words", "copy"), F.lit(shards)).cast("int")).drop("copy")

    @tidy
    def one(table: pa.Table) -> pa.Table:
        # equal rows are alike, so an order by all columns settles every tie
        table = table.sort_by([(c, "ascending") for c in ("words", "doc_id", "source", "cluster")])
        words, source, cl = (table.column(c).to_pylist() for c in ("words", "source", "cluster"))
        rows = [(i, words[i], source[i], cl[i]) for i in range(len(words))]
        packed = pack_rows([r for r in rows if r[1]], capacity, max_same_source, source_limits(rows, capacity, max_same_source))
        packed += [(i, 0, 0, None, None) for i in range(len(words)) if not words[i]]
        at = pa.array([p[0] for p in packed], pa.int64())
        cols = [table.column("doc_id").take(at), *[pa.array([p[k] for p in packed], pa.int64()) for k in (1, 2)], table.column("shard").take(at), *[pa.array([p[k] for p in packed], pa.int64()) for k in (3, 4)]]
        return pa.Table.from_arrays(cols, ["doc_id", "piece", "n_words", "shard", "bin", "bin_offset"])

    return dealt.groupBy("shard").applyInArrow(one, f"doc_id {kind}, piece long, n_words long, shard int, bin long, bin_offset long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """shard, bins, words, fill: how full the bins of each shard are."""
    g = packed.where("bin IS NOT NULL").groupBy("shard").agg(F.countDistinct("bin").alias("bins"), F.sum("n_words").alias("words"))
    return g.withColumn("fill", F.col("words") / (F.col("bins") * capacity))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
