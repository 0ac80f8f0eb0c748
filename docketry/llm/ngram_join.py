"""Exact Jaccard join of word n-gram sets by prefix filtering and prefix-tree traversal.

1. Each document becomes a set of 5-word shingle hashes; equal sets (copies) collapse to the smallest id.
2. Blocks and key ranges find the shingles that two sets hold (narrow keys: a chance clash only
   weakens the filter). The global order is (holders, hash): unshared shingles first. Two sets
   that reach 75 % share a shingle among the first n - ceil(0.75 n) + 1 of each, so a set whose prefix is all
   unshared links with nothing and is done.
3. Every link lies in the posting of a shared prefix shingle. Each posting's smallest document, its head, meets the
   others, where the lengths allow a link: a document first meets the least of its heads, by which most groups of
   near copies become one component, then the heads from which it is still apart. What is left are
   postings whose other members are not yet in one component. Postings with the same members count once, and those
   that hang together by their members are one job where all their sets fit into a chunk. In others
   members are cut by length class (a link joins one class or two neighbours) and into chunks of bounded size;
   chunks of a posting, and pairs of them that are not in one component, are joined.
4. A join stores one side as a trie of its sets in the global order (most frequent shingle first, edges compressed); the
   other's sets traverse it with the overlap so far, a subtree is left when its remaining length
   cannot bring the overlap to the bound, and sets already in one component are not compared again.
5. Components of the found links and of the copies.

A hot prefix shingle costs a comparison with its head for each holder, in chunks; only its holders that stay apart
meet each other. Chunks are of fixed size, so no task grows with a posting.

Defined results: empty or null text has no shingles and links with nothing; rows of one id are one
node; a null id is linked with nothing and its component is null; an empty table gives no rows; other columns are ignored.
Shingle equality is equality of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import corpus_size, discard, materialise, read, tidy
from .components import UnionFind, components
from .textkit import shingle_sets

NGRAM, CHUNK_BYTES = 5, 6 << 20
#: Similarity at least NUM / DEN.
NUM, DEN = 3, 4


def enough(inter: int, n: int, m: int) -> bool:
    """intersection / union >= NUM / DEN, in integers."""
    return (NUM + DEN) * inter >= NUM * (n + m)


class PrefixTree:
    """A compressed trie of sequences of token numbers."""

    __slots__ = ("edge", "kids", "low", "high", "ends")

    def __init__(self, edge: np.ndarray) -> None:
        self.edge, self.kids, self.low, self.high, self.ends = edge, {}, 1 << 60, 0, []

    def insert(self, seq: np.ndarray, item: int) -> None:
        node, at, n = self, 0, len(seq)
        node.low, node.high = min(node.low, n), max(node.high, n)
        while at < n:
            kid = node.kids.get(int(seq[at]))
            if kid is None:
                leaf = PrefixTree(seq[at:])
                leaf.low = leaf.high = n
                leaf.ends.append(item)
                node.kids[int(seq[at])] = leaf
                return
            m = min(len(kid.edge), n - at)
            differ = np.flatnonzero(kid.edge[:m] != seq[at : at + m])
            m = int(differ[0]) if len(differ) else m
            if m < len(kid.edge):  # split the edge
                upper = PrefixTree(kid.edge[:m])
                upper.low, upper.high = kid.low, kid.high
                kid.edge = kid.edge[m:]
                upper.kids[int(kid.edge[0])] = kid
                node.kids[int(seq[at])] = upper
                kid = upper
            kid.low, kid.high = min(kid.low, n), max(kid.high, n)
            node, at = kid, at + m
        node.ends.append(item)

    def matches(self, mark: np.ndarray, n: int, skip) -> Iterator[int]:
        """Items similar to the set whose tokens are marked; skip(item) is asked before an item's own edge is read."""
        stack = [(kid, 0, 0) for kid in self.kids.values()]
        while stack:
            node, overlap, depth = stack.pop()
            # the longest set below can add at most what it has left; the shortest must not be too short or long
            if (NUM + DEN) * (overlap + node.high - depth) < NUM * (n + node.high) or DEN * n < NUM * node.low or DEN * node.high < NUM * n:
                continue
            if not node.kids and all(skip(i) for i in node.ends):
                continue
            overlap += int(np.count_nonzero(mark[node.edge]))
            depth += len(node.edge)
            for i in node.ends:
                if enough(overlap, n, depth):
                    yield i
            stack.extend((kid, overlap, depth) for kid in node.kids.values())


def join_sets(ids_a, sets_a, labels_a, ids_b=None, sets_b=None, labels_b=None) -> list[tuple[int, int]]:
    """Links that connect: pairs of similar sets, of one chunk (b is None) or between two, without those
    whose ends are connected already (by label or by an earlier pair). Sets come in the global order."""
    same = ids_b is None
    uf = UnionFind()
    node = dict(zip(ids_a, labels_a)) | ({} if same else dict(zip(ids_b, labels_b)))
    everything = sets_a if same else sets_a + sets_b
    # numbers for the tokens; sequences stay in the global order
    tokens, flat = np.unique(np.concatenate(everything), return_inverse=True)
    bounds = np.cumsum([0] + [len(s) for s in everything])
    seqs = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    mark = np.zeros(len(tokens), dtype=bool)
    links = []
    tree = PrefixTree(np.zeros(0, dtype=np.int64))

    def probe(seq, me) -> None:
        mark[seq] = True
        skip = lambda i: uf.find(node[ids_a[i]]) == uf.find(node[me])
        for i in tree.matches(mark, len(seq), skip):
            if uf.union(node[ids_a[i]], node[me]):
                links.append((ids_a[i], me))
        mark[seq] = False

    for i in sorted(range(len(ids_a)), key=lambda i: (len(seqs[i]), ids_a[i])):
        if same:
            probe(seqs[i], ids_a[i])
        tree.insert(seqs[i], i)
    if not same:
        for i, me in enumerate(ids_b):
            probe(seqs[len(ids_a) + i], me)
    return links


def set_digests(docs: DataFrame, n_blocks: int) -> DataFrame:
    """doc_id, blk, n_shingles, digest (null without shingles) for each row of doc_id, text."""

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [b"" if not t.is_valid else t.as_buffer().to_pybytes().lower() for t in part.column(1)]
                sets = shingle_sets(texts, NGRAM)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                cols = [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "blk", "n_shingles", "digest"])

    rows = docs.select("doc_id", "text", B.block_of(["doc_id", "text"], n_blocks).alias("blk"))
    return rows.mapInArrow(digest, "doc_id long, blk int, n_shingles long, digest binary")


def _survivors(docs: DataFrame, chosen: DataFrame, size: int, n_blocks: int) -> DataFrame:
    """doc_id, n, prefix (shared prefix shingles), shingles (binary, most frequent first): the sets that can link with another.

    chosen: doc_id, blk of one document for each distinct set.
    """
    n_keys = size // 6 + 1
    bits, ranges = B.key_bits(n_keys), B.range_count(n_keys)
    narrow = np.uint64(64 - bits)
    held = B.dealt(docs, ["doc_id", "text"], n_blocks).repartition(F.col("blk"))

    def sets_of(left: pa.Table, ids: list[int]) -> tuple[list[int], list[np.ndarray]]:
        docs = B.unpack_tables(left.column("payload"))
        wanted, have = set(ids), docs.column("doc_id").to_pylist()
        pick = [i for i, d in enumerate(have) if d in wanted]
        sets = shingle_sets([t.lower() for t in B.texts_of(docs.take(pa.array(pick, pa.int64())))], NGRAM)
        return [have[i] for i in pick], sets

    @tidy
    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return B.cells_table([])
        _, sets = sets_of(left, right.column("doc_id").to_pylist())
        keys = [np.unique(s >> narrow) for s in sets]
        keys, many = B.distinct_with_many(np.concatenate(keys))
        return B.presence_cells(left.column("blk")[0].as_py(), keys, many, ranges, bits)

    answers = B.shared(held.groupBy("blk").cogroup(chosen.groupBy("blk")).applyInArrow(tell, B.CELL))
    none = lambda kind: F.lit(None).cast(kind)
    told = answers.select("blk", "rng", "payload", none("long").alias("doc_id")).unionByName(chosen.select("blk", none("int").alias("rng"), none("binary").alias("payload"), "doc_id"))
    names = ["doc_id", "n", "prefix", "shingles"]

    @tidy
    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            is_id = right.column("doc_id").is_valid()
            ids, sets = sets_of(left, right.filter(is_id).column("doc_id").to_pylist())
            keys, holders = B.read_shared(right.filter(pc.invert(is_id)))
            for i, s in zip(ids, sets):
                n = len(s)
                at = B.find(keys, s >> narrow)
                prefix = n - -(-NUM * n // DEN) + 1
                alone = int((at < 0).sum())
                if alone >= prefix:
                    continue
                weight = np.where(at < 0, 0, holders[at] if len(holders) else 0)
                ordered = s[np.lexsort((s, weight))]
                rows.append((i, n, ordered[alone:prefix].astype(np.int64), ordered[::-1].astype("<u8").tobytes()))
        cols = [[r[k] for r in rows] for k in range(4)]
        return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], names)

    return held.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(keep, "doc_id long, n long, prefix array<long>, shingles binary")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in column]


def _links_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _groups(table: pa.Table, names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The parts of a table with equal values in some columns: several small jobs share a task's call."""
    table = table.sort_by([(n, "ascending") for n in names])
    keys = [table.column(n).to_numpy() for n in names]
    cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    for a, b in zip([0, *cut], [*cut, table.num_rows]):
        yield table.slice(int(a), int(b - a))


@tidy
def _with_heads(table: pa.Table) -> pa.Table:
    """Links of the heads of a group of (head, chunk) jobs with the chunks."""
    out: list[tuple[int, int]] = []
    for job in _groups(table, ("head", "chunk")):
        ids, sets, head = job.column("doc_id").to_pylist(), _arrays(job.column("shingles")), job.column("head")[0].as_py()
        others = [i for i, d in enumerate(ids) if d != head]
        if head in ids and others:
            mine = [ids[i] for i in others]
            # the head itself is the one set that traverses; it may link with all
            out += join_sets(mine, [sets[i] for i in others], mine, [head], [sets[ids.index(head)]], [head])
    return _links_table(out)


@tidy
def _in_postings(table: pa.Table) -> pa.Table:
    """Links of a group of (posting, x, y) jobs: inside a chunk (x = y), or between two."""
    out: list[tuple[int, int]] = []
    for job in _groups(table, ("posting", "x", "y")):
        sides = [job.filter(pc.equal(job.column("side"), k)) for k in (0, 1)]
        args = [(t.column("doc_id").to_pylist(), _arrays(t.column("shingles")), t.column("label").to_pylist()) for t in sides]
        if job.column("x")[0].as_py() == job.column("y")[0].as_py():
            if len(args[0][0]) > 1:
                out += join_sets(*args[0])
        elif args[0][0] and args[1][0]:
            out += join_sets(*args[0], *args[1])
    return _links_table(out)


def _bins(size: Column, total: int, *own: str) -> Column:
    """A group number: small jobs share groups of about a chunk, a job of a chunk's size has one of its own."""
    bins = max(24, -(-2 * total // CHUNK_BYTES))
    return F.when(size * 4 < CHUNK_BYTES, F.pmod(F.xxhash64(*own), F.lit(bins))).otherwise(F.xxhash64(F.lit(5), *own)).alias("grp")


def _near(n: Column, m: Column) -> Column:
    """Sets of these sizes can link."""
    return DEN * F.least(n, m) >= NUM * F.greatest(n, m)


def _met(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: the pairs (head, doc_id, n) that are links."""
    pairs = materialise(pairs, "head-pairs")
    sizes = pairs.groupBy("head").agg(F.sum(F.col("n") * 8).alias("bytes")).withColumn("chunks", F.ceil(F.col("bytes") / CHUNK_BYTES).cast("int"))
    sizes = materialise(sizes, "head-sizes")
    total = int(sizes.agg(F.sum("bytes")).first()[0] or 0)
    grp = _bins(F.col("bytes") / F.col("chunks"), total, "head", "chunk")
    members = pairs.select("head", "doc_id").join(sizes, "head").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    heads = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("doc_id", F.col("head"))
    shipped = members.select("head", "chunk", "doc_id", grp).unionByName(heads.select("head", "chunk", "doc_id", grp)).join(sets.select("doc_id", "shingles"), "doc_id")
    links = materialise(shipped.groupBy("grp").applyInArrow(_with_heads, "a long, b long"), "head-links")
    discard(pairs, sizes)
    return links


def _head_links(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """a, b: links between the heads of postings and their other members that connect.

    A set meets the least of its heads, and then those heads from which it is still apart."""
    head = tokens.groupBy("token").agg(F.min(F.struct("doc_id", "n")).alias("h"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", F.col("h.doc_id").alias("head"), F.col("h.n").alias("m"))
    pairs = tokens.join(head, "token").where((F.col("doc_id") != F.col("head")) & _near(F.col("n"), F.col("m"))).select("head", "doc_id", "n").distinct()
    pairs = materialise(pairs, "pairs")
    first = _met(sets, pairs.groupBy("doc_id", "n").agg(F.min("head").alias("head")))
    label = components(first)
    of = lambda node, name: label.select(F.col("node").alias(node), F.col("component").alias(name))
    apart = pairs.join(of("doc_id", "x"), "doc_id", "left").join(of("head", "y"), "head", "left").where(F.coalesce("x", "doc_id") != F.coalesce("y", "head"))
    least = pairs.groupBy("doc_id").agg(F.min("head").alias("head"))
    second = _met(sets, apart.select("head", "doc_id", "n").join(least, ["doc_id", "head"], "left_anti"))
    discard(pairs)
    return first.unionByName(second)


def _hung_together(member: DataFrame) -> DataFrame:
    """member (posting, doc_id, n, label, class) with postings that share documents made one, where all their sets fit into one chunk."""
    first = member.groupBy("posting").agg(F.min("doc_id").alias("first"))
    whole = components(member.join(first, "posting").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    placed = member.join(whole, F.col("doc_id") == F.col("node"), "left").withColumn("whole", F.xxhash64(F.lit(1), F.coalesce("component", "doc_id")))
    once = placed.select("whole", "doc_id", "n", "label").distinct()
    fits = once.groupBy("whole").agg(F.sum(F.col("n") * 8).alias("bytes")).where(F.col("bytes") <= CHUNK_BYTES).select("whole")
    together = once.join(fits, "whole").select(F.col("whole").alias("posting"), "doc_id", "n", "label", F.lit(0).alias("class"))
    return materialise(together.unionByName(placed.join(fits, "whole", "left_anti").select(*together.columns)), "members")


def _posting_links(sets: DataFrame, tokens: DataFrame, links: DataFrame) -> DataFrame | None:
    """a, b: links between members of a posting that the links so far leave apart; None if there are no such postings."""
    label = components(links)
    labelled = tokens.join(label, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    labelled = materialise(labelled, "labelled")
    head = labelled.groupBy("token").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 2").select("token", "head")
    rest = labelled.join(head, "token").where("doc_id <> head")  # heads have met all
    signed = rest.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("doc_id")).alias("s"), F.bit_xor(F.xxhash64(F.lit(3), "doc_id")).alias("t")).where("lo <> hi")
    chosen = materialise(signed.groupBy("k", "s", "t").agg(F.min("token").alias("posting")).select("posting"), "postings")
    if chosen.isEmpty():
        discard(labelled, chosen)
        return None
    # sizes of linked sets differ by less than one class: a class is the next if sizes are DEN / NUM apart
    size_class = F.floor(F.log("n") / float(np.log(DEN / NUM)) + 1e-9).cast("int")
    member = rest.join(chosen, rest["token"] == chosen["posting"]).select("posting", "doc_id", "n", "label", size_class.alias("class"))
    member = _hung_together(materialise(member, "members"))
    chunks = member.groupBy("posting", "class").agg(F.ceil(F.sum(F.col("n") * 8) / CHUNK_BYTES).cast("int").alias("chunks"))
    cell = F.col("class") * 1_000_000 + F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    member = materialise(member.join(chunks, ["posting", "class"]).withColumn("cell", cell.cast("long")), "cells")
    spread = member.groupBy("posting", "class", "cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.col("n") * 8).alias("bytes"))
    x, y = spread.alias("x"), spread.withColumn("near", F.explode(F.array(F.col("class"), F.col("class") - 1))).alias("y")
    apart = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    # the jobs are pairs of chunks of one posting, in one class or two neighbours, that are not in one component
    jobs = x.join(y, (F.col("x.posting") == F.col("y.posting")) & (F.col("x.class") == F.col("y.near")) & ((F.col("x.class") < F.col("y.class")) | (F.col("x.cell") <= F.col("y.cell"))) & apart)
    jobs = materialise(jobs.select("x.posting", F.col("x.cell").alias("x"), F.col("y.cell").alias("y"), (F.col("x.bytes") + F.col("y.bytes")).alias("bytes")), "jobs")
    total = int(jobs.agg(F.sum("bytes")).first()[0] or 0)
    side = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("cell"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("y").alias("cell"), F.lit(1).alias("side"))))
    sides = jobs.select("posting", "x", "y", _bins(F.col("bytes"), total, "posting", "x", "y"), F.explode(side).alias("c")).select("posting", "x", "y", "grp", "c.*")
    shipped = sides.join(member.select("posting", "cell", "doc_id", "label"), ["posting", "cell"]).join(sets.select("doc_id", "shingles"), "doc_id")
    more = materialise(shipped.groupBy("grp").applyInArrow(_in_postings, "a long, b long"), "posting-links")
    discard(labelled, chosen, member, jobs)
    return more


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) for each input row; ids are long."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, size = corpus_size(docs)
    n_blocks = B.block_count(size)
    digests = materialise(set_digests(docs, n_blocks), "digests")
    linkable = digests.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialise(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "blk")).alias("r"), F.count(F.lit(1)).alias("copies")).select("digest", "r.doc_id", "r.blk", "copies"), "classes")
    sets = materialise(_survivors(docs, classes.select("doc_id", "blk"), size, n_blocks), "sets")
    tokens = materialise(sets.select("doc_id", "n", F.explode("prefix").alias("token")), "prefixes")
    links = _head_links(sets, tokens)
    more = _posting_links(sets, tokens, links)
    discard(sets, tokens)

    copies = linkable.join(classes.where("copies > 1").select("digest", F.col("doc_id").alias("rep")), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(links.unionByName(copies) if more is None else links.unionByName(more).unionByName(copies))
    out = digests.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))


#: c6: doc_id, component_id. `{docs}` has distinct ids.
SQL_CTES = """
j_w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}),
j_g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM j_w)),
j_n AS (SELECT doc_id, count(*) AS n FROM j_g GROUP BY doc_id),
j_p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM j_g a JOIN j_g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
j_l AS (SELECT a, b FROM j_p JOIN j_n x ON x.doc_id = a JOIN j_n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
j_e AS (SELECT a, b FROM j_l UNION ALL SELECT b, a FROM j_l),
j_r AS (SELECT doc_id AS node, doc_id AS seen FROM {docs} UNION SELECT r.node, e.b FROM j_r r JOIN j_e e ON r.seen = e.a),
j_c AS (SELECT node AS doc_id, min(seen) AS component_id FROM j_r GROUP BY node)
"""
OP6_SQL = "WITH RECURSIVE " + SQL_CTES.format(docs="documents") + "SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM j_w w LEFT JOIN j_n USING (doc_id) JOIN j_c USING (doc_id)"
