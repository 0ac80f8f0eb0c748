"""Quality by perplexity: an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted rows (labels: quality 1, toxic 0) are split by a hash of the id: nine tenths train, one tenth is held
out. Documents lie in blocks by a hash of the id; counts are sharded and exact but for equal 64-bit hashes of words:

1. each block tells word shards its distinct words; a shard numbers its words and answers with the numbers, so a
   bigram is a pair of short numbers;
2. each block tells bigram shards its distinct bigrams, each with its count in the block's training texts. A shard adds
   up the counts of all blocks, and answers each block with the sums of the bigrams it told: the join that counts is
   also the one that asks. Keys are mixed, so that a frequent word is spread over all shards;
3. sums per left word (tokens, followers seen once, twice, more) and per right word (distinct left words) go on as
   partial sums to the word shards, which answer the blocks. Discounts come from counts of counts;
4. each block scores its documents from the answers: p(w|v) = max(c(vw) - D, 0) / c(v) + g(v) p(w), where p(w) is the
   discounted share of distinct left words, interpolated with 1 / vocabulary.

A document is kept if its log perplexity is at most that of the QUANTILE of its language's held-out trusted
texts, plus SLACK and SHORT / words (a few words say little). What is asked and answered grows with the corpus.

Defined results: a text without words has perplexity null and is not kept; null language is one of its own; a
language without held-out text keeps all its texts; repeated rows are scored each, and count once each if they train;
a null id is scored and never trains; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import corpus_size, materialise, read, release, tidy
from .textkit import word_hashes

QUANTILE, SLACK, SHORT = 0.99, 0.25, 8.0
START = np.uint64(0x51A27)
BLOCK_BYTES = 16 << 20
_ODD = 0x9E3779B97F4A7C15


class Mixer:
    """A bijection of numbers below 2**bits (even, at most 64) that spreads them, and its inverse."""

    def __init__(self, bits: int) -> None:
        self.mask, self.half, self.back = np.uint64((1 << bits) - 1), np.uint64(bits // 2), np.uint64(pow(_ODD, -1, 1 << bits))

    def there(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = (x * np.uint64(_ODD)) & self.mask
            x = x ^ (x >> self.half)
        return x

    def again(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x ^ (x >> self.half)
            x = (x * self.back) & self.mask
        return x


def block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, left, right, first) of lower-cased texts: 64-bit hashes, START among them, and for each word the
    places of it and of the one before; the left of a first word is START."""
    words, first = word_hashes([t.lower() for t in texts])
    every, right = np.unique(np.concatenate([[START], words]).astype(np.uint64), return_inverse=True)
    start, right = right[0], right[1:]
    left = np.concatenate([[start], right[:-1]])[: len(right)]
    left[first[:-1][np.diff(first) > 0]] = start
    return every, left, right, first


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2, 3 and more, from how many have counts 1, 2, 3, 4."""
    n1, n2, n3, n4 = (max(0, int(x)) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d1 = min(max(1 - 2 * y * n2 / n1, 0.05), 1.0)
    d2 = min(max(2 - 3 * y * n3 / n2, d1), 2.0) if n3 else d1
    d3 = min(max(3 - 4 * y * n4 / n3, d2), 3.0) if n3 and n4 else d2
    return d1, d2, d3


def discount_of(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
    return k[begin], *[np.add.reduceat(v[order], begin) if len(k) else v for v in values]


ROW = "kind int, rng int, blk int, payload binary, n1 long, n2 long, n3 long, n4 long, total long, size long"
_NAMES = ["kind", "rng", "blk", "payload", "n1", "n2", "n3", "n4", "total", "size"]
BIGRAMS, WORDS, IDS = 0, 1, 2


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 6]
    return pa.Table.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], kinds[i]) for i in range(10)], _NAMES)


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _counts(*values: np.ndarray) -> bytes:
    return zlib.compress(b"".join(B.pack_counts(v) for v in values), 1)


def _read_counts(data: bytes, n_values: int) -> list[np.ndarray]:
    data, at, out = zlib.decompress(data), 0, []
    for _ in range(n_values):
        v, at = B.unpack_counts(data, at)
        out.append(v)
    return out


def _bytes(payload) -> list[bytes]:
    return [p.as_buffer().to_pybytes() for p in payload]


def _of_kind(table: pa.Table, kind: int) -> dict[int, bytes]:
    """The payloads of a block's rows of a kind, by range."""
    part = table.filter(pc.equal(table.column("kind"), kind))
    return dict(zip(part.column("rng").to_pylist(), _bytes(part.column("payload"))))


def perplexity(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, held_out for each row; trusted: doc_id of the trusted texts; ids are long."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    _, size = corpus_size(docs)
    n_blocks, n_keys = B.block_count(size, BLOCK_BYTES), size // 6 + 1
    ranges = B.range_count(n_keys)
    by_id = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    held = B.dealt(docs, ["doc_id", "text", "lang"], n_blocks, by_id(F.coalesce("doc_id", F.xxhash64("text")))).repartition(F.col("blk"))
    marked = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("u", F.xxhash64(F.lit(11), "doc_id"))
    marked = materialise(marked.select("doc_id", (F.pmod("u", F.lit(10)) != 0).alias("train"), by_id(F.col("doc_id")).alias("blk")), "trusted")

    # 1. words to numbers
    @tidy
    def tell_words(table: pa.Table) -> pa.Table:
        every, *_ = block_words(B.texts_of(B.unpack_tables(table.column("payload"))))
        blk = table.column("blk")[0].as_py()
        return _table([(IDS, r, blk, B.pack_keys(every[a:b])) for r, a, b in B.cuts(every, ranges, 64)])

    @tidy
    def number(table: pa.Table) -> pa.Table:
        told = [B.unpack_keys(p)[0] for p in _bytes(table.column("payload"))]
        known = np.unique(np.concatenate(told))
        rng = table.column("rng")[0].as_py()
        return _table([(IDS, rng, blk, B.pack_keys(np.searchsorted(known, t).astype(np.uint64)), *[None] * 5, len(known)) for blk, t in zip(table.column("blk").to_pylist(), told)])

    numbers = materialise(held.groupBy("blk").applyInArrow(tell_words, ROW).groupBy("rng").applyInArrow(number, ROW), "kn-numbers")
    most = numbers.agg(F.max("size")).first()[0] or 1
    vast = most * ranges  # numbers are below this: those of range r are r * most + i
    if vast >= 1 << 32:
        raise ValueError("more words than 32-bit numbers")
    bits = max(10, (vast * vast - 1).bit_length() + 1 & ~1)
    release(docs.sparkSession)
    mixer = Mixer(bits)

    def block(held: pa.Table, told: pa.Table):
        """(documents, distinct words, first, their numbers, left and right places, distinct bigrams, place of each word's bigram)."""
        docs = B.unpack_tables(held.column("payload"))
        every, left, right, first = block_words(B.texts_of(docs))
        ids, said = np.zeros(len(every), dtype=np.uint64), _of_kind(told, IDS)
        for r, a, b in B.cuts(every, ranges, 64):
            ids[a:b] = B.unpack_keys(said[r])[0] + np.uint64(r * most)
        keys, place = np.unique(mixer.there(ids[left] * np.uint64(vast) + ids[right]), return_inverse=True)
        return docs, every, first, ids, left, right, keys, place

    # 2. bigrams and their training counts
    flags = lambda rows: rows.select("blk", *[F.lit(None).cast(k).alias(n) for n, k in (("kind", "int"), ("rng", "int"), ("payload", "binary"))], "doc_id")
    with_ids = numbers.select("blk", "kind", "rng", "payload", F.lit(None).cast("long").alias("doc_id"))

    @tidy
    def tell_bigrams(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        docs, _, first, _, _, _, keys, place = block(left, right)
        train = set(right.column("doc_id").drop_null().to_pylist())
        mine = np.repeat([d in train for d in docs.column("doc_id").to_pylist()], np.diff(first))
        c = np.bincount(place[mine], minlength=len(keys)).astype(np.int64)
        blk = left.column("blk")[0].as_py()
        return _table([(BIGRAMS, r, blk, B.pack_keys(keys[a:b]) + _counts(c[a:b])) for r, a, b in B.cuts(keys, ranges, bits)])

    @tidy
    def add_up(table: pa.Table) -> pa.Table:
        rng, blks, told, counts = table.column("rng")[0].as_py(), table.column("blk").to_pylist(), [], []
        for data in _bytes(table.column("payload")):
            keys, at = B.unpack_keys(data)
            told.append(keys)
            counts += _read_counts(data[at:], 1)
        keys, place = np.unique(np.concatenate(told), return_inverse=True)
        c = np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
        rows, lo = [], 0
        for blk, t in zip(blks, told):
            rows.append((BIGRAMS, rng, blk, _counts(c[place[lo : lo + len(t)]])))
            lo += len(t)
        keys, c = keys[c > 0], c[c > 0]
        pair, z = mixer.again(keys), np.zeros(len(c), dtype=np.int64)
        ids = np.concatenate(np.divmod(pair, np.uint64(vast)))
        ids, *sums = _sum_by(ids, *[np.concatenate([a, b]) for a, b in ((c, z), ((c == 1) * 1, z), ((c == 2) * 1, z), ((c >= 3) * 1, z), (z, z + 1))])
        edge = np.concatenate([[0], np.flatnonzero(np.diff(ids // np.uint64(most))) + 1, [len(ids)]]) if len(ids) else np.zeros(1, dtype=np.int64)
        rows += [(WORDS, int(ids[a]) // most, None, B.pack_keys(ids[a:b]) + _counts(*[s[a:b] for s in sums])) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return _table([*rows, (None, None, None, None, *_of_counts(c), int(c.sum()), len(c))])

    with_train = with_ids.unionByName(flags(marked.where("train")))
    told = held.groupBy("blk").cogroup(with_train.groupBy("blk")).applyInArrow(tell_bigrams, ROW)
    counted = materialise(told.groupBy("rng").applyInArrow(add_up, ROW), "kn-bigrams")
    release(docs.sparkSession)

    # 3. sums of words
    @tidy
    def add_words(known: pa.Table, asking: pa.Table) -> pa.Table:
        """For each asking block the five sums of the words that it told, in order, 0 where unknown; and counts of counts."""
        if not asking.num_rows:
            return _table([])
        rng, runs = asking.column("rng")[0].as_py(), []
        for data in _bytes(known.column("payload")):
            ids, at = B.unpack_keys(data)
            runs.append((ids, *_read_counts(data[at:], 5)))
        none = np.zeros(0, dtype=np.int64)
        ids, *sums = _sum_by(*[np.concatenate([r[k] for r in runs]) for k in range(6)]) if runs else (none.astype(np.uint64), *[none] * 5)
        rows = []
        for blk, data in zip(asking.column("blk").to_pylist(), _bytes(asking.column("payload"))):
            at = B.find(ids, B.unpack_keys(data)[0] + np.uint64(rng * most))
            rows.append((WORDS, rng, blk, _counts(*[np.where(at >= 0, s[at] if len(s) else 0, 0) for s in sums])))
        return _table([*rows, (None, None, None, None, *_of_counts(sums[4]), int(sums[4].sum()), len(ids))])

    stats = materialise(counted.where(F.col("kind") == WORDS).groupBy("rng").cogroup(numbers.groupBy("rng")).applyInArrow(add_words, ROW), "kn-words")
    total = lambda df: [int(x or 0) for x in df.where("kind IS NULL").agg(*[F.sum(c) for c in _NAMES[4:]]).first()]
    n2, n1 = total(counted), total(stats)
    d2, d1 = discounts(n2[:4]), discounts(n1[:4])
    types, vocabulary = max(1, n1[4]), max(1, n1[5])
    rare = (d1[0] * n1[0] + d1[1] * n1[1] + d1[2] * max(0, vocabulary - n1[0] - n1[1])) / types
    names = ["doc_id", "lang", "n_words", "log_perplexity", "held_out"]

    # 4. scores
    @tidy
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_())], names)
        docs, every, first, _, lw, rw, keys, place = block(left, right)
        c2, said = np.zeros(len(keys), dtype=np.int64), _of_kind(right, BIGRAMS)
        for r, a, b in B.cuts(keys, ranges, bits):
            c2[a:b], = _read_counts(said[r], 1)
        sums, said = np.zeros((5, len(every)), dtype=np.int64), _of_kind(right, WORDS)
        for r, a, b in B.cuts(every, ranges, 64):
            sums[:, a:b] = _read_counts(said[r], 5)
        c, f1, f2, f3, cont = sums
        p1 = np.maximum(cont - discount_of(cont, d1), 0) / types + rare / (vocabulary + 1) + 1e-12
        gamma = np.where(c > 0, (d2[0] * f1 + d2[1] * f2 + d2[2] * f3) / np.maximum(c, 1), 1.0)
        cc, total_left = c2[place], c[lw].astype(np.float64)
        p = np.where(total_left > 0, np.maximum(cc - discount_of(cc, d2), 0) / np.maximum(total_left, 1), 0) + gamma[lw] * p1[rw]
        upto = np.concatenate([[0.0], np.cumsum(-np.log(np.maximum(p, 1e-30)))])
        n = np.diff(first)
        with np.errstate(invalid="ignore", divide="ignore"):
            lp = (upto[first[1:]] - upto[first[:-1]]) / n
        out = set(right.column("doc_id").drop_null().to_pylist())
        held_out = [d in out for d in docs.column("doc_id").to_pylist()]
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("lang"), pa.array(n), pa.array(lp, mask=n == 0), pa.array(held_out)], names)

    answers = counted.where(F.col("kind") == BIGRAMS).unionByName(stats.where(F.col("kind") == WORDS)).select("blk", "kind", "rng", "payload", F.lit(None).cast("long").alias("doc_id"))
    answers = answers.unionByName(with_ids).unionByName(flags(marked.where("not train")))
    return held.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(score, "doc_id long, lang string, n_words long, log_perplexity double, held_out boolean")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, **columns) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, threshold, kept for each row."""
    scored = materialise(perplexity(docs, trusted, **columns), "perplexity")
    limits = scored.where("held_out").groupBy("lang").agg((F.percentile_approx("log_perplexity", quantile, 10_000) + slack).alias("threshold")).withColumnRenamed("lang", "l")
    out = scored.join(F.broadcast(limits) if limits.count() <= 10_000 else limits, F.col("lang").eqNullSafe(F.col("l")), "left")
    kept = F.col("log_perplexity").isNotNull() & F.coalesce(F.col("log_perplexity") <= F.col("threshold") + SHORT / F.col("n_words"), F.lit(True))
    return out.select("doc_id", "lang", "n_words", "log_perplexity", "threshold", kept.alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return classify(read(spark, sf_dir, "documents"), trusted)
