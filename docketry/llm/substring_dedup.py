"""Removal of word runs that a smaller document already has, with difference-cover anchors.

Seven-word windows are hashed only at positions whose place in the document modulo 7 lies in the
difference cover {0, 1, 3}. For any two positions there is an offset below 7 that brings both into the
cover, so two equal 13-word windows share an aligned anchor inside them. Steps:

1. each block of documents tells the key ranges its distinct anchors (narrow keys);
2. the ranges answer with the anchors that two documents hold;
3. shared anchors are extended to the 13-word windows around them, and each block tells each such
   window (64-bit hash) with its smallest document;
4. the ranges answer with the windows that a smaller document outside the block has;
5. the block removes the words of these windows and of those that a smaller document inside has.

Windows are equal when their 64-bit hashes are (for w candidate windows about w*w / 2**65 chance
pairs in all). A passage in a third of all documents is one entry per block.

Defined results: null text has no words; rows with a null id neither remove nor lose words; rows of one
id do not remove one another's words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import corpus_size, read, tidy
from .textkit import windows_of, word_hashes

WINDOW, PERIOD = 13, 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1


def anchors_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the anchors: windows of ANCHOR words at cover positions."""
    h, at = windows_of(words, first, ANCHOR)
    place = at - np.repeat(first[:-1], np.diff(first))[at]
    ok = np.isin(place % PERIOD, COVER)
    return h[ok], at[ok]


def _block(table: pa.Table):
    """Documents of a block with an id: (rows table, ids, words, first)."""
    docs = B.unpack_tables(table.column("payload"))
    words, first = word_hashes(B.texts_of(docs))
    has_id = docs.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    ids = docs.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
    return docs, has_id, ids, words, first


def _narrow(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text, for each input row; ids are long."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, size = corpus_size(docs)
    n_blocks, n_anchors = B.block_count(size), size // 15 + 1
    bits, ranges = B.key_bits(n_anchors), B.range_count(n_anchors)
    held = B.dealt(docs, ["doc_id", "text"], n_blocks).repartition(F.col("blk"))

    @tidy
    def tell_anchors(table: pa.Table) -> pa.Table:
        _, has_id, ids, words, first = _block(table)
        h, at = anchors_of(words, first)
        doc = np.searchsorted(first, at, side="right") - 1
        keep = has_id[doc]
        h, who = _narrow(h[keep], bits), ids[doc[keep]]
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        keys, many = B.distinct_with_many(h[fresh])
        return B.presence_cells(table.column("blk")[0].as_py(), keys, many, ranges, bits)

    anchors = B.shared(held.groupBy("blk").applyInArrow(tell_anchors, B.CELL))

    @tidy
    def tell_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return B.cells_table([])
        _, has_id, ids, words, first = _block(left)
        keys, _ = B.read_shared(right)
        h, at = anchors_of(words, first)
        hit = at[B.find(keys, _narrow(h, bits)) >= 0]
        upto = np.zeros(len(words) + PERIOD + 2, dtype=np.int32)
        upto[hit + 1] = 1
        upto = np.cumsum(upto, dtype=np.int32)
        win, pos = windows_of(words, first, WINDOW)
        near = (upto[pos + PERIOD] - upto[pos]) > 0
        win, pos = win[near], pos[near]
        doc = np.searchsorted(first, pos, side="right") - 1
        keep = has_id[doc]
        win, who = win[keep], ids[doc[keep]]
        order = np.lexsort((who, win))
        win, who = win[order], who[order]
        fresh = np.concatenate([[True], win[1:] != win[:-1]])[: len(win)]
        win, who = win[fresh], who[fresh]
        blk = left.column("blk")[0].as_py()
        return B.cells_table([(r, blk, B.pack_keys(win[a:b]) + who[a:b].astype("<i8").tobytes()) for r, a, b in B.cuts(win, ranges, 64)])

    windows = held.groupBy("blk").cogroup(anchors.groupBy("blk")).applyInArrow(tell_windows, B.CELL)

    @tidy
    def smaller_elsewhere(table: pa.Table) -> pa.Table:
        blks, parts, mins = table.column("blk").to_pylist(), [], []
        for p in table.column("payload"):
            data = p.as_buffer().to_pybytes()
            keys, at = B.unpack_keys(data)
            parts.append(keys)
            mins.append(np.frombuffer(data, dtype="<i8", offset=at))
        keys, who = np.concatenate(parts), np.concatenate(mins)
        order = np.argsort(keys, kind="stable")
        begin = np.concatenate([[0], np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1])
        low = np.empty(len(keys), dtype=np.int64)
        low[order] = np.repeat(np.minimum.reduceat(who[order], begin), np.diff(np.concatenate([begin, [len(keys)]])))
        rows, lo = [], 0
        for blk, part in zip(blks, parts):
            hi = lo + len(part)
            hit = low[lo:hi] < who[lo:hi]
            if hit.any():
                rows.append((table.column("rng")[0].as_py(), blk, B.pack_keys(part[hit])))
            lo = hi
        return B.cells_table(rows)

    elsewhere = windows.groupBy("rng").applyInArrow(smaller_elsewhere, B.CELL)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    @tidy
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())] * (1 + with_text), names)
        docs, has_id, ids, words, first = _block(left)
        keys, _ = B.read_shared(right)
        win, pos = windows_of(words, first, WINDOW)
        doc = np.searchsorted(first, pos, side="right") - 1
        gone = B.find(keys, win) >= 0
        # smallest document in the block
        who = np.where(has_id[doc], ids[doc], np.iinfo(np.int64).max)
        order = np.lexsort((who, win))
        begin = np.flatnonzero(np.concatenate([[True], win[order][1:] != win[order][:-1]])[: len(win)])
        low = np.empty(len(win), dtype=np.int64)
        if len(win):
            low[order] = np.repeat(who[order][begin], np.diff(np.concatenate([begin, [len(win)]])))
        gone = (gone | (low < who)) & has_id[doc]
        mark = np.zeros(len(words) + WINDOW + 1, dtype=np.int32)
        np.add.at(mark, pos[gone], 1)
        np.add.at(mark, pos[gone] + WINDOW, -1)
        keep = np.cumsum(mark)[: len(words)] == 0
        n_removed, shas, kept_texts = [], [], []
        texts = B.texts_of(docs)
        for i, text in enumerate(texts):
            k = keep[first[i] : first[i + 1]]
            n_removed.append(int(len(k) - k.sum()))
            kept = b" ".join(compress(text.split(), k.tolist()))
            shas.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode("utf-8", "replace") if n_removed[-1] else text.decode("utf-8", "replace"))
        cols = [docs.column("doc_id"), pa.array(np.diff(first)), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())] + [pa.array(kept_texts, pa.string())] * with_text
        return pa.Table.from_arrays(cols, names)

    return held.groupBy("blk").cogroup(elsewhere.groupBy("blk")).applyInArrow(remove, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


OP9_SQL = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM g) WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(13)) AS j)),
e AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT e.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
