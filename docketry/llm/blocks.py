"""Blocks of documents, and exchanges of sorted keys between blocks and key ranges.

Rows are dealt by a hash to blocks of some MB of text (so neither a source, a key nor a group of copies
can overload one). A block tells each key range once about each distinct key that it holds, as a
delta-coded run; a range merges the runs of all blocks and answers each block alone. A key that sits in
a third of all rows costs one entry per block, and memory is bounded by the size of a block or of a
range, both of which are fixed while their numbers grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

BLOCK_BYTES, RANGE_KEYS, LEAST = 3 << 20, 1 << 21, 64
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(LEAST, -(-total_bytes // block_bytes))


def range_count(total_keys: int) -> int:
    return max(LEAST, -(-total_keys // RANGE_KEYS))


def key_bits(total_keys: int) -> int:
    """Bits of narrow keys: 32 times as many values as keys, so chance sharing stays near 3 %."""
    return min(63, max(30, math.ceil(math.log2(max(2, total_keys))) + 5))


def block_of(columns: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(blocks)).cast("int")


def dealt(docs: DataFrame, columns: list[str], blocks: int, block: Column | None = None) -> DataFrame:
    """blk int, payload binary: the rows' columns, packed (compressed Arrow) by block in each input partition."""

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            blk = table.column("__blk").to_numpy()
            order = np.argsort(blk, kind="stable")
            table, blk = table.drop_columns(["__blk"]).take(pa.array(order)), blk[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(blk)) + 1, [len(blk)]])
            ids, payloads, fill = [], [], 0
            for a, b in zip(cut[:-1], cut[1:]):
                if b > a:
                    ids.append(int(blk[a]))
                    payloads.append(pack_table(table.slice(a, b - a)))
                    fill += len(payloads[-1])
                    if fill > 4 << 20:
                        yield _rows(ids, payloads)
                        ids, payloads, fill = [], [], 0
            if ids:
                yield _rows(ids, payloads)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                held.append(batch.slice(lo, 500))
                size += int(held[-1].nbytes)
                if size > 24 << 20:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select((block_of(columns, blocks) if block is None else block).alias("__blk"), *columns).mapInArrow(deal, "blk int, payload binary")


def _rows(ids: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], ["blk", "payload"])


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    table = table.combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=_IPC) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_tables(payloads: pa.ChunkedArray) -> pa.Table | None:
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in payloads]
    return pa.concat_tables(tables) if tables else None


_POWERS_OF_2 = np.uint64(1) << np.arange(64, dtype=np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit keys: gaps in the number of bits that costs least, with exceptions for wider gaps."""
    n = len(keys)
    gaps = np.diff(keys, prepend=np.uint64(0))
    size = np.bincount(np.searchsorted(_POWERS_OF_2, gaps, side="right"), minlength=65)  # gaps by bit length
    wider = n - np.cumsum(size)
    w = int(np.argmin(np.arange(65) * n + 96 * wider))
    low = gaps if w == 64 else gaps & np.uint64((1 << w) - 1)
    bits = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - w :]
    wide = np.zeros(0, dtype=np.int64) if w == 64 else np.flatnonzero(gaps >> np.uint64(w))
    high = gaps[wide] >> np.uint64(min(w, 63))
    return b"".join([np.array([n, w, len(wide)], dtype="<u4").tobytes(), np.packbits(bits).tobytes(), wide.astype("<u4").tobytes(), high.astype("<u8").tobytes()])


def unpack_keys(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(keys, end of what was read)."""
    n, w, m = (int(x) for x in np.frombuffer(data, dtype="<u4", count=3, offset=at))
    at += 12
    packed = (n * w + 7) // 8
    bits = np.zeros((n, 64), dtype=np.uint8)
    bits[:, 64 - w :] = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=packed, offset=at), count=n * w).reshape(n, w)
    gaps = np.packbits(bits, axis=1).reshape(-1).view(">u8").astype(np.uint64)
    at += packed
    wide = np.frombuffer(data, dtype="<u4", count=m, offset=at)
    at += 4 * m
    if m:
        gaps[wide] |= np.frombuffer(data, dtype="<u8", count=m, offset=at) << np.uint64(w)
    return np.cumsum(gaps, dtype=np.uint64), at + 8 * m


def pack_counts(counts: np.ndarray) -> bytes:
    """Nonnegative integers, most of them small: a byte each, and exceptions."""
    wide = np.flatnonzero(counts >= 255)
    return np.array([len(counts), len(wide)], dtype="<u4").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + wide.astype("<u4").tobytes() + counts[wide].astype("<i8").tobytes()


def unpack_counts(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, m = (int(x) for x in np.frombuffer(data, dtype="<u4", count=2, offset=at))
    at += 8
    out = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).astype(np.int64)
    at += n
    wide = np.frombuffer(data, dtype="<u4", count=m, offset=at)
    at += 4 * m
    out[wide] = np.frombuffer(data, dtype="<i8", count=m, offset=at)
    return out, at + 8 * m


def cuts(keys: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of the nonempty parts of sorted keys."""
    step = -(-(1 << bits) // ranges)
    bounds = np.searchsorted(keys, np.array([min(i * step, (1 << 64) - 1) for i in range(1, ranges)], dtype=np.uint64))
    bounds = np.concatenate([[0], bounds, [len(keys)]])
    for r in np.flatnonzero(np.diff(bounds)):
        yield int(r), int(bounds[r]), int(bounds[r + 1])


CELL = "rng int, blk int, payload binary"


def cells_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    rng, blk, payload = zip(*rows) if rows else ((), (), ())
    return pa.Table.from_arrays([pa.array(rng, pa.int32()), pa.array(blk, pa.int32()), pa.array(payload, pa.binary())], ["rng", "blk", "payload"])


def presence_cells(blk: int, keys: np.ndarray, many: np.ndarray, ranges: int, bits: int) -> pa.Table:
    """What a block tells: its distinct keys, and which of them several of its documents hold."""
    return cells_table([(r, blk, pack_keys(keys[a:b]) + np.packbits(many[a:b]).tobytes()) for r, a, b in cuts(keys, ranges, bits)])


def distinct_with_many(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: each document's distinct keys, one after the other."""
    keys, n = np.unique(keys, return_counts=True)
    return keys, n > 1


def shared(cells: DataFrame) -> DataFrame:
    """rng, blk, payload: to each block those of its keys that two documents hold, with the (capped) number of holders' blocks."""

    @tidy
    def answer(table: pa.Table) -> pa.Table:
        blks, parts, many = table.column("blk").to_pylist(), [], []
        for p in table.column("payload"):
            data = p.as_buffer().to_pybytes()
            keys, at = unpack_keys(data)
            parts.append(keys)
            many.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=at), count=len(keys)))
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        begin = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
        count = np.add.reduceat(1 + np.concatenate(many).astype(np.int64)[order], begin)
        holders = np.empty(len(keys), dtype=np.int64)
        holders[order] = np.repeat(count, np.diff(np.concatenate([begin, [len(keys)]])))
        rows, lo = [], 0
        for blk, part in zip(blks, parts):
            n = holders[lo : lo + len(part)]
            hit = n >= 2
            if hit.any():
                rows.append((table.column("rng")[0].as_py(), blk, pack_keys(part[hit]) + np.minimum(n[hit], 255).astype(np.uint8).tobytes()))
            lo += len(part)
        return cells_table(rows)

    return cells.groupBy("rng").applyInArrow(answer, CELL)


def read_shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, holders) of a block's answers."""
    keys, holders = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint8)]
    if table.num_rows:
        rng = table.column("rng").to_numpy()
        payload = table.column("payload")
        for i in np.argsort(rng, kind="stable"):
            data = payload[int(i)].as_buffer().to_pybytes()
            k, at = unpack_keys(data)
            keys.append(k)
            holders.append(np.frombuffer(data, dtype=np.uint8, offset=at))
    return np.concatenate(keys), np.concatenate(holders)


def find(sorted_keys: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """For each probe its place in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(probes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, probes), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == probes, at, -1)


def texts_of(table: pa.Table, column: str = "text") -> list[bytes]:
    return [b"" if not t.is_valid else t.as_buffer().to_pybytes() for t in table.column(column)]
