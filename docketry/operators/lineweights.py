"""A trained line model as tables of numbers, applied to Arrow batches of lines.

The score of a line and role is a sum over its grams (weight times idf), its shape and its place, so equal texts of a batch are
scored once. Grams are the ways down a trie: a place of the text has one node, the deepest it reaches, which bears the weights
of all grams that begin there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Greatest number of cells of a table that is addressed by its keys; larger ones are searched.
CELLS = 1 << 23
#: Bytes of text scored at once (a longer line alone), and characters of a line that are summed in turn.
BYTES, PIECE = 1 << 20, 64
DIGIT, LETTER, UPPER, WORD, SPACE = 1, 2, 4, 8, 16


def _kinds() -> np.ndarray:
    """Kinds of the ASCII characters; the last place stands for any other, as none of ₹€£ is of any kind."""
    kinds = np.zeros(129, np.uint8)
    kinds[48:58] = DIGIT | WORD
    kinds[65:91] = LETTER | UPPER | WORD
    kinds[97:123] = LETTER | WORD
    kinds[95] = WORD
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    return kinds


KINDS = _kinds()


class Table:
    """Places of distinct keys in the sorted order, from 1; 0 for what is no key."""

    def __init__(self, keys: np.ndarray, space: int) -> None:
        self.keys, self.cells = keys, None
        if space <= CELLS:
            self.cells = np.zeros(max(space, 1), np.int32)
            self.cells[keys] = np.arange(1, len(keys) + 1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if self.cells is not None:
            return self.cells.take(keys)
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys.take(at, mode="clip") == keys, at + 1, 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        end = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(end)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _own_shapes(texts: pa.Array, shape: pa.Array) -> np.ndarray:
    """The shape features but the place; shape: those of lines with other characters, else null."""
    own = LineWeights._shapes(texts)
    odd = shape.is_valid().to_numpy(zero_copy_only=False)
    if odd.any():
        own[odd] = np.array(shape.filter(pa.array(odd)).to_pylist(), float)
    return own


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """role, grams and shape of lines, as linemodel.featured() has them."""
    white = re.compile("[ \\t\\n\\x0b\\f\\r]+")
    for batch in _cut(batches):
        texts = batch["text"].cast(pa.string())
        grams: list[str] = []
        ends, known = [0], {}
        for line in pc.coalesce(batch["low"].cast(pa.string()), pc.ascii_lower(texts)).to_pylist():
            for w in white.split(line):
                if w:
                    if w not in known:
                        p = f" {w} "
                        known[w] = [p[i : i + k] for k in (3, 4, 5) for i in range(len(p) - k + 1)]
                    grams += known[w]
            ends.append(len(grams))
        at, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("at", "n"))
        own = np.column_stack([at / np.maximum(n - 1, 1), _own_shapes(texts, batch["shape"])])
        shape = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel()))
        yield pa.RecordBatch.from_arrays([batch["role"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams, pa.string())), shape], ["role", "grams", "shape"])


class LineWeights:
    def __init__(self, labels: list[str], grams: list[str], weights: np.ndarray, shape: np.ndarray, intercept: np.ndarray) -> None:
        """weights: a row of each gram (3 to 5 characters), a column of each label; shape: a row of each shape feature, the place first."""
        self.labels, self.grams, self.weights, self.shape, self.intercept = labels, grams, weights, shape, intercept

    def built(self) -> LineWeights:
        """Makes the trie; each task does so, as the grams are smaller to send."""
        k = len(self.labels)
        size = np.array([len(g) for g in self.grams], np.int64)
        code = np.zeros((len(self.grams), 5), np.int64)
        for j in range(5):
            code[:, j] = [ord(g[j]) if j < len(g) else 0 for g in self.grams]
        letters = np.unique(code[code > 0])
        self.letter = np.zeros(int(letters[-1]) + 2 if len(letters) else 2, np.int64)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        # all other white space ends words too
        self.letter[[x for x in (9, 10, 11, 12, 13) if x < len(self.letter) - 1]] = self.letter[32] if len(self.letter) > 33 else 0
        self.a = a = len(letters) + 1
        ids = np.where(code > 0, self.letter[np.minimum(code, len(self.letter) - 1)], 0)
        self.tables, self.first, total, node = [], [], 1, None
        rows = [np.zeros((1, k))]
        for depth in (3, 4, 5):
            deep = size >= depth
            key = (ids[:, 0] * a + ids[:, 1]) * a + ids[:, 2] if depth == 3 else node * a + ids[:, depth - 1]
            keys = np.unique(key[deep])
            above = len(self.tables[-1].keys) if self.tables else 0
            self.tables.append(Table(keys, a**3 if depth == 3 else (above + 1) * a))
            own = np.zeros((len(keys) + 1, k))
            if depth > 3:
                own[1:] = rows[-1][keys // a]
            place = np.where(deep, np.searchsorted(keys, key) + 1, 0)
            np.add.at(own, place[size == depth], self.weights[size == depth])
            self.first.append(total - 1)
            total += len(keys)
            rows.append(own)
            node = place
        self.rows = np.concatenate([rows[0], *[r[1:] for r in rows[1:]]])
        return self

    @staticmethod
    def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the texts, each after a space, and a space at the end; where each begins, and its length with that space."""
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), " ")[0].as_py()
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return np.frombuffer(f" {whole} ".encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size

    def _of_grams(self, low: pa.Array) -> np.ndarray:
        chars, start, size = self._joined(low)
        ids = np.concatenate([self.letter.take(np.minimum(chars, len(self.letter) - 1)), np.zeros(4, np.int64)])
        n, a = len(chars), self.a
        node = self.tables[0].of((ids[:n] * a + ids[1 : n + 1]) * a + ids[2 : n + 2])
        deepest = np.where(node > 0, node + self.first[0], 0)
        for depth in (1, 2):
            # below node 0 there is no key
            node = self.tables[depth].of(node * a + ids[depth + 2 : n + depth + 2])
            deepest = np.where(node > 0, node + self.first[depth], deepest)
        pieces = -(-size // PIECE)
        piece = np.cumsum(pieces) - pieces
        before = (np.arange(pieces.sum()) - np.repeat(piece, pieces)) * PIECE
        start, size = np.repeat(start, pieces) + before, np.minimum(np.repeat(size, pieces) - before, PIECE)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        sums = np.zeros((len(size), len(self.labels)))
        for j, m in enumerate(np.searchsorted(-size, -np.arange(size[0])).tolist()):
            sums[:m] += self.rows.take(deepest.take(start[:m] + j), axis=0)
        out = np.empty_like(sums)
        out[order] = sums
        return np.add.reduceat(out, piece, axis=0) if len(out) > len(piece) else out

    @staticmethod
    def _shapes(texts: pa.Array) -> np.ndarray:
        """The shape features but the place, of lines of ASCII and ₹€£."""
        chars, start, size = LineWeights._joined(texts)
        kind = KINDS.take(np.minimum(chars, 128))
        many = lambda k: np.add.reduceat((kind[:-1] & k) > 0, start, dtype=np.int64)
        digits, letters, upper, visible = many(DIGIT), many(LETTER), many(UPPER), size - many(SPACE)
        point = np.flatnonzero((chars == 46) | (chars == 44))
        point = point[point < len(chars) - 3]
        point = point[(kind[point - 1] & kind[point + 1] & kind[point + 2] & DIGIT > 0) & (kind[point + 3] & WORD == 0)]
        has = np.zeros((3, len(size)))
        for row, at in zip(has, (point, np.flatnonzero(chars == 58), np.flatnonzero(np.isin(chars, [0x20B9, 36, 0x20AC, 163, 37])))):
            row[np.searchsorted(start, at, side="right") - 1] = 1.0
        length = size - 1
        share = lambda x, of: np.divide(x, of, out=np.zeros(len(x)), where=of > 0)
        return np.column_stack([np.minimum(length / 80, 1.0), digits / np.maximum(length, 1), share(letters, visible), share(upper, letters), *has])

    def margins(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row of each line, a column of each label."""
        coded = pc.dictionary_encode(batch["text"].cast(pa.string()))
        which, texts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        first = np.empty(len(texts), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        low, shape = batch["low"].cast(pa.string()).take(pa.array(first)), batch["shape"].take(pa.array(first))
        own = _own_shapes(texts, shape)
        score = self._of_grams(pc.coalesce(low, pc.ascii_lower(texts))) + own @ self.shape[1:] + self.intercept
        at, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("at", "n"))
        return score[which] + (at / np.maximum(n - 1, 1))[:, None] * self.shape[0]

    def _each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.built()
        return _cut(batches)

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """role, said and how often, of the lines of a task."""
        found: dict[tuple[str | None, int], int] = {}
        for batch in self._each(batches):
            said = self.margins(batch).argmax(axis=1)
            role = pc.dictionary_encode(batch["role"], null_encoding="encode")
            both, n = np.unique(role.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(self.labels) + said, return_counts=True)
            names = role.dictionary.to_pylist()
            for x, k in zip(both.tolist(), n.tolist()):
                key = names[x // len(self.labels)], x % len(self.labels)
                found[key] = found.get(key, 0) + k
        columns = [[r for r, _ in found], [self.labels[s] for _, s in found], list(found.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["role", "said", "n"])

    def roles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """receipt_id, line_no and the probabilities of the labels."""
        for batch in self._each(batches):
            m = self.margins(batch)
            top = m.max(axis=1, keepdims=True)
            e = np.where(m == top, 1.0, np.exp(np.where(np.isinf(top), -np.inf, m - np.where(np.isinf(top), 0, top))))
            p = e / e.sum(axis=1, keepdims=True)
            k = len(self.labels)
            names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(k), len(p)), pa.int32()), pa.array(self.labels, pa.string())).cast(pa.string())
            said = pa.MapArray.from_arrays(pa.array(np.arange(len(p) + 1) * k, pa.int32()), names, pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch["receipt_id"], batch["line_no"], said], ["receipt_id", "line_no", "roles"])
