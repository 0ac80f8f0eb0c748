"""Token counts of a unigram model, by dynamic programming over a trie of pre-tokens.

A word (with a leading word mark) is cut into pieces of a public vocabulary so that the sum of piece
scores is highest; the forward score of a prefix depends on the prefix alone, so it is computed once
per trie node and shared by all words that begin with it. A terminal node stores its token count.
Only the first DEPTH characters of a word are in the trie: what follows them in longer words is scored with a window of the last
scores, so a word of any length needs no more memory. Each Python worker keeps one trie for all its tasks, dropped when it exceeds MAX_NODES, and a table of
the terminal counts by word hash (64 bits, MAX_WORDS); a document is counted where it is read, so
nothing shuffles.

Scores: a piece of rank r (its place in the vocabulary file) has log probability -log(r + 2); a single
character that is no piece costs UNKNOWN and is one token. Ties go to fewer tokens.

The pieces are those of a byte-pair vocabulary, as no unigram model is at hand, and so their scores are made from ranks.

Defined results: null text has 0 words and 0 tokens; rows repeat as they come in, with any id or none; words of any
length are counted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import find
from .common import read, tidy
from .textkit import word_hashes

MARK = "▁"
UNKNOWN = -30.0
MAX_NODES, MAX_WORDS, DEPTH = 600_000, 2_000_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str) -> dict[str, float]:
    """piece -> log score, from a sentencepiece model file; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): -math.log(i + 2.0) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class TrieCounter:
    """Token counts of words; prefixes share their forward scores."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES) -> None:
        self.scores, self.longest, self.max_nodes = scores, max(map(len, scores), default=1), max_nodes
        self.clear()

    def clear(self) -> None:
        #: node -> children; node -> (score, minus tokens) of the best cut of its prefix; word -> count
        self.children: list[dict[str, int]] = [{}]
        self.forward: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        got = self.terminal.get(word)
        return self.insert(word) if got is None else got

    def _best(self, marked: str, i: int, before: list[tuple[float, int]], at: int) -> tuple[float, int]:
        """The forward score behind character i; before[j - at] is the one in front of character j."""
        scores = self.scores
        s, t = before[i - at]
        best = (s + scores.get(marked[i], UNKNOWN), t - 1)
        for j in range(max(0, i + 1 - self.longest), i):
            piece = scores.get(marked[j : i + 1])
            if piece is not None:
                s, t = before[j - at]
                if (s + piece, t - 1) > best:
                    best = (s + piece, t - 1)
        return best

    def insert(self, word: str) -> int:
        if len(self.children) > self.max_nodes:
            self.clear()
        marked = MARK + word
        node, along = 0, [self.forward[0]]
        for i, ch in enumerate(marked[:DEPTH]):
            nxt = self.children[node].get(ch)
            if nxt is None:
                nxt = len(self.children)
                self.forward.append(self._best(marked, i, along, 0))
                self.children[node][ch] = nxt
                self.children.append({})
            node = nxt
            along.append(self.forward[node])
        at = 0
        for i in range(DEPTH, len(marked)):
            along.append(self._best(marked, i, along, at))
            if len(along) > 2 * self.longest + DEPTH:  # scores further back than a piece is long are done with
                at += len(along) - self.longest
                along = along[-self.longest :]
        count = -along[-1][1]
        if len(marked) <= DEPTH:
            self.terminal[word] = count
        return count


class CountTable:
    """Terminal counts of the words met so far, by 64-bit hash; unknown words go through the trie."""

    def __init__(self, counter: TrieCounter, limit: int = MAX_WORDS) -> None:
        self.counter, self.limit = counter, limit
        self.hashes, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) of each text."""
        if len(self.hashes) > self.limit:
            self.hashes, self.counts = self.hashes[:0], self.counts[:0]
        hashes, first = word_hashes(texts)
        seen, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        missing = find(self.hashes, seen) < 0
        if missing.any():
            words = b" ".join(texts).split()
            # in order, so that words with a common beginning follow one another
            order = sorted((words[i].decode("utf-8", "replace"), k) for k, i in zip(np.flatnonzero(missing).tolist(), at[missing].tolist()))
            n = np.zeros(len(seen), dtype=np.int64)
            for word, k in order:
                n[k] = self.counter.insert(word)
            place = np.searchsorted(self.hashes, seen[missing])
            self.hashes, self.counts = np.insert(self.hashes, place, seen[missing]), np.insert(self.counts, place, n[missing])
        size = self.counts[find(self.hashes, seen)][inverse] if len(seen) else np.zeros(0, dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        return np.diff(first), np.diff(upto[first])


_TABLES: dict[tuple[str, int], CountTable] = {}


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, n_words, n_tokens for each input row."""
    path = vocabulary or default_vocabulary()

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _TABLES.get((path, max_nodes)) or _TABLES.setdefault((path, max_nodes), CountTable(TrieCounter(load_scores(path), max_nodes)))
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:  # a few MB of text at a time
                hi, size, texts = lo, 0, []
                while hi < batch.num_rows and size < 4_000_000:
                    t = batch.column(1)[hi]
                    texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
                    size += len(texts[-1])
                    hi += 1
                n_words, n_tokens = table.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string").alias("__t")).mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
