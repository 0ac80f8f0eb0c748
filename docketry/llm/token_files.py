"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Texts are range-partitioned by document id and sorted, then encoded where they lie, so files and the
rows in them ascend by id. Each row has its document's ids and its place in the file; where a file
begins in the whole stream comes from one row per file when reading. Readers split files by stripe, and a
lookup of document ids prunes files and stripes by statistics and Bloom filters and row groups by the
row index.

Words are encoded once per Python worker and kept in a cache of at most about CACHE_WORDS: the vocabulary
drops white space and no token spans it, so a text's ids are those of its words in turn.

Defined results: null text is an empty text (the end id alone); null document ids come first; rows of
one id are ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import find
from .common import corpus_size, fresh_path, materialise, read, small, tidy
from .textkit import word_hashes

END_ID, CACHE_WORDS, FILE_BYTES, GROUP_BYTES = 2, 1_500_000, 32 << 20, 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII punctuation but for the apostrophe (contractions) and the signs of special tokens.
TRAILING = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|>")


class WordEncoder:
    """Ids of texts through the tokenizers library, word by word, with numpy.

    Words are known by 64-bit hashes in a sorted table of at most about `limit` (for a table of k words a new
    word meets a false entry with probability k / 2**64); their ids lie in one array. An unknown word is
    its lower-cased stem and the punctuation that trails it: both are pre-tokens of their own. Stems of letters are
    encoded many to a string, with spaces between, and told apart by the ids that end a pre-token.
    Other words are encoded one by one.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype="<u4")

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encoded(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
        """Each word's ids as bytes; hashes and ids of the stems that the table does not have."""
        low = b" ".join(words).lower().split(b" ")
        stems = [w.rstrip(TRAILING) for w in low]
        every = [x for x in set(stems) if x]
        hashes = word_hashes([b" ".join(every)])[0]
        at = find(self.hashes, hashes)
        have = np.flatnonzero(at >= 0)
        starts, ends = self.starts[at[have]], self.starts[at[have]] + self.counts[at[have]]
        old = {every[i]: self.ids[a:b].tobytes() for i, a, b in zip(have.tolist(), starts.tolist(), ends.tolist())}
        new = [every[i] for i in np.flatnonzero(at < 0).tolist()]
        texts = b" ".join(new).decode("utf-8", "replace").split(" ") if new else []
        plain = [x for x, t in zip(new, texts) if t.isalpha() and (t.isascii() or max(t) < "\u0130")]
        known: dict[bytes, bytes] = {}
        for lo in range(0, len(plain), 512):
            part = plain[lo : lo + 512]
            ids = np.asarray(self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):
                known.update((w, self._ids(w.decode())) for w in part)
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(part, (4 * (last + 1)).tolist()):
                known[word] = data[at:end]
                at = end
        fresh = list(known)
        fresh_hashes, fresh_ids = word_hashes([b" ".join(fresh)])[0], list(known.values())
        texts = b" ".join(old).decode("utf-8", "replace").split(" ") if old else []
        known.update((x, ids) for (x, ids), t in zip(old.items(), texts) if t.isalpha() and (t.isascii() or max(t) < "\u0130"))
        out, tails, get = [], self.tails, known.get
        for word, lower, stem in zip(words, low, stems):
            ids = get(stem)
            if ids is None:
                out.append(self._ids(word.decode("utf-8", "replace")))
                continue
            tail = lower[len(stem) :]
            if tail not in tails:
                if len(tails) > 10_000:
                    tails.clear()
                tails[tail] = self._ids(tail.decode()) if tail else b""
            out.append(ids + tails[tail])
        return out, fresh_hashes, fresh_ids

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; number of ids of each). The table starts anew beyond its limit."""
        if len(self.hashes) > self.limit:
            self.clear()
        hashes, first = word_hashes(texts)
        seen, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        missing = find(self.hashes, seen) < 0
        if missing.any():
            words = b" ".join(texts).split()
            coded, more, more_ids = self._encoded([words[i] for i in at[missing].tolist()])
            keys, one = np.unique(np.concatenate([seen[missing], more]), return_index=True)
            coded = coded + more_ids
            coded = [coded[i] for i in one.tolist()]
            n = np.array([len(c) // 4 for c in coded], dtype=np.int32)
            fresh = len(self.ids) + np.concatenate([[0], np.cumsum(n, dtype=np.int64)[:-1]])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), dtype="<u4")])
            place = np.searchsorted(self.hashes, keys)
            self.hashes, self.starts, self.counts = np.insert(self.hashes, place, keys), np.insert(self.starts, place, fresh), np.insert(self.counts, place, n)
        row = find(self.hashes, seen)[inverse] if len(seen) else np.zeros(0, dtype=np.int64)
        size = self.counts[row]
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        total, n_docs = int(upto[-1]), len(texts)
        flat = self.ids[np.repeat(self.starts[row] - upto[:-1], size) + np.arange(total)]
        each = np.diff(upto[first])
        out = np.full(total + n_docs, end_id, dtype="<u4")
        out[np.arange(total) + np.repeat(np.arange(n_docs), each)] = flat
        return out, each + 1


_ENCODERS: dict[str, WordEncoder] = {}


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Rows doc_id, part, at (ids before it in its part), n_tokens, ids; ascending by doc_id over the part files."""
    vocabulary = vocabulary or default_vocabulary()
    files = files or max(8, -(-corpus_size(docs, text_col)[1] // FILE_BYTES))

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, WordEncoder(vocabulary))
        at = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < batch.num_rows:  # some MB of text at a time
                hi, size = lo, 0
                group = []
                while hi < batch.num_rows and size < GROUP_BYTES:
                    t = texts[hi].as_buffer().to_pybytes() if texts[hi].is_valid else b""
                    group.append(t)
                    size += len(t)
                    hi += 1
                flat, n = coder.encode(group, end_id)
                starts = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                at += int(n.sum())
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(starts), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view("<i4")))], ["doc_id", "at", "n_tokens", "ids"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__t")).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "__t")
    rows = dealt.mapInArrow(encode, f"doc_id {kind}, at long, n_tokens long, ids array<int>")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), "at", "n_tokens", "ids")
    rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(8 << 20)).option("compression", "lz4").orc(path)


def rows_of(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The rows of the files (none where an empty table was written); kind: type of the document ids."""
    return spark.read.schema(f"doc_id {kind}, part int, at long, n_tokens long, ids array<int>").orc(path)


def read_token_files(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The rows with `start`: ids of all documents before."""
    rows = rows_of(spark, path, kind)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    parts = rows.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    base = materialise(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "parts")
    return rows.join(small(base), "part").withColumn("start", F.col("base") + F.col("at"))


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of some document ids: files, stripes and row groups without them are left out by statistics and Bloom filters."""
    return rows_of(spark, path).where(F.col("doc_id").isin(ids))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from rows read back."""

    @tidy
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat, off = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            n = off[1:] - off[:-1]
            crcs = [zlib.crc32(np.ascontiguousarray(flat[a:b], dtype="<u4").tobytes()) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "ids").mapInArrow(crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path)
    return digest(read_token_files(spark, path))
