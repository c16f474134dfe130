"""Packing of tokenized documents into sequences by first-fit decreasing.

Documents are cut at multiples of the sequence length; whole pieces fill sequences of their own, and the rest
are packed by a tournament tree of bin capacities, run independently in randomised groups of documents.
"""

from __future__ import annotations

import re
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, texts

#: Texts of these characters alone are NFC already and have simple lower cases.
PLAIN = re.compile(r"[ \n\r\t!-~À-ÖØ-öø-ÿ]*")
BREAK = re.compile(r"[ \n\r\t]+")
#: No plain text holds it; it is a token of its own.
MARK = "\x01"


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker, whatever the number of its tasks."""
    return WordTokenizer(path)


class WordTokenizer:
    """Ids of whole texts, with a bounded store of ids by word: no token crosses white space in this vocabulary."""

    def __init__(self, path: str, limit: int = 120_000) -> None:
        from tokenizers import Tokenizer, normalizers

        self.path, self.short = path, Tokenizer.from_file(path)
        self.mark = self.short.encode(MARK, add_special_tokens=False).ids
        self.short.normalizer = normalizers.Sequence([])
        self.limit = limit
        self.store: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    @cached_property
    def full(self):
        """With its normalizer, for texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def learn(self, words: list[str]) -> None:
        """Encodes new lower-case words, many at a time with marks between."""
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        found = self.short.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False)
        for group, enc in zip(groups, found, strict=True):
            ids = np.array(enc.ids, "<u4")
            at = np.flatnonzero(ids == self.mark[0])
            data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            start = 0
            for w, end in zip(group, ends, strict=True):
                self.store[w] = data[start:end]
                start = end + 4

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.store) > self.limit:
            self.store.clear()
        if len(self.odd) > self.limit // 10:
            self.odd.clear()
        plain = [t.lower() if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        lists = pc.ascii_split_whitespace(pa.array(["" if t is None else t for t in plain], pa.large_string()))
        words = lists.flatten().dictionary_encode()
        unique, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if new := [w for w in unique if w and w not in self.store]:
            self.learn(new)
        self.store[""] = b""
        found = [self.store[w] for w in unique]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, size = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(found), "<u4")
        ids = flat[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [self._other(t) if p is None else ids[cuts[i] : cuts[i + 1]].tobytes() for i, (t, p) in enumerate(zip(texts, plain, strict=True))]

    def _other(self, text: str) -> bytes:
        out = []
        for w in BREAK.split(text):
            if w not in self.odd:
                self.odd[w] = np.array(self.full.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            out.append(self.odd[w])
        return b"".join(out)


class BinTree:
    """A tournament tree over bins: each inner node holds the most room of any bin below it."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, which is taken."""
        i, room = 1, self.room
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        room[i] -= size
        found = i - self.leaves
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size its bin and its offset there."""
    tree, used = BinTree(max(1, len(sizes)), capacity), {}
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        b = tree.place(int(sizes[i]))
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + int(sizes[i])
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids with end_id behind, cut at multiples of length."""

    def tokenize(batches):
        tok = tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole):
                out = ([], [], [], [], [])
                for doc_id, ids in zip(batch.column(0).to_pylist(), tok.batch(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        part = ids[4 * start : 4 * (start + length)]
                        for col, v in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(tokenize, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, group_docs: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    A null or empty text is end_id alone. Documents meet in groups of about group_docs by a hash of doc_id; the
    sequences of a group are numbered group x 2^32 upward. Rows that repeat a doc_id are packed as documents of
    their own. An empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(texts(docs), tokenizer_path, length, end_id).withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
        g = table["g"].to_numpy()
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(g * (1 << 32) + bins)).append_column("offset", pa.array(offsets))

    return cut.groupBy("g").applyInArrow(packed, schema)
