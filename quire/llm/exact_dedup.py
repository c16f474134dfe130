"""Exact deduplication by a log-structured merge index.

Each task fills a memtable of digests, and flushes it as a sorted run with a Bloom filter; runs meet by digest,
and compaction keeps the smallest identifier of each. A digest that matches is compared byte for byte.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, materialize, shuffle_partitions, texts

SPACE = b" \t\n\x0b\x0c\r"


def normalized(text: bytes) -> bytes:
    """Each run of ASCII white space as one space, also at the ends."""
    words = b" ".join(text.split())
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in SPACE else b"") + words + (b" " if text[-1] in SPACE else b"")


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


class Bloom:
    """A filter of about ten bits a digest; digests are hashes already, so their own bytes give the positions."""

    def __init__(self, n: int) -> None:
        self.size = max(64, 10 * n)
        self.bits = bytearray(self.size // 8 + 1)

    def _at(self, digest: bytes) -> Iterator[int]:
        a, b = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big") | 1
        return ((a + i * b) % self.size for i in range(4))

    def add(self, digest: bytes) -> None:
        for i in self._at(digest):
            self.bits[i >> 3] |= 1 << (i & 7)

    def __contains__(self, digest: bytes) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._at(digest))


class LsmIndex:
    """(digest, text) -> smallest identifier and count, in bounded memory.

    Entries are equal only when their bytes are; two texts of one digest stay two entries. Runs are in a folder of the
    task's own, for the time of the task: a task that is tried again builds them anew.
    """

    def __init__(self, folder: str, memtable_bytes: int = 32 << 20) -> None:
        self.folder, self.limit = Path(folder), memtable_bytes
        self.memtable: dict[tuple[bytes, bytes], list] = {}
        self.digests: set[bytes] = set()
        self.held = 0
        self.runs: list[tuple[Path, Bloom]] = []

    def add(self, digest: bytes, text: bytes, doc_id: int | None, n: int = 1) -> None:
        entry = self.memtable.get((digest, text))
        if entry is None:
            self.memtable[digest, text] = [doc_id, n]
            self.digests.add(digest)
            self.held += len(text) + 200
            if self.held >= self.limit:
                self.flush()
            return
        entry[0] = smaller(entry[0], doc_id)
        entry[1] += n

    def flush(self) -> None:
        if not self.memtable:
            return
        bloom, path = Bloom(len(self.memtable)), self.folder / f"run-{len(self.runs)}"
        with path.open("wb") as f:
            for key in sorted(self.memtable):
                bloom.add(key[0])
                pickle.dump((*key, *self.memtable[key]), f, pickle.HIGHEST_PROTOCOL)
        self.runs.append((path, bloom))
        self.memtable, self.held = {}, 0
        self.digests.clear()

    @staticmethod
    def _read(path: Path) -> Iterator[tuple]:
        with path.open("rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return

    def _claimed(self, digest: bytes, but: int = -1) -> bool:
        """Whether another run may hold the digest: its filter says so, or the memtable has it."""
        return digest in self.digests or any(digest in bloom for i, (_, bloom) in enumerate(self.runs) if i != but)

    def seen(self, digest: bytes) -> bool:
        """Whether a digest is in the index; filters spare the reading of runs that lack it."""
        return digest in self.digests or any(digest in bloom and any(e[0] == digest for e in self._read(path)) for path, bloom in self.runs)

    def compact(self) -> Iterator[tuple[bytes, bytes, int | None, int]]:
        """All entries, those of one digest together: first what no other run's filter claims, run by run, then the rest merged.

        Claimed entries are put aside as they are read, so each run is read once, and only they are compared byte for byte.
        """
        contested: list[Path] = []
        for i, (path, _) in enumerate(self.runs):
            aside = self.folder / f"contested-{i}"
            with aside.open("wb") as f:
                for e in self._read(path):
                    if self._claimed(e[0], i):
                        pickle.dump(e, f, pickle.HIGHEST_PROTOCOL)
                    else:
                        yield e
            contested.append(aside)
            path.unlink()
        newest = ((*k, *self.memtable[k]) for k in sorted(self.memtable))
        last = None
        for e in heapq.merge(*(self._read(p) for p in contested), newest, key=lambda e: e[:2]):
            if last is not None and last[:2] == e[:2]:
                last = (*last[:2], smaller(last[2], e[2]), last[3] + e[3])
                continue
            if last is not None:
                yield last
            last = e
        if last is not None:
            yield last


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


RUN = pa.schema([("digest", pa.binary()), ("text", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
KEPT = pa.schema([("digest", pa.binary()), ("text", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1] or b"") + 64
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def build_index(docs: DataFrame, digest=sha256, memtable_bytes: int = 32 << 20) -> DataFrame:
    """digest, text (only where several texts share the digest), keep_id, group_size: a row for each distinct text."""

    def runs(batches):
        with tempfile.TemporaryDirectory() as folder:
            index = LsmIndex(folder, memtable_bytes)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    norm = normalized(text)
                    index.add(digest(norm), norm, doc_id)
            yield from _batches(index.compact(), RUN)

    def compacted(batches):
        with tempfile.TemporaryDirectory() as folder:
            index = LsmIndex(folder, memtable_bytes)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    index.add(*row)

            def rows():
                group: list[tuple] = []
                for e in index.compact():
                    if group and group[0][0] != e[0]:
                        yield from (group if len(group) > 1 else [(group[0][0], None, *group[0][2:])])
                        group = []
                    group.append(e)
                yield from (group if len(group) > 1 else [(g[0], None, *g[2:]) for g in group])

            yield from _batches(rows(), KEPT)

    schema = "digest binary, text binary, keep_id long, group_size long"
    n = shuffle_partitions(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(runs, schema).repartition(n, "digest").mapInArrow(compacted, schema)


def exact_duplicates(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when identical after each run of ASCII white space is made one space; a null text is empty.
    Of equal texts the smallest doc_id is kept; a null doc_id counts as the largest. Rows that repeat a kept
    doc_id with an equal text are that same document and are kept with it. An empty table gives no rows.
    """
    docs = texts(docs)
    index = materialize(build_index(docs, digest))

    def digests(batches):
        for batch in batches:
            norm = [normalized(t) for t in batch.column(1).to_pylist()]
            keys = [digest(t) for t in norm]
            shas = keys if digest is sha256 else [sha256(t) for t in norm]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([s.hex() for s in shas], pa.string())], names=["doc_id", "digest", "text_sha256"])

    members = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(digests, "doc_id long, digest binary, text_sha256 string")
    clashing = index.where(F.col("text").isNotNull())
    out = members.join(index.where(F.col("text").isNull()).drop("text"), "digest")
    if not clashing.isEmpty():  # one digest for several texts: those rows are told apart by all their bytes
        exact = clashing.withColumn("text_sha256", F.sha2("text", 256)).drop("text")
        out = out.unionByName(members.join(exact, ["digest", "text_sha256"]))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, all columns as they are: that with the smallest doc_id, where null is the largest.

    Texts are equal as in exact_duplicates. Of rows that repeat a doc_id and its text one stays; other texts of that
    doc_id stay too. Rows meet by digest and doc_id, so that many copies of a text are no hot key.
    """
    d, i, null, other = fresh(docs.columns, "digest", "id", "null", "other")
    index = materialize(build_index(texts(docs), sha256))
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    key = lambda c: (F.coalesce(c, F.lit(-1)).alias(i), c.isNull().alias(null))
    kept = index.select(F.col("digest").alias(d), *key(F.col("keep_id")), F.col("text").alias(other))
    rows = docs.select("*", F.unhex(F.sha2(norm, 256)).alias(d), *key(F.col("doc_id").cast("long"))).join(kept, [d, i, null])
    # where one digest has several texts, a row meets them all
    rows = rows.where(F.col(other).isNull() | (F.col(other) == norm.cast("binary")))
    return rows.dropDuplicates([d, i, null, other]).select(docs.columns)
