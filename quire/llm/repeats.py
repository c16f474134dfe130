"""Strings of k tokens that occur again: the frame that suffix-array and substring deduplication share.

Consecutive windows of k tokens that share a minimiser (the smallest hash of q tokens in them, of equal ones the
leftmost) form a run, the super-k-mer. A window that occurs again has its minimiser in both places, and these are two
runs, even within one document, as the leftmost is as far from either start; so first the minimisers are counted;
only runs whose minimiser occurs again travel, each as one packed string, to the bucket of its minimiser, where a
resolver compares all windows exactly. Equal packed strings meet before they travel: all but the first are settled.

Documents are dealt into groups by a hash of the row; a group is the unit of work, and a few MB on average.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, release, shuffle_partitions, texts

U = np.uint64
P = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(P, -1, 1 << 64)
NO_ID = (1 << 63) - 1
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20
#: Low bits of a minimiser's key, for its place: of equal hashes in a window the leftmost is taken.
PLACE = 24
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), base, U)
        held[0] = 1
        _powers[base] = held = np.cumprod(held)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(32))


def spans_hash(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of tokens."""
    total = np.zeros(len(tokens) + 1, U)
    np.cumsum((tokens.astype(U) + U(1)) * powers(P, len(tokens)), out=total[1:])
    return mix((total[end] - total[start]) * powers(INVERSE, len(tokens) + 1)[start])


@dataclass(frozen=True)
class Kind:
    """What a token is, and what k and q count."""

    words: bool
    k: int
    q: int
    #: Whether a second occurrence within one document counts.
    within: bool
    #: (packed strings, owner's doc_id, owner's start) -> for each window, by string and offset, the first owner and its start.
    resolve: Callable

    def text(self, raw: bytes) -> bytes:
        return b" ".join(raw.split()) if self.words else raw


@dataclass
class Runs:
    """Runs of windows of some documents: 48 bits of the minimiser, document, first token, number of windows, first and last byte."""

    value: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def runs(kind: Kind, docs: list[bytes]) -> Runs:
    data = np.frombuffer(b"".join(docs), np.uint8)
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    doc_end = np.cumsum(size)
    if kind.words:
        edge = np.zeros(len(data) + 1, bool)
        edge[doc_end] = True  # a document ends or begins here
        space = SPACES[data]
        before = np.append(True, space[:-1]) if len(data) else space
        first = np.flatnonzero(~space & (before | edge[:-1]))
        after = np.append(space[1:], True) if len(data) else space
        last = np.flatnonzero(~space & (after | edge[1:])) + 1
        tokens = spans_hash(data, first, last)
        doc = np.searchsorted(doc_end, first, "right")
        counts = np.bincount(doc, minlength=len(docs))
    else:
        tokens, counts = data, size
        first = last = None
        doc = np.repeat(np.arange(len(docs)), size)
    ends = np.cumsum(counts)
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < kind.k:
        return Runs(none.astype(U), none, none, none, none, none)
    at = np.arange(n - kind.q + 1)
    low = U((1 << PLACE) - 1)
    each = key = (spans_hash(tokens, at, at + kind.q) & ~low) | (at.astype(U) & low)
    width, covered = kind.k - kind.q + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        key = np.minimum(key[: len(key) - step], key[step:])
        covered += step
    for edge in range(1 << PLACE, len(at), 1 << PLACE):  # where places begin again, windows are looked through one by one
        for i in range(max(0, edge - width + 1), min(edge, len(key))):
            hashed = each[i : i + width] & ~low
            key[i] = hashed.min() | U((i + int(hashed.argmin())) & int(low))
    doc = doc[: len(key)]
    valid = np.arange(len(key)) + kind.k <= ends[doc]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    total = np.append(0, np.cumsum(valid))
    windows = total[np.append(start[1:], len(key))] - total[start]
    begin = ends[doc[start]] - counts[doc[start]]
    byte = doc_end - size
    lo = first[start] if kind.words else start
    hi = last[start + windows + kind.k - 2] if kind.words else start + windows + kind.k - 1
    return Runs(mix(key[start] >> U(PLACE)) >> U(16), doc[start], start - begin, windows, lo - byte[doc[start]], hi - byte[doc[start]])


def chunks(keys: list[int], ids: list[int | None], raw: list[bytes], kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    held, size, begin = [], 0, 0
    for i, text in enumerate(raw):
        held.append(kind.text(text or b""))
        size += len(held[-1])
        if size >= CHUNK or i + 1 == len(raw):
            part = slice(begin, i + 1)
            yield np.array(keys[part], np.int64), np.array([NO_ID if d is None else d for d in ids[part]], np.int64), held
            held, size, begin = [], 0, i + 1


def columns(table) -> list:
    return [c.to_pylist() for c in table.columns]


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    if parts <= 1 << 16:  # sorted by radix
        part = part.astype(np.uint16)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, order[cut[p] : cut[p + 1]]


def planes(values, dtype=np.int64) -> bytes:
    """Numbers by planes of equal bytes, so that high bytes that are alike take no room once compressed."""
    values = np.ascontiguousarray(values, dtype)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def bundle(*arrays, raw: bytes = b"") -> bytes:
    """Arrays of 64-bit numbers and a string in one compressed piece: small pieces are many, and each frame takes room."""
    head = struct.pack(f"<{len(arrays)}I", *map(len, arrays))
    return zstandard.ZstdCompressor(1).compress(head + b"".join([planes(a) for a in arrays]) + raw)


def unbundle(data: bytes, n: int) -> list:
    """The n arrays of a bundle, and its string."""
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 4 * n, []
    for size in struct.unpack_from(f"<{n}I", data):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * size, at).reshape(8, size).T).view(np.int64).ravel())
        at += 8 * size
    return [*out, data[at:]]


def steps(values: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the steps to the next."""
    return np.diff(values.astype(np.int64), prepend=0)


PAIRS = pa.schema([("part", pa.int32()), ("back", pa.bool_()), ("many", pa.bool_()), ("data", pa.binary())])
#: Bits of a minimiser.
VALUE = 48


def shard_of(value: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of minimisers, so that those of one are close."""
    return ((value >> U(VALUE - 32)) * U(shards) >> U(32)).astype(np.int64)


def repeated_minimisers(docs: DataFrame, kind: Kind, groups: int, shards: int) -> DataFrame:
    """part, data: by group, the minimisers of its rows that occur again."""

    def by_group(group: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, bytes]]:
        for g, i in by_part(group, groups):
            yield g, bundle(steps(np.unique(value[i])))

    def collected(batches):
        held: list[tuple] = []

        def flush():
            if not held:
                return
            key, doc_id, value = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc_id, value))
            key, value = key[order], value[order]
            if not kind.within and len(value):
                once = np.append(True, (value[1:] != value[:-1]) | (key[1:] != key[:-1]))
                key, value = key[once], value[once]
            group, same = key % groups, value[1:] == value[:-1]
            repeated = np.append(False, same) | np.append(same, False)
            head = np.flatnonzero(repeated & np.append(True, ~same))
            alone = np.flatnonzero(~repeated)
            rows = [(g, True, False, data) for g, data in by_group(group[repeated], value[repeated])]
            rows += [(p, False, True, bundle(steps(value[head[i]]), group[:0])) for p, i in by_part(shard_of(value[head], shards), shards)]
            rows += [(p, False, False, bundle(steps(value[alone[i]]), group[alone[i]])) for p, i in by_part(shard_of(value[alone], shards), shards)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), PAIRS.types, strict=True)], schema=PAIRS) if rows else pa.RecordBatch.from_pylist([], PAIRS)

        for batch in batches:
            for keys, ids, held_docs in chunks(*columns(batch), kind):
                r = runs(kind, held_docs)
                held.append((keys[r.doc], ids[r.doc], r.value))
                if sum(len(h[2]) for h in held) >= 2_000_000:
                    yield from flush()
        yield from flush()

    def counted(table: pa.Table) -> pa.Table:
        """What comes back goes on; of the rest, each value with two entries or a local repetition goes to its owners."""
        rows = table.to_pylist()
        out = [{"part": r["part"], "data": r["data"]} for r in rows if r["back"]]
        own, many, group = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for r in rows:
            if not r["back"]:
                value, of, _ = unbundle(r["data"], 2)
                (many if r["many"] else own).append(np.cumsum(value).view(U))
                group.append(of)
        value, group = np.concatenate(own), np.concatenate(group)
        order = np.argsort(value)
        value, group = value[order], group[order]
        same = value[1:] == value[:-1]
        again = np.append(False, same)[: len(value)] | np.append(same, False)[: len(value)] | np.isin(value, np.concatenate(many))
        out += [{"part": g, "data": data} for g, data in by_group(group[again], value[again])]
        return pa.Table.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("data", pa.binary())]))

    sent = docs.mapInArrow(collected, "part int, back boolean, many boolean, data binary")
    shard = F.when(F.col("back"), F.pmod(F.xxhash64("part", "data"), F.lit(shards)).cast("int")).otherwise(F.col("part")).alias("shard")
    return sent.select(shard, "*").groupBy("shard").applyInArrow(counted, "part int, data binary")


MARKS = pa.schema([("part", pa.int32()), ("data", pa.binary())])
SENT = pa.schema([("part", pa.int32()), ("back", pa.bool_()), ("data", pa.binary())])
#: Shards that travel in one piece and are resolved one after another.
FINE = 4


def settle(kind: Kind, found: dict[bytes, list]) -> tuple[list, list[tuple]]:
    """Of equal packed strings, the first and, where only other documents count, its document's others stay open.

    found: packed -> (doc_id, start, key, windows). Returns the spans that are settled, and the open (packed, those)."""
    marks, rest = [], []
    for packed, seen in found.items():
        if len(seen) > 1:
            seen.sort(key=lambda x: x[:2])
            if kind.within:
                keep = [x for x in seen if x[:2] == seen[0][:2]]
            else:
                keep = [x for x in seen if x[0] == seen[0][0]]
            marks += [(x[2], x[1], x[1] + x[3] + kind.k - 1) for x in seen[len(keep) :]]
            seen = keep
        rest.append((packed, seen))
    return marks, rest


def marked(docs: DataFrame, pairs: DataFrame, kind: Kind, groups: int, shards: int) -> DataFrame:
    """part, data: by group, the spans of tokens that are covered by a window with an earlier occurrence, as bundle(keys, place among them, starts, ends)."""

    def packed(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(np.concatenate([np.zeros(0, U), *(np.cumsum(unbundle(d, 1)[0]).view(U) for d in right["data"].to_pylist())]))
        found: dict[bytes, list] = {}
        bucket: dict[bytes, int] = {}
        for keys, ids, texts_ in chunks(*columns(left.select(["key", "doc_id", "text"])), kind) if len(wanted) else ():
            r = runs(kind, texts_)
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, r.value), len(wanted) - 1)] == r.value)
            part = shard_of(r.value[hit], FINE * shards).tolist()
            for b, d, s, n, lo, hi in zip(part, r.doc[hit].tolist(), r.start[hit].tolist(), r.n[hit].tolist(), r.lo[hit].tolist(), r.hi[hit].tolist(), strict=True):
                string = texts_[d][lo:hi]
                found.setdefault(string, []).append((int(ids[d]), s, int(keys[d]), n))
                bucket[string] = b
        marks, rest = settle(kind, found)
        out = [{"part": g, "back": True, "data": data} for g, data in grouped(marks)]
        fine = np.array([bucket[s] for s, _ in rest], np.int64)
        for p, at in by_part(fine // FINE, shards):
            at = at[np.argsort(fine[at], kind="stable")].tolist()
            strings, flat = [rest[i][0] for i in at], [x for i in at for x in rest[i][1]]
            key, first, place = np.unique([x[2] for x in flat], return_index=True, return_inverse=True)
            data = bundle(
                np.bincount(fine[at] % FINE, minlength=FINE), [len(s) for s in strings], [len(rest[i][1]) for i in at], [x[1] for x in flat], place, key, [flat[i][0] for i in first.tolist()],
                raw=b"".join(strings))
            out.append({"part": p, "back": False, "data": data})
        return pa.Table.from_pylist(out, schema=SENT)

    def grouped(marks: list[tuple]) -> Iterator[tuple[int, bytes]]:
        if marks:
            m = np.array(marks, np.int64)
            for g, i in by_part(m[:, 0] % groups, groups):
                key, place = np.unique(m[i, 0], return_inverse=True)
                yield g, bundle(key, place, m[i, 1], m[i, 2])

    def resolved(table: pa.Table) -> pa.Table:
        back, data = table["back"].to_pylist(), table["data"].to_pylist()
        out = [{"part": g, "data": d} for g, b, d in zip(table["part"].to_pylist(), back, data, strict=True) if b]
        sent, marks = [d for b, d in zip(back, data, strict=True) if not b], []
        for f in range(FINE):
            found: dict[bytes, list] = {}
            for d in sent:
                cuts, sizes, owners, starts, place, key, ids, raw = unbundle(d, 7)
                lo, hi = int(cuts[:f].sum()), int(cuts[: f + 1].sum())
                at, x = int(sizes[:lo].sum()), int(owners[:lo].sum())
                rows = list(zip(ids[place[x:]].tolist(), starts[x:].tolist(), key[place[x:]].tolist(), strict=True))
                x = 0
                for size, n in zip(sizes[lo:hi].tolist(), owners[lo:hi].tolist(), strict=True):
                    string = raw[at : at + size]
                    windows = (string.count(b" ") + 1 if kind.words else size) - kind.k + 1
                    found.setdefault(string, []).extend([(*row, windows) for row in rows[x : x + n]])
                    at, x = at + size, x + n
            marks += compared(found)
        out += [{"part": g, "data": d} for g, d in grouped(marks)]
        return pa.Table.from_pylist(out, schema=MARKS)

    def compared(found: dict[bytes, list]) -> list[tuple]:
        marks, rest = settle(kind, found)
        if len(rest) > 1 or (rest and kind.within):
            owner = np.array([x[0][0] for _, x in rest], np.int64)
            begin = np.array([x[0][1] for _, x in rest], np.int64)
            string, offset, first, first_start = kind.resolve([s for s, _ in rest], owner, begin, kind.k)
            others = [(i, x) for i, (_, seen) in enumerate(rest) for x in seen]
            earlier = first < owner[string]
            if kind.within:
                earlier |= (first == owner[string]) & (first_start < begin[string] + offset)
            string, offset = string[earlier], offset[earlier]
            order = np.lexsort((offset, string))
            string, offset = string[order], offset[order]
            new = np.append(True, (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + 1))[: len(string)]
            a = np.flatnonzero(new)
            b = np.append(a, len(string))[1:] - 1
            cut = np.searchsorted(string[a], np.arange(len(rest) + 1)).tolist()
            lo, hi = offset[a].tolist(), (offset[b] + kind.k).tolist()
            marks += [(x[2], x[1] + lo[j], x[1] + hi[j]) for i, x in others for j in range(cut[i], cut[i + 1])]
        return marks

    sent = docs.groupBy("part").cogroup(pairs.groupBy("part")).applyInArrow(packed, "part int, back boolean, data binary")
    shard = F.when(F.col("back"), F.pmod(F.xxhash64("part", "data"), F.lit(shards)).cast("int")).otherwise(F.col("part")).alias("shard")
    return sent.select(shard, "*").groupBy("shard").applyInArrow(resolved, "part int, data binary")


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, kind: Kind, keep_text: bool = False, group_docs: int = 1024) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans, kept_sha256 (and kept_text, a binary, if asked): one row for each row of docs."""
    spark = docs.sparkSession
    groups, shards = max(1, -(-docs.count() // group_docs)), shuffle_partitions(spark)
    docs = texts(docs).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.col("text").cast("binary").alias("text"))
    pairs = materialize(repeated_minimisers(docs, kind, groups, shards))
    dealt = docs.withColumn("part", F.pmod("key", F.lit(groups)).cast("int"))
    marks = materialize(marked(dealt, pairs, kind, groups, shards))
    release(pairs)
    names = ["doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        marks_ = [(key[place], start, end) for key, place, start, end, _ in (unbundle(d, 4) for d in right["data"].to_pylist())]
        key, start, end = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*marks_, strict=True) if marks_ else ((), (), ())))
        order = np.argsort(key, kind="stable")
        key, start, end = key[order], start[order], end[order]
        out: dict[str, list] = {n: [] for n in names}
        for k, doc_id, text in zip(*columns(left.select(["key", "doc_id", "text"])), strict=True):
            a, b = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            spans = union(start[a:b], end[a:b])
            tokens = text.split() if kind.words else text
            parts, last = [], 0
            for lo, hi in spans:
                parts.append(tokens[last:lo])
                last = hi
            parts.append(tokens[last:])
            rest = b" ".join(w for p in parts for w in p) if kind.words else b"".join(parts)
            for n, v in zip(names, (doc_id, len(tokens), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(rest).hexdigest(), rest), strict=False):
                out[n].append(v)
        types = {"doc_id": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.binary()}
        return pa.table([pa.array(out[n], types.get(n, pa.int64())) for n in names], names=names)

    schema = "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * keep_text
    return dealt.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(kept, schema)
