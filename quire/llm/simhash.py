"""SimHash fingerprints, and links between those that differ in few bits, by pigeonhole blocks.

A fingerprint of 64 bits is cut into five blocks; two that differ in at most three bits agree on two blocks at
least, so each of the ten pairs of blocks is a key to join on. Distances are verified within a key's group, from
which a spanning forest of its links goes out: it connects what the group's links connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, joined, materialize, release, shuffle_partitions, slices, texts
from quire.llm.components import components

SEED = 42
#: Lower-cases A-Z and leaves all else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashes(strings: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in strings]), ">u8")


def majority(h: np.ndarray) -> np.ndarray:
    """The bit is 1 where over half of the hashes have it; as one 64-bit number in an array."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[at : at + (1 << 14)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">i8").astype(np.int64)


def shingles(text: bytes, k: int) -> list[bytes]:
    words = text.translate(LOWER).split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends.tolist()]
    return [line[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)]


def fingerprint(text: bytes, k: int = 3) -> int:
    return int(majority(hashes(shingles(text, k)))[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp: the majority fingerprint of each row's k-word shingles, repeats included; zero without words."""

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            fp = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(rows, "doc_id long, fp long")


def _masks(bits: list[int], blocks: int, chosen: int) -> list[int]:
    """The bits of each choice of blocks, as signed 64-bit masks."""
    parts = np.array_split(np.array(bits), blocks)
    out = []
    for some in combinations(parts, chosen):
        m = sum(1 << int(b) for part in some for b in part)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _groups(batches, key: str) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Batches cut between keys, with the first row of each key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            keys = batch.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut or (held and held[-1].column(key)[0].as_py() != keys[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                yield _table(held, key)
                held = []
            held.append(batch.slice(cut))
    if held:
        yield _table(held, key)


def _table(held: list[pa.RecordBatch], key: str):
    table = pa.Table.from_batches(held).combine_chunks()
    keys = table[key].to_numpy()
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), table


def forest(fp: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a group: each member is compared with those that no tree has reached yet."""
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = near(i, left)
            reached = left[hit]
            out += [(i, int(j)) for j in reached]
            front += reached.tolist()
            left = left[~hit]
    return out


def links(fps: DataFrame, distance: int = 3, checked: Callable | None = None, whole: int = 4096) -> DataFrame:
    """a, b: pairs of nodes whose fp differs in at most distance bits, enough of them to connect all such pairs.

    fps: node, fam, fp, and extra when checked is given: (extra of one, extras of others) -> whether to link. Only
    rows of one fam are compared. Keys with over `whole` members are split again by blocks of their free bits.
    """
    blocks, chosen = distance + 2, 2
    first = _masks(list(range(64)), blocks, chosen)
    second = [_masks([b for b in range(64) if not m >> b & 1], 5, 5 - distance) for m in first]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    cols = ["node", "fp", *(["extra"] if checked else [])]
    keyed = fps.select("fam", *cols, F.posexplode(longs(first)).alias("t", "mask")).select(F.xxhash64("fam", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "t", *cols)

    def inner(rows: DataFrame) -> DataFrame:
        schema = "a long, b long"

        def found(batches):
            for start, table in _groups(batches, "k"):
                node, fp = table["node"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
                extra = np.frombuffer(b"".join(table["extra"].to_pylist()), np.uint64).reshape(len(node), -1) if checked else None
                size = np.diff(np.append(start, len(node)))

                def near(i, j, fp=fp, extra=extra):
                    hit = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                    return hit & checked(extra[i], extra[j]) if checked else hit

                at = np.arange(len(node))
                group = np.repeat(np.arange(len(start)), size)
                small = size[group] <= 8
                pairs = []
                for d in range(1, 8):
                    i = at[:-d][small[:-d] & (group[:-d] == group[d:])]
                    hit = near(i, i + d)
                    pairs += [(node[i[hit]], node[i[hit] + d])]
                for g in np.flatnonzero(size > 8).tolist():
                    base = start[g]
                    own = forest(fp[base : base + size[g]], lambda i, j, base=base: near(base + i, base + j))
                    if own:
                        e = np.array(own) + base
                        pairs.append((node[e[:, 0]], node[e[:, 1]]))
                a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return rows.select("k", *cols).sortWithinPartitions("k").mapInArrow(found, schema)

    counts = keyed.groupBy("k").agg(F.count("*").alias("members")).where("members > 1")
    shared = joined(keyed, counts, "k")
    wide = shared.where(F.col("members") > whole)
    mask2 = F.array(*[longs(m) for m in second])
    split = wide.select("k", *cols, F.posexplode(F.get(mask2, F.col("t"))).alias("t2", "mask2")).select(F.xxhash64("k", "t2", F.col("fp").bitwiseAND(F.col("mask2"))).alias("k"), *cols)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inner(shared.where(F.col("members") <= whole).repartition(n, "k")).unionByName(inner(split.repartition(n, "k"))).distinct()


def simhash_groups(docs: DataFrame, k: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs.

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id reachable. A null
    text has no words and fingerprint zero, which links like any other. Rows that share a fingerprint are one node.
    A null doc_id stays null and is no component's smallest unless it is alone. An empty table gives no rows.
    """
    rows = materialize(fingerprints(texts(docs), k))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select(F.col("fp").alias("node"), F.lit(0).alias("fam"), "fp"), distance))
    rooted = joined(nodes, roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined(rooted, best, "root").select("fp", "component_id")
    return joined(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates for a pipeline: fingerprints that link propose pairs, and MinHash bands of five-word shingle sets those
# that an edit has taken farther apart; all are held against similarity 0.8.

SHINGLE = 5
#: Keys of a set, and minima in each: a pair of similarity 0.8 shares one with 0.99995, of 0.5 with 0.55.
BANDS, WIDTH = 25, 5
#: Equal minima of all that a candidate needs; a pair of similarity 0.8 has 100 of 125 on average, 79 at 4.7 deviations less.
AGREE = 79
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * WIDTH), np.uint64)


def minima(sets: np.ndarray) -> np.ndarray:
    """The least of each permutation's values over a set of hashes."""
    turn, odd = _DRAWN[0][:, None], _DRAWN[1][:, None] | np.uint64(1)
    least = np.full(BANDS * WIDTH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(sets), 512):
        x = (sets[None, at : at + 512] ^ turn) * odd
        x ^= x >> np.uint64(32)
        x *= odd
        np.minimum(least, x.min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    x = ((least ^ (least >> np.uint64(31))) * (_DRAWN[2] | np.uint64(1))).reshape(BANDS, WIDTH).sum(1, dtype=np.uint64)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xD6E8FEB86659FD93) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(hashes(shingles(text, SHINGLE))).astype(np.uint64)


def set_node(sets: np.ndarray) -> int:
    """One number for equal sets."""
    h = xxhash.xxh64_intdigest(sets.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _near(sig: np.ndarray, n: np.ndarray, i, j) -> np.ndarray:
    """Whether signatures and sizes leave a similarity of 0.8 possible."""
    fits = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
    return fits & ((sig[i] == sig[j]).sum(-1) >= AGREE)


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _by_key(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.select("k", "node", *cols).repartition(shuffle_partitions(rows.sparkSession), "k").sortWithinPartitions("k", "node")


def stars(rows: DataFrame) -> DataFrame:
    """a, b: each key's first node and another that could be similar. rows: k, node, n (the size of the set), sig."""

    def found(batches):
        for start, table in _groups(batches, "k"):
            node, n, sig = table["node"].to_numpy(), table["n"].to_numpy(), _signatures(table)
            first = np.repeat(start, np.diff(np.append(start, len(node))))
            j = np.flatnonzero(np.arange(len(node)) != first)
            j = j[_near(sig, n, first[j], j)]
            yield pa.RecordBatch.from_arrays([pa.array(node[first[j]], pa.int64()), pa.array(node[j], pa.int64())], names=["a", "b"])

    return _by_key(rows, "n", "sig").mapInArrow(found, "a long, b long").distinct()


def apart(rows: DataFrame) -> DataFrame:
    """k, node, root: of keys that hold several roots, the nodes that could be similar to one of another root.

    Each node goes out once for a key, whatever the number of its candidates. The key's first node is left out, as
    stars() has it with all others.
    """

    def found(batches):
        for start, table in _groups(batches, "k"):
            node, n, sig, root = table["node"].to_numpy(), table["n"].to_numpy(), _signatures(table), table["root"].to_numpy()
            size = np.diff(np.append(start, len(node)))
            mixed = np.add.reduceat(root != np.repeat(root[start], size), start) > 0
            open_ = np.zeros(len(node), bool)
            for g in np.flatnonzero(mixed & (size > 2)).tolist():
                end = start[g] + size[g]
                for i in range(start[g] + 1, end - 1):
                    j = np.arange(i + 1, end)
                    j = j[root[i + 1 : end] != root[i]]
                    j = j[_near(sig, n, i, j)]
                    open_[j] = True
                    open_[i] |= len(j) > 0
            yield table.filter(pa.array(open_)).select(["k", "node", "root"]).combine_chunks().to_batches()[0] if open_.any() else pa.RecordBatch.from_pylist([], table.select(["k", "node", "root"]).schema)

    return _by_key(rows, "n", "sig", "root").mapInArrow(found, "k long, node long, root long")


def set_forest(sets: list[np.ndarray], root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of exact similarity of 0.8 or more that connect all roots of a group that such pairs connect."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(ids.max(initial=-1) + 1, np.int64)
    left, out = np.ones(len(sets), bool), []
    while left.any():
        front = np.flatnonzero(root == root[np.argmax(left)]).tolist()
        left[front] = False
        while front and left.any():
            i = front.pop()
            own = ids[start[i] : start[i] + size[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[ids], start)
            mark[own] = 0
            for j in np.flatnonzero(left & (9 * common >= 4 * (size + size[i]))).tolist():
                if left[j]:
                    out.append((i, j))
                    more = np.flatnonzero(left & (root == root[j]))
                    left[more] = False
                    front += more.tolist()
    return out


def forests(rows: DataFrame) -> DataFrame:
    """a, b: pairs of exact similarity of 0.8 or more, a forest for each key. rows: k, node, root, set."""

    def found(batches):
        for start, table in _groups(batches, "k"):
            node, root, raw = table["node"].to_numpy(), table["root"].to_numpy(), table["set"].to_pylist()
            pairs = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(node)], strict=True):
                if b - a > 1:
                    pairs += [(node[a + i], node[a + j]) for i, j in set_forest([np.frombuffer(x, np.uint64) for x in raw[a:b]], root[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return _by_key(rows, "root", "set").mapInArrow(found, "a long, b long").distinct()


def sets_of(wanted: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set of the nodes wanted, made again of the texts of their least rows. own: doc_id, text, digest; nodes: node, least."""

    def sets(batches):
        for batch in (part for whole in batches for part in slices(whole, 0)):
            found = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_node(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "set"])

    rows = nodes.join(wanted.distinct(), "node").select(F.col("least.null").alias("null"), F.coalesce("least.doc_id", F.lit(-1)).alias("i"), F.col("least.digest").alias("digest"))
    of = own.select("text", "digest", F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(-1)).alias("i")).join(rows.distinct(), ["null", "i", "digest"], "left_semi")
    return materialize(of.select("text").mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]))


def similar(pairs: DataFrame, own: DataFrame, nodes: DataFrame, share: int = 64) -> DataFrame:
    """a, b: the pairs whose shingle sets have Jaccard similarity 0.8 or more, exactly.

    The sets of all b that an a has go past it one by one; an a with over `share` of them is in several places.
    """

    def kept(batches):
        now, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = ([], [])
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                y = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    now, x = a, y.copy()
                    continue
                assert now == a
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 9 * common >= 4 * (len(x) + len(y)):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    made = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), own, nodes)
    parts = F.ceil(F.col("partners") / share)
    dealt = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("partners")), "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("s"))
    firsts = dealt.select("a", "s").distinct().join(made, F.col("a") == F.col("node")).select("a", F.lit(None).cast("long").alias("b"), "set", "s")
    seconds = dealt.join(made, F.col("b") == F.col("node")).select("a", "b", "set", "s")
    n = shuffle_partitions(pairs.sparkSession)
    rows = firsts.unionByName(seconds).repartition(n, "a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    out = materialize(rows.select("a", "b", "set").mapInArrow(kept, "a long, b long"))
    release(made)
    return out


def proposed(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """a, b: pairs of nodes that connect all whose fingerprints differ in at most distance bits. nodes: node, fp.

    Nodes of one fingerprint go with the least of them, which stands for it among the links of fingerprints.
    """
    stands = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = joined(nodes, stands, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    far = links(stands.select(F.col("fp").alias("node"), F.lit(0).alias("fam"), "fp"), distance)
    one = joined(far, stands.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
    both = joined(one, stands.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    out = materialize(same.unionByName(both))
    release(stands)
    return out


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest, component_id, kept: for each doc_id and text of docs once; near copies share a component.

    digest: md5 of the text. component_id is the component's smallest doc_id, where null is the largest; one row of each
    component is kept, that of the smallest doc_id, then digest. Candidates are SimHash links, of fingerprints that differ
    in at most three bits, as in simhash_groups. Edits that change more bits are candidates if they share one of 25 keys,
    each of five minima of their sets of five-word shingles. First each key's nodes are held against the smallest; then
    those that could be similar to one that these links leave apart go, with their sets, to their keys again, from which
    a forest of links goes out. A pair of either kind links only if its sets have similarity 0.8 or more.
    Texts under five words have their whole sequence as shingle; a null text is empty. An empty table gives no rows.
    """

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            out = ([], [], [], [], [])
            for text in batch.column(1).to_pylist():
                out[4].append(fingerprint(text))
                sets = shingle_set(text)
                least = minima(sets)
                out[0].append(set_node(sets))
                out[1].append(len(sets))
                out[2].append((least >> np.uint64(24)).astype(np.uint8).tobytes())
                out[3].append(band_keys(least))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(out[0]) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), keys, pa.array(out[4], pa.int64())], names=["doc_id", "digest", "node", "n", "sig", "ks", "fp"])

    own = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.md5("text").alias("digest"))
    node = materialize(own.mapInArrow(rows, "doc_id long, digest string, node long, n long, sig binary, ks array<long>, fp long"))
    # rows with the same set are one node, whatever their number; the least row stands for it
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest")
    nodes = materialize(node.groupBy("node").agg(F.min(first).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("ks").alias("ks"), F.min_by("fp", first).alias("fp")))
    keyed = nodes.select("node", "n", "sig", F.explode("ks").alias("k"))
    counts = keyed.groupBy("k").agg(F.count("*").alias("members")).where("members > 1").select("k")
    shared = materialize(joined(keyed, counts, "k"))
    close = proposed(nodes.select("node", "fp"))
    candidates = materialize(stars(shared).unionByName(close).distinct())
    release(close)
    found = similar(candidates, own, nodes)
    roots = components(found)
    rest = materialize(apart(joined(shared, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))))
    sets = sets_of(rest.select("node"), own, nodes)
    more = materialize(forests(rest.join(sets, "node")))
    release(candidates, rest, shared, sets)
    roots = components(found.unionByName(more))
    rooted = materialize(joined(nodes, roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    named = joined(rooted, best, "root").select("node", "best")
    each = node.select("doc_id", "digest", "node").dropDuplicates(["doc_id", "digest"])
    release(found, more)
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    return joined(each, named, "node").select("doc_id", "digest", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicate_groups keeps, all columns as they are.

    Rows are told apart by doc_id and text, so that other texts of a doc_id stay; rows that repeat both stay together.
    """
    i, null, digest = fresh(docs.columns, "id", "null", "digest")
    key = lambda c, d: (F.coalesce(c, F.lit(-1)).alias(i), c.isNull().alias(null), d.alias(digest))
    gone = near_duplicate_groups(docs).where("not kept").select(*key(F.col("doc_id"), F.col("digest")))
    rows = docs.select("*", *key(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit("")))))
    return rows.join(gone, [i, null, digest], "left_anti").select(docs.columns)
