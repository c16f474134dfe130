"""Encoding, decoding and sampling of segmentations with a SentencePiece vocabulary.

Segmentations are sampled without replacement by Gumbel top-k: an agenda holds disjoint sets of the lattice's paths,
each with the largest perturbed log-probability of its paths as bound; taking out the best set, A* fashion, gives the
next sample, and what is left of the set is split at each step of that path. Random numbers are hashes of the row's
key, the sample's number and the place in the text, so they don't depend on partitions, batches or retries.

Pieces hold white space only in front and never a line feed, so encoding and lattices are worked out for each distinct
word of a batch; a path's steps still run over the whole text. The vocabulary has merge ranks instead of
probabilities: a piece counts as 1/rank, normalised (Zipf's law), and a byte of the fallback as the last rank.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import texts

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: In the code points of words, behind each word; no character has it.
END = 0x1FFFFF
#: Characters of texts that are worked on together; a longer text is alone.
TOGETHER = 500_000
#: Characters of distinct words that a worker keeps at most, before those of the next texts.
STORE = 3_000_000
SAMPLES, THETA, SEED = 2, 1.0, 42
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(seed: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, by seed, stream and place."""
    x = seed + np.uint64(stream * int(_C) % (1 << 64)) + at.astype(np.uint64) * _A
    for shift, by in ((30, _B), (27, _C)):
        x ^= x >> np.uint64(shift)
        x *= by
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def rest(log: np.ndarray) -> np.ndarray:
    """Log-probability that a step doesn't take an edge that isn't the only one."""
    return np.log1p(-np.minimum(np.exp(log), 1 - 2.0**-53))


class Table:
    """Numbers by key, in open addressing with at most a quarter of the places taken."""

    def __init__(self, items: dict[int, int]) -> None:
        bits = (4 * len(items)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.array(list(items), np.int64), np.array(list(items.values()), np.int32)
        at = self._at(keys)
        while len(keys):
            free = self.key[at] < 0
            self.key[at[free]] = keys[free]  # of several for one place, the last
            placed = self.key[at] == keys
            self.value[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _A) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = self._at(keys)
        found = self.key[at]
        out = np.where(found == keys, self.value[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            here = self.key[at[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return out


class Vocabulary:
    """The pieces of a model file: a trie in a table, log-probabilities and bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int32)
        out, edges, self.piece, normal = [], {}, [-1], []
        for i, p in enumerate(pieces):
            if m.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b] = i
                out.append(bytes([b]))
                continue
            if m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                out.append(b"")
                continue
            if SPACE in p.lstrip(SPACE) or "\n" in p:
                raise ValueError(f"piece {i} goes over the end of a word")
            normal.append(i)
            out.append(p.replace(SPACE, " ").encode())
            state = 0
            for c in map(ord, p):
                state = edges.setdefault((state << 21) | c, len(self.piece))
                if state == len(self.piece):
                    self.piece.append(-1)
            self.piece[state] = i
        self.edges = Table(edges)
        self.piece = np.array(self.piece, np.int32)
        self.root = np.zeros(END + 1, np.int32)
        for c, state in edges.items():
            if c <= END:
                self.root[c] = state
        weight = np.zeros(n)
        weight[normal] = np.log(np.arange(1, len(normal) + 1))
        total = np.log(np.sum(1.0 / np.arange(1, len(normal) + 1)))
        self.log, self.byte_log = -weight - total, -np.log(len(normal)) - total
        # each piece's bytes, and behind them all pieces as they are at the start of a text
        self.bytes = pa.array(out + [x.removeprefix(b" ") for x in out], pa.large_binary())
        self.sizes = np.fromiter(map(len, out), np.int64, n)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as parts of a text, one after the other, and how many each has.

        Line feeds keep words apart and the model from adding spaces; words that hold one are cut there again.
        """
        parts = [np.array(self.model.encode("\n" + "\n".join(words[i : i + 256])), np.int32)[1:] for i in range(0, len(words), 256)]
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        feeds = apart = np.flatnonzero(ids == self.byte[10])
        if len(feeds) != len(words):
            before = np.cumsum(pc.count_substring(pa.array(words, pa.large_string()), "\n").to_numpy() + 1)
            apart = feeds[np.append(0, before[:-1])]
        return np.delete(ids, apart), (np.diff(np.append(apart, len(ids))) - 1).astype(np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each list of ids, without the space that encoding puts in front; what is no UTF-8 is U+FFFD."""
        ids, first = ids.astype(np.int32), offsets[:-1].astype(np.int64)
        # where the first id that stands for anything is
        at, end = first, offsets[1:]
        while len(at):
            at, end = at[at < end], end[at < end]
            none = self.sizes[ids[at]] == 0
            ids[at[~none]] += len(self.sizes)
            at, end = at[none] + 1, end[none]
        data = self.bytes.take(pa.array(ids))
        ends = np.frombuffer(data.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends[offsets]), data.buffers()[2]])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode(errors="replace") for x in found.to_pylist()], pa.string())


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The lattices of distinct words: edges by node, with log-probabilities given the node, from left to right."""

    def __init__(self) -> None:
        self.start = np.zeros(0, np.int64)
        self.inside = np.zeros(0, bool)
        self.first = self.last = self.src = self.dst = self.id = np.zeros(0, np.int32)
        self.log = self.cum = np.zeros(0)
        self.odd: list[np.ndarray] = []
        self.room: dict[str, np.ndarray] = {}

    def extend(self, v: Vocabulary, words: list[str], theta: float) -> None:
        """Adds words behind those that are there."""
        size = np.fromiter(map(len, words), np.int32, len(words))
        ends = np.cumsum(size + 1, dtype=np.int32) - 1
        cp = np.full(int(ends[-1]) + 1 if len(ends) else 0, END, np.int64)
        inside = np.ones(len(cp), bool)
        inside[ends] = False
        cp[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        single = np.zeros(len(cp), bool)
        pos = np.flatnonzero(inside).astype(np.int32)
        state, length, found = v.root[cp[pos]].astype(np.int64), 1, []
        pos, state = pos[state > 0], state[state > 0]
        while len(pos) or length == 1:
            if length > 1:
                child = v.edges.get((state << 21) | cp[pos + (length - 1)])
                hit = child >= 0
                pos, state = pos[hit], child[hit].astype(np.int64)
            piece = v.piece[state]
            ok = piece >= 0
            found.append((pos[ok], piece[ok], length))
            if length == 1:
                single[pos[ok]] = True
            length += 1
        # a character that is no piece goes as its bytes
        odd = np.flatnonzero(inside & ~single).astype(np.int32)
        found.append((odd, -1 - len(self.odd) - np.arange(len(odd), dtype=np.int32), 1))
        bytes_ = [v.byte[list(chr(c).encode())] for c in cp[odd].tolist()]
        found.reverse()
        src = np.concatenate([x[0] for x in found])
        order = np.argsort(src, kind="stable")
        src = src[order]
        ids = np.concatenate([x[1] for x in found])[order]
        dst = np.concatenate([x[0] + np.int32(x[2]) for x in found])[order]
        score = v.log[np.maximum(ids, 0)]
        score[ids < 0] = v.byte_log * np.fromiter(map(len, bytes_), np.int64, len(bytes_))[-1 - len(self.odd) - ids[ids < 0]]
        score *= theta
        count = np.bincount(src, minlength=len(cp)).astype(np.int32)
        first = np.cumsum(count, dtype=np.int32) - count
        # sums over all ways from a node to the word's end, nodes nearest to the end first
        far = np.repeat(ends, size + 1) - np.arange(len(cp), dtype=np.int32)
        ways = np.zeros(len(cp))
        by = np.argsort(far[src].astype(np.uint16 if far.max(initial=0) < 1 << 16 else np.int32), kind="stable")
        heads = np.flatnonzero(np.append(True, src[by][1:] != src[by][:-1])) if len(by) else by
        node, to, sc = src[by][heads], dst[by], score[by]
        level = far[node]
        cuts = np.flatnonzero(np.append(True, level[1:] != level[:-1])).tolist() if len(level) else []
        for x, y in pairwise([*cuts, len(node)]) if cuts else []:
            lo, hi = heads[x], heads[y] if y < len(heads) else len(by)
            ways[node[x:y]] = np.logaddexp.reduceat(sc[lo:hi] + ways[to[lo:hi]], heads[x:y] - lo)
        log = np.minimum(score + ways[dst] - ways[src], 0.0)
        log[count[src] == 1] = 0.0
        # summed within each node, so that nothing depends on what other words there are
        cum = np.exp(log)
        rank = np.arange(len(src), dtype=np.int32) - first[src]
        left, r = np.flatnonzero(rank), 1
        while len(left):
            here = rank[left] == r
            now, left, r = left[here], left[~here], r + 1
            cum[now] += cum[now - 1]
        nodes, edges = np.int32(len(self.inside)), np.int32(len(self.src))
        self.append(start=(ends - size + nodes).astype(np.int64), inside=inside, first=first + edges, last=first + count - 1 + edges)
        self.append(src=src + nodes, dst=dst + nodes, id=ids, log=log, cum=cum)
        self.odd += bytes_

    def append(self, **more: np.ndarray) -> None:
        """Puts numbers behind those of each name, in room that grows by half."""
        for name, new in more.items():
            old, room = getattr(self, name), self.room.get(name)
            n = len(old) + len(new)
            if room is None or len(room) < n:
                room = self.room[name] = np.empty(n + n // 2, new.dtype)
                room[: len(old)] = old
            room[len(old) : n] = new
            setattr(self, name, room[:n])

    def paths(self, node: np.ndarray, base: np.ndarray, seed: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of a sampled way from each node to its word's end, one after the other, whether each was a choice,
        and how many each way has."""
        who, count, steps = np.arange(len(node)), np.zeros(len(node), np.int64), []
        e, last = self.first[node], self.last[node]
        while True:
            # the end of a word has no edge
            on = np.flatnonzero(e <= last)
            if not len(on):
                break
            who, node, e, last = who[on], node[on], e[on], last[on]
            choice = e < last
            more = np.flatnonzero(choice)
            at = who[more]
            u = uniform(seed[at], stream, base[at] + node[more])
            while len(more):
                on = np.flatnonzero(u >= self.cum[e[more]])
                more, u = more[on], u[on]
                e[more] += 1
                on = np.flatnonzero(e[more] < last[more])
                more, u = more[on], u[on]
            steps.append((who, e, choice))
            count[who] += 1
            node = self.dst[e]
            e, last = self.first[node], self.last[node]
        out, begin = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        free = np.empty(len(out), bool)
        for i, (who, e, choice) in enumerate(steps):
            at = begin[who] + i
            out[at], free[at] = e, choice
        return out, free, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        ids = self.id[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        parts, at = [], 0
        for i in odd.tolist():
            parts += [ids[at:i], self.odd[-1 - ids[i]]]
            at = i + 1
        return np.concatenate([*parts, ids[at:]])


class _Row:
    """The agenda and the samples of one text: (-bound, number, sample, step, edges taken, log-probability before)."""

    def __init__(self, words: tuple[int, int], seed: np.ndarray) -> None:
        self.words, self.seed, self.agenda, self.paths, self.found = words, seed, [], [], []

    def add(self, lattice: Lattice, path: np.ndarray, word: np.ndarray, log: np.ndarray, noise: np.ndarray, fork: tuple | None, bound: float, want: int) -> None:
        """Takes a path as the next sample and splits what is left of its set.

        noise: of the steps behind the fork, perturbed log-probability of not taking the edge, -inf where it is the only one.
        """
        r = len(self.paths)
        self.paths.append((path, word, log))
        after = np.cumsum(log)
        self.found.append((float(after[-1]) if len(path) else 0.0, bound))
        before = after - log
        skip = 0
        if fork:
            t, taken, base = fork
            skip = t + 1
            self.put(lattice, r, t, [*taken, int(path[t])], base, bound)
        score = before[skip:] + noise
        best = np.flatnonzero(score > -np.inf)
        if len(best) > want:
            best = best[np.argpartition(-score[best], want - 1)[:want]]
        for t in best.tolist():
            self.push(r, t + skip, [int(path[t + skip])], float(before[t + skip]), float(score[t]), bound)

    def put(self, lattice: Lattice, r: int, t: int, taken: list[int], base: float, bound: float) -> None:
        left = np.exp(lattice.log[self.free(lattice, taken)]).sum()
        if left > 0:
            u = uniform(self.seed, 3 * r + 2, np.array([t]))
            self.push(r, t, taken, base, base + float(np.log(left) + gumbel(u)[0]), bound)

    def push(self, r: int, t: int, taken: list[int], base: float, score: float, bound: float) -> None:
        """The maximum of a set, given that it is below bound."""
        heapq.heappush(self.agenda, (float(np.logaddexp(-bound, -score)), len(self.agenda), r, t, taken, base))

    @staticmethod
    def free(lattice: Lattice, taken: list[int]) -> list[int]:
        node = lattice.src[taken[0]]
        return [e for e in range(lattice.first[node], lattice.last[node] + 1) if e not in taken]


def samples(lattice: Lattice, code: np.ndarray, cuts: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: ids, log-probability, perturbed log-probability, logarithm of the inclusion score.

    code: the words of all texts; cuts: where texts begin among them. A path is included if its perturbed
    log-probability is above that of the best path left behind; the score is the probability of that.
    """
    size = np.diff(np.append(lattice.start, len(lattice.inside)))[code] - 1
    place = np.cumsum(size) - size
    begin = np.append(place, size.sum())[cuts[:-1]]
    owner = np.repeat(np.arange(len(seeds)), np.diff(cuts))
    base, seed = place - begin[owner] - lattice.start[code], seeds[owner]
    rows = [_Row((int(a), int(b)), seeds[i : i + 1]) for i, (a, b) in enumerate(pairwise(cuts.tolist()))]
    bounds = gumbel(uniform(seeds, 0, np.full(len(seeds), 1 << 62)))
    # rows that go on: whence, the step and the edge where they leave it, and their bound
    todo = [(row, None, -1, [], 0.0, float(b)) for row, b in zip(rows, bounds, strict=True)]
    for r in range(k):
        nodes, which, forks = [], [], []
        for row, parent, t, taken, _, _ in todo:
            if parent is None:
                which.append(np.arange(*row.words))
                nodes.append(lattice.start[code[which[-1]]])
                forks.append(None)
                continue
            path, word, logs = row.paths[parent]
            free = _Row.free(lattice, taken)
            p = np.cumsum(np.exp(lattice.log[free]))
            u = uniform(row.seed, 3 * r + 3, np.array([t]))[0] * p[-1]
            edge = free[min(int(np.searchsorted(p, u, "right")), len(free) - 1)]
            which.append(np.arange(int(word[t]), row.words[1]))
            start = lattice.start[code[which[-1]]]
            start[0] = lattice.dst[edge]
            nodes.append(start)
            forks.append((path[:t], word[:t], edge, word[t], logs[:t]))
        if not todo:
            break
        w, node = np.concatenate(which), np.concatenate(nodes)
        edges, choice, count = lattice.paths(node, base[w], seed[w], 3 * r + 1)
        words = np.repeat(w, count)
        log, noise, free = lattice.log[edges], np.full(len(edges), -np.inf), np.flatnonzero(choice)
        at = words[free]
        noise[free] = rest(log[free]) + gumbel(uniform(seed[at], 3 * r + 2, base[at] + lattice.src[edges[free]] + (1 << 40)))
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum([len(x) for x in which])])].tolist()
        for (row, _, t, taken, before, bound), fork, (a, b) in zip(todo, forks, pairwise(ends), strict=True):
            path, word, logs = edges[a:b], words[a:b], log[a:b]
            if fork:
                path, word = np.concatenate([fork[0], [fork[2]], path]), np.concatenate([fork[1], [fork[3]], word])
                logs = np.concatenate([fork[4], [lattice.log[fork[2]]], logs])
            row.add(lattice, path, word, logs, noise[a:b], (t, taken, before) if fork else None, bound, k - r)
        if r + 1 < k:
            todo = []
            for row in rows:
                if row.agenda and len(row.paths) == r + 1:
                    cost, _, parent, t, taken, before = heapq.heappop(row.agenda)
                    todo.append((row, parent, t, taken, before, -cost))
    out = []
    for row in rows:
        behind = -row.agenda[0][0] if row.agenda else -np.inf
        out.append([(lattice.ids(p[0]), lp, g, log_inclusion(lp, behind)) for p, (lp, g) in zip(row.paths, row.found, strict=True)])
    return out


def log_inclusion(log: float, behind: float) -> float:
    """Logarithm of the probability that log plus Gumbel noise is above behind."""
    x = log - behind
    if x > 3.5:
        return float(np.log1p(-np.exp(-np.exp(min(x, 700.0)))))
    return float(x if x < -36 else np.log(-np.expm1(-np.exp(x))))


class Segmenter:
    """Encodes and samples texts, with a bounded store of the words of earlier ones."""

    def __init__(self, v: Vocabulary, theta: float, nodes: int = STORE) -> None:
        self.v, self.theta, self.nodes = v, theta, nodes
        self.clear()

    def clear(self) -> None:
        # words with and without the space in front that cutting at spaces takes away
        self.code: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.lattice = Lattice()
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def codes(self, words: list[str], whole: bool = False) -> np.ndarray:
        """Numbers of words, after learning the new ones; whole: as they are, or else a space goes in front."""
        code = self.code[whole]
        out = np.fromiter(map(code.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            first = list(dict.fromkeys(words[i] for i in new))
            full = first if whole else [SPACE + w for w in first]
            ids, size = self.v.encode(full)
            code.update(zip(first, range(len(self.size), len(self.size) + len(first)), strict=True))
            self.size, self.flat = np.append(self.size, size), np.append(self.flat, ids)
            self.lattice.extend(self.v, full, self.theta)
            out[new] = [code[words[i]] for i in new]
        return out

    def __call__(self, texts_: list[str], seeds: np.ndarray, k: int) -> tuple[list[np.ndarray], list]:
        """For each text its encoding and its samples."""
        if len(self.lattice.inside) > self.nodes:
            self.clear()
        # texts with runs of spaces are cut by the pattern, all others at each space; a line feed within a word does no harm
        odd = [i for i, t in enumerate(texts_) if "  " in t or SPACE in t or t[:1] in ("", " ") or t[-1:] == " "]
        own = {i: WORD.findall((SPACE + texts_[i]).replace(" ", SPACE)) if texts_[i] else [] for i in odd}
        lists = pc.split_pattern(pa.array([None if i in own else t for i, t in enumerate(texts_)], pa.large_string()), " ")
        count = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        known = lists.flatten().dictionary_encode()
        code = self.codes(_cut(known.dictionary))[known.indices.to_numpy()]
        del lists, known
        if odd:
            here = np.cumsum(count)[odd] - count[odd]
            count[odd] = [len(own[i]) for i in odd]
            code = np.insert(code, np.repeat(here, count[odd]), self.codes(list(chain.from_iterable(own.values())), whole=True))
        cuts = np.concatenate([[0], np.cumsum(count)])
        each, start = self.size[code].astype(np.int64), (np.cumsum(self.size, dtype=np.int64) - self.size)[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = self.flat[np.repeat(start - ends[:-1], each) + np.arange(ends[-1])]
        encoded = np.split(ids, ends[cuts[1:-1]]) if len(texts_) > 1 else [ids]
        return encoded, samples(self.lattice, code, cuts, seeds, k) if k else [[] for _ in texts_]


def _cut(words: pa.Array) -> list[str]:
    """Strings without spaces, as one that is cut again, which is faster than one by one."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py()
    return joined.split(" ") if len(words) else []


@lru_cache(1)
def segmenter(path: str, theta: float) -> Segmenter:
    """One for each worker, whatever the number of its tasks."""
    return Segmenter(vocabulary(path), theta)


NAMES = ["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion", "text"]
SCHEMA = "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


def encodings(docs: DataFrame, path: str, k: int = SAMPLES, theta: float = THETA, seed: int = SEED, decode: bool = False) -> DataFrame:
    """doc_id, rank, ids, log_prob, perturbed, log_inclusion: for each row of docs its encoding, of rank 0 and without
    scores, and up to k distinct sampled segmentations, of rank 1 and up in descending order of perturbed.

    With decode, text too, that the ids stand for: as decoded() makes it, but in the same process.

    theta is the inverse temperature of log-probabilities. Rows of one doc_id and text get the same samples; those
    without doc_id share a key. A null or empty text has no ids and one segmentation, which is certain. A text with
    fewer segmentations than k gives all, each certain. An empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter(path, theta)
        for batch in batches:
            doc, text = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(doc):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
                seeds = np.array([xxhash.xxh64_intdigest(str(d), seed) for d in doc[at:end]], np.uint64)
                out = segment(text.slice(at, end - at).to_pylist(), seeds, k)
                flat = [(d, i, *x) for d, e, s in zip(doc[at:end], *out, strict=True) for i, x in enumerate([(e, None, None, None), *s])]
                del out
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x[2]) for x in flat])]).astype(np.int32), np.concatenate([x[2] for x in flat]).astype(np.int32))
                columns = [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()), lists, *[pa.array([x[i] for x in flat], pa.float64()) for i in (3, 4, 5)]]
                del flat
                if decode:
                    columns.append(segment.v.decode(lists.values.to_numpy(), lists.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])
                del columns, lists
                at = end

    return texts(docs).mapInArrow(rows, SCHEMA + ", text string" if decode else SCHEMA)


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of encoded and text, that its ids stand for; null ids stand for the empty text.

    Ids of control pieces stand for nothing; what is no UTF-8 becomes U+FFFD. Encoding then decoding gives a text
    back, but for U+2581, which comes back as a space. A column text of encoded is replaced.
    """
    kept = [F.col(c) for c in encoded.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            sizes = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, "right")) - 1)
                text = v.decode(flat[ends[at] : ends[end]], ends[at : end + 1] - ends[at])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "text"])
                at = end

    schema = encoded.select(*kept).schema.add("text", "string")
    return encoded.select(*kept).mapInArrow(rows, schema)
