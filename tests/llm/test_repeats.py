import hashlib
import random

import numpy as np
import pytest

from quire.llm import repeats
from quire.llm.substring_dedup import by_sorting, remove_repeated_words
from quire.llm.suffix_dedup import remove_repeated_bytes


def brute(rows, k, words):
    seq = [((t or "").encode().split() if words else (t or "").encode(), 1 << 63 if d is None else d) for d, t in rows]
    first = {}
    for tokens, d in seq:
        for i in range(len(tokens) - k + 1):
            w = tuple(tokens[i : i + k])
            at = (d, i) if words else (d,)
            first[w] = min(first.get(w, at), at)
    out = []
    for (tokens, d), (doc_id, _) in zip(seq, rows, strict=True):
        gone = [False] * len(tokens)
        for i in range(len(tokens) - k + 1):
            if first[tuple(tokens[i : i + k])] < ((d, i) if words else (d,)):
                gone[i : i + k] = [True] * k
        kept = [t for t, g in zip(tokens, gone, strict=True) if not g]
        kept = b" ".join(kept) if words else bytes(kept)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(tokens), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def table(seed):
    r = random.Random(seed)
    word = ["a", "the", "ré", "of", "x" * 30, "der", "日本", "to", "b"]
    passages = [" ".join(r.choice(word) for _ in range(r.randint(22, 60))) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [" ".join(r.choice(word) + str(r.randint(0, 300)) for _ in range(r.randint(0, 40))) for _ in range(3)]
        text = parts[0] + " " + r.choice(passages) + "\n" + parts[1] + "\t " * r.randint(0, 1) + r.choice([*passages, ""]) + parts[2]
        texts.append(text)
    texts += [None, "", " \n", "a " * 200, "b" * 300, texts[0], texts[0], texts[1] + " tail", "q " + texts[2]]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + [(rows[3][0], rows[3][1]), (None, rows[5][1]), (rows[6][0], rows[7][1])]


@pytest.mark.parametrize("words", [False, True])
def test_against_brute_force(spark, words):
    for seed in range(2):
        rows = table(seed)
        docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, part string")
        out = remove_repeated_words(docs) if words else remove_repeated_bytes(docs)
        got = [tuple(r) for r in out.select("doc_id", out.columns[1], "n_removed", "n_spans", "kept_sha256").collect()]
        assert sorted(got, key=str) == brute(rows, 20 if words else 50, words)


def test_short_texts_that_repeat_themselves(spark):
    """Each repeats a few words of its own alone, wherever it lies among the others."""
    r = random.Random(1)
    rows = [(d, " ".join(([f"w{d}x{j}" for j in range(r.choice([1, 1, 2, 3, 5]))] * 40)[: r.randint(20, 40)])) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(x) for x in remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows, 20, True)


def test_equal_windows_of_a_text_are_in_two_runs(monkeypatch):
    monkeypatch.setattr(repeats, "PLACE", 7)  # places begin again every 128 words
    r = random.Random(2)
    docs = [b" ".join(([b"w%d" % r.randint(0, 50) for _ in range(r.choice([1, 2, 3]))] * 40)[: r.randint(20, 40)]) for _ in range(200)]
    found = repeats.runs(repeats.Kind(True, 20, 6, True, by_sorting), docs)
    windows = [len(d.split()) - 19 for d in docs]
    assert [int(found.n[found.doc == i].sum()) for i in range(200)] == windows
    for d, s, n in zip(found.doc.tolist(), found.start.tolist(), found.n.tolist(), strict=True):
        words = docs[d].split()
        assert len({tuple(words[i : i + 20]) for i in range(s, s + n)}) == n


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_words(docs).count() == remove_repeated_bytes(docs).count() == 0


def test_many_small_pieces_take_little_room():
    """At scale a piece holds a few strings of a few rows; each may only take little more than its numbers."""
    r = random.Random(3)
    key = np.array([r.getrandbits(63) for _ in range(4)])
    data = repeats.bundle(key, [0, 1, 2, 3], [r.randint(0, 9000) for _ in range(4)], [r.randint(0, 9000) for _ in range(4)], raw=b"tail")
    assert len(data) < 120
    back = repeats.unbundle(data, 4)
    assert back[0].tolist() == key.tolist() and back[1].tolist() == [0, 1, 2, 3] and back[4] == b"tail"
    value = np.unique(np.array([r.getrandbits(48) for _ in range(20_000)], np.uint64))
    shard = repeats.shard_of(value, 64)
    assert shard[0] == 0 and shard[-1] == 63 and (np.diff(shard) >= 0).all()
    one = value[shard == 5]
    assert len(repeats.bundle(repeats.steps(one))) < 5.5 * len(one) and (np.cumsum(repeats.unbundle(repeats.bundle(repeats.steps(one)), 1)[0]) == one.astype(np.int64)).all()
