import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import toxicity as tox
from quire.llm.toxicity import toxicity, train, without_toxic, words


def table(n=1200):
    r = random.Random(4)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rude = ["grub" + a + e for e in ("a", "el", "ion", "ato", "en") for a in ("", "s", "t", "l")]
    rows, labels = [], []
    for d in range(n):
        bad = d % 4 == 0
        w = [r.choice(common) for _ in range(r.randint(20, 80))]
        if bad:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(rude)
        rows.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = table()
    docs = spark.createDataFrame([*rows, (9001, "grubissimo wab grubola"), (9002, None), (9003, "!!"), (None, "wab")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 3)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, lab).collect()}
    truth = dict(labels)
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out == (d in held) for d in truth)
    assert sum(got[d].predicted == truth[d] for d in held) / len(held) > 0.97
    assert got[9001].predicted == 1 and got[9002].predicted == got[9003].predicted == 0
    kept = {r.doc_id for r in without_toxic(docs, lab).collect()}
    assert kept == {d for d, r in got.items() if not r.predicted}


def test_without_labels(spark):
    rows, _ = table(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, none).collect()} == {0.0}
    assert without_toxic(docs, none).count() == 8 and toxicity(docs.limit(0), none).count() == 0


def model(rows, corpus):
    """Log of p(word after another), p(word) of one class, each from its definition."""
    triples = {t for _, text in rows for w in [words(text)] for t in zip([b"", b"", *w], [b"", *w], w, strict=False)}
    pairs = Counter((v, w) for _, v, w in triples)
    lefts = Counter(w for _, w in pairs)
    stems = Counter(w[:4] for w in lefts)
    tokens = Counter(w[:4] for _, text in corpus for w in words(text))
    shared = Counter(w[:4] for w in {w for _, text in corpus for w in words(text)})
    after = defaultdict(list)
    for (v, _), n in pairs.items():
        after[v].append(n)
    d = tox.DISCOUNT

    def p_stem(s):
        base = (tokens[s] + 1) / (tokens.total() + len(shared) + 1)
        return (max(stems[s] - d, 0) + d * len(stems) * base) / len(lefts)

    def p_word(w):
        return (max(lefts[w] - d, 0) + d * len(lefts) * p_stem(w[:4]) / (shared[w[:4]] + 1)) / sum(lefts.values())

    def p_pair(v, w):
        return (max(pairs[v, w] - d, 0) + d * len(after[v]) * p_word(w)) / sum(after[v]) if after[v] else p_word(w)

    return p_word, p_pair, lefts, pairs


def test_weights_against_the_definition(spark):
    rows, labels = table(400)
    rows = [(d, t + (" vile grub" if d % 4 == 0 else " fine grub")) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    seen = {y: [r for r, (d, x) in zip(rows, labels, strict=True) if x == y and zlib.crc32(str(d).encode()) % 3 != 1] for y in (0, 1)}
    ordinary, toxic = model(seen[0], rows), model(seen[1], rows)
    cut = lambda x: math.copysign(max(0.0, abs(x) - 2.0), x)
    vocabulary = {w for _, t in rows for w in words(t)}
    for w in vocabulary:
        if ordinary[2][w] + toxic[2][w] >= tox.LEAST:
            assert scorer.of_word[w] == pytest.approx(cut(math.log(toxic[0](w) / ordinary[0](w))))
        else:
            assert w not in scorer.of_word
    assert scorer.of_word[b"grubel"] > 2
    for (v, w), more in scorer.of_pair.items():
        assert more + scorer.of_word.get(w, scorer.of_stem.get(w[:4], 0.0)) == pytest.approx(cut(math.log(toxic[1](v, w) / ordinary[1](v, w))))
    # "grub" is neither toxic nor ordinary, "vile grub" is toxic
    assert scorer.of_pair[b"vile", b"grub"] > 0 and b"grub" not in scorer.of_word


def test_long_texts_and_clashing_columns(spark):
    rows, labels = table(600)
    docs = spark.createDataFrame([(*r, "x", 1.0, b"w") for r in [*rows, (7000, "wab " * 400_000), (7001, None)]], "doc_id long, text string, stem string, score double, word binary")
    kept = without_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert len(got[7000].text) == 1_600_000 and got[7001].text is None and got[7001].word == b"w"
