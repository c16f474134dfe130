import math
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from quire.llm.sentencepiece import SPACE, Segmenter, decoded, encodings, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a ", "the cats", "a\n\tb  c\n\n d", "Ünïcode 日本語 \U0001f600 ﬁ\x00", "x" * 3000, "word " * 2000, "of\n", "\n", "a\nb c", "\n\nx y\n z"]


def segment(texts, seeds, k):
    return Segmenter(vocabulary(PATH), 1.0)(texts, np.array(seeds, np.uint64), k)[1]


def ways(text):
    """All segmentations of a text with their log-probabilities."""
    v = vocabulary(PATH)
    t = (SPACE + text).replace(" ", SPACE) if text else ""
    found = {}

    def go(at, ids, log):
        if at == len(t):
            found[tuple(ids)] = log
        for end in range(at + 1, len(t) + 1):
            i = v.model.piece_to_id(t[at:end])
            if i and not v.model.is_byte(i):
                go(end, [*ids, i], log + v.log[i])
            elif end == at + 1:
                b = [int(v.byte[x]) for x in t[at].encode()]
                go(end, [*ids, *b], log + len(b) * v.byte_log)

    go(0, [], 0.0)
    z = math.log(sum(map(math.exp, found.values())))
    return {k: x - z for k, x in found.items()}


def test_encoding_is_the_models_and_round_trips(spark):
    sp = SentencePieceProcessor(model_file=PATH)
    r = random.Random(1)
    more = ["".join(r.choice("ab e\nth\téŽ日.,0") for _ in range(r.randint(1, 90))) for _ in range(300)]
    rows = list(enumerate([*TEXTS, *more]))
    docs = spark.createDataFrame([(*x, 7, "x") for x in rows], "doc_id long, text string, ids int, rank string")
    got = decoded(encodings(docs, PATH, 4), PATH).collect()
    once = encodings(docs, PATH, 4, decode=True).collect()
    assert sorted((x.doc_id, x.rank, x.text) for x in once) == sorted((x.doc_id, x["rank"], x.text) for x in got)
    for x in got:
        assert x.text == rows[x.doc_id][1]
        if x.rank == 0:
            assert x.ids == sp.encode(rows[x.doc_id][1]) and x.log_prob is None
    for d, t in rows:
        own = sorted((x for x in got if x.doc_id == d and x.rank), key=lambda x: x.rank)
        assert len({tuple(x.ids) for x in own}) == len(own) >= 1
        assert all(a.perturbed > b.perturbed for a, b in zip(own, own[1:], strict=False))
        assert len(own) == 4 or len(own) == len(ways(t))


@pytest.mark.parametrize("text", ["cat", "a b", "é日", "the\nof"])
def test_log_probabilities_are_those_of_brute_force(text):
    every = ways(text)
    k = len(every) + 2
    got = segment([text] * 3, [1, 2, 3], k)
    for own in got:
        assert {tuple(x[0].tolist()) for x in own} == set(every)
        for ids, log, _, inclusion in own:
            assert abs(log - every[tuple(ids.tolist())]) < 1e-9 and inclusion == 0


def test_samples_follow_the_distribution_without_replacement():
    text, n = "tin", 20000
    every = ways(text)
    p = {k: math.exp(x) for k, x in every.items()}
    got = segment([text] * n, np.arange(n) * 7919 + 5, 2)
    first, pair, estimate = dict.fromkeys(p, 0), dict.fromkeys(p, 0), 0.0
    for own in got:
        a, b = (tuple(x[0].tolist()) for x in own)
        first[a] += 1
        pair[b] += 1
        # inverse inclusion scores make unbiased estimates: here of the sum of all probabilities
        estimate += sum(math.exp(x[1] - x[3]) for x in own) / n
    for a in p:
        second = sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)
        for have, want in ((first[a] / n, p[a]), (pair[a] / n, second)):
            assert abs(have - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-4
    assert abs(estimate - 1) < 0.03


def test_seeded_by_key_whatever_the_batch():
    data = ["some words here", "other ones", "some words here"]
    many = segment(data, [5, 6, 7], 3)
    kept = Segmenter(vocabulary(PATH), 1.0, 5)
    for i, t in enumerate(data):
        for alone in (segment([t], [5 + i], 3)[0], kept([t], np.array([5 + i], np.uint64), 3)[1][0]):
            assert [(x[0].tolist(), *x[1:]) for x in alone] == [(x[0].tolist(), *x[1:]) for x in many[i]]


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    got = encodings(docs, PATH, 2).collect()
    assert sum(x.rank == 0 for x in got) == 5
    empty = [x for x in got if not x.ids]
    assert len(empty) == 4 and all(x.log_inclusion in (None, 0.0) for x in empty)
    twice = [tuple(x.ids) for x in got if x.doc_id == 1 and x.rank == 1 and x.ids]
    assert len(twice) == 2 and len(set(twice)) == 1
    assert encodings(docs.limit(0), PATH).count() == 0
    assert decoded(encodings(docs.limit(0), PATH), PATH).count() == 0
    odd = decoded(spark.createDataFrame([(1, [3 + 255, 1]), (2, None)], "doc_id long, ids array<int>"), PATH)
    assert [x.text for x in odd.orderBy("doc_id").collect()] == ["�", ""]
