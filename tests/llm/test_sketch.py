import hashlib
import random
import re

import pytest
import xxhash

from pyspark.sql import functions as F

from quire.llm import sketch_fingerprint as sf
from quire.llm.sketch_fingerprint import fingerprints, likeness_of


def pieces(t):
    """Runs of words, each up to one that its hash chooses; words over 64 letters in runs of letters."""
    units = []
    for w in filter(None, re.split(r"[ \t\n\x0b\f\r]+", t)):
        units += [*w, " "] if len(w) > 64 else [w + " "]
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    hashes = [h - (1 << 64) if h >> 63 else h for h in hashes]
    out, run = set(), ""
    for i, u in enumerate(units):
        run += u
        one = 8 if i < 128 else 16 if i < 512 else 32
        least = all(hashes[i] < h for h in hashes[max(0, i - 2) : i]) and all(hashes[i] <= h for h in hashes[i + 1 : i + 3])
        if least if i < 32 else hashes[i] % one == 0:
            out.add(run.strip(" "))
            run = ""
    return (out | {run.strip(" ")}) - {""}


def jaccard(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("n", [1, 2, 60])
def test_against_brute_force(spark, n):
    r = random.Random(n)
    word = ["one", "two", "é", "日本", "five.", "six,", "sev\n", "\U0001f600"]
    rows = [(d * 7 - 50, None if d == 5 else " ".join(r.choice(word) + r.choice(["", str(r.randint(0, 99))]) for _ in range(r.choice([0, 1, 2, 5, 30, 200, 900, 3000])))) for d in range(n)]
    if n > 2:
        rows[9] = (rows[9][0], rows[8][1])
    docs = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, o int, b string")
    got = {x.doc_id: x for x in fingerprints(docs).collect()}
    assert len(got) == n
    order = sorted(rows, reverse=True)
    for (d, t), (_, z) in zip(order, [*order[1:], order[0]], strict=True):
        t, z = t or "", z or ""
        f = len(t) // 3
        e = t[: len(t) - f] + z[:f]
        x = got[d]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(x.near_edited - jaccard(t, e)) < 1e-12 and abs(x.near_next - jaccard(t, z)) < 1e-12
        assert (x.fingerprint == x.edited_fingerprint) == (pieces(t) == pieces(e))
    # the numbers come from the published texts alone
    ids = [d for d, _ in order]
    pairs = [(f"e{d}", got[d].fingerprint, got[d].edited_fingerprint) for d in ids] + [(f"n{d}", got[d].fingerprint, got[z].fingerprint) for d, z in zip(ids, [*ids[1:], ids[0]], strict=True)]
    near = {x.id: x.near for x in likeness_of(spark.createDataFrame(pairs, "id string, a string, b string")).collect()}
    assert all(near[f"e{d}"] == pytest.approx(got[d].near_edited) and near[f"n{d}"] == pytest.approx(got[d].near_next) for d in ids)
    if n > 2:
        assert got[rows[9][0]].fingerprint == got[rows[8][0]].fingerprint


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)], "doc_id long, text string")
    assert fingerprints(docs).count() == 5
    assert fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sep", [" ", ""])
def test_long_texts_without_punctuation(spark, sep):
    r = random.Random(7)
    unit = [f"w{i}" for i in range(900)] if sep else [chr(0x4E00 + i) for i in range(900)]
    a = [r.choice(unit) for _ in range(1200)]
    b = list(a)
    b[600] = unit[0]
    rows = [(3, sep.join(a)), (2, sep.join(b)), (1, sep.join(r.choice(unit) for _ in range(1200)))]
    got = {x.doc_id: x for x in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].near_next > 0.9 and got[2].near_next < 0.2
    assert all(0.3 < got[d].near_edited < 1 for d in (2, 1))


def test_no_length_is_cut_otherwise(spark):
    """Versions on either side of any length share what they share; no punctuation is needed."""
    r, rows, lengths = random.Random(5), [], [120, 200, 255, 256, 257, 279, 409]
    for i, length in enumerate(lengths):
        text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(200))[:length]
        rows += [(10 * i + 3, text), (10 * i + 2, text + " and seventeen more"), (10 * i + 1, text[: 2 * length // 3]), (10 * i, "short")]
    got = {x.doc_id: x for x in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in enumerate(lengths):
        assert got[10 * i + 3].near_next > 0.5 and got[10 * i + 2].near_next > 0.3 and 0.2 < got[10 * i + 1].near_edited < 1 and got[10 * i].near_next < 0.1


def test_sketches_that_fail_go_again_larger(spark, monkeypatch):
    monkeypatch.setattr(sf, "size_for", lambda n: F.lit(4))
    r = random.Random(2)
    rows = [(d, " ".join(str(r.randint(0, 9999)) for _ in range(r.choice([3, 60, 300])))) for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = sf.likeness(sf.dealt(docs)[0]).collect()
    assert len(first) == 24 and not all(x.clean for x in first)
    got = {x.doc_id: x for x in fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    for (d, t), (_, z) in zip(order, [*order[1:], order[0]], strict=True):
        assert got[d].near_next == pytest.approx(jaccard(t, z))


def test_texts_are_cut_once(spark, monkeypatch):
    """Likeness and published sketches are made of the same digests: own ones and those of the edited text, once each."""
    asked = []
    plain = sf.digests
    monkeypatch.setattr(sf, "digests", lambda text: asked.append(1) or plain(text))
    docs = spark.createDataFrame([(d, f"some {d} words, and more of them {d % 3}\x0b\f ") for d in range(20)], "doc_id long, text string")
    assert fingerprints(docs).count() == 20 and len(asked) == 2


def test_half_of_the_rows_without_doc_id(spark):
    rows = [(None if i % 2 else i, f"text number {i} of many") for i in range(300)] + [(None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sf.with_next(sf.dealt(docs)[0])
    spread = found.where("doc_id is null").groupBy("r").count().collect()
    assert len(spread) >= 4 and sum(x["count"] for x in spread) == 155
    texts = [t or "" for _, t in rows]
    assert sorted(x.next_text for x in found.collect()) == sorted(texts)  # a ring: each row is one row's next
    assert fingerprints(docs).count() == 305


def test_very_long_text_and_clashing_columns(spark):
    r = random.Random(1)
    long = " ".join(str(r.randint(0, 10**6)) for _ in range(60_000))
    docs = spark.createDataFrame([(2, long, 1, "x"), (1, long + " tail", 2, "y")], "doc_id long, text string, r int, near string")
    got = {x.doc_id: x for x in fingerprints(docs).collect()}
    assert got[2].near_next > 0.99 and 0.4 < got[2].near_edited < 1
