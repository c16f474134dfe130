import hashlib
import re
import zlib

import numpy as np
import pytest

from quire.llm.exact_dedup import LsmIndex, exact_duplicates, sha256
from quire.llm.packing import WordTokenizer, first_fit_decreasing, pack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["a b", "a  b", " a b", None, "", "\n", "\t \t", "x" * 5000, "a b", "Ünï cödé 日本", "a b", "Don't 3x <|endoftext|>é ½ Σας"]


def reference(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm, strict=True):
        ids = [x for (x, _), m in zip(rows, norm, strict=True) if m == n]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [sha256, lambda t: sha256(t)[:1] and bytes([sha256(t)[0] & 1])])
def test_exact(spark, digest):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(3, "a b"), (None, "a b"), (None, "only")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, digest string, keep_id int")
    got = [tuple(r) for r in exact_duplicates(docs, digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == reference(rows)
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_lsm_runs_and_filters(tmp_path):
    index = LsmIndex(str(tmp_path), 500)
    for i in range(50):
        index.add(sha256(bytes([i % 10])), bytes([i % 10]), i)
    assert len(index.runs) > 3 and index.seen(sha256(b"\x03")) and not index.seen(sha256(b"no"))
    got = {t: (d, n) for _, t, d, n in index.compact()}
    assert got == {bytes([i]): (i, 5) for i in range(10)}


def test_tokens_equal_the_tokenizer_on_whole_texts():
    tok = WordTokenizer(PATH, limit=3)
    texts = [t or "" for t in TEXTS] + ["it's 3DON'T I'LLx éÀß µ ×÷", "ΟΔΟΣ İ x́ \x1c z\x85q", "''s''t x'sy", "A,b. C!! \x01 \x01"]
    for _ in range(2):
        for t, ids in zip(texts, tok.batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.full.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    rows = [(i, (t or "") * (1 + i * 40) if t is not None else None) for i, t in enumerate(TEXTS)] + [(2, "again"), (None, "x y")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, group_docs=5).toPandas()
    tok = WordTokenizer(PATH)
    expected = sorted((-1 if d is None else d, zlib.crc32(ids + b"\x01\0\0\0"), len(ids) // 4 + 1) for (d, _), ids in zip(rows, tok.batch([t or "" for _, t in rows]), strict=True) if len(ids) // 4 < 2048)
    single = got[got.length == got.doc_tokens]
    assert sorted(zip(single.doc_id.fillna(-1).astype(int), single.ids_crc32, single.length, strict=True)) == expected
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    sizes = np.random.default_rng(1).integers(1, 100, 300)
    bins, offsets = first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= sizes[i]
