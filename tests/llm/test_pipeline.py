import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp
from quire.llm.packing import WordTokenizer
from quire.llm.toxicity import toxicity
from test_secret import base
from test_toxicity import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def corpus():
    r = random.Random(12)
    rows, labels = table(300)
    words = [f"v{i}" for i in range(4000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    more = []
    for d in range(30):
        text = some(r.choice([6, 60, 200]))
        edit = list(text)
        for _ in range(r.randint(0, 8)):
            edit[r.randrange(len(edit))] = r.choice(words)
        more += [(1000 + d, " ".join(text)), (2000 + d, " ".join(edit)), (3000 + d, " ".join(text + some(len(text) // 6)))]
    copy = more[4][1]
    more += [(4000, copy), (4000, "wholly different words stand here"), (1, "same"), (4001, "same"), (4001, "another text of it"), (None, copy), (None, "alone"), (None, "alone"), (5000, None), (5001, ""), (5002, " \t ")]
    more += [(6000, "his token=abcdef123456 leaked"), (6001, "a\nlong " + "text " * 9000), (6002, "a\n\nlong  " + "text " * 9000), more[7]]
    rows = [*rows, *more]
    r.shuffle(rows)
    return [(d, t, "en", "web", None if t is None else len(t)) for d, t in rows], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = corpus()
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def ordered(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def first(rows):
    """The row of the smallest doc_id, where null is the largest."""
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


def exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(SPACE.sub(" ", r[1] or ""), []).append(r)
    return groups


def shingles(text):
    w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def near(rows):
    """Components of rows at exact similarity of 0.8 or more, all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return list(groups.values())


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows, got = docs.collect(), {}
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, tables))
        got[name] = docs.collect()
    bad = {(r.doc_id, r.score) for r in toxicity(spark.read.parquet(f"{tables}/documents.parquet"), labels).where("predicted = 1").collect()}
    assert len(bad) > 60
    assert ordered(got["toxicity"]) == ordered(r for r in rows if r.doc_id not in {d for d, _ in bad})
    kept = got["exact_dedup"]
    groups = exact(got["toxicity"])
    assert len(kept) == len(groups)
    assert sorted(str((r.doc_id, SPACE.sub(" ", r.text or ""))) for r in kept) == sorted(str((first(g)[0], t)) for t, g in groups.items())
    assert {r.text for r in kept if r.doc_id == 4001} == {"another text of it"} and {r.text for r in kept if r.doc_id == 4000} == {"wholly different words stand here"}
    classes = near(kept)
    assert ordered(got["simhash_near_dedup"]) == ordered(first(c) for c in classes) and len(classes) < len(kept) - 20
    mark = {r.doc_id: r for r in got["secret_scan"]}
    assert mark[6000].text == "his [SECRET] leaked" and mark[6000].n_chars == len(mark[6000].text)
    clean = [r for r in got["simhash_near_dedup"] if not base(r.text)[4]]
    assert len(clean) == len(got["simhash_near_dedup"]) - 1 and set(ordered(clean)) <= set(ordered(got["secret_scan"]))
    tok, expected = WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    for r in got["secret_scan"]:
        ids = np.array([*tok.full.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(r.doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in got["packing"])
    assert max(r.doc_tokens for r in got["packing"]) > 4096
    assert sorted(str(tuple(r)[:5]) for r in cp.run(spark, tables).collect()) == sorted(map(str, expected))


def test_stages_of_empty_and_odd_tables(spark, tables):
    empty = spark.createDataFrame([], SCHEMA + ", digest string, node int, blob string, found int, g int")
    odd = spark.createDataFrame([(d, t, "x", "y", None, "d", 1, "b", 2, 3) for d, t in [(None, None), (None, None), (3, None), (2, "token=abcdef12"), (2, "token=abcdef12"), (1, " ")]], empty.schema)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, tables).count() == 0
        out = stage(spark, odd, tables)
        if name != "packing":
            assert out.columns == odd.columns
    assert ordered(cp.exact_dedup(spark, odd, tables).collect()) == ordered([(1, " "), (2, "token=abcdef12"), (3, None)])
