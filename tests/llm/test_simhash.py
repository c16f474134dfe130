import random

import numpy as np
import xxhash

from quire.llm import simhash
from quire.llm.components import components
from quire.llm.simhash import links, near_duplicate_groups, set_forest, simhash_groups


def reference(rows):
    fps = {}
    for i, (d, t) in enumerate(rows):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()]
        s = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_groups_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for d in range(60):
        base = [r.choice("abcdefghij") * r.randint(1, 4) for _ in range(r.choice([0, 1, 2, 3, 200, 400]))]
        rows.append((d * 3, " ".join(base)))
        for c in range(r.randint(0, 2)):
            edit = list(base)
            for _ in range(min(len(edit), c + 1)):
                edit[r.randrange(len(edit))] = "Zed"
            rows.append((1000 + d * 3 + c, "\n".join(edit)))
    rows += [(7, None), (None, None), (8, " \t"), rows[4], (None, "lonely words here É")]
    docs = spark.createDataFrame([(*x, 0, 1) for x in rows], "doc_id long, text string, fp int, node int")
    got = [tuple(x) for x in simhash_groups(docs).collect()]
    assert sorted(got, key=str) == reference(rows)


def test_links_connect_all_close_pairs_in_wide_groups(spark):
    r = random.Random(9)
    fps = {r.getrandbits(20) | 7 << 60 for _ in range(300)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, 0, f) for f in fps], "node long, fam int, fp long")
    got = {x.node: x.root for x in components(links(df, whole=20)).collect()}
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                    root[a] = min(root[a], root[b])
        if all(root[a] == root[b] for a in fps for b in fps if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3):
            break
    assert all(got.get(f, f) == root[f] for f in fps)


def test_no_table_goes_through_the_driver(spark, tmp_path):
    """Keys are ten rows of each fingerprint, which estimates of size don't count."""
    spark.createDataFrame([(f, 0, f) for f in range(2000)], "node long, fam int, fp long").write.parquet(f"{tmp_path}/fps")
    found = links(spark.read.parquet(f"{tmp_path}/fps"))
    assert found.count() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(d, f"some words and {d}") for d in range(50)], "doc_id long, text string")
    out = simhash_groups(docs)
    assert out.count() == 50 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, near = [], {}
    for d in range(40):
        base = [r.choice(words) for _ in range(300)]
        rows.append((d, " ".join(base)))
        edit = list(base)
        for _ in range(3):
            edit[r.randrange(300)] = "changed"
        rows.append((100 + d, " ".join(edit)))
        near[100 + d] = d
    rows += [(500, None), (None, "x"), (501, ""), (502, "one two")]
    got = {x.doc_id: x.component_id for x in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None] is None
    assert all(got[d] == d for d in range(40)) and got[502] == 502 and got[501] == 500
    assert sum(got[a] == b for a, b in near.items()) >= 38


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(docs).count() == near_duplicate_groups(docs).count() == 0


def test_near_duplicates_edited_in_one_place(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows, near = [], {}
    for d in range(60):
        base = some(400)
        rows.append((d, " ".join(base)))
        edits = {1000: base + some(80), 2000: base[:340], 3000: base[:150] + some(32) + base[182:], 4000: some(70) + base}
        for at, edit in edits.items():
            rows.append((at + d, " ".join(edit)))
            near[at + d] = d
    got = {x.doc_id: x.component_id for x in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d in range(60)} | near


def test_near_duplicates_link_at_exact_similarity_alone(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(404)]
    # of 400 shingles the first 320 are all that is left in one, 319 in another; both are in the first's text
    rows = [(0, " ".join(base)), (10, " ".join(base[:324])), (30, "a b c d e"), (31, "A b\nc d e"), (32, "a b c d f")]
    other = [r.choice(words) for _ in range(404)]
    rows += [(20, " ".join(other)), (21, " ".join(other[:323]))]
    # two texts under 0.8 of each other that a third in between links
    line = [r.choice(words) for _ in range(504)]
    rows += [(40, " ".join(line[:424])), (41, " ".join(line[40:464])), (42, " ".join(line[80:504]))]
    got = {x.doc_id: x.component_id for x in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 10: 0, 20: 20, 21: 21, 30: 30, 31: 30, 32: 32, 40: 40, 41: 40, 42: 40}


def test_fingerprints_propose_near_duplicates(spark, monkeypatch):
    """Without any band keys, pairs whose fingerprints link are found; they too are held against similarity 0.8."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows, bits = [], {}
    for d in range(40):
        base = [r.choice(words) for _ in range(400)]
        edit = [*base[:-1], "last"]
        rows += [(d, " ".join(base)), (100 + d, " ".join(edit))]
        bits[d] = (simhash.fingerprint(rows[-2][1].encode()) ^ simhash.fingerprint(rows[-1][1].encode())) & (1 << 64) - 1
    close = {d for d, x in bits.items() if x.bit_count() <= 3}
    # one shingle of three words that repeats rules the fingerprint of both, but most of their sets differs
    many = " ".join(["a b c"] * 300)
    rows += [(500, many + " " + " ".join(words[:40])), (501, many + " " + " ".join(words[40:80]))]
    assert len(close) > 20 and ((simhash.fingerprint(rows[-2][1].encode()) ^ simhash.fingerprint(rows[-1][1].encode())) & (1 << 64) - 1).bit_count() <= 3
    for name in ("stars", "apart"):
        monkeypatch.setattr(simhash, name, lambda rows, f=getattr(simhash, name): f(rows.limit(0)))
    got = {x.doc_id: x.component_id for x in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d in range(40) if got[100 + d] == d} == close and got[501] == 501


def test_forest_connects_what_exact_pairs_connect():
    r = random.Random(6)
    base = np.array(sorted(r.sample(range(10_000), 60)), np.uint64)
    sets = []
    for _ in range(80):
        drop = set(r.sample(range(60), r.choice([2, 5, 9, 20])))
        sets.append(np.unique(np.append(base[[i for i in range(60) if i not in drop]], np.array(r.sample(range(10_000, 20_000), r.choice([0, 3, 8])), np.uint64))))
    root = np.array([r.choice([i, 0, 1]) for i in range(80)])

    def classes(pairs):
        up = list(range(80))
        for a, b in [*pairs, *((i, j) for i in range(80) for j in range(i) if root[i] == root[j])]:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        out = []
        for i in range(80):
            while up[i] != i:
                i = up[i]
            out.append(i)
        return out

    close = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
    every = [(i, j) for i in range(80) for j in range(i) if close(i, j)]
    made = set_forest(sets, root)
    assert all(close(i, j) for i, j in made) and classes(made) == classes(every) and len(made) < 80
