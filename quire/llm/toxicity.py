"""Toxicity by class-conditional Kneser-Ney models of word pairs, words and stems.

All counts are continuation counts, so that copies of a passage count once: a pair of words counts by the different
words before it, a word by those before it, a stem (a word's first letters) by its different words. Each class gives a
word after another its discounted count; what the discount frees goes to the word, what that frees to the word's
stem, and what that frees to shared counts: of how many tokens of the whole corpus the stem is. A rare inflection of an expression thus takes the odds of its stem, and one that
neither class knows takes none. A text's evidence is the log-likelihood ratio of its words, normalised by length; a
logistic curve fitted to the labelled rows makes it a score.

Evidence of a word that is within DEAD of zero counts as none: invented and rare words are most of a vocabulary, and
the sum of their chance ratios hides that of the few words that matter (figures are in the README).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, release, slices, texts

STEM = 4
DISCOUNT = 0.75
#: Log-likelihood ratios within it count as zero.
DEAD = 2.0
#: Words (pairs) seen after fewer words in the sample have the ratio of what they back off to.
LEAST, LEAST_PAIRS = 3, 10
#: Texts with more characters aren't fitted on; all are scored.
FIT_CHARS = 100_000
#: ASCII letters in lower case, bytes of other letters as they are, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()


def stem(word: bytes) -> bytes:
    return word[:STEM]


def shrunk(x: float, dead: float = DEAD) -> float:
    return math.copysign(max(0.0, abs(x) - dead), x)


@dataclass
class Counts:
    """Of one class. lefts: different words before a word; stems: different words of a stem; pairs: different words
    before a pair; after: by a word, the sum of the pairs that it begins, and their number. The sums are of all words, the
    tables may lack rare ones."""

    sum_lefts: int
    types: int
    lefts: dict[bytes, int]
    stems: dict[bytes, int]
    after: dict[bytes, tuple[int, int]]
    pairs: dict[tuple[bytes, bytes], int]


@dataclass
class Shared:
    """Of the corpus: tokens and different words by stem; tokens and different stems in all."""

    stems: dict[bytes, tuple[int, int]]
    tokens: int
    n_stems: int


def stem_share(c: Counts, shared: Shared, s: bytes) -> float:
    """Probability that a word of the class that backs off begins with the stem."""
    types = max(1, c.types)
    base = (shared.stems.get(s, (0, 0))[0] + 1) / (shared.tokens + shared.n_stems + 1)
    return max(c.stems.get(s, 0) - DISCOUNT, 0) / types + DISCOUNT * max(1, len(c.stems)) / types * base


def word_share(c: Counts, shared: Shared, w: bytes) -> float:
    """Probability of a word by its continuation counts; a stem's words share its probability evenly."""
    s, total = stem(w), max(1, c.sum_lefts)
    return max(c.lefts.get(w, 0) - DISCOUNT, 0) / total + DISCOUNT * max(1, c.types) / total * stem_share(c, shared, s) / (shared.stems.get(s, (0, 0))[1] + 1)


def pair_share(c: Counts, shared: Shared, v: bytes, w: bytes) -> float:
    """Probability of a word after another."""
    n, types = c.after.get(v, (0, 0))
    lower = word_share(c, shared, w)
    return max(c.pairs.get((v, w), 0) - DISCOUNT, 0) / n + DISCOUNT * types / n * lower if n else lower


def weights(ordinary: Counts, toxic: Counts, shared: Shared, least: int = LEAST) -> tuple[dict, dict, dict]:
    """Log-likelihood ratios of words, of the stems of words that no class has seen, and what pairs add to their second word's."""

    def ratio(share, *x: bytes) -> float:
        return shrunk(math.log(share(toxic, shared, *x) / share(ordinary, shared, *x)))

    free = math.log((toxic.types / max(1, toxic.sum_lefts)) / (ordinary.types / max(1, ordinary.sum_lefts)))  # of words backing off
    known = set(ordinary.stems) | set(toxic.stems)
    of_stem = {s: shrunk(free + math.log(stem_share(toxic, shared, s) / stem_share(ordinary, shared, s))) for s in known if ordinary.stems.get(s, 0) + toxic.stems.get(s, 0) >= least}
    of_word = {w: ratio(word_share, w) for w in set(ordinary.lefts) | set(toxic.lefts) if ordinary.lefts.get(w, 0) + toxic.lefts.get(w, 0) >= least}
    of_pair = {}
    for v, w in set(ordinary.pairs) | set(toxic.pairs):
        more = ratio(pair_share, v, w) - of_word.get(w, of_stem.get(stem(w), 0.0))
        if more:
            of_pair[v, w] = more
    return of_word, of_stem, of_pair


class Scorer:
    """Weighs texts; what it knows of words is kept in a bounded store."""

    def __init__(self, of_word: dict, of_stem: dict, of_pair: dict, curve: tuple[float, float, float] = (0, 0, 0)) -> None:
        self.of_word, self.of_stem, self.of_pair, self.curve = of_word, of_stem, of_pair, curve
        self.known: dict[bytes, float] = {}

    def evidence(self, text: str) -> tuple[float, float]:
        """The log-likelihood ratio by word, and by the root of the number of words."""
        found = words(text)
        if not found:
            return 0.0, 0.0
        known = self.known
        if len(known) > 100_000:
            known.clear()
        try:
            total = sum(map(known.__getitem__, found))
        except KeyError:
            for w in found:
                if w not in known:
                    x = self.of_word.get(w)
                    known[w] = self.of_stem.get(stem(w), 0.0) if x is None else x
            total = sum(map(known.__getitem__, found))
        if self.of_pair:
            total += sum(map(self.of_pair.get, zip(found, found[1:], strict=False), repeat(0.0)))
        return total / len(found), total / math.sqrt(len(found))

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.evidence(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x + c * y))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Intercept and slopes of two inputs, by Newton's method."""
    scale = np.abs(x).max(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.diag([1e-3, 1, 1]) / 10, z.T @ (y - p) - ridge * len(x) / 10 * np.array([1e-3, 1, 1]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale[0]), float(w[2] / scale[1])


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


WORD = "word binary, n long"
TRIPLE = "toxic int, half int, first binary, before binary, word binary"


def _words_of(batches):
    """Counts the words of texts, some at a time."""
    names = [("word", pa.binary()), ("n", pa.int64())]
    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(words(text))
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip((found.keys(), found.values()), names, strict=True)], schema=pa.schema(names))
                found.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip((found.keys(), found.values()), names, strict=True)], schema=pa.schema(names))


def _triples_of(batches):
    """The different triples of words in toxic, half, text; a text's first two words follow nothing."""
    schema = pa.schema([("toxic", pa.int32()), ("half", pa.int32()), ("first", pa.binary()), ("before", pa.binary()), ("word", pa.binary())])
    found: set = set()

    def rows():
        columns = zip(*found, strict=True) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = words(text)
            found.update(zip(repeat(toxic), repeat(half), [b"", b"", *w], [b"", *w], w, strict=False))
            if len(found) > 50_000:
                yield rows()
                found.clear()
    yield rows()


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 4000, ordinary_rows: int = 8000, least: int = LEAST) -> Scorer | None:
    """The scorer of labelled rows outside the held-out third; None unless both labels occur there.

    The classes' counts are of at most toxic_rows and ordinary_rows labelled rows of at most FIT_CHARS characters, those
    with the smallest hashes of doc_id; the shared counts are of the words of all docs, counted as a table.
    The curve is fitted on half of the sample by the weights of the other.
    """
    docs = texts(docs)
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.where(~held_out(F.col("doc_id"))).withColumn("half", (F.xxhash64("doc_id", F.lit(7)) % 2 == 0).cast("int"))
    picks = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, ordinary_rows), (1, toxic_rows))]
    fit = docs.where(F.length("text") <= FIT_CHARS)
    sample = materialize(fit.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").select("toxic", "half", "text"))  # at most as many rows as the two bounds
    cases = {f"{'all' if h is None else 'half'}{y}": (F.col("toxic") == y) & (F.lit(True) if h is None else F.col("half") == h) for h in (None, 0) for y in (0, 1)}
    found = sample.select("toxic", "half", "text").mapInArrow(_triples_of, TRIPLE)
    by_triple = found.groupBy("first", "before", "word").agg(*[F.max(c.cast("long")).alias(name) for name, c in cases.items()])
    by_pair = materialize(by_triple.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in cases]))
    seen = {c: (F.col(c) > 0).cast("long") for c in cases}
    by_word = materialize(by_pair.groupBy("word").agg(*[F.sum(seen[c]).alias(c) for c in cases]))
    sums = by_word.agg(*[F.sum(c).alias(c) for c in cases], *[F.sum(seen[c]).alias(f"types_{c}") for c in cases]).first()
    if not sums["all0"] or not sums["all1"]:
        release(sample, by_pair, by_word)
        return None
    of_stem = F.substring("word", 1, STEM).alias("stem")
    corpus = materialize(docs.select("text").mapInArrow(_words_of, WORD).groupBy("word").agg(F.sum("n").alias("n")).groupBy(of_stem).agg(F.sum("n").alias("tokens"), F.count("*").alias("forms")))
    whole = corpus.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    # the tables that follow are of the sample's stems, words and pairs alone
    stems = by_word.groupBy(of_stem).agg(*[F.sum(seen[c]).alias(c) for c in cases]).join(corpus, "stem", "left").collect()
    often = by_word.where(f"all0 + all1 >= {least}").collect()
    # a pair that both classes have about as often behind its first word can't leave the dead zone
    after = by_pair.groupBy("before").agg(*[f(x).alias(f"{n}_{c}") for c in cases for n, f, x in (("n", F.sum, F.col(c)), ("types", F.sum, seen[c]))])
    lopsided = F.abs(F.log((F.col("all1") + 1) / (F.col("n_all1") + 1)) - F.log((F.col("all0") + 1) / (F.col("n_all0") + 1))) > DEAD / 2
    pairs = by_pair.where(f"all0 + all1 >= {LEAST_PAIRS}").join(after, "before").where(lopsided | F.expr("n_all0 = 0 or n_all1 = 0"))
    pairs = pairs.join(by_word.select("word", *[F.col(c).alias(f"left_{c}") for c in cases]), "word").collect()
    shared = Shared({bytes(r["stem"]): (r["tokens"] or 0, r["forms"] or 0) for r in stems}, *whole)

    def of(case: str) -> Counts:
        return Counts(
            sums[case], sums[f"types_{case}"], {bytes(r["word"]): r[c] for rows, c in ((often, case), (pairs, f"left_{case}")) for r in rows if r[c]}, {bytes(r["stem"]): r[case] for r in stems if r[case]},
            {bytes(r["before"]): (r[f"n_{case}"], r[f"types_{case}"]) for r in pairs}, {(bytes(r["before"]), bytes(r["word"])): r[case] for r in pairs if r[case]},
        )

    half = Scorer(*weights(of("half0"), of("half1"), shared, least))

    def evidence(batches):
        for batch in batches:
            found = [half.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64())], names=["toxic", "x", "y"])

    curve = (0.0, 0.0, 0.0)
    if sums["half0"] and sums["half1"]:
        judged = sample.where("half = 1").select("toxic", "text").mapInArrow(evidence, "toxic int, x double, y double").collect()
        if {r["toxic"] for r in judged} == {0, 1}:
            curve = logistic(np.array([(r["x"], r["y"]) for r in judged]), np.array([r["toxic"] for r in judged], float))
    release(by_word, by_pair, corpus, sample)
    return Scorer(*weights(of("all0"), of("all1"), shared, least), curve)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs.

    A null text is empty, and an empty text has no evidence either way. Labels that are null or neither 0 nor 1 are
    left out; of several labels of a doc_id the larger counts. If the training rows lack a label, scores are 0.
    A null doc_id isn't held out. An empty table gives no rows.
    """
    scorer = train(docs, labels, **bounds)

    def scored(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            s = [0.0 if scorer is None else scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = texts(docs).mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """The rows of docs, all columns as they are, that score under threshold; of repeated rows each by itself.

    A null text is empty and stays unless empty texts score as toxic. If the training rows lack a label, all stay.
    """
    scorer = train(docs, labels, **bounds)
    if scorer is None:
        return docs
    text = docs.columns.index("text")

    def clean(batches):
        for whole in batches:
            for batch in slices(whole, text):
                yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
