"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, by tables and column functions alone.

A paragraph's digest goes to one cell in each third of a sketch; a cell counts, and xors digests and checks. A sketch
is as large as its document has digests, so that it lists them all; its cells are the published fingerprint. Two
sketches of one size subtract cell by cell, and what is left peels: a cell with one digest gives it away, and it is
taken out of its other cells. What doesn't peel is tried again with larger sketches of both documents.

A sketch is rows of a table, one for each cell that isn't empty, so building, subtracting and peeling are sums by cell,
linear in the length of the text. A document's rows stay in the partition that its text was dealt to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, release, shuffle_partitions

#: Among the first words, one ends a paragraph if its hash is the least among so many before and behind.
NEAR = 2
#: From this word on, one word in so many ends a paragraph.
FAR = ((32, 8), (128, 16), (512, 32))
#: Words with more letters are cut too.
WORD = 64
#: Cells in a third of a sketch: this at least, and the least power of two that is four times the number of digests. Only
#: cells that aren't empty are stored, so room costs nothing.
LEAST = 128
#: Passes over the three thirds; what is left then counts as failed.
PASSES = 3
#: Bytes of text that a task is to have, as long as tasks aren't more than MORE times the shuffle's partitions.
SHARE, MORE = 1 << 20, 16
#: Places of what isn't a cell.
TALLY, LISTED, OWN, LIKE, SHA = -1, -2, -3, -4, -5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Runs of words, cut behind words that their hashes choose, so that an edit changes the runs about it alone.

    The first words are chosen where their hash is the least among their neighbours', so short texts have several runs
    too; farther on one word in so many is chosen, and runs grow with the distance from the start of the text, never by
    its length. Overlong words are runs of letters, cut likewise.
    """
    def cut(us: Column, hs: Column, between: str) -> Column:
        """us joined, with a line feed behind the chosen ones."""

        def marked(u: Column, i: Column) -> Column:
            def least(h: Column) -> Column:
                out = F.lit(True)
                for j in range(1, NEAR + 1):
                    out = out & F.coalesce(h < F.get(hs, i - j), F.lit(True)) & F.coalesce(h <= F.get(hs, i + j), F.lit(True))
                return out

            one = F.lit(FAR[-1][1])
            for (_, n), (until, _) in reversed(list(zip(FAR, FAR[1:], strict=False))):
                one = F.when(i < until, n).otherwise(one)
            chosen = F.when(i < FAR[0][0], let(F.get(hs, i), least)).otherwise(F.pmod(F.get(hs, i), one) == 0)
            return F.when(chosen, F.concat(u, F.lit("\n"))).otherwise(u)

        return F.array_join(F.transform(us, marked), between)

    def letters(words: Column) -> Column:
        """Where some words are overlong: units with the space behind them."""
        each = lambda w: F.when(F.length(w) > WORD, F.concat(F.filter(F.split(w, ""), lambda x: x != ""), F.array(F.lit(" ")))).otherwise(F.array(F.concat(w, F.lit(" "))))
        units = F.flatten(F.transform(words, each))
        return let(units, lambda us: let(F.transform(us, lambda u: F.xxhash64(u)), lambda hs: cut(us, hs, "")))

    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"\s+")
    plain = let(words, lambda ws: let(F.transform(ws, lambda w: F.xxhash64(F.concat(w, F.lit(" ")))), lambda hs: cut(ws, hs, " ")))
    odd = text.rlike(f"\\S{{{WORD + 1}}}")
    runs = F.split(F.when(odd, letters(words)).otherwise(plain), "\n")
    return F.filter(F.transform(runs, lambda p: F.trim(p)), lambda p: p != "")


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def size_for(n: Column) -> Column:
    """Cells in a third of the sketch of n digests."""
    return F.greatest(F.lit(LEAST), F.pow(2.0, F.ceil(F.log2(F.greatest(4 * n, F.lit(1))))).cast("int"))


def check(d: Column) -> Column:
    return F.xxhash64(d)


def places(d: Column, size: Column) -> list[Column]:
    """The digest's cell in each third."""
    return [(F.pmod(F.xxhash64(d, F.lit(i)), size) + i * size).cast("int") for i in range(3)]


def added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of equal place summed; empty ones go, but for those with places below 0. rows: keys, cell, n, k, c."""
    sums = rows.groupBy(*keys, "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return sums.where("cell < 0 or n <> 0 or k <> 0 or c <> 0")


def _cell(cell: Column, n: Column, k: Column, c: Column) -> Column:
    return F.struct(cell.cast("int").alias("cell"), n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def sketched(rows: DataFrame, keys: list[str], *notes: Column) -> DataFrame:
    """keys, cell, n, k, c: the sum of signed digests in sketches of the size in the key `size`, and notes as they are.

    rows: keys, signed: array of struct<d, n> with n not 0. notes: cells with places below 0, with columns of rows.
    """
    kind = "struct<cell:int,n:int,k:bigint,c:bigint>"
    digest = F.transform("signed", lambda s: _cell(F.lit(0), s["n"], s["d"], F.lit(0)).cast(kind))
    each = rows.select(*keys, F.explode(F.concat(F.array(*[x.cast(kind) for x in notes]), digest)).alias("s"))
    d, n = F.col("s.k"), F.col("s.n")
    three = F.array(*[_cell(p, n, d, check(d)).cast(kind) for p in places(d, F.col("size"))])
    placed = F.when(F.col("s.cell") < 0, F.array("s")).otherwise(three)
    return added(each.select(*keys, F.explode(placed).alias("e")).select(*keys, "e.*"), keys)


def tally(ours: Column, theirs: Column) -> Column:
    """The numbers of digests of two sketches that are subtracted."""
    return _cell(F.lit(TALLY), F.lit(0), ours, theirs)


def peeled(cells: DataFrame, keys: list[str], listing: bool = False) -> DataFrame:
    """What is left of cells once the digests that some cell holds alone are taken out, third by third.

    A digest that had entered with 1 adds one to its tally's n. With listing, each digest taken out is a row of its own
    instead, with place LISTED, its sign in n, and itself in k and the key `dig`. No other cell but notes is left where
    all has come out.
    """
    if listing:
        keys, cells = [*keys, "dig"], cells.withColumn("dig", F.lit(0).cast("long"))
    n, k, size = F.col("n"), F.col("k"), F.col("size")
    zero = F.lit(0).cast("long")
    for third in [0, 1, 2] * PASSES:
        pure = (F.col("cell") >= third * size) & (F.col("cell") < (third + 1) * size) & (F.abs(n) == 1) & (check(k) == F.col("c"))
        item = lambda cell, dig: F.struct(cell, dig.alias("dig")) if listing else F.struct(cell)
        others = [item(_cell(p, -n, k, F.col("c")).alias("e"), zero) for j, p in enumerate(places(k, size)) if j != third]
        told = item(_cell(F.lit(LISTED), n, zero, zero).alias("e"), k) if listing else item(_cell(F.lit(TALLY), F.when(n == 1, 1).otherwise(0), zero, zero).alias("e"), zero)
        kept = F.array(item(_cell(F.col("cell"), n, k, F.col("c")).alias("e"), F.col("dig") if listing else zero))
        plain = [x for x in keys if x != "dig"]
        moved = cells.select(*plain, F.explode(F.when(pure, F.array(*others, told)).otherwise(kept)).alias("m")).select(*plain, "m.*")
        cells = added(moved.select(*keys, "e.*"), keys)
    return cells


def signed(found: Column, n: int) -> Column:
    return F.transform(found, lambda d: F.struct(d.alias("d"), F.lit(n).alias("n")))


def counted(left: DataFrame, keys: list[str]) -> DataFrame:
    """keys, common, union, clean: how many digests two sketches share and have together, of what peeled() leaves."""
    told = F.col("cell") == TALLY
    sums = left.groupBy(*keys).agg(F.max((F.col("cell") >= 0).cast("int")).alias("open"), *[F.sum(F.when(told, F.col(c)).otherwise(0)).alias(c) for c in ("n", "k", "c")])
    return sums.select(*keys, (F.col("k") - F.col("n")).alias("common"), (F.col("c") + F.col("n")).alias("union"), (F.col("open") == 0).alias("clean"))


def share(common: Column, union: Column) -> Column:
    """Jaccard similarity; of two empty sets 1."""
    return F.when(union == 0, 1.0).otherwise(common / union)


def published_cell() -> Column:
    """A cell as text: place, count, digest and check, in hexadecimal digits but for the count."""
    return F.lower(F.concat_ws(".", F.hex(F.col("cell").cast("long")), "n", F.hex("k"), F.hex("c")))


def published(cells: Column, n: Column, size: Column) -> Column:
    """A sketch as text: size of a third, number of digests, then its cells in order. cells: array of struct<cell, t>."""
    return F.concat(size, F.lit("."), n, F.lit(";"), F.array_join(F.transform(F.array_sort(cells), lambda e: e["t"]), ","))


def cells_of(prints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, size, cell, n, k, c of published sketches, with their numbers in notes. prints: keys, print."""
    head, body = F.split("print", "[.;]"), F.substring_index("print", ";", -1)
    number = lambda h: F.conv(h, 16, -10).cast("long")
    cell = lambda e: let(F.split(e, "[.]"), lambda p: _cell(number(p[0]), p[1].cast("int"), number(p[2]), number(p[3])))
    every = F.concat(F.array(tally(head[1].cast("long"), F.lit(0))), F.transform(F.filter(F.split(body, ","), lambda e: e != ""), cell))
    return prints.select(*keys, head[0].cast("int").alias("size"), F.explode(every).alias("e")).select(*keys, "size", "e.*")


def likeness_of(pairs: DataFrame) -> DataFrame:
    """id, near: likeness of published fingerprints alone. pairs: id, a, b.

    Sketches of one size are subtracted and peeled. Where sizes differ, or what is left doesn't peel, each sketch is
    listed by itself and the digests are compared; near is null where not even that comes out.
    """
    sides = F.array(*[F.struct(F.lit(v).alias("v"), F.col(c).alias("print")) for v, c in ((0, "a"), (1, "b"))])
    cells = cells_of(pairs.select("id", F.explode(sides).alias("p")).select("id", "p.*"), ["id", "v"])
    first, told = F.col("v") == 0, F.col("cell") == TALLY
    second = told & ~first
    signs = cells.select("id", "size", "cell", F.when(first, F.col("n")).otherwise(-F.col("n")).alias("n"), F.when(second, F.col("c")).otherwise(F.col("k")).alias("k"), F.when(second, F.col("k")).otherwise(F.col("c")).alias("c"))
    same = cells.groupBy("id").agg(F.count_distinct("size").alias("sizes")).where("sizes = 1").select("id")
    left = counted(peeled(added(signs.join(same, "id", "left_semi"), ["id", "size"]), ["id", "size"]), ["id"])
    direct = left.where("clean").select("id", share(F.col("common"), F.col("union")).alias("near"))
    out = peeled(cells.join(direct, "id", "left_anti"), ["id", "v", "size"], listing=True)
    whole = out.groupBy("id").agg(F.max((F.col("cell") >= 0).cast("int")).alias("open"))
    each = out.where(f"cell = {LISTED}").groupBy("id", "dig").agg(F.count("*").alias("sides"))
    sums = each.groupBy("id").agg(F.count("*").alias("union"), F.sum((F.col("sides") == 2).cast("int")).alias("common"))
    near = F.when(F.col("open") == 0, F.coalesce(share(F.col("common"), F.col("union")), F.lit(1.0)))
    return direct.unionByName(whole.join(sums, "id", "left").select("id", near.alias("near")))


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """r, again, doc_id, tie, text for with_next(): the text of the next row in descending order of doc_id, and of the first after the last.

    Null doc_ids come last, rows of one doc_id by a hash of text. Rows are dealt into ranges by quantiles of doc_id and
    evenly within them, rows of a frequent doc_id (or without any) by the hash; each range is put in order by itself.
    The first row of each range goes to the range above too, behind its last: a place for each range, of which there is a
    fixed number, tells which rows these are, and texts go through one shuffle, by r into the number of partitions that is given back.
    r and rn tell rows apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("o", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    seen = rows.agg(F.percentile_approx("o", [i / 32 for i in range(33)], 2000), F.sum(F.octet_length("text"))).first()
    found, partitions = seen[0] or [0], shuffle_partitions(docs.sparkSession)
    n = max(partitions, min(MORE * partitions, -(-(seen[1] or 0) // SHARE)))
    cuts, often = sorted(set(found)), {c: found.count(c) for c in found if found.count(c) > 1}
    ranges = 8 * n  # several for a partition, so that these are alike
    inner, wide = max(1, -(-ranges // len(cuts))), 2 * ranges + 4
    longs = F.array(*[F.lit(c).cast("long") for c in cuts])
    at = F.size(F.filter(longs, lambda c: c <= F.col("o")))
    lo, hi = F.get(longs, F.greatest(at - 1, F.lit(0))).cast("double"), F.get(longs, F.least(at, F.lit(len(cuts) - 1))).cast("double")
    within = lambda share, parts: F.least(F.floor(share * parts), F.lit(parts - 1))
    part = wide // 2 + within(F.when(hi > lo, (F.col("o").cast("double") - lo) / (hi - lo)).otherwise(0.0), inner)
    for c, times in often.items():  # as many parts as this doc_id has quantiles
        by_tie = within((F.col("tie").cast("double") + 2.0**63) / 2.0**64, -(-ranges * times // 33))
        part = F.when(F.col("o") == c, by_tie).otherwise(part)
    rows = rows.withColumn("r", (at * wide + part).cast("int"))
    heads = rows.groupBy("r").agg(F.max(F.struct("o", "tie")).alias("h")).collect()  # one row for each range
    order = sorted(heads, key=lambda h: -h["r"])
    ring = [(h["h"]["o"], h["h"]["tie"], order[i - 1]["r"]) for i, h in enumerate(order)]  # the top's is the lowest
    ring = docs.sparkSession.createDataFrame(ring, "o long, tie long, above int")
    own = F.struct(F.col("r"), F.lit(False).alias("again"))
    placed = F.array_compact(F.array(own, F.when(F.col("above").isNotNull(), F.struct(F.col("above").alias("r"), F.lit(True).alias("again")))))
    both = rows.join(F.broadcast(ring), ["o", "tie"], "left").select("doc_id", "tie", "text", F.explode(placed).alias("p"))
    return both.select("p.*", "doc_id", "tie", "text").repartition(n, "r"), n


def with_next(dealt_: DataFrame, **more: Column) -> DataFrame:
    """r, rn, doc_id, text, next_text, and for each of more its value and the next row's: rows of dealt(), each with its next."""
    over = Window.partitionBy("r").orderBy("again", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    rows = dealt_.select("*", *[c.alias(n) for n, c in more.items()])
    names = ["text", *more]
    led = rows.select("r", "again", "doc_id", *names, *[F.lead(c).over(over).alias(f"next_{c}") for c in names], F.row_number().over(over).alias("rn"))
    return led.where(~F.col("again")).drop("again")


def edited() -> Column:
    """The text with its last third replaced by as much, or all, of the head of the next."""
    third = F.floor(F.length("text") / 3).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))


def digested(dealt_: DataFrame) -> DataFrame:
    """r, rn, doc_id, n_chars, sha, a, e, z: rows of dealt() with the digests of their text, of their edited text and of the next row's."""
    rows = with_next(dealt_, a=digests(F.col("text"))).select("r", "rn", "doc_id", "text", "a", F.col("next_a").alias("z"), edited().alias("edited"))
    return rows.select("r", "rn", "doc_id", F.length("text").alias("n_chars"), F.sha2("edited", 256).alias("sha"), "a", digests(F.col("edited")).alias("e"), "z")


def likeness(dealt_: DataFrame, larger: int = 0, open_: DataFrame | None = None) -> DataFrame:
    """r, rn, v, common, union, clean: each row's digests with those of its edited text (v 0) and of the next row's (v 1),
    from the difference of two sketches of the larger one's size.

    dealt_: rows of dealt() or of digested(). larger: how often sketches have failed; each time they have sixteen times
    the cells. open_: r, rn of the rows wanted.
    """
    found = dealt_ if "z" in dealt_.columns else digested(dealt_)
    if open_ is not None:
        found = found.join(open_, ["r", "rn"], "left_semi")
    both = F.array(*[F.struct(F.lit(v).alias("v"), F.col(c).alias("o")) for v, c in ((0, "e"), (1, "z"))])
    each = found.select("r", "rn", "a", F.explode(both).alias("p")).select("r", "rn", "p.v", "a", "p.o")
    size = F.greatest(size_for(F.size("a")), size_for(F.size("o"))) * 16**larger
    pairs = each.select("r", "rn", "v", size.alias("size"), F.concat(signed(F.col("a"), 1), signed(F.col("o"), -1)).alias("signed"), F.size("a").alias("x"), F.size("o").alias("y"))
    keys = ["r", "rn", "v", "size"]
    return counted(peeled(sketched(pairs, keys, tally(F.col("x"), F.col("y"))), keys), ["r", "rn", "v"])


def nearness(dealt_: DataFrame, attempts: int = 8) -> DataFrame:
    """r, rn, v, common, union: likeness() of all pairs; rows with one that doesn't peel go again with larger sketches."""
    held: list[DataFrame] = []
    for larger in range(attempts):
        open_ = held[-1].where(~F.col("clean")).select("r", "rn").distinct() if held else None
        held.append(materialize(likeness(dealt_, larger, open_)))
        if held[-1].where(~F.col("clean")).isEmpty():
            break
    else:
        raise RuntimeError("sketches don't peel")
    every = held[0]
    for more in held[1:]:
        every = every.unionByName(more)
    out = materialize(every.where("clean").groupBy("r", "rn", "v").agg(F.max("common").alias("common"), F.max("union").alias("union")))
    release(*held)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of docs.

    The edited text has its last third replaced by as much, or all, of the head of the next row's text, in descending
    order of doc_id (null last; rows of one doc_id by a hash of text); the first row follows the last. A null text is
    empty. Likeness is that of the distinct paragraphs, recovered from the difference of two sketches of the size of the
    larger fingerprint; two texts without any are alike. An empty table gives no rows.
    """
    rows, n = dealt(docs)
    # texts are cut and hashed once; all else is made of their digests, dealt as the texts were
    made = materialize(digested(rows))
    rows = made.repartition(n, "r")
    near = nearness(rows)
    # whatever belongs to a row is notes of its first sketch: numbers alone, so that rows meet by sums in their partition
    words = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"w{i}") for i in range(4)]
    two = F.array(*[F.struct(F.lit(v).alias("v"), F.col(t).alias("d")) for v, t in ((0, "a"), (1, "e"))])
    told = rows.select("r", "rn", F.col("doc_id").isNull().cast("int").alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"), "n_chars", *words, F.explode(two).alias("p"))
    each = told.select("*", "p.v", size_for(F.size("p.d")).alias("size"), F.size("p.d").alias("count"), signed(F.col("p.d"), 1).alias("signed"))
    notes = [
        _cell(F.lit(TALLY), F.lit(0), F.col("count"), F.col("size")),
        _cell(F.lit(OWN), F.col("null"), F.col("id"), F.col("n_chars")),
        _cell(F.lit(SHA), F.lit(0), F.col("w0"), F.col("w1")),
        _cell(F.lit(SHA - 1), F.lit(0), F.col("w2"), F.col("w3")),
    ]
    cells = sketched(each, ["r", "rn", "v", "size"], *notes)

    def note(place: int, field: str) -> Column:
        return F.max(F.when(F.col("cell") == place, F.col(field))).alias(f"{field}{-place}")

    one = cells.select("*", published_cell().alias("t")).groupBy("r", "rn", "v").agg(
        F.collect_list(F.when(F.col("cell") >= 0, F.struct("cell", "t"))).alias("cells"),
        note(TALLY, "k"), note(TALLY, "c"), note(OWN, "n"), note(OWN, "k"), note(OWN, "c"), *[note(SHA - i, f) for i in (0, 1) for f in ("k", "c")])
    hexed = [F.lpad(F.hex(f"{f}{-SHA + i}"), 16, "0") for i in (0, 1) for f in ("k", "c")]
    none, number, text = F.lit(None), F.lit(None).cast("long"), F.lit(None).cast("string")
    shown = one.select(
        "r", "rn", "v", published(F.col("cells"), F.col(f"k{-TALLY}"), F.col(f"c{-TALLY}")).alias("print"), F.when(F.col(f"n{-OWN}") == 0, F.col(f"k{-OWN}")).alias("doc_id"),
        F.col(f"c{-OWN}").alias("n_chars"), F.lower(F.concat(*hexed)).alias("sha"), none.cast("double").alias("near"))
    # dealt as rows are, so that nothing but these few numbers moves
    likes = near.repartition(n, "r").select("r", "rn", "v", text.alias("print"), number.alias("doc_id"), number.alias("n_chars"), text.alias("sha"), share(F.col("common"), F.col("union")).alias("near"))
    of = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    return shown.union(likes).groupBy("r", "rn").agg(
        of(0, "doc_id").alias("doc_id"), of(0, "n_chars").alias("n_chars"), of(0, "sha").alias("edited_sha256"), of(0, "print").alias("fingerprint"),
        of(1, "print").alias("edited_fingerprint"), of(0, "near").alias("near_edited"), of(1, "near").alias("near_next")).drop("r", "rn")
