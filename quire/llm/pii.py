"""Personal data: patterns of the value, and more values by the words about them.

Spans of four kinds are found by their form. They are the seeds of a graph of values and lexical patterns (one to three
words before a value, behind it, or on both sides): a pattern scores by the share of its values that are known, a value
by its best pattern, and values of like form in patterns of high score become known; both are scored in turn, for a
fixed number of rounds. Column functions and tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, release
from quire.llm.spans import bare, count, listed, matches, none

KINDS = ["email", "ip", "card", "phone"]
#: Stand-ins for single marks between like neighbours, so that a run of them is a run of one class of characters.
DOT, GAP = "\ue000", "\ue001"
LOCAL = f"[A-Za-z0-9._%+{DOT}-]"
EMAIL = f"(?:(?<!{LOCAL})|\\G){LOCAL}++@(?=[A-Za-z0-9-]*+{DOT})[A-Za-z0-9{DOT}-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"(?<![0-9{GAP}])[0-9{GAP}]{{16,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: A word with a digit or an @, without marks at its ends.
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S++"
#: Words of a pattern on each side at most.
WORDS = 3
FOUND = "array<struct<kind:int,s:int,e:int,m:string,left:string,right:string>>"


def _plain(text: Column, stand_in: str) -> Column:
    return F.translate(text, stand_in, "\ufffd")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    d = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def with_context(found: Column, text: Column) -> Column:
    """kind, s, e, m of matches in text, and left, right: up to WORDS words, lower-cased and with single spaces between,
    before and behind each, whether or not they belong to another match.

    ^ and $ stand for the ends of the text; what sticks to the end of a match is no word.
    """
    spaced = lambda c: F.regexp_replace(F.translate(c, DOT + GAP, ". "), r"\s++", " ")
    part = lambda x, i: F.struct(*[x[c].alias(c) for c in ("kind", "s", "e")], F.translate(x["m"], DOT + GAP, ". ").alias("m"), spaced(x["m"]).alias("w"), F.when(i == 0, F.ltrim(spaced(x["gap"]))).otherwise(spaced(x["gap"])).alias("gap"))

    def item(all_: Column, tail: Column, x: Column, i: Column) -> Column:
        at = lambda j, c: F.coalesce(F.get(all_, i + j)[c], F.lit(""))
        # the matches before and behind have a word at least, so as many of them do
        left = F.concat(F.when(i < WORDS, "^ ").otherwise(""), *[f for j in range(-WORDS, 0) for f in (*([at(j, "gap")] if j > -WORDS else []), at(j, "w"))], x["gap"])
        first = F.when(i == 0, F.concat(F.lit("^ "), x["gap"])).otherwise(left)
        right = F.concat(*[f for j in range(1, WORDS + 1) for f in (at(j, "gap"), at(j, "w"))], F.when(i + WORDS >= F.size(all_), F.concat(F.rtrim(tail), F.lit(" $"))).otherwise(""))
        before = F.substring_index(F.rtrim(first), " ", -WORDS)
        behind = F.substring_index(F.regexp_replace(right, "^[^ ]*+ ", ""), " ", WORDS)
        return F.struct(*[x[c].alias(c) for c in ("kind", "s", "e", "m")], F.lower(before).alias("left"), F.lower(behind).alias("right"))

    def items(all_: Column) -> Column:
        tail = spaced(F.substring(text, F.element_at(all_, -1)["e"] + 1, F.length(text)))
        one = F.transform(F.array(tail), lambda t: F.transform(all_, lambda x, i: item(all_, t, x, i)))
        return F.when(F.size(all_) > 0, F.flatten(one)).otherwise(F.array().cast(FOUND))

    # the matches are made once, not for each of them
    return F.flatten(F.transform(F.array(F.transform(found, part)), items))


def patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a value between left and right; a long one is its digest."""
    before = lambda n: F.concat(F.substring_index(left, " ", -n), F.lit(" _"))
    behind = lambda n: F.concat(F.lit("_ "), F.substring_index(right, " ", n))
    both = lambda n: F.concat(before(n), F.lit(" "), F.substring_index(right, " ", n))
    every = F.array(*[f(n) for f in (before, behind) for n in range(1, WORDS + 1)], *[both(n) for n in range(1, WORDS)])
    return F.array_distinct(F.transform(every, lambda p: F.when(F.octet_length(p) > 128, F.md5(p)).otherwise(p)))


def base_found(text: Column) -> Column:
    """Matches of the four kinds, by kind and start: kind, s, e, m, left, right."""
    digit = text.rlike("[0-9]")
    dotted = F.regexp_replace(_plain(text, DOT), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    email = F.when(F.contains(text, F.lit("@")), matches(dotted, EMAIL, 0)).otherwise(none())
    ip = F.when(digit & text.rlike(r"[0-9]\.[0-9]"), matches(text, IP, 1)).otherwise(none())
    joined = F.regexp_replace(_plain(text, GAP), "(?<=[0-9])[ -](?=[0-9])", GAP)
    card = F.when(digit, matches(joined, CARD, 2)).otherwise(none())
    phone = F.when(F.contains(text, F.lit("+")), matches(text, PHONE, 3)).otherwise(none())
    return F.concat(
        with_context(email, text),
        F.filter(with_context(ip, text), lambda x: x["m"].rlike(OCTETS)),
        F.filter(with_context(card, text), lambda x: F.length(_digits(x["m"])).between(16, 19) & luhn(_digits(x["m"]))),
        F.filter(with_context(phone, text), lambda x: F.length(_digits(x["m"])).between(8, 15)),
    )


def instances(text: Column, base: Column) -> Column:
    """What could be a value, with the words about it: s, e, value, left, right.

    Whole spans of base, words, and runs of words of digits with single spaces between.
    """
    found = F.when(text.rlike("[0-9@]"), matches(text, TOKEN, 0)).otherwise(none())
    run = F.regexp_replace(_plain(text, GAP), r"(?<=[0-9)])\x20(?=[(]?[0-9])", GAP)
    runs = F.when(text.rlike(r"[0-9)]\x20[(]?[0-9]"), matches(run, TOKEN, 0)).otherwise(none())

    def item(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["m"], r"^[^A-Za-z0-9+@(]*+", 0))
        value = F.regexp_replace(F.substring(x["m"], lead + 1, F.length(x["m"])), r"[^A-Za-z0-9)]++$", "")
        return F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.length(value)).alias("e"), value.alias("value"), x["left"].alias("left"), x["right"].alias("right"))

    def free(xs: Column, base: Column) -> Column:
        return F.filter(xs, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))

    def joined(base: Column) -> Column:
        whole = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))
        spaced = F.filter(F.transform(with_context(runs, text), item), lambda x: F.contains(x["value"], F.lit(" ")))
        return F.concat(whole, free(F.filter(F.concat(F.transform(with_context(found, text), item), spaced), lambda x: x["value"] != ""), base))

    return F.flatten(F.transform(F.array(base), joined))


def discovered(seen: DataFrame, rounds: int = 3, trust: float = 0.8, support: int = 5) -> DataFrame:
    """value, kind of values that patterns of high score make known.

    seen: value, left, right, kind (null where unknown). A pattern counts each of its values once; its score for a kind
    is the sum of its values' scores for that kind, by their number. It is trusted with a score of `trust` or more and
    `support` known values. Seeds score 1, other values as their best trusted pattern, so that what follows from
    uncertain values weighs less; a value needs the shape of a seed of the kind and half the length of the shortest
    such seed. Of several kinds the one of highest score counts, then the first.
    """
    seeds = seen.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    edges = materialize(seen.select(F.explode(patterns(F.col("left"), F.col("right"))).alias("pattern"), "value").distinct())
    # no pattern with fewer values can get support
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    graph = materialize(edges.join(sizes, "pattern").select("pattern", "n", "value", shape(F.col("value")).alias("shape"), F.length("value").alias("length")))
    release(edges)
    start = materialize(seeds)
    shapes = start.groupBy(shape(F.col("value")).alias("shape"), "kind").agg((F.min(F.length("value")) / 2).alias("least"))
    known = start
    for _ in range(rounds):
        scores = graph.select("pattern", "n", "value").join(known, "value").groupBy("pattern", "kind").agg(F.first("n").alias("n"), F.count("*").alias("hits"), F.sum("score").alias("sum"))
        trusted = scores.where((F.col("hits") >= support) & (F.col("sum") >= trust * F.col("n"))).select("pattern", "kind", (F.col("sum") / F.col("n")).alias("score"))
        found = graph.join(trusted, "pattern").join(shapes, ["shape", "kind"]).where("length >= least").groupBy("value", "kind").agg(F.max("score").alias("score"))
        best = found.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("value", (-F.col("b.k")).alias("kind"), "b.score")
        known = materialize(start.unionByName(best.join(start, "value", "left_anti")))
    return known.join(start, "value", "left_anti").select("value", "kind")


def shape(value: Column) -> Column:
    """Runs of digits, of letters and of marks, each as one character."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]++", "9"), r"[A-Za-z]++", "a"), r"[^9a@.+()]++", "-")


def pii_spans(docs: DataFrame, rounds: int = 3, trust: float = 0.8, support: int = 5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each row of docs.

    A null text is empty. Counts and base_sha256 are of the spans by form; spans adds those by pattern, which overlap
    none of them. Equal texts get equal spans, and each repeated row its own. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", base_found(F.col("text")).alias("found"))
    rows = materialize(rows.select("doc_id", F.xxhash64("text").alias("key"), bare(F.col("found")).alias("base"), instances(F.col("text"), F.col("found")).alias("inst")))
    one = F.explode("inst").alias("i")
    each = rows.where(F.size("inst") > 0).dropDuplicates(["key"]).select("key", "base", one).select(
        "key", "i.*", F.filter("base", lambda b: (b["s"] < F.col("i.e")) & (b["e"] > F.col("i.s"))).alias("over"))
    each = materialize(each.select("key", "s", "e", "value", "left", "right", F.get("over", F.lit(0))["kind"].alias("kind"), (F.size("over") > 0).alias("based")))
    new = discovered(each, rounds, trust, support)
    added = each.where("not based").drop("kind").join(new, "value").groupBy("key").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added"))
    # of a run and a word of it, the run
    inside = lambda x: F.exists("added", lambda y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & (y["e"] - y["s"] > x["e"] - x["s"]))
    added = added.select("key", F.filter("added", lambda x: ~inside(x)).alias("added"))
    joined = rows.select("doc_id", "key", "base").join(added, "key", "left").withColumn("all", F.concat("base", F.coalesce("added", bare(none()))))
    by_kind = F.array_sort("all")
    return joined.select("doc_id", *[count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(F.array_sort("base"), KINDS), 256).alias("base_sha256"), listed(by_kind, KINDS).alias("spans"))


