"""Places of regular expressions in texts, by column functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,s:int,e:int,m:string,gap:string>>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """The matches of a pattern from left to right: kind, start, end (code points, end exclusive), text, what lies before.

    The parts between matches and the matches alternate, so their lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        item = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m"), x["gap"].alias("gap"))
        return F.struct(e.alias("at"), F.array_append(acc["out"], item).alias("out"))

    return F.aggregate(both, zero, step, lambda acc: acc["out"])


def none() -> Column:
    return F.array().cast(SPAN)


def bare(spans: Column) -> Column:
    """kind, s, e of spans."""
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each, comma-joined in the order that the array has."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(n) for n in names]), x["kind"] + 1), x["s"], x["e"])), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def by_start(spans: Column) -> Column:
    """In order of start, then kind, then end."""
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
