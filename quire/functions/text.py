"""String helpers with Unicode white space and byte lengths, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}"
# Contents that stand for no content.
PLACEHOLDERS = ["", "[non-text]", "[empty]", "[]", "[no text]", "(no text)"]
# Noise cells of tables, besides the placeholders.
NOISE = ["[document icon]", "arrowleft", "exit left", "center", "screen up", "move the right", "work around the screen", "speed up the screen at the bottom left", "mail group"]
# Phrases of leaked instructions.
LEAKS = ["ground truth", "rule 2", "inconsistent", "no text or characters", "too blurry", "unreadable", "\\therefore", "\\frac{", "广力云"]
LEAK_ALL = ["loopback", "65536", "italian"]
# Fragments of gibberish.
GIBBERISH = ["0 0 0 0", "00 00 00", "24 0 24", "侍", "收元铜业", "bitch"]
GIBBERISH_ALL = ["水平", "0 0"]
# Names of styles, which a reference tag may hold instead of text.
STYLES = ["italic", "bold", "regular", "underline", "italian", "roman"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def count_of(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def fields(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def any_of(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def all_of(c: Column, parts: list[str]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.contains(c, F.lit(p))
    return out


def strip_references(c: Column) -> Column:
    """Reference tags give way to their text, and to nothing where that is the name of a style."""
    blank = r"[^\S\n]*"
    pair = f"(?id)<[|/]*ref[|/]*>(?:{blank}(?:{'|'.join(STYLES)}){blank}|{blank}(.*?){blank})<[|/]+ref[|/]+>"
    return F.regexp_replace(F.regexp_replace(c, pair, "$1"), "(?i)<[|/]*ref[|/]*>", "")


def _gibberish(low: Column) -> Column:
    def run(parts: Column) -> Column:
        numbers = F.size(F.filter(parts, lambda p: p.rlike(r"^[0-9.\-]*$")))
        zeros = F.size(F.filter(parts, lambda p: p.isin("0", "00", "000")))
        return (F.size(parts) > 10) & (((numbers > 8) & (numbers / F.size(parts) > 0.7)) | (zeros >= 4))

    # eleven fields take 21 characters
    long = F.when(F.length(low) > 20, let(fields(low), run)).otherwise(False)
    return any_of(low, GIBBERISH) | all_of(low, GIBBERISH_ALL) | (count_of(low, "\\(") >= 4) | long


def is_gibberish(c: Column) -> Column:
    return let(F.lower(c), _gibberish)


def is_leaked(c: Column) -> Column:
    return let(F.lower(c), lambda low: any_of(low, LEAKS) | all_of(low, LEAK_ALL) | _gibberish(low))


def is_placeholder(c: Column) -> Column:
    return F.lower(trim(c)).isin(PLACEHOLDERS)


def is_list_item(c: Column) -> Column:
    return trim(c).rlike(r"^([-*] |[0-9]+\. )")


def sanitize_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "-")


def row_plain(c: Column) -> Column:
    cells = F.filter(F.transform(F.split(c, r"\|"), trim), lambda x: x != "")
    return F.when(F.contains(c, F.lit("---")), "").otherwise(F.array_join(cells, "  "))


# Entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "'"), ("&quot;", '"')]


def html_text(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?s)<[^>]*(>|\z)|>", "")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return trim(out)


#: The next cell, with nothing ahead of it that opens one; where a cell has no end, no match begins.
CELL = r"(?is)\G(?:(?!<t[dh]).)*+(<td[^>]*>.*?</td>|<th[^>]*>.*?</th>)"


def html_rows(c: Column) -> Column:
    """Cells of each bare <tr> row, an array of arrays; rows without cells are left out.

    A row's cells end at the first that is opened and has no end tag of its kind.
    """
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr>(.*?)</tr>"), F.lit(1))
    return F.filter(F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), html_text)), lambda r: F.size(r) > 0)


def html_table_markdown(c: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def made(rows: Column) -> Column:
        rule = line(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")))
        lines = F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r)))
        return F.when(F.size(rows) == 0, c).otherwise(F.array_join(lines, "\n"))

    return let(html_rows(c), made)
