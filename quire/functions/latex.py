"""LaTeX escapes, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import html_rows, html_text, let

# Characters and what LaTeX has for them, in the order of replacement.
UNICODE = [
    ("。", "."), ("，", ", "), ("（", "("), ("）", ")"), ("；", ";"), ("：", ":"), ("？", "?"), ("！", "!"),
    ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("○", "0"),
    ("□", "\\(\\square\\)"), ("•", "\\(\\bullet\\)"), ("π", "\\(\\pi\\)"), ("α", "\\(\\alpha\\)"), ("β", "\\(\\beta\\)"),
    ("λ", "\\(\\lambda\\)"), ("θ", "\\(\\theta\\)"), ("√", "\\(\\surd\\)"),
    ("⁰", "\\(^{0}\\)"), ("¹", "\\(^{1}\\)"), ("²", "\\(^{2}\\)"), ("³", "\\(^{3}\\)"), ("⁴", "\\(^{4}\\)"),
    ("⁵", "\\(^{5}\\)"), ("⁶", "\\(^{6}\\)"), ("⁷", "\\(^{7}\\)"), ("⁸", "\\(^{8}\\)"), ("⁹", "\\(^{9}\\)"),
    ("↔", "\\(\\leftrightarrow\\)"), ("→", "\\(\\rightarrow\\)"), ("←", "\\(\\leftarrow\\)"),
    ("Ø", "\\O "), ("ø", "\\o "), ("∅", "\\O "), ("Æ", "\\AE "), ("æ", "\\ae "), ("Å", "\\AA "), ("å", "\\aa "),
]
# LaTeX's own characters and their escapes, the backslash first.
ESCAPES = [
    ("\\", "\\textbackslash "), ("%", "\\%"), ("&", "\\&"), ("$", "\\$"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("#", "\\#"),
    ("~", "\\textasciitilde "), ("^", "\\textasciicircum "), ("<", "\\textless "), (">", "\\textgreater "),
]
# What stands before and behind the rows of a table.
TABLE_HEAD = "\\begin{table}[h]\n\\centering\n\\sbox{\\tblbox}{%\n\\small\n"
TABLE_TAIL = (
    "\\hline\n\\end{tabular}%\n}\n"
    "\\ifdim\\wd\\tblbox>\\linewidth\n  \\resizebox{\\linewidth}{!}{\\usebox{\\tblbox}}%\n"
    "\\else\n  \\usebox{\\tblbox}%\n\\fi\n\\end{table}\n"
)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unicode_latex(c: Column) -> Column:
    whole = F.regexp_replace(_replaced(c, UNICODE), r"\p{IsHan}", "")
    return F.when(c.rlike("[^\x00-\x7f]"), whole).otherwise(c)  # nothing of it is ASCII


def escape(c: Column) -> Column:
    return F.when(c.rlike(r"[\\%&$_{}#~^<>]"), _replaced(c, ESCAPES)).otherwise(c)


def escape_math(c: Column) -> Column:
    """Escapes all but what stands between \\( and \\)."""

    def part(p: Column, i: Column) -> Column:
        end = F.locate("\\)", p)
        math = F.concat(F.lit("\\("), F.substring(p, F.lit(1), end + 1), escape(F.substring(p, end + 2, F.length(p))))
        return F.when(i == 0, escape(p)).when(end > 0, math).otherwise(escape(F.concat(F.lit("\\("), p)))

    return F.array_join(F.transform(F.split(unicode_latex(c), r"\\\(", -1), part), "")


def table_head(width: Column) -> Column:
    return F.concat(F.lit(TABLE_HEAD + "\\begin{tabular}{"), F.array_join(F.array_repeat(F.lit("l"), width), " "), F.lit("}\n\\hline\n"))


def html_table_latex(c: Column) -> Column:
    def made(rows: Column) -> Column:
        def whole(width: Column) -> Column:
            def line(r: Column, i: Column) -> Column:
                cells = F.concat(F.transform(r, escape_math), F.array_repeat(F.lit(""), width - F.size(r)))
                return F.concat(F.array_join(cells, " & "), F.lit(" \\\\ \\relax\n"), F.when(i == 0, "\\hline\n").otherwise(""))

            return F.concat(table_head(width), F.array_join(F.transform(rows, line), ""), F.lit(TABLE_TAIL))

        return F.when(F.size(rows) == 0, escape_math(html_text(c))).otherwise(let(F.array_max(F.transform(rows, F.size)), whole))

    return let(html_rows(c), made)
