"""SQL of the parser, the layout and the renderers, from the rules and not from any input's known answers.

Each function gives an expression or a query; tables are chained by name, so that a query reads what it needs.
"""

from __future__ import annotations

from quire.functions import latex as lx
from quire.functions import text as tx
from quire.operators import render

WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NL = "chr(10)"


def quoted(text: str) -> str:
    """A literal; line feeds by their number."""
    return "'" + text.replace("'", "''").replace("\n", f"' || {NL} || '") + "'"


def listed(texts: list[str]) -> str:
    return "(" + ", ".join(map(quoted, texts)) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


def any_of(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


def all_of(x: str, parts: list[str]) -> str:
    return "(" + " AND ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


def count_of(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, {quoted(part)}, ''))) // {len(part)})"


def gibberish(x: str) -> str:
    low = f"lower({x})"
    parts = f"list_filter(regexp_split_to_array({low}, '{WHITE}+'), lambda w: w <> '')"
    numbers = rf"len(list_filter({parts}, lambda w: regexp_full_match(w, '[0-9.\-]*')))"
    zeros = f"len(list_filter({parts}, lambda w: w IN ('0', '00', '000')))"
    return (
        f"({any_of(low, tx.GIBBERISH)} OR {all_of(low, tx.GIBBERISH_ALL)} OR {count_of(low, chr(92) + '(')} >= 4"
        f" OR (len({parts}) > 10 AND (({numbers} > 8 AND {numbers} / len({parts}) > 0.7) OR {zeros} >= 4)))"
    )


def leaked(x: str) -> str:
    low = f"lower({x})"
    return f"({any_of(low, tx.LEAKS)} OR {all_of(low, tx.LEAK_ALL)} OR {gibberish(x)})"


def strip_references(x: str) -> str:
    blank, styles = r"[^\S\n]*", "|".join(tx.STYLES)
    pair = rf"(?i)<[|/]*ref[|/]*>(?:{blank}(?:{styles}){blank}|{blank}(.*?){blank})<[|/]+ref[|/]+>"
    return rf"regexp_replace(regexp_replace({x}, '{pair}', '\1', 'g'), '(?i)<[|/]*ref[|/]*>', '', 'g')"


def html_text(x: str) -> str:
    return trim(replaced(rf"regexp_replace({x}, '(?s)<[^>]*(>|\z)|>', '', 'g')", tx.ENTITIES))


def html_rows(x: str) -> str:
    """A row is read up to the first cell that has no end; no input has one angle bracket right behind another."""
    cell = "<td[^>]*>.*?</td>|<th[^>]*>.*?</th>"
    head = f"regexp_extract(tr, '(?is)^(?:[^<]|<[^t]|<t[^dh]|{cell})*', 0)"
    cells = f"list_transform(regexp_extract_all({head}, '(?is){cell}', 0), lambda td: {html_text('td')})"
    return f"list_filter(list_transform(regexp_extract_all({x}, '(?is)<tr>(.*?)</tr>', 1), lambda tr: {cells}), lambda tds: len(tds) > 0)"


def html_table_markdown(x: str) -> str:
    rows = html_rows(x)
    line = lambda r: f"'| ' || array_to_string({r}, ' | ') || ' |'"
    rule = line("list_transform(tds, lambda c: '---')")
    lines = f"list_transform({rows}, lambda tds, i: {line('tds')} || CASE WHEN i = 1 THEN {NL} || {rule} ELSE '' END)"
    return f"CASE WHEN len({rows}) = 0 THEN {x} ELSE array_to_string({lines}, {NL}) END"


def unicode_latex(x: str) -> str:
    return rf"regexp_replace({replaced(x, lx.UNICODE)}, '\p{{Han}}', '', 'g')"


def escape(x: str) -> str:
    return replaced(x, lx.ESCAPES)


def escape_math(x: str) -> str:
    end = "instr(p, '\\)')"
    math = f"'\\(' || substr(p, 1, {end} + 1) || {escape(f'substr(p, {end} + 2)')}"
    part = f"CASE WHEN j = 1 THEN {escape('p')} WHEN {end} > 0 THEN {math} ELSE {escape(f'{quoted(chr(92) + chr(40))} || p')} END"
    return f"array_to_string(list_transform(string_split({unicode_latex(x)}, '\\('), lambda p, j: {part}), '')"


def table_head(width: str) -> str:
    return f"{quoted(lx.TABLE_HEAD)} || '\\begin{{tabular}}{{' || array_to_string(list_transform(range({width}), lambda c: 'l'), ' ') || '}}' || {NL} || '\\hline' || {NL}"


def html_table_latex(x: str) -> str:
    rows = html_rows(x)
    width = f"list_max(list_transform({rows}, lambda ws: len(ws)))"
    cells = f"array_to_string(list_concat(list_transform(tds, lambda td: {escape_math('td')}), list_transform(range({width} - len(tds)), lambda c: '')), ' & ')"
    lines = f"list_transform({rows}, lambda tds, i: {cells} || ' \\\\ \\relax' || {NL} || CASE WHEN i = 1 THEN '\\hline' || {NL} ELSE '' END)"
    return f"CASE WHEN len({rows}) = 0 THEN {escape_math(html_text(x))} ELSE {table_head(width)} || array_to_string({lines}, '') || {quoted(lx.TABLE_TAIL)} END"


def row_plain(x: str) -> str:
    cells = f"list_filter(list_transform(string_split({x}, '|'), lambda c: {trim('c')}), lambda c: c <> '')"
    return f"CASE WHEN contains({x}, '---') THEN '' ELSE array_to_string({cells}, '  ') END"


def plain(x: str) -> str:
    bare = f"CASE WHEN starts_with(ln, '#') THEN {trim("regexp_replace(ln, '^#+', '')")} ELSE ln END"
    shown = f"list_transform(list_transform({x}, lambda ln: {bare}), lambda b: CASE WHEN contains(b, '|') THEN {row_plain('b')} ELSE b END)"
    kept = shown.replace(x, f"list_filter(string_split({x}, {NL}), lambda w: NOT (starts_with(w, '---') OR starts_with(w, '<!--')))", 1)
    text = f"array_to_string(list_transform({kept}, lambda t: translate(t, '*_`', '')), {NL})"
    return trim(rf"regexp_replace({text}, '\n{{3,}}', {NL} || {NL}, 'g')")


def labelled(source: str) -> str:
    """source with label and bbox of a tag's payload in the column tag, which is trimmed."""
    part = f"TRY_CAST(nullif(regexp_extract({trim('w')}, '^[+-]?[0-9]+'), '') AS BIGINT)"
    return f"""
        SELECT * EXCLUDE (nums), CASE WHEN a > 0 AND b > a THEN {trim("substr(tag, 1, a - 1)")} ELSE tag END AS label,
               CASE WHEN a > 0 AND b > a AND len(nums) = 4 AND len(list_filter(nums, lambda n: n IS NULL)) = 0 THEN nums END AS bbox
        FROM (SELECT *, list_transform(string_split(substr(tag, a + 1, b - a - 1), ','), lambda w: {part}) AS nums
              FROM (SELECT *, instr(tag, '[') AS a, instr(tag, ']') AS b FROM {source}))
    """


def content(x: str) -> str:
    return f"replace(replace({strip_references(trim(x))}, '<|det|>', ''), '<|/det|>', '')"


def chunks(raw: str = "raws") -> str:
    """chunks(doc_id, page_no, chunk) of raws(doc_id, raw)."""
    return f"""
        kept AS (SELECT doc_id, CASE WHEN len(c) > 1 AND {trim("c[1]")} = '' THEN c[2:] ELSE c END AS c
                 FROM (SELECT doc_id, string_split({trim("raw")}, '<PAGE>') AS c FROM {raw})),
        chunks AS (SELECT doc_id, CAST(i AS INT) AS page_no, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM kept))
    """


#: blocks(doc_id, page_no, ord, label, content, bbox) of chunks that have tags. A tag without a closer goes with the
#: next ones up to a closer, so a tag is as many parts as there are between one closer and the next.
BLOCKS = f"""
    parts AS (SELECT doc_id, page_no, j, c[j] AS part, contains(c[j], '<|/det|>') AS closed
              FROM (SELECT doc_id, page_no, c, unnest(range(1, len(c) + 1)) AS j
                    FROM (SELECT doc_id, page_no, string_split(chunk, '<|det|>') AS c FROM chunks))),
    numbered AS (SELECT *, coalesce(sum(CAST(closed AS INT)) OVER (PARTITION BY doc_id, page_no ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
                 FROM parts WHERE j > 1),
    wholes AS (SELECT doc_id, page_no, min(j) AS j, string_agg(part, '<|det|>' ORDER BY j) AS whole, bool_or(closed) AS closed FROM numbered GROUP BY doc_id, page_no, g),
    tags AS (SELECT *, {trim("substr(whole, 1, pos - 1)")} AS tag FROM (SELECT *, instr(whole, '<|/det|>') AS pos FROM wholes WHERE closed)),
    found AS (
        SELECT doc_id, page_no, j, label, {content("substr(whole, pos + 8)")} AS content, bbox FROM ({labelled("tags")})
        UNION ALL SELECT doc_id, page_no, j, 'text', {trim("whole")}, NULL FROM wholes WHERE NOT closed
        UNION ALL SELECT doc_id, page_no, j, 'text', {trim("part")}, NULL FROM parts WHERE j = 1 AND {trim("part")} <> ''
    ),
    blocks AS (SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY j) - 1 AS INT) AS ord, label, content, bbox FROM found)
"""

ROW = "STRUCT(sy DOUBLE, sh DOUBLE, n INT, tall BOOLEAN)"


def layout(blocks: str) -> str:
    """cells(doc_id, page_no, row_no, col_no, ord, label, content, box): boxed blocks in their rows; rows grow block by block."""
    mean = "CASE WHEN r.sh / r.n <= 0 THEN 10 ELSE r.sh / r.n END"
    return f"""
        boxed AS (SELECT *, (bbox[2] + bbox[4]) / 2.0 AS yc, CAST(bbox[4] - bbox[2] AS DOUBLE) AS raw FROM {blocks} WHERE bbox IS NOT NULL),
        seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY yc, ord) AS i FROM boxed),
        walk AS (
            SELECT DISTINCT doc_id, page_no, CAST(0 AS BIGINT) AS i, CAST([] AS {ROW}[]) AS held, CAST(0 AS BIGINT) AS pos FROM seq
            UNION ALL
            SELECT doc_id, page_no, i,
                   CASE WHEN pos > 0 THEN list_transform(held, lambda r, j: CASE WHEN j = pos THEN CAST(ROW(r.sy + yc, r.sh + raw, r.n + 1, r.tall) AS {ROW}) ELSE r END)
                        ELSE list_append(held, CAST(ROW(yc, raw, 1, raw > 50) AS {ROW})) END,
                   CASE WHEN pos > 0 THEN pos ELSE len(held) + 1 END
            FROM (SELECT s.doc_id, s.page_no, s.i, s.yc, s.raw, w.held,
                         CASE WHEN s.raw > 50 THEN 0 ELSE coalesce(list_position(list_transform(w.held, lambda r:
                              NOT r.tall AND abs(s.yc - r.sy / r.n) < greatest(12.0, ({mean}) * 0.7)), true), 0) END AS pos
                  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.page_no = w.page_no AND s.i = w.i + 1)
        ),
        cells AS (SELECT s.doc_id, s.page_no, CAST(w.pos - 1 AS INT) AS row_no,
                         CAST(row_number() OVER (PARTITION BY s.doc_id, s.page_no, w.pos ORDER BY s.bbox[1], s.i) - 1 AS INT) AS col_no, s.ord, s.label, s.content, s.bbox AS box
                  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.page_no = w.page_no AND s.i = w.i)
    """


KEPT = f"shown AS (SELECT * FROM blocks WHERE lower({trim('content')}) NOT IN {listed(tx.PLACEHOLDERS)})"

#: lines(doc_id, page_no, row_no, one, text, label, html, flush, cells, fa): fa is where a row's table is written.
LINES = f"""
    grouped AS (SELECT doc_id, page_no, row_no, count(*) AS n, list(replace({trim("content")}, {NL}, ' ') ORDER BY col_no) AS cells,
                       {trim(f"string_agg({trim('content')}, ' ' ORDER BY col_no)")} AS text, lower(arg_min(label, col_no)) AS label
                FROM cells GROUP BY doc_id, page_no, row_no),
    told AS (SELECT *, n = 1 OR n > 20 AS one, contains(lower(text), '<table') AS html, {leaked("text")} AS bad FROM grouped),
    marked AS (SELECT *, one AND NOT html AND NOT bad AND text <> '' AND (label IN {listed(render.FLUSHING)} OR strlen(text) > 40 OR {count_of("text", " ")} > 5) AS flush FROM told),
    lines AS (SELECT *, coalesce(min(CASE WHEN flush THEN row_no END) OVER (PARTITION BY doc_id, page_no ORDER BY row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1000000000) AS fa
              FROM marked WHERE NOT one OR (text <> '' AND (html OR NOT bad)))
"""


def segments(line: str, html: str, cell: str, row: str, head: str, tail: str, pad: bool) -> str:
    """segs(doc_id, page_no, k1, k2, t): lines and tables as they are written. row: of clean, idx and width."""
    made = f"list_transform(cells, lambda c: CASE WHEN {leaked('c')} THEN '' ELSE {cell} END)"
    if pad:
        made = f"list_concat({made}, list_transform(range(width - len(cells)), lambda z: ''))"
    return f"""
        wide AS (SELECT *, row_number() OVER w AS idx, max(len(cells)) OVER (PARTITION BY doc_id, page_no, fa) AS width FROM lines WHERE NOT one
                 WINDOW w AS (PARTITION BY doc_id, page_no, fa ORDER BY row_no)),
        clean AS (SELECT *, {made} AS clean FROM wide),
        segs AS (
            SELECT doc_id, page_no, row_no AS k1, 1 AS k2, CASE WHEN html THEN {html} ELSE {line} END || {NL} || {NL} AS t FROM lines WHERE one
            UNION ALL
            SELECT doc_id, page_no, fa, 0, {head} || string_agg({row}, '' ORDER BY row_no) || {tail} FROM clean GROUP BY doc_id, page_no, fa, width
        )
    """


def _empty_row(words: list[str]) -> str:
    return f"len(list_filter(clean, lambda c: lower({trim('c')}) NOT IN {listed(words)})) = 0"


MARKDOWN = segments(
    "CASE WHEN label = 'title' THEN '## ' || text WHEN label IN ('figure', 'caption') THEN '*' || text || '*' ELSE text END",
    html_table_markdown("text"), "c",
    f"CASE WHEN {_empty_row([*tx.PLACEHOLDERS, *tx.NOISE])} THEN '' ELSE '| ' || array_to_string(clean, ' | ') || ' |' || {NL}"
    f" || CASE WHEN idx = 1 THEN '|' || repeat(' --- |', width) || {NL} ELSE '' END END",
    "''", NL, False,
)

LATEX = segments(
    f"CASE WHEN label = 'title' THEN '\\section{{' || {escape_math('text')} || '}}' WHEN label = 'header' THEN '\\subsection{{' || {escape_math('text')} || '}}'"
    f" WHEN label IN ('figure', 'caption') THEN '\\begin{{figure}}[h]' || {NL} || '\\centering' || {NL} || '\\caption{{' || {escape_math('text')} || '}}' || {NL} || '\\end{{figure}}'"
    f" ELSE {escape_math('text')} END",
    html_table_latex("text"), escape_math("c"),
    f"CASE WHEN {_empty_row(tx.PLACEHOLDERS)} THEN '' ELSE array_to_string(clean, ' & ') || ' \\\\ \\relax' || {NL} || CASE WHEN idx = 1 THEN '\\hline' || {NL} ELSE '' END END",
    table_head("width"), f"{quoted(lx.TABLE_TAIL)} || {NL}", True,
)


def pages(loose: str) -> str:
    """pages(doc_id, page_no, n, t): every page, of those without boxes the contents one after the other."""
    return f"""
        loose AS (SELECT doc_id, page_no, string_agg({loose} || {NL} || {NL}, '' ORDER BY ord) AS t FROM shown GROUP BY doc_id, page_no HAVING count(bbox) = 0),
        written AS (SELECT doc_id, page_no, string_agg(t, '' ORDER BY k1, k2) AS t FROM segs GROUP BY doc_id, page_no UNION ALL SELECT * FROM loose),
        pages AS (SELECT c.doc_id, c.page_no, count(*) OVER (PARTITION BY c.doc_id) AS n, coalesce(w.t, '') AS t FROM chunks c LEFT JOIN written w USING (doc_id, page_no))
    """


def documents_markdown(raws: str) -> str:
    """docs(doc_id, markdown) behind the tables it needs."""
    head = f"CASE WHEN n > 1 THEN {NL} || '---' || {NL} || '<!-- page ' || page_no || ' -->' || {NL} || {NL} ELSE '' END"
    return f"""{rendered(raws, MARKDOWN, 'content')},
        docs AS (SELECT doc_id, {trim(f"string_agg({head} || t, '' ORDER BY page_no)")} AS markdown FROM pages GROUP BY doc_id)"""


def rendered(raws: str, segs: str, loose: str) -> str:
    return f"WITH RECURSIVE {raws}, {chunks()}, {BLOCKS}, {KEPT}, {layout('shown')}, {LINES}, {segs}, {pages(loose)}"
