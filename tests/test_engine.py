import json

import pytest
from pyspark.sql import functions as F

from quire.functions import latex as lx
from quire.functions import text as tx
from quire.operators import layout, parse, render, request, structured


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def parsed(spark, raw):
    pages = parse.pages(spark.createDataFrame([(1, raw)], "doc_id long, raw string"))
    return [(r.page_no, r.label, r.content, r.bbox) for r in parse.blocks(pages).orderBy("page_no", "ord").collect()]


@pytest.mark.parametrize(("raw", "expected"), [
    ("<|det|>caption [3, 40, 70, 58]<|/det|>Fig 2: 春の川", [(1, "caption", "Fig 2: 春の川", [3, 40, 70, 58])]),
    ("<|det|>text [9,8,17,16]<|/det|>see <|ref|>note 4<|/ref>", [(1, "text", "see note 4", [9, 8, 17, 16])]),
    ("<|det|>no end of this tag", [(1, "text", "no end of this tag", None)]),
    ("<|det|>a [1,2,3,4]<|/det|>x<|det|>b <|det|>c<|/det|>y<|det|>open", [(1, "a", "x", [1, 2, 3, 4]), (1, "b <|det|>c", "y", None), (1, "text", "open", None)]),
    ("<PAGE><|det|>a [1,2,3,4]<|/det|>x<PAGE>y [1, 2, 3, 4] z\nmore", [(1, "a", "x", [1, 2, 3, 4]), (2, "y", "z\nmore", [1, 2, 3, 4])]),
    ("lead <|det|>a <|det|>b [1,2,x,4]<|/det|> c", [(1, "text", "lead", None), (1, "a <|det|>b", "c", None)]),
    ("", [(1, "text", "", None)]),
    ("a [1,2] b", [(1, "text", "a [1,2] b", None)]),
])
def test_parse(spark, raw, expected):
    assert parsed(spark, raw) == expected


def test_html_tables(spark):
    table = "<table><tr><th>Fruit</th><th a='1'>Price &amp; tax</th></tr><tr class='x'><td>lost</td></tr><TR><TD>Plum</TD></TR></table>"
    assert one(spark, tx.html_table_markdown, table) == "| Fruit | Price & tax |\n| --- | --- |\n| Plum |"
    tex = one(spark, lx.html_table_latex, table)
    assert tex.startswith("\\begin{table}[h]\n\\centering\n\\sbox{\\tblbox}{%\n\\small\n\\begin{tabular}{l l}\n\\hline\nFruit & Price \\& tax \\\\ \\relax\n\\hline\nPlum &  \\\\ \\relax\n")
    assert one(spark, tx.html_table_markdown, "none") == "none"


@pytest.mark.parametrize(("row", "cells"), [
    ("<td>a</td><th>b<td>c</td>", ["a"]),
    ("<td>a</td><td b</td>", ["a"]),
    ("<td>a<td>b</td><th>c</th>", ["ab", "c"]),
    ("<td>a</th><td>b</td>", ["ab"]),
    ("x<td>a</td>y < z<th\n>b</TH>", ["a", "b"]),
    ("<th>a<td>b</td>", None),
    ("a" * 50000 + "<td>b</td>", ["b"]),
])
def test_cells_end_where_one_is_not_closed(spark, row, cells):
    got = spark.createDataFrame([(f"<tr>{row}</tr>",)], "t string").select(tx.html_rows(F.col("t"))).first()[0]
    assert got == ([cells] if cells else [])


def test_text_rules(spark):
    assert one(spark, tx.strip_references, "a <|ref|>Bold<|/ref|>b <|ref|> c <|/ref|>") == "a b c"
    assert one(spark, tx.is_leaked, "the Ground Truth") and not one(spark, tx.is_leaked, "fine")
    assert one(spark, tx.is_gibberish, "1 2 3 4 5 6 7 8 9 10 11") and not one(spark, tx.is_gibberish, "1 2 3")
    assert one(spark, parse.strip_fence, "```json\n[1]\n```") == "[1]"
    assert one(spark, lx.escape_math, "5% \\(x_1\\) \\(y") == "5\\% \\(x_1\\) \\textbackslash (y"
    assert one(spark, render.plain, "# A\n| a | b |\n| --- | --- |\n**x**") == "A\na  b\n\nx"


def rows_of(boxes):
    """The clustering rule, box by box; in a row from left to right, of equal ones the upper first."""
    rows = []
    order = sorted(range(len(boxes)), key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, i))
    for i in order:
        b = boxes[i]
        yc, h = (b[1] + b[3]) / 2, b[3] - b[1] if b[3] > b[1] else 10
        for r in rows if h <= 50 else []:
            heights = [boxes[j][3] - boxes[j][1] for j in r]
            mean = sum(heights) / len(r)
            if max(heights) <= 50 and abs(yc - sum((boxes[j][1] + boxes[j][3]) / 2 for j in r) / len(r)) < max(12, 0.7 * (mean if mean > 0 else 10)):
                r.append(i)
                break
        else:
            rows.append([i])
    return [sorted(r, key=lambda j: (boxes[j][0], order.index(j))) for r in rows]


def test_clusters(spark):
    import random

    r = random.Random(1)
    pages = [[(r.randint(0, 9) * 100, y := r.randint(0, 300), 500, y + r.choice([-5, 0, 10, 20, 45, 80])) for _ in range(r.randint(1, 14))] for _ in range(40)]
    data = [(d, 1, i, "text", str(i), list(b)) for d, p in enumerate(pages) for i, b in enumerate(p)]
    blocks = spark.createDataFrame(data, "doc_id long, page_no int, ord int, label string, content string, bbox array<bigint>")
    got = layout.layout(layout.page_rows(blocks)).collect()
    for d, p in enumerate(pages):
        mine = {}
        for x in sorted((x for x in got if x.doc_id == d), key=lambda x: (x.row_no, x.col_no)):
            mine.setdefault(x.row_no, []).append(x.ord)
        assert list(mine.values()) == rows_of(p)


def test_documents(spark):
    raw = "<|det|>title [0,0,9,20]<|/det|>T\n<|det|>text [0,50,9,60]<|/det|>a<|det|>text [100,50,109,60]<|/det|>b<|det|>text [0,90,9,100]<|/det|>tail<PAGE>[empty]"
    pages = parse.pages(spark.createDataFrame([(1, raw)], "doc_id long, raw string"))
    blocks = parse.blocks(pages)
    md = render.markdown(blocks, pages).first().markdown
    assert md == "---\n<!-- page 1 -->\n\n## T\n\ntail\n\n| a | b |\n| --- | --- |\n\n\n---\n<!-- page 2 -->"
    tex = render.latex(blocks, pages).first().latex
    assert "\\section{T}" in tex and "a & b \\\\ \\relax\n\\hline\n" in tex and "\\newpage" in tex and tex.endswith("\\end{document}\n")
    meta = spark.createDataFrame([(1, 1, 2, 3, 4, 0)], "doc_id long, page int, width int, height int, dpi int, rotation int")
    out = json.loads(render.json_documents(blocks, meta, F.lit("s<"), "m").first().json)
    assert out["source"] == "s<" and len(out["blocks"]) == 5 and out["blocks"][4]["bbox_2d"] is None


def test_json_documents_keep_all(spark):
    answers = [(1, '[[]]'), (2, '[{"index":7,"label":"a","content":["x",1.5,{"k":null}],"bbox_2d":[1,2.5,3]}]'), (3, "plain \u2028 <line>")]
    blocks = structured.contents(spark.createDataFrame(answers, "doc_id long, raw string"))
    meta = spark.createDataFrame([(1, 1, 2, 3, 4, 0), (2, 1, 2, 3, 4, 0), (4, 1, 2, 3, 4, 90)], "doc_id long, page int, width int, height int, dpi int, rotation int")
    got = render.json_documents(blocks, meta, F.lit("s"), "m").select("doc_id", "json", render.indented(F.col("json")).alias("pretty")).collect()
    out = {r.doc_id: json.loads(r.json) for r in got}
    assert all(json.loads(r.pretty) == out[r.doc_id] for r in got)
    assert out[1]["blocks"] == out[4]["blocks"] == [] and out[3]["pages"] == [] and out[4]["pages"][0]["rotation"] == 90
    assert out[2]["blocks"] == [{"page": 1, "index": 7, "label": "a", "content": ["x", 1.5, {"k": None}], "bbox_2d": [1, 2.5, 3]}]
    assert out[3]["blocks"][0]["content"] == "plain \u2028 <line>"
    text = next(r for r in got if r.doc_id == 3)
    assert "\\u2028 \\u003cline\\u003e" in text.pretty and "\\u2028 \\u003cline\\u003e" in text.json
    assert text.pretty.startswith('{\n  "source": "s",\n  "model": "m",\n  "pages": [],\n  "blocks": [\n    {\n      "page": 1,\n      "index": 0,')


def test_merged_neighbours(spark):
    row = [(10, 0, "a", [0, 0, 10, 10]), (30, 1, "b", [30, 5, 40, 12]), (61, 2, "c", [61, 0, 70, 10]), (75, 3, "", [75, 0, 80, 10]), (85, 4, "t", [85, 0, 90, 10])]
    data = [(1, 1, i, "Table" if t == "t" else "text", t, b) for _, i, t, b in row]
    blocks = spark.createDataFrame(data, "doc_id long, page_no int, ord int, label string, content string, bbox array<bigint>")
    rows = layout.page_rows(blocks)
    got = rows.select(layout.merge_horizontal(F.col("rows")).alias("m"), F.transform("rows", layout.line_box).alias("b")).first()
    assert [(b.label, b.content, b.x1, b.y1, b.x2, b.y2) for b in got.m[0]] == [("text", "a b", 0, 0, 40, 12), ("text", "c", 61, 0, 80, 10), ("Table", "t", 85, 0, 90, 10)]
    assert [tuple(b) for b in got.b] == [(0, 0, 90, 12)]


def test_recipes(spark):
    cases = [("baidu", 0, 1), ("baidu", 0, 2), ("baidu", 1, 9), ("baidu", 2, 1), ("glm", 3, 3)]
    got = spark.createDataFrame(cases, "e string, b int, p int").select(request.recipe(F.col("e"), F.col("b"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["window_size=128", "window_size=1024", "window_size=128", "window_size=1024", ""]
    prompts = [(request.DEFAULT_PROMPT, 2), (request.DEFAULT_PROMPT, 1), ("<image>x", 2), ("x", 2)]
    got = spark.createDataFrame(prompts, "t string, p int").select(request.document_prompt(F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in got] == [request.MULTI, request.SINGLE, "<image>x", "<image>x"]


def test_requests(spark):
    row = spark.range(1).select(
        request.api_url(F.lit("http://h:80/"), F.lit(9)).alias("url"), request.data_uri(F.lit("a.PNG"), F.lit(b"x" * 99)).alias("uri"),
        request.chat_request(F.lit("m"), F.lit("p"), F.array(F.lit("u")), F.lit(0), True).alias("req"), request.response(F.lit('{"choices":[{"message":{"content":"c"}}]}')).alias("ok"),
        request.response(F.lit('{"error":{"message":"bad"}}')).alias("bad"), request.batch_prompt(F.lit("x"), F.lit(1)).alias("prompt")).first()
    assert row.url == "http://h:9/v1/chat/completions" and "\n" not in row.uri and row.uri.startswith("data:image/png;base64,")
    assert json.loads(row.req)["custom_params"] == {"ngram_size": 35, "window_size": 128}
    assert row.ok.content == "c" and row.bad.error == "bad" and row.prompt == "<image>x"
    cache = spark.createDataFrame([("h", 0, "a", 2), ("h", 0, "b", 1)], "hash string, page_index int, content string, seq int")
    pages = spark.createDataFrame([("h", 0), ("h", 1)], "hash string, page_index int")
    assert request.cache_hits(pages, cache).first().content == "b" and request.cache_misses(pages, cache).first().page_index == 1
