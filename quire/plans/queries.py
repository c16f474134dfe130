"""Queries over texts made from the tables in the recognizer's dialects, each with its SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import latex as lx
from quire.functions import text as tx
from quire.operators import layout, parse, render, request, structured
from quire.plans import oracle as o
from quire.sources import images

PER_ORDER = """
    SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS k,
           CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def _tag(label: str, *box: str) -> str:
    return f"'<|det|>{label} [' || " + " || ', ' || ".join(f"CAST({x} AS STRING)" for x in box) + " || ']<|/det|>'"


Y = "(CASE WHEN doc_id % 25 = 1 THEN 100 ELSE (k - 1) % 4 * 60 + 100 END)"
#: A line of an order as recognized text, in SQL that both engines read. Its cells are tall, unboxed, unclosed or out of
#: line, and hold references, noise, tables, mathematics or nothing, by the line's part, supplier and quantity.
LINE = f"""
    CASE WHEN k = 1 AND doc_id % 9 = 0 THEN ' lead ' || CAST(doc_id AS STRING) ELSE '' END
    || CASE WHEN k > 1 AND k % 4 = 1 AND doc_id % 25 <> 1 THEN '<PAGE>' ELSE '' END
    || CASE WHEN k % 4 <> 1 OR doc_id % 25 = 1 THEN '' WHEN doc_id % 7 = 0 THEN '<|det|>title<|/det|>Order ' || CAST(doc_id AS STRING) || chr(10)
            ELSE {_tag("title", "10", "10", "900", "40")} || 'Order ' || CAST(doc_id AS STRING) || chr(10) END
    || CASE WHEN doc_id % 7 = 0 OR p % 11 = 0 THEN '<|det|>text<|/det|>'
            WHEN p % 11 = 1 THEN {_tag("Title", "10", Y, "200", f"{Y} + 20")}
            WHEN p % 11 = 2 THEN {_tag(" caption ", "10", Y, "200", f"{Y} + 20")}
            WHEN p % 11 = 3 THEN '<|det|>text [1, x, 3, 4]<|/det|>'
            WHEN p % 11 = 4 THEN '<|det|>note '
            ELSE {_tag("text", "10", Y, "200.7", f"{Y} + (CASE WHEN p % 7 = 0 THEN 60 ELSE 20 END)")} END
    || CASE p % 13 WHEN 0 THEN 'part <|ref|> ' || CAST(p AS STRING) || '<|/ref|>' WHEN 1 THEN 'Ground Truth ' || CAST(p AS STRING) WHEN 2 THEN ' [Empty] '
            WHEN 3 THEN '<table><tr><td>' || CAST(p AS STRING) || '</td><td>a &amp; b</td></tr><TR><th>' || CAST(q AS STRING) || '</th><td>open</tr></table>'
            WHEN 4 THEN 'a fairly long line of words that goes over forty bytes ' || CAST(p AS STRING) WHEN 5 THEN '0 0 0 0 ' || CAST(p AS STRING)
            WHEN 6 THEN '5% of x_1 ' || chr(92) || '( a_' || CAST(p AS STRING) || ' ' || chr(92) || ') α 日 æ' WHEN 7 THEN 'a | b *c* #' || CAST(p AS STRING)
            WHEN 8 THEN 'x' || chr(10) || 'y ' || CAST(p AS STRING) WHEN 9 THEN 'Center' ELSE '  part ' || CAST(p AS STRING) END || chr(10)
    || CASE WHEN s % 5 = 0 OR doc_id % 7 = 0 THEN '' ELSE {_tag("text", "300", f"{Y} + p % 25", "500", f"{Y} + p % 25 + 20")}
            || CASE q % 9 WHEN 0 THEN '<|ref|>Bold<|/ref|>' WHEN 1 THEN '[no text]' ELSE 'qty ' || CAST(q AS STRING) END || chr(10) END
    || CASE WHEN s % 4 <> 1 OR doc_id % 7 = 0 THEN '' ELSE {_tag("text", "600 - k", f"{Y} + 2", "700", f"{Y} + 22")} || 'third ' || CAST(s AS STRING) END
    || CASE WHEN doc_id % 10 = 3 AND s % 3 = 0 THEN '<|det|>left open ' || CAST(s AS STRING) ELSE '' END
"""
RAWS = f"raws AS (SELECT doc_id, string_agg(t, '' ORDER BY k) AS raw FROM (SELECT doc_id, k, {LINE} AS t FROM ({PER_ORDER})) GROUP BY doc_id)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw: an order's lines as tagged pages of four lines, or one page with all of them on one height."""
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(f"SELECT doc_id, k, {LINE} AS t FROM ({PER_ORDER})")
    one = F.array_sort(F.collect_list(F.struct("k", "t")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(one, lambda x: x["t"]), "").alias("raw"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, blocks."""
    return parse.page_blocks(parse.pages(tagged(spark, sf_dir)))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.blocks(parse.pages(tagged(spark, sf_dir)))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, rows of all boxed blocks."""
    return _pages(spark, sf_dir).select("doc_id", "page_no", layout.rows_of(layout.numbered(F.col("blocks"))).alias("rows"))


def _box(bbox) -> F.Column:
    return F.array_join(F.transform(bbox, lambda x: x.cast("string")), ",")


def split_pages(spark, sf_dir):
    return parse.pages(tagged(spark, sf_dir))


def parse_det_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "page_no", "ord", "label", "content", _box("bbox").alias("box"))


def parse_det_unclosed(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    rows = spark.sql(f"SELECT c_custkey AS doc_id, {UNCLOSED} AS raw FROM customer")
    return parse.blocks(parse.pages(rows)).select("doc_id", "page_no", "ord", "label", "content", _box("bbox").alias("box"))


UNCLOSED = """CASE c_custkey % 3 WHEN 0 THEN 'lead ' ELSE '' END || '<|det|>a ' || c_name || CASE WHEN c_custkey % 4 = 0 THEN '<|det|>b' ELSE '' END || ' [1, 2, 3, ' || CAST(c_nationkey AS STRING) || ']<|/det|> ' || c_mktsegment
    || CASE c_custkey % 5 WHEN 0 THEN '<|det|>open ' || c_name || '<|det|>again ' WHEN 1 THEN '<|det|><|/det|>' WHEN 2 THEN '<|det|>' ELSE '<PAGE><|det|>c [1,2]<|/det|><|ref|>z<|/ref|> ' END"""


def row_cluster(spark, sf_dir):
    return layout.layout(_rows(spark, sf_dir))


def row_order(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("doc_id", "page_no", F.posexplode("rows").alias("row_no", "r"))
    b = layout.line_box(F.col("r"))
    return rows.select("doc_id", "page_no", "row_no", F.size("r").alias("n"), F.array_join(F.transform("r", lambda x: x["content"]), " / ").alias("contents"), _box(F.array(b["x1"], b["y1"], b["x2"], b["y2"])).alias("box"))


def horizontal_merge(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("doc_id", "page_no", F.posexplode(layout.merge_horizontal(F.col("rows"), 100)).alias("row_no", "r"))
    return rows.select("doc_id", "page_no", "row_no", F.posexplode("r").alias("col_no", "b")).select("doc_id", "page_no", "row_no", "col_no", "b.*")


def _segments(spark, sf_dir):
    found = render.page_segments(_pages(spark, sf_dir))
    return found.select("doc_id", "page_no", F.posexplode("segments").alias("seg_no", "s"))


def table_islands(spark, sf_dir):
    return _segments(spark, sf_dir).select("doc_id", "page_no", "seg_no", F.coalesce(F.size("s.cells"), F.lit(0)).alias("n_rows"), F.array_join(F.transform("s.cells", lambda r: F.array_join(r, "/")), ";").alias("cells"))


def table_markdown(spark, sf_dir):
    return _segments(spark, sf_dir).where("s.cells is not null").select("doc_id", "page_no", "seg_no", render.segment_markdown(F.col("s")).alias("t"))


def line_markdown(spark, sf_dir):
    return _segments(spark, sf_dir).where("s.cells is null").select("doc_id", "page_no", "seg_no", render.segment_markdown(F.col("s")).alias("t"))


def page_markdown(spark, sf_dir):
    return render.markdown_bodies(_pages(spark, sf_dir)).select("doc_id", F.explode("bodies").alias("p")).select("doc_id", "p.page_no", "p.t")


def document_markdown(spark, sf_dir):
    return render.markdown_pages(_pages(spark, sf_dir))


def document_text(spark, sf_dir):
    return document_markdown(spark, sf_dir).select("doc_id", render.plain(F.col("markdown")).alias("text"))


def document_latex(spark, sf_dir):
    return render.latex_pages(_pages(spark, sf_dir))


def page_meta(spark, sf_dir):
    pages = parse.pages(tagged(spark, sf_dir))
    code = ((F.col("doc_id") + F.col("page_no")) % 5).cast("int")
    return pages.select("doc_id", F.col("page_no").alias("page"), (F.col("page_no") * 100).alias("width"), F.length("chunk").alias("height"), F.lit(200).alias("dpi"), request.rotation(code).alias("rotation"))


def json_document(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).where("doc_id % 8 <> 0")  # some have none
    return render.json_documents(blocks, page_meta(spark, sf_dir), F.concat(F.lit("order-<"), F.col("doc_id"), F.lit(">")), "model")


def json_blocks_flat(spark, sf_dir):
    kind = "blocks array<struct<page:int,`index`:int,label:string,content:string,bbox_2d:array<bigint>>>"
    found = json_document(spark, sf_dir).select("doc_id", F.explode(F.from_json("json", kind)["blocks"]).alias("b"))
    return found.select("doc_id", "b.page", F.col("b.index").alias("idx"), "b.label", "b.content", _box("b.bbox_2d").alias("box"))


SIBLING = """
    CASE WHEN k % 6 = 0 THEN 'orphan ' || CAST(p AS STRING) || chr(10) ELSE '' END
    || CASE s % 4 WHEN 0 THEN 'text [10, ' ELSE ' Note [ 10, ' END || CAST(p AS STRING) || ', 20, 30' || CASE WHEN q % 5 = 0 THEN ', 1' ELSE '' END || '] qty <|ref|>' || CAST(q AS STRING) || '<|/ref|>'
    || chr(10) || chr(10) || '  more ' || CAST(s AS STRING) || chr(10) || CASE WHEN q % 3 = 0 THEN 'cell [1, 2, 3, 4]' || chr(10) || 'below' ELSE 'note [1,2] x' END
    || CASE WHEN p % 4 = 0 THEN chr(10) || '[5, 6, 7, 8] no label' ELSE '' END
"""


def parse_sibling(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(f"SELECT doc_id, k, {SIBLING} AS raw FROM ({PER_ORDER})")
    return rows.select("doc_id", "k", F.posexplode(parse.sibling_blocks(F.col("raw"))).alias("ord", "b")).select("doc_id", "k", "ord", "b.label", "b.content", _box("b.bbox").alias("box"))


def parse_lines(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    return parse.line_blocks(spark.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw")))


NOISE = """CASE turn % 7 WHEN 0 THEN text || ' 0 0 0 0' WHEN 1 THEN text || chr(92) || '(a' || chr(92) || '(b' || chr(92) || '(c' || chr(92) || '(d' WHEN 2 THEN '1 2 3.5 -4 5 6 7 8 9 10 11 ' || CAST(conv_id AS STRING)
    WHEN 3 THEN 'a b c d e f g h 0 00 000 0' WHEN 4 THEN '1 2 3 4 5 6 7 8 9 a b c d' WHEN 5 THEN text || ' \u6c34\u5e73 0 0' ELSE text END"""


def gibberish_flags(spark, sf_dir):
    tables(spark, sf_dir, "conversations")
    return spark.sql(f"SELECT conv_id, turn, {NOISE} AS t FROM conversations").select("conv_id", "turn", tx.is_gibberish(F.col("t")).alias("gibberish"))


LEAK = """CASE doc_id % 9 WHEN 0 THEN text || ' Ground Truth' WHEN 1 THEN 'Loopback 65536 ITALIAN' WHEN 2 THEN 'loopback 65536' WHEN 3 THEN chr(92) || 'frac{1}' || text
    WHEN 4 THEN '1 2 3 4 5 6 7 8 9 10 - ' || CAST(doc_id AS STRING) WHEN 5 THEN text || ' 24 0 24' ELSE text END"""


def leak_flags(spark, sf_dir):
    tables(spark, sf_dir, "documents")
    return spark.sql(f"SELECT doc_id, {LEAK} AS t FROM documents").select("doc_id", tx.is_leaked(F.col("t")).alias("leaked"))


def html_text(spark, sf_dir):
    tables(spark, sf_dir, "pages")
    return spark.table("pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


REFS = """CASE p_partkey % 6 WHEN 0 THEN '<|ref|> ' || p_name || ' <|/ref|> <|ref|>Bold<|/ref|>x<|ref|>' WHEN 1 THEN 'a <|REF|>' || p_name || '<|/ref>b' WHEN 2 THEN '<ref>' || p_name || '<//ref|>, <|ref|>c<|/ref|>'
    WHEN 3 THEN '<|ref|> italic <|/ref|><|ref|>italics<|/ref|>' || p_name WHEN 4 THEN '<|ref|>' || p_name || chr(10) || 'd<|/ref|>' ELSE p_name || '<|/ref|><|ref|>' END"""


def strip_refs(spark, sf_dir):
    tables(spark, sf_dir, "part")
    return spark.sql(f"SELECT p_partkey, {REFS} AS t FROM part").select("p_partkey", tx.strip_references(F.col("t")).alias("text"))


HTML = """CASE o_orderkey % 8 WHEN 7 THEN 'no table ' || o_orderstatus ELSE '<table><tr><th>Key</th><TH a=1>50% &lt;Status&gt;</th></tr>' END
    || CASE o_orderkey % 4 WHEN 0 THEN '<tr><td>' || CAST(o_orderkey AS STRING) || '</td><td>' || o_orderstatus || ' &amp;amp; more</td></tr>'
            WHEN 1 THEN '<tr>x<td class="y">' || o_orderpriority || '</td><th>open<td>' || o_orderstatus || '</td></tr><TR><td>' || chr(10) || '<b>' || CAST(o_custkey AS STRING) || '</b> </TD><td></td><td>3</td></TR>'
            WHEN 2 THEN '<tr class="z"><td>lost</td></tr><tr></tr>' ELSE '<tr><td>a<td>' || o_orderpriority || '</td></tr><tr><td>never closed</td>' END"""


def html_table_md(spark, sf_dir):
    tables(spark, sf_dir, "orders")
    return spark.sql(f"SELECT o_orderkey, {HTML} AS t FROM orders").select("o_orderkey", tx.html_table_markdown(F.col("t")).alias("md"))


def html_table_latex(spark, sf_dir):
    tables(spark, sf_dir, "orders")
    return spark.sql(f"SELECT o_orderkey, {HTML} AS t FROM orders").select("o_orderkey", lx.html_table_latex(F.col("t")).alias("tex"))


MATH = """CASE p_partkey % 5 WHEN 0 THEN p_name || ' 5%_\u03b1 ' || chr(92) || '(x_1' || chr(92) || ') \u00d8 \u65e5 ' || chr(92) || '(y' WHEN 1 THEN chr(92) || '(a_' || CAST(p_size AS STRING) || chr(92) || ')' || chr(92) || '(b' || chr(92) || ') #' || p_brand
    WHEN 2 THEN '\u201c' || p_type || '\u201d \u2192 ~{^}<&>$' WHEN 3 THEN chr(92) || chr(92) || '(' || p_name || '\u00b2\uff0c' ELSE p_name END"""


def latex_escape(spark, sf_dir):
    tables(spark, sf_dir, "part")
    return spark.sql(f"SELECT p_partkey, {MATH} AS t FROM part").select("p_partkey", lx.escape_math(F.col("t")).alias("tex"))


def unicode_latex(spark, sf_dir):
    tables(spark, sf_dir, "part")
    return spark.sql(f"SELECT p_partkey, {MATH} AS t FROM part").select("p_partkey", lx.unicode_latex(F.col("t")).alias("tex"))


def sanitize_label(spark, sf_dir):
    tables(spark, sf_dir, "part")
    return spark.table("part").select("p_partkey", tx.sanitize_label(F.col("p_type")).alias("label"))


def api_url(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return spark.table("customer").select("c_custkey", request.api_url(F.concat(F.lit("http://h"), F.col("c_nationkey"), F.lit(":80//")), (F.col("c_custkey") % 3 * 1000).cast("int")).alias("url"))


def mime_by_ext(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".png", ".jpeg", ".gif", ".webp", ".txt", "")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return spark.table("customer").select("c_custkey", request.mime_type(F.concat("c_name", ext)).alias("mime"))


def batch_assign(spark, sf_dir):
    pages = parse.pages(tagged(spark, sf_dir))
    return request.batches(pages, 2).select("doc_id", "batch_no", "n", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


def resume_hash(spark, sf_dir):
    tables(spark, sf_dir, "orders")
    engine = F.when(F.col("o_orderkey") % 2 == 0, "baidu").otherwise("glm")
    recipe = request.recipe(engine, F.col("o_orderkey") % 4 - 1, F.col("o_custkey") % 3 + 1)
    fields = [F.concat(F.lit("/in/"), "o_orderkey"), F.col("o_custkey"), F.lit(7), F.col("o_orderpriority"), F.lit("m"), F.lit(200), F.lit("http://h/v1"), engine, recipe]
    return spark.table("orders").select("o_orderkey", request.resume_hash(*fields).alias("hash"))


def _chat(spark, sf_dir, batched):
    tables(spark, sf_dir, "conversations")
    uris = F.transform(F.sequence(F.lit(0), (F.col("turn") % 3).cast("int")), lambda i: F.concat(F.lit("data:"), i.cast("string")))
    made = request.chat_request(F.lit("m"), F.col("text"), uris, (F.col("conv_id") % 3 * 100).cast("int"), batched)
    return spark.table("conversations").select("conv_id", "turn", made.alias("body"))


def chat_request_glm(spark, sf_dir):
    return _chat(spark, sf_dir, False)


def chat_request_baidu(spark, sf_dir):
    return _chat(spark, sf_dir, True)


def label_stats(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when(layout.has_box(F.col("bbox")), 1).otherwise(0)).alias("boxed"))


def json_blocks(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    block = lambda i, text, box: F.concat(F.lit(f'{{"index":{i},"Label":"text","content":'), text, F.lit(',"bbox_2d":[1,'), box, F.lit(',3.9,4]}'))
    quoted = F.concat(F.lit('"part '), F.col("p"), F.lit('"'))
    blocks = F.concat(block(0, quoted, F.col("s")), F.lit(","), block(1, F.concat(F.lit("["), F.col("q"), F.lit(',"x"]')), F.lit('"2"')))
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("```json\n[["), blocks, F.lit("],[null]]\n```"))).when(F.col("k") % 3 == 1, F.concat(F.lit("so: ["), blocks, F.lit("] ok"))).otherwise(F.concat(F.lit("# a ["), F.col("p"), F.lit("\n\n- b]")))
    found = structured.contents(spark.sql(PER_ORDER).select(F.struct("doc_id", "k").alias("doc_id"), raw.alias("raw")))
    return found.select("doc_id.doc_id", "doc_id.k", "page_no", "ord", "index", "label", "content", F.element_at("bbox", 2).alias("y1"), "structured")


TAG = """CASE s % 6 WHEN 0 THEN ' note [' || CAST(p AS STRING) || ', x, +7, 12.7] ' WHEN 1 THEN 'a]b[' || CAST(p AS STRING) || ',2,3,4]' WHEN 2 THEN 'n[1,2,3,4,' || CAST(q AS STRING) || ']' WHEN 3 THEN '[ -' || CAST(p AS STRING) || ' ,2 ,3 , 4 ] x [9]'
    WHEN 4 THEN 'big [99999999999999999999,1,2,3]' ELSE ' note [' || CAST(p AS STRING) || ', ' || CAST(s AS STRING) || ', +7, 12.7] ' END"""


def tag_bbox(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(f"SELECT doc_id, k, {TAG} AS t FROM ({PER_ORDER})").select("doc_id", "k", parse.tag_label_box(F.col("t")).alias("t"))
    return rows.select("doc_id", "k", "t.label", _box("t.bbox").alias("box"))


BOXES = """CASE s % 6 WHEN 0 THEN '[1, ' || CAST(p AS STRING) || ', 3.9, -4.9]' WHEN 1 THEN '["1", 2, 3, ' || CAST(p AS STRING) || ']' WHEN 2 THEN '[1, 2, ' || CAST(q AS STRING) || ']' WHEN 3 THEN 'null'
    WHEN 4 THEN '[true, 1, 2, 3]' ELSE '[' || CAST(q AS STRING) || ', 2, 3, ' || CAST(p AS STRING) || '.5]' END"""


def bbox_coerce(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(f"""SELECT doc_id * 1000 + k AS doc_id, '[{{"content":"x","bbox_2d":' || {BOXES} || '}}]' AS raw FROM ({PER_ORDER})""")
    return structured.contents(rows).select("doc_id", "content", _box("bbox").alias("box"))


ITEM = """'  ' || CASE c_custkey % 9 WHEN 0 THEN '- ' WHEN 1 THEN '* ' WHEN 2 THEN CAST(c_nationkey AS STRING) || '. ' WHEN 3 THEN '-' WHEN 4 THEN '1.' WHEN 5 THEN 'a. ' WHEN 6 THEN '-' || chr(9) WHEN 7 THEN chr(9) || '3. ' ELSE '' END || c_name"""


def list_item_flags(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return spark.sql(f"SELECT c_custkey, {ITEM} AS t FROM customer").select("c_custkey", tx.is_list_item(F.col("t")).alias("item"))


FENCE = """CASE c_custkey % 6 WHEN 0 THEN ' ' || chr(96) || chr(96) || chr(96) || 'json' || chr(10) || c_name || chr(10) || '  b' || chr(10) || chr(96) || chr(96) || chr(96) WHEN 1 THEN chr(96) || chr(96) || chr(96) || 'json' || chr(10) || c_name || chr(96) || chr(96) || chr(96) WHEN 2 THEN chr(96) || chr(96) || chr(96) || c_name || chr(96) || chr(96) || chr(96)
    WHEN 3 THEN chr(96) || chr(96) || chr(96) || chr(10) || c_name || chr(10) || 'last line goes' WHEN 4 THEN 'x ' || chr(96) || chr(96) || chr(96) || c_name ELSE ' ' || c_name || chr(10) END"""


def fence_strip(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return spark.sql(f"SELECT c_custkey, {FENCE} AS t FROM customer").select("c_custkey", parse.strip_fence(F.col("t")).alias("text"))


HOLDER = """CASE c_custkey % 6 WHEN 0 THEN ' [EMPTY] ' WHEN 1 THEN '(no text)' WHEN 2 THEN c_name WHEN 3 THEN '[]' || chr(10) WHEN 4 THEN '[ ]' ELSE c_mktsegment END"""


def placeholder_filter(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return spark.sql(f"SELECT c_custkey, {HOLDER} AS text FROM customer").where(~tx.is_placeholder(F.col("text")))


def page_has_bbox(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.count_if(layout.has_box(F.col("bbox"))).alias("boxed"), F.count("*").alias("blocks"))


PIPES = """CASE c_custkey % 5 WHEN 0 THEN '| --- |' WHEN 1 THEN '|  ' || c_name || ' || ' || c_mktsegment || ' |' WHEN 2 THEN c_name || '|' || chr(9) || '| -- |' WHEN 3 THEN '|||' ELSE c_name || '---' END"""


def row_plain(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return spark.sql(f"SELECT c_custkey, {PIPES} AS t FROM customer").select("c_custkey", tx.row_plain(F.col("t")).alias("text"))


def data_uri(spark, sf_dir):
    tables(spark, sf_dir, "part")
    return spark.table("part").select("p_partkey", request.data_uri(F.lit("a.PNG"), F.encode(F.repeat("p_name", F.lit(9)), "UTF-8")).alias("uri"))


def image_dims(spark, sf_dir):
    tables(spark, sf_dir, "part")
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(F.col("p_partkey"), 8), hexed(F.col("p_size"), 8))
    jpeg = F.concat(F.lit("FFD8FFE00004ABCDFFC000110B"), hexed(F.col("p_size"), 4), hexed(F.col("p_partkey") % 60000, 4), F.lit("03"))
    content = F.unhex(F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, jpeg).otherwise("00"))
    return spark.table("part").select("p_partkey", images.image_size(content).alias("s")).select("p_partkey", "s.width", "s.height")


PROMPT = f"CASE c_custkey % 5 WHEN 0 THEN '{request.DEFAULT_PROMPT}' WHEN 1 THEN '<image>' || c_name WHEN 2 THEN c_name WHEN 3 THEN '{request.MULTI}' ELSE '{request.SINGLE}' END"


def prompt_recipe(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    rows = spark.sql(f"SELECT c_custkey, {PROMPT} AS t, c_nationkey % 3 AS pages, c_nationkey % 4 - 1 AS size FROM customer")
    recipe = request.recipe(F.when(F.col("c_custkey") % 2 == 0, "baidu").otherwise("glm"), F.col("size"), F.col("pages"))
    return rows.select("c_custkey", request.batch_prompt(F.col("t"), F.col("pages")).alias("batch"), request.document_prompt(F.col("t"), F.col("pages")).alias("document"), recipe.alias("recipe"))


def batch_concat(spark, sf_dir):
    tables(spark, sf_dir, "lineitem")
    return request.batch_concat(spark.sql(PER_ORDER).select("doc_id", F.col("k").alias("batch_no"), F.col("p").cast("string").alias("content")))


BODY = """CASE c_custkey % 5 WHEN 0 THEN '{"choices":[{"message":{"content":"' || c_name || '"}},{"message":{"content":"second"}}]}' WHEN 1 THEN '{"choices":[]}' WHEN 2 THEN '{"error":{"message":"' || c_mktsegment || '"},"choices":[{"message":{"content":"x"}}]}'
    WHEN 3 THEN '{"choices":[{"message":{"role":"' || c_name || '"}}]}' ELSE '{}' END"""


def response_content(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return spark.sql(f"SELECT c_custkey, {BODY} AS body FROM customer").select("c_custkey", request.response(F.col("body")).alias("r")).select("c_custkey", "r.content", "r.error")


def _cache(spark, sf_dir):
    tables(spark, sf_dir, "orders")
    o = spark.table("orders")
    pages = o.select(F.col("o_custkey").cast("string").alias("hash"), F.col("o_orderkey").alias("page_index"))
    cache = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("hash"), F.col("o_orderkey").alias("page_index"), F.explode(F.array(F.struct(F.lit("b").alias("content"), F.lit(2).alias("seq")), F.struct(F.col("o_orderstatus").alias("content"), F.lit(1).alias("seq")))).alias("c")).select("hash", "page_index", "c.*")
    return pages, cache


def cache_hits(spark, sf_dir):
    return request.cache_hits(*_cache(spark, sf_dir))


def cache_misses(spark, sf_dir):
    return request.cache_misses(*_cache(spark, sf_dir))


def rotation_map(spark, sf_dir):
    tables(spark, sf_dir, "nation")
    return spark.table("nation").select("n_nationkey", request.rotation(F.col("n_regionkey")).alias("rotation"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    split_pages, parse_det_blocks, parse_det_unclosed, row_cluster, row_order, horizontal_merge, table_islands,
    table_markdown, line_markdown, page_markdown, document_markdown, document_text, document_latex, page_meta,
    json_document, json_blocks_flat, parse_sibling, parse_lines, gibberish_flags, leak_flags, html_text, strip_refs,
    html_table_md, html_table_latex, latex_escape, unicode_latex, sanitize_label, api_url, mime_by_ext, batch_assign,
    resume_hash, chat_request_glm, chat_request_baidu, label_stats, json_blocks, tag_bbox, bbox_coerce,
    list_item_flags, fence_strip, placeholder_filter, page_has_bbox, row_plain, data_uri, image_dims, prompt_recipe,
    batch_concat, response_content, cache_hits, cache_misses, rotation_map,
)}

BOX = "array_to_string(bbox, ',')"
_ALL = f"WITH RECURSIVE {RAWS}, {o.chunks()}, {o.BLOCKS}"
_LAID = f"{_ALL}, {o.layout('blocks')}"
_MARKDOWN = o.rendered(RAWS, o.MARKDOWN, "content")
_SEGMENTS = f"{_MARKDOWN}, seen AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY k1, k2) - 1 AS INT) AS seg_no FROM segs)"
_META = "SELECT doc_id, page_no AS page, page_no * 100 AS width, length(chunk) AS height, 200 AS dpi, CASE WHEN (doc_id + page_no) % 5 IN (1, 2, 3) THEN (doc_id + page_no) % 5 * 90 ELSE 0 END AS rotation FROM chunks"


def _chat_sql(batched: bool) -> str:
    image = """array_to_string(list_transform(range(turn % 3 + 1), lambda i: '{"type":"image_url","image_url":{"url":"data:' || i || '"}}'), ',')"""
    text = """'{"type":"text","text":' || to_json(text) || '}'"""
    parts = f"{text} || ',' || {image}" if batched else f"{image} || ',' || {text}"
    more = """ || ',"skip_special_tokens":false,"images_config":{"image_mode":"' || CASE WHEN turn % 3 > 0 THEN 'base' ELSE 'gundam' END
        || '"},"custom_logit_processor":"DeepseekOCRNoRepeatNGramLogitProcessor","custom_params":{"ngram_size":35,"window_size":' || CASE WHEN turn % 3 > 0 THEN 1024 ELSE 128 END || '}' """
    tokens = "CASE WHEN conv_id % 3 > 0 THEN conv_id % 3 * 100 ELSE 8192 END"
    body = f"""'{{"model":"m","messages":[{{"role":"user","content":[' || {parts} || ']}}],"temperature":0,"max_tokens":' || {tokens}{more if batched else ""} || '}}'"""
    return f"SELECT conv_id, turn, {body} AS body FROM conversations"


#: A block begins at a line with a label and four numbers; the lines behind it are of its island.
_SIBLING = f"""
    WITH raws AS (SELECT doc_id, k, {SIBLING} AS raw FROM ({PER_ORDER})),
    split AS (SELECT doc_id, k, i, {o.trim("string_split(raw, chr(10))[i]")} AS line FROM (SELECT *, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS i FROM raws)),
    tags AS (SELECT *, {o.trim("regexp_extract(line, '^([^[]*[[][^]]*[]])', 1)")} AS tag FROM split WHERE line <> ''),
    starts AS (SELECT *, bbox IS NOT NULL AND label <> '' AS start FROM ({o.labelled("tags")})),
    islands AS (SELECT *, sum(CAST(start AS INT)) OVER (PARTITION BY doc_id, k ORDER BY i) AS g, bool_or(start) OVER (PARTITION BY doc_id, k) AS found FROM starts),
    joined AS (SELECT doc_id, k, g, CASE WHEN bool_or(start) THEN max(CASE WHEN start THEN label END) ELSE 'text' END AS label, max(CASE WHEN start THEN {BOX} END) AS box,
                      string_agg(nullif(CASE WHEN start THEN {o.content("substr(line, instr(line, ']') + 1)")} ELSE line END, ''), chr(10) ORDER BY i) AS content
               FROM islands WHERE found GROUP BY doc_id, k, g),
    whole AS (SELECT DISTINCT doc_id, k, 0 AS g, 'text' AS label, CAST(NULL AS VARCHAR) AS box, {o.trim("raw")} AS content FROM raws JOIN (SELECT DISTINCT doc_id, k FROM islands WHERE NOT found) USING (doc_id, k))
    SELECT doc_id, k, CAST(row_number() OVER (PARTITION BY doc_id, k ORDER BY g) - 1 AS INT) AS ord, label, coalesce(content, '') AS content, box FROM (SELECT doc_id, k, g, label, box, content FROM joined UNION ALL SELECT * FROM whole)
"""

#: A block joins the one before unless a table is between them or the gap to the largest right edge so far is wider.
_MERGED = f"""
    {_LAID}, ordered AS (SELECT *, box[1] - last_value(box[3]) OVER w > 100 OR lower(label) = 'table' AS far FROM cells WINDOW w AS (PARTITION BY doc_id, page_no, row_no ORDER BY col_no ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)),
    walked AS (
        SELECT doc_id, page_no, row_no, col_no, 0 AS g, box[3] AS edge FROM cells WHERE col_no = 0
        UNION ALL
        SELECT c.doc_id, c.page_no, c.row_no, c.col_no, CASE WHEN c.box[1] - w.edge <= 100 THEN w.g ELSE w.g + 1 END, CASE WHEN c.box[1] - w.edge <= 100 THEN greatest(w.edge, c.box[3]) ELSE c.box[3] END
        FROM walked w JOIN cells c ON c.doc_id = w.doc_id AND c.page_no = w.page_no AND c.row_no = w.row_no AND c.col_no = w.col_no + 1
    )
    SELECT doc_id, page_no, row_no, CAST(g AS INT) AS col_no, arg_min(label, col_no) AS label, coalesce(string_agg(nullif(content, ''), ' ' ORDER BY col_no), '') AS content, min(box[1]) AS x1, min(box[2]) AS y1, max(box[3]) AS x2, max(box[4]) AS y2
    FROM walked JOIN cells USING (doc_id, page_no, row_no, col_no) GROUP BY doc_id, page_no, row_no, g
"""

_JSON = f"""
    {_ALL}, metas AS ({_META}),
    m AS (SELECT doc_id, list({{'page': page, 'width': width, 'height': height, 'dpi': dpi, 'rotation': rotation}} ORDER BY page) AS pages FROM metas GROUP BY doc_id),
    b AS (SELECT doc_id, list({{'page': page_no, 'index': ord, 'label': label, 'content': content, 'bbox_2d': bbox}} ORDER BY page_no, ord) AS blocks FROM blocks WHERE doc_id % 8 <> 0 GROUP BY doc_id)
    SELECT doc_id, replace(replace(replace(CAST(to_json({{'source': 'order-<' || doc_id || '>', 'model': 'model', 'pages': pages, 'blocks': coalesce(blocks, [])}}) AS VARCHAR), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS json
    FROM m LEFT JOIN b USING (doc_id)
"""

FENCED = "chr(96) || chr(96) || chr(96)"
ORACLE_SQL: dict[str, str] = {
    "split_pages": f"WITH {RAWS}, {o.chunks()} SELECT doc_id, page_no, chunk FROM chunks",
    "parse_det_blocks": f"{_ALL} SELECT doc_id, page_no, ord, label, content, {BOX} AS box FROM blocks",
    "parse_det_unclosed": f"WITH raws AS (SELECT c_custkey AS doc_id, {UNCLOSED} AS raw FROM customer), {o.chunks()}, {o.BLOCKS} SELECT doc_id, page_no, ord, label, content, {BOX} AS box FROM blocks",
    "row_cluster": f"{_LAID} SELECT doc_id, page_no, row_no, col_no, ord, label, content FROM cells",
    "row_order": f"""{_LAID} SELECT doc_id, page_no, row_no, CAST(count(*) AS INT) AS n, string_agg(content, ' / ' ORDER BY col_no) AS contents,
        min(box[1]) || ',' || min(box[2]) || ',' || max(box[3]) || ',' || max(box[4]) AS box FROM cells GROUP BY doc_id, page_no, row_no""",
    "horizontal_merge": _MERGED,
    "table_islands": f"""{_SEGMENTS}, bodies AS (SELECT doc_id, page_no, fa AS k1, CAST(count(*) AS INT) AS n_rows, string_agg(array_to_string(cells, '/'), ';' ORDER BY row_no) AS cells FROM wide GROUP BY doc_id, page_no, fa)
        SELECT s.doc_id, s.page_no, seg_no, coalesce(n_rows, 0) AS n_rows, b.cells FROM seen s LEFT JOIN bodies b ON s.doc_id = b.doc_id AND s.page_no = b.page_no AND s.k1 = b.k1 AND s.k2 = 0""",
    "table_markdown": f"{_SEGMENTS} SELECT doc_id, page_no, seg_no, t FROM seen WHERE k2 = 0",
    "line_markdown": f"{_SEGMENTS} SELECT doc_id, page_no, seg_no, t FROM seen WHERE k2 = 1",
    "page_markdown": f"{_MARKDOWN} SELECT doc_id, page_no, t FROM pages",
    "document_markdown": f"{o.documents_markdown(RAWS)} SELECT doc_id, markdown FROM docs",
    "document_text": f"{o.documents_markdown(RAWS)} SELECT doc_id, {o.plain('markdown')} AS text FROM docs",
    "document_latex": f"""{o.rendered(RAWS, o.LATEX, o.escape_math(o.trim('content')))}
        SELECT doc_id, {o.quoted(render.PREAMBLE)} || string_agg(CASE WHEN page_no > 1 THEN '\\newpage' || chr(10) || chr(10) ELSE '' END || t, '' ORDER BY page_no) || '\\end{{document}}' || chr(10) AS latex FROM pages GROUP BY doc_id""",
    "page_meta": f"WITH {RAWS}, {o.chunks()} SELECT doc_id, page, width, CAST(height AS INT) AS height, dpi, CAST(rotation AS INT) AS rotation FROM ({_META})",
    "json_document": _JSON,
    "json_blocks_flat": f"{_ALL} SELECT doc_id, page_no AS page, ord AS idx, label, content, {BOX} AS box FROM blocks WHERE doc_id % 8 <> 0",
    "parse_sibling": _SIBLING,
    "gibberish_flags": f"SELECT conv_id, turn, {o.gibberish('t')} AS gibberish FROM (SELECT conv_id, turn, {NOISE} AS t FROM conversations)",
    "leak_flags": f"SELECT doc_id, {o.leaked('t')} AS leaked FROM (SELECT doc_id, {LEAK} AS t FROM documents)",
    "strip_refs": f"SELECT p_partkey, {o.strip_references('t')} AS text FROM (SELECT p_partkey, {REFS} AS t FROM part)",
    "html_text": f"SELECT page_id, {o.html_text('html')} AS text FROM pages",
    "html_table_md": f"SELECT o_orderkey, {o.html_table_markdown('t')} AS md FROM (SELECT o_orderkey, {HTML} AS t FROM orders)",
    "html_table_latex": f"SELECT o_orderkey, {o.html_table_latex('t')} AS tex FROM (SELECT o_orderkey, {HTML} AS t FROM orders)",
    "latex_escape": f"SELECT p_partkey, {o.escape_math('t')} AS tex FROM (SELECT p_partkey, {MATH} AS t FROM part)",
    "unicode_latex": f"SELECT p_partkey, {o.unicode_latex('t')} AS tex FROM (SELECT p_partkey, {MATH} AS t FROM part)",
    "tag_bbox": f"WITH tags AS (SELECT doc_id, k, {o.trim(TAG)} AS tag FROM ({PER_ORDER})) SELECT doc_id, k, label, {BOX} AS box FROM ({o.labelled('tags')})",
    "bbox_coerce": f"""SELECT doc_id, 'x' AS content, CASE WHEN n = 4 AND len(list_filter(kinds, lambda t: t IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 4
        THEN array_to_string(list_transform(range(4), lambda i: CAST(trunc(CAST(json_extract_string(j, '$[' || i || ']') AS DOUBLE)) AS BIGINT)), ',') END AS box
        FROM (SELECT doc_id, j, json_array_length(j) AS n, list_transform(range(4), lambda i: json_type(j, '$[' || i || ']')) AS kinds FROM (SELECT doc_id * 1000 + k AS doc_id, CAST({BOXES} AS JSON) AS j FROM ({PER_ORDER})))""",
    "list_item_flags": rf"SELECT c_custkey, regexp_matches({o.trim('t')}, '^([-*] |[0-9]+\. )') AS item FROM (SELECT c_custkey, {ITEM} AS t FROM customer)",
    "fence_strip": f"""
        WITH t AS (SELECT c_custkey, {o.trim(FENCE)} AS t FROM customer), l AS (SELECT *, string_split(t, chr(10)) AS l FROM t)
        SELECT c_custkey, CASE WHEN NOT starts_with(t, {FENCED}) THEN t WHEN len(l) > 2 THEN {o.trim("array_to_string(l[2:len(l) - 1], chr(10))")}
                               ELSE {o.trim("regexp_replace(regexp_replace(t, '^`+|`+$', '', 'g'), '^json' || chr(10), '')")} END AS text FROM l""",
    "placeholder_filter": f"SELECT * FROM (SELECT c_custkey, {HOLDER} AS text FROM customer) WHERE lower({o.trim('text')}) NOT IN {o.listed(tx.PLACEHOLDERS)}",
    "page_has_bbox": f"{_ALL} SELECT doc_id, page_no, count(bbox) AS boxed, count(*) AS blocks FROM blocks GROUP BY ALL",
    "label_stats": f"{_ALL} SELECT label, count(*) AS n, count(bbox) AS boxed FROM blocks GROUP BY label",
    "batch_assign": f"""WITH {RAWS}, {o.chunks()} SELECT doc_id, CAST((page_no - 1) // 2 AS BIGINT) AS batch_no, count(*) AS n, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS pages
        FROM chunks GROUP BY doc_id, batch_no""",
    "row_plain": f"SELECT c_custkey, {o.row_plain('t')} AS text FROM (SELECT c_custkey, {PIPES} AS t FROM customer)",
    "prompt_recipe": f"""
        WITH t AS (SELECT c_custkey, {PROMPT} AS t, c_nationkey % 3 AS pages, c_nationkey % 4 - 1 AS size FROM customer),
        d AS (SELECT *, CASE WHEN t <> '{request.DEFAULT_PROMPT}' THEN t WHEN pages > 1 THEN '{request.MULTI}' ELSE '{request.SINGLE}' END AS own FROM t)
        SELECT c_custkey, CASE WHEN t IN ('{request.DEFAULT_PROMPT}', '{request.MULTI}', '{request.SINGLE}') THEN CASE WHEN pages > 1 THEN '{request.MULTI}' ELSE '{request.SINGLE}' END
                               WHEN starts_with(t, '<image>') THEN t ELSE '<image>' || t END AS batch,
               CASE WHEN starts_with(own, '<image>') THEN own ELSE '<image>' || own END AS document,
               CASE WHEN c_custkey % 2 = 1 THEN '' WHEN CASE WHEN size > 0 THEN size > 1 ELSE pages > 1 END THEN 'window_size=1024' ELSE 'window_size=128' END AS recipe FROM d""",
    "response_content": f"""
        SELECT c_custkey, CASE WHEN json_extract(j, '$.error') IS NULL AND json_array_length(j, '$.choices') > 0 THEN coalesce(json_extract_string(j, '$.choices[0].message.content'), '') END AS content,
               CASE WHEN json_extract(j, '$.error') IS NOT NULL THEN json_extract_string(j, '$.error.message') WHEN coalesce(json_array_length(j, '$.choices'), 0) = 0 THEN 'no choices' END AS error
        FROM (SELECT c_custkey, CAST({BODY} AS JSON) AS j FROM customer)""",
    "chat_request_glm": _chat_sql(False),
    "chat_request_baidu": _chat_sql(True),
    "resume_hash": """SELECT o_orderkey, sha256(concat_ws('|', '/in/' || o_orderkey, o_custkey, 7, o_orderpriority, 'm', 200, 'http://h/v1', CASE WHEN o_orderkey % 2 = 0 THEN 'baidu' ELSE 'glm' END,
        CASE WHEN o_orderkey % 2 = 1 THEN '' WHEN CASE WHEN o_orderkey % 4 - 1 > 0 THEN o_orderkey % 4 - 1 > 1 ELSE o_custkey % 3 + 1 > 1 END THEN 'window_size=1024' ELSE 'window_size=128' END)) AS hash FROM orders""",
    "parse_lines": rf"""
        WITH l AS (SELECT doc_id, i, regexp_replace(string_split(coalesce(text, ''), chr(10))[i], '^{o.WHITE}+|{o.WHITE}+$', '', 'g') AS content
                   FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS ord,
               CASE WHEN content LIKE '#%' THEN 'title' WHEN regexp_matches(content, '^([-*] |[0-9]+\. )') THEN 'list_item' ELSE 'text' END AS label, content
        FROM l WHERE content <> ''
    """,
    "sanitize_label": "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '-', 'g') AS label FROM part",
    "api_url": "SELECT c_custkey, 'http://h' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ':80' ELSE ':' || (c_custkey % 3 * 1000) END || '/v1/chat/completions' AS url FROM customer",
    "mime_by_ext": "SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' ELSE 'application/octet-stream' END AS mime FROM customer",
    "json_blocks": f"""
        WITH r AS ({PER_ORDER})
        SELECT doc_id, k, CAST(1 AS INT) AS page_no, CAST(0 AS INT) AS ord, CAST(0 AS BIGINT) AS index, 'text' AS label, 'part ' || p AS content, s AS y1, true AS structured FROM r WHERE k % 3 < 2
        UNION ALL SELECT doc_id, k, 1, 1, 1, 'text', q || chr(10) || 'x', NULL, true FROM r WHERE k % 3 < 2
        UNION ALL SELECT doc_id, k, 1, 0, 0, 'title', '# a [' || p, NULL, false FROM r WHERE k % 3 = 2
        UNION ALL SELECT doc_id, k, 1, 1, 1, 'list_item', '- b]', NULL, false FROM r WHERE k % 3 = 2
    """,
    "data_uri": "SELECT p_partkey, 'data:image/png;base64,' || to_base64(encode(repeat(p_name, 9))) AS uri FROM part",
    "image_dims": "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey % 60000 ELSE 0 END AS INT) AS width, CAST(CASE WHEN p_partkey % 3 < 2 THEN p_size ELSE 0 END AS INT) AS height FROM part",
    "batch_concat": f"WITH r AS ({PER_ORDER}) SELECT doc_id, string_agg(CAST(p AS VARCHAR), '<PAGE>' ORDER BY k) AS raw FROM r GROUP BY doc_id",
    "cache_hits": "SELECT CAST(o_custkey AS VARCHAR) AS hash, o_orderkey AS page_index, o_orderstatus AS content FROM orders WHERE o_orderkey % 3 = 0",
    "cache_misses": "SELECT CAST(o_custkey AS VARCHAR) AS hash, o_orderkey AS page_index FROM orders WHERE o_orderkey % 3 <> 0",
    "rotation_map": "SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 2, 3) THEN n_regionkey * 90 ELSE 0 END AS rotation FROM nation",
}
