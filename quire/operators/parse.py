"""Raw recognizer text into pages and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_list_item, let, strip_references, trim

OPEN, CLOSE = "<|det|>", "<|/det|>"


def _without_tags(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))


def tag_label_box(tag: Column) -> Column:
    """struct<label, bbox> of a tag's payload; bbox is null unless there are four leading integers."""

    def box(tag: Column, at: Column) -> Column:
        inside = F.split(F.substring(tag, at["a"] + 1, at["b"] - at["a"] - 1), ",", -1)
        nums = F.transform(inside, lambda p: F.regexp_extract(trim(p), "^[+-]?[0-9]+", 0).try_cast("bigint"))
        return F.when(F.size(inside) == 4, let(nums, lambda ns: F.when(~F.exists(ns, lambda n: n.isNull()), ns)))

    def made(tag: Column) -> Column:
        at = F.struct(F.locate("[", tag).alias("a"), F.locate("]", tag).alias("b"))
        whole = lambda at: F.struct(trim(F.substring(tag, F.lit(1), at["a"] - 1)).alias("label"), box(tag, at).alias("bbox"))
        bare = F.struct(tag.alias("label"), F.lit(None).cast("array<bigint>").alias("bbox"))
        return let(at, lambda at: F.when((at["a"] > 0) & (at["b"] > at["a"]), whole(at)).otherwise(bare))

    return let(trim(tag), made)


def strip_fence(c: Column) -> Column:
    c = trim(c)
    lines = F.split(c, "\n", -1)
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    bare = F.regexp_replace(F.regexp_replace(c, "^`+|`+\\z", ""), "^json\n", "")
    return F.when(c.startswith("```"), trim(F.when(F.size(lines) > 2, inner).otherwise(bare))).otherwise(c)


def pages(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """doc_id, page_no, chunk: text cut at page marks; a blank first chunk goes, other blank ones stay."""
    text = trim(F.col(raw))
    parts = F.split(text, "<PAGE>", -1)
    first = (F.size(parts) > 1) & (trim(F.get(parts, F.lit(0))) == "")
    kept = F.when(first, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return docs.select("doc_id", F.posexplode(kept).alias("i", "chunk")).select("doc_id", (F.col("i") + 1).alias("page_no"), "chunk")


def _block(label: Column, content: Column, bbox: Column) -> Column:
    return F.struct(label.alias("label"), content.alias("content"), bbox.cast("array<bigint>").alias("bbox"))


BLOCKS = "array<struct<label:string,content:string,bbox:array<bigint>>>"


def _tagged(whole: Column) -> Column:
    """The block of a tag's text, which holds a closer."""
    at = F.locate(CLOSE, whole)
    content = _without_tags(strip_references(trim(F.substring(whole, at + len(CLOSE), F.length(whole)))))
    return let(tag_label_box(F.substring(whole, F.lit(1), at - 1)), lambda tag: _block(tag["label"], content, tag["bbox"]))


def tagged_blocks(chunk: Column) -> Column:
    """Blocks of a chunk with opening tags. A tag without a closer of its own takes the next ones into its label."""
    none = F.array().cast(BLOCKS)

    def swallowed(parts: Column) -> Column:
        """Texts of tags, those without a closer with the next ones; the last is null or what no closer follows."""
        state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"))

        def step(s: Column, p: Column) -> Column:
            whole = F.when(s["open"].isNull(), p).otherwise(F.concat(s["open"], F.lit(OPEN), p))
            done = F.struct(F.array_append(s["out"], whole).alias("out"), F.lit(None).cast("string").alias("open"))
            return F.when(F.contains(p, F.lit(CLOSE)), done).otherwise(F.struct(s["out"].alias("out"), whole.alias("open")))

        return F.aggregate(parts, state, step, lambda s: F.array_append(s["out"], s["open"]))

    def all_(parts: Column) -> Column:
        lead = let(trim(F.get(parts, F.lit(0))), lambda x: F.when(x != "", F.array(_block(F.lit("text"), x, F.lit(None)))).otherwise(none))
        tags = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        closed = lambda tags: F.forall(tags, lambda p: F.contains(p, F.lit(CLOSE)))

        def odd(texts: Column) -> Column:
            n = F.size(texts)
            last = F.element_at(texts, -1)
            rest = F.when(last.isNull(), none).otherwise(F.array(_block(F.lit("text"), trim(last), F.lit(None))))
            return F.concat(F.transform(F.slice(texts, F.lit(1), n - 1), _tagged), rest)

        return F.concat(lead, let(tags, lambda tags: F.when(closed(tags), F.transform(tags, _tagged)).otherwise(let(swallowed(tags), odd))))

    return let(F.split(chunk, r"<\|det\|>", -1), all_)


def sibling_blocks(chunk: Column) -> Column:
    """Blocks of lines `label [a, b, c, d] content`; other lines go on with the block before. Without any, one block."""
    lines = F.filter(F.transform(F.split(chunk, "\n", -1), trim), lambda x: x != "")

    def parsed(line: Column) -> Column:
        tag = tag_label_box(F.regexp_extract(line, r"^([^\[]*\[[^\]]*\])", 1))
        content = _without_tags(strip_references(trim(F.substring(line, F.locate("]", line) + 1, F.length(line)))))
        starts = lambda t: t["bbox"].isNotNull() & (t["label"] != "")
        return let(tag, lambda t: F.struct(starts(t).alias("starts"), F.when(starts(t), _block(t["label"], content, t["bbox"])).otherwise(_block(F.lit("text"), line, F.lit(None))).alias("b")))

    def step(out: Column, x: Column) -> Column:
        n = F.size(out)
        prev = F.element_at(out, -1)
        line = x["b"]["content"]
        joined = _block(prev["label"], F.when(prev["content"] == "", line).otherwise(F.concat(prev["content"], F.lit("\n"), line)), prev["bbox"])
        return F.when(x["starts"] | (n == 0), F.array_append(out, x["b"])).otherwise(F.array_append(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), joined))

    whole = F.array(_block(F.lit("text"), trim(chunk), F.lit(None)))
    found = lambda xs: F.when(F.exists(xs, lambda x: x["starts"]), F.aggregate(xs, F.array().cast(BLOCKS), step)).otherwise(whole)
    return let(F.transform(lines, parsed), found)


def chunk_blocks(chunk: Column) -> Column:
    """Blocks of a page's text in either dialect."""
    return F.when(F.contains(chunk, F.lit(OPEN)), tagged_blocks(chunk)).otherwise(sibling_blocks(chunk))


def page_blocks(pages_: DataFrame) -> DataFrame:
    """doc_id, page_no, blocks: a row for each page, in the order and partitioning of pages."""
    return pages_.select("doc_id", "page_no", chunk_blocks(F.col("chunk")).alias("blocks"))


def blocks(pages_: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, label, content, bbox of the blocks of pages."""
    return page_blocks(pages_).select("doc_id", "page_no", F.posexplode("blocks").alias("ord", "b")).select("doc_id", "page_no", "ord", "b.*")


def lines_of(raw: Column) -> Column:
    """Lines of unstructured text that aren't blank; without any, the text itself."""
    lines = F.filter(F.transform(F.split(strip_fence(raw), "\n", -1), trim), lambda x: x != "")
    return F.when(F.size(lines) == 0, F.array(trim(raw))).otherwise(lines)


def line_label(line: Column) -> Column:
    return F.when(line.startswith("#"), "title").when(is_list_item(line), "list_item").otherwise("text")


def line_blocks(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """doc_id, ord, label, content: each line of unstructured text as a block; without lines, one block of the text.

    That block is a text, whatever it begins with.
    """
    out = docs.select("doc_id", F.posexplode(lines_of(F.col(raw))).alias("ord", "content"))
    return out.select("doc_id", "ord", line_label(F.col("content")).alias("label"), "content")
