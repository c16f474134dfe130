"""Recognizer text that holds JSON: an array of pages of blocks, or of blocks; else its lines become blocks.

Decoding is strict: one value and nothing behind it, types as expected, missing or null fields as zero values, field
names in any case, the last of repeated ones. Spark's own JSON functions are lenient, so this step alone is an Arrow
function, and it gets nothing of texts without brackets.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import trim
from quire.operators.parse import line_label, lines_of, strip_fence

BLOCK = "struct<index:bigint,label:string,content:string,bbox:array<bigint>,content_json:string,bbox_json:string>"
_FIELDS = [("index", pa.int64()), ("label", pa.string()), ("content", pa.string()), ("bbox", pa.list_(pa.int64())), ("content_json", pa.string()), ("bbox_json", pa.string())]
_PAGES = pa.list_(pa.list_(pa.struct(_FIELDS)))
_LONE = re.compile("[\ud800-\udfff]")


def number_text(x: float) -> str:
    """The shortest digits that give the number back, with an exponent if that is below -4 or from 6 on."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    text, power = "".join(map(str, digits)), len(digits) + exponent - 1
    if power < -4 or power >= 6:
        out = text[0] + ("." + text[1:] if text[1:] else "") + f"e{'-' if power < 0 else '+'}{abs(power):02d}"
    elif power < 0:
        out = "0." + "0" * (-power - 1) + text
    else:
        out = text[: power + 1].ljust(power + 1, "0") + ("." + text[power + 1 :] if text[power + 1 :] else "")
    return ("-" if sign else "") + out


def value_text(v: Any) -> str:
    """A decoded value in default formatting."""
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "[" + " ".join(map(value_text, v)) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{value_text(v[k])}" for k in sorted(v, key=str.encode)) + "]"
    return number_text(float(v))


def content_text(v: Any) -> str:
    return "\n".join(map(value_text, v)) if isinstance(v, list) else value_text(v)


def box(v: Any) -> list[int] | None:
    """Four numbers, fractions cut off; nothing else."""
    if isinstance(v, list) and len(v) == 4 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v):
        return [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in v]
    return None


class _Object(list):
    """Fields of an object in their order, repeated ones too."""


def _plain(v: Any) -> Any:
    if isinstance(v, _Object):
        return {k: _plain(x) for k, x in v}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _block(v: Any) -> dict:
    fields = {"index": 0, "label": "", "content": None, "bbox_2d": None}
    if v is not None:
        if not isinstance(v, _Object):
            raise ValueError("no object")
        for k, x in v:
            k = k.lower()
            if k == "index" and x is not None:
                if isinstance(x, bool) or not isinstance(x, int) or not -(1 << 63) <= x < 1 << 63:
                    raise ValueError("no whole number")
                fields[k] = x
            elif k == "label" and x is not None:
                if not isinstance(x, str):
                    raise ValueError("no string")
                fields[k] = x
            elif k in ("content", "bbox_2d"):
                fields[k] = _plain(x)
    content, bbox = fields["content"], fields["bbox_2d"]
    return {"index": fields["index"], "label": fields["label"], "content": content_text(content), "bbox": box(bbox), "content_json": json.dumps(content), "bbox_json": json.dumps(bbox)}


def _refuse(name: str) -> None:
    raise ValueError(name)


def _float(text: str) -> float:
    if math.isinf(x := float(text)):
        raise ValueError("out of range")
    return x


def decode(text: str) -> list[list[dict]] | None:
    """Pages of blocks from the first opening to the last closing bracket; None if that is no such array."""
    start, end = text.find("["), text.rfind("]")
    if start < 0 or end <= start:
        return None
    try:
        value = json.loads(text[start : end + 1], object_pairs_hook=_Object, parse_constant=_refuse, parse_float=_float)
    except (ValueError, RecursionError):
        return None
    if isinstance(value, _Object) or not isinstance(value, list) or not value:
        return None
    if all(p is None or (isinstance(p, list) and not isinstance(p, _Object)) for p in value):
        tries = [lambda: [[_block(b) for b in p or []] for p in value], lambda: [[_block(b) for b in value]]]
    else:
        tries = [lambda: [[_block(b) for b in value]]]
    for made in tries:
        try:
            return made()
        except ValueError:
            continue
    return None


def _scrubbed(pages: list[list[dict]]) -> list[list[dict]]:
    for p in pages:
        for b in p:
            b["label"], b["content"] = _LONE.sub("�", b["label"]), _LONE.sub("�", b["content"])
    return pages


def _decoded(clean: pa.Array, raw: pa.Array) -> pa.Array:
    out = []
    for c, r in zip(clean.to_pylist(), raw.to_pylist(), strict=True):
        pages = None if c is None else decode(c)
        if pages is None and r is not None and r != c:
            pages = decode(r)
        out.append(pages and _scrubbed(pages))
    return pa.array(out, _PAGES)


def structured_pages(raw: Column) -> Column:
    """array<array<block>> of text that holds JSON, else null."""
    text = trim(raw)
    held = F.contains(text, F.lit("[")) & F.contains(text, F.lit("]"))
    return F.arrow_udf(_decoded, f"array<array<{BLOCK}>>")(F.when(held, strip_fence(text)), F.when(held, text))


def contents(docs: DataFrame, raw: str = "raw", first_page: bool = True) -> DataFrame:
    """doc_id, page_no, ord, index, label, content, bbox, content_json, bbox_json, structured of the blocks in a recognizer's answer.

    content and bbox are text and four numbers, content_json and bbox_json the values as they stand in the answer.

    With first_page, pages behind the first are dropped, as an answer is for one page. A null answer is empty; an
    answer without JSON has a block for each line, and one empty block if it has no lines. A page without blocks has
    no rows, nor has an empty table.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    line = lambda x, i: F.struct(i.cast("bigint").alias("index"), line_label(x).alias("label"), x.alias("content"), F.lit(None).cast("array<bigint>").alias("bbox"), F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "").alias("content_json"), F.lit("null").alias("bbox_json"))
    found = docs.select("doc_id", text.alias("t"), structured_pages(text).alias("p"))
    pages = found.select("doc_id", F.coalesce("p", F.array(F.transform(lines_of(F.col("t")), line))).alias("p"), F.col("p").isNotNull().alias("structured"))
    kept = pages.select("doc_id", "structured", F.posexplode(F.slice("p", 1, 1) if first_page else F.col("p")).alias("n", "page"))
    blocks = kept.select("doc_id", (F.col("n") + 1).alias("page_no"), "structured", F.posexplode("page").alias("ord", "b"))
    return blocks.select("doc_id", "page_no", "ord", "b.*", "structured")
