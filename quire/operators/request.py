"""Model requests and responses, page batches and cache keys, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PROMPT = "Extract all text from this document"
MULTI, SINGLE = "<image>Multi page parsing.", "<image>document parsing."


def api_url(endpoint: Column, port: Column) -> Column:
    base = F.regexp_replace(endpoint, "/+$", "")
    last = F.length(base) - F.locate(":", F.reverse(base)) + 1
    cut = F.when(F.contains(base, F.lit(":")) & (last > F.locate("//", base)), F.substring(base, F.lit(1), last - 1)).otherwise(base)
    return F.concat(F.when(port != 0, F.concat(cut, F.lit(":"), port.cast("string"))).otherwise(base), F.lit("/v1/chat/completions"))


def mime_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    kinds = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}
    out = F.lit("application/octet-stream")
    for k, v in kinds.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def batch_prompt(prompt: Column, size: Column) -> Column:
    return F.when(prompt.isin(DEFAULT_PROMPT, MULTI, SINGLE), F.when(size > 1, MULTI).otherwise(SINGLE)).when(prompt.startswith("<image>"), prompt).otherwise(F.concat(F.lit("<image>"), prompt))


def document_prompt(prompt: Column, pages: Column) -> Column:
    """The prompt of a whole document in the batched dialect, which is part of its cache key."""
    own = F.when(prompt == DEFAULT_PROMPT, F.when(pages > 1, MULTI).otherwise(SINGLE)).otherwise(prompt)
    return F.when(own.startswith("<image>"), own).otherwise(F.concat(F.lit("<image>"), own))


def recipe(engine: Column, batch_size: Column, pages: Column) -> Column:
    """The settings that a cache key has besides the request; empty but for the batched dialect."""
    multi = F.when(batch_size > 0, batch_size > 1).otherwise(pages > 1)
    return F.when(engine == "baidu", F.concat(F.lit("window_size="), F.when(multi, "1024").otherwise("128"))).otherwise("")


def batches(pages: DataFrame, size: int = 0) -> DataFrame:
    """doc_id, batch_no, n, pages: consecutive pages in groups; a size of zero or less is one."""
    size = max(1, size)
    return pages.groupBy("doc_id", F.floor((F.col("page_no") - 1) / size).alias("batch_no")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("page_no")).alias("pages"))


def batch_concat(raw: DataFrame) -> DataFrame:
    """doc_id, raw: the texts of a document's batches with page marks between."""
    one = F.array_sort(F.collect_list(F.struct("batch_no", "content")))
    return raw.groupBy("doc_id").agg(F.array_join(F.transform(one, lambda x: x["content"]), "<PAGE>").alias("raw"))


def chat_request(model: Column, prompt: Column, uris: Column, max_tokens: Column, batched: bool) -> Column:
    """The request body; the batched dialect has the text first and settings of its own."""
    image = F.transform(uris, lambda u: F.struct(F.lit("image_url").alias("type"), F.struct(u.alias("url")).alias("image_url"), F.lit(None).cast("string").alias("text")))
    text = F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<url:string>").alias("image_url"), prompt.alias("text")))
    tokens = F.when(max_tokens > 0, max_tokens).otherwise(8192)
    fields = [model.alias("model"), F.array(F.struct(F.lit("user").alias("role"), (F.concat(text, image) if batched else F.concat(image, text)).alias("content"))).alias("messages"), F.lit(0).alias("temperature"), tokens.alias("max_tokens")]
    if batched:
        multi = F.size(uris) > 1
        fields += [
            F.lit(False).alias("skip_special_tokens"), F.struct(F.when(multi, "base").otherwise("gundam").alias("image_mode")).alias("images_config"),
            F.lit("DeepseekOCRNoRepeatNGramLogitProcessor").alias("custom_logit_processor"), F.struct(F.lit(35).alias("ngram_size"), F.when(multi, 1024).otherwise(128).alias("window_size")).alias("custom_params"),
        ]
    return F.to_json(F.struct(*fields))


def response(body: Column) -> Column:
    """struct<content, error> of a response."""
    r = F.from_json(body, "choices array<struct<message struct<content string>>>, error struct<message string>")
    none = F.coalesce(F.size(r["choices"]), F.lit(0)) <= 0
    error = F.when(r["error"].isNotNull(), r["error"]["message"]).when(none, "no choices")
    return F.struct(F.when(error.isNull(), F.coalesce(F.get(r["choices"], F.lit(0))["message"]["content"], F.lit(""))).alias("content"), error.alias("error"))


def resume_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def rotation(code: Column) -> Column:
    return F.when(code.isin(1, 2, 3), code * 90).otherwise(0)


def cache_hits(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages with the first cached content of each."""
    first = cache.groupBy("hash", "page_index").agg(F.min_by("content", "seq").alias("content"))
    return pages.join(first, ["hash", "page_index"])


def cache_misses(pages: DataFrame, cache: DataFrame) -> DataFrame:
    return pages.join(cache, ["hash", "page_index"], "left_anti")
