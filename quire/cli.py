"""The command line: files to documents through a recognizer. `python -m quire.cli scan.png --endpoint http://host`."""

from __future__ import annotations

import argparse
import contextlib
import os
import shutil
import sys
import threading
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import progress
from quire.operators import parse, render, request, structured
from quire.sources import images, recognizer

# Models of the two dialects.
VERSION = "0.2"
MODELS = {"glm": "zai-org/GLM-OCR", "baidu": "baidu/Unlimited-OCR"}


@dataclass(frozen=True)
class Options:
    endpoint: str = "http://localhost"
    port: int = 0
    model: str = ""
    prompt: str = request.DEFAULT_PROMPT
    output: str = ""
    text: bool = False
    json: bool = False
    latex: bool = False
    raw: bool = False
    dpi: int = 200
    engine: str = "glm"
    max_tokens: int = 0
    batch_size: int = 0
    resume: bool = False

    @property
    def own_model(self) -> str:
        """The model; the batched dialect has its own instead of none or the other's default."""
        return MODELS["baidu"] if self.batched and self.model in ("", MODELS["glm"]) else self.model or MODELS["glm"]

    @property
    def batched(self) -> bool:
        return self.engine.lower() == "baidu"

    @property
    def kind(self) -> str:
        """json before text before latex before markdown."""
        return next((k for k in ("json", "text", "latex") if getattr(self, k)), "markdown")


def arguments(args: Sequence[str]) -> tuple[str, Options]:
    p = argparse.ArgumentParser("quire", allow_abbrev=False, description="Recognizes a file's pages and writes them as one document.")
    p.add_argument("file")
    for name, kind in (("endpoint", str), ("port", int), ("model", str), ("prompt", str), ("output", str), ("dpi", int), ("engine", str), ("max-tokens", int), ("batch-size", int)):
        p.add_argument(f"-{name}", f"--{name}", type=kind, default=getattr(Options, name.replace("-", "_")))
    p.add_argument("-version", "--version", action="version", version=f"%(prog)s {VERSION}")
    for name in ("text", "json", "latex", "raw", "markdown", "bbox", "baidu", "resume"):
        p.add_argument(f"-{name}", f"--{name}", action="store_true")
    found = vars(p.parse_args(list(args)))
    file, _, _ = found.pop("file"), found.pop("markdown"), found.pop("bbox")
    if found.pop("baidu"):
        found["engine"] = "baidu"
    return file, Options(**found)


def answers(pages: DataFrame, o: Options, client: recognizer.Client) -> DataFrame:
    """doc_id, page_no or batch_no, content, error of pages (doc_id, page_no, uri)."""
    model = F.lit(o.own_model)
    url = request.api_url(F.lit(o.endpoint), F.lit(o.port))
    if o.batched:
        groups = request.batches(pages, o.batch_size)
        uris = pages.withColumn("batch_no", F.floor((F.col("page_no") - 1) / max(1, o.batch_size))).groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "uri"))).alias("u"))
        rows = groups.join(uris, ["doc_id", "batch_no"]).withColumn("uris", F.transform("u", lambda x: x["uri"]))
        asked = rows.select("doc_id", "batch_no", url.alias("url"), request.chat_request(model, request.batch_prompt(F.lit(o.prompt), F.col("n")), F.col("uris"), F.lit(o.max_tokens), True).alias("body"))
    else:
        asked = pages.select("doc_id", "page_no", url.alias("url"), request.chat_request(model, F.lit(o.prompt), F.array("uri"), F.lit(o.max_tokens), False).alias("body"))
    return recognizer.recognize(asked, client)


def documents(got: DataFrame, o: Options, metas: DataFrame, source: str) -> DataFrame:
    """doc_id and one column with the document, of answers without errors. metas: doc_id, page, width, height, dpi, rotation."""
    if o.batched:
        whole = request.batch_concat(got)
        if o.raw:
            return whole
        pages = parse.pages(whole)
        blocks = parse.blocks(pages)
    else:
        if o.raw:
            return got.select("doc_id", "page_no", "content").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "content"))), lambda x: x["content"]), "\n").alias("raw"))
        one = structured.contents(got.select(F.struct("doc_id", "page_no").alias("doc_id"), F.col("content").alias("raw")))
        blocks = one.select("doc_id.doc_id", "doc_id.page_no", "ord", "index", "label", "content", "bbox", "content_json", "bbox_json")
        pages = got.select("doc_id", "page_no")
    if o.kind == "json":
        made = render.json_documents(blocks, metas, F.lit(source), o.own_model)
        return made.select("doc_id", render.indented(F.col("json")).alias("json"))
    if o.kind == "latex":
        return render.latex(blocks, pages)
    made = render.markdown(blocks, pages)
    return made.select("doc_id", render.plain(F.col("markdown")).alias("text")) if o.kind == "text" else made


def kept_answers(file: str, o: Options, pages: int) -> str:
    """The folder of a file's answers: one for each state of the file and way of asking."""
    stat, one = os.stat(file), SparkSession.active().range(1)
    prompt = request.document_prompt(F.lit(o.prompt), F.lit(pages)) if o.batched else F.lit(o.prompt)
    url, recipe = request.api_url(F.lit(o.endpoint), F.lit(o.port)), request.recipe(F.lit(o.engine.lower()), F.lit(o.batch_size), F.lit(pages))
    fields = [F.lit(x) for x in (os.path.abspath(file), stat.st_mtime_ns, stat.st_size)] + [prompt, F.lit(o.own_model), F.lit(o.dpi), url, F.lit(o.engine.lower()), recipe]
    top = os.environ.get("XDG_CACHE_HOME") or (os.path.join(os.environ["HOME"], ".cache") if "HOME" in os.environ else "")
    name = one.select(request.resume_hash(*fields)).first()[0]
    return str(Path(top, "quire", name) if top else Path(".quire-cache", name))


@contextlib.contextmanager
def shown(total: int, counted, status: str) -> Iterator[None]:
    """Draws progress on a terminal until what is inside is done. counted: an accumulator of pages."""
    began, over = time.time(), threading.Event()
    draw = lambda done, text: print(progress.bar(done, total, time.time() - began, text, sys.stderr), end="", file=sys.stderr, flush=True)

    def loop() -> None:
        while not over.wait(0.5):
            draw(min(total, counted.value), status)

    if not progress.is_terminal(sys.stderr):
        yield
        return
    thread = threading.Thread(target=loop, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        draw(min(total, counted.value), "")
        print(file=sys.stderr)


def main(args: Sequence[str] | None = None, client: recognizer.Client = recognizer.http_client, rasterizer: images.Factory | None = None) -> int:
    """Writes the document of one file, or prints it; 1 on errors.

    With -resume, each answer is kept as it comes, what is kept isn't asked for again, and all goes once the document is
    written; a raw document leaves it.
    """
    file, o = arguments(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.getOrCreate()
    files = images.scan(spark, file)
    found = images.page_images(files, rasterizer, o.dpi).select(F.lit(0).cast("long").alias("doc_id"), (F.col("page_index") + 1).alias("page_no"), "uri", "width", "height", "dpi", "rotation").cache()
    total = found.count()
    folder = kept_answers(file, o, total) if o.resume and total else ""
    if folder:
        client = recognizer.remembering(client, folder)
    counted, size = spark.sparkContext.accumulator(0), max(1, o.batch_size) if o.batched else 1

    def counting(url: str, body: str) -> tuple[int, str]:
        got = client(url, body)
        counted.add(size)
        return got

    with shown(total, counted, "recognizing..."):
        got = answers(found.repartition(max(1, total), "page_no"), o, counting).cache()
        failed = got.where("error is not null").select("error").limit(1).collect()
        none = got.isEmpty()
    if failed or none:
        print(progress.colored(progress.YELLOW, failed[0].error if failed else "no pages", sys.stderr), file=sys.stderr)
        return 1
    metas = found.select("doc_id", F.col("page_no").alias("page"), "width", "height", "dpi", "rotation")
    text = documents(got, o, metas, file).first()[1] + "\n"
    if o.output:
        with open(o.output, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        sys.stdout.write(text)
    if folder and not o.raw:
        shutil.rmtree(folder, ignore_errors=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
