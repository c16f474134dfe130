"""Files into page images: sizes from headers by column functions, paged files through a rasterizer of the caller's."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.operators.request import data_uri, mime_type, rotation

PAGE = "path string, page_index int, uri string, width int, height int, dpi int, rotation int"


class Image(NamedTuple):
    png: bytes
    width: int
    height: int
    #: 1, 2, 3 for quarter turns
    turn: int = 0


class Rasterizer(Protocol):
    """Pictures of a paged file's pages; no such library comes with this package."""

    def pages(self, content: bytes) -> int: ...

    def render(self, content: bytes, page_index: int, dpi: int) -> Image: ...


#: Makes a rasterizer where it is called; a class will do.
Factory = Callable[[], Rasterizer]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime_ns, size, content, paged, mime of files; modification times have microseconds at best."""
    files = spark.read.format("binaryFile").load(path)
    mtime = F.unix_micros("modificationTime") * 1000
    return files.select("path", mtime.alias("mtime_ns"), F.col("length").alias("size"), "content", F.lower("path").endswith(".pdf").alias("paged"), mime_type(F.col("path")).alias("mime"))


def number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """The unsigned number in some bytes, the first at 1."""
    bytes_ = F.array(*[F.hex(F.substring(content, at + i, 1)) for i in range(size)])
    return F.conv(F.array_join(F.reverse(bytes_) if little else bytes_, ""), 16, 10).cast("int")


def _jpeg_size(content: pa.Array) -> pa.Array:
    def size(b: bytes) -> tuple[int, int] | None:
        at = 2
        while at + 9 <= len(b):
            if b[at] != 0xFF:
                return None
            kind = b[at + 1]
            if kind == 0xFF:
                at += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
                at += 2
            else:
                at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        return None

    found = [None if b is None else size(b) for b in content.to_pylist()]
    return pa.array([x and {"width": x[0], "height": x[1]} for x in found], pa.struct([("width", pa.int32()), ("height", pa.int32())]))


def image_size(content: Column) -> Column:
    """struct<width, height> of PNG, GIF and JPEG images; zeros for anything else."""
    head = F.hex(F.substring(content, 1, 8))
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    png, gif, jpeg = head == "89504E470D0A1A0A", head.startswith("474946383761") | head.startswith("474946383961"), head.startswith("FFD8FF")
    whole = F.octet_length(content)
    zero = pair(F.lit(0), F.lit(0))
    native = F.when(png & (whole >= 24), pair(number(content, 17, 4), number(content, 21, 4))).when(gif & (whole >= 10), pair(number(content, 7, 2, True), number(content, 9, 2, True)))
    return F.coalesce(native, F.arrow_udf(_jpeg_size, "struct<width:int,height:int>")(F.when(jpeg, content)), zero)


def single_pages(files: DataFrame) -> DataFrame:
    """Files that are images, as pages: no resolution and no rotation."""
    one = files.where(~F.col("paged")).select("path", F.lit(0).alias("page_index"), data_uri(F.col("path"), F.col("content")).alias("uri"), image_size(F.col("content")).alias("s"))
    return one.select("path", "page_index", "uri", "s.width", "s.height", F.lit(0).alias("dpi"), F.lit(0).alias("rotation"))


_pool: dict[bytes, list[Rasterizer]] = {}
#: Rasterizers that a worker keeps at most.
POOL = 4


@contextmanager
def pooled(factory: Factory) -> Iterator[Rasterizer]:
    """A rasterizer of this worker's, made when none is idle and kept for the next task."""
    idle = _pool.setdefault(cloudpickle.dumps(factory), [])
    made = idle.pop() if idle else factory()
    yield made  # one that has failed isn't used again
    if len(idle) < POOL:
        idle.append(made)


def page_counts(files: DataFrame, factory: Factory) -> DataFrame:
    """files with n_pages; a file that the rasterizer can't read has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for content in batch.column("content"):
                try:
                    with pooled(factory) as r:
                        n.append(r.pages(content.as_py()))
                except ValueError:
                    n.append(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], names=[*batch.schema.names, "n_pages"])

    return files.mapInArrow(rows, StructType([*files.schema.fields, StructField("n_pages", IntegerType())]))


def rendered_pages(files: DataFrame, factory: Factory, dpi: int = 200, pages_per_task: int = 16) -> DataFrame:
    """Pages of paged files. factory makes a rasterizer on an executor, and must pickle.

    A file's pages go out in ranges, each a row of its own, so that one long file is many tasks' work.
    """
    names = ["path", "page_index", "uri", "width", "height", "dpi", "turn"]
    kinds = pa.schema([("path", pa.string()), ("page_index", pa.int32()), ("uri", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("dpi", pa.int32()), ("turn", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, first, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = content.as_py()
                for i in range(first, min(n, first + pages_per_task)):
                    with pooled(factory) as r:
                        made = r.render(data, i, dpi)
                    uri = "data:image/png;base64," + base64.b64encode(made.png).decode()
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (path, i, uri, made.width, made.height, dpi, made.turn), strict=True))], kinds)

    counted = page_counts(files.where("paged").select("path", "content"), factory).where("n_pages > 0")
    ranges = counted.select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(pages_per_task))).alias("first"), "n_pages")
    made = ranges.repartition(F.col("path"), F.col("first")).mapInArrow(rows, "path string, page_index int, uri string, width int, height int, dpi int, turn int")
    return made.select("path", "page_index", "uri", "width", "height", "dpi", rotation(F.col("turn")).alias("rotation"))


def page_images(files: DataFrame, rasterizer: Factory | None = None, dpi: int = 200) -> DataFrame:
    """All pages of files of scan(); without a rasterizer those of images alone."""
    single = single_pages(files)
    return single.unionByName(rendered_pages(files, rasterizer, dpi)) if rasterizer else single
