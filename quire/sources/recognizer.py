"""Requests to a recognizer, made on the executors by a client of the caller's choice."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from http.client import HTTPException
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.request import response

#: (url, body) -> (status, body)
Client = Callable[[str, str], tuple[int, str]]
# Fixed value: seconds that a request may take.
TIMEOUT = 300


def http_client(url: str, body: str) -> tuple[int, str]:
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as got:
            return got.status, got.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def remembering(client: Client, folder: str) -> Client:
    """A client that keeps each good answer as soon as it has it, and asks nobody for a request that is kept.

    folder: one that all executors share; a file for each request, put in place when it is whole.
    """

    def asked(url: str, body: str) -> tuple[int, str]:
        top = Path(folder)
        file = top / f"{hashlib.sha256(f'{url}\n{body}'.encode()).hexdigest()}.json"
        if file.exists():
            return tuple(json.loads(file.read_text()))
        status, text = client(url, body)
        if status == 200:
            top.mkdir(parents=True, exist_ok=True)
            part = file.with_suffix(f".{os.getpid()}")
            part.write_text(json.dumps([status, text]))
            part.replace(file)
        return status, text

    return asked


def recognize(requests: DataFrame, client: Client = http_client) -> DataFrame:
    """requests (url, body and more) without url and body, with content and error: one request a row, none repeated.

    A status other than 200 is an error with the body, and so is a body that holds an error or no choices. A connection
    that is refused or lost, or takes too long, is an error of its row with status 0, so the task goes on.
    """
    kept = [c for c in requests.columns if c not in ("url", "body")]

    def asked(url: str, body: str) -> tuple[int, str]:
        try:
            return client(url, body)
        except (OSError, HTTPException) as e:
            return 0, str(e) or type(e).__name__

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [asked(u, b) for u, b in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True)]
            status, text = pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], status, text], names=[*kept, "_status", "_text"])

    schema = StructType([requests.schema[c] for c in kept]).add("_status", "integer").add("_text", "string")
    got = requests.select(*kept, "url", "body").mapInArrow(rows, schema).withColumn("_r", response(F.col("_text")))
    bad = F.col("_status") != 200
    error = F.when(bad, F.concat(F.lit("status "), F.col("_status"), F.lit(": "), F.col("_text"))).otherwise(F.col("_r")["error"])
    return got.select(*kept, F.when(~bad, F.col("_r")["content"]).alias("content"), error.alias("error"))
