import json
import struct

import pytest
from pyspark.sql import functions as F

from quire import cli, progress
from quire.operators import structured
from quire.sources import images, recognizer
from quire.streaming import resume


@pytest.mark.parametrize(("raw", "expected"), [
    ('[{"index":3,"label":"a","content":"x","bbox_2d":[1,2.9,-3.9,4]}]', [(1, 3, "a", "x", [1, 2, -3, 4])]),
    ('```json\n[[{"LABEL":"a"}],[{"content":"second"}]]\n```', [(1, 0, "a", "<nil>", None), (2, 0, "", "second", None)]),
    ('[{"index":1.0,"content":"x"}]', [(1, 0, "text", '[{"index":1.0,"content":"x"}]', None)]),
    ('[{"content":1}] tail ]', [(1, 0, "text", '[{"content":1}] tail ]', None)]),
    ('[{"content":[1000000,0.5,true,null,{"b":1,"a":[2]}],"bbox_2d":["1",2,3,4]}]', [(1, 0, "", "1e+06\n0.5\ntrue\n<nil>\nmap[a:[2] b:1]", None)]),
    ('[{"content":NaN}]', [(1, 0, "text", '[{"content":NaN}]', None)]),
    ('[{"content":"a","content":"b"}]', [(1, 0, "", "b", None)]),
    ("[[null]]", [(1, 0, "", "<nil>", None)]),
    ("[]", [(1, 0, "text", "[]", None)]),
    ("# t\n\n- i\n3. j\nk", [(1, 0, "title", "# t", None), (1, 1, "list_item", "- i", None), (1, 2, "list_item", "3. j", None), (1, 3, "text", "k", None)]),
    (None, [(1, 0, "text", "", None)]),
])
def test_structured(spark, raw, expected):
    docs = spark.createDataFrame([(1, raw, 5)], "doc_id long, raw string, label int")
    got = structured.contents(docs, first_page=False).orderBy("page_no", "ord").collect()
    assert [(x.page_no, x["index"], x.label, x.content, x.bbox) for x in got] == expected
    assert {x.page_no for x in structured.contents(docs).collect()} == {1}


@pytest.mark.parametrize(("x", "text"), [(0.0, "0"), (123456.0, "123456"), (1234567.0, "1.234567e+06"), (1e-5, "1e-05"), (0.0001, "0.0001"), (-2.5, "-2.5"), (1e100, "1e+100")])
def test_number_text(x, text):
    assert structured.number_text(x) == text


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h)


def test_image_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc2\0\x11\x08" + struct.pack(">HH", 7, 300) + b"\x03"
    rows = [(1, png(70000, 5)), (2, b"GIF89a" + struct.pack("<HH", 300, 9)), (3, jpeg), (4, b"RIFF"), (5, b""), (6, None), (7, jpeg[:9]), (8, b"\xff\xd8\xff\x01" * 3)]
    got = {x.i: (x.s.width, x.s.height) for x in spark.createDataFrame(rows, "i int, b binary").select("i", images.image_size(F.col("b")).alias("s")).collect()}
    assert got == {1: (70000, 5), 2: (300, 9), 3: (300, 7), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (0, 0), 8: (0, 0)}


class Pages:
    def pages(self, content):
        return len(content)

    def render(self, content, page_index, dpi):
        return images.Image(b"p", page_index + 1, dpi, page_index)


def test_files_to_pages(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 4))
    (tmp_path / "b.PDF").write_bytes(b"12")
    files = images.scan(spark, str(tmp_path))
    assert {(x.paged, x.mime, x.size) for x in files.collect()} == {(False, "image/png", 24), (True, "application/pdf", 2)}
    got = sorted(tuple(x)[1:] for x in images.page_images(files, Pages, 75).select("path", "page_index", F.substring("uri", 1, 15), "width", "height", "dpi", "rotation").collect())
    assert got == [(0, "data:image/png;", 1, 75, 75, 0), (0, "data:image/png;", 3, 4, 0, 0), (1, "data:image/png;", 2, 75, 75, 90)]


def answer(url, body):
    prompt = json.loads(body)["messages"][0]["content"][-1].get("text")
    if prompt == "fail":
        return 500, "down"
    return 200, json.dumps({"choices": [{"message": {"content": '[{"label":"title","content":"T","bbox_2d":[0,0,9,9]},{"content":"<b>","bbox_2d":[0,50,9,60]}]'}}]})


def test_recognize(spark):
    body = lambda t: json.dumps({"messages": [{"content": [{"text": t}]}]})
    got = recognizer.recognize(spark.createDataFrame([(1, "u", body("x")), (2, "u", body("fail"))], "i int, url string, body string"), answer).orderBy("i").collect()
    assert got[0].error is None and got[0].content.startswith("[") and got[1].content is None and got[1].error == "status 500: down"


def test_recognize_goes_on_after_a_lost_connection(spark):
    def client(url, body):
        if body == "lost":
            raise ConnectionRefusedError("refused")
        if body == "slow":
            raise TimeoutError
        return 200, json.dumps({"choices": [{"message": {"content": body}}]})

    rows = spark.createDataFrame([(i, "u", b) for i, b in enumerate(["a", "lost", "slow", "b"])], "i int, url string, body string").coalesce(1)
    got = [(r.content, r.error) for r in recognizer.recognize(rows, client).orderBy("i").collect()]
    assert got == [("a", None), (None, "status 0: refused"), (None, "status 0: TimeoutError"), ("b", None)]


def test_long_files_go_out_in_ranges(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 40)
    (tmp_path / "b.pdf").write_bytes(b"")
    got = images.rendered_pages(images.scan(spark, str(tmp_path)), Pages, 100, pages_per_task=7).collect()
    assert sorted(r.page_index for r in got) == list(range(40)) and {r.rotation for r in got} == {0, 90, 180, 270}


def test_cache_is_compacted(spark, tmp_path):
    cache = str(tmp_path / "cache")
    ask = lambda pages: pages.withColumn("content", F.concat("hash", "page_index")).withColumn("error", F.lit(None).cast("string"))
    for i in range(4):
        resume.recognize_missing(spark.createDataFrame([("h", i), ("h", 0)], "hash string, page_index int"), cache, i, ask)
    before = sorted(map(tuple, resume.load(spark, cache).collect()))
    resume.compact(spark, cache, 3)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["batch=3", "whole-3"]
    assert sorted(map(tuple, resume.load(spark, cache).collect())) == before and len(before) == 4


def test_command_line_resumes(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "kept"))
    file, log = tmp_path / "a.pdf", tmp_path / "asked"
    file.write_bytes(b"xyz")

    def client(url, body):
        page = json.loads(body)["messages"][0]["content"][0]["image_url"]["url"]
        with log.open("a") as f:
            f.write("x")
        down = not (tmp_path / "up").exists()
        return (500, "down") if down and page.endswith("Mg==") else (200, json.dumps({"choices": [{"message": {"content": page[-4:]}}]}))

    class Numbered(Pages):
        def render(self, content, page_index, dpi):
            return images.Image(str(page_index).encode(), 1, 1)

    args = [str(file), "-resume"]
    assert cli.main(args, client, Numbered) == 1 and log.read_text() == "xxx"
    (tmp_path / "up").touch()
    assert cli.main([*args, "-raw"], client, Numbered) == 0 and log.read_text() == "xxxx"
    assert cli.main(args, client, Numbered) == 0 and log.read_text() == "xxxx"
    assert not any((tmp_path / "kept" / "quire").iterdir())
    assert cli.main(args, client, Numbered) == 0 and log.read_text() == "xxxxxxx"
    capsys.readouterr()


def test_models():
    glm = cli.MODELS["glm"]
    assert cli.arguments(["x", "-model", glm, "-baidu"])[1].own_model == cli.MODELS["baidu"]
    assert cli.arguments(["x"])[1].own_model == glm and cli.arguments(["x", "-baidu", "-model", "m"])[1].own_model == "m"


def test_progress(monkeypatch):
    class Terminal:
        isatty = lambda self: True

    assert progress.bar(5, 10, 100, "x", None) == "\r\033[K  \u23f3 [" + "\u2588" * 10 + "\u2591" * 10 + "]  50% | 5/10 pages | 20.0s/page | Elapsed: 1m40s | ETA: 1m40s | x"
    assert "--s/page" in progress.bar(0, 3, 1, "", None) and "\u2714" in progress.bar(3, 3, 1, "", None) and progress.bar(0, 0, 1, "", None) == ""
    assert progress.colored(progress.CYAN, "a", Terminal()) == "\033[36ma\033[0m"
    monkeypatch.setenv("NO_COLOR", "1")
    assert progress.colored(progress.CYAN, "a", Terminal()) == "a"


def test_resumed_stream(spark, tmp_path):
    source, cache, mark = str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "mark")
    asked = spark.sparkContext.accumulator(0)

    def ask(pages):
        asked.add(pages.count())
        return pages.withColumn("content", F.concat("hash", "page_index")).withColumn("error", F.when(F.col("page_index") == 9, "bad"))

    kind = "hash string, page_index int"
    for rows in ([("h", 0), ("h", 1), ("h", 1), ("h", 9)], [("h", 1), ("h", 2), ("h", 9)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        resume.stream(spark.readStream.schema(kind).parquet(source), cache, mark, ask).awaitTermination()
    assert asked.value == 5
    assert sorted((x.page_index, x.content) for x in resume.load(spark, cache).collect()) == [(0, "h0"), (1, "h1"), (2, "h2")]
    resume.recognize_missing(spark.createDataFrame([("h", 2)], kind), cache, 1, ask)
    assert resume.load(spark, cache).count() == 3
    resume.delete(spark, cache)
    assert resume.load(spark, cache).count() == 0


def test_command_line(spark, tmp_path, capsys):
    file, out = tmp_path / "a.png", tmp_path / "o.md"
    file.write_bytes(png(3, 4))
    assert cli.main([str(file), "-output", str(out)], answer) == 0
    assert out.read_text() == "## T\n\n<b>\n"
    assert cli.main(["--json", str(file)], answer) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["pages"][0]["width"] == 3 and found["blocks"][1]["content"] == "<b>"
    assert cli.main([str(file), "--raw", "--baidu"], answer) == 0 and "bbox_2d" in capsys.readouterr().out
    assert cli.main([str(file), "-prompt", "fail", "-latex"], lambda u, b: (500, "down")) == 1
    assert cli.arguments(["x", "-text", "-json", "-baidu"])[1].kind == "json"
