import ast
import os
import threading
import time
import uuid
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from compare import ROOT
from pyspark.sql import functions as F

from quire.plans import conversion, models
from quire.sources import images as pictures
from quire.sources import storage


QUICK = models.Limits(pause=0.01)


def page_rows(spark, texts):
    rows = [(1, i, 1000, 1000, t.encode(), "qwen3.5-plus") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, page_num int, width int, height int, png binary, model string")


def client():
    said = lambda r: r["images"][0]["data"].decode()

    def convert(r):
        if said(r) == "fail":
            raise RuntimeError("down")
        return said(r)

    return models.StubClient({"context": lambda r: " ctx ", "detect": lambda r: '[{"bbox":[0,0,500,500],"desc":"d"}]' if "figure" in said(r) else "no", "verify": lambda r: '[{"index":1,"action":"accept"}]', "convert": convert, "review": lambda r: "{}", "stitch": lambda r: ""})


def test_whole_conversion(spark):
    got = conversion.documents(page_rows(spark, ["# A figure", "fail", "The end."]), client, limits=QUICK).collect()
    assert [(r.doc_id, r.md) for r in got] == [(1, "# A figure\n\n![](images/page1_fig1.png)\n\n<!-- 第2页转换失败: down -->\n\nThe end.")]


def test_pages_are_rendered_once(spark, tmp_path):
    folder = str(tmp_path)

    @F.udf("binary")
    def rendered(n):
        open(os.path.join(folder, f"{n}-{uuid.uuid4().hex}"), "x").close()
        return f"Words {n}.".encode()

    pages = page_rows(spark, ["", ""]).withColumn("png", rendered("page_num"))
    assert [r.md for r in conversion.documents(pages, client, limits=QUICK).collect()] == ["Words 0.\n\nWords 1."]
    assert Counter(f.split("-")[0] for f in os.listdir(folder)) == {"0": 1, "1": 1}


def counted(folder, said):
    """A client that notes each call as a file of its own, and answers by ``said(request, calls of this stage and picture before)``."""

    class Counted:
        def complete(self, r):
            picture = r["images"][0]["data"].decode() if r["images"] else ""
            name = f"{r['stage']}-{picture}-"
            before = len([f for f in os.listdir(folder) if f.startswith(name)])
            open(os.path.join(folder, f"{name}{uuid.uuid4().hex}"), "x").close()
            return said(r, before)

    return Counted


def calls(folder):
    """Times that each stage was asked about each picture."""
    return Counter(tuple(f.split("-")[:2]) for f in os.listdir(folder))


NO_CROPS = "doc_id int, page_num int, filenames array<string>, places array<string>, coverage int"


def transcribe(spark, texts, factory, memory=None, limits=QUICK):
    known = page_rows(spark, texts).withColumn("doc_context", F.lit(""))
    rows = conversion.transcribed(known.drop("png"), spark.createDataFrame([], NO_CROPS), conversion.shown(pictures.sent(known, None, 0)), conversion.Caller(factory, memory, limits))
    return {r.page_num: (r.md, r.attempts) for r in rows.collect()}


def test_retry_keeps_the_better(spark, tmp_path):
    def said(r, before):
        if r["stage"] == "convert":
            return "better" if before else "worse"
        return '{"score": 90, "issues": []}' if "better" in r["prompt"] else '{"score": 30, "issues": ["x"]}'

    assert transcribe(spark, ["x"], counted(str(tmp_path), said)) == {0: ("better", 2)}
    assert calls(tmp_path) == {("convert", "x"): 2, ("review", "x"): 2}


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    """Killed after the third page: the next run asks nothing twice, and the pages are those of a run in one piece."""
    (tmp_path / "calls").mkdir()
    texts = [f"# Page {i}\n\nwords of {i}" for i in range(5)]

    def said(dies):
        def answer(r, before):
            picture = r["images"][0]["data"].decode()
            if dies and picture == texts[3]:
                os._exit(1)  # the task's process, as if its machine were gone
            return picture.replace("words", "read") if r["stage"] == "convert" else "{}"

        return counted(str(tmp_path / "calls"), answer)

    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        transcribe(spark, texts, said(True), str(tmp_path / "m"))
    before = calls(tmp_path / "calls")
    got = transcribe(spark, texts, said(False), str(tmp_path / "m"))
    assert got == {i: (t.replace("words", "read"), 1) for i, t in enumerate(texts)}
    again = calls(tmp_path / "calls")
    assert all(again[k] == 1 == before[k] for k in again if k[1] in texts[:3]) and again["convert", texts[4]] == 1
    assert transcribe(spark, texts, said(False), str(tmp_path / "m")) == got and calls(tmp_path / "calls") == again


def test_tasks_that_ended_stay_remembered(spark, tmp_path):
    """One of a job's tasks fails: what the others were told is not asked again."""
    (tmp_path / "calls").mkdir()
    rows = [(i, "s", "m", "", f"p{i}", [{"mime": "", "data": f"{i}".encode()}], 0.0, 1) for i in range(12)]
    requests = spark.createDataFrame(rows, "k int, " + models.REQUEST)
    one_each = models.Limits(pause=0.01, batch=1)

    def said(dies):
        def answer(r, before):
            if dies and r["prompt"] == "p7":
                time.sleep(3)  # the other tasks end before
                os._exit(1)
            return r["prompt"]

        return counted(str(tmp_path / "calls"), answer)

    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        models.remembered(requests, said(True), str(tmp_path / "m"), one_each).collect()
    got = {r.k: r.reply for r in models.remembered(requests, said(False), str(tmp_path / "m"), one_each).collect()}
    assert got == {i: f"p{i}" for i in range(12)}
    assert [i for i in range(12) if calls(tmp_path / "calls")["s", f"{i}"] > 1] == [7]


def test_progress_rises(spark, tmp_path):
    """Percents are those of the pages that are stored; then stitching, then done."""
    said = []
    pages = page_rows(spark, [f"# {i}" for i in range(6)]).unionByName(page_rows(spark, ["x", "y"]).withColumn("doc_id", F.lit(2)))
    factory = lambda: models.StubClient({"convert": lambda r: "md", "detect": lambda r: "[]"})
    conversion.write(pages.withColumn("png", F.lit(picture(40, 40))), factory, str(tmp_path), pictures.NetpbmCodec, limits=QUICK, progress=lambda step, percent: said.append((step, percent)))
    share = lambda done: min(95, int(done / 8 * 90 + 0.5) + 5)
    assert said == [*(("pages", share(n)) for n in (2, 4, 5, 6, 7, 8)), ("stitch", 92), ("done", 100)]


def test_calls_in_flight():
    """As many calls at once as allowed and no more; results stay in order."""
    now, most, lock = 0, 0, threading.Lock()

    def slow(r):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02)
        with lock:
            now -= 1
        return r["prompt"]

    asker = models.Asker(models.StubClient({"s": slow}), models.Limits(in_flight=5))
    assert asker.all([{"stage": "s", "prompt": str(i)} if i % 4 else None for i in range(40)]) == [(str(i), None) if i % 4 else (None, None) for i in range(40)]
    assert most == 5
    assert models.Limits(in_flight=20, per_minute=100).of_task(8) == models.Limits(in_flight=2, per_minute=12)


def test_rate_and_backing_off():
    clock, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    bucket = models.Bucket(120, lambda: clock[0], sleep)  # two a second
    for _ in range(12):
        bucket.take()
    assert clock[0] == pytest.approx(4.5, abs=0.6)
    fails = iter([RuntimeError("down"), RuntimeError("429 too many"), None])

    def said(r):
        error = next(fails)
        if error:
            raise error
        return "ok"

    clock[0], slept[:] = 100.0, []
    bucket = models.Bucket(6000, lambda: clock[0], sleep)
    assert models.Asker(models.StubClient({"s": said}), models.Limits(in_flight=1, pause=1), bucket).one({"stage": "s"}) == ("ok", None)
    assert len(slept) == 2 and 1 <= slept[0] <= 1.25 and 2 <= slept[1] <= 2.5  # doubled; the second by holding all of the task back
    always = models.Asker(models.StubClient({"s": lambda r: 1 / 0}), models.Limits(in_flight=1, attempts=2, pause=0))
    assert always.one({"stage": "s"}) == (None, "division by zero")


def test_requests_are_dealt(spark):
    rows = spark.range(100)
    some, own = models.dealt(rows, models.Limits(in_flight=20, batch=10))
    assert some.rdd.getNumPartitions() == 10 and own.in_flight == 20 // spark.sparkContext.defaultParallelism
    few, own = models.dealt(rows, models.Limits(in_flight=2, batch=10))
    assert few.rdd.getNumPartitions() == 2 and own.in_flight == 1
    assert models.dealt(rows.limit(0), models.Limits())[0] is None


def test_keys_are_checked():
    for name in ("DASHSCOPE_API_KEY", "GEMINI_PROXY_API_KEY"):
        os.environ.pop(name, None)
    for model in ("qwen3.5-plus", "gemini/x"):
        with pytest.raises(ValueError, match="is not set"):
            models.client_for(model)


def picture(width, height, *dark):
    """A white page with dark boxes."""
    pixels = np.full((height, width, 3), 255, np.uint8)
    for x1, y1, x2, y2 in dark:
        pixels[y1:y2, x1:x2] = 40
    return pictures.NetpbmCodec().encode(pixels, "png")


def test_crops_end_to_end(spark, tmp_path):
    """Detected, verified on outlines and crops, corrected unless blank, written, and referred to; old files go."""
    codec = pictures.NetpbmCodec()
    page = picture(1000, 2000, (100, 100, 400, 500), (600, 1000, 900, 1400))
    pages = spark.createDataFrame([("d", 0, 1000, 2000, page, "gemini/m"), ("e", 0, 1000, 2000, picture(1000, 2000), "gemini/m")], "doc_id string, page_num int, width int, height int, png binary, model string")

    def factory():
        def verify(r):
            shown = [codec.decode(i["data"]) for i in r["images"]]
            assert len(shown) == 3 and shown[0].shape == (2000, 1000, 3) and max(max(s.shape) for s in shown[1:]) <= 800
            assert shown[0][94, 200].tolist() == [255, 0, 0] and shown[1].min() == 40
            return '[{"index": 1, "action": "adjust", "bbox": [450, 50, 550, 100]}, {"index": 2, "action": "split", "regions": [{"bbox": [600, 500, 750, 700], "desc": "l"}, {"bbox": [450, 50, 550, 100]}]}]'

        def detect(r):
            shown = codec.decode(r["images"][0]["data"])
            assert shown.shape == (1600, 800, 3)
            return '[{"bbox": [100, 50, 400, 250], "desc": "a"}, {"bbox": [480, 800, 720, 1120], "desc": "b, in pixels of what is shown"}]' if shown.min() < 255 else "[]"

        return models.StubClient({"detect": detect, "detect-again": detect, "verify": verify, "convert": lambda r: "Text ![](images/gone.png)"})

    old = tmp_path / "d" / "images" / "old.png"
    os.makedirs(old.parent)
    old.write_bytes(b"1")
    conversion.write(pages, factory, str(tmp_path), pictures.NetpbmCodec)
    files = [(r.doc_id, r.filename) for r in storage.image_files(spark, str(tmp_path)).collect()]
    assert files == [("d", "page1_fig1.png"), ("d", "page1_fig2_a.png")] and not old.exists()
    assert codec.decode((tmp_path / "d" / "images" / "page1_fig1.png").read_bytes()).min() == 40
    md = {r.doc_id: r.md for r in storage.markdown_files(spark, str(tmp_path)).collect()}
    assert md["d"] == "Text \n\n![](images/page1_fig1.png)\n\n![](images/page1_fig2_a.png)" and md["e"].strip() == "Text"


def test_pictures_are_not_broadcast(spark):
    """Plain pages, whose files are far smaller than they are: no join of a conversion sends them through the driver."""
    rows = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_num"), F.lit(picture(300, 200)).alias("png"))
    sent = conversion.shown(pictures.sent(rows.withColumns({"width": F.lit(300), "height": F.lit(200)}), pictures.NetpbmCodec, 100))
    keys = storage.stored(rows.drop("png"))
    joined = [conversion.with_images(keys, sent), conversion.beside(keys, storage.stored(rows))]
    for df in joined:
        assert df.count() == 4 and "Broadcast" not in df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_sizes_for_the_model():
    class Lossy(pictures.NetpbmCodec):
        def encode(self, pixels, kind, quality=90):
            return b"x" * (pixels.size // (1 if kind == "png" else 100 // (quality // 10)))

    pixels = np.zeros((1000, 2000, 3), np.uint8)
    assert pictures.prepared(Lossy(), pixels, [2000], 6_000_000)[::3] == ("image/png", 1000)
    mime, data, width, height = pictures.prepared(Lossy(), pixels, [2000, 1700], 520_000)
    assert (mime, width, height) == ("image/jpeg", 2000, 1000) and len(data) <= 520_000
    assert pictures.prepared(Lossy(), pixels, [2000, 1700], 1)[2] == 1700


def test_remembered_replies(spark, tmp_path):
    """A second run asks only for what failed."""
    rows = [(i, "s", "m", "", f"p{i % 2}", [], 0.0, 1) for i in range(4)]
    requests = spark.createDataFrame(rows, "k int, " + models.REQUEST)

    def factory(broken):
        def said(r):
            if broken and r["prompt"] == "p1" or not broken and r["prompt"] == "p0":
                raise RuntimeError("asked")
            return r["prompt"]

        return lambda: models.StubClient({"s": said})

    first = {r.k: (r.reply, r.error) for r in models.remembered(requests, factory(True), str(tmp_path / "m"), QUICK).collect()}
    assert first == {0: ("p0", None), 2: ("p0", None), 1: (None, "asked"), 3: (None, "asked")}
    again = {r.k: r.reply for r in models.remembered(requests, factory(False), str(tmp_path / "m"), QUICK).collect()}
    assert again == {0: "p0", 1: "p1", 2: "p0", 3: "p1"}


def test_reply_text_and_env(tmp_path, monkeypatch):
    class Refused:
        candidates = [SimpleNamespace(content=SimpleNamespace(parts=[SimpleNamespace(text="a"), SimpleNamespace(text=None), SimpleNamespace(text="b")]))]

        @property
        def text(self):
            raise ValueError

    assert models.reply_text(Refused()) == "ab" and models.reply_text(SimpleNamespace(text="x")) == "x"
    monkeypatch.delenv("QUIRE_T1", raising=False)
    monkeypatch.setenv("QUIRE_T2", "kept")
    (tmp_path / "e").write_text("# c\nexport QUIRE_T1='v=1'\nQUIRE_T2=new\n")
    models.env_file(str(tmp_path / "e"))
    assert os.environ.pop("QUIRE_T1") == "v=1" and os.environ["QUIRE_T2"] == "kept"


def test_nothing_outside_imports_the_optional_part():
    for home, _, names in os.walk(os.path.join(ROOT, "quire")):
        for name in names:
            if name.endswith(".py") and "llm" not in home:
                for node in ast.walk(ast.parse(open(os.path.join(home, name), encoding="utf-8").read())):
                    found = getattr(node, "module", None) or " ".join(a.name for a in getattr(node, "names", []) if isinstance(node, (ast.Import, ast.ImportFrom)))
                    assert "llm" not in (found or ""), name
