import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import files, pdf, sink, storage


class Lines:
    """A document whose pages are the lines of its file; notes who opened it."""

    def __init__(self, file):
        self.lines = file.read().decode().split("\n") if file.size() else []

    def __len__(self):
        return len(self.lines)

    def page(self, number):
        return len(self.lines[number]), 1, self.lines[number].encode()


def test_pages_of_many_tasks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "long.pdf").write_text("\n".join(f"page {i}" for i in range(1000)))
    for i in range(5):
        (tmp_path / "in" / "deep" / f"s.{i}.PDF").write_text(f"a{i}\nb{i}")
    (tmp_path / "in" / "none.pdf").write_text("")
    (tmp_path / "in" / "other.txt").write_text("x")
    got = pdf.pages(spark, str(tmp_path / "in"), lambda: Lines, pages_per_task=8, whole_bytes=1000)
    assert got.rdd.getNumPartitions() == 125 + 1
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count()
    assert tasks.count() == 126 and tasks.agg(F.max("count")).first()[0] == 10
    rows = {(r.doc_id, r.page_num): bytes(r.png) for r in got.collect()}
    assert rows == {("long", i): f"page {i}".encode() for i in range(1000)} | {(f"s.{i}", k): f"{'ab'[k]}{i}".encode() for i in range(5) for k in range(2)}
    one = pdf.pages(spark, f"file:{tmp_path}/in/long.pdf", lambda: Lines, pages_per_task=400, whole_bytes=10)
    assert one.count() == 1000 and one.rdd.getNumPartitions() == 3
    (tmp_path / "nothing").mkdir()
    assert pdf.pages(spark, str(tmp_path / "nothing"), lambda: Lines).count() == 0


def test_ranges():
    parts = pdf.ranges([("b", 5), ("a", 50), ("c", 6), ("d", 3), ("e", 90)], {"a": 5, "e": 0}.get, 2, 10)
    assert [p.items for p in parts] == [(("a", 0, 2),), (("a", 2, 4),), (("a", 4, 5),), (("b", 0, None),), (("c", 0, None), ("d", 0, None))]


def test_few_tasks_for_many_ranges(spark, tmp_path):
    """No more tasks than ``most_tasks``, and the same pages in their order."""
    parts = [pdf.Pages(((str(i), 0, None),)) for i in range(10)]
    assert [len(p.items) for p in pdf.together(parts, 4)] == [2, 3, 2, 3] and sum((p.items for p in pdf.together(parts, 4)), ()) == sum((p.items for p in parts), ())
    assert pdf.together(parts, 10) == parts and pdf.together([], 10) == []
    for i in range(1500):
        (tmp_path / f"{i}.pdf").write_text(f"a{i}\nb{i}")
    got = pdf.pages(spark, str(tmp_path), lambda: Lines, pages_per_task=1, whole_bytes=1)
    assert got.rdd.getNumPartitions() == 1024  # of 3,000 ranges
    assert {(r.doc_id, r.page_num, bytes(r.png).decode()) for r in got.collect()} == {(str(i), k, f"{'ab'[k]}{i}") for i in range(1500) for k in range(2)}


def test_pages_go_in_small_batches():
    rows = [("d", i, 1, 1, b"x" * n) for i, n in enumerate([10, 10, pdf.BATCH_BYTES - 20, 1, 3 * pdf.BATCH_BYTES, 5, *[0] * 300])]
    got = list(pdf.batched(rows))
    assert [b.num_rows for b in got] == [3, 1, 1, 256, 45] and [r["page_num"] for b in got for r in b.to_pylist()] == list(range(306))
    assert list(pdf.batched([])) == []


def tree(folder):
    return sorted(os.path.relpath(os.path.join(home, name), folder) for home, _, names in os.walk(folder) for name in names)


def content(spark, rows):
    return spark.createDataFrame([(d, n, None if x is None else x.encode()) for d, n, x in rows], sink.FILES)


def test_written_documents(spark, tmp_path):
    out = tmp_path / "out"
    (out / "a" / "images").mkdir(parents=True)
    (out / "a" / "images" / "old.png").write_bytes(b"1")
    (out / "a" / "notes.txt").write_bytes(b"2")
    (out / "z" / "images").mkdir(parents=True)
    (out / "z" / "images" / "other.png").write_bytes(b"3")
    docs = spark.createDataFrame([("a", "# A"), ("b", None), ("x/../c", "C")], "doc_id string, md string")
    images = spark.createDataFrame([("a", "p.png", b"p"), ("b", "../q.png", b"q")], "doc_id string, filename string, data binary")
    rows = sink.file_rows(docs, images)
    sink.write(rows.unionByName(sink.archives(rows)), str(out))
    assert tree(out) == ["a/a.md", "a/a_markdown.zip", "a/images/p.png", "a/notes.txt", "b/b.md", "b/b_markdown.zip", "b/images/q.png", "c/c.md", "c/c_markdown.zip", "z/images/other.png"]
    assert (out / "a" / "a.md").read_bytes() == b"# A" and (out / "b" / "b.md").read_bytes() == b""
    with zipfile.ZipFile(io.BytesIO((out / "a" / "a_markdown.zip").read_bytes())) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"a.md": b"# A", "images/p.png": b"p"}
    assert {(r.doc_id, r.md) for r in storage.markdown_files(spark, str(out)).collect()} >= {("a", "# A"), ("c", "C")}
    assert [(r.doc_id, r.filename) for r in storage.image_files(spark, str(out)).collect()] == [("a", "p.png"), ("b", "q.png"), ("z", "other.png")]
    sink.write(content(spark, [("a", "a.md", "new")]), str(out))
    assert [f for f in tree(out) if f.startswith("a/")] == ["a/a.md", "a/a_markdown.zip", "a/notes.txt"] and (out / "a" / "a.md").read_bytes() == b"new"


def test_only_folders_that_hold_files(spark, tmp_path):
    """No folder for pictures of a document that has none, and staged files in a folder for each task; names may have folders of their own."""
    rows = content(spark, [("a", "a.md", "x"), ("b", "images/p.png", "y"), ("b", "deep/er/n", "z")]).repartition(3)
    sink.stage(rows, f"{tmp_path}/o/_staging-1")
    homes = [os.path.dirname(r.staged) for r in spark.read.parquet(f"{tmp_path}/o/_staging-1/manifest").collect()]
    assert len(set(homes)) == spark.read.parquet(f"{tmp_path}/o/_staging-1/manifest").select(F.input_file_name()).distinct().count()
    sink.publish(spark, f"{tmp_path}/o/_staging-1", f"{tmp_path}/o")
    assert sorted(os.path.relpath(home, tmp_path / "o") for home, _, _ in os.walk(tmp_path / "o")) == [".", "a", "b", "b/deep", "b/deep/er", "b/images"]


def test_odd_rows_to_files(spark, tmp_path):
    rows = [("a", "x", "1"), ("a", "x", "2"), ("a", "x", "1"), ("b", "y", None), (None, "n", "1"), ("", "n", "1"), ("c", "", "1"), ("c", None, "1")]
    sink.write(content(spark, rows).repartition(3), f"file://{tmp_path}/o")
    assert tree(tmp_path / "o") == ["a/x", "b/y"] and (tmp_path / "o" / "b" / "y").read_bytes() == b""
    sink.write(content(spark, []), str(tmp_path / "n"))
    assert tree(tmp_path / "n") == []


def test_an_aborted_write_leaves_no_file(spark, tmp_path):
    """One task fails after the others have written."""
    out = tmp_path / "out"
    sink.write(content(spark, [("d1", "d1.md", "before")]), str(out))

    def failing(frames):
        for frame in frames:
            yield frame
            if "d7" in set(frame["doc_id"]):
                raise RuntimeError("lost")

    rows = content(spark, [(f"d{i}", f"d{i}.md", "after") for i in range(12)]).repartition(4).mapInPandas(failing, sink.FILES)
    with pytest.raises(Exception, match="lost"):
        sink.write(rows, str(out))
    assert tree(out) == ["d1/d1.md"] and os.listdir(out) == ["d1"] and (out / "d1" / "d1.md").read_bytes() == b"before"


def test_publishing_goes_on_after_a_failure(spark, tmp_path):
    """Some moves are made, then the job is lost: the same manifest finishes it."""
    out, staging = str(tmp_path / "out"), str(tmp_path / "out" / "_staging-1")
    sink.stage(content(spark, [(f"d{i}", f"d{i}.md", str(i)) for i in range(6)]), staging)
    assert all(f.startswith("_staging-1") for f in tree(out))
    for r in spark.read.parquet(f"{staging}/manifest").filter("doc_id < 'd3'").collect():
        os.makedirs(f"{out}/{r.doc_id}")
        os.replace(r.staged, f"{out}/{r.doc_id}/{r.name}")
    sink.publish(spark, staging, out)
    assert tree(out) == [f"d{i}/d{i}.md" for i in range(6)] and [(tmp_path / "out" / f"d{i}" / f"d{i}.md").read_text() for i in range(6)] == list("012345")
    sink.stage(content(spark, [("e", "e.md", "x")]), staging)
    os.unlink(spark.read.parquet(f"{staging}/manifest").first().staged)
    with pytest.raises(Exception, match="FileNotFound"):
        sink.publish(spark, staging, out)


def test_listing(tmp_path):
    assert files.files_under(str(tmp_path / "none")) == []
    (tmp_path / "f").write_text("x")
    assert [f.size for f in files.files_under(str(tmp_path / "f"))] == [1]


def test_written_files_come_back(spark, tmp_path):
    """Also empty ones, which Spark's own file sources leave out."""
    sink.write(content(spark, [("a", "a.md", ""), ("a", "images/x.png", "x"), ("b", "b.md", None)]), str(tmp_path / "out"))
    docs = spark.createDataFrame([("a",), ("b",), ("a",), ("none",)], "doc_id string")
    got = sorted((r.doc_id, r.name, bytes(r.data)) for r in sink.written(docs, f"file:{tmp_path}/out").collect())
    assert got == [("a", "a.md", b""), ("a", "images/x.png", b"x"), ("b", "b.md", b"")]
