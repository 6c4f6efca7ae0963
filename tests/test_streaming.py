import os
import shutil
import time

import pytest
from pyspark.errors import AnalysisException

from quire.streaming import arrivals, carry

SCHEMA = "doc_id string, page_num int, md string"


@pytest.fixture
def pages(spark, tmp_path):
    """Drops files of pages, and runs the stream over what has come since its last run."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    carry.use_state_variables(spark)

    class Pages:
        def drop(self, *rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.1)  # files are read in the order of their times

        def run(self, *until, patience=carry.PATIENCE):
            """A new query from the checkpoint, as after a restart, that is stopped once the pages ``until`` are out."""
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = carry.with_context(stream, patience).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="200 milliseconds").start()
            try:
                for _ in range(120):
                    time.sleep(0.5)
                    rows = self.read()
                    if query.exception() or set(until) <= {r[:2] for r in rows}:
                        break
            finally:
                query.stop()
            rows = self.read()
            assert len(rows) == len({r[:2] for r in rows})  # nothing goes out twice
            return {r[:2]: r[2:] for r in rows}

        def read(self):
            try:
                return [(r.doc_id, r.page_num, r.prev_tail, r.outline, r.lost) for r in spark.read.schema(carry.OUT).parquet(str(tmp_path / "out")).collect()]
            except AnalysisException:
                return []  # no batch has ended yet

    yield Pages()
    spark.conf.set(store, before)


def test_pages_in_any_order(pages):
    pages.drop(("d", 1, "# two\nbb"), ("d", 0, "# one\naa"), ("e", 1, "late"), (None, 0, "x"), ("d", None, "x"))
    pages.drop(("d", 2, "cc"), ("d", 0, "again"), ("e", 0, None))
    got = pages.run(("d", 2), ("e", 1))
    assert got == {("d", 0): ("", "", 0), ("d", 1): ("# one\naa", "# one", 0), ("d", 2): ("# two\nbb", "# one\n# two", 0), ("e", 0): ("", "", 0), ("e", 1): ("", "", 0)}


def test_a_lost_page_and_a_restart(pages):
    """Page 1 never comes: pages 2 and 3 go out once they have waited, after a restart, with what was kept; page 1 comes too late."""
    pages.drop(("d", 0, "# one\naa"), ("d", 2, "# three\ncc"))
    assert set(pages.run(("d", 0), patience=12_000)) == {("d", 0)}
    pages.drop(("other", 0, "x"))
    got = pages.run(("d", 2), ("other", 0))
    assert got["d", 2] == ("# one\naa", "# one", 1) and ("d", 3) not in got
    pages.drop(("d", 3, "dd"), ("d", 1, "too late"))
    got = pages.run(("d", 3))
    assert got["d", 3] == ("# three\ncc", "# one\n# three", 0) and ("d", 1) not in got


def test_headings_are_bounded(pages):
    rows = [("d", n, "\n".join(f"## {n}.{k}" for k in range(30))) for n in range(6)]
    pages.drop(*reversed(rows))
    got = pages.run(("d", 5))
    every = [f"## {n}.{k}" for n in range(6) for k in range(30)]
    assert [got["d", n][1] for n in range(6)] == ["\n".join(every[: 30 * n][-80:]) for n in range(6)]


def test_files_that_arrive(spark, tmp_path):
    """Two drops and restarts: every file is converted once, also when a batch is run again."""
    drop, out, checkpoint = tmp_path / "drop", tmp_path / "out", tmp_path / "c"
    (drop / "deep").mkdir(parents=True)
    seen = []

    def convert(files):
        rows = files.collect()
        seen.extend(r.doc_id for r in rows)
        made = [(r.doc_id, f"{r.doc_id}.md", str(r.bytes).encode()) for r in rows]
        return spark.createDataFrame(made, "doc_id string, name string, data binary")

    def run():
        query = arrivals.converted(arrivals.arrivals(spark, str(drop), most_bytes=100), convert, str(out), str(checkpoint))
        query.awaitTermination()
        return {r.doc_id: (r.batch, r.state) for r in arrivals.jobs(spark, str(out)).collect()}

    (drop / "a.pdf").write_bytes(b"1" * 10)
    (drop / "deep" / "b.PDF").write_bytes(b"1" * 20)
    (drop / "big.pdf").write_bytes(b"1" * 101)
    (drop / "notes.txt").write_bytes(b"1")
    first = {"a": (0, "done"), "b": (0, "done"), "big": (0, "too large"), "notes": (0, "no PDF")}
    assert run() == first and run() == first
    (drop / "c.pdf").write_bytes(b"1")
    assert run() == first | {"c": (1, "done")}
    shutil.rmtree(checkpoint / "commits")  # as if the driver had been lost before it noted the batches' ends
    assert run() == first | {"c": (1, "done")}
    assert sorted(seen) == ["a", "b", "c"]
    assert sorted(os.path.relpath(os.path.join(h, n), out) for h, _, names in os.walk(out) for n in names if n.endswith(".md")) == ["a/a.md", "b/b.md", "c/c.md"]
    assert (out / "b" / "b.md").read_bytes() == b"20"
