"""Documents to files, all of them or none: Markdown, crops, archives.

A file is a row (doc_id, name, data); it goes to ``<folder>/<doc_id>/<name>``.  ``write`` has two steps.

* Tasks write each row to a file with a name of its own in a staging folder beside the documents, and
  return what they wrote as the rows of a manifest.  Spark stores the manifest through its committer,
  so it has the rows of one attempt of every task, whatever ran twice or was lost.  If this step
  fails, the staging folder goes and no document has changed.
* Tasks move the staged files of the manifest to their names.  A move that has been made is passed over, so a
  step that breaks off is finished by ``publish`` from the same manifest.

Files that earlier runs left in a written document's folder, and that match ``STALE``, go with the
second step.  The driver handles no names but those of the folders.

Defined cases: of several rows with one document and name the one with the least digest stays; null
data is an empty file; ids and names are stripped of folders that would lead elsewhere; rows of no
document are left out; an empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import file_system, files_under

FILES = "doc_id string, name string, data binary"
MANIFEST = "doc_id string, name string, staged string, digest string"
#: files of a document that are removed unless they are written
STALE = re.compile(r"images/[^/]*\.png")


def file_rows(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Files of documents (doc_id, md) and their images (doc_id, filename, data)."""
    home = F.element_at(F.split(F.col("doc_id").cast("string"), "/"), -1)
    text = documents.select(home.alias("doc_id"), F.concat(home, F.lit(".md")).alias("name"), F.encode(F.coalesce("md", F.lit("")), "UTF-8").alias("data"))
    name = F.concat(F.lit("images/"), F.element_at(F.split("filename", "/"), -1))
    return text.unionByName(images.select(home.alias("doc_id"), name.alias("name"), "data"))


def archives(files: DataFrame) -> DataFrame:
    """A zip of each document's files as a row of ``FILES``: what one document has is packed by one task."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out, doc = io.BytesIO(), rows["doc_id"].iloc[0]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(rows["name"], rows["data"], strict=True)):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data or b"", zipfile.ZIP_DEFLATED)  # equal files make equal archives
        return pd.DataFrame({"doc_id": [doc], "name": [f"{doc}_markdown.zip"], "data": [out.getvalue()]})

    return files.dropDuplicates(["doc_id", "name"]).groupBy("doc_id").applyInPandas(pack, FILES)


def _staging(staging: str):
    """Rows of ``FILES`` to files of their own and rows of ``MANIFEST``."""
    schema = pa.schema([(c, pa.string()) for c in ("doc_id", "name", "staged", "digest")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(staging)
        own = f"{folder}/files/{uuid.uuid4().hex}"  # a folder has the files of one task, as file systems bound the names of one
        system.create_dir(own, recursive=True)
        for k, batch in enumerate(batches):
            rows = []
            for at in range(batch.num_rows):
                doc, name, data = (c[at].as_py() for c in batch.columns)
                staged = f"{own}/{k}-{at}"
                with system.open_output_stream(staged) as out:
                    out.write(data or b"")
                rows.append((doc, name, staged, hashlib.sha256(data or b"").hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], schema=schema)

    return run


def _moving(target: str):
    """Names and staged files of one document a row: moves, and what is left from earlier runs removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(target)
        for batch in batches:
            for row in batch.to_pylist():
                home, own = posixpath.join(folder, row["doc_id"]), {f["name"]: f["staged"] for f in row["files"]}
                new = system.get_file_info(home).type == fs.FileType.NotFound
                for parent in {posixpath.dirname(posixpath.join(home, name)) for name in own}:  # no folder without files
                    system.create_dir(parent, recursive=True)
                for name, staged in own.items():
                    if system.get_file_info(staged).type == fs.FileType.File:  # else an earlier attempt has moved it
                        system.move(staged, posixpath.join(home, name))
                    elif system.get_file_info(posixpath.join(home, name)).type != fs.FileType.File:
                        raise FileNotFoundError(staged)
                for info in () if new else files_under(f"{target.rstrip('/')}/{row['doc_id']}"):
                    name = info.path[len(home) + 1 :]
                    if STALE.fullmatch(name) and name not in own:
                        try:
                            system.delete_file(info.path)
                        except FileNotFoundError:
                            pass  # another attempt of this task was first
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["doc_id"])

    return run


def stage(files: DataFrame, staging: str) -> None:
    """Write ``files`` (``FILES``) and their manifest to the folder ``staging``; where that fails, nothing of it is left."""
    named = files.filter("doc_id != '' and name != ''").select("doc_id", "name", "data")
    try:
        named.mapInArrow(_staging(staging), MANIFEST).write.parquet(f"{staging}/manifest")
    except Exception:
        remove(staging)
        raise


def publish(spark: SparkSession, staging: str, folder: str) -> None:
    """Move what is staged to its names; may be called again after a failure."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{staging}/manifest")
    one = manifest.groupBy("doc_id", "name").agg(F.min(F.struct("digest", "staged"))["staged"].alias("staged"))
    homes = one.groupBy("doc_id").agg(F.collect_list(F.struct("name", "staged")).alias("files"))  # the files of one document
    homes.mapInArrow(_moving(folder), "doc_id string").write.format("noop").mode("overwrite").save()
    remove(staging)


def written(documents: DataFrame, folder: str) -> DataFrame:
    """``FILES`` as they lie under ``folder``, of ``documents`` (doc_id); empty ones too, which Spark's file sources pass over."""
    schema = pa.schema([("doc_id", pa.string()), ("name", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder.rstrip("/"))
        for batch in batches:
            for doc in batch.column(0).to_pylist():
                for info in files_under(f"{folder.rstrip('/')}/{doc}"):  # one file in memory at a time
                    with system.open_input_file(info.path) as file:
                        row = (doc, info.path[len(posixpath.join(root, doc)) + 1 :], file.read())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    return documents.select(F.col("doc_id").cast("string")).distinct().mapInArrow(run, FILES)


def remove(staging: str) -> None:
    system, path = file_system(staging)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def write(files: DataFrame, folder: str) -> None:
    """Write ``files`` (``FILES``) under ``folder``, which all executors reach."""
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    stage(files, staging)
    publish(files.sparkSession, staging, folder)
