"""Jobs by arrival: files that are dropped into a folder are taken up by a stream and converted, once each.

Of the files that arrive those with a PDF's suffix and of at most ``MOST_BYTES`` are accepted; others are
noted as refused, and Spark's reader passes over empty ones.  A batch of the stream is a job: what ``convert`` makes of its files is written by the
committing sink, and then the batch's rows of the jobs table, in a folder named for the batch.  A
batch that is run again after a restart, as the stream could not note that it had ended, finds its
folder and does nothing; one that broke off before is done anew, and the sink replaces what was there.
Only names and sizes pass through the stream: contents are read by ``convert``, from where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import text
from quire.sources import sink
from quire.sources.files import file_system

# Fixed value: bytes of a file that is still accepted
MOST_BYTES = 200 * 1024 * 1024
JOBS = "batch long, doc_id string, path string, bytes long, state string"
_ARRIVALS = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, at_most: int = 1000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A stream of doc_id, path, bytes, state (accepted, too large, no PDF) of the files under ``folder``, ``at_most`` to a batch."""
    files = spark.readStream.format("binaryFile").schema(_ARRIVALS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_most).load(folder)
    state = F.when(~text.is_pdf_name(F.col("path")), "no PDF").when(F.col("length") > most_bytes, "too large").otherwise("accepted")
    return files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("doc_id"), "path", F.col("length").alias("bytes"), state.alias("state"))


def converted(files: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Start the conversion of ``arrivals`` into ``out``; it ends when all that has arrived is done.

    ``convert``: accepted rows (doc_id, path, bytes) to files (``sink.FILES``).  The jobs are in
    ``<out>/_jobs``.
    """

    def job(batch: DataFrame, number: int) -> None:
        home = f"{out.rstrip('/')}/_jobs/batch={number}"
        system, path = file_system(home)
        if system.get_file_info(f"{path}/_SUCCESS").is_file:
            return
        batch = batch.persist()
        try:
            sink.write(convert(batch.filter("state = 'accepted'").select("doc_id", "path", "bytes")), out)
            done = F.when(F.col("state") == "accepted", "done").otherwise(F.col("state"))
            batch.withColumn("state", done).write.mode("overwrite").parquet(home)
        finally:
            batch.unpersist()

    return files.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jobs(spark: SparkSession, out: str) -> DataFrame:
    """Rows of ``JOBS``: what has become of every file."""
    return spark.read.schema(JOBS).option("basePath", f"{out.rstrip('/')}/_jobs").parquet(f"{out.rstrip('/')}/_jobs")
