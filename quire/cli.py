"""Command line: repair and join Markdown pages, or convert PDF files with a model."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import stitching, tables
from quire.plans import conversion, models
from quire.sources import images, pdf, sink, storage


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    join = sub.add_parser("join", help="Parquet pages (doc_id, page_num, md) to Markdown files")
    join.add_argument("pages")
    join.add_argument("-i", "--images", help="folder of <doc>/images/*.png; references to others are removed")
    join.add_argument("-o", "--output", required=True)
    convert = sub.add_parser("convert", help="PDF files to Markdown files")
    convert.add_argument("pdf")
    convert.add_argument("-m", "--model", choices=text.MODELS, default=text.DEFAULT_MODEL)
    convert.add_argument("-o", "--output", required=True)
    convert.add_argument("-r", "--remember", help="folder where the model's replies are kept for later runs")
    convert.add_argument("--in-flight", type=int, default=models.Limits.in_flight, help="calls of the model at one time")
    convert.add_argument("--per-minute", type=int, default=models.Limits.per_minute, help="calls of the model a minute")
    convert.add_argument("-z", "--zip", action="store_true", help="an archive of each document as well")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if a.command == "join":
        pages = spark.read.parquet(a.pages)
        files = storage.image_files(spark, a.images) if a.images else spark.createDataFrame([], "doc_id string, filename string")
        sink.write(sink.file_rows(tables.postprocessed(stitching.joined(pages), files), spark.createDataFrame([], "doc_id string, filename string, data binary")), a.output)
        return
    pages = storage.stored(pdf.pages(spark, a.pdf))
    model = a.model
    conversion.write(pages.withColumn("model", F.lit(model)), lambda: models.client_for(model), a.output, images.PillowCodec, a.zip, memory=a.remember, limits=models.Limits(in_flight=a.in_flight, per_minute=a.per_minute))


if __name__ == "__main__":
    main()
