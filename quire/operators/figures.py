"""Figures of pages: verification of crops, decorative images, positions on the page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import boxes
from quire.functions.boxes import CROP, LEAST_NEW_SIDE, SIDES


def _crop(filename: Column, desc: Column, b: Column) -> Column:
    return F.struct(filename.alias("filename"), desc.alias("desc"), *(b[s].alias(s) for s in SIDES))


def _corrected(numbers: Column, width: Column, height: Column) -> Column:
    """The padded pixel box, or null if it is none or too small."""
    b = boxes.padded(boxes.to_pixels(boxes.box(*(F.get(numbers, F.lit(i)) for i in range(4))), width, height), width, height)
    return F.when(numbers.isNotNull(), boxes.let(b, lambda b: F.when((b["x2"] - b["x1"] >= LEAST_NEW_SIDE) & (b["y2"] - b["y1"] >= LEAST_NEW_SIDE), b)))


def corrections(actions: Column, width: Column, height: Column) -> Column:
    """All boxes that adjustments and splits ask for."""
    asked = F.flatten(F.transform(actions, lambda a: F.when(a["action"] == "adjust", F.array(a["bbox"])).when(a["action"] == "split", F.transform(a["regions"], lambda r: r["bbox"])).otherwise(F.array().cast("array<array<double>>"))))
    return F.array_distinct(F.filter(F.transform(asked, lambda n: _corrected(n, width, height)), lambda b: b.isNotNull()))


def executed(crops: Column, actions: Column, page_num: Column, width: Column, height: Column, is_blank: Callable[[Column], Column] | None = None) -> Column:
    """The crops after a round of actions; of several for one crop the last counts, without one it stays."""
    blank = is_blank or (lambda b: F.lit(False))

    def corrected(numbers: Column) -> Column:
        return boxes.let(_corrected(numbers, width, height), lambda b: F.when(b.isNotNull() & ~blank(b), b))

    none = F.array().cast(f"array<{CROP}>")

    def after(crop: Column, i: Column) -> Column:
        stays = F.array(crop.cast(CROP))
        name = lambda k: F.concat(F.lit("page"), (page_num + 1).cast("string"), F.lit("_fig"), (i + 1).cast("string"), F.lit("_"), F.char(k + 97), F.lit(".png"))

        def part(r: Column, k: Column) -> Column:
            return boxes.let(corrected(r["bbox"]), lambda b: F.when(b.isNotNull(), _crop(name(k), r["desc"], b).cast(CROP)))

        def done(action: Column) -> Column:
            adjusted = boxes.let(corrected(action["bbox"]), lambda b: F.when(b.isNotNull(), F.array(_crop(crop["filename"], crop["desc"], b).cast(CROP))).otherwise(stays))
            parts = F.filter(F.transform(action["regions"], part), lambda c: c.isNotNull())
            return F.when(action["action"] == "reject", none).when(action["action"] == "adjust", adjusted).when((action["action"] == "split") & (F.size(action["regions"]) > 0), parts).otherwise(stays)

        own = F.filter(actions, lambda a: a["index"] == i + 1)
        return boxes.let(F.try_element_at(own, F.lit(-1)), lambda a: F.when(a.isNull(), stays).otherwise(done(a)))

    return F.flatten(F.transform(crops, after))


def all_accept(actions: Column) -> Column:
    return F.forall(actions, lambda a: a["action"] == "accept")


def moves_boxes(actions: Column) -> Column:
    """Is there anything that another round could look at again?"""
    return F.exists(actions, lambda a: a["action"].isin("adjust", "split"))


def _judged(crops: DataFrame, pages: DataFrame, share: float, most_area: float) -> DataFrame:
    """``crops`` with ``signature`` and ``repeats``: is its size one of ``decorative``?

    Windows over the crops in order of document, size and page tell it, so that no task holds a table
    of all sizes, and the crops are made and shuffled once for each of the two keys.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sizes = pages.select("doc_id", "page_num", "width", "height", F.count("*").over(W.partitionBy("doc_id")).alias("total_pages"))
    ratio = F.coalesce(F.try_divide(w * h, F.col("width").cast("long") * F.col("height")), F.lit(1.0))
    known = F.col("total_pages").isNotNull()
    sized = crops.join(sizes, ["doc_id", "page_num"], "left")
    rows = sized.select(*crops.columns, boxes.size_signature(w, h).alias("signature"), F.when(known, F.col("page_num")).alias("_page"), F.when(known, ratio).alias("_area"), "total_pages")
    same = W.partitionBy("doc_id", "signature")
    rows = rows.withColumn("_nth", F.when(F.col("_page").isNotNull(), F.dense_rank().over(same.orderBy(F.asc_nulls_last("_page")))))
    total, n_pages, mean_area = F.max("total_pages").over(same), F.max("_nth").over(same), F.avg("_area").over(same)
    repeats = (total >= 3) & (n_pages > total * share) & (mean_area < most_area)
    return rows.select(*crops.columns, "signature", F.coalesce(repeats, F.lit(False)).alias("repeats"))


def decorative(crops: DataFrame, pages: DataFrame, share: float = 0.5, most_area: float = 0.08) -> DataFrame:
    """doc_id, signature of the sizes that repeat as small images on over half of a document's pages.

    ``crops``: doc_id, page_num, filename, x1..y2; ``pages``: doc_id, page_num, width, height, one row a page.
    Documents of fewer than three pages have none.
    """
    return _judged(crops, pages, share, most_area).filter("repeats").select("doc_id", "signature").distinct()


def without_decorative(crops: DataFrame, pages: DataFrame, share: float = 0.5, most_area: float = 0.08) -> DataFrame:
    return _judged(crops, pages, share, most_area).filter("not repeats").select(*crops.columns)


def positions(crops: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_num, filenames from top to bottom, their positions and the covered percent.

    A crop without a box stands in the middle of the page.  Pages without crops have no row.
    """
    known = crops.join(pages.select("doc_id", "page_num", "width", "height"), ["doc_id", "page_num"])
    default = {"x1": F.col("width") * 0.1, "y1": F.col("height") * 0.3, "x2": F.col("width") * 0.9, "y2": F.col("height") * 0.7}
    given = F.col("x1").isNotNull()
    x1, y1, x2, y2 = (F.when(given, F.col(s).cast("double")).otherwise(default[s]) for s in SIDES)
    percent = lambda v, of, other: F.when(of > 0, F.rint(F.try_divide(v, of) * 100)).otherwise(other).cast("int").cast("string")
    across = F.coalesce(F.try_divide((x1 + x2) / 2, F.col("width")), F.lit(0.5))
    side = F.when(across < 0.35, " 左半").when(across > 0.65, " 右半").otherwise("")
    place = F.concat(F.lit("~"), percent(y1, F.col("height"), 30), F.lit("%-"), percent(y2, F.col("height"), 70), F.lit("%"), side)
    rows = known.select("doc_id", "page_num", "width", "height", F.struct(((y1 + y2) / 2).alias("middle"), F.col("fig_idx").alias("fig_idx"), "filename", place.alias("place")).alias("item"), ((x2 - x1) * (y2 - y1)).alias("area"))
    whole = F.max(F.col("width").cast("double") * F.col("height"))
    found = rows.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list("item")).alias("items"), F.sum("area").alias("covered"), whole.alias("whole"))
    named = lambda f: F.transform("items", lambda x: x[f])
    return found.select("doc_id", "page_num", named("filename").alias("filenames"), named("place").alias("places"), F.coalesce(F.rint(F.try_divide("covered", "whole") * 100), F.lit(0)).cast("int").alias("coverage"))
