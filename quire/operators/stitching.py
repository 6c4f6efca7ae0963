"""Pages to documents: outline, boundary classes, joining, image references.

The central table is ``pages``: doc_id, page_num (from 0), md.  Windows run over one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.boxes import let

# Headings kept in the outline, characters handed on to conversion and to stitching
OUTLINE_HEADINGS, CONVERT_TAIL, STITCH_TAIL = 80, 1200, 600


def in_document():
    """The pages of a document in order."""
    return W.partitionBy("doc_id").orderBy("page_num")


def headings(md: Column) -> Column:
    """The lines of a page that are headings of the outline."""
    return F.filter(text.lines(md), lambda x: x.rlike("^#{1,4} "))


def rolling_outline(pages: DataFrame, most: int = OUTLINE_HEADINGS) -> DataFrame:
    """``outline``: the last headings of all earlier pages, one a line.

    A page that has headings gathers those of the ``most`` latest such pages, itself included; any page
    has the outline of the last one before it.  So the work grows with the pages, however many a
    document has, and all windows share one shuffle.
    """
    rows = pages.withColumn("_own", headings(F.col("md"))).withColumn("_some", F.size("_own") > 0)
    latest = W.partitionBy("doc_id", "_some").orderBy("page_num").rowsBetween(1 - most, 0)
    rows = rows.withColumn("_upto", F.when(F.col("_some"), text.tail_of(F.flatten(F.collect_list("_own").over(latest)), most)))
    before = F.last("_upto", ignorenulls=True).over(in_document().rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("outline", F.array_join(F.coalesce(before, F.array().cast("array<string>")), "\n")).drop("_own", "_some", "_upto")


def previous_tail(pages: DataFrame, n: int = CONVERT_TAIL) -> DataFrame:
    """``prev_tail``: the last characters of the page before; empty on the first."""
    return pages.withColumn("prev_tail", F.coalesce(F.right(F.lag("md").over(in_document()), F.lit(n)), F.lit("")))


def boundaries(pages: DataFrame) -> DataFrame:
    """A row per page but the first: prev, curr and the tests of the boundary between them."""
    rows = pages.select("doc_id", "page_num", F.lag("md").over(in_document()).alias("prev"), F.col("md").alias("curr")).filter(F.col("prev").isNotNull())
    prev, curr = F.col("prev"), F.col("curr")
    return rows.withColumns({"prev_open": text.is_incomplete_sentence(prev), "curr_continues": text.is_continuation_start(curr), "needs_stitch": text.boundary_needs_stitch(prev, curr), "deduped": text.dedup_page_boundary(prev, curr)})


def accepted_replies(bounds: DataFrame, replies: DataFrame) -> DataFrame:
    """``bounds`` with ``fixed``: the model's page start where no guard refuses it, and ``refused``: why it does.

    ``replies``: doc_id, page_num, reply.
    """
    known = bounds.join(replies, ["doc_id", "page_num"], "left")
    tail, head = F.right(F.col("prev"), F.lit(STITCH_TAIL)), F.left(F.col("curr"), F.lit(STITCH_TAIL))
    clean = text.without_page_fence(F.col("reply"))
    return known.withColumn("refused", text.stitch_verdict(tail, head, clean)).withColumn("fixed", F.when(F.col("refused").isNull(), clean)).drop("reply")


def joined(pages: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """doc_id, md: the pages of each document as one text.

    A clean boundary is a blank line, or a line break inside a table.  Others are mended: by the
    model's reply if there is one that passes the guards, else by dropping what repeats; a sentence
    that breaks off and goes on is glued by a single line break.  Every page looks at the original
    text before it, so all boundaries are judged at once.
    """
    rows = pages.select("doc_id", "page_num", "md", F.lag("md").over(in_document()).alias("prev"))
    if replies is None:
        rows = rows.withColumn("fixed", F.lit(None).cast("string"))
    else:
        rows = accepted_replies(rows.withColumnRenamed("md", "curr"), replies).withColumnRenamed("curr", "md")
    prev, md, fixed = F.col("prev"), F.col("md"), F.col("fixed")
    rest = F.substring(md, STITCH_TAIL + 1, F.char_length(md))
    start = text.no_newlines_before(fixed)
    # each test is a column of its own, so that later ones do not repeat it; all but the first are of unclean boundaries
    rows = rows.withColumn("unclean", F.when(prev.isNotNull() & ~text.is_blank(md), text.boundary_needs_stitch(prev, md)))
    unclean, open_, cut, kind = (F.col(c) for c in ("unclean", "open", "cut", "kind"))
    rows = rows.withColumns({"open": F.when(unclean, text.is_incomplete_sentence(prev)), "cut": F.when(unclean & fixed.isNull(), text.dedup_page_boundary(prev, md))})
    last, first = text.strip(text.last_line(text.rstrip(prev))), text.strip(text.first_line(text.no_newlines_before(md)))
    rows = rows.withColumn(
        "kind",
        F.when(prev.isNull(), "first")
        .when(text.is_blank(md), "skip")
        .when(~unclean, F.when(text.is_table_row(last) & text.is_table_row(first), "row").otherwise("clean"))
        .when(fixed.isNotNull(), F.when(open_ & (start != "") & ~start.rlike(rf"^{text.B}*#"), "fix-glue").otherwise("fix"))
        .when(text.is_blank(cut), "skip")
        .when(open_ & text.is_continuation_start(cut), "glue")
        .otherwise("mended"),
    )
    part = (
        F.when(kind == "first", md)
        .when(kind == "row", F.concat(F.lit("\n"), md))
        .when(kind == "clean", F.concat(F.lit("\n\n"), md))
        .when(kind == "fix-glue", F.concat(start, rest))
        .when(kind == "fix", F.concat(F.lit("\n\n"), fixed, rest))
        .when(kind == "glue", text.no_newlines_before(cut))
        .otherwise(F.concat(F.lit("\n\n"), cut))
    )
    # skipped pages are left out of the list, not by a filter, which would be moved below the tests and repeat them
    listed = rows.groupBy("doc_id").agg(F.collect_list(F.when(kind != "skip", F.struct("page_num", "kind", part.alias("part")))).alias("parts"))

    def with_ends(parts: Column) -> Column:
        glued_next = lambda i: F.get(parts, i + 1)["kind"].isin("glue", "fix-glue")
        return F.transform(parts, lambda x, i: F.when(glued_next(i), F.concat(text.no_newlines_after(x["part"]), F.lit("\n"))).otherwise(x["part"]))

    return listed.select("doc_id", F.array_join(let(F.array_sort("parts"), with_ends), "").alias("md"))


def plain_joined(pages: DataFrame) -> DataFrame:
    """doc_id, plain: the non-blank pages with a blank line between."""
    rows = pages.filter(~text.is_blank(F.col("md")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "md"))), lambda x: x["md"]), "\n\n").alias("plain"))


def with_unreferenced_images(md: Column, files: Column) -> Column:
    """``md`` with a reference at its end for each file that it does not name."""
    missing = F.filter(files, lambda f: ~F.contains(md, f))
    return F.concat(md, F.array_join(F.transform(missing, lambda f: F.concat(F.lit("\n\n![](images/"), f, F.lit(")"))), ""))


def image_loss_fallback(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``documents`` (doc_id, md), joined plainly wherever a page (with image_files) lost all its images."""
    files = pages.filter(F.size("image_files") > 0).groupBy("doc_id").agg(F.collect_list("image_files").alias("files"))
    # one join on the documents alone: what makes them is not run again to look for names
    known = documents.join(files, "doc_id", "left").join(plain_joined(pages), "doc_id", "left")
    lost = F.exists("files", lambda page: ~F.exists(page, lambda f: F.contains(F.col("md"), f)))
    known = known.withColumn("fell_back", F.coalesce(lost, F.lit(False)))
    return known.select("doc_id", F.when(F.col("fell_back"), F.coalesce("plain", F.lit(""))).otherwise(F.col("md")).alias("md"), "fell_back")


def retried(score: Column, issues: Column) -> Column:
    """A page is tried once more if its review names issues and scores it under 60."""
    return F.coalesce((F.size(issues) > 0) & (score < 60), F.lit(False))


def page_that_stays(page_num: Column, one: dict[str, Column], two: dict[str, Column], tried: Column) -> Column:
    """The Markdown of a page from its tries (md, error, score): the second where it was made (``tried``) and scores higher."""
    name = F.concat(F.lit("<!-- 第"), (page_num + 1).cast("string"), F.lit("页转换失败"))
    blank = lambda x: F.coalesce(text.is_blank(x["md"]), F.lit(True))
    better = tried & ~blank(two) & two["error"].isNull() & (two["score"] > one["score"])
    return F.when(one["error"].isNotNull(), F.concat(name, F.lit(": "), one["error"], F.lit(" -->"))).when(blank(one), F.concat(name, F.lit(" -->"))).when(better, two["md"]).otherwise(one["md"])


def chosen_attempt(attempts: DataFrame) -> DataFrame:
    """doc_id, page_num, md of the attempt that stays.

    ``attempts``: doc_id, page_num, attempt (1 or 2), md, error, score, issues.
    """
    of = lambda k: F.max(F.when(F.col("attempt") == k, F.struct("md", "error", "score", "issues"))).alias(f"try{k}")
    both = attempts.groupBy("doc_id", "page_num").agg(of(1), of(2))
    one, two = ({c: F.col(f"try{k}.{c}") for c in ("md", "error", "score", "issues")} for k in (1, 2))
    tried = retried(one["score"], one["issues"])
    return both.select("doc_id", "page_num", page_that_stays(F.col("page_num"), one, two, tried).alias("md"), tried.alias("retried"))
