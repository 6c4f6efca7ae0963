"""Prompts as column expressions.  The wording is this library's own; sections and data are fixed by their use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text

SYSTEM = """\
You turn one page image of a document into Markdown.
1. Transcribe every visible character; rely on the image alone.
2. Leave out page headers, footers and page numbers.
3. Put each supplied image where its position says, as ![](images/name); do not retell what it shows.
4. Tables are Markdown tables with a constant number of columns.
5. Code goes into fences with its language.
6. Formulas are LaTeX, $...$ inline and $$...$$ on their own.
7. Continue the heading levels and numbers of the outline; contents pages are lists.
8. If the previous page breaks off inside a sentence, begin with its rest.
9. If it breaks off inside a table, go on with rows, without repeating the header.
Answer with the Markdown alone, without a fence and without coordinates."""
STITCH_SYSTEM = """\
You mend the start of a page. Given the end of the page before, which is correct, and the start of the
next, drop from the start what repeats the end, and let it continue an unfinished sentence or table
row directly. Keep headings, images, comments and table rows as they are; never
rewrite or add. Answer with the mended start alone."""
CONTEXT = "Describe this document from its first page in two or three sentences: its kind, its subject, how headings are numbered. Answer with the description alone."
DETECT_SYSTEM = "You locate figures on page images. Each box covers a whole figure, sub-figures together; plain text, logos, headers and footers are none. Answer with JSON alone."
VERIFY_SYSTEM = "You review crops of figures against the whole page. When in doubt keep a crop; merge fragments; reject only plain text or decoration. Answer with JSON alone."


def _context(doc_context: Column) -> Column:
    return F.when(F.coalesce(doc_context, F.lit("")) != "", F.concat(F.lit("About the document: "), doc_context, F.lit("\n\n"))).otherwise("")


def detect(doc_context: Column) -> Column:
    return F.concat(
        _context(doc_context),
        F.lit('Find all figures, charts, diagrams, photographs and drawings on this page.\nNot wanted: running text, captions, bordered text tables, headers, footers, page numbers.\nBoxes must not cut off any part of a figure and should hold no paragraph of text.\nAnswer: [{"bbox": [x1, y1, x2, y2], "desc": "short description"}], coordinates from 0 to 1000, [] if there are none.'),
    )


def detect_again(doc_context: Column) -> Column:
    """The looser prompt for when nothing was found."""
    return F.concat(_context(doc_context), F.lit('Find anything on this page that is not text: pictures, charts, drawings, patterns.\nAnswer: [{"bbox": [x1, y1, x2, y2], "desc": "description"}], coordinates from 0 to 1000, [] if there is nothing.'))


def crop_lines(crops: Column) -> Column:
    """A line for each crop: number, file, size in pixels, description."""

    def line(c: Column, i: Column) -> Column:
        size = F.concat((c["x2"] - c["x1"]).cast("string"), F.lit(" by "), (c["y2"] - c["y1"]).cast("string"), F.lit(" pixels"))
        return F.concat((i + 1).cast("string"), F.lit(". "), c["filename"], F.lit(", "), size, F.when(c["desc"] != "", F.concat(F.lit(": "), c["desc"])).otherwise(""))

    return F.array_join(F.transform(crops, line), "\n")


def verify(crops: Column, page_num: Column, doc_context: Column) -> Column:
    return F.concat(
        _context(doc_context),
        F.lit("Page "), (page_num + 1).cast("string"), F.lit(" with numbered outlines, followed by "), F.size(crops).cast("string"), F.lit(" crops:\n"),
        crop_lines(crops),
        F.lit('\nFor each crop choose: accept (complete); reject (only text, decoration or a repeat); adjust with a new "bbox"; split with "regions" of "bbox" and "desc".\nAnswer: [{"index": 1, "action": "accept"}], coordinates from 0 to 1000.'),
    )


#: what the end of the page before asks for
IN_TABLE = "That page ends inside a table: go on with its rows, with as many columns, without header and separator."
IN_SENTENCE = "That page breaks off inside a sentence: begin with its rest."
FIRST_PAGE = "Nothing stands before this page."


def _before(tail: Column) -> Column:
    """The end of the page before, with what follows from an open sentence or table."""
    body = text.rstrip(tail)
    in_table = F.coalesce(text.is_table_row(F.try_element_at(F.filter(F.transform(text.lines(body), text.strip), lambda x: x != ""), F.lit(-1))), F.lit(False))
    open_ = (body != "") & ~body.rlike(text.ENDS_TAIL)
    hints = F.filter(F.array(F.when(in_table, IN_TABLE), F.when(open_, IN_SENTENCE)), lambda x: x.isNotNull())
    return F.when(tail == "", FIRST_PAGE).otherwise(F.array_join(F.concat(F.array(F.lit("The page before ends with:\n>>>"), tail, F.lit("<<<")), hints), "\n"))


def _pictures(filenames: Column, places: Column, coverage: Column) -> Column:
    def item(f: Column, i: Column) -> Column:
        place = F.coalesce(F.get(places, i), F.lit(""))
        return F.concat(F.lit("- "), f, F.when(place != "", F.concat(F.lit(" at "), place)).otherwise(""))

    percent = coverage.cast("string")
    share = F.when(coverage >= 30, F.concat(F.lit(", about "), percent, F.lit("% of the page; do not retell what they show"))).when(coverage > 0, F.concat(F.lit(", about "), percent, F.lit("% of the page"))).otherwise("")
    some = F.concat(F.lit("Pictures to place, from top to bottom ("), F.size(filenames).cast("string"), share, F.lit("):\n"), F.array_join(F.transform(filenames, item), "\n"))
    return F.when(F.size(filenames) > 0, some).otherwise("There are no pictures to place.")


def page(page_num: Column, total_pages: Column, doc_context: Column, outline: Column, tail: Column, filenames: Column, places: Column, coverage: Column) -> Column:
    """The task of converting one page; ``outline`` and ``tail`` are put between paragraphs of their own."""
    paragraphs = F.array(
        F.concat(F.lit("This is page "), (page_num + 1).cast("string"), F.lit(" of "), total_pages.cast("string"), F.lit(".")),
        F.when(F.coalesce(doc_context, F.lit("")) != "", F.concat(F.lit("About the document: "), doc_context)),
        F.when(outline != "", F.concat(F.lit("Headings so far:\n"), outline)),
        _before(tail),
        _pictures(filenames, places, coverage),
        F.lit("Transcribe the page as you were told."),
    )
    return F.array_join(F.filter(paragraphs, lambda s: s.isNotNull()), "\n\n")


# Fixed value: characters of a page that a review sees
PREVIEW = 3000


def review(md: Column, page_num: Column, filenames: Column) -> Column:
    images = F.when(F.size(filenames) > 0, F.concat(F.size(filenames).cast("string"), F.lit(" crops were supplied: "), F.array_join(filenames, ", "))).otherwise("")
    return F.concat(F.lit("Compare page "), (page_num + 1).cast("string"), F.lit(" with its conversion.\n"), images, F.lit("\n\nCONVERSION:\n"), F.left(md, F.lit(PREVIEW)), F.lit('\n\nIs the text complete, are images referenced, are formulas closed, are there no coordinates?\nAnswer: {"score": 0-100, "issues": ["..."]}'))


def stitch(tail: Column, head: Column) -> Column:
    return F.concat(F.lit("END OF THE PAGE BEFORE:\n"), tail, F.lit("\n\nSTART OF THE NEXT PAGE:\n"), head)
