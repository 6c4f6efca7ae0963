"""Markdown text as column expressions: blanks, lines, sentence and boundary tests, repairs.

Everything is built from Spark functions, so it stays inside code generation.  Blanks and digits are
those of Unicode, lines end at ``\\n`` only, and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.boxes import let

# The characters that count as white space
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Characters that continue a sentence at the start of a page
CONTINUES = "和与及或但而且的了着过把被让给对向从到也都还又才就只已不没无" + "，、；：）】」』\"" + ",.;:)]'"
# Ends of a sentence, for an open sentence, a clean boundary and a truncated tail
ENDS_SENTENCE = r"[。？！…」』”；：.?!;:]\z|\*\*\z"
ENDS_BOUNDARY = r"[。？！…」』”；.?!;:]\z|\*\*\z|```\z"
ENDS_TAIL = r"[。？！…」』”.?!:;]\z|\*\*\z|```\z"
# How structural lines begin
STRUCTURAL = r"^(?:#{1,6} |!\[|```|[-*] |> |---)"
STRUCTURAL_END = r"^(?:#{1,6} |```|---|!\[)"
NOT_A_SENTENCE = r"^(?:#{1,6} |!\[|```|>)"
NOT_A_CONTINUATION = r"^(?:#{1,6} |!\[|```|[-*] |> |<)"
LIST_ITEM = r"(?s)^[ \t]*(?:[-*+]|\p{Nd}+[.)])[ \t]+(.+)\z"
AFTER_LIST_ITEM = r"^(?:#{1,6} |!\[|```|[-*] |\p{Nd}+[.)] |> |\||---)"

#: a regex class of ``BLANKS``
B = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def no_newlines_before(c: Column) -> Column:
    return F.ltrim(c, F.lit("\n"))


def no_newlines_after(c: Column) -> Column:
    return F.rtrim(c, F.lit("\n"))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def last_line(c: Column) -> Column:
    return F.element_at(lines(c), -1)


def first_line(c: Column) -> Column:
    return F.get(lines(c), F.lit(0))


def tail_of(a: Column, n: Column | int) -> Column:
    """The last ``n`` elements; all of a shorter array."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))


def is_blank(c: Column) -> Column:
    return lstrip(c) == ""


def is_table_row(line: Column) -> Column:
    """A trimmed line with a pipe at the start and another later."""
    return line.rlike(r"(?s)^\|.*\|")


# --- sentences and page boundaries -----------------------------------------------------------------


def _ends(c: Column, pattern: str) -> Column:
    """Does one of the ``ENDS_`` patterns match?  They look at three characters at most, and the rest is not searched."""
    return F.right(c, F.lit(3)).rlike(pattern)


def _begins(c: Column, pattern: str) -> Column:
    """Does a pattern of how structural lines begin match?  Seven characters tell."""
    return F.left(c, F.lit(7)).rlike(pattern)


def is_incomplete_sentence(text: Column) -> Column:
    """Does the text break off inside a sentence?"""

    def breaks_off(last: Column) -> Column:
        sentence = strip(F.when(last.rlike(LIST_ITEM), F.regexp_extract(last, LIST_ITEM, 1)).otherwise(last))
        return (last != "") & ~_begins(last, NOT_A_SENTENCE) & let(sentence, lambda tail: (tail != "") & ~_ends(tail, ENDS_SENTENCE))

    return let(last_line(rstrip(text)), breaks_off)


def is_continuation_start(text: Column) -> Column:
    """Does the text begin like the rest of a sentence?"""

    def goes_on(s: Column) -> Column:
        first = F.substring(s, 1, 1)
        plain = ~s.rlike(NOT_A_CONTINUATION) & (s != "")
        chinese = first.rlike(r"^[一-鿿]") & F.left(s, F.lit(5)).rlike(r"[。？！，、]")
        return plain & (F.contains(F.lit(CONTINUES), first) | first.rlike(r"^\p{IsLowercase}") | chinese)

    return let(F.left(lstrip(text), F.lit(7)), goes_on)


def _last_lines(text: Column, n: int) -> Column:
    """The last ``n`` lines, stripped, without blanks after the text."""
    return let(lines(rstrip(text)), lambda ls: F.transform(tail_of(ls, n), strip))


def boundary_needs_stitch(prev: Column, curr: Column) -> Column:
    """May the boundary between two pages be anything but a clean break?"""
    pipes = lambda c: F.regexp_count(c, F.lit(r"\|")) - 1
    filled = lambda a: F.filter(a, lambda x: x != "")

    def unclean(last: Column, first: Column, old: Column, new: Column) -> Column:
        # the last line is blank only if all is, and the first one empty only if all is
        complete, structural = _ends(last, ENDS_BOUNDARY), _begins(first, STRUCTURAL)
        same_table = is_table_row(last) & is_table_row(first) & (pipes(last) == pipes(first)) & (pipes(last) > 0)
        head = F.filter(F.transform(new, strip), lambda x: F.char_length(x) > 10)
        clean = (last == "") | (F.get(new, F.lit(0)) == "") | (complete & structural) | (_begins(last, STRUCTURAL_END) & structural) | same_table
        return ~clean & (~complete | F.arrays_overlap(filled(old), head))

    ends = F.struct(_last_lines(prev, 5).alias("old"), F.slice(lines(no_newlines_before(curr)), 1, 3).alias("new"))
    lines_beside = lambda r: F.struct(F.element_at(r["old"], -1).alias("last"), strip(F.get(r["new"], F.lit(0))).alias("first"), r["old"].alias("old"), r["new"].alias("new"))
    return let(let(ends, lines_beside), lambda r: unclean(r["last"], r["first"], r["old"], r["new"]))


def dedup_page_boundary(prev: Column, curr: Column) -> Column:
    """``curr`` without what its start repeats of the end of ``prev``."""

    def cut(old: Column, new: Column, start: Column) -> Column:
        most = F.least(F.lit(8), F.size(old), F.size(new))
        same = F.filter(F.sequence(F.lit(1), most), lambda n: (tail_of(old, n) == F.slice(start, F.lit(1), n)) & F.exists(F.slice(start, F.lit(1), n), lambda x: x != ""))
        after = lambda n: no_newlines_before(F.array_join(F.slice(new, n + 1, F.greatest(F.size(new), F.lit(1))), "\n"))

        def once_more(at: Column) -> Column:
            found = let(strip(F.get(new, (at - 1).cast("int"))), lambda line: (F.char_length(line) > 15) & F.array_contains(tail_of(old, most), line))
            return F.when((at > 0) & found, after(at.cast("int"))).otherwise(curr)

        first = F.array_position(F.transform(new, lambda x: lstrip(x) != ""), True)  # 0 if all are blank
        return let(F.coalesce(F.array_max(same), F.lit(0)), lambda overlap: F.when(overlap > 0, after(overlap)).otherwise(let(first, once_more)))

    ends = F.struct(_last_lines(prev, 8).alias("old"), lines(no_newlines_before(curr)).alias("new"))
    starts = lambda r: F.struct(r["old"].alias("old"), r["new"].alias("new"), F.transform(F.slice(r["new"], 1, 8), strip).alias("start"))
    return F.when((prev == "") | (curr == ""), curr).otherwise(let(let(ends, starts), lambda r: cut(r["old"], r["new"], r["start"])))


def join_split_list_items(text: Column) -> Column:
    """Drop the blank line between a list item and the continuation of its sentence."""

    def splits(item: Column, line: Column) -> Column:
        own = strip(F.regexp_extract(item, LIST_ITEM, 1))
        return F.coalesce(item.rlike(LIST_ITEM) & ~is_blank(line) & is_incomplete_sentence(own) & ~lstrip(line).rlike(AFTER_LIST_ITEM) & is_continuation_start(line), F.lit(False))

    # a gap is judged by the lines beside it alone: no line is item and continuation of one join
    own = F.transform(F.array(lines(text)), lambda ls: F.filter(ls, lambda x, i: (x != "") | ~splits(F.get(ls, i - 1), F.get(ls, i + 1))))
    return F.array_join(F.get(own, F.lit(0)), "\n")


def stitch_verdict(tail: Column, head: Column, reply: Column) -> Column:
    """Why a model's corrected page start is refused; null if it is accepted."""
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    rows = lambda c: F.size(F.filter(lines(c), lambda x: is_table_row(strip(x))))
    heading = r"(?md)^#{1,6} "
    return (
        F.when(reply.isNull(), "no reply")
        .when(F.char_length(reply) > F.char_length(head) * 1.1 + F.char_length(tail) * 0.3, "too long")
        .when(is_blank(reply), "blank")
        .when(count(reply, heading) < count(head, heading), "lost headings")
        .when(count(reply, r"!\[") < count(head, r"!\["), "lost images")
        .when(count(reply, "<!--") != count(reply, "-->"), "open comment")
        .when(rows(reply) < rows(head), "lost table rows")
    )


# --- fences of model replies -----------------------------------------------------------------------


def without_json_fence(reply: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(reply), rf"\A```(?:json)?{B}*", ""), rf"{B}*```\z", "")


def without_markdown_fence(reply: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(reply), rf"\A```(?:markdown)?{B}*", ""), rf"{B}*```\z", "")


def without_page_fence(reply: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(reply), rf"\A```markdown{B}*\n", ""), rf"\n```{B}*\z", "")


# --- repairs -----------------------------------------------------------------------------------------


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


# Pattern and replacement of each image reference repair, in order
IMAGE_REPAIRS = (
    (rf"\A```markdown{B}*\n", ""),
    (rf"\n```{B}*\z", ""),
    (rf"\n```{B}*\n\n```markdown{B}*\n", "\n\n"),
    (r"!\[\]\(images/page\p{Nd}*\[\]\(images/(page\p{Nd}+_(?:img|fig)\p{Nd}+\.png)\)", "![](images/$1)"),
    (r"(?<!!)\[\]\(images/", "![](images/"),
    (r"!\[([^\]]*)\]\((page\p{Nd}+_(?:img|fig)\p{Nd}+\.png)\)", "![$1](images/$2)"),
    (r"(!\[[^\]]*\]\(images/[^)]+\.png\))[ \t]*(!\[[^\]]*\]\(images/)", "$1\n$2"),
)


def image_refs_repaired(text: Column) -> Column:
    for pattern, new in IMAGE_REPAIRS:
        text = F.regexp_replace(text, pattern, new)
    return text


def without_box_comments(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?md)^<!--{B}*Image{B}*\((?:[\p{{Nd}},.]|{B})+\){B}*-->{B}*$", "")


def single_h1(text: Column) -> Column:
    """Only the first level-one heading stays one."""
    at = F.regexp_instr(text, F.lit("(?md)^# "))
    rest = F.regexp_replace(F.substring(text, at + 2, F.char_length(text)), "(?md)^# ", "## ")
    return F.when(at > 0, F.concat(F.left(text, at + 1), rest)).otherwise(text)


def blank_lines_collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


# --- small operators ----------------------------------------------------------------------------------


def document_stats(text: Column) -> dict[str, Column]:
    return {
        "n_lines": F.size(lines(text)).cast("long"),
        "utf16_length": (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"),
        "n_headings": F.regexp_count(text, F.lit(rf"(?md)^#{{1,6}}{B}")).cast("long"),
        "n_table_rows": F.regexp_count(text, F.lit(r"(?md)^\|")).cast("long"),
        "n_images": F.regexp_count(text, F.lit(r"!\[")).cast("long"),
    }


def image_urls(text: Column, task: Column) -> Column:
    """References to ``images/x`` as the web service serves them."""
    return F.regexp_replace(text, F.lit(r"!\[([^\]]*)\]\(images/([^)]+)\)"), F.concat(F.lit("![$1](/image/"), task, F.lit("/$2)")))


def progress_percent(log: Column) -> Column:
    """Percent done that a log line tells: 92 while pages are stitched, else from ``[i/n]``, else null."""
    i, n = (F.regexp_extract(log, r"\[([0-9]+)/([0-9]+)\]", k).try_cast("double") for k in (1, 2))
    pages = F.least(F.lit(95), F.floor(F.try_divide(i, n) * 90 + 0.5) + 5)
    return F.when(F.contains(log, F.lit("拼接")), 92).when(i.isNotNull() & (n > 0), pages).cast("int")


# The models to choose from and the default
MODELS = ("qwen3.5-flash", "qwen3.5-plus", "qwen3.6-plus", "gemini/gemini-3.1-pro-high")
DEFAULT_MODEL = "qwen3.5-plus"


def provider_of(model: Column) -> Column:
    return F.when(F.startswith(model, F.lit("gemini/")), "gemini").otherwise("dashscope")


def known_model(model: Column) -> Column:
    return F.when(model.isin(*MODELS), model).otherwise(DEFAULT_MODEL)


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\r?\n", ""))


def is_pdf_name(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".pdf"))


def task_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def safe_file_name(name: Column) -> Column:
    """The last part of a path, whichever slash it uses."""
    return F.regexp_extract(name, r"([^/\\]*)\z", 1)
