import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text


def column(spark, of, *rows):
    width = max(len(r) if isinstance(r, tuple) else 1 for r in rows)
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, " + ", ".join(f"c{j} string" for j in range(width)))
    return [r[0] for r in df.orderBy("k").select(of(*(F.col(f"c{j}") for j in range(width)))).collect()]


def test_strips_all_unicode_blanks(spark):
    blanks = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert set(text.BLANKS) == set(blanks)
    assert column(spark, text.strip, blanks + "a b" + blanks) == ["a b"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("It goes on", True), ("It ends.", False), ("# Heading", False), ("text\n![](images/a.png)", False), ("- item goes on", True), ("- item ends。", False), ("", False), ("  \n", False), ("**bold**", False), ("one:", False), ("一；", False), ("> quote", False), ("12) open", True), ("ends ”", False), ("x \n\n", True)],
)
def test_incomplete_sentence(spark, value, want):
    assert column(spark, text.is_incomplete_sentence, value) == [want]


@pytest.mark.parametrize(
    ("value", "want"),
    [("and so", True), ("And so", False), ("的话", True), ("，但是", True), ("我们去，", True), ("我们去看电影，", False), ("- a", False), ("<b>", False), (", x", True), ("", False), ('"q', True), ("\n\n the", True), ("É", False), ("é", True)],
)
def test_continuation_start(spark, value, want):
    assert column(spark, text.is_continuation_start, value) == [want]


@pytest.mark.parametrize(
    ("prev", "curr", "want"),
    [("Done.", "# Next", False), ("Not done", "# Next", True), ("# Head", "# Next", False), ("| a | b |", "| c | d |", False), ("| a | b |", "| c |", True), ("", "x", False), ("x", "", False), ("A long enough line.", "A long enough line.\nmore", True), ("Done.", "Other text", False), ("ends：", "x", True), ("```", "text", False)],
)
def test_boundary(spark, prev, curr, want):
    assert column(spark, text.boundary_needs_stitch, (prev, curr)) == [want]


@pytest.mark.parametrize(
    ("prev", "curr", "want"),
    [("a\nb\nc", "b\nc\nd", "d"), ("a", "a", ""), ("x\nThis line is repeated here", "\n\nThis line is repeated here\nrest", "rest"), ("x\nshort", "\nshorter\ny", "\nshorter\ny"), ("", "a", "a"), ("a", "", ""), (" a ", "a\n\n\nb", "b"), ("q", "\n\n", "\n\n")],
)
def test_dedup(spark, prev, curr, want):
    assert column(spark, text.dedup_page_boundary, (prev, curr)) == [want]


def test_repairs(spark):
    assert column(spark, text.single_h1, "a\n# one\n# two", "# # x\n# y", "none") == ["a\n# one\n## two", "# ## x\n## y", "none"]
    assert column(spark, text.unix_newlines, "a\r\nb\rc\n") == ["a\nb\nc\n"]
    assert column(spark, text.without_box_comments, "a\n<!-- Image (1, 2,3.5,4) -->\n\nb", "<!-- image (1,2,3,4) -->", "x <!-- Image (1) -->") == ["a\n\nb", "<!-- image (1,2,3,4) -->", "x <!-- Image (1) -->"]
    broken = ("[](images/a.png)", "![x](page1_fig2.png)", "![](images/a.png) ![](images/b.png)", "```markdown\nx\n```", "![](images/page1[](images/page1_fig2.png)", "a\n```\n\n```markdown\nb")
    assert column(spark, text.image_refs_repaired, *broken) == ["![](images/a.png)", "![x](images/page1_fig2.png)", "![](images/a.png)\n![](images/b.png)", "x", "![](images/page1_fig2.png)", "a\n\nb"]


def test_repairs_are_idempotent(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["# ", "\n", "a", "\r", "\n\n\n", "x\r\n"]) for _ in range(30)) for _ in range(60)]
    for repair in (text.unix_newlines, text.single_h1, text.blank_lines_collapsed):
        once = column(spark, repair, *texts)
        assert column(spark, repair, *once) == once


def test_joins_split_list_items(spark):
    assert column(spark, text.join_split_list_items, "- item goes on\n\nand ends.", "- item ends.\n\nand", "- a b\n\n- c", "- one goes\n\n- two goes\n\non here") == ["- item goes on\nand ends.", "- item ends.\n\nand", "- a b\n\n- c", "- one goes\n\n- two goes\non here"]


def test_progress(spark):
    assert column(spark, text.progress_percent, "[1/2] ok", "[4/4]", "拼接 3 页", "x", "[1/0]") == [50, 95, 92, None, None]


def test_blank_classes_agree():
    blank = re.compile(text.B.replace("\\s", " \\t\\n\\r\\x0b\\x0c"))
    assert all(bool(blank.fullmatch(chr(c))) == chr(c).isspace() for c in range(0x3100))
