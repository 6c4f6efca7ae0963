"""Repair of Markdown tables that page and line breaks tore apart, ghost images, the whole repair.

Rows fold over lines with a growing state, so the table repair runs as an Arrow-batched function of
one text; everything else is column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text

_SEPARATOR = re.compile(r"\|[\s:\-|]+\|")
# What ends a wrapped row, and what a gap inside a table may not begin with
_ENDS_ROW = ("#", "![", "- ", "* ", "> ", "```", "**", "注：", "注:", "Note:", "NOTE:")
_NOT_IN_GAP = ("#", "![", "- ", "* ", "> ", "```")
_GAP_LINES = 3


def _is_row(line: str) -> bool:
    line = line.strip()
    return line.startswith("|") and line.count("|") > 1


def _is_separator(line: str) -> bool:
    return _SEPARATOR.fullmatch(line.strip()) is not None


#: a row whose last cell is still open: what ends at the last pipe, and what follows it
_OPEN = re.compile(r"(\|.*)\|([^|]*)", re.S)


def _closed(row: str, more: str = "") -> str:
    """A row that ends in a pipe; what followed the last pipe, and ``more``, go into the last cell."""
    row = row.strip()
    m = _OPEN.fullmatch(row)
    if not m or not (more or m[2]):
        return row
    return "<br>".join(x for x in (m[1].rstrip(), m[2].strip(), more) if x) + " |"


def unwrapped(lines: list[str]) -> list[str]:
    """Rows that were broken over several lines as one line each."""
    out, at = [], 0
    while at < len(lines):
        if not _is_row(lines[at]):
            out.append(lines[at])
            at += 1
            continue
        row, at = lines[at].strip(), at + 1
        blank, after = False, []
        while at < len(lines) and not _is_row(lines[at]):
            line = lines[at].strip()
            if row.endswith("|"):
                if not line:  # a blank line after a finished row stays, as an empty one
                    after, at = [""], at + 1
                break
            if line.startswith(_ENDS_ROW):
                break
            if line:
                row += f"{'<br>' if blank else ' '}{line}"
            blank, at = not line, at + 1
        out.append(_closed(row))
        out += after
    return out


def _blocks(lines: list[str]) -> list[tuple[bool, list[str]]]:
    blocks: list[tuple[bool, list[str]]] = []
    for line in lines:
        row = _is_row(line)
        if not blocks or blocks[-1][0] != row:
            blocks.append((row, []))
        blocks[-1][1].append(line.strip() if row else line)
    return blocks


def _shape(table: list[str]) -> tuple[int | None, str | None]:
    """Cells of the first row that is no separator, and the header if a separator stands below it."""
    kinds = [_is_separator(r) for r in table]
    cells = table[kinds.index(False)].count("|") - 1 if False in kinds else None
    return cells, table[0] if kinds[1:2] == [True] else None


def _bridged(one: list[str], gap: list[str], two: list[str]) -> list[str] | None:
    """Both tables as one, what stood between in the last cell; none where they do not belong together."""
    between = [line.strip() for line in gap if line.strip()]
    (cells, header), (cells2, header2) = _shape(one), _shape(two)
    may_hold = len(between) <= _GAP_LINES and header2 is not None and not any(line.startswith(_NOT_IN_GAP) for line in between)
    if cells is None or cells != cells2 or between and not may_hold:
        return None
    first = [*one[:-1], _closed(one[-1], "<br>".join(between))] if between else one
    return first + [r for r in two[2 if header and header == header2 else 0 :] if not _is_separator(r)]


def bridged(lines: list[str]) -> list[str]:
    """Tables joined across text that separates parts of one table, until none can be joined.

    A join can only change the verdict on the pair that ends with the joined table, so the search
    goes on from there.
    """
    blocks, at = _blocks(lines), 0
    while at + 2 < len(blocks):
        whole = _bridged(blocks[at][1], blocks[at + 1][1], blocks[at + 2][1]) if blocks[at][0] else None
        if whole is None:
            at += 1
        else:
            blocks[at : at + 3] = [(True, whole)]
            at = max(at - 2, 0)
    return [line for _, block in blocks for line in block]


def cleaned(lines: list[str]) -> list[str]:
    """One header and separator per table; repeats of either go."""
    out: list[str] = []
    for is_table, block in _blocks(lines):
        if not is_table:
            out += block
            continue
        header = _shape(block)[1]
        if header is not None:
            out += block[:2]
            block = block[2:]
        again = lambda k: header is not None and block[k] == header and k + 1 < len(block) and _is_separator(block[k + 1])  # noqa: B023, E731
        out += [r for k, r in enumerate(block) if not _is_separator(r) and not again(k)]
    return out


def repaired(md: str | None) -> str | None:
    if md is None or "|" not in md:
        return md
    return "\n".join(cleaned(bridged(unwrapped(md.split("\n")))))


def tables_repaired(md: Column) -> Column:
    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(repaired, na_action="ignore")

    return repair(md)


IMAGE_REF = r"!\[[^\]]*\]\(images/[^)]+\)"


def without_ghost_images(md: Column, files: Column) -> Column:
    """``md`` without references to images that are not among ``files`` (names under images/)."""
    refs = F.array_distinct(F.regexp_extract_all(md, F.lit(IMAGE_REF), F.lit(0)))
    path = lambda r: F.regexp_extract(r, r"\]\(images/([^)]+)\)\z", 1)
    ghosts = F.filter(refs, lambda r: ~F.array_contains(files, path(r)))
    # the longest first: one reference can end another's text
    longest = F.transform(F.sort_array(F.transform(ghosts, lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r"))), asc=False), lambda x: x["r"])
    return F.when(F.size(ghosts) > 0, F.aggregate(longest, md, lambda t, r: F.replace(t, r, F.lit("")))).otherwise(md)


def postprocessed(documents: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, md after all repairs. ``documents``: doc_id, md; ``files``: doc_id, filename."""
    md = text.single_h1(text.without_box_comments(text.image_refs_repaired(text.unix_newlines(F.col("md")))))
    rows = documents.select("doc_id", tables_repaired(md).alias("md"))
    own = files.groupBy("doc_id").agg(F.collect_set("filename").alias("files"))  # the images of one document
    known = rows.join(own, "doc_id", "left")
    clean = without_ghost_images(F.col("md"), F.coalesce("files", F.array().cast("array<string>")))
    return known.select("doc_id", text.blank_lines_collapsed(clean).alias("md"))
