"""Text tests and repairs as DuckDB SQL, written on their own, to hold the Spark expressions against."""

from __future__ import annotations

from quire.functions.text import BLANKS

B = f"[{BLANKS}]"


def strip(x: str) -> str:
    return f"trim({x}, '{BLANKS}')"


def rstrip(x: str) -> str:
    return f"rtrim({x}, '{BLANKS}')"


def lstrip(x: str) -> str:
    return f"ltrim({x}, '{BLANKS}')"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def last_line(x: str) -> str:
    return f"list_extract({lines(x)}, -1)"


def first_line(x: str) -> str:
    return f"list_extract({lines(x)}, 1)"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


ITEM = r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+((?s:.+))\z"


def incomplete(text: str) -> str:
    last = last_line(rstrip(text))
    tail = strip(f"CASE WHEN {like(last, ITEM)} THEN regexp_extract({last}, '{ITEM}', 1) ELSE {last} END")
    return f"({last} <> '' AND NOT {like(last, '^(?:#{1,6} |!' + chr(92) + '[|```|>)')} AND {tail} <> '' AND NOT {like(tail, '(?:[。？！…」』”；：.?!;:]|' + chr(92) + '*' + chr(92) + '*)' + chr(92) + 'z')})"


def continues(text: str) -> str:
    s = lstrip(text)
    first = f"substr({s}, 1, 1)"
    plain = f"{s} <> '' AND NOT {like(s, '^(?:#{1,6} |!' + chr(92) + '[|```|[-*] |> |<)')}"
    words = "和与及或但而且的了着过把被让给对向从到也都还又才就只已不没无，、；：）】」』\",.;:)]'".replace("'", "''")
    return f"({plain} AND (contains('{words}', {first}) OR {like(first, '^' + chr(92) + 'p{Ll}')} OR ({like(first, '^[一-鿿]')} AND {like(f'left({s}, 5)', '[。？！，、]')})))"


def is_row(x: str) -> str:
    return like(x, r"(?s)^\|.*\|")


def needs_stitch(prev: str, curr: str) -> str:
    before, after = rstrip(prev), f"ltrim({curr}, chr(10))"
    last, first = strip(last_line(before)), strip(first_line(after))
    complete = like(before, r"(?:[。？！…」』”；.?!;:]|\*\*|```)\z")
    structural = like(first, r"^(?:#{1,6} |!\[|```|[-*] |> |---)")
    ended = like(last, r"^(?:#{1,6} |```|---|!\[)")
    pipes = lambda x: f"(length({x}) - length(replace({x}, '|', '')))"
    same = f"({is_row(last)} AND {is_row(first)} AND {pipes(last)} = {pipes(first)} AND {pipes(last)} > 1)"
    tail = f"list_transform({lines(before)}[-5:], lambda x: {strip('x')})"
    head = f"list_filter(list_transform({lines(after)}[1:3], lambda x: {strip('x')}), lambda x: length(x) > 10)"
    overlap = f"list_has_any({tail}, {head})"
    clean = f"({before} = '' OR {after} = '' OR ({complete} AND {structural}) OR ({ended} AND {structural}) OR {same})"
    return f"(NOT {clean} AND (NOT {complete} OR {overlap}))"


def deduped(prev: str, curr: str) -> str:
    """Uses columns old_l, new_l (trimmed lines) and new_raw of the row."""
    most = "least(8, len(old_l), len(new_l))"
    n = f"coalesce(list_max(list_filter(range(1, {most} + 1), lambda n: old_l[-n:] = new_l[1:n] AND len(list_filter(new_l[1:n], lambda x: x <> '')) > 0)), 0)"
    at = "coalesce(list_position(list_transform(new_l, lambda x: x <> ''), true), 0)"
    line = f"new_l[{at}]"
    again = f"({at} > 0 AND length({line}) > 15 AND list_contains(old_l[-({most}):], {line}))"
    after = lambda k: f"ltrim(array_to_string(new_raw[{k} + 1:], chr(10)), chr(10))"
    return f"CASE WHEN {prev} = '' OR {curr} = '' THEN {curr} WHEN {n} > 0 THEN {after(n)} WHEN {again} THEN {after(at)} ELSE {curr} END"


def with_lines(prev: str, curr: str) -> str:
    """Columns that ``deduped`` reads."""
    old, new = lines(rstrip(prev)), lines(f"ltrim({curr}, chr(10))")
    return f"list_transform({old}, lambda x: {strip('x')}) AS old_l, list_transform({new}, lambda x: {strip('x')}) AS new_l, {new} AS new_raw"


def tables_repaired(source: str) -> str:
    """CTEs from the relation ``source`` (doc_id, i, line) to ``repaired`` (doc_id, i, x): the lines that stay, by windows.

    Every step is islands of lines: a row and what follows it up to the next row; blocks of rows and of
    other lines; chains of tables that are joined.  Left out are two cases that change a table while it is joined:
    text with pipes between tables of one row, and text after a table of a header alone.
    """
    starts = lambda x, marks: "(" + " OR ".join(f"starts_with({x}, '{m}')" for m in marks) + ")"
    not_in_gap = ("#", "![", "- ", "* ", "> ", "```")
    ends_row = (*not_in_gap, "**", "注：", "注:", "Note:", "NOTE:")
    last_pipe = lambda x: f"(length({x}) - strpos(reverse({x}), '|') + 1)"
    before = lambda x: rstrip(f"left({x}, {last_pipe(x)} - 1)")
    after = lambda x: strip(f"substr({x}, {last_pipe(x)} + 1)")
    separator = like("x", r"^\|[\s:\-|]+\|$")
    return f"""
w0 AS (SELECT doc_id, i, line, {strip('line')} AS s, {is_row(strip('line'))} AS is_row FROM {source}),
w1 AS (SELECT *, sum(CAST(is_row AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM w0),
w2 AS (SELECT *, last_value(CASE WHEN s <> '' THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended, lag(s) OVER (PARTITION BY doc_id, island ORDER BY i) AS above FROM w1),
w3 AS (SELECT *, island > 0 AND NOT is_row AND (ends_with(ended, '|') OR {starts('s', ends_row)}) AS stops FROM w2),
w4 AS (SELECT *, sum(CAST(stops AS INTEGER)) OVER (PARTITION BY doc_id, island ORDER BY i) AS stopped FROM w3),
w5 AS (SELECT doc_id, island, string_agg(CASE WHEN is_row THEN s WHEN s = '' THEN '' WHEN above = '' THEN '<br>' || s ELSE ' ' || s END, '' ORDER BY i) AS x FROM w4 WHERE island > 0 AND stopped = 0 GROUP BY doc_id, island),
w6 AS (SELECT doc_id, w4.i, CASE WHEN is_row THEN CASE WHEN ends_with(w5.x, '|') THEN w5.x ELSE concat_ws('<br>', {before('w5.x')}, nullif({after('w5.x')}, '')) || ' |' END
  WHEN stops AND stopped = 1 AND s = '' AND ends_with(ended, '|') THEN '' ELSE line END AS x, is_row FROM w4 LEFT JOIN w5 USING (doc_id, island) WHERE is_row OR island = 0 OR stopped > 0),
b0 AS (SELECT *, coalesce(is_row <> lag(is_row) OVER (PARTITION BY doc_id ORDER BY i), true) AS turns FROM w6),
b1 AS (SELECT *, sum(CAST(turns AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS block, is_row AND {separator} AS sep FROM b0),
b2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS k, lead(sep) OVER (PARTITION BY doc_id, block ORDER BY i) AS over_sep FROM b1),
t0 AS (SELECT doc_id, block, is_row, min(i) AS i, CASE WHEN bool_or(k = 2 AND sep) THEN min(CASE WHEN k = 1 THEN x END) END AS header,
  arg_min(length(x) - length(replace(x, '|', '')) - 1, i) FILTER (WHERE NOT sep) AS cells,
  count(*) FILTER (WHERE {strip('x')} <> '') AS lines, bool_or({starts(strip('x'), not_in_gap)}) AS bad, string_agg({strip('x')}, '<br>' ORDER BY i) FILTER (WHERE {strip('x')} <> '') AS said FROM b2 GROUP BY doc_id, block, is_row),
t1 AS (SELECT *, lag(cells, 2) OVER w AS cells_before, lag(lines) OVER w AS gap, lag(bad) OVER w AS gap_bad, lag(is_row, 2) OVER w AS table_before FROM t0 WINDOW w AS (PARTITION BY doc_id ORDER BY block)),
t2 AS (SELECT *, is_row AND coalesce(table_before AND cells = cells_before AND (gap = 0 OR gap <= 3 AND header IS NOT NULL AND NOT gap_bad), false) AS joins FROM t1),
t3 AS (SELECT *, sum(CAST(is_row AND NOT joins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY block) AS chain, coalesce(lead(joins) OVER (PARTITION BY doc_id ORDER BY block), false) AND NOT is_row AS bridged FROM t2),
t4 AS (SELECT *, first_value(header) OVER (PARTITION BY doc_id, chain ORDER BY NOT is_row, block) AS first_header FROM t3),
l0 AS (SELECT b2.doc_id, b2.i, x, b2.is_row, t.bridged, t.said, t.i = b2.i AS first,
  CASE WHEN NOT b2.is_row THEN NOT t.bridged WHEN t.joins THEN NOT sep AND NOT coalesce(k <= 2 AND t.header = first_header, false)
  WHEN t.header IS NULL THEN NOT sep ELSE k <= 2 OR NOT sep AND NOT (x = t.header AND coalesce(over_sep, false)) END AS stays FROM b2 JOIN t4 t ON t.doc_id = b2.doc_id AND t.block = b2.block),
l1 AS (SELECT *, last_value(CASE WHEN is_row AND stays THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS home FROM l0),
g AS (SELECT doc_id, home, string_agg(said, '<br>' ORDER BY i) AS more FROM l1 WHERE bridged AND first AND said IS NOT NULL GROUP BY doc_id, home),
repaired AS (SELECT l1.doc_id, l1.i, CASE WHEN more IS NOT NULL THEN {before('x')} || '<br>' || more || ' |' ELSE x END AS x FROM l1 LEFT JOIN g ON g.doc_id = l1.doc_id AND g.home = l1.i AND l1.is_row WHERE stays)"""
