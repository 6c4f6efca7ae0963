"""All queries of the library by name, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import sql
from quire.functions import boxes, replies, text
from quire.inputs import FIGURES_SQL, LINES_SQL, PAGES_SQL, figure_rows, figures_fx, lines_fx, pages_fx, table
from quire.operators import figures, large_pages, stitching, tables
from quire.plans import conversion, models, prompts
from quire.sources import images, pdf, sink, storage

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)



def _md():
    return F.col("md")


# --- repairs of one text ---------------------------------------------------------------------------

_CRLF = "CASE WHEN page_num % 3 = 0 THEN replace(md, chr(10), chr(13) || chr(10)) WHEN page_num % 3 = 1 THEN replace(md, chr(10), chr(10) || chr(13) || chr(10) || chr(13)) ELSE replace(md, chr(10), chr(10) || chr(10) || chr(10) || chr(10)) END"


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_num, regexp_replace(replace(replace({_CRLF}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS md FROM pages_fx")
def newline_blank_collapse(spark, d):
    k = F.col("page_num") % 3
    wild = F.when(k == 0, F.replace(_md(), F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.replace(_md(), F.lit("\n"), F.lit("\n\r\n\r"))).otherwise(F.replace(_md(), F.lit("\n"), F.lit("\n\n\n\n")))
    return pages_fx(spark, d).select("doc_id", "page_num", text.blank_lines_collapsed(text.unix_newlines(wild)).alias("md"))


@query(
    f"""WITH {PAGES_SQL}, t AS (SELECT doc_id, page_num, replace(md, '## ', '# ') AS md FROM pages_fx),
s AS (SELECT *, CASE WHEN starts_with(md, '# ') THEN 1 WHEN instr(md, chr(10) || '# ') > 0 THEN instr(md, chr(10) || '# ') + 1 ELSE 0 END AS p FROM t)
SELECT doc_id, page_num, CASE WHEN p = 0 THEN md ELSE left(md, p + 1) || regexp_replace(substr(md, p + 2), '(?m)^# ', '## ', 'g') END AS md FROM s"""
)
def single_h1(spark, d):
    return pages_fx(spark, d).select("doc_id", "page_num", text.single_h1(F.replace(_md(), F.lit("## "), F.lit("# "))).alias("md"))


_BROKEN = "CASE page_num % 4 WHEN 0 THEN replace(md, '![](images/', '[](images/') WHEN 1 THEN replace(md, '](images/', '](') WHEN 2 THEN replace(md, '.png)', '.png) ![](images/page7_fig2.png)') ELSE '```markdown' || chr(10) || md || chr(10) || '```' END"


def _broken() -> object:
    k = F.col("page_num") % 4
    return (
        F.when(k == 0, F.replace(_md(), F.lit("![](images/"), F.lit("[](images/")))
        .when(k == 1, F.replace(_md(), F.lit("](images/"), F.lit("](")))
        .when(k == 2, F.replace(_md(), F.lit(".png)"), F.lit(".png) ![](images/page7_fig2.png)")))
        .otherwise(F.concat(F.lit("```markdown\n"), _md(), F.lit("\n```")))
    )


@query(
    f"""WITH {PAGES_SQL}, t AS (SELECT doc_id, page_num, {_BROKEN} AS md FROM pages_fx),
f AS (SELECT doc_id, page_num, regexp_replace(regexp_replace(md, '^```markdown\\s*\\n', ''), '\\n```\\s*\\z', '') AS md FROM t),
x AS (SELECT doc_id, page_num, replace(replace(replace(md, '![](images/', chr(1)), '[](images/', '![](images/'), chr(1), '![](images/') AS md FROM f),
p AS (SELECT doc_id, page_num, regexp_replace(md, '!\\[([^\\]]*)\\]\\((page\\d+_(?:img|fig)\\d+\\.png)\\)', '![\\1](images/\\2)', 'g') AS md FROM x)
SELECT doc_id, page_num, regexp_replace(md, '(!\\[[^\\]]*\\]\\(images/[^)]+\\.png\\))[ \\t]*(!\\[[^\\]]*\\]\\(images/)', '\\1' || chr(10) || '\\2', 'g') AS md FROM p"""
)
def image_ref_repair(spark, d):
    return pages_fx(spark, d).select("doc_id", "page_num", text.image_refs_repaired(_broken()).alias("md"))


@query(
    f"""WITH {PAGES_SQL}, t AS (SELECT doc_id, page_num, regexp_replace(md, '(?m)^- ', '<!-- Image (1, 2.5,3,4) -->' || chr(10) || '- ', 'g') AS md FROM pages_fx)
SELECT doc_id, page_num, regexp_replace(md, '(?m)^<!--\\s*Image\\s*\\([\\d,\\s.]+\\)\\s*-->\\s*$', '', 'g') AS md FROM t"""
)
def bbox_leak_strip(spark, d):
    leaked = F.regexp_replace(_md(), "(?m)^- ", "<!-- Image (1, 2.5,3,4) -->\n- ")
    return pages_fx(spark, d).select("doc_id", "page_num", text.without_box_comments(leaked).alias("md"))


# --- page boundaries ----------------------------------------------------------------------------------


@query(
    f"""WITH {PAGES_SQL}, h AS (SELECT doc_id, page_num, list_filter(string_split(md, chr(10)), lambda x: regexp_matches(x, '^#{{1,4}} ')) AS own FROM pages_fx),
a AS (SELECT doc_id, page_num, flatten(list(own) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS l FROM h)
SELECT doc_id, page_num, coalesce(array_to_string(l[-80:], chr(10)), '') AS outline FROM a"""
)
def rolling_outline(spark, d):
    return stitching.rolling_outline(pages_fx(spark, d)).select("doc_id", "page_num", "outline")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_num, coalesce(right(lag(md) OVER (PARTITION BY doc_id ORDER BY page_num), 1200), '') AS prev_tail FROM pages_fx")
def prev_tail(spark, d):
    return stitching.previous_tail(pages_fx(spark, d)).select("doc_id", "page_num", "prev_tail")


_LAGGED = f"{PAGES_SQL}, b AS (SELECT doc_id, page_num, lag(md) OVER (PARTITION BY doc_id ORDER BY page_num) AS prev, md AS curr FROM pages_fx), c AS (SELECT * FROM b WHERE prev IS NOT NULL)"


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_num, {sql.incomplete('md')} AS incomplete, {sql.continues('md')} AS continues FROM pages_fx")
def sentence_flags(spark, d):
    return pages_fx(spark, d).select("doc_id", "page_num", text.is_incomplete_sentence(_md()).alias("incomplete"), text.is_continuation_start(_md()).alias("continues"))


@query(f"WITH {_LAGGED} SELECT doc_id, page_num, {sql.needs_stitch('prev', 'curr')} AS needs_stitch, {sql.incomplete('prev')} AS prev_open, {sql.continues('curr')} AS curr_continues FROM c")
def boundary_class(spark, d):
    return stitching.boundaries(pages_fx(spark, d)).select("doc_id", "page_num", "needs_stitch", "prev_open", "curr_continues")


@query(f"WITH {_LAGGED}, e AS (SELECT *, {sql.with_lines('prev', 'curr')} FROM c) SELECT doc_id, page_num, {sql.deduped('prev', 'curr')} AS deduped FROM e")
def boundary_dedup(spark, d):
    return stitching.boundaries(pages_fx(spark, d)).select("doc_id", "page_num", "deduped")


_JOINED = f"""{PAGES_SQL}, b AS (SELECT doc_id, page_num, lag(md) OVER (PARTITION BY doc_id ORDER BY page_num) AS prev, md AS curr FROM pages_fx),
e AS (SELECT *, {sql.with_lines('prev', 'curr')} FROM b),
f AS (SELECT doc_id, page_num, prev, curr, {sql.deduped('prev', 'curr')} AS cut FROM e),
k AS (SELECT *, CASE WHEN prev IS NULL THEN 'first' WHEN {sql.strip('curr')} = '' THEN 'skip'
  WHEN NOT {sql.needs_stitch('prev', 'curr')} THEN CASE WHEN {sql.is_row(sql.strip(sql.last_line(sql.rstrip('prev'))))} AND {sql.is_row(sql.strip(sql.first_line("ltrim(curr, chr(10))")))} THEN 'row' ELSE 'clean' END
  WHEN {sql.strip('cut')} = '' THEN 'skip' WHEN {sql.incomplete('prev')} AND {sql.continues('cut')} THEN 'glue' ELSE 'mended' END AS kind FROM f),
p AS (SELECT doc_id, page_num, kind, CASE kind WHEN 'first' THEN curr WHEN 'row' THEN chr(10) || curr WHEN 'clean' THEN chr(10) || chr(10) || curr WHEN 'glue' THEN ltrim(cut, chr(10)) ELSE chr(10) || chr(10) || cut END AS part FROM k WHERE kind <> 'skip'),
g AS (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY page_num) AS following FROM p),
joined AS (SELECT doc_id, string_agg(CASE WHEN following = 'glue' THEN rtrim(part, chr(10)) || chr(10) ELSE part END, '' ORDER BY page_num) AS md FROM g GROUP BY doc_id)"""


@query(f"WITH {_JOINED} SELECT doc_id, regexp_replace(md, '\\n{{3,}}', chr(10) || chr(10), 'g') AS md FROM joined")
def stitched_documents(spark, d):
    whole = stitching.joined(pages_fx(spark, d))
    return whole.select("doc_id", text.blank_lines_collapsed(text.unix_newlines(_md())).alias("md"))


# --- images of pages ----------------------------------------------------------------------------------

_FILES_SQL = f"{PAGES_SQL}, n AS (SELECT doc_id, page_num, md, ['page' || (page_num * 4 + 1) || '_fig1.png', 'page' || (page_num * 4 + 2) || '_fig1.png'] AS files FROM pages_fx)"


def _with_files(spark, d):
    name = lambda k: F.concat(F.lit("page"), (F.col("page_num") * 4 + k).cast("string"), F.lit("_fig1.png"))
    return pages_fx(spark, d).withColumn("image_files", F.array(name(1), name(2)))


@query(f"WITH {_FILES_SQL} SELECT doc_id, page_num, md || array_to_string(list_transform(list_filter(files, lambda f: NOT contains(md, f)), lambda f: chr(10) || chr(10) || '![](images/' || f || ')'), '') AS md FROM n")
def unreferenced_images(spark, d):
    return _with_files(spark, d).select("doc_id", "page_num", stitching.with_unreferenced_images(_md(), F.col("image_files")).alias("md"))


@query(
    f"""WITH {_JOINED}, n AS (SELECT doc_id, page_num, md AS page_md, ['page' || (page_num * 4 + 1) || '_fig1.png', 'page' || (page_num * 4 + 2) || '_fig1.png'] AS files FROM pages_fx WHERE doc_id % 3 = 0 AND page_num = 0),
l AS (SELECT n.doc_id, bool_or(len(list_filter(files, lambda f: contains(md, f))) = 0) AS lost FROM n JOIN joined USING (doc_id) GROUP BY n.doc_id),
pl AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY page_num) AS plain FROM pages_fx WHERE {sql.strip('md')} <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(lost, false) THEN coalesce(plain, '') ELSE md END AS md, coalesce(lost, false) AS fell_back FROM joined LEFT JOIN l USING (doc_id) LEFT JOIN pl USING (doc_id)"""
)
def image_loss_fallback(spark, d):
    pages = _with_files(spark, d)
    pages = pages.withColumn("image_files", F.when((F.col("doc_id") % 3 == 0) & (F.col("page_num") == 0), F.col("image_files")).otherwise(F.array().cast("array<string>")))
    return stitching.image_loss_fallback(stitching.joined(pages), pages)


@query(
    f"""WITH {LINES_SQL}, t AS (SELECT doc_id, string_agg(m, chr(10) ORDER BY i) AS md FROM lines_fx GROUP BY doc_id),
r AS (SELECT doc_id, i FROM lines_fx WHERE (doc_id + i) % 11 = 9 AND i % 2 = 1)
SELECT t.doc_id, string_agg(CASE WHEN (l.doc_id + l.i) % 11 = 9 AND l.i % 2 = 0 THEN '' ELSE l.m END, chr(10) ORDER BY l.i) AS md FROM t JOIN lines_fx l ON l.doc_id = t.doc_id GROUP BY t.doc_id"""
)
def ghost_images(spark, d):
    """Of each document's images those on odd lines exist."""
    rows = lines_fx(spark, d)
    docs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), "\n").alias("md"))
    files = rows.filter("(doc_id + i) % 11 = 9 and i % 2 = 1").groupBy("doc_id").agg(F.collect_set(F.concat(F.lit("page"), F.col("i").cast("string"), F.lit("_fig1.png"))).alias("files"))
    known = docs.join(files, "doc_id", "left")
    return known.select("doc_id", tables.without_ghost_images(_md(), F.coalesce("files", F.array().cast("array<string>"))).alias("md"))


# --- boxes --------------------------------------------------------------------------------------------

_SIZED = "CAST(1000 + doc_id % 700 AS INTEGER) AS w, CAST(1400 + doc_id % 900 AS INTEGER) AS h"


def _size():
    return (F.col("doc_id") % 700 + 1000).cast("int"), (F.col("doc_id") % 900 + 1400).cast("int")



@query(
    f"""WITH {FIGURES_SQL}, s AS (SELECT *, x2 * (1 + fig_idx % 4) AS xx, {_SIZED} FROM figures_fx),
p AS (SELECT *, greatest(x1, y1, xx, y2) <= 1000 AS thousandths FROM s),
r AS (SELECT *, CAST(round_even(CASE WHEN thousandths THEN x1 / 1000 * w ELSE x1 END, 0) AS INTEGER) AS a, CAST(round_even(CASE WHEN thousandths THEN y1 / 1000 * h ELSE y1 END, 0) AS INTEGER) AS b,
 CAST(round_even(CASE WHEN thousandths THEN xx / 1000 * w ELSE xx END, 0) AS INTEGER) AS c, CAST(round_even(CASE WHEN thousandths THEN y2 / 1000 * h ELSE y2 END, 0) AS INTEGER) AS e FROM p)
SELECT doc_id, fig_idx, greatest(0, least(w, least(a, c))) AS px1, greatest(0, least(h, least(b, e))) AS py1, greatest(0, least(w, greatest(a, c))) AS px2, greatest(0, least(h, greatest(b, e))) AS py2 FROM r"""
)
def bbox_pixels(spark, d):
    b = boxes.to_pixels(boxes.box(F.col("x1"), F.col("y1"), F.col("x2") * (1 + F.col("fig_idx") % 4), F.col("y2")), *_size())
    return figure_rows(spark, d).select("doc_id", "fig_idx", *(b[s].alias(f"p{s}") for s in boxes.SIDES))


@query(
    f"""WITH {FIGURES_SQL}, s AS (SELECT *, x2 * (1 + fig_idx % 4) AS xx, {_SIZED} FROM figures_fx),
p AS (SELECT *, fig_idx % 3 = 0 OR greatest(x1, y1, xx, y2) > 1000 AS conv FROM s),
r AS (SELECT *, CASE WHEN conv THEN x1 / w * 1000 ELSE x1 END AS a, CASE WHEN conv THEN y1 / h * 1000 ELSE y1 END AS b, CASE WHEN conv THEN xx / w * 1000 ELSE xx END AS c, CASE WHEN conv THEN y2 / h * 1000 ELSE y2 END AS e FROM p)
SELECT doc_id, fig_idx, round(greatest(0, least(1000, least(a, c))), 6) AS nx1, round(greatest(0, least(1000, least(b, e))), 6) AS ny1, round(greatest(0, least(1000, greatest(a, c))), 6) AS nx2, round(greatest(0, least(1000, greatest(b, e))), 6) AS ny2 FROM r"""
)
def bbox_norm(spark, d):
    b = boxes.to_thousandths(boxes.box(F.col("x1"), F.col("y1"), F.col("x2") * (1 + F.col("fig_idx") % 4), F.col("y2")), *_size(), F.col("fig_idx") % 3 == 0)
    return figure_rows(spark, d).select("doc_id", "fig_idx", *(F.round(b[s], 6).alias(f"n{s}") for s in boxes.SIDES))


def _rows(df: DataFrame, column: str, *names: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(column).alias("pos", "f")).select("doc_id", F.col("pos").cast("long").alias("pos"), *(F.col(f"f.{n}").alias("descr" if n == "desc" else n) for n in names))


_LISTED = "l AS (SELECT doc_id, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'descr': 'f' || fig_idx} ORDER BY fig_idx) AS f FROM figures_fx GROUP BY doc_id)"


def _sql_keep(items: str, share: str) -> str:
    """Greedy fold in SQL: keeps what none of the kept boxes shares too much with."""
    inter = "greatest(0, least(k.x2, x.x2) - greatest(k.x1, x.x1)) * greatest(0, least(k.y2, x.y2) - greatest(k.y1, x.y1))"
    area = lambda v: f"(({v}.x2 - {v}.x1) * ({v}.y2 - {v}.y1))"
    of = f"least({area('k')}, {area('x')})" if share == "smaller" else f"({area('k')} + {area('x')} - {inter})"
    return f"list_reduce(list_transform({items}, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: len(list_filter(y, lambda x: {of} > 0 AND {inter} > 0.5 * {of})) > 0)) > 0 THEN acc ELSE acc || y END)"


@query(f"WITH {FIGURES_SQL}, {_LISTED}, k AS (SELECT doc_id, {_sql_keep('f', 'smaller')} AS f FROM l), u AS (SELECT doc_id, unnest(f) AS f, unnest(range(len(f))) AS pos FROM k) SELECT doc_id, pos, f.x1 AS x1, f.y1 AS y1, f.x2 AS x2, f.y2 AS y2, f.descr AS descr FROM u")
def overlap_dedup(spark, d):
    own = figures_fx(spark, d).select("doc_id", boxes.merged(F.col("figures"), F.array().cast(f"array<{boxes.FIGURE}>")).alias("figures"))
    return _rows(own, "figures", "x1", "y1", "x2", "y2", "desc")


@query(
    f"""WITH {FIGURES_SQL}, s AS (SELECT *, {_SIZED} FROM figures_fx),
r AS (SELECT doc_id, fig_idx, w, h, CAST(round_even(x1 / 1000 * w, 0) AS INTEGER) AS a, CAST(round_even(y1 / 1000 * h, 0) AS INTEGER) AS b, CAST(round_even(x2 / 1000 * w, 0) AS INTEGER) AS c, CAST(round_even(y2 / 1000 * h, 0) AS INTEGER) AS e FROM s),
q AS (SELECT doc_id, fig_idx, greatest(0, a - 5) AS x1, greatest(0, b - 5) AS y1, least(w, c + 5) AS x2, least(h, e + 5) AS y2 FROM r),
l AS (SELECT doc_id, list({{'filename': 'page' || (doc_id + 1) || '_fig' || fig_idx || '.png', 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY fig_idx) AS f FROM q WHERE x2 - x1 >= 20 AND y2 - y1 >= 20 GROUP BY doc_id),
k AS (SELECT doc_id, {_sql_keep('f', 'union')} AS f FROM l), u AS (SELECT doc_id, unnest(f) AS f, unnest(range(len(f))) AS pos FROM k)
SELECT doc_id, pos, f.filename AS filename, f.x1 AS x1, f.y1 AS y1, f.x2 AS x2, f.y2 AS y2 FROM u"""
)
def iou_dedup(spark, d):
    own = figures_fx(spark, d).select("doc_id", boxes.crops(F.col("figures"), F.col("doc_id"), *_size()).alias("crops"))
    return _rows(own, "crops", "filename", "x1", "y1", "x2", "y2")


@query(
    f"""WITH RECURSIVE {FIGURES_SQL},
e AS (SELECT a.doc_id, a.fig_idx AS u, b.fig_idx AS v FROM figures_fx a JOIN figures_fx b ON a.doc_id = b.doc_id AND a.fig_idx <> b.fig_idx
 WHERE greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2), greatest(a.y1, b.y1) - least(a.y2, b.y2)) < 40
 AND (greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(least(a.x2 - a.x1, b.x2 - b.x1), 1) > 0.3 OR greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(least(a.y2 - a.y1, b.y2 - b.y1), 1) > 0.3)),
r AS (SELECT doc_id, fig_idx AS node, fig_idx AS seen FROM figures_fx UNION SELECT r.doc_id, r.node, e.v FROM r JOIN e ON e.doc_id = r.doc_id AND e.u = r.seen),
c AS (SELECT doc_id, node, min(seen) AS label FROM r GROUP BY doc_id, node),
g AS (SELECT c.doc_id, label, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, array_to_string(list('f' || fig_idx ORDER BY fig_idx)[1:3], '; ') AS descr FROM c JOIN figures_fx f ON f.doc_id = c.doc_id AND f.fig_idx = c.node GROUP BY c.doc_id, label)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY label) - 1 AS pos, x1, y1, x2, y2, descr FROM g"""
)
def bbox_clusters(spark, d):
    own = figures_fx(spark, d).select("doc_id", boxes.clustered(F.col("figures")).alias("figures"))
    return _rows(own, "figures", "x1", "y1", "x2", "y2", "desc")


_PLANES = """planes_fx AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS place,
 CAST((l_orderkey * 7919 + l_partkey * 31) % 6000 AS DOUBLE) AS x1, CAST((l_partkey * 104729 + l_orderkey * 17) % 6000 AS DOUBLE) AS y1, CAST(l_quantity AS DOUBLE) AS w, CAST(5 + l_partkey % 90 AS DOUBLE) AS h FROM lineitem)"""


@query(
    f"""WITH RECURSIVE {_PLANES}, p AS (SELECT doc_id, place, x1, y1, x1 + w AS x2, y1 + h AS y2, CASE WHEN place % 4 = 0 THEN '' ELSE 'f' || place END AS descr FROM planes_fx),
e AS (SELECT a.doc_id, a.place AS u, b.place AS v FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.place <> b.place
 WHERE greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2), greatest(a.y1, b.y1) - least(a.y2, b.y2)) < 40
 AND (greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(least(a.x2 - a.x1, b.x2 - b.x1), 1) > 0.3 OR greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(least(a.y2 - a.y1, b.y2 - b.y1), 1) > 0.3)),
r AS (SELECT doc_id, place AS node, place AS seen FROM p UNION SELECT r.doc_id, r.node, e.v FROM r JOIN e ON e.doc_id = r.doc_id AND e.u = r.seen),
c AS (SELECT doc_id, node, min(seen) AS label FROM r GROUP BY doc_id, node)
SELECT c.doc_id, label AS place, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, coalesce(array_to_string((list(descr ORDER BY c.node) FILTER (WHERE descr <> ''))[1:3], '; '), '') AS descr FROM c JOIN p ON p.doc_id = c.doc_id AND p.place = c.node GROUP BY c.doc_id, label"""
)
def large_page_clusters(spark, d):
    """All lines of a supplier as boxes on one large page, clustered as rows."""
    from pyspark.sql import Window as W

    n = lambda c: F.col(c).cast("long")
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    x1, y1 = ((n("l_orderkey") * 7919 + n("l_partkey") * 31) % 6000).cast("double"), ((n("l_partkey") * 104729 + n("l_orderkey") * 17) % 6000).cast("double")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("place"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity")).alias("x2"), (y1 + 5 + n("l_partkey") % 90).alias("y2"))
    rows = storage.stored(rows.withColumn("desc", F.when(F.col("place") % 4 == 0, "").otherwise(F.concat(F.lit("f"), F.col("place").cast("string")))))
    return large_pages.clustered(rows, ["doc_id"]).withColumnRenamed("desc", "descr")


# documents of up to four pages of figures: order number by eights, page by remainder
_CROPS_SQL = f"""{FIGURES_SQL},
crops_fx AS (SELECT doc_id // 8 AS doc, doc_id % 8 AS page_num, fig_idx, 'page' || (doc_id % 8 + 1) || '_fig' || fig_idx || '.png' AS filename, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1,
  CAST(CASE WHEN fig_idx = 1 THEN x1 + 30 ELSE x2 END AS INTEGER) AS x2, CAST(CASE WHEN fig_idx = 1 THEN y1 + 20 ELSE y2 END AS INTEGER) AS y2 FROM figures_fx),
pages_of AS (SELECT DISTINCT doc, page_num, 600 AS width, 800 AS height FROM crops_fx)"""


def _crops_fx(spark, d):
    first = F.col("fig_idx") == 1
    page = F.col("doc_id") % 8
    rows = figure_rows(spark, d).select(
        F.floor(F.col("doc_id") / 8).alias("doc"), page.alias("page_num"), "fig_idx", F.concat(F.lit("page"), (page + 1).cast("string"), F.lit("_fig"), F.col("fig_idx").cast("string"), F.lit(".png")).alias("filename"),
        F.col("x1").cast("int").alias("x1"), F.col("y1").cast("int").alias("y1"), F.when(first, F.col("x1") + 30).otherwise(F.col("x2")).cast("int").alias("x2"), F.when(first, F.col("y1") + 20).otherwise(F.col("y2")).cast("int").alias("y2"),
    )
    rows = rows.withColumnRenamed("doc", "doc_id")
    return rows, rows.select("doc_id", "page_num").distinct().withColumns({"width": F.lit(600), "height": F.lit(800)})


@query(
    f"""WITH {_CROPS_SQL}, s AS (SELECT *, round_even((x2 - x1) / 10.0, 0) * 10 AS sw, round_even((y2 - y1) / 10.0, 0) * 10 AS sh FROM crops_fx),
t AS (SELECT doc, count(*) AS total FROM pages_of GROUP BY doc),
g AS (SELECT doc, sw, sh FROM s JOIN t USING (doc) GROUP BY doc, sw, sh, total HAVING total >= 3 AND count(DISTINCT page_num) > total * 0.5 AND avg((x2 - x1) * (y2 - y1) / 480000.0) < 0.08)
SELECT doc AS doc_id, page_num, filename FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc = s.doc AND g.sw = s.sw AND g.sh = s.sh)"""
)
def decorative_filter(spark, d):
    return figures.without_decorative(*_crops_fx(spark, d)).select("doc_id", "page_num", "filename")


@query(
    f"""WITH {_CROPS_SQL}, p AS (SELECT doc, page_num, fig_idx, filename, (y1 + y2) / 2.0 AS mid, (x2 - x1) * (y2 - y1) AS area,
 '~' || CAST(round_even(y1 / 800 * 100, 0) AS INTEGER) || '%-' || CAST(round_even(y2 / 800 * 100, 0) AS INTEGER) || '%' || CASE WHEN (x1 + x2) / 2.0 / 600 < 0.35 THEN ' 左半' WHEN (x1 + x2) / 2.0 / 600 > 0.65 THEN ' 右半' ELSE '' END AS place FROM crops_fx)
SELECT doc AS doc_id, page_num, string_agg(filename, ',' ORDER BY mid, fig_idx) AS filenames, string_agg(place, ',' ORDER BY mid, fig_idx) AS places, CAST(round_even(sum(area) / 480000.0 * 100, 0) AS INTEGER) AS coverage FROM p GROUP BY doc, page_num"""
)
def image_positions(spark, d):
    found = figures.positions(*_crops_fx(spark, d))
    return found.select("doc_id", "page_num", F.array_join("filenames", ",").alias("filenames"), F.array_join("places", ",").alias("places"), "coverage")


@query(
    f"""WITH {_CROPS_SQL} SELECT doc AS doc_id, page_num, fig_idx AS label, list_extract(['ff0000', '00b400', '0000ff', 'ff00ff', 'ffa000', '00c8c8', '8000ff', 'ff8000'], CAST((fig_idx - 1) % 8 + 1 AS INTEGER)) AS colour,
 x1 AS tag_x1, greatest(0, y1 - 22) AS tag_y1, x1 + 26 AS tag_x2, y1 AS tag_y2 FROM crops_fx"""
)
def overlay_geometry(spark, d):
    rows, _ = _crops_fx(spark, d)
    listed = rows.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("fig_idx", "x1", "y1", "x2", "y2"))).alias("c"))
    marks = listed.select("doc_id", "page_num", F.explode(boxes.overlay(F.col("c"))).alias("m"))
    return marks.select("doc_id", "page_num", F.col("m.label").cast("long").alias("label"), *(F.col(f"m.{c}").alias(c) for c in ("colour", "tag_x1", "tag_y1", "tag_x2", "tag_y2")))


@query(
    """WITH s AS (SELECT p_partkey AS k, CAST(p_size * 70 + 100 AS INTEGER) AS w, CAST(p_partkey % 3000 + 200 AS INTEGER) AS h FROM part)
SELECT k, CASE WHEN greatest(w, h) > 1600 THEN greatest(1, CAST(round_even(w * (CAST(1600 AS DOUBLE) / greatest(w, h)), 0) AS INTEGER)) ELSE w END AS width, CASE WHEN greatest(w, h) > 1600 THEN greatest(1, CAST(round_even(h * (CAST(1600 AS DOUBLE) / greatest(w, h)), 0) AS INTEGER)) ELSE h END AS height FROM s"""
)
def fit_sizes(spark, d):
    w, h = (F.col("p_size") * 70 + 100).cast("int"), (F.col("p_partkey") % 3000 + 200).cast("int")
    size = boxes.fitted(w, h, F.lit(1600))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), size["width"].alias("width"), size["height"].alias("height"))


# --- model replies, recorded as text -------------------------------------------------------------------

# a reply per figure row: good boxes, pixel boxes, bad items, fences, no JSON
_REPLY_SQL = f"""{FIGURES_SQL},
replies_fx AS (SELECT doc_id, fig_idx, x1, y1, x2, y2, CASE fig_idx % 6
  WHEN 0 THEN '```json' || chr(10) || '[{{"bbox": [' || CAST(x1 AS BIGINT) || ', ' || CAST(y1 AS BIGINT) || ', ' || CAST(x2 AS BIGINT) || ', ' || CAST(y2 AS BIGINT) || '], "desc": "a"}}]' || chr(10) || '```'
  WHEN 1 THEN '[{{"bbox_2d": [' || CAST(x1 AS BIGINT) || ', ' || CAST(y1 AS BIGINT) || ', ' || CAST(x2 AS BIGINT) || ', ' || CAST(y2 AS BIGINT) || '], "label": "b"}}, {{"desc": "no box"}}, 7]'
  WHEN 2 THEN '[{{"bbox": [1, 2, 3], "bbox_2d": [1, 2, 3, 4]}}]'
  WHEN 3 THEN '[{{"bbox": [1, 2, "3", 4]}}, {{"bbox": [' || CAST(x2 AS BIGINT) || ', 10, 5, 1200.5], "desc": ""}}]'
  WHEN 4 THEN 'no figures here'
  ELSE '{{"bbox": [1, 2, 3, 4]}}' END AS reply FROM figures_fx)"""


def _replies_fx(spark, d):
    n = lambda c: F.col(c).cast("long").cast("string")
    four = F.concat(n("x1"), F.lit(", "), n("y1"), F.lit(", "), n("x2"), F.lit(", "), n("y2"))
    k = F.col("fig_idx") % 6
    reply = (
        F.when(k == 0, F.concat(F.lit('```json\n[{"bbox": ['), four, F.lit('], "desc": "a"}]\n```')))
        .when(k == 1, F.concat(F.lit('[{"bbox_2d": ['), four, F.lit('], "label": "b"}, {"desc": "no box"}, 7]')))
        .when(k == 2, '[{"bbox": [1, 2, 3], "bbox_2d": [1, 2, 3, 4]}]')
        .when(k == 3, F.concat(F.lit('[{"bbox": [1, 2, "3", 4]}, {"bbox": ['), n("x2"), F.lit(', 10, 5, 1200.5], "desc": ""}]')))
        .when(k == 4, "no figures here")
        .otherwise('{"bbox": [1, 2, 3, 4]}')
    )
    return figure_rows(spark, d).withColumn("reply", reply)


_CLAMP = lambda a, b: f"round(greatest(0, least(1000, {a})), 6) AS {b}"


@query(
    f"""WITH {_REPLY_SQL}
SELECT doc_id, fig_idx, 'a' AS descr, {_CLAMP('x1', 'x1')}, {_CLAMP('y1', 'y1')}, {_CLAMP('x2', 'x2')}, {_CLAMP('y2', 'y2')} FROM replies_fx WHERE fig_idx % 6 = 0
UNION ALL SELECT doc_id, fig_idx, 'b', {_CLAMP('x1 / 1200 * 1000', 'x1')}, {_CLAMP('y1 / 1600 * 1000', 'y1')}, {_CLAMP('x2 / 1200 * 1000', 'x2')}, {_CLAMP('y2 / 1600 * 1000', 'y2')} FROM replies_fx WHERE fig_idx % 6 = 1
UNION ALL SELECT doc_id, fig_idx, '', {_CLAMP('5 / 1200.0 * 1000', 'x1')}, {_CLAMP('10 / 1600.0 * 1000', 'y1')}, {_CLAMP('x2 / 1200 * 1000', 'x2')}, {_CLAMP('1200.5 / 1600 * 1000', 'y2')} FROM replies_fx WHERE fig_idx % 6 = 3"""
)
def detection_json(spark, d):
    found = _replies_fx(spark, d).select("doc_id", "fig_idx", F.explode(replies.detected(F.col("reply"), F.lit(1200), F.lit(1600))).alias("f"))
    return found.select("doc_id", "fig_idx", F.col("f.desc").alias("descr"), *(F.round(F.col(f"f.{s}"), 6).alias(s) for s in boxes.SIDES))


@query(
    f"""WITH {FIGURES_SQL} SELECT doc_id, fig_idx, {_CLAMP('x1 / 1200 * 1000', 'x1')}, {_CLAMP('y1 / 1600 * 1000', 'y1')}, {_CLAMP('x2 / 1200 * 1000', 'x2')}, {_CLAMP('y2 / 1600 * 1000', 'y2')} FROM figures_fx WHERE fig_idx % 3 <> 2"""
)
def comment_boxes(spark, d):
    """Every third reply is no box; the others name theirs twice."""
    n = lambda c: F.col(c).cast("long").cast("string")
    comment = F.concat(F.lit("<!-- IMAGE ("), n("x1"), F.lit(","), n("y1"), F.lit(" , "), n("x2"), F.lit(","), n("y2"), F.lit(") -->"))
    reply = F.when(F.col("fig_idx") % 3 == 2, "<!-- Image (1, x, 3, 4) --> <!-- Image (1,2,3) -->").otherwise(F.concat(F.lit("```markdown\n# T\n"), comment, F.lit("\ntext\n"), comment, F.lit("\n```")))
    found = figure_rows(spark, d).withColumn("reply", reply).select("doc_id", "fig_idx", F.explode(replies.commented(F.col("reply"), F.lit(1200), F.lit(1600))).alias("f"))
    return found.select("doc_id", "fig_idx", *(F.round(F.col(f"f.{s}"), 6).alias(s) for s in boxes.SIDES))


@query(
    f"""WITH {FIGURES_SQL} SELECT doc_id, fig_idx, CASE fig_idx % 6 WHEN 0 THEN CAST(x1 AS INTEGER) % 100 WHEN 1 THEN 85 WHEN 2 THEN 80 WHEN 3 THEN 80 WHEN 4 THEN 40 ELSE 0 END AS score,
 CASE fig_idx % 6 WHEN 0 THEN 'a|b' WHEN 4 THEN '\\alpha' WHEN 5 THEN '空输出' ELSE '' END AS issues FROM figures_fx"""
)
def review_parse(spark, d):
    k = F.col("fig_idx") % 6
    reply = (
        F.when(k == 0, F.concat(F.lit('```json\n{"score": '), (F.col("x1").cast("int") % 100).cast("string"), F.lit(', "issues": ["a", "b"]}\n```')))
        .when(k == 1, '{"score": "85"}')
        .when(k == 2, '{"issues": []}')
        .when(k == 3, '{"score": 10, "issues": "text"}')
        .when(k == 4, '{"score": 40.9, "issues": ["\\alpha"]}')
        .otherwise('{"score": 90, "issues": []}')
    )
    got = replies.reviewed(F.when(k == 5, " \n").otherwise("some text"), reply)
    return figure_rows(spark, d).select("doc_id", "fig_idx", got["score"].alias("score"), F.array_join(got["issues"], "|").alias("issues"))


_EDITED_SQL = """CASE page_num % 6 WHEN 0 THEN curr WHEN 1 THEN replace(curr, '## ', '') WHEN 2 THEN replace(curr, '![](', '(') WHEN 3 THEN curr || ' <!-- x' WHEN 4 THEN replace(curr, '| ', '') ELSE curr || curr || curr || prev END"""


@query(
    f"""WITH {_LAGGED}, s AS (SELECT doc_id, page_num, right(prev, 600) AS tail, left(curr, 600) AS head, {_EDITED_SQL} AS raw FROM c),
t AS (SELECT *, {sql.strip('raw')} AS reply FROM s), r AS (SELECT *, regexp_replace(regexp_replace(reply, '\\A```markdown\\s*\\n', ''), '\\n```\\s*\\z', '') AS reply2 FROM t)
SELECT doc_id, page_num, CASE WHEN length(reply2) > length(head) * 1.1 + length(tail) * 0.3 THEN 'too long' WHEN {sql.strip('reply2')} = '' THEN 'blank'
 WHEN {sql.count('reply2', '(?m)^#{1,6} ')} < {sql.count('head', '(?m)^#{1,6} ')} THEN 'lost headings' WHEN {sql.count('reply2', '!' + chr(92) + '[')} < {sql.count('head', '!' + chr(92) + '[')} THEN 'lost images'
 WHEN {sql.count('reply2', '<!--')} <> {sql.count('reply2', '-->')} THEN 'open comment'
 WHEN len(list_filter(string_split(reply2, chr(10)), lambda x: {sql.is_row(sql.strip('x'))})) < len(list_filter(string_split(head, chr(10)), lambda x: {sql.is_row(sql.strip('x'))})) THEN 'lost table rows' ELSE 'accepted' END AS verdict FROM r"""
)
def stitch_guards(spark, d):
    k, curr, prev = F.col("page_num") % 6, F.col("curr"), F.col("prev")
    reply = (
        F.when(k == 0, curr)
        .when(k == 1, F.replace(curr, F.lit("## "), F.lit("")))
        .when(k == 2, F.replace(curr, F.lit("![]("), F.lit("(")))
        .when(k == 3, F.concat(curr, F.lit(" <!-- x")))
        .when(k == 4, F.replace(curr, F.lit("| "), F.lit("")))
        .otherwise(F.concat(curr, curr, curr, prev))
    )
    bounds = stitching.boundaries(pages_fx(spark, d)).select("doc_id", "page_num", "prev", "curr")
    judged = stitching.accepted_replies(bounds, bounds.select("doc_id", "page_num", reply.alias("reply")))
    return judged.select("doc_id", "page_num", F.coalesce("refused", F.lit("accepted")).alias("verdict"))


@query(
    f"""WITH {_CROPS_SQL}, r AS (SELECT doc, page_num, row_number() OVER (PARTITION BY doc, page_num ORDER BY fig_idx) - 1 AS k, filename, x1, y1, x2, y2 FROM crops_fx)
SELECT doc AS doc_id, page_num, filename, x1, y1, x2, y2 FROM r WHERE k % 4 = 0 OR k % 4 = 3
UNION ALL SELECT doc, page_num, filename, 55, 75, 305, 565 FROM r WHERE k % 4 = 2
"""
)
def crop_actions(spark, d):
    """Of each four crops: accepted, rejected, adjusted, and adjusted to something too small."""
    rows, pages = _crops_fx(spark, d)
    listed = rows.groupBy("doc_id", "page_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("fig_idx", "filename", "x1", "y1", "x2", "y2"))), lambda c: F.struct(c["filename"].alias("filename"), F.lit("").alias("desc"), *(c[s].alias(s) for s in boxes.SIDES))).alias("crops"))
    n = F.size("crops")

    def act(i):
        kind = F.element_at(F.array(F.lit('"accept"'), F.lit('"reject"'), F.lit('"adjust", "bbox": [100, 100, 500, 700]'), F.lit('"adjust", "bbox": [10, 10, 20, 20]')), (i % 4 + 1).cast("int"))
        return F.concat(F.lit('{"index": '), (i + 1).cast("string"), F.lit(', "action": '), kind, F.lit("}"))

    reply = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), act), ", "), F.lit("]"))
    known = listed.withColumn("actions", replies.actions(reply, n))
    done = known.select("doc_id", "page_num", F.explode(figures.executed(F.col("crops"), F.col("actions"), F.col("page_num"), F.lit(600), F.lit(800))).alias("c"))
    return done.select("doc_id", "page_num", F.col("c.filename").alias("filename"), *(F.col(f"c.{s}").alias(s) for s in boxes.SIDES))


@query(
    f"""WITH {PAGES_SQL} SELECT doc_id, page_num, CASE page_num % 5 WHEN 0 THEN '<!-- 第' || (page_num + 1) || '页转换失败 -->' WHEN 1 THEN '<!-- 第' || (page_num + 1) || '页转换失败: timeout -->' WHEN 2 THEN 'second' ELSE 'x' || md END AS md, page_num % 5 IN (2, 3) AS retried FROM pages_fx"""
)
def retry_selection(spark, d):
    """Blank, failed, better second try, worse second try, good at once."""
    k = F.col("page_num") % 5
    pages = pages_fx(spark, d)
    some, none = F.array(F.lit("x")), F.array().cast("array<string>")
    first = pages.select("doc_id", "page_num", F.lit(1).alias("attempt"), F.when(k == 0, " ").when(k == 1, None).otherwise(F.concat(F.lit("x"), _md())).alias("md"), F.when(k == 1, "timeout").alias("error"), F.when(k.isin(2, 3), 50).when(k == 4, 55).alias("score"), F.when(k == 4, none).otherwise(some).alias("issues"))
    second = pages.filter(k.isin(2, 3)).select("doc_id", "page_num", F.lit(2).alias("attempt"), F.lit("second").alias("md"), F.lit(None).cast("string").alias("error"), F.when(k == 2, 51).otherwise(50).alias("score"), some.alias("issues"))
    first = first.withColumn("issues", F.when(k.isin(0, 1), none).otherwise(F.col("issues")))
    return stitching.chosen_attempt(first.unionByName(second))


# --- small operators -----------------------------------------------------------------------------------

_STATS_SQL = "doc_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, CAST(length(t) + len(regexp_extract_all(t, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS utf16_length, CAST(len(regexp_extract_all(t, '(?m)^#{1,6}\\s')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all(t, '(?m)^\\|')) AS BIGINT) AS n_table_rows, CAST(len(regexp_extract_all(t, '!\\[')) AS BIGINT) AS n_images"


@query(f"WITH {LINES_SQL}, t AS (SELECT doc_id, string_agg(m, chr(10) ORDER BY i) || '😀' AS t FROM lines_fx GROUP BY doc_id) SELECT {_STATS_SQL} FROM t")
def doc_stats(spark, d):
    rows = lines_fx(spark, d).groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), "\n"), F.lit("😀")).alias("t"))
    return rows.select("doc_id", *(v.alias(k) for k, v in text.document_stats(F.col("t")).items()))


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_num, regexp_replace(md, '!\\[([^\\]]*)\\]\\(images/([^)]+)\\)', '![\\1](/image/t' || doc_id || '/\\2)', 'g') AS md FROM pages_fx")
def image_urls(spark, d):
    return pages_fx(spark, d).select("doc_id", "page_num", text.image_urls(_md(), F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("md"))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 92 WHEN event_id % 7 = 1 THEN NULL ELSE CAST(least(95, floor((event_id % 40 + 1) / 40.0 * 90 + 0.5) + 5) AS INTEGER) END AS percent,
 CASE WHEN event_type LIKE 'p%' THEN 'gemini' ELSE 'dashscope' END AS provider, CASE WHEN event_type LIKE 'p%' THEN 'gemini/gemini-3.1-pro-high' ELSE 'qwen3.5-plus' END AS model,
 strftime(ts, '%Y%m%d_%H%M%S') AS task, 'doc' || event_id || '.PDF' AS name, event_id % 2 = 0 AS is_pdf, 'data:text/plain;base64,' || to_base64(encode(event_type)) AS url FROM events"""
)
def service_fields(spark, d):
    """Progress, model routing, task ids, file names and data URLs of the web service."""
    k = F.col("event_id") % 7
    log = F.when(k == 0, "  拼接 40 页... [1/2]").when(k == 1, "  Phase B").otherwise(F.concat(F.lit("  ["), (F.col("event_id") % 40 + 1).cast("string"), F.lit("/40] [img:2]")))
    asked = F.when(F.col("event_type").startswith("p"), "gemini/gemini-3.1-pro-high").otherwise(F.concat(F.lit("other/"), "event_type"))
    path = F.concat(F.lit("..\\up/load/doc"), F.col("event_id").cast("string"), F.lit(".PDF"))
    model = text.known_model(asked)
    return table(spark, d, "events").select(
        "event_id", text.progress_percent(log).alias("percent"), text.provider_of(model).alias("provider"), model.alias("model"), text.task_id(F.col("ts")).alias("task"), text.safe_file_name(path).alias("name"),
        text.is_pdf_name(F.when(F.col("event_id") % 2 == 0, path).otherwise("a.txt")).alias("is_pdf"), text.data_url(F.lit("text/plain"), F.encode("event_type", "UTF-8")).alias("url"),
    )


@query(
    """WITH p AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, turn % 5 = 1 AS shown FROM conversations),
m AS (SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) FILTER (WHERE turn % 3 = 0 AND t <> '') AS instruction,
  string_agg(CASE WHEN role = 'assistant' THEN 'model:' ELSE 'user:' END || array_to_string(list_filter([CASE WHEN t <> '' THEN t END, CASE WHEN shown THEN '<image/gif ' || t || '>' END], lambda x: x IS NOT NULL), '+'), chr(10) ORDER BY turn)
    FILTER (WHERE turn % 3 <> 0 AND (t <> '' OR shown)) AS contents FROM p GROUP BY conv_id)
SELECT conv_id, coalesce(instruction, '') AS instruction, coalesce(contents, '') AS contents FROM m"""
)
def message_flattening(spark, d):
    """Every third turn as a system message; the others with a remote picture, broken data and, every fifth turn, a data URL beside the text."""
    url = lambda c: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), c.alias("url"))
    said = F.coalesce("text", F.lit(""))
    part = F.struct(F.lit("text").alias("type"), said.alias("text"), F.lit(None).cast("string").alias("url"))
    odd = [url(F.lit("https://host/picture.png")), url(F.lit("data:image/png;base64,%%%"))]
    shown = url(F.concat(F.lit("data:image/gif;base64,"), F.base64(F.encode(said, "UTF-8"))))
    parts = F.when(F.col("turn") % 3 == 0, F.array(part)).when(F.col("turn") % 5 == 1, F.array(part, *odd, shown)).otherwise(F.array(part, *odd))
    message = F.struct("turn", F.when(F.col("turn") % 3 == 0, "system").otherwise(F.col("role")).alias("role"), parts.alias("parts"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    flat = replies.flattened(F.col("messages"))
    told = lambda p: F.when(p["data"].isNotNull(), F.concat(F.lit("<"), p["mime_type"], F.lit(" "), F.decode(p["data"], "UTF-8"), F.lit(">"))).otherwise(p["text"])
    contents = F.array_join(F.transform(flat["contents"], lambda m: F.concat(F.when(m["role"] == "model", "model:").otherwise("user:"), F.array_join(F.transform(m["parts"], told), "+"))), "\n")
    return rows.select("conv_id", flat["system_instruction"].alias("instruction"), contents.alias("contents"))


@query(
    f"""WITH {PAGES_SQL}, t AS (SELECT *, coalesce(lag(md) OVER (PARTITION BY doc_id ORDER BY page_num), '') AS prev, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'ctx' END AS ctx FROM pages_fx)
SELECT doc_id, page_num, CASE WHEN ctx <> '' THEN 'About the document: ctx' || repeat(chr(10), 2) ELSE '' END AS context,
 'END OF THE PAGE BEFORE:' || chr(10) || right(prev, 600) || repeat(chr(10), 2) || 'START OF THE NEXT PAGE:' || chr(10) || left(md, 600) AS stitch,
 'Compare page ' || (page_num + 1) || ' with its conversion.' || chr(10) || CASE WHEN page_num % 2 = 0 THEN '2 crops were supplied: a.png, b.png' ELSE '' END || repeat(chr(10), 2) || 'CONVERSION:' || chr(10) || left(md, 3000) || repeat(chr(10), 2) ||
 'Is the text complete, are images referenced, are formulas closed, are there no coordinates?' || chr(10) || 'Answer: {{"score": 0-100, "issues": ["..."]}}' AS review FROM t"""
)
def model_prompts(spark, d):
    """The context that goes before detection prompts, and the prompts of stitching and review."""
    from pyspark.sql import Window as W

    rows = pages_fx(spark, d).withColumns({"prev": F.coalesce(F.lag("md").over(W.partitionBy("doc_id").orderBy("page_num")), F.lit("")), "ctx": F.when(F.col("doc_id") % 2 == 0, "").otherwise("ctx")})
    names = F.when(F.col("page_num") % 2 == 0, F.array(F.lit("a.png"), F.lit("b.png"))).otherwise(F.array().cast("array<string>"))
    context = F.regexp_replace(prompts.detect(F.col("ctx")), r"(?s)Find all.*", "")
    return rows.select("doc_id", "page_num", context.alias("context"), prompts.stitch(F.right("prev", F.lit(600)), F.left("md", F.lit(600))).alias("stitch"), prompts.review(_md(), F.col("page_num"), names).alias("review"))


@query(
    f"""WITH {_CROPS_SQL}
SELECT doc AS doc_id, page_num, 'Page ' || (page_num + 1) || ' with numbered outlines, followed by ' || count(*) || ' crops:' || chr(10) ||
 string_agg(rank || '. ' || filename || ', ' || (x2 - x1) || ' by ' || (y2 - y1) || ' pixels' || CASE WHEN rank % 2 = 0 THEN '' ELSE ': d' || rank END, chr(10) ORDER BY rank) AS listed
FROM (SELECT *, row_number() OVER (PARTITION BY doc, page_num ORDER BY fig_idx) AS rank FROM crops_fx) GROUP BY doc, page_num"""
)
def verify_prompts(spark, d):
    rows, _ = _crops_fx(spark, d)
    crops = F.transform(F.array_sort(F.collect_list(F.struct("fig_idx", "filename", *boxes.SIDES))), lambda c, i: F.struct(c["filename"].alias("filename"), F.when(i % 2 == 1, "").otherwise(F.concat(F.lit("d"), (i + 1).cast("string"))).alias("desc"), *(c[x].alias(x) for x in boxes.SIDES)))
    pages = rows.groupBy("doc_id", "page_num").agg(crops.alias("crops"))
    return pages.select("doc_id", "page_num", F.regexp_replace(prompts.verify(F.col("crops"), F.col("page_num"), F.lit("")), r"(?s)\nFor each crop choose.*", "").alias("listed"))


@query("SELECT l_orderkey AS doc_id, CAST(count(*) FILTER (WHERE 200 + CAST(l_quantity AS INTEGER) > 240) AS DOUBLE) / count(*) > 0.95 AS blank FROM lineitem GROUP BY l_orderkey")
def blank_crops(spark, d):
    """Grey values from the quantities of an order."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.lit(200) + F.col("l_quantity").cast("int")).alias("pixels"))
    return rows.select("doc_id", boxes.is_blank_crop(F.col("pixels")).alias("blank"))


@query(
    f"""WITH {PAGES_SQL}, t AS (SELECT doc_id, page_num, coalesce(right(lag(md) OVER (PARTITION BY doc_id ORDER BY page_num), 1200), '') AS tail, count(*) OVER (PARTITION BY doc_id) AS total FROM pages_fx),
b AS (SELECT *, {sql.rstrip('tail')} AS body FROM t),
h AS (SELECT *, list_extract(list_filter(list_transform(string_split(body, chr(10)), lambda x: {sql.strip('x')}), lambda x: x <> ''), -1) AS last, body <> '' AND NOT {sql.like('body', '(?:[。？！…」』”.?!:;]|' + chr(92) + '*' + chr(92) + '*|```)' + chr(92) + 'z')} AS is_open FROM b),
k AS (SELECT *, list_filter([CASE WHEN coalesce({sql.is_row('last')}, false) THEN '{prompts.IN_TABLE}' END, CASE WHEN is_open THEN '{prompts.IN_SENTENCE}' END], lambda x: x IS NOT NULL) AS hints FROM h)
SELECT doc_id, page_num, 'This is page ' || (page_num + 1) || ' of ' || total || '.' || repeat(chr(10), 2) || 'About the document: ctx' || repeat(chr(10), 2) ||
 CASE WHEN tail = '' THEN '{prompts.FIRST_PAGE}' ELSE 'The page before ends with:' || chr(10) || '>>>' || chr(10) || tail || chr(10) || '<<<' || array_to_string(list_transform(hints, lambda x: chr(10) || x), '') END || repeat(chr(10), 2) ||
 'There are no pictures to place.' || repeat(chr(10), 2) || 'Transcribe the page as you were told.' AS prompt FROM k"""
)
def page_prompts(spark, d):
    from pyspark.sql import Window as W

    pages = stitching.previous_tail(pages_fx(spark, d)).withColumn("total", F.count("*").over(W.partitionBy("doc_id")))
    none = F.array().cast("array<string>")
    return pages.select("doc_id", "page_num", prompts.page(F.col("page_num"), F.col("total"), F.lit("ctx"), F.lit(""), F.col("prev_tail"), none, none, F.lit(0)).alias("prompt"))


# --- tables ------------------------------------------------------------------------------------------


def _tables_fx(spark, d):
    """Documents whose lines turn into tables with headers, wrapped rows, gaps and repeats."""
    rows = lines_fx(spark, d)
    k = (F.col("doc_id") * 3 + F.col("i")) % 9
    cell = F.left("m", F.lit(12))
    row = F.concat(F.lit("| "), F.replace(cell, F.lit("|"), F.lit("/")), F.lit(" | "), F.col("i").cast("string"))
    line = F.when(k == 0, "| a | b |").when(k == 1, "|---|---|").when(k.isin(2, 3), F.concat(row, F.lit(" |"))).when(k == 4, row).when(k == 5, "rest of the cell").when(k == 6, "").otherwise(F.col("m"))
    return _as_documents(rows.select("doc_id", "i", line.alias("m")))


def _as_documents(rows):
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), "\n").alias("md"))


_TABLES_SQL = f"""WITH {LINES_SQL}, k AS (SELECT doc_id, i, m, (doc_id * 3 + i) % 9 AS k, '| ' || replace(left(m, 12), '|', '/') || ' | ' || i AS r FROM lines_fx),
tables_fx AS (SELECT doc_id, i, CASE k WHEN 0 THEN '| a | b |' WHEN 1 THEN '|---|---|' WHEN 2 THEN r || ' |' WHEN 3 THEN r || ' |' WHEN 4 THEN r WHEN 5 THEN 'rest of the cell' WHEN 6 THEN '' ELSE m END AS line FROM k), {sql.tables_repaired('tables_fx')}"""


@query(f"{_TABLES_SQL} SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS md FROM repaired GROUP BY doc_id")
def table_repair(spark, d):
    return _tables_fx(spark, d).select("doc_id", tables.tables_repaired(_md()).alias("md"))


@query(
    f"""{_TABLES_SQL}, p AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS md FROM repaired GROUP BY doc_id),
f AS (SELECT doc_id, list('page' || i || '_fig1.png') AS files FROM lines_fx WHERE (doc_id + i) % 11 = 9 AND i % 2 = 1 GROUP BY doc_id),
r AS (SELECT doc_id, md, coalesce(files, []) AS files, list_distinct(regexp_extract_all(md, '!\\[[^\\]]*\\]\\(images/[^)]+\\)')) AS refs FROM p LEFT JOIN f USING (doc_id)),
gone AS (SELECT *, list_reverse_sort(list_transform(list_filter(refs, lambda x: NOT list_contains(files, regexp_extract(x, '\\]\\(images/([^)]+)\\)\\z', 1))), lambda x: {{'n': length(x), 'x': x}})) AS ghosts FROM r)
SELECT doc_id, regexp_replace(list_reduce(list_transform(ghosts, lambda x: x.x), lambda t, x: replace(t, x, ''), md), '\\n{{3,}}', chr(10) || chr(10), 'g') AS md FROM gone"""
)
def postprocessed(spark, d):
    """Of each document's images those on odd lines exist."""
    files = lines_fx(spark, d).filter("(doc_id + i) % 11 = 9 and i % 2 = 1").select("doc_id", F.concat(F.lit("page"), F.col("i").cast("string"), F.lit("_fig1.png")).alias("filename"))
    return tables.postprocessed(_tables_fx(spark, d), files)


_BRIDGES = """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS n, CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s FROM lineitem),
e AS (SELECT doc_id, n, p, s, unnest(range(6)) AS k FROM r),
bridges_fx AS (SELECT doc_id, n * 6 + k AS i, CASE k WHEN 0 THEN CASE WHEN p % 4 = 0 THEN '| c | b |' WHEN p % 11 = 0 THEN '| a | b | c |' ELSE ' | a | b |' END WHEN 1 THEN '| :-- | --- |'
  WHEN 2 THEN CASE WHEN s % 3 = 0 THEN '|' || p || '|' || s ELSE '| ' || p || ' | ' || s || ' | ' END
  WHEN 3 THEN CASE s % 3 WHEN 0 THEN 'more ' || s ELSE 'Note: ' || s END WHEN 4 THEN CASE p % 5 WHEN 0 THEN '# h' WHEN 1 THEN ' ' ELSE 'between ' || p || ' ' END ELSE CASE p % 7 WHEN 0 THEN 'third' ELSE '' END END AS line FROM e)"""


@query(f"{_BRIDGES}, {sql.tables_repaired('bridges_fx')} SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS md FROM repaired GROUP BY doc_id")
def table_bridges(spark, d):
    """Orders as tables, a header for each line: notes between them, wrapped rows, other headers, headings."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("n"), F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"))
    p, s = F.col("p"), F.col("s")
    text_of = lambda c: c.cast("string")
    lines = F.array(
        F.when(p % 4 == 0, "| c | b |").when(p % 11 == 0, "| a | b | c |").otherwise(" | a | b |"),
        F.lit("| :-- | --- |"),
        F.when(s % 3 == 0, F.concat(F.lit("|"), text_of(p), F.lit("|"), text_of(s))).otherwise(F.concat(F.lit("| "), text_of(p), F.lit(" | "), text_of(s), F.lit(" | "))),
        F.when(s % 3 == 0, F.concat(F.lit("more "), text_of(s))).otherwise(F.concat(F.lit("Note: "), text_of(s))),
        F.when(p % 5 == 0, "# h").when(p % 5 == 1, " ").otherwise(F.concat(F.lit("between "), text_of(p), F.lit(" "))),
        F.when(p % 7 == 0, "third").otherwise(""),
    )
    rows = rows.select("doc_id", "n", F.posexplode(lines).alias("k", "m"))
    return _as_documents(rows.select("doc_id", (F.col("n") * 6 + F.col("k")).alias("i"), "m")).select("doc_id", tables.tables_repaired(_md()).alias("md"))


# --- lists, and what is held against independent versions in the tests ----------------------------------


_AFTER_ITEM = r"^(?:#{1,6} |!\[|```|[-*] |\d+[.)] |> |\||---)"


@query(
    f"""WITH {PAGES_SQL}, p AS (SELECT doc_id, page_num, replace(md, chr(10), chr(10) || chr(10)) AS md FROM pages_fx),
l AS (SELECT doc_id, page_num, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, page_num, {sql.lines('md')} AS ls FROM p)),
n AS (SELECT *, lag(line) OVER w AS item, lead(line) OVER w AS next FROM l WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY i)),
t AS (SELECT *, {sql.strip("CASE WHEN " + sql.like('item', sql.ITEM) + " THEN regexp_extract(item, '" + sql.ITEM + "', 1) ELSE '' END")} AS own FROM n),
d AS (SELECT *, line = '' AND item IS NOT NULL AND next IS NOT NULL AND {sql.like('item', sql.ITEM)} AND {sql.strip('next')} <> '' AND {sql.incomplete('own')} AND NOT {sql.like(sql.lstrip('next'), _AFTER_ITEM)} AND {sql.continues('next')} AS goes FROM t)
SELECT doc_id, page_num, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE goes IS NOT TRUE), '') AS md FROM d GROUP BY doc_id, page_num"""
)
def list_item_join(spark, d):
    rows = pages_fx(spark, d).select("doc_id", "page_num", F.replace(_md(), F.lit("\n"), F.lit("\n\n")).alias("md"))
    return rows.select("doc_id", "page_num", text.join_split_list_items(_md()).alias("md"))


def _stub():
    """A model that reads the page's text back from its image bytes."""
    said = lambda r: r["images"][0]["data"].decode() if r["images"] else ""
    return models.StubClient({"context": lambda r: "A text.", "detect": lambda r: '[{"bbox": [100, 100, 400, 400], "desc": "figure"}]' if len(said(r)) % 3 == 0 else "[]", "verify": lambda r: '[{"index": 1, "action": "adjust", "bbox": [90, 90, 500, 500]}]', "convert": said, "review": lambda r: '{"score": 90, "issues": []}'})


@query()
def convert_stub(spark, d):
    pages = pages_fx(spark, d).select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.lit(1200).alias("width"), F.lit(1600).alias("height"), F.encode("md", "UTF-8").alias("png"), F.lit(text.DEFAULT_MODEL).alias("model"))
    return conversion.documents(pages, _stub)


class _Lines:
    """A document whose pages are the lines of its file."""

    def __init__(self, file):
        self.lines = file.read().decode().split("\n")

    def __len__(self):
        return len(self.lines)

    def page(self, number):
        return len(self.lines[number]), 1, self.lines[number].encode()


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS page_num, CAST(length(line) AS INTEGER) AS width, md5(line) AS png FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)")
def pdf_page_ranges(spark, d):
    """The documents as files, written by the sink and read by the page source, a page for each line, long ones by several tasks."""
    folder = storage.shared_folder(spark)
    sink.write(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat("doc_id", F.lit(".pdf")).alias("name"), F.encode("text", "UTF-8").alias("data")), folder)
    pages = pdf.pages(spark, folder, lambda: _Lines, pages_per_task=256, whole_bytes=1 << 14)
    return pages.select("doc_id", "page_num", "width", F.md5("png").alias("png"))


@query(
    f"""WITH {LINES_SQL}, m AS (SELECT doc_id, string_agg(m, chr(10) ORDER BY i) AS md FROM lines_fx GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || '.md' AS name, md5(md) AS content FROM m
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'images/page' || i || '_fig1.png', md5(m) FROM lines_fx WHERE (doc_id + i) % 11 = 9
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || '_markdown.zip', NULL FROM m"""
)
def written_documents(spark, d):
    """What the sink has written, as it is read back: Markdown, crops, archives (their names)."""
    rows = lines_fx(spark, d)
    docs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), "\n").alias("md"))
    crops = rows.filter("(doc_id + i) % 11 = 9").select("doc_id", F.concat(F.lit("page"), F.col("i").cast("string"), F.lit("_fig1.png")).alias("filename"), F.encode("m", "UTF-8").alias("data"))
    made, folder = storage.stored(sink.file_rows(docs, crops)), storage.shared_folder(spark)
    sink.write(made.unionByName(sink.archives(made)), folder)
    found = sink.written(made.select("doc_id"), folder)
    return found.select("doc_id", "name", F.when(~F.col("name").endswith(".zip"), F.md5("data")).alias("content"))


def _silent():
    """A model that is not to be asked."""
    return models.StubClient({stage: lambda r: 1 / 0 for stage in ("convert", "review")})


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_num, text AS md, CASE WHEN turn % 3 = 1 THEN 2 ELSE 1 END AS attempts FROM conversations")
def remembered_pages(spark, d):
    """Conversations as documents, turns as pages, in waves; every third page is poor and tried twice.  A second run, whose model answers nothing, has it all."""
    poor = F.when(F.col("turn") % 3 == 1, "poor").otherwise("good")
    picture = F.array(F.struct(poor.alias("mime"), F.encode("text", "UTF-8").alias("data")))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.lit("ctx").alias("doc_context"), F.lit(text.DEFAULT_MODEL).alias("model"), picture.alias("images"))
    shown, pages = conversion.shown(rows.select("doc_id", "page_num", "images")), rows.drop("images")
    placed = spark.createDataFrame([], "doc_id long, page_num int, filenames array<string>, places array<string>, coverage int")
    memory = storage.shared_folder(spark)
    model = lambda: models.StubClient({"convert": lambda r: r["images"][0]["data"].decode(), "review": lambda r: f'{{"score": {30 if r["images"][0]["mime"] == "poor" else 90}, "issues": ["x"]}}'})
    conversion.transcribed(pages, placed, shown, conversion.Caller(model, memory))
    return conversion.transcribed(pages, placed, shown, conversion.Caller(_silent, memory, models.Limits(attempts=1)))


def _drawn():
    """A model that finds two figures, moves the first and would move the second onto blank paper."""
    found = '[{"bbox": [0, 0, 1000, 400], "desc": "top"}, {"bbox": [100, 600, 900, 900], "desc": "low"}]'
    moved = '[{"index": 1, "action": "adjust", "bbox": [0, 0, 1000, 450]}, {"index": 2, "action": "adjust", "bbox": [0, 550, 1000, 1000]}]'
    return models.StubClient({"detect": lambda r: found, "verify": lambda r: moved, "convert": lambda r: "Text", "review": lambda r: "{}"})


@query(
    """WITH p AS (SELECT s_suppkey AS doc_id, CAST(unnest(range(s_suppkey % 2 + 1)) AS INTEGER) AS page_num FROM supplier), c AS (SELECT unnest([{'fig': 1, 'w': 200, 'h': 95}, {'fig': 2, 'w': 170, 'h': 70}], recursive := true))
SELECT doc_id, page_num, 'page' || (page_num + 1) || '_fig' || fig || '.png' AS filename, CAST(w * h * 3 + length('P6.' || w || ' ' || h || '.255.') AS INTEGER) AS bytes FROM p, c"""
)
def written_crops(spark, d):
    """The crop files of pages that are dark above and white below, as they come back from storage."""
    pages = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("s_suppkey").cast("int") % 2)).alias("page_num"), F.lit(200).alias("width"), F.lit(200).alias("height"), F.lit("gemini/m").alias("model"))
    half = lambda colour: F.repeat(F.lit(colour), F.lit(200 * 100))
    pages = pages.withColumn("png", F.unhex(F.concat(F.hex(F.lit("P6\n200 200\n255\n")), half("282828"), half("FFFFFF"))))
    files = conversion.converted(pages, _drawn, codec=images.NetpbmCodec)[1]
    return files.select("doc_id", "page_num", "filename", F.octet_length("data").alias("bytes"))
