import random

from pyspark.sql import functions as F

from quire.functions import boxes, replies
from quire.operators import figures, stitching, tables


def test_wrapped_rows():
    assert tables.unwrapped(["| a | b", "rest", "", "more", "| c | d |", "", "text"]) == ["| a<br>b rest<br>more |", "| c | d |", "", "text"]
    assert tables.unwrapped(["| a | b |", "  ", "x"]) == ["| a | b |", "", "x"]
    assert tables.unwrapped(["| a | b", "# h"]) == ["| a<br>b |", "# h"]
    assert tables.unwrapped(["| a | b |", "text"]) == ["| a | b |", "text"]
    assert tables.unwrapped(["|a|", "Note: x"]) == ["|a|", "Note: x"]


def test_bridged_tables():
    one, two = ["| a | b |", "|---|---|", "| 1 | 2 |"], ["| a | b |", "|---|---|", "| 3 | 4 |"]
    assert tables.bridged([*one, "", *two]) == [*one, "| 3 | 4 |"]
    assert tables.bridged([*one, "note", *two]) == [*one[:2], "| 1 | 2<br>note |", "| 3 | 4 |"]
    assert tables.bridged([*one, "# head", *two]) == [*one, "# head", *two]
    assert tables.bridged([*one, "", "| x |"]) == [*one, "", "| x |"]
    assert tables.bridged([*one, "", "| 5 | 6 |", "", "| 7 | 8 |"]) == [*one, "| 5 | 6 |", "| 7 | 8 |"]


def merged_tables(lines):
    """Tables of a text joined, by rules written down on their own: one join at a time, from the top each time."""
    row = lambda x: x.strip()[:1] == "|" and "|" in x.strip()[1:]
    rule = lambda x: row(x) and set(x.strip()) <= set("|-: \t")
    lines = [x.strip() if row(x) else x for x in lines]
    while True:
        starts = [i for i, x in enumerate(lines) if row(x) and (not i or not row(lines[i - 1]))]
        spans = [(i, next((j for j in range(i, len(lines)) if not row(lines[j])), len(lines))) for i in starts]
        for (a, b), (c, e) in zip(spans, spans[1:]):
            one, gap, two = lines[a:b], [x.strip() for x in lines[b:c] if x.strip()], lines[c:e]
            width = [next((x.count("|") for x in t if not rule(x)), None) for t in (one, two)]
            head = [t[0] if len(t) > 1 and rule(t[1]) else None for t in (one, two)]
            if None in width or width[0] != width[1]:
                continue
            if gap and (len(gap) > 3 or not head[1] or any(x.startswith(("#", "![", "- ", "* ", "> ", "```")) for x in gap)):
                continue
            if gap:
                one = [*one[:-1], one[-1].rstrip("| ") + "<br>" + "<br>".join(gap) + " |"]
            two = [x for x in (two[2:] if head[0] and head[0] == head[1] else two) if not rule(x)]
            lines = lines[:a] + one + two + lines[e:]
            break
        else:
            return lines


def test_bridging_equals_an_independent_search():
    rng = random.Random(9)
    kinds = ["| a | b |", "|---|---|", "| 1 | 2 |", "| x |", "", "", "text", "a | b", "# h"]
    for _ in range(3000):
        lines = [rng.choice(kinds) for _ in range(rng.randint(1, 14))]
        assert tables.bridged(lines) == merged_tables(lines), lines


def test_cleaned_tables():
    assert tables.cleaned(["| h |", "|---|", "| 1 |", "|---|", "| h |", "|---|", "| 2 |"]) == ["| h |", "|---|", "| 1 |", "| 2 |"]
    assert tables.cleaned(["|---|", "| 1 |"]) == ["| 1 |"]


def test_ghost_images(spark):
    md = "![a](images/x.png) ![](images/y.png) ![](other/z.png)"
    df = spark.createDataFrame([(1, md)], "doc_id int, md string")
    got = df.select(tables.without_ghost_images(F.col("md"), F.array(F.lit("y.png")))).first()[0]
    assert got == " ![](images/y.png) ![](other/z.png)"


def figs(spark, *boxes_):
    rows = [(i, *map(float, b), f"f{i}") for i, b in enumerate(boxes_)]
    return spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double, desc string").groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x1", "y1", "x2", "y2", "desc"))), lambda f: F.struct(f["x1"].alias("x1"), f["y1"].alias("y1"), f["x2"].alias("x2"), f["y2"].alias("y2"), f["desc"].alias("desc"))).alias("f"))


def test_clusters_and_overlaps(spark):
    df = figs(spark, (0, 0, 100, 100), (110, 0, 200, 100), (500, 500, 600, 600), (205, 10, 300, 90))
    got = df.select(boxes.clustered(F.col("f"))).first()[0]
    assert [(r.x1, r.x2, r.desc) for r in got] == [(0, 300, "f0; f1; f3"), (500, 600, "f2")]
    df = figs(spark, (0, 0, 100, 100), (10, 10, 90, 90), (60, 0, 160, 100))
    assert [r.desc for r in df.select(boxes.merged(F.col("f"))).first()[0]] == ["f0", "f2"]


def test_rounding_is_half_even(spark):
    b = boxes.box(*(F.lit(float(v)) for v in (2.5, 3.5, 1500.5, 2000.0)))
    got = spark.range(1).select(boxes.to_pixels(b, F.lit(1400), F.lit(2200)).alias("p")).first().p
    assert (got.x1, got.y1, got.x2, got.y2) == (2, 4, 1400, 2000)


def test_actions(spark):
    crop = lambda n: F.struct(F.lit(f"page1_fig{n}.png").alias("filename"), F.lit("").alias("desc"), *(F.lit(v).alias(s) for v, s in zip((0, 0, 200, 200), boxes.SIDES, strict=True)))
    reply = '[{"index":1,"action":"reject"},{"index":1,"action":"accept"},{"index":2,"action":"split","regions":[{"bbox":[0,0,500,500],"desc":"a"},{"bbox":[0,0,1,1]},{"bbox":[500,500,1000,1000]}]},{"index":3,"action":"split","regions":[]},{"index":9,"action":"reject"},{"index":4,"action":"odd"},{"index":5,"action":"split","regions":[{"bbox":[1,1,2,2]}]}]'
    crops = F.array(*(crop(n) for n in range(1, 6)))
    df = spark.range(1).select(figures.executed(crops, replies.actions(F.lit(reply), F.size(crops)), F.lit(0), F.lit(1000), F.lit(1000)).alias("c"))
    assert [r.filename for r in df.first().c] == ["page1_fig1.png", "page1_fig2_a.png", "page1_fig2_c.png", "page1_fig3.png", "page1_fig4.png"]


def test_joined_pages(spark):
    pages = [(1, 0, "# T\nIt goes"), (1, 1, "on and ends."), (1, 2, "  "), (1, 3, "# Next"), (1, 4, "| a | b |"), (1, 5, "| c | d |"), (2, 0, "single\n\n\n")]
    df = spark.createDataFrame(pages, "doc_id int, page_num int, md string")
    got = {r.doc_id: r.md for r in stitching.joined(df).collect()}
    assert got == {1: "# T\nIt goes\non and ends.\n\n# Next\n\n| a | b |\n| c | d |", 2: "single\n\n\n"}


def test_joined_with_replies(spark):
    df = spark.createDataFrame([(1, 0, "It goes"), (1, 1, "goes on."), (1, 2, "Other"), (1, 3, "Text")], "doc_id int, page_num int, md string")
    told = spark.createDataFrame([(1, 1, "on."), (1, 3, "# H\n" * 40)], "doc_id int, page_num int, reply string")
    assert stitching.joined(df, told).first().md == "It goes\non.\n\nOther\n\nText"


def test_boundaries_are_judged_once(spark):
    from quire.functions import text

    pages = spark.createDataFrame([(1, 0, "It goes", ["a.png"]), (1, 1, "on.", [])], "doc_id long, page_num long, md string, image_files array<string>")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole = stitching.joined(pages)
    assert plan(whole).count(text.STRUCTURAL_END) == plan(whole).count(text.ENDS_SENTENCE) == 1
    back = stitching.image_loss_fallback(whole, pages)
    assert plan(back).count(text.STRUCTURAL_END) == plan(back).count(text.ENDS_SENTENCE) == 1
    assert back.collect() == [(1, "It goes\n\non.", True)]


def test_decorative_in_one_pass(spark):
    size = [(1, p, 600, 800) for p in range(4)] + [(2, p, 600, 800) for p in range(2)]
    pages = spark.createDataFrame(size, "doc_id long, page_num long, width int, height int")
    small = lambda d, p, f: (d, p, f, 0, 0, 41, 39)
    rows = [small(1, p, f"s{p}") for p in (0, 0, 1, 3)] + [small(1, 9, "no such page"), (1, 2, "no box", None, None, None, None), (1, 2, "other", 0, 0, 90, 90)]
    rows += [(1, p, f"large{p}", 0, 0, 500, 700) for p in range(4)] + [(1, p, f"half{p}", 0, 0, 60, 60) for p in (1, 2)] + [small(2, p, f"two{p}") for p in range(2)] + [small(3, 0, "no pages")]
    crops = spark.createDataFrame(rows, "doc_id long, page_num long, filename string, x1 int, y1 int, x2 int, y2 int")
    rest = figures.without_decorative(crops, pages)
    kept = {"no box", "other", "large0", "large1", "large2", "large3", "half1", "half2", "two0", "two1", "no pages"}
    assert {r.filename for r in rest.collect()} == kept and rest.columns == crops.columns
    assert [tuple(r.signature) for r in figures.decorative(crops, pages).collect()] == [(40, 40)]
    plan = rest._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "Aggregate" not in plan
