"""Figure boxes as column expressions: scaling, overlap, clusters, crop geometry.

A box is a struct with doubles x1, y1, x2, y2; a page's figures are an array of such structs in
detection order, which matters.  Rounding is half to even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")
FIGURE = "struct<x1:double,y1:double,x2:double,y2:double,desc:string>"
CROP = "struct<filename:string,desc:string,x1:int,y1:int,x2:int,y2:int>"
# Padding of a crop, its least side, the least side of a corrected crop
PADDING, LEAST_SIDE, LEAST_NEW_SIDE = 5, 20, 80
# Outline colours in turn
COLOURS = ("ff0000", "00b400", "0000ff", "ff00ff", "ffa000", "00c8c8", "8000ff", "ff8000")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _ordered(b: Column, low: Column, high_x: Column, high_y: Column) -> Column:
    """Each axis sorted and clamped."""
    clamp = lambda v, high: F.greatest(low, F.least(high, v))
    of = lambda b: box(clamp(F.least(b["x1"], b["x2"]), high_x), clamp(F.least(b["y1"], b["y2"]), high_y), clamp(F.greatest(b["x1"], b["x2"]), high_x), clamp(F.greatest(b["y1"], b["y2"]), high_y))
    return let(b, of)


def _within_1000(b: Column) -> Column:
    sides = [b[s] for s in SIDES]
    return (F.least(*sides) >= 0) & (F.greatest(*sides) <= 1000)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Integer pixels; sides all within [0, 1000] are thousandths of the page, others pixels."""
    whole = lambda b, *of: box(*(F.rint(b[s] / 1000 * o if of else b[s]).cast("int") for s, o in zip(SIDES, of or SIDES, strict=True)))
    scaled = let(b, lambda b: F.when(_within_1000(b), whole(b, width, height, width, height)).otherwise(whole(b)))
    return _ordered(scaled, F.lit(0), width.cast("int"), height.cast("int"))


def to_thousandths(b: Column, width: Column, height: Column, from_pixels: Column) -> Column:
    """Thousandths of the page; converts pixel boxes and those with a side over 1000 where the size is known."""
    known = width.isNotNull() & height.isNotNull()
    scaled = lambda b: box(*(b[s] / of * 1000 for s, of in zip(SIDES, (width, height, width, height), strict=True)))
    over = lambda b: F.greatest(*(b[s] for s in SIDES)) > 1000
    either = let(b, lambda b: F.when(known & (from_pixels | over(b)), scaled(b)).otherwise(box(*(b[s] for s in SIDES))))
    return _ordered(either, F.lit(0.0), F.lit(1000.0), F.lit(1000.0))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share; 0 if they only touch."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def covers(a: Column, b: Column, share: float = 0.5) -> Column:
    """Do they share more than ``share`` of the smaller?"""
    smaller = F.least(area(a), area(b))
    return (intersection(a, b) > 0) & (smaller > 0) & (F.try_divide(intersection(a, b), smaller) > share)


def coincides(a: Column, b: Column, share: float = 0.5) -> Column:
    """Do they share more than ``share`` of their union?"""
    union = area(a) + area(b) - intersection(a, b)
    return (intersection(a, b) > 0) & (union > 0) & (F.try_divide(intersection(a, b), union) > share)


def keep_first(items: Column, kind: str, same: Callable[[Column, Column], Column]) -> Column:
    """In order, the items that are not the ``same`` as one kept before."""
    return F.aggregate(items, F.array().cast(f"array<{kind}>"), lambda kept, x: F.when(F.exists(kept, lambda k: same(x, k)), kept).otherwise(F.concat(kept, F.array(x))))


def merged(*lists: Column) -> Column:
    """Figures of several detectors without those that overlap an earlier one by over half."""
    return keep_first(F.concat(*lists), FIGURE, covers)


def is_near(a: Column, b: Column, gap: float) -> Column:
    """Less than ``gap`` apart along both axes, and side by side for over three tenths of the smaller along one."""
    zero = F.lit(0.0)
    shared = lambda lo, hi: F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    width, height = shared("x1", "x2"), shared("y1", "y2")
    least = lambda lo, hi: F.greatest(F.least(a[hi] - a[lo], b[hi] - b[lo]), F.lit(1.0))
    apart = F.greatest(F.greatest(zero, -width), F.greatest(zero, -height))
    overlaps = (F.greatest(zero, width) / least("x1", "x2") > 0.3) | (F.greatest(zero, height) / least("y1", "y2") > 0.3)
    return (apart < gap) & overlaps


def clustered(figures: Column, gap: float = 40.0) -> Column:
    """Groups of figures that lie near each other as one enclosing figure, by the first member."""
    n = F.size(figures)

    def later(a: Column, i: Column) -> Column:
        """The figures after ``a`` that are near it, as pairs of places."""
        near = F.transform(F.slice(figures, i + 2, n), lambda b, k: F.when(is_near(a, b, gap), i + k + 1))
        return F.transform(F.filter(near, lambda j: j.isNotNull()), lambda j: F.struct(i.alias("i"), j.alias("j")))

    pairs = F.flatten(F.transform(figures, later))

    def join(labels: Column, p: Column) -> Column:
        a, b = F.get(labels, p["i"]), F.get(labels, p["j"])
        return F.transform(labels, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x))

    labels = F.aggregate(pairs, F.sequence(F.lit(0), n - 1), join)

    def group(members: Column) -> Column:
        told = F.filter(F.transform(members, lambda m: m["desc"]), lambda d: d != "")
        side = lambda s, of: of(F.transform(members, lambda m: m[s])).alias(s)
        whole = F.struct(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max), F.array_join(F.slice(told, 1, 3), "; ").alias("desc"))
        return F.when(F.size(members) == 1, F.get(members, F.lit(0))).otherwise(whole)

    members = lambda ls, label: F.filter(figures, lambda f, i: F.get(ls, i) == label)
    found = let(labels, lambda ls: F.transform(F.array_sort(F.array_distinct(ls)), lambda label: let(members(ls, label), group)))
    return F.when(n <= 1, figures).otherwise(found)


def padded(b: Column, width: Column, height: Column) -> Column:
    return let(b, lambda b: box(F.greatest(F.lit(0), b["x1"] - PADDING), F.greatest(F.lit(0), b["y1"] - PADDING), F.least(width.cast("int"), b["x2"] + PADDING), F.least(height.cast("int"), b["y2"] + PADDING)))


def crops(figures: Column, page_num: Column, width: Column, height: Column) -> Column:
    """Crop candidates of a page: padded pixels, none tiny, none that coincides with an earlier one."""

    def crop(f: Column, i: Column) -> Column:
        name = F.concat(F.lit("page"), (page_num + 1).cast("string"), F.lit("_fig"), (i + 1).cast("string"), F.lit(".png"))
        return let(padded(to_pixels(f, width, height), width, height), lambda b: F.struct(name.alias("filename"), F.coalesce(f["desc"], F.lit("")).alias("desc"), *(b[s].alias(s) for s in SIDES)))

    all_crops = F.transform(figures, crop)
    large = F.filter(all_crops, lambda c: (c["x2"] - c["x1"] >= LEAST_SIDE) & (c["y2"] - c["y1"] >= LEAST_SIDE))
    return keep_first(large, CROP, coincides)


def is_blank_crop(pixels: Column) -> Column:
    """Is over 95 % of a grey-scale crop nearly white?"""
    return F.try_divide(F.size(F.filter(pixels, lambda x: x > 240)), F.size(pixels)) > 0.95


def size_signature(w: Column, h: Column) -> Column:
    return F.struct((F.rint(w / 10) * 10).cast("int").alias("w"), (F.rint(h / 10) * 10).cast("int").alias("h"))


def overlay(crops_: Column) -> Column:
    """How numbered outlines are drawn: colour, label and the box of the label."""

    def mark(c: Column, i: Column) -> Column:
        colour = F.element_at(F.array(*map(F.lit, COLOURS)), (i % len(COLOURS) + 1).cast("int"))
        return F.struct(colour.alias("colour"), (i + 1).alias("label"), c["x1"].alias("tag_x1"), F.greatest(F.lit(0), c["y1"] - 22).alias("tag_y1"), (c["x1"] + 26).alias("tag_x2"), c["y1"].alias("tag_y2"), F.lit(3).alias("outline"))

    return F.transform(crops_, mark)


def fitted(width: Column, height: Column, most: Column) -> Column:
    """Size after scaling the longer side down to ``most``; never below one pixel."""
    longer = F.greatest(width, height)
    side = lambda v: F.when(longer > most, F.greatest(F.lit(1), F.rint(v * (most / longer)).cast("int"))).otherwise(v.cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


# JPEG qualities tried at each size, the step down, and the least longer side
QUALITIES, STEP_DOWN, LEAST_MODEL_SIDE = (90, 85, 80, 75, 70, 60, 50, 40), 0.85, 640


def side_ladder(width: Column, height: Column, most: int) -> Column:
    """The longer sides that are tried in turn until an encoding is small enough."""
    first = F.least(F.greatest(width, height), F.lit(most)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.array(first), lambda a, _: F.when(F.element_at(a, -1) <= LEAST_MODEL_SIDE, a).otherwise(F.concat(a, F.array(F.greatest(F.lit(LEAST_MODEL_SIDE), (F.element_at(a, -1) * STEP_DOWN).cast("int"))))))
