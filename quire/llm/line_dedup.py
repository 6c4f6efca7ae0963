"""Line dedup: a segment-partition edit join in DataFrame operations only.

A line goes if an earlier line of the corpus - by document id, then place in the text - is equal or
near; that the earlier line may go itself does not matter.  Near lines have at least ``LEAST``
characters and are within ``EDITS`` edits; with ``share``, as ``keep`` and so the pipeline have it, the
edits grow with the length: one for ``share`` characters of the shorter line.  Lines under ``LEAST``
characters that hold a word go where an earlier line is equal (``short``, as both queries and ``keep``
have it): two edits turn a short line into another one too easily.  Lines without a word stay.

Equal lines are grouped first; a group stands for its first occurrence.  A group's text is split into
``EDITS + 1`` segments; of two texts within ``EDITS`` edits, the longer has one segment of the shorter
as it stands, at a place that the length difference bounds.  So each text is indexed under its
segments (length, segment number, hash) and probes, for every length from ``EDITS`` below its own,
the substrings at those places.  Pairs that meet are verified on their whole texts by a bit-parallel
edit distance in a band of ``EDITS`` around the diagonal.

Verification has two rounds.  First every text of a bucket meets the earliest text of the bucket:
linear in the index, and enough to drop nearly all of a group of copies.  Texts that are not dropped
then meet all earlier texts of their buckets, block by block.  Buckets with the same earliest text are
one group there: texts that are alike meet in many buckets, but in few groups, and once where both
have the same first group.  In both rounds lengths and counts of letters of a pair are compared before
its texts are fetched, so that only pairs which may be near are rows that hold texts.  The pairs of
large groups grow faster than the texts, so letters and texts of pairs are shuffled in passes, each in
proportion to the texts, whose files go before the next.

Defined cases: a null text has no lines and stays null; an empty text stays empty; ``keep`` leaves out
a document all of whose words went, while one that never had any stays; rows with equal ids count as
one document: its lines drop no lines of the same number, and lose the same lines; a null id comes
first; of equal lines the first place is the one that stays; lines are compared whole, however long;
``keep`` returns all columns, whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, documents, few, stored

EDITS, LEAST = 2, 40
#: with ``share``, one edit for so many characters: ``EDITS`` below 60, 3 from 60, 16 from 320
SHARE = 20
#: allowances of a class have segments of one size; the far classes, the last without end, have keys by windows instead of places
CLASSES = ((2, 2), (3, 3), (4, 8), (9, 18), (19, 40))
FAR = tuple((round(41 * 1.15**i), round(41 * 1.15 ** (i + 1)) - 1 if i < 30 else 1 << 30) for i in range(31))
#: keys of a pass for each text, which bounds what is shuffled at once
PASS_KEYS, LEAST_KEYS = 12, 5_000_000
#: most windows of a segment that are indexed
STRIDE = 4
#: characters that a comparison reads first
EARLY = 24
#: characters that are counted in a text before it is compared
LETTERS = "etaoinsrlhducmpgwbyfv .,"
#: texts of a group that are compared as one row
BLOCK = 128
#: what a pass of the comparisons shuffles, for each text and at least: rows with letters, and pairs with their texts
PASS_ROWS, LEAST_ROWS = 1, 1_000_000
PASS_PAIRS, LEAST_PAIRS = 0.25, 250_000
#: most keys that are broadcast
MOST = 500_000


def _segments(n: str, k: int) -> list[tuple[str, str]]:
    """(start from 1, length) of the k + 1 segments of a text of length ``n``, as SQL; the last are longer by one where it does not divide."""
    parts = k + 1
    short = f"({n} div {parts})"
    extra = f"({n} % {parts})"
    out = []
    for i in range(parts):
        longer = f"greatest(0, {i} - ({parts} - {extra}))"
        out.append((f"({i} * {short} + {longer} + 1)", f"({short} + if({i} >= {parts} - {extra}, 1, 0))"))
    return out


def posts(texts: DataFrame, k: int) -> DataFrame:
    """id, key, indexed, probes: the keys of each text's segments, and those of the other places; it probes all of them."""
    places, columns = [], {}
    for d in range(k + 1):  # the indexed text is d shorter
        for i, (s, size) in enumerate(_segments(f"(n - {d})", k)):
            columns |= {f"s{d}_{i}": F.expr(f"cast({s} as int)"), f"z{d}_{i}": F.expr(f"cast(4 * {size} as int)")}
            # at most i edits lie to the left of segment i and k - i to its right
            places += [(d, i, o) for o in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)]
    places.sort(key=lambda p: (p[0] > 0 or p[2] != 0, p))  # the text's own segments first
    # four bytes a character: places are found without counting characters
    keys = [f"xxhash64(n - {d}, {i}, substring(wide, 4 * (s{d}_{i} + {o}) - 3, z{d}_{i}))" for d, i, o in places]
    wide = texts.select("id", "n", F.encode("text", "UTF-32").alias("wide"), *(c.alias(name) for name, c in columns.items()))
    return wide.select("id", F.posexplode(F.expr(f"array({', '.join(keys)})")).alias("at", "key")).select("id", "key", (F.col("at") <= k).alias("indexed"), F.lit(True).alias("probes"))


def allowed(n: Column, share: int) -> Column:
    """Edits within which a text of ``n`` characters counts as near, where they grow with its length."""
    return F.greatest(F.lit(EDITS), F.floor(n / share)).cast("int")


def _width(least: int, share: int) -> int:
    """Size of the segments of a class that begins with ``least`` edits: one more than the edits fit in any of its texts."""
    return least * share // (least + 1)


def classed(texts: DataFrame, share: int) -> DataFrame:
    """id, n, wide, own, class, k, w: each text once for its own class and for those of the shorter texts that it may be near to.

    ``k`` is the greatest allowance of such texts, ``own`` whether the class is the text's.
    """
    kinds = [*CLASSES, *FAR]
    each = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(_width(lo, share)).alias("w")) for c, (lo, hi) in enumerate(kinds)))
    # of two near texts, the shorter has at least share / (share + 1) of the length of the longer
    least = allowed(F.floor(F.col("n") * share / (share + 1)) - 1, share)
    rows = texts.select("id", "n", "text", allowed(F.col("n"), share).alias("most"), least.alias("least"))
    some = F.filter(each, lambda c: (c["lo"] <= F.col("most")) & (c["hi"] >= F.col("least")))
    rows = rows.withColumn("c", F.explode(some)).select("id", "n", "text", F.col("c.class").alias("class"), F.col("c.w").alias("w"), F.least("most", F.col("c.hi")).alias("k"), (F.col("most") <= F.col("c.hi")).alias("own"))
    # four bytes a character, so that places are found without counting; exploded, it is made once a text and not once a key
    return rows.select("id", "n", "class", "w", "k", "own", F.explode(F.array(F.encode("text", "UTF-32"))).alias("wide"))


def _units(of: DataFrame) -> list[tuple[int, int, int]]:
    """(class, side, number) of the segments, as many from the start (side 0) as from the end, or one more; keys of two units never meet."""
    most = {r["class"]: r["k"] for r in of.groupBy("class").agg(F.max("k").alias("k")).collect()}  # a row for each class
    near = [(c, side, i) for c, k in sorted(most.items()) if c < len(CLASSES) for side in (0, 1) for i in range(k // 2 + 1 if side == 0 else k - k // 2)]
    return near + [(c, 0, 0) for c in sorted(most) if c >= len(CLASSES)]


def classed_posts(of: DataFrame, units: list[tuple[int, int, int]]) -> DataFrame:
    """id, key, indexed, probes as in ``posts``, for the pairs within what the shorter text allows; ``of`` are rows of ``classed``.

    An allowance ``k`` has k + 1 segments, the first k div 2 + 1 placed from the start of a text and the
    others from its end.  Some segment has no edit in it, at most ``i`` edits to its left and at most
    ``k - i`` to its right: so one that has ``i`` others between it and its end of the text stands in
    the longer text within ``i`` places from there, whatever ``k`` and the lengths.  Of texts with a
    great allowance all places are probed.

    A segment has ``t`` keys, its windows of ``w - t + 1`` characters; wherever it stands, one of them
    is at a place that ``t`` divides (counted from where it would stand without edits), so that only
    every ``t``-th place is probed: ``_stride`` says at which ``t`` the keys are fewest.
    """
    spark, far = of.sparkSession, len(CLASSES)
    places = [(c, side, i, o, _stride(i), indexed) for c, side, i in units if c < far for o, indexed in _places(i, _stride(i))]
    table = F.broadcast(spark.createDataFrame(places, "class int, side int, i int, o int, t int, segment boolean"))  # some hundred places
    near = of.filter(F.col("class") < far).join(table, "class").filter(F.expr("if(side = 0, i <= k div 2, i < k - k div 2) and (own or o % t = 0)"))
    near = near.withColumn("at", F.expr("if(side = 0, i * w, n - (i + 1) * w) + o")).filter("at >= 0 and at <= n - (w - t + 1)")
    posts_ = near.select("id", F.expr("xxhash64(class, side, i, substring(wide, 4 * at + 1, 4 * (w - t + 1)))").alias("key"), F.expr("own and segment").alias("indexed"), F.expr("o % t = 0").alias("probes"))
    if long := [c for c, *_ in units if c >= far]:
        windows = of.filter(F.col("class").isin(long)).withColumn("at", F.explode(F.expr(f"sequence(0, n - (w - {STRIDE} + 1))")))
        windows = windows.withColumn("indexed", F.expr(f"own and at % w < {STRIDE} and at div w <= k")).filter(f"indexed or at % {STRIDE} = 0")
        posts_ = posts_.unionByName(windows.select("id", F.expr(f"xxhash64(class, substring(wide, 4 * at + 1, 4 * (w - {STRIDE} + 1)))").alias("key"), "indexed", F.expr(f"at % {STRIDE} = 0").alias("probes")))
    return posts_


def _places(i: int, t: int) -> list[tuple[int, bool]]:
    """(place, indexed): the ``t`` windows of a segment that has ``i`` others to its left, and the places that ``t`` divides of those where one may stand in a longer text."""
    return [(o, 0 <= o < t) for o in range(-i, i + t) if o % t == 0 or 0 <= o < t]


def _stride(i: int) -> int:
    return min(range(1, STRIDE + 1), key=lambda t: (len(_places(i, t)), t))


def _passes(of: DataFrame, share: int) -> list[list[tuple[int, int, int]]]:
    """The units in groups, each with about ``PASS_KEYS`` keys a text or with one unit alone."""
    counts = of.groupBy("class", "k").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()  # a row for each allowance
    most, out, held = max(LEAST_KEYS, PASS_KEYS * sum(r["rows"] for r in counts if r["k"])), [], 0
    for c, side, i in _units(of):
        each = (1 / STRIDE + STRIDE / share) if c >= len(CLASSES) else len(_places(i, _stride(i)))
        keys = sum(int(each * r["n"]) if c >= len(CLASSES) else each * r["rows"] for r in counts if r["class"] == c and (c >= len(CLASSES) or i < (r["k"] // 2 + 1 if side == 0 else r["k"] - r["k"] // 2)))
        if not out or held + keys > most:
            out.append([])
            held = 0
        out[-1].append((c, side, i))
        held += keys
    return out


def within(x: Column, y: Column, k: int) -> Column:
    """Are two texts within ``k`` edits?  A bit-parallel band, folded over the characters of ``y``.

    Mask ``e`` holds, for each diagonal from ``-k`` to ``k``, whether ``e`` edits can bring one there.
    A character keeps the diagonals on which it equals its counterpart; an edit stays on a diagonal
    (substitution), falls to the one below (insertion), or, reading nothing, rises (deletion).
    """
    full, shift = (1 << 2 * k + 1) - 1, F.shiftright
    let = lambda v, of: F.get(F.transform(F.array(v), of), F.lit(0))
    as_masks = lambda masks: F.struct(*(m.cast("int").alias(f"m{e}") for e, m in enumerate(masks)))

    def step(a: Column, c: Column, j: Column, state: Column) -> Column:
        same = lambda o: F.when(F.get(a, j + o) == c, 1 << o + k).otherwise(0)

        def moved(equal: Column) -> Column:
            masks = []
            for e in range(k + 1):
                new = state[f"m{e}"].bitwiseAND(equal)
                if e:
                    old = state[f"m{e - 1}"]
                    new = new.bitwiseOR(old).bitwiseOR(shift(old, 1)).bitwiseOR(F.shiftleft(masks[-1], 1).bitwiseAND(F.lit(full)))
                masks.append(new)
            return as_masks(masks)

        equal = same(-k)
        for o in range(1 - k, k + 1):
            equal = equal.bitwiseOR(same(o))
        return F.when(state[f"m{k}"] == 0, state).otherwise(let(equal, moved))

    start = as_masks([F.lit(sum(1 << k + i for i in range(e + 1))) for e in range(k + 1)])

    def masks(x: Column, y: Column) -> Column:
        places = F.transform(F.split(y, ""), lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        return let(F.split(x, ""), lambda a: F.aggregate(places, start, lambda state, p: step(a, p["c"], p["j"], state)))

    # most texts that are no match differ early: their beginnings are read first
    alive = let(masks(F.left(x, F.lit(EARLY + k)), F.left(y, F.lit(EARLY))), lambda m: m[f"m{k}"] != 0)
    longer = F.char_length(x) - F.char_length(y)
    accept = F.call_function("shiftleft", F.lit(1), longer + k)
    return F.when((F.abs(longer) <= k) & alive, let(masks(x, y), lambda m: F.greatest(*(m[f"m{e}"].bitwiseAND(accept) for e in range(k + 1))) > 0)).otherwise(F.lit(False))


def letters(text: Column) -> Column:
    """How often each of ``LETTERS`` stands in the text."""
    return F.array(*(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS))


def _alike(x: Column, y: Column, k: int, share: int | None) -> Column:
    """Do lengths and letters of two texts, as structs (n, letters), let them be within the edits?

    An edit takes at most one character away and puts at most one in: so by no more than the edits do
    counts fall in all, or rise in all, those of other characters together being one count.
    """
    most = F.lit(k) if share is None else allowed(F.least(x["n"], y["n"]), share)
    longer, plus = x["n"] - y["n"], functools.partial(functools.reduce, Column.__add__)
    more = [F.get(x["letters"], i) - F.get(y["letters"], i) for i in range(len(LETTERS))]
    fallen = plus([F.greatest(m, F.lit(0)) for m in [*more, longer - plus(more)]])
    return (F.abs(longer) <= most) & (fallen + F.greatest(-longer, F.lit(0)) <= most)


def _id(docs: DataFrame) -> Column:
    """A number for (doc_id, at) that ascends with both: a long where it fits, else a decimal."""
    r = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.octet_length("text")).alias("n")).first()
    lo, hi, bits = int(r["lo"] or 0), int(r["hi"] or 0), int(r["n"] or 0).bit_length()
    kind = "bigint" if (hi - lo + 2) << bits < 1 << 63 else "decimal(38,0)"
    return F.expr(f"(coalesce(cast(doc_id as decimal(20,0)) - {lo} + 1, 0) * {1 << bits} + at)" if kind != "bigint" else f"coalesce(doc_id - {lo}L + 1L, 0L) * {1 << bits}L + at").cast(kind)


def lines(docs: DataFrame, least: int = LEAST, short: bool = False) -> DataFrame:
    """doc_id, id, text, n of the lines that are compared, with ``short`` also those under ``least`` that hold a word; ids ascend with document id and place."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return rows.withColumn("n", F.char_length("text")).filter((F.col("n") >= least) | (F.col("text").rlike(WORD) if short else F.lit(False))).select("doc_id", "at", _id(docs).alias("id"), "text", "n")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose id is in ``ids`` (distinct)."""
    return rows.join(few(ids), "id", "left_semi")


def _close(x: Column, y: Column, nx: Column, ny: Column, k: int, share: int | None) -> Column:
    """Are two texts within ``k`` edits, or with ``share`` within what the shorter one allows?"""
    if share is None:
        return (F.abs(nx - ny) <= k) & within(x, y, k)
    most = allowed(F.least(nx, ny), share)
    return (F.abs(nx - ny) <= most) & (F.call_function("levenshtein", x, y, most) >= 0)  # -1 beyond


def _parts(rows: int, texts: int, each: float, least: int) -> int:
    """Passes that ``rows`` take at ``each`` of them for a text, or at ``least``."""
    return max(1, math.ceil(rows / max(least, each * texts)))


def _within(pairs: DataFrame, texts: DataFrame, k: int, share: int | None) -> DataFrame:
    """Ids b of the pairs (a, b; stored) whose texts are close; pairs of a text that an earlier pass has found are not compared."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = stored(_of_ids(texts.select("id", "text", "n"), ids))
    x, y = (some.select(F.col("id").alias(i), F.col("text").alias(t), F.col("n").alias(f"n{i}")) for i, t in (("a", "x"), ("b", "y")))
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that long comparisons are not put in one task
    parts, found = _parts(pairs.count(), texts.count(), PASS_PAIRS, LEAST_PAIRS), []
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    for p in range(parts):
        own = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == p)
        if found:
            own = own.join(union(found).withColumnRenamed("id", "b"), "b", "left_anti")
        met = own.join(x, "a").join(y, "b").repartition(spread, "a", "b").filter(_close(F.col("x"), F.col("y"), F.col("na"), F.col("nb"), k, share))
        found.append(stored(met.select(F.col("b").alias("id")).distinct()))
    return union(found)


def _links(part: DataFrame) -> DataFrame:
    """low, id, large: the earliest text of each bucket and every other one there, once; ``large`` if more than these two stand in one."""
    kinds = [F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size"), F.bool_or("indexed").alias("any_indexed"), F.bool_or("probes").alias("any_probes")]
    met, seen = part.groupBy("key").agg(*kinds).filter("any_indexed and any_probes and low != high").select("key", "low", "high", "size"), Observation()
    met = stored(met.observe(seen, F.count_if(F.col("size") > 2).alias("large")))
    keys = met.filter("size > 2").select("key", "low")
    members = part.join(F.broadcast(keys) if (seen.get.get("large") or 0) <= MOST else keys, "key").filter("id != low")
    links = members.select("low", "id", F.lit(True).alias("large")).unionByName(met.filter("size = 2").select("low", F.col("high").alias("id"), F.lit(False).alias("large")))
    return stored(_once(links))


def _once(links: DataFrame) -> DataFrame:
    return links.groupBy("low", "id").agg(F.bool_or("large").alias("large"))


def _later_pairs(links: DataFrame, gone: DataFrame, marks: DataFrame, k: int, share: int | None) -> DataFrame:
    """(a, b), stored: the texts b that are not ``gone``, and the earlier texts of their groups that are alike, block by block; the first text of a group is left out.

    A text b is a row for each block of its groups, so blocks are taken in passes.
    """
    rows = links.filter("large").select("low", "id")
    large = few(rows.groupBy("low").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK))
    rows = rows.join(rows.groupBy("id").agg(F.min("low").alias("least")), "id").join(large, "low", "left")
    rows = rows.withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK))
    rows = stored(rows.select("low", "id", "least", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block")))
    left = stored(rows.join(gone, "id", "left_anti"))
    early = rows.join(left.select("low").distinct(), "low", "left_semi")
    mine = left.join(marks, "id").select("low", "blocks", F.col("id").alias("b"), F.col("least").alias("its"), F.col("of").alias("y"))
    others = early.join(marks, "id").select("low", F.col("block").alias("of_block"), F.col("id").alias("a"), "least", F.col("of").alias("x"))
    parts = _parts(left.agg(F.sum("blocks").alias("n")).first()["n"] or 0, marks.count(), PASS_ROWS, LEAST_ROWS)
    if parts > 1:
        mine, others = stored(mine), stored(others)

    first = F.pmod(F.xxhash64("low"), F.lit(parts))  # the pass of a group's first block; its others are in the next ones

    def pairs(p: int) -> DataFrame:
        own = others.filter(F.pmod(first + F.col("of_block"), F.lit(parts)) == p)
        met = mine.filter(F.pmod(p - first, F.lit(parts)) < F.col("blocks")).drop("blocks")
        met = met.join(own.select("low", "of_block").distinct(), "low").join(own, ["low", "of_block"])
        # texts with the same first group meet there alone
        return stored(met.filter((F.col("a") < F.col("b")) & ((F.col("least") != F.col("its")) | (F.col("low") == F.col("its"))) & _alike(F.col("x"), F.col("y"), k, share)).select("a", "b").distinct())

    some = [pairs(p) for p in range(parts)]
    return some[0] if parts == 1 else stored(functools.reduce(DataFrame.unionByName, some).distinct())


def near_lines(texts: DataFrame, k: int = EDITS, share: int | None = None) -> DataFrame:
    """Ids of ``texts`` (id, text, n; all different) that have an earlier text within ``k`` edits, or with ``share`` within what the shorter of both allows."""
    if share is None:
        links = _links(posts(texts, k))
    else:
        of = classed(texts, share)
        # one table of all passes, so that the plans below do not have a branch for every pass
        links = stored(_once(functools.reduce(DataFrame.unionByName, [_links(classed_posts(of, units)) for units in _passes(of, share) or [[]]])))
    marks = stored(texts.select("id", F.struct("n", letters(F.col("text")).alias("letters")).alias("of")))
    x, y = (marks.select(F.col("id").alias(i), F.col("of").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    star = links.select(F.col("low").alias("a"), F.col("id").alias("b")).join(x, "a").join(y, "b").filter(_alike(F.col("x"), F.col("y"), k, share)).select("a", "b")
    gone = _within(stored(star), texts, k, share)
    # texts are sent to pairs whose letters are alike alone
    more = _later_pairs(links, gone, marks, k, share)
    return gone.unionByName(_within(more, texts, k, share)).distinct()


def dropped(docs: DataFrame, k: int = EDITS, least: int = LEAST, short: bool = False, share: int | None = None) -> DataFrame:
    """doc_id, at, near of every line that goes; ``near`` is false where the earlier line is equal.

    With ``short``, lines under ``least`` that hold a word go where an earlier line is equal.
    """
    if share is not None and least < EDITS * share:
        raise ValueError(f"lines under {EDITS * share} characters do not have the segments of {EDITS} edits at one for {share}")
    rows = lines(docs, least, short)
    texts = stored(rows.groupBy("text").agg(F.min("id").alias("id"), F.first("n").alias("n")), "zstd")
    near = near_lines(texts.filter(F.col("n") >= least) if short else texts, k, share).withColumn("near", F.lit(True))
    same = F.unhex(F.md5("text"))
    fate = texts.select("id", same.alias("same")).join(near, "id", "left").select("same", F.col("id").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    each = rows.select("doc_id", "at", "id", same.alias("same")).join(fate, "same")
    return each.filter("id != first or near").select("doc_id", "at", (F.col("id") == F.col("first")).alias("near"))


def counted(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near of every row: its lines, and those that go as equal or near."""
    gone = dropped(docs, **how).groupBy("doc_id").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))
    gone = gone.withColumnRenamed("doc_id", "_id")  # ``own`` has two columns
    return own.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "n_lines", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_equal", "n_near")))


def keep(docs: DataFrame, short: bool = True, share: int | None = SHARE, **how) -> DataFrame:
    """``docs`` without the lines that go; ``n_chars``, if there, is counted anew."""
    gone = dropped(docs, short=short, share=share, **how).distinct().groupBy("doc_id").agg(F.collect_list("at").alias("gone"))  # lines of one document
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")), "left").select("row", "gone")
    parts, whole = F.split("row.text", "\n"), F.col("gone").isNull()
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join(F.transform(F.array_sort(left), lambda i: F.get(parts, i)), "\n"))
    rows = rows.withColumn("left", text).filter(whole | F.col("left").rlike(WORD))
    new = {"text": F.col("left"), "n_chars": F.when(whole, F.col("row")["n_chars"]).otherwise(F.char_length("left").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return rows.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT *, length(t) AS n FROM l WHERE length(t) >= {LEAST} OR regexp_matches(t, '[^\x20\x09-\x0D]')),
g AS (SELECT t, n, min((doc_id, i)) AS first FROM k GROUP BY t, n),
near AS (SELECT DISTINCT a.t FROM g a JOIN g b ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND b.first < a.first WHERE a.n >= {LEAST} AND b.n >= {LEAST} AND levenshtein(a.t, b.t) <= {EDITS}),
f AS (SELECT k.doc_id, count(*) FILTER (WHERE (k.doc_id, k.i) <> g.first) AS n_equal, count(*) FILTER (WHERE (k.doc_id, k.i) = g.first AND near.t IS NOT NULL) AS n_near
  FROM k JOIN g ON g.t = k.t LEFT JOIN near ON near.t = k.t GROUP BY k.doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir), short=True)
