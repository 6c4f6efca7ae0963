"""Embedding near-duplicates: PCA-ordered tiled comparison.

A rotation to principal axes is fitted on a bounded sample of vectors; being orthonormal it changes no
cosine, it only puts the dimensions that tell vectors apart first.  Rows of a label fall into cells of
the two leading coordinates of their unit vectors, as wide as two linked vectors can differ, and cells
into tiles of about ``TILE`` rows by a hash of their number.  Tiles meet within a cell and with the next
cells.  Inside a pair of tiles, products over the leading dimensions are accumulated block by block;
the product over the rest is bounded by the suffix norms, and pairs whose bound cannot reach the
threshold are dropped.  What is left is decided by the cosine of the original vectors in double
precision.

A pair of tiles returns for each of its rows the number of links and the least row that it is
connected with inside the pair, so the output is linear in the rows even where all of them are copies;
components then join those.  Equal vectors of a label are one row with a multiplicity.

Defined cases: a vector that is null, zero or holds a null or non-finite component, or whose label is
null, links with nothing; vectors of different lengths never link; rows with equal ids count as
separate vectors, each with its own links, and so link when equal; a row with a null id counts among
the links of others, has the least id of its component if there is one, and is never kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import least_hashed, stored
from quire.llm.components import components

TILE = 1024
LEAD = 16


def principal_axes(rows: DataFrame, sample: int = 2048) -> dict[int, np.ndarray]:
    """Rotation by dimension from at most ``sample`` vectors, those with the smallest hash of the id."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in least_hashed(rows.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding"), ["vec_id", "embedding"], sample).select("embedding").collect():
        if None in r[0] or not r[0]:
            continue
        v = np.array(r[0], np.float64)
        n = np.linalg.norm(v)
        if np.isfinite(n) and n > 0:
            by_dim.setdefault(len(v), []).append(v / n)
    axes = {}
    for d, vectors in by_dim.items():
        x = np.stack(vectors)
        _, axes[d] = np.linalg.eigh(x.T @ x)
        axes[d] = axes[d][:, ::-1].copy()  # most spread first
    return axes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepare(axes: dict[int, np.ndarray], width: float):
    """vec_id, label, raw doubles (null if it links with nothing), dimension and the two leading cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims, cells = [], [], [[], []]
            for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(v, np.float64) if v and label is not None and None not in v else None
                if x is None or not np.isfinite(x).all() or not x.any():
                    raw.append(None), dims.append(None), cells[0].append(None), cells[1].append(None)
                    continue
                u = _unit(x[None])[0]
                lead = u @ axes[len(x)][:, :2] if len(x) in axes else u[:2]
                raw.append((x + 0.0).tobytes()), dims.append(len(x))
                for i in (0, 1):
                    cells[i].append(int(np.floor(lead[i] / width)) if i < len(lead) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(dims, pa.int32()), pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int32())], names=["vec_id", "label", "raw", "dim", "c0", "c1"])

    return run


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the linked pairs of two tiles; i < j within one tile."""
    ua, ub = _unit(a), _unit(b)
    ra, rb = (ua, ub) if axes is None else (ua @ axes, ub @ axes)
    d, slack = ra.shape[1], 1e-9
    lead = min(LEAD, d)
    # squares left from each dimension on, for the bound
    tail = lambda r, k: np.sqrt(np.maximum((r[:, k:] ** 2).sum(axis=1), 0))
    part = ra[:, :lead] @ rb[:, :lead].T
    alive = part + tail(ra, lead)[:, None] * tail(rb, lead)[None, :] >= threshold - slack
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    so_far = part[i, j]
    for k in range(lead, d, LEAD):
        if not len(i):
            break
        end = min(k + LEAD, d)
        for at in range(0, len(i), 100_000):
            s = slice(at, at + 100_000)
            so_far[s] += np.einsum("ij,ij->i", ra[i[s], k:end], rb[j[s], k:end])
        ok = so_far + tail(ra, end)[i] * tail(rb, end)[j] >= threshold - slack
        i, j, so_far = i[ok], j[ok], so_far[ok]
    near = np.abs(so_far - threshold) < 1e-9
    keep = so_far >= threshold
    for n in np.flatnonzero(near):  # too close for a rotated sum: the plain formula decides
        x, y = a[i[n]], b[j[n]]
        keep[n] = float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))) >= threshold
    return i[keep], j[keep]


def least_connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of the least row that each of ``n`` rows is connected with."""
    low = np.arange(n)
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    return low


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, same = batch.column("dim")[row].as_py(), batch.column("same")[row].as_py()
                tile = lambda name: batch.column(name)[row].values
                data = []
                for name in ("a", "b"):
                    t = tile(name)
                    x = np.frombuffer(b"".join(t.field("raw").to_pylist()), np.float64).reshape(-1, dim)
                    data.append((t.field("uid").to_numpy(zero_copy_only=False), t.field("n").to_numpy(zero_copy_only=False), x))
                (ids, n, x), (ids2, n2, y) = data
                i, j = linked(x, y, axes.get(dim), threshold, same)
                if same:
                    count = np.bincount(i, n2[j], len(ids)) + np.bincount(j, n[i], len(ids))
                    all_ids, j2 = ids, j
                else:
                    count = np.concatenate([np.bincount(i, n2[j], len(ids)), np.bincount(j, n[i], len(ids2))])
                    all_ids, j2 = np.concatenate([ids, ids2]), j + len(ids)
                order = np.argsort(all_ids, kind="stable")  # so that the least row has the least id
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                low = all_ids[order][least_connected(len(order), place[i], place[j2])][place]
                some = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(all_ids[some], pa.int64()), pa.array(count[some].astype(np.int64)), pa.array(low[some], pa.int64())], names=["uid", "n", "low"])

    return run


def dedup(vectors: DataFrame, threshold: float = 0.98, sample: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, label, embedding)."""
    axes = principal_axes(vectors, sample)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    kinds = "vec_id long, label string, raw binary, dim int, c0 int, c1 int"
    rows = stored(rows.mapInArrow(lambda it: _prepare(shared.value, width)(it), kinds))
    cell = ["label", "dim", "c0", "c1"]
    # unlike vectors have numbers of their own, whatever their ids
    own = rows.filter(F.col("raw").isNotNull()).groupBy(*cell, "raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    own = stored(own.withColumn("uid", F.monotonically_increasing_id()))
    sizes = own.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = own.join(sizes, cell).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    tiles = stored(tiles.groupBy(*cell, "tile").agg(F.sort_array(F.collect_list(F.struct("uid", "n", "raw"))).alias("rows")))  # about TILE rows
    names = tiles.select(*cell, "tile")
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    near = names.withColumn("step", F.explode(steps)).select("label", "dim", (F.col("c0") + F.col("step.x")).alias("d0"), (F.col("c1") + F.col("step.y")).alias("d1"), "c0", "c1", "tile")
    other = names.select("label", "dim", F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("tile").alias("tile2"))
    pairs = near.join(other, ["label", "dim", "d0", "d1"]).filter((F.col("c0") != F.col("d0")) | (F.col("c1") != F.col("d1")) | (F.col("tile") <= F.col("tile2")))
    pairs = pairs.withColumn("same", (F.col("c0") == F.col("d0")) & (F.col("c1") == F.col("d1")) & (F.col("tile") == F.col("tile2")))
    left = tiles.withColumnRenamed("rows", "a")
    right = tiles.select("label", "dim", F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("tile").alias("tile2"), F.col("rows").alias("b"))
    met = pairs.hint("shuffle_hash").join(left, [*cell, "tile"]).join(right, ["label", "dim", "d0", "d1", "tile2"])
    found = stored(met.select("dim", "same", "a", "b").mapInArrow(lambda it: _compare(shared.value, threshold)(it), "uid long, n long, low long"))
    links = found.groupBy("uid").agg(F.sum("n").alias("others"))
    parts = components(found.select("uid", "low")).withColumnRenamed("node", "uid")
    classes = own.select("label", "dim", "raw", "uid", "first", F.col("n").alias("copies")).join(links, "uid", "left").join(parts, "uid", "left").withColumn("part", F.coalesce("component", "uid"))
    classes = stored(classes.select("label", "dim", "raw", "part", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    least = classes.groupBy("part").agg(F.min("first").alias("component"))
    known = rows.join(classes.join(least, "part"), ["label", "dim", "raw"], "left")
    component = F.coalesce("component", "vec_id")
    return known.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, p.w FROM r JOIN p ON p.u = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.u = vec_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
