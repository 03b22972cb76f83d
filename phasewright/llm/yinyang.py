"""Centroid clustering in whole numbers: groups of centroids, one lower bound a group, exact scans of what is left."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import checkpoint, table

_EXACT = 2**53
#: Bounds are moved by this share of their parts, so that rounding never rules out a centroid.
_SLACK = 1e-9
_LIMB = 45


def whole_vectors(vectors: DataFrame, *, size: int = 64, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(factor * x) of each component, as whole doubles, of vectors of ``size`` finite components.

    A double that is infinite once it is scaled (over 2.8e306) is no finite one.
    """
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * factor < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == size)).where(fine)

    def whole(v: Column) -> Column:
        x = v.cast("double") * factor
        return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # larger ones are whole, and may be beyond the longs that floor gives

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), whole).alias("q"))


def _ints(q: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    return np.array([[int(x) for x in row] for row in q.tolist()], object).reshape(q.shape)


def squared(q: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of rows of whole doubles from one centroid: as long numbers, or beyond these as Python's integers."""
    largest = max([abs(x) for x in centroid] + [int(np.abs(q).max(initial=0))], default=0)
    if (2 * largest) ** 2 * max(1, len(centroid)) < _EXACT:
        away = q - np.array(centroid, float)
        return np.einsum("ij,ij->i", away, away).astype(np.int64)
    return ((_ints(q) - np.array(centroid, object)) ** 2).sum(axis=1) if len(q) else np.empty(0, np.int64)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


def centroid_groups(centroids: list[list[int]], count: int) -> list[np.ndarray]:
    """The centroids' numbers in at most ``count`` groups of near ones: farthest ones first, then a few rounds of means."""
    c = np.array(centroids, float).reshape(len(centroids), -1)
    heads = [0]
    while len(heads) < min(count, len(c)):
        heads.append(int(((c[:, None] - c[heads]) ** 2).sum(axis=2).min(axis=1).argmax()))
    means = c[heads]
    for _ in range(5):
        nearest = ((c[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([c[nearest == g].mean(axis=0) if (nearest == g).any() else means[g] for g in range(len(means))])
    return [g for g in (np.flatnonzero(nearest == i) for i in range(len(means))) if len(g)]


def scan(q: np.ndarray, centroids: list[list[int]], groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, upper, lower) of each row with all centroids looked at; ties go to the smaller number."""
    d = np.stack([squared(q, c) for c in centroids], axis=1)
    a = d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(row)), key=row.__getitem__) for row in d], np.int64)
    far = _roots(d)
    upper = far[np.arange(len(q)), a]
    far[np.arange(len(q)), a] = np.inf
    return a, upper, np.stack([far[:, g].min(axis=1) for g in groups], axis=1)


def step(q: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: list[list[int]], groups: list[np.ndarray], drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest, upper, lower, distances taken) after the centroids have moved by ``drift``.

    ``lower`` bounds the distance to each group's centroids but the own one. A row
    is done if every group is farther than its own centroid; else only groups
    that aren't, and of these only centroids whose own drift leaves them in
    reach, are looked at exactly.
    """
    n, taken = len(q), 0
    most = np.array([drift[g].max() for g in groups])
    upper = (upper + drift[a]) * (1 + _SLACK)
    finite = np.where(np.isfinite(lower), lower, 0)
    low = lower - most - _SLACK * (finite + most)
    a = a.copy()
    rows = np.flatnonzero(low.min(axis=1, initial=np.inf) <= upper)
    own = np.empty(len(rows), object)
    for c in np.unique(a[rows]):
        here = a[rows] == c
        own[here] = squared(q[rows[here]], centroids[c])
        taken += int(here.sum())
    own = own.astype(np.int64) if max(own, default=0) < 2**63 else own
    upper[rows] = _roots(own)
    some = low[rows].min(axis=1, initial=np.inf) <= upper[rows]
    rows, own = rows[some], own[some]
    before, best, bound = a[rows], own.copy(), upper[rows]
    nearest = before.copy()
    far = np.full((len(rows), len(centroids)), np.inf)
    far[np.arange(len(rows)), before] = bound
    reached = np.zeros((len(rows), len(groups)), bool)
    for g, members in enumerate(groups):
        near = low[rows, g] <= bound
        reached[:, g] = near
        for c in members:
            other = near & (before != c)
            least = lower[rows, g] - drift[c] - _SLACK * (finite[rows, g] + drift[c])
            look = np.flatnonzero(other & (least <= bound))
            far[other, c] = least[other]
            d = squared(q[rows[look]], centroids[c])
            taken += len(look)
            far[look, c] = _roots(d)
            best = best.astype(object) if d.dtype == object else best
            wins = (d < best[look]) | (d == best[look]) & (c < nearest[look])
            wins = wins.astype(bool)
            best[look[wins]], nearest[look[wins]] = d[wins], c
    a[rows] = nearest
    upper[rows] = _roots(best)
    at = np.arange(len(rows))
    left = far.copy()
    left[at, nearest] = np.inf
    for g, members in enumerate(groups):
        # of a group that wasn't looked at the own centroid alone can have been left
        was = np.isin(before, members) & (before != nearest)
        unseen = np.where(was, np.minimum(low[rows, g], bound), low[rows, g])
        low[rows, g] = np.where(reached[:, g], left[:, members].min(axis=1), unseen)
    return a, upper, low, taken


_STATE = "vec_id long, q array<double>, cluster int, was int, upper double, lower array<double>, distance long"


def _assigned(rows: DataFrame, size: int, work: Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], centroids: list[list[int]] | None = None) -> DataFrame:
    """The state after ``work``; with exact distances to ``centroids`` if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, size)
            a, upper, lower = work(q, batch)
            was = batch.column("cluster") if "cluster" in batch.schema.names else pa.array(np.full(len(a), -1), pa.int32())
            distance = np.zeros(len(a), np.int64)
            for c in np.unique(a) if centroids is not None else ():
                here = a == c
                d = squared(q[here], centroids[c])
                if d.max(initial=0) > np.iinfo(np.int64).max:
                    raise OverflowError(f"a squared distance of {d.max()} is beyond a long")
                distance[here] = d
            edges = pa.array(np.arange(len(a) + 1) * lower.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(a, pa.int32()), was, pa.array(upper), pa.ListArray.from_arrays(edges, pa.array(lower.ravel())), pa.array(distance)], names=["vec_id", "q", "cluster", "was", "upper", "lower", "distance"])

    return rows.mapInArrow(run, _STATE)


def moved_sums(state: DataFrame, size: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(cluster, component) to what its count and its sum change by, from vectors that have changed their cluster.

    Tasks add up their own vectors and send each sum in ``_LIMB`` bits a number,
    which Spark adds up; one row for each cluster and component is collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, size)
            for column, sign in (("cluster", 1), ("was", -1)):
                a = batch.column(column).to_numpy()
                for c in np.unique(a[a >= 0]).tolist():
                    part = q[a == c]
                    exact = np.abs(part).max(initial=0) * len(part) < _EXACT
                    total = [int(x) for x in part.sum(axis=0)] if exact else _ints(part).sum(axis=0)
                    counts[c] = counts.get(c, 0) + sign * len(part)
                    sums[c] = sums.get(c, np.zeros(size, object)) + sign * np.array(total, object)
        out = [[], [], [], [], [], [], []]
        for c, total in sums.items():
            for j, s in enumerate(total.tolist()):
                limbs = [s >> (_LIMB * i) & ((1 << _LIMB) - 1) for i in range(3)]
                for column, x in zip(out, (c, j, counts[c], *limbs, s >> (3 * _LIMB)), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["c", "j", "n", "l0", "l1", "l2", "l3"])

    moved = state.where("cluster <> was").select("q", "cluster", "was").mapInArrow(run, "c long, j long, n long, l0 long, l1 long, l2 long, l3 long")
    rows = moved.groupBy("c", "j").agg(*[F.sum(x).alias(x) for x in ("n", "l0", "l1", "l2", "l3")]).collect()
    return {(r["c"], r["j"]): (r["n"], sum(r[f"l{i}"] << (_LIMB * i) for i in range(4))) for r in rows}


def clusters(vectors: DataFrame, *, k: int = 16, rounds: int = 3, size: int = 64, factor: int = 64, seed: int = 1, groups: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) after ``rounds`` rounds of means in whole numbers.

    The first assignment looks at all centroids; later ones go by bounds that
    each vector carries in a checkpointed state. Sums change by the vectors that
    have moved. The driver holds ``k`` centroids and their sums, nothing else.

    Vectors of another size, null ones, and those with a null or a component that
    isn't finite take no part. A null id is no seed unless there are too few
    others, and stays null; a repeated id takes part each time (of equal hashes the smaller
    vector is the earlier seed). With fewer than ``k`` vectors there are as many
    centroids; an empty table gives no rows. A squared distance beyond a long, or an inertia, makes
    the query fail. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, size=size, factor=factor, id_col=id_col, vector_col=vector_col)
    first = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("_h").asc_nulls_last(), "q").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = [[int(x) for x in r["q"]] for r in first]
    parts = centroid_groups(centroids, groups)
    counts, sums = [0] * len(centroids), [[0] * size for _ in centroids]
    start, last = centroids, rounds == 0
    state = checkpoint(_assigned(rows, size, lambda q, _: scan(q, start, parts), centroids if last else None), 10_000)
    for i in range(rounds):
        for (c, j), (n, s) in moved_sums(state, size).items():
            sums[c][j] += s
            counts[c] += n if j == 0 else 0
        old, centroids = centroids, [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(len(centroids))]
        drift = np.array([float(sum((x - y) ** 2 for x, y in zip(u, v, strict=True))) ** 0.5 for u, v in zip(old, centroids, strict=True)])

        def work(q: np.ndarray, batch: pa.RecordBatch, centroids: list = centroids, drift: np.ndarray = drift) -> tuple:
            lower = batch.column("lower").flatten().to_numpy().reshape(len(q), len(parts))
            return step(q, batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), lower, centroids, parts, drift)[:3]

        state = checkpoint(_assigned(state, size, work, centroids if i == rounds - 1 else None), 10_000)
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(inertia.values())
    if whole > np.iinfo(np.int64).max:
        raise OverflowError(f"an inertia of {whole} is beyond a long")
    of_cluster = spark.createDataFrame([(c, n, whole, names[c]) for c, n in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of ``embeddings`` after three rounds."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _round_sql(i: int) -> str:
    """Assignment ``a<i>`` to centroids ``c<i>``, and the centroids after it."""
    return f"""
d{i} AS (
  SELECT k.rid, c.c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(k.q, c.q)]) AS d FROM kept k, c{i} c
), a{i} AS (
  SELECT rid, CAST(best.c AS INTEGER) AS cluster, best.d AS distance FROM (SELECT rid, min({{'d': d, 'c': c}}) AS best FROM d{i} GROUP BY rid)
), s{i} AS (
  SELECT cluster AS c, i, sum(k.q[i]) AS s, count(*) AS n FROM a{i} JOIN kept k USING (rid), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL
), m{i} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY c
), c{i + 1} AS (
  SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c
)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS rid, [CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), seeds AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS c, q FROM kept
), c0 AS (
  SELECT c, q FROM seeds WHERE c < 16
), {",".join(_round_sql(i) for i in range(4))}, per AS (
  SELECT cluster, sum(distance) AS s FROM a3 GROUP BY cluster
)
SELECT k.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(p.s AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(s) FROM per) AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS VARCHAR) FOR x IN c.q], ',')) AS centroid_sha256
FROM a3 a JOIN kept k USING (rid) JOIN c3 c ON c.c = a.cluster JOIN per p ON p.cluster = a.cluster
"""
