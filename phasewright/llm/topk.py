"""Exact top-k inner products: vectors by descending length, rotated partial sums, residual bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import checkpoint, small_side, table

_EXACT = 2.0**52
#: Stands for itself and any score below, of which the longs end; it must not be among the best.
BELOW = -(2**63) + 1


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64) -> DataFrame:
    """(vec_id, q, norm): floor(factor * x) of each component as whole doubles, and the length.

    Vectors that are null or hold a null or a number that is not finite (a double
    over 2.8e306 is none once it is scaled) take no part, nor do null ids. A vector
    without components is one of length 0.
    """
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * factor < math.inf))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * factor).cast("double")).alias("q"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)))


def rotation(rows: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first.

    Each task sums outer products of its own vectors; what is collected is one
    size x size matrix.
    """

    def work(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            for part in np.array_split(pdf["q"].to_numpy(), max(1, len(pdf) // 2000)):
                if len(part):
                    m = _matrix(part, size)
                    total += m.T @ m
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    summed = rows.select("q").mapInPandas(work, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    gram = np.zeros((size, size))
    for r in summed.collect():
        gram[r["i"], r["j"]] = r["v"]
    values, vectors = np.linalg.eigh(gram)
    return np.ascontiguousarray(vectors[:, ::-1])


def _matrix(q, size: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(q), size))
    for i, v in enumerate(q):
        out[i, : len(v)] = v
    return out


def _whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; what is below every long is ``BELOW``.

    A product beyond the largest long would be the best of its query and can't be
    returned: OverflowError.
    """
    if (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1]) < _EXACT:
        return np.rint(np.einsum("ij,ij->i", a, b)).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a.tolist(), b.tolist(), strict=True)]
    if max(exact, default=0) > np.iinfo(np.int64).max:
        raise OverflowError(f"a score of {max(exact)} is beyond a long")
    return np.array([max(x, BELOW) for x in exact], np.int64)


def best_in_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, basis: np.ndarray, cells: int = 2_000_000) -> pd.DataFrame:
    """The ``k`` best candidates of each query in one block; ``floor`` is a score already reached by k others.

    Candidates go by descending length, a few at a time (``cells`` pairs). A query is done when
    the product of lengths is under its k-th best score. The rest are bounded by
    the sum over the first rotated coordinates and the product of what is left of
    both lengths; only pairs whose bound reaches the k-th best are multiplied out.
    """
    size = len(basis)
    c = candidates.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
    ids, norms, cq = c["vec_id"].to_numpy(np.int64), c["norm"].to_numpy(float), _matrix(c["q"].to_numpy(), size)
    qids, qnorms, qq = queries["qid"].to_numpy(np.int64), queries["norm"].to_numpy(float), _matrix(queries["q"].to_numpy(), size)
    kth = queries["floor"].to_numpy(float).copy()
    head = max(1, size // 4)
    cr, qr = cq @ basis, qq @ basis
    c_rest, q_rest = (np.sqrt(np.maximum(0, (x[:, head:] ** 2).sum(axis=1))) for x in (cr, qr))
    best_s, best_i = [np.empty(0, np.int64)] * len(qids), [np.empty(0, np.int64)] * len(qids)
    step = max(64, cells // max(1, len(qids)))
    whole = max(np.abs(cq).max(initial=0) * np.abs(qq).max(initial=0), 1) * size < _EXACT  # products of doubles are exact
    for at in range(0, len(ids), step):
        here = slice(at, at + step)
        slack = 1e-9 * qnorms * norms[at] + 1e-6
        alive = np.flatnonzero(qnorms * norms[at] + slack >= kth)
        if not len(alive):
            break
        other = ids[None, here] != qids[alive, None]
        near = other & (qr[alive, :head] @ cr[here, :head].T + q_rest[alive, None] * c_rest[None, here] + slack[alive, None] >= kth[alive, None])
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            continue
        alive, near = alive[some], near[some]
        if whole and near.mean() > 0.005:
            # many pairs are left: one product of matrices, then only scores that reach the k-th best
            scores = np.where(near, qq[alive] @ cq[here].T, -np.inf)
            reach = np.maximum(kth[alive], np.partition(scores, -k, axis=1)[:, -k]) if scores.shape[1] > k else kth[alive]
            rows, cols = np.nonzero(near & (scores >= reach[:, None]))
            scores = np.rint(scores[rows, cols]).astype(np.int64)
        else:
            rows, cols = np.nonzero(near)
            scores = np.concatenate([_whole_products(qq[alive[rows[i : i + 200_000]]], cq[at + cols[i : i + 200_000]]) for i in range(0, len(rows), 200_000)])
        if not len(rows):
            continue
        edges = np.flatnonzero(np.diff(rows, prepend=-1))
        for first, last in zip(edges, [*edges[1:], len(rows)], strict=True):
            q = alive[rows[first]]
            s, i = np.concatenate((best_s[q], scores[first:last])), np.concatenate((best_i[q], ids[at + cols[first:last]]))
            order = np.lexsort((i, -s))[:k]
            best_s[q], best_i[q] = s[order], i[order]
            if len(order) == k:
                kth[q] = max(kth[q], float(best_s[q][-1]))
    counts = [len(x) for x in best_s]
    return pd.DataFrame({"query_id": np.repeat(qids, counts), "vec_id": np.concatenate([*best_i, np.empty(0, np.int64)]).astype(np.int64), "score": np.concatenate([*best_s, np.empty(0, np.int64)]).astype(np.int64)})


def exact_top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16_384, group_rows: int = 16_384, bands: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    other rows. Candidates are dealt into blocks of similar length, queries into
    groups. A first pass over the block of longest vectors gives each query a
    score that ``k`` candidates reach; it is then sent only to bands whose
    longest vector could reach that score, and candidates go only to groups with
    such queries. Ties go to the smaller id. Scores are exact whatever the size of
    the components; the query fails if one of the best is no 64-bit number.

    Vectors that ``quantised`` passes over take no part; vectors of several sizes
    are filled with zeros; a repeated id is a candidate each time, and a query
    once (its first row by components); candidates of the query's own id take no
    part. An empty table gives no rows. Other columns are not read.
    """
    rows = checkpoint(quantised(vectors, id_col=id_col, vector_col=vector_col, factor=factor))
    total, size = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    schema = "query_id long, vec_id long, score long"
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = max(1, size)
    basis = rotation(rows, size)
    # bands of falling length, at most ``bands``; each is dealt into parts by a hash, so that equal lengths are no limit
    count = min(bands, max(1, math.ceil(total / block_rows)))
    edges = sorted(set(rows.select(F.percentile_approx("norm", [i / count for i in range(1, count)], 10_000)).first()[0]), reverse=True) if count > 1 else []
    band = F.lit(0)
    for e in edges:
        band = band + F.when(F.col("norm") < e, 1).otherwise(0)
    banded = rows.withColumn("band", band)
    found = {r["band"]: (max(1, math.ceil(r["n"] / block_rows)), float(r["top"])) for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()}
    by_band = [found.get(i, (1, 0.0)) for i in range(len(edges) + 1)]
    parts = F.array(*[F.lit(n) for n, _ in by_band])
    candidates = banded.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(parts, F.col("band")).cast("long")).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0)
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("q", "norm")).alias("_q")).select(F.col("vec_id").alias("qid"), "_q.q", "_q.norm")
    groups = max(1, math.ceil(total / every / group_rows))
    queries = queries.withColumn("grp", F.pmod(F.xxhash64("qid", F.lit(7)), F.lit(groups)).cast("int"))

    def search(q: DataFrame, c: DataFrame) -> DataFrame:
        def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:  # such a side comes without columns
                return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})
            return best_in_block(left, right, k, basis)

        return q.groupBy("grp", "band", "part").cogroup(c.groupBy("grp", "band", "part")).applyInPandas(work, schema)

    def best(found: DataFrame) -> DataFrame:
        # at most k rows from each block
        entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
        return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))

    zero, head = F.lit(0), (F.col("band") == 0) & (F.col("part") == 0)
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    first = search(queries.select("qid", "q", "norm", F.lit(-math.inf).alias("floor"), "grp", zero.alias("band"), zero.alias("part")), candidates.where(head).select("vec_id", "q", "norm", every_group, "band", "part"))
    first = checkpoint(first)
    reached = best(first).select(F.col("query_id").alias("qid"), F.when(F.size("best") == k, -F.get("best", F.lit(k - 1)).s.cast("double")).otherwise(-math.inf).alias("floor"))
    rest = queries.join(reached, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf)))
    tops = F.array(*[F.lit(t) for _, t in by_band])
    reach = F.size(F.filter(tops, lambda t: t * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("floor")))  # lengths fall, so these are the first bands
    sent = rest.withColumn("_n", reach).where("_n > 0").select("qid", "q", "norm", "floor", "grp", F.explode(F.sequence(zero, F.col("_n") - 1)).alias("band"))
    # at most one row for each group and band
    cells = checkpoint(sent.select("grp", "band").distinct())
    sent = sent.select("*", F.explode(F.sequence(zero, F.get(parts, F.col("band")) - 1)).alias("part")).where(~head)
    second = search(sent, candidates.where(~head).join(small_side(cells), "band").select("vec_id", "q", "norm", "grp", "band", "part"))
    out = best(first.unionByName(second)).select("query_id", F.posexplode("best").alias("_r", "_b"))
    return out.select("query_id", (F.col("_r") + 1).alias("rank"), F.col("_b.v").alias("vec_id"), F.when(F.col("_b.s") == -BELOW, F.raise_error(F.lit("a score is below every long"))).otherwise(-F.col("_b.s")).alias("score"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates for every twentieth vector of ``embeddings``."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
