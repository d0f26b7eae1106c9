"""Approximate nearest neighbours by adaptive dimension scans inside probed lists.

Rows are indexed in the lists of a k-means quantiser that is fitted on a bounded sample; every row
is assigned. Vectors are turned by a random rotation, so that the first columns of a difference
tell, up to a known deviation, how long all of it is. A probed list is scanned in blocks of
columns: after each block a hypothesis test compares a candidate's partial distance with the
query's current tenth-best and abandons it when it is too long to be explained by chance. What is
left is measured on the original vectors in double precision. Before vectors are compared they are moved to
where they lie and scaled by a power of two, so neither an offset nor a scale costs digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.llm.embedding_dedup import usable
from shoalgrid.llm.shared import staged, table

#: The quantiser and the number of probes are fitted on at most so many rows.
SAMPLE_ROWS = 20_000
#: The quantiser has at most so many lists, a few sample rows for each; longer lists are split into blocks.
MAX_LISTS = 4096


def rotation(dim: int, seed: int = 23) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 29) -> np.ndarray:
    """k-means on the sample; lists that fall empty keep their centre."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = nearest_lists(sample, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.r_[True, near[order][1:] != near[order][:-1]])
        c[near[order][starts]] = np.add.reduceat(sample[order], starts, axis=0) / n[n > 0][:, None]
    return c


def nearest_lists(rows: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = []
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        d = (c * c).sum(axis=1)[None, :] - 2 * part @ c.T
        best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(part), 1))
        out.append(np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1))
    return np.vstack(out) if out else np.empty((0, n), int)


def probes_needed(sample: np.ndarray, c: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The fewest lists that hold the share ``recall`` of the sample's own ``k`` nearest, found by brute force."""
    q = np.arange(0, len(sample), max(1, len(sample) // queries))[:queries]
    home = nearest_lists(sample, c, 1)[:, 0]
    order = nearest_lists(sample[q], c, len(c))
    place = np.argsort(order, axis=1)
    d = (sample * sample).sum(axis=1)[None, :] - 2 * sample[q] @ sample.T
    d[np.arange(len(q)), q] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(d, k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, home[best], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def adaptive_scan(q: np.ndarray, rows: np.ndarray, k: int, rotate: np.ndarray, own: np.ndarray, columns: int = 16, slack: float = 2.5, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, distance)`` of each query's ``k`` nearest rows of a list, as its tests let them through.

    Rows must come in the order of their ids: of rows at the same distance the first are kept.
    ``own`` marks pairs that must not meet. After ``d`` of ``D`` columns the partial distance,
    scaled by ``D / d``, is tested against ``(1 + slack / sqrt(d))**2`` times the k-th best so far. Partial distances
    are taken from the list's mean, in doubles, and every test allows for what rounding can have added to them.
    """
    dim = q.shape[1]
    unit = power_of_two(q, rows)
    q, rows = q * unit, rows * unit
    middle = rows.mean(axis=0)
    tq, tr = (q - middle) @ rotate, (rows - middle) @ rotate
    rounding = 8 * (dim + 8) * np.finfo(float).eps * ((tq**2).sum(1).max() + (tr**2).sum(1).max())
    bound = np.full(len(q), np.inf)
    best_d, best_r = np.full((len(q), 0), np.inf), np.empty((len(q), 0), np.int64)
    for at in range(0, len(rows), chunk):
        part = tr[at : at + chunk]
        i, j = np.nonzero(~own[:, at : at + chunk])
        partial = np.zeros(len(i))
        for done in range(0, dim, columns):
            upto = min(dim, done + columns)
            if len(i) > len(q) * len(part) // 4:  # dense: by matrix products
                block_q, block_r = tq[:, done:upto], part[:, done:upto]
                d2 = (block_q**2).sum(1)[:, None] + (block_r**2).sum(1)[None, :] - 2 * block_q @ block_r.T
                partial = partial + np.maximum(d2[i, j], 0)
            else:
                diff = tq[i, done:upto] - part[j, done:upto]
                partial = partial + np.einsum("ij,ij->i", diff, diff)
            if upto < dim:
                keep = partial * (dim / upto) <= bound[i] * (1 + slack / np.sqrt(upto)) ** 2 + rounding * dim / upto
                i, j, partial = i[keep], j[keep], partial[keep]
        keep = partial <= bound[i] * (1 + 1e-9) + rounding
        i, j = i[keep], j[keep] + at
        diff = q[i] - rows[j]
        exact = np.einsum("ij,ij->i", diff, diff)
        count = np.bincount(i, minlength=len(q))
        wide = int(count.max()) if len(i) else 0
        if not wide:
            continue
        new_d, new_r = np.full((len(q), wide), np.inf), np.full((len(q), wide), -1)
        slot = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        new_d[i, slot], new_r[i, slot] = exact, j
        best_d, best_r = np.hstack([best_d, new_d]), np.hstack([best_r, new_r])
        if best_d.shape[1] > k:
            # rows come in the order of their ids, so among ties the stable sort keeps the smaller ids
            order = np.argsort(best_d, axis=1, kind="stable")[:, :k]
            best_d, best_r = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_r, order, 1)
            bound = best_d[:, k - 1]
    i, s = np.nonzero(np.isfinite(best_d))
    return i, best_r[i, s], np.sqrt(best_d[i, s]) / unit


def power_of_two(*parts: np.ndarray) -> float:
    """What brings the largest component near 1; as a power of two it changes no digit."""
    most = max((float(np.abs(x).max()) for x in parts if x.size), default=0.0)
    return 2.0 ** -min(1000, max(-1000, int(np.floor(np.log2(most))))) if most > 0 else 1.0


def slack_needed(sample: np.ndarray, k: int, recall: float, rotate: np.ndarray, queries: int = 128) -> float:
    """The smallest slack with which a scan of the whole sample finds the share ``recall`` of its ``k`` nearest; at last, one that abandons nothing."""
    at = np.arange(0, len(sample), max(1, len(sample) // queries))[:queries]
    own = at[:, None] == np.arange(len(sample))[None, :]
    k = min(k, len(sample) - 1)
    if k < 1:
        return 2.5
    d = np.stack([((sample - sample[x]) ** 2).sum(axis=1) for x in at])
    d[own] = np.inf
    reach = np.sort(d, axis=1)[:, k - 1]
    for slack in (2.5, 4.0, 8.0):
        i, j, _ = adaptive_scan(sample[at], sample, k, rotate, own, slack=slack)
        if (d[i, j] <= reach[i]).sum() >= recall * k * len(at):
            return slack
    return 1e9


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.98, sample_rows: int = SAMPLE_ROWS,
    block_rows: int = 8192, block_queries: int = 2048, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows by Euclidean distance, ties to smaller ids.

    A row with the query's id is never its answer. Vectors that are null, empty, zero, or hold
    null or non-finite components take no part, nor do null ids, nor vectors of another length
    than most; rows repeated under an id count once, with the smallest vector. With fewer
    candidates than ``k`` all are returned; without any, the query has no row. ``recall`` is
    what the probes and the scan's slack are fitted for on the sample (see ``probes_needed``, ``slack_needed``); a query whose probed lists hold
    too few rows probes further ones. Lists and their queries
    are split into blocks of bounded size, so neither a popular list nor many queries meet in one task.
    """
    spark = rows.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
        return v.groupBy("vec_id").agg(F.min("v").alias("v"))

    every = staged(clean(rows), "vectors")
    shape = every.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], result)
    dim, n = shape["dim"], shape["n"]
    every = every.where(F.size("v") == dim)
    sample = np.array([r["v"] for r in every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()])
    scale = power_of_two(sample)
    origin = (sample * scale).mean(axis=0)

    def placed_at(v: np.ndarray) -> np.ndarray:
        return np.clip(v * scale, -1e150, 1e150) - origin

    sample = placed_at(sample)
    c = centroids(sample, max(1, min(MAX_LISTS, int(np.sqrt(n) / 2), len(sample))))
    probes = probes_needed(sample, c, k, recall)
    rotate = rotation(dim)
    slack = slack_needed(sample, k, recall, rotate)

    def assign(n_lists: int, sizes: np.ndarray | None):
        def run(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    v = placed_at(np.array(pdf["v"].tolist()))
                    lists = list(nearest_lists(v, c, n_lists).astype(np.int32))
                    if sizes is not None:
                        # the query itself may be among the rows, so k others are sure from k + 1 on
                        for x in np.flatnonzero([sizes[p].sum() <= k for p in lists]):
                            order = np.argsort(((c - v[x]) ** 2).sum(axis=1), kind="stable").astype(np.int32)
                            enough = int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1
                            lists[x] = np.union1d(lists[x], order[:enough])
                    pdf["list"] = lists
                else:
                    pdf["list"] = []
                yield pdf

        return run

    def placed(df: DataFrame, n_lists: int, sizes: np.ndarray | None = None) -> DataFrame:
        return df.mapInPandas(assign(n_lists, sizes), "vec_id long, v array<double>, list array<int>").withColumn("list", F.explode("list"))

    rows_in = staged(placed(every, 1), "lists")
    held = {r["list"]: r["n"] for r in rows_in.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MAX_LISTS rows
    sizes = np.array([held.get(x, 0) for x in range(len(c))])
    asked = staged(placed(clean(queries).where(F.size("v") == dim), probes, sizes), "probes")
    count = lambda df, size: {r["list"]: -(-r["n"] // size) for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}  # noqa: E731  at most MAX_LISTS rows
    of_rows, of_queries = count(rows_in, block_rows), count(asked, block_queries)
    met = [(x, of_rows[x], of_queries[x]) for x in of_rows if x in of_queries]
    if not met:
        return spark.createDataFrame([], result)
    blocks = F.broadcast(spark.createDataFrame(met, "list int, of_rows int, of_queries int"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        own_block = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(own)).cast("int")
        return df.join(blocks, "list").select("list", "vec_id", "v", own_block.alias(f"b_{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"b_{other}"))

    key = ["list", "b_of_rows", "b_of_queries"]

    def scan(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        r, q = r.sort_values("vec_id"), q.sort_values("vec_id")
        qi, ri = q["vec_id"].to_numpy(np.int64), r["vec_id"].to_numpy(np.int64)
        qv, rv = np.array(q["v"].tolist()), np.array(r["v"].tolist())
        found = [adaptive_scan(qv[a : a + 256], rv, k, rotate, qi[a : a + 256, None] == ri[None, :], slack=slack) for a in range(0, len(qi), 256)]
        i = np.concatenate([x[0] + 256 * t for t, x in enumerate(found)])
        return pd.DataFrame({"query_id": qi[i], "vec_id": ri[np.concatenate([x[1] for x in found])], "score": np.concatenate([x[2] for x in found])})

    left, right = dealt(asked, "of_queries", "of_rows"), dealt(rows_in, "of_rows", "of_queries")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the 10 nearest of every row whose vec_id is divisible by 100, among all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where("vec_id % 100 = 0"))
