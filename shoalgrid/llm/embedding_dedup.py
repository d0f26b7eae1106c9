"""Embedding near-dedup by collision counting on sorted one-dimensional projections.

Unit vectors are projected onto many random directions. For a query, a projection's window is
centred on the query's own value; another vector collides if it lies inside. Two vectors whose
cosine reaches the threshold are at a known distance, so each window catches them with a known
probability, and the least number of collisions that such a pair shows is a binomial quantile:
it is set so that a pair at the threshold is lost with a chance below ``miss``. Pairs that reach
the count are verified by their cosine in double precision.

Vectors of a label are dealt into blocks of bounded size and block pairs are compared in one task
each: a block's projections are sorted once, windows become ranges of ranks, and counting is
vectorised over ranks. Equal vectors are one, with a
multiplicity. A task returns, for each vector, its number of links and a spanning edge,
never the pairs themselves.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.components import connected_components
from shoalgrid.llm.shared import staged, table
from shoalgrid.llm.simhash import Forest


def usable(vector: str | Column) -> Column:
    """True for vectors that are not null or empty, hold only finite components, and not only zeros."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def least_collisions(projections: int, half_width: float, cosine: float, miss: float) -> int:
    """The largest count that a pair at the threshold fails to reach with a chance of at most ``miss``.

    A projection of a difference of length d on a unit-variance direction is normal with deviation d.
    """
    p = erf(half_width / sqrt(2 - 2 * cosine) / sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


def _unit(rows: list) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in rows])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def window_pairs(a: np.ndarray, b: np.ndarray, half_width: float, stages: list[tuple[int, int]], step: int = 64):
    """Index pairs of rows of the projected blocks ``a`` and ``b`` whose windows collide often enough.

    ``stages`` holds (projections, least collisions among so many): pairs below the count of one
    stage are not counted further. The first stage is dense, the later ones look only at what is left.
    """
    n, m = len(b), b.shape[1]
    order = np.argsort(b, axis=0, kind="stable")
    rank = np.empty((m, n), np.uint16)
    lo, width = np.empty((m, len(a)), np.uint16), np.empty((m, len(a)), np.uint16)
    for k in range(m):
        rank[k, order[:, k]] = np.arange(n, dtype=np.uint16)
        line = b[order[:, k], k]
        first = np.searchsorted(line, a[:, k] - half_width, "left")
        lo[k] = first
        width[k] = np.searchsorted(line, a[:, k] + half_width, "right") - first
    (dense, least), later = stages[0], stages[1:]
    shift, inside = np.empty((step, n), np.uint16), np.empty((step, n), bool)
    for at in range(0, len(a), step):
        r = min(step, len(a) - at)
        count = np.zeros((r, n), np.uint8)
        for k in range(dense):
            np.subtract(rank[k], lo[k, at : at + r, None], out=shift[:r])
            np.less(shift[:r], width[k, at : at + r, None], out=inside[:r])
            np.add(count, inside[:r].view(np.uint8), out=count)
        hit = np.flatnonzero(count >= least)
        total = count.reshape(-1)[hit]
        i, j, done = hit // n + at, hit % n, dense
        for upto, need in later:
            for k in range(done, upto):
                total = total + ((rank[k, j] - lo[k, i]) < width[k, i])
            keep = total >= need
            i, j, total, done = i[keep], j[keep], total[keep], upto
        if len(i):
            yield i, j


def near_vectors(
    rows: DataFrame, cosine: float = 0.93, projections: int = 32, half_width: float = 0.85, miss: float = 3e-5,
    block_rows: int = 4096, seed: int = 17, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``rows``.

    Vectors are linked when their labels are equal and not null (all are compared if ``label`` is
    None) and their cosine, in double precision, is at least ``cosine``. Vectors that are null or
    empty, all zeros, or hold null or non-finite components link with nothing: ``n_links`` 0 and
    their own id as component. So do vectors of different lengths among each other. ``kept`` is
    true where the component is the row's own id. Rows that repeat id, label and vector are one
    vector, returned as often as they occur; rows with a null id take no part and get nulls. An
    empty table gives an empty result.
    """
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(0)).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    known = staged(
        base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
        .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # minus zero is zero
        .withColumn("dim", F.size("v")).groupBy("label", "dim", "v", "vec_id").agg(F.count("*").alias("rows")), "vectors",
    )
    # equal vectors are compared as one, under the smallest id; a row repeated under its id counts once
    good = staged(known.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m")), "distinct")
    sizes = good.groupBy("label", "dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = good.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "vec_id", "m", "v"
    )
    stages = [(k, least_collisions(k, half_width, cosine, miss / 3)) for k in (12, 20, projections)]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["one"].iloc[0] == pdf["two"].iloc[0]
        first = (pdf["block"] == pdf["one"]).to_numpy()
        ids, many, unit = pdf["vec_id"].to_numpy(np.int64), pdf["m"].to_numpy(np.int64), _unit(pdf["v"].tolist())
        directions = np.random.default_rng(seed).standard_normal((unit.shape[1], projections))
        line = unit @ directions
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        if len(left) and len(right):
            for i, j in window_pairs(line[left], line[right], half_width, stages):
                if same:
                    keep = i < j
                    i, j = i[keep], j[keep]
                for at in range(0, len(i), 1 << 16):
                    x, y = left[i[at : at + (1 << 16)]], right[j[at : at + (1 << 16)]]
                    near = (np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine) & (ids[x] != ids[y])
                    x, y = x[near], y[near]
                    links += (np.bincount(x, many[y], len(ids)) + np.bincount(y, many[x], len(ids))).astype(np.int64)
                    forest.link_many(x, y)
        at = np.flatnonzero(links)
        return pd.DataFrame({"vec_id": ids[at], "links": links[at], "root": ids[[forest.root(int(k)) for k in at]] if len(at) else np.empty(0, np.int64)})

    found = staged(pairs.groupBy("label", "dim", "one", "two").applyInPandas(compare, "vec_id long, links long, root long"), "links")
    firsts = good.select("label", "dim", "v", F.col("vec_id").alias("first"), "m")
    # copies hang on the first of them, and have its links and each other
    copies = staged(known.join(firsts, ["label", "dim", "v"]).select("vec_id", "first", "m"), "copies")
    near = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    degrees = copies.join(near.withColumnRenamed("vec_id", "first"), "first", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    edges = found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(copies.select(F.col("vec_id").alias("a"), F.col("first").alias("b")))
    comps = connected_components(edges).select(F.col("node").alias("vec_id"), "component")
    out = base.select("vec_id").join(degrees, "vec_id", "left").join(comps, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector, compared within its label at a cosine of 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
k AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.93),
c(vec_id, component_id) USING KEY (vec_id) AS (
  SELECT DISTINCT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION
  SELECT k.a, min(c.component_id) FROM c JOIN k ON k.b = c.vec_id JOIN recurring.c AS old ON old.vec_id = k.a
  WHERE c.component_id < old.component_id GROUP BY k.a),
d AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT m.vec_id, CASE WHEN m.vec_id IS NOT NULL THEN coalesce(d.n, 0) END AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m LEFT JOIN c ON c.vec_id = m.vec_id LEFT JOIN d ON d.a = m.vec_id
"""
