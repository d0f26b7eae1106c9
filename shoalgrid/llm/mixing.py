"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies every one of its documents should
have on average: a whole part, and a fraction to be rounded. Pivotal rounding takes two documents
with fractional parts and moves *words* from one to the other, in the random direction that keeps
both expectations, until one of them is whole. Documents are dealt by a hash into leaves of
bounded size; each leaf leaves one residual, and residuals are combined the same way in a
reduction tree until one is left for each source, which is rounded by itself. As words are what
moves, a source then misses its target by that last document's share. A few documents of every
order of size travel up the tree beside the residuals, already whole; at the root some of them
are given one copy more or less, which makes good the miss to within a few words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.shared import WORD, staged, table

#: Weights of the sources in the order of their names (code points, null last), repeating.
WEIGHTS = (1.0, 2.0, 3.0)
LIMIT = 3.0
#: Stands for a null doc_id inside the tree.
NO_ID = -(1 << 63)


def targets(sizes: list[float], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; none above ``limit`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * unit > limit * sizes[k]]
        if not full:
            for k in open_:
                out[k] = weights[k] * unit
            break
        for k in full:
            out[k] = limit * sizes[k]
            left -= out[k]
        left = max(left, 0.0)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def _uniform(ids: np.ndarray, level: int, seed: int) -> np.ndarray:
    """A uniform number for each id, the same in every run."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + level * 7919 + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def pivot(size: np.ndarray, part: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions ``part`` in the given order; the index of the one left fractional, or -1.

    Each step takes the residual and the next document. With ``a`` words that can move one way
    and ``b`` the other, the move of ``a`` has probability ``b / (a + b)``, which keeps both
    expectations; either move makes at least one of the two whole. Words in sum are kept exactly.
    """
    p, s, held = part.tolist(), size.tolist(), -1
    for k, u in enumerate(chance.tolist()):
        if not 1e-12 < p[k] < 1 - 1e-12:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        a = min(p[held] * s[held], (1 - p[k]) * s[k])  # from the residual to this one
        b = min((1 - p[held]) * s[held], p[k] * s[k])  # from this one to the residual
        move = a if u * (a + b) < b else -b
        p[held] -= move / s[held]
        p[k] += move / s[k]
        one, two = (abs(p[x] - round(p[x])) < 1e-9 for x in (held, k))
        if one:
            p[held] = round(p[held])
        if two:
            p[k] = round(p[k])
        held = -1 if one and two else k if one else held
    return np.array(p), held


#: Documents of each order of size (powers of two) that travel up the tree.
RESERVE = 8


def _reserve(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The documents of each order of size with the smallest draws."""
    octave = np.floor(np.log2(np.maximum(size, 1))).astype(int)
    order = np.lexsort((chance, octave))
    first = np.searchsorted(octave[order], octave[order], "left")
    out = np.zeros(len(size), bool)
    out[order[np.arange(len(size)) - first < RESERVE]] = True
    return out


def settle(size: np.ndarray, copies: np.ndarray, miss: float, most: int) -> np.ndarray:
    """Copies changed by one for some documents, largest first, so that ``miss`` words too many (or too few) go."""
    copies, sign = copies.copy(), -1 if miss > 0 else 1
    for k in np.argsort(-size, kind="stable"):
        if 0 < size[k] <= abs(miss) and 0 <= copies[k] + sign <= most:
            copies[k] += sign
            miss += sign * size[k]
    return copies


def _level(level: int, seed: int, most: int, root: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, key = pdf["unit"].to_numpy(), pdf["key"].to_numpy()
        pdf = pdf.assign(draw=np.where(unit == NO_ID, key, unit)).sort_values(["size", "draw", "key"], ascending=[False, True, True], kind="stable")
        size, draw = pdf["size"].to_numpy(float), pdf["draw"].to_numpy()
        chance = _uniform(draw, level, seed)
        p, held = pivot(size, pdf["part"].to_numpy(float), chance)
        keep = _reserve(size, _uniform(draw, 0, seed + 1))
        if held >= 0:
            keep[held] = True
        if root:
            miss = 0.0
            if held >= 0:  # the last residual of a source is rounded by its own probability
                up = float(_uniform(draw[held : held + 1], level + 1, seed)[0] < p[held])
                miss, p[held] = (up - p[held]) * size[held], up
            base = pdf["base"].to_numpy(int)
            p = settle(size, base + p.astype(int), miss, most) - base
            keep[:] = False
        pdf["part"], pdf["open"] = p, keep
        return pdf[["unit", "key", "place", "bucket", "size", "base", "part", "open"]]

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, leaf_rows: int = 20_000, fan_in: int = 64, seed: int = 5, max_sources: int = 100_000, key: str | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` for each row of ``docs(doc_id, text, source)``.

    ``size`` is the number of words of the text (null or without words: 0). Sources are ordered
    by code point, null last, and take ``weights`` in turn; a source without words has the target
    0 and its documents no copies; an empty table gives an empty result. Documents without words
    get the whole part of their source's ratio. Rows with the same doc_id, source and size are
    units of their own, hashed by their texts as well: reruns return the same
    multiset. ``key`` names a further column of longs that is returned beside them and serves as that hash;
    null ids are told apart by it alone, rows that are equal in all of this by nothing. Only one row per source is brought to the driver
    (more than ``max_sources`` raise an error); leaves hold about ``leaf_rows`` rows however
    large a source is, and each level of the tree divides the leaves by ``fan_in``.
    """
    spark = docs.sparkSession
    base = staged(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (F.col(key).cast("long") if key else F.xxhash64("text")).alias("key")), "sizes")
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))], limit)
    n = sum(r["n"] for r in found)
    plan = spark.createDataFrame(
        [(k, r["source"], r["size"], t, (t / r["size"]) if r["size"] else 0.0) for k, (r, t) in enumerate(zip(found, aims))],
        "place int, name string, source_size long, target double, ratio double",
    )
    buckets = max(1, -(-n // leaf_rows))
    units = (
        base.join(F.broadcast(plan), base["source"].eqNullSafe(plan["name"]))
        .select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("unit"), "key", "place", "size", F.floor("ratio").cast("long").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("part"))
    )
    sized = units.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("unit", "key", F.lit(seed)), F.lit(buckets)))
    shape = "unit long, key long, place int, bucket long, size long, base long, part double, open boolean"
    level = 0
    most = int(limit)
    layer = staged(sized.groupBy("place", "bucket").applyInPandas(_level(level, seed, most, buckets == 1), shape), "leaf")
    done = [layer.where("not open")]
    while buckets > 1:
        level, buckets = level + 1, -(-buckets // fan_in)
        rest = layer.where("open").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
        layer = staged(rest.groupBy("place", "bucket").applyInPandas(_level(level, seed, most, buckets == 1), shape), "tree")
        done.append(layer.where("not open"))
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.unionByName(d)
    whole = rounded.select("unit", "key", "place", "size", (F.col("base") + F.rint("part").cast("long")).alias("copies"))
    none = units.where("size = 0").select("unit", "key", "place", "size", F.col("base").alias("copies"))
    out = whole.unionByName(none).join(F.broadcast(plan), "place")
    return out.select(F.when(F.col("unit") == NO_ID, F.lit(None)).otherwise(F.col("unit")).cast("long").alias("doc_id"), F.col("name").alias("source"), "size", "source_size", "target", "copies", *([F.col("key").alias(key)] if key else []))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row repeated by its copies (none: left out); all columns are kept.

    Rows are told apart by a hash of all their columns, so that null and repeated ids each get their own
    copies; rows that are equal in every column get the sum of theirs.
    """
    whole = F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))])
    keyed = docs.withColumn("_key", whole).withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    plan = mix_sources(keyed.select("doc_id", "text", "source", "_key"), key="_key", **how)
    plan = staged(plan.groupBy("_key", F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0"), "plan")
    same = (keyed["_key"] == plan["_key"]) & (keyed["_n"] == plan["_size"]) & keyed["source"].eqNullSafe(plan["_source"])

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_k", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)

    out = repeated(keyed.join(plan.where("_rows = 1").hint("merge"), same))
    if plan.where("_rows > 1").limit(1).count():
        equal = keyed.join(plan.where("_rows > 1"), same).select(*docs.columns, "_copies").distinct()
        out = out.unionByName(repeated(equal))
    return out


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document: words the mix takes, repeats counted."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
