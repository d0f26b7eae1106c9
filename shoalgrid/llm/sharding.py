"""Sharding by balanced label propagation, in DataFrame operations only.

Documents start in shards by a hash, which is even but cuts most links. In each round every
linked document learns, through joins, how many neighbours each shard holds, and asks to move to
the one that holds most. Requests are counted for each pair of shards, and quotas let as many
through as capacity allows, counting what leaves. Documents with a smaller neighbour and those
without take turns, so that two neighbours never swap places. At the end a distributed ranking
gives every shard its exact number of rows: what is over leaves from the end of a shard's order,
in which documents without links come last, so that they go first and cut nothing. Groups of equal
texts above a quarter of a shard do not take part: they are few, and are placed whole beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.llm.shared import staged, table, unstage

SHARDS = 24
#: Rows that one ranking bucket holds, about.
BUCKET_ROWS = 50_000


def equal_text_links(rows: DataFrame, n_rows: int, shards: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Links of documents with equal texts, ``(a, b, parts)``, from ``rows(doc_id, size, crc, hash)``; large groups' places; their rows by shard.

    A group of at most a quarter of a shard is a star around its smallest doc_id. A larger one, of which
    there are fewer than ``4 * shards``, is put into a shard as a whole, the largest first, each where
    most room is left; only one larger than a shard is cut, by a hash of the ids, into blocks of nearly
    a shard. Places are ``(v, anchor, shard, parts)``; ``parts`` is the number of ranking buckets needed.
    """
    key = ["hash", "size", "crc"]
    shard = n_rows / shards
    held = rows.where("doc_id is not null and hash is not null").groupBy("doc_id", *key).agg(F.count("*").alias("m"))
    groups = held.groupBy(*key).agg(F.count("*").alias("n"), F.sum("m").alias("rows"), F.min("doc_id").alias("centre")).where("n > 1")
    blocks = F.when(F.col("rows") <= int(shard), F.lit(1).cast("long")).otherwise(F.ceil(F.col("rows") / (0.95 * max(1.0, shard))))
    members = staged(held.join(groups, key).withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)), "members")
    large = F.col("rows") > max(1.0, shard / 4)
    links = members.where(~large & (F.col("doc_id") != F.col("centre"))).select(F.col("doc_id").alias("a"), F.col("centre").alias("b"), F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("parts"))
    # fewer than 4 * shards large groups and, of those cut, about 1.05 * shards + 1 more blocks
    sizes = members.where(large).groupBy(*key, "block").agg(F.sum("m").alias("m"), F.min("doc_id").alias("anchor")).collect()
    load, placed = [0] * shards, []
    for x in sorted(sizes, key=lambda x: (-x["m"], x["anchor"])):
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += x["m"]
        placed.append((*[x[c] for c in key], x["block"], x["anchor"], s, -(-x["m"] // BUCKET_ROWS)))
    plan = rows.sparkSession.createDataFrame(placed, "hash long, size long, crc long, block long, anchor long, shard int, parts int")
    places = members.where(large).join(F.broadcast(plan), [*key, "block"])
    places = places.groupBy(F.col("doc_id").alias("v")).agg(F.min(F.struct("anchor", "shard", "parts")).alias("p")).select("v", "p.*")
    return links, places, load


def first_shard(shards: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(shards)).cast("int")


def propagate(links: DataFrame, counts: list[int], cap: float, shards: int, rounds: int = 6, slack: float = 0.02) -> DataFrame:
    """``(v, shard)`` of every linked document after rounds of label propagation under capacity quotas.

    ``links(a, b)``; ``counts`` are the rows of each shard at the start that make no room for others: those of
    placed groups, and linked ones, which stand where ``first_shard`` puts them; ``cap`` is what a shard holds. Only counts by pairs of shards reach the driver.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "graph")
    now = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("anchor"), (F.col("low") < F.col("a")).alias("outer"), first_shard(shards, "a").alias("shard")), "labels")
    counts, cap = list(counts), cap * (1 + slack) + 4
    idle = 0
    for r in range(rounds):
        votes = both.join(now.select(F.col("v").alias("b"), "shard"), "b").groupBy(F.col("a").alias("v"), F.col("shard").alias("to")).agg(F.count("*").alias("w"))
        asked = (
            votes.join(now, "v").groupBy("v").agg(
                F.max_by("to", F.struct("w", -F.col("to"))).alias("to"), F.max("w").alias("most"),
                F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("w"))), F.lit(0)).alias("here"),
            ).where("most > here").select("v", "to")
        )
        asking = now.join(asked, "v", "left").withColumn("to", F.when(F.col("outer") == F.lit(r % 2 == 0), F.col("to")))
        asking = staged(asking, "requests")
        want = {(x["shard"], x["to"]): x["n"] for x in asking.where("to is not null").groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # at most shards ** 2 rows
        if not want:
            unstage(asking)
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        share = _quotas(want, counts, cap, shards)
        for (i, j), n in want.items():
            counts[i] -= n * share[j]
            counts[j] += n * share[j]
        # one draw for all neighbours of an anchor: they are let through together
        draw = F.pmod(F.xxhash64("anchor", F.lit(r)), F.lit(1_000_000)) / 1_000_000
        quota = F.element_at(F.array(*map(F.lit, share)), F.col("to") + 1)
        was, now = now, staged(asking.select("v", "anchor", "outer", F.when(F.col("to").isNotNull() & (draw < quota), F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
        unstage(was)
        unstage(asking)
    return now


def _quotas(want: dict, counts: list[float], cap: float, shards: int) -> list[float]:
    """Share of the requests to each shard that may pass, so that none ends above its capacity."""
    share = [1.0] * shards
    for _ in range(50):
        for j in range(shards):
            comes = sum(n for (_, to), n in want.items() if to == j)
            goes = sum(n * share[to] for (at, to), n in want.items() if at == j)
            share[j] = min(1.0, max(0.0, (cap - counts[j] + goes) / comes)) if comes else 1.0
    return share


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``, gapless from 0 within ``shard``, in the order ``(loose, bucket, part, anchor, ids)``.

    Windows run inside buckets of about ``BUCKET_ROWS`` rows; the buckets' offsets come from a
    window over their counts.
    """
    key = ["shard", "loose", "bucket", "part"]
    inside = Window.partitionBy(*key).orderBy("anchor", "doc_id", "hash", "size", "crc")
    before = Window.partitionBy("shard").orderBy("loose", "bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.withColumn("place", F.row_number().over(inside)).join(offsets, key).withColumn("rank", F.col("offset") + F.col("place") - 1).drop("place", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, rounds: int = 6) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row of ``docs(doc_id, text)``; row counts differ by one at most.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. ``links(a, b)`` of doc_ids defaults
    to equal texts; null texts, null ids and links to ids that are not in ``docs`` pull nothing.
    Rows repeated under one doc_id move together until the last step, which counts rows one by
    one. Slots are gapless from 0 in each shard. An empty table gives an empty result.
    """
    raw = F.col("text").cast("binary")
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("crc"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hash"),
        ), "rows",
    )
    start = F.when(F.col("doc_id").isNotNull(), first_shard(shards, "doc_id")).otherwise(first_shard(shards, "hash", "crc"))
    n = rows.count()
    if links is None:
        known, places, load = equal_text_links(rows, n, shards)
    else:
        known, load = links.select("a", "b", F.lit(1).alias("parts")), [0] * shards
        places = docs.sparkSession.createDataFrame([], "v long, anchor long, shard int, parts int")
    places = staged(places, "places")
    known = staged(known, "links")
    # rows without links leave when a shard is over its number, so they take no room from groups
    linked = known.select(F.col("a").alias("doc_id")).unionByName(known.select(F.col("b").alias("doc_id"))).distinct()
    held = rows.join(linked, "doc_id", "left_semi").join(places.select(F.col("v").alias("doc_id")), "doc_id", "left_anti")
    held = {r["s"]: r["n"] for r in held.groupBy(start.alias("s")).agg(F.count("*").alias("n")).collect()}
    labels = propagate(known, [held.get(s, 0) + load[s] for s in range(shards)], n / shards, shards, rounds)
    parts = known.groupBy(F.col("a").alias("v")).agg(F.max("parts").alias("parts"))
    labels = labels.join(parts, "v", "left").join(places.select("v"), "v", "left_anti").select("v", "anchor", "shard", F.coalesce("parts", F.lit(1)).alias("parts"), F.lit(1).alias("order"))
    labels = labels.unionByName(places.withColumn("order", F.lit(0))).select(F.col("v").alias("doc_id"), "anchor", F.col("shard").alias("moved"), "parts", "order")
    buckets = max(1, -(-n // (shards * BUCKET_ROWS)))
    placed = (
        rows.join(labels, "doc_id", "left")
        .withColumn("shard", F.coalesce("moved", start)).withColumn("loose", F.coalesce("order", F.lit(2)))
        .withColumn("anchor", F.coalesce("anchor", "doc_id"))
        .withColumn("bucket", F.pmod(F.xxhash64("anchor", F.when(F.col("anchor").isNull(), F.col("hash"))), F.lit(buckets)))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "hash"), F.coalesce("parts", F.lit(1)).cast("long")))
        .select("doc_id", "size", "crc", "hash", "shard", "loose", "anchor", "bucket", "part")
    )
    placed = staged(placed, "placed")
    have = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    have = [have.get(s, 0) for s in range(shards)]
    fuller = sorted(range(shards), key=lambda s: (-have[s], s))
    quota = [n // shards + (fuller.index(s) < n % shards) for s in range(shards)]
    over = [max(0, h - q) for h, q in zip(have, quota)]
    room = [max(0, q - h) for h, q in zip(have, quota)]
    before = lambda x: [sum(x[:s]) for s in range(len(x))]
    at = lambda x, s: F.element_at(F.array(*[F.lit(int(v)) for v in x]).cast("array<long>"), s + 1)
    shard = F.col("shard")
    out = ranked(placed).withColumn("spill", F.when(F.col("rank") >= at(quota, shard), at(before(over), shard) + F.col("rank") - at(quota, shard)))
    target = F.lit(None).cast("int")
    for s, (b, r) in enumerate(zip(before(room), room)):
        if r:
            target = F.when((F.col("spill") >= b) & (F.col("spill") < b + r), F.lit(s)).otherwise(target)
    out = out.withColumn("target", target)
    slot = F.when(F.col("spill").isNull(), F.col("rank")).otherwise(at(have, F.col("target")) + F.col("spill") - at(before(room), F.col("target")))
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.coalesce("target", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every document in 24 shards, by the law ``rows``."""
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
