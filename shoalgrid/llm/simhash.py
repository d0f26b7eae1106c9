"""SimHash near-dedup: exact tiled comparison of fingerprints with exclusive-or and bit counts.

Fingerprints are cut into tiles of one population count each. Two tiles are compared only if
their population counts differ by no more than the radius, since two fingerprints differ in at
least as many bits as their counts do. A tile pair is one Arrow group of bounded size; from
its hits only a spanning forest leaves the task, so a group of copies never becomes all its pairs.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.llm.components import connected_components
from shoalgrid.llm.shared import release_memory, staged, table, unstage

SPACES = bytes(range(9, 14)) + b" "
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TO_SPACE = bytes(32 if c in SPACES else c for c in range(256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of every ``width``-word shingle, repeats included.

    A-Z are lower-cased and words are runs without ASCII white space, joined by single spaces;
    a text of fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How often each bit, from the lowest, is set in ``h``."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        bits = np.unpackbits(h[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_MIX = [np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """An independent 64-bit hash of each hash; the hash itself for the first word."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + _MIX[k]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, width: int, words: int = 1) -> list[int]:
    """``words`` unsigned 64-bit majority words: a bit is 1 if set in over half of the hashes."""
    h = shingle_hashes(text, width)
    return [int(_WEIGHTS[2 * _bit_sums(_mixed(h, k)) > len(h)].sum(dtype=np.uint64)) for k in range(words)]


def fingerprints(docs: DataFrame, width: int, words: int = 1) -> DataFrame:
    """``(doc_id, fp array<long>)`` of each row of ``docs(doc_id, text)``; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, words) for t in b.column(1).to_pylist()], np.uint64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, words), pa.int32()), pa.array(fps.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "fp"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp array<long>")


def tile_hits(a: np.ndarray, b: np.ndarray, radius: int, first_radius: int, same: bool, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` (n x words of uint64) that differ in at most ``radius`` bits.

    ``first_radius`` bounds the difference in the first word; for one word it is the radius.
    """
    step = max(1, block // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, 0][:, None] ^ b[:, 0][None, :]) <= first_radius)
        i += k
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if a.shape[1] > 1 and len(i):
            keep = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= radius
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while not np.array_equal(up, again := up[up]):
            up = again
        return up

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def link_many(self, x: np.ndarray, y: np.ndarray, step: int = 1 << 16) -> None:
        """Link pairs; those that hang together already cost a look-up in an array, so a group of copies is no matter of its pairs."""
        for at in range(0, len(x), step):
            up = np.array(self.up)
            while not np.array_equal(up, up[up]):
                up = up[up]
            a, b = up[x[at : at + step]], up[y[at : at + step]]
            differ = a != b
            for p, q in np.unique(np.column_stack([a[differ], b[differ]]), axis=0).tolist():
                self.link(p, q)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in range(len(self.up)) if (r := self.root(x)) != x]


def fingerprint_links(fps: DataFrame, radius: int, words: int = 1, first_radius: int | None = None, tile_rows: int = 16384) -> DataFrame:
    """``fps(node long, fp array<long>)``, distinct fingerprints -> ``(a, b)`` spanning their links.

    Two nodes are connected in the result exactly if a chain of fingerprints joins them in which
    neighbours differ in at most ``radius`` bits. With several words the first word prunes:
    ``first_radius`` (default: the radius) bounds its part of the difference, and tiles are
    skipped when their first words' population counts differ by more than that.
    """
    spark = fps.sparkSession
    first_radius = radius if first_radius is None else min(radius, first_radius)
    keyed = fps.withColumn("pop", F.bit_count(F.col("fp")[0]))
    counts = {r["pop"]: r["n"] for r in keyed.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # at most 65 rows
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    chunks = {p: -(-n // tile_rows) for p, n in counts.items()}
    per_pop = F.element_at(F.create_map(*[F.lit(int(x)) for kv in sorted(chunks.items()) for x in kv]), F.col("pop"))
    tiles = (
        keyed.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit("tile")), per_pop.cast("long")).cast("int"))
        .groupBy("pop", "chunk").agg(F.collect_list(F.struct("node", "fp")).alias("rows"))
        .select("pop", "chunk", F.col("rows.node").alias("nodes"), F.flatten("rows.fp").alias("bits"))
    )
    tiles = staged(tiles, "tiles")
    near = [(p, q, chunks[q]) for p in chunks for q in chunks if abs(p - q) <= first_radius]  # at most 65 * 65 rows
    partners = spark.createDataFrame(near, "pop int, pop2 int, chunks int")
    pairs = (
        tiles.join(F.broadcast(partners), "pop")
        .withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("mine", F.struct("pop", "chunk")).withColumn("other", F.struct(F.col("pop2").alias("pop"), F.col("chunk2").alias("chunk")))
        .select(F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") <= F.col("other")).alias("first"), "nodes", "bits")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", ascending=False)
        node = [np.asarray(x, np.int64) for x in pdf["nodes"]]
        fp = [np.asarray(x, np.int64).view(np.uint64).reshape(-1, words) for x in pdf["bits"]]
        same = len(node) == 1
        a, b = fp[0], fp[-1]
        forest = Forest(len(a) if same else len(a) + len(b))
        for i, j in tile_hits(a, b, radius, first_radius, same):
            forest.link_many(i, j if same else j + len(a))
        ids = node[0] if same else np.concatenate(node)
        e = forest.edges()
        return pd.DataFrame({"a": ids[[x for x, _ in e]] if e else np.empty(0, np.int64), "b": ids[[y for _, y in e]] if e else np.empty(0, np.int64)})

    return pairs.groupBy("lo", "hi").applyInPandas(compare, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 5, radius: int = 46, words: int = 4, first_radius: int | None = 22) -> DataFrame:
    """``(doc_id, fp array<long>, component_id)`` for each row of ``docs(doc_id, text)``.

    Documents whose fingerprints are linked by a chain of differences of at most ``radius`` bits
    share the smallest doc_id among them. Texts without words (null, empty, white space only)
    have a fingerprint of zeros, linked like any other. Repeated rows are all returned; rows
    with a null doc_id keep it and never name a component (null if a group has no other).
    An empty table gives an empty result; further columns are ignored.

    The defaults take five-word shingles at a Jaccard similarity of 0.8: 256 bits, of which
    such texts differ in 39 with a deviation of 6. The contract's query passes its own values.
    """
    prints = staged(fingerprints(docs, width, words), "fingerprints")
    reps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    # a node is named by its smallest doc_id; fingerprints seen only under null ids join by a negative hash
    nodes = reps.select(F.coalesce("rep", -F.abs(F.xxhash64("fp")) - 1).alias("node"), "fp", "rep")
    if nodes.where("rep is not null").groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        nodes = reps.select(F.xxhash64("fp").alias("node"), "fp", "rep")  # ids repeated over different texts name no node
    links = staged(fingerprint_links(nodes.select("node", "fp"), radius, words, first_radius), "links")
    comps = connected_components(links)
    named = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = staged(named.join(lowest, "component").select("fp", "component_id"), "classes")
    return prints.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document: four-word shingles, 64 bits, links at 4 bits or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash_groups(docs, width=4, radius=4, words=1, first_radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: Sets of up to so many shingles meet by shared shingles, longer ones by shared parts; a pair alike to 0.8 has one side above SHORT only if the other is at most SHORT_MEETS.
SHORT, SHORT_MEETS = 32, 40
#: Shingles (and 256 for each set) that one task compares with as many others, about.
BLOCK_SHINGLES = 1 << 18
#: Up to so many sets of one key are compared in one group; more are dealt by size into groups of about that many.
FEW = 1024
#: Keys meet in so many rounds, each a shuffle of its share of them that is deleted before the next.
KEY_ROUNDS = 4
#: The smallest sizes of the classes that longer sets fall into, each class up to 1.25 times its smallest size.
CLASSES = [SHORT + 1]
while CLASSES[-1] < 1 << 31:
    CLASSES.append(CLASSES[-1] * 5 // 4 + 1)


def meeting_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the set of sorted distinct hashes ``h``: any two sets alike to 0.8 or more share one.

    Short sets: the first ``w - ceil(0.8 w) + 1`` hashes. Longer ones: two such sets differ in at most a ninth of the sum of their sizes, and the larger one is
    of the smaller one's class or of the next. For the class of the larger one, hashes are cut by value into more
    parts than the sets can differ in, so some part is the same in both, and a part's content is a key. Parts without
    hashes are no keys: there are ``spare`` parts besides, and a set that leaves more than these empty has the first hashes as keys as well.
    """
    w = len(h)
    first = h[: w - -(-4 * w // 5) + 1]
    if w <= SHORT:
        return first
    keys, own, scarce = [], bisect.bisect_right(CLASSES, w) - 1, w <= SHORT_MEETS
    mixed = _mixed(h, 1)
    for c in (own, own + 1) if 5 * w // 4 >= CLASSES[own + 1] else (own,):
        differ = 2 * (CLASSES[c + 1] - 1) // 9
        spare = 3 + differ // 12
        parts = differ + 1 + spare
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        with np.errstate(over="ignore"):
            keys.append(_mixed(np.add.reduceat(mixed, starts) + part[starts] * _MIX[2] + np.uint64(c) * _MIX[3], 3))
        scarce |= parts - len(starts) > spare
    return np.concatenate([*keys, first]) if scarce else np.concatenate(keys)


def parities(h: np.ndarray) -> np.ndarray:
    """A bit for each value of the hashes' last bits, as many as there are hashes or up to twice that: whether an odd number of them ends so.

    What two sets share cancels out, so their bits differ in at most as many places as the sets in hashes.
    """
    bits = max(64, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").astype(np.int64)


def may_be_alike(w: np.ndarray, at: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of sets of ``w`` hashes, whose parities are ``bits[at[k] : at[k + 1]]``: false only if they are less alike than 0.8."""
    size = np.diff(at)
    passed = 5 * np.minimum(w[i], w[j]) >= 4 * np.maximum(w[i], w[j])  # one's parities are then at most twice as many as the other's
    close = np.flatnonzero(passed)
    short = np.minimum(size[i[close]], size[j[close]])

    def folded(k: np.ndarray, m: int) -> np.ndarray:
        out, longer = bits[at[k][:, None] + np.arange(m)], np.flatnonzero(size[k] > m)
        out[longer] ^= bits[at[k[longer]][:, None] + np.arange(m, 2 * m)]
        return out

    for m in np.unique(short).tolist():
        of, step = close[short == m], max(1, (1 << 20) // m)
        for k in range(0, len(of), step):
            p = of[k : k + step]
            differ = np.bitwise_count(folded(i[p], m) ^ folded(j[p], m)).sum(axis=1, dtype=np.int64)
            passed[p] = 9 * differ <= w[i[p]] + w[j[p]]
    return passed


def _spanned(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Whole keys, one after the other, of ``rows(key, node, w, fine)`` -> ``(a, b)`` spanning what pairs that may be alike connect within each key."""
    key, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    w, at, bits = rows.column(2).to_numpy().astype(np.int64), rows.column(3).offsets.to_numpy(), rows.column(3).values.to_numpy().view(np.uint64)
    ends = np.searchsorted(key, key, side="right")
    forest, i, away = Forest(len(key)), np.arange(len(key)), 1
    root = i
    while len(i := i[i + away < ends[i]]):
        apart = i[root[i] != root[i + away]]  # the others hang together already
        passed = apart[may_be_alike(w, at, bits, apart, apart + away)]
        if len(passed):
            forest.link_many(passed, passed + away)
            root = forest.roots()
        away += 1
    e = np.array([(x, y) for x, y in forest.edges() if node[x] != node[y]], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[e[:, 0]]), pa.array(node[e[:, 1]])], ["a", "b"])


def key_links(few: DataFrame) -> DataFrame:
    """``few(key, node, w, fine)``, few sets of each key -> ``(a, b)``, fewer links of each key than it has sets.

    A task holds whole keys, compares a key's sets there by their parities and gives only a spanning forest of the pairs
    that may be alike, so near copies that meet by many keys never become rows for their pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if rest is None else pa.concat_batches([rest, b])
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield _spanned(b.slice(0, cut))
            rest = b.slice(cut)
        if rest is not None:
            yield _spanned(rest)
        release_memory()

    return few.select("key", "node", "w", "fine").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def _dealt(sets: DataFrame) -> DataFrame:
    """``sets(key, node, n, w, fine)``, ``n`` the sets of the key -> the same, ``key`` now a group's: any two sets of a key whose sizes differ by up to a quarter share one.

    Sizes fall into classes that grow by more than a quarter, and a group holds two neighbouring ones. Each is cut into
    blocks of about ``FEW`` sets, and every two blocks are a group. Keys of up to ``FEW`` sets stay whole.
    """
    class_, blocks = F.floor(F.log("w") / F.log(F.lit(1.26))), F.ceil(F.col("n") / FEW)
    mine = F.pmod(F.xxhash64("node", F.lit(11)), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("lo"), F.greatest("mine", o).alias("hi")))
    where = F.when(F.col("n") <= FEW, F.array(F.struct(F.lit(None).cast("long").alias("class"), F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("pairs")))).otherwise(
        F.array(F.struct(F.col("class"), pairs.alias("pairs")), F.struct((F.col("class") - 1).alias("class"), pairs.alias("pairs"))))
    placed = sets.withColumns({"class": class_, "blocks": blocks, "mine": mine}).withColumn("_to", F.explode(where))
    placed = placed.withColumn("_pair", F.explode_outer("_to.pairs"))
    key = F.when(F.col("n") <= FEW, F.col("key")).otherwise(F.xxhash64("key", "_to.class", "_pair.lo", "_pair.hi"))
    return placed.select(key.alias("key"), "node", "w", "fine")


def candidate_links(prints: DataFrame, nodes: DataFrame, last: bool = False) -> DataFrame:
    """``prints(node, keys)`` and ``nodes(node, w, fine)`` -> ``(a, b)``, whose components hold all pairs alike to 0.8 or more.

    Sets that share a key are compared in one task (``key_links``), and pairs whose parities tell them apart are left out, lest passages that many texts
    hold chain them all. The sets of a key that more than ``FEW`` have are dealt into groups (``_dealt``). A key gives fewer links than it has
    rows, so the links grow with the sets' keys and not with the pairs of a group. With ``last`` the files of ``prints`` are deleted once the keys have met.
    """
    per_key = Window.partitionBy("key")
    keys = prints.select("node", F.explode("keys").alias("key"))
    rounds = []
    for k in range(KEY_ROUNDS):
        part = keys.where(F.pmod("key", F.lit(KEY_ROUNDS)) == k)
        part = part.withColumns({"low": F.min("node").over(per_key), "high": F.max("node").over(per_key), "n": F.count("*").over(per_key)}).where("low != high")
        rounds.append(staged(part.select("node", "key", "n"), "met"))
    if last:
        unstage(prints)
    met = reduce(DataFrame.unionByName, rounds)
    sets = met.select("node", "key", "n").join(nodes.select("node", "w", "fine").hint("merge"), "node")
    links = staged(key_links(_dealt(sets)), "links")
    unstage(met)
    return links


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, mark, node, w, fine, keys)`` of each row of ``docs(doc_id, text)``: of the set of the text's shingles.

    ``mark`` is a hash of the text, ``w`` the number of distinct hashes and ``node`` a hash of them all; ``fine`` is ``parities``. ``keys`` are those by
    which sets meet (``meeting_keys``); a set that a task has seen before has none there again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in b.column(1).to_pylist()]
            node, keys = _nodes(sets), []
            for x, h in zip(node.tolist(), sets):
                keys.append(meeting_keys(h).view(np.int64) if len(h) and x not in seen else np.empty(0, np.int64))
                seen.add(x)
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node), pa.array([len(h) for h in sets], pa.int32()), pa.array([parities(h).tolist() for h in sets], pa.list_(pa.int64())), lists], ["doc_id", "mark", "node", "w", "fine", "keys"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, node long, w int, fine array<long>, keys array<long>")


def shingle_bits(docs: DataFrame, width: int) -> DataFrame:
    """``(node, bits)`` of each row of ``docs(doc_id, text)``: the sorted distinct hashes of the text's shingles, and their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(sets)), pa.array([_raw(h) for h in sets], pa.binary())], ["node", "bits"])
        release_memory()

    return docs.select("text").mapInArrow(run, "node long, bits binary")


def _raw(h: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes()


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(_raw(h), 7) for h in sets], np.uint64).view(np.int64)


def alike(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``i < j`` of sorted distinct hashes whose Jaccard similarity is 0.8 or more; exact, all pairs."""
    n, w = len(sets), np.array([len(x) for x in sets])
    seen, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), w)
    at = np.cumsum(df > 1) - 1  # a hash of one set alone is in no intersection
    keep = df[col] > 1
    row, col = row[keep], at[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shared = np.zeros((n, n), np.float32)
    step = max(256, (1 << 22) // n)
    for k in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        lo, hi = np.searchsorted(col, [k, k + step])
        part = np.zeros((n, int(col[hi - 1]) - k + 1), np.float32)
        part[row[lo:hi], col[lo:hi] - k] = 1
        shared += part @ part.T
    for k in range(0, n, 256):
        both = shared[k : k + 256].astype(np.int64)
        i, j = np.nonzero(5 * both >= 4 * (w[k : k + 256, None] + w[None, :] - both))
        i += k
        if (keep := i < j).any():
            yield i[keep], j[keep]


def _alike_edges(rows: DataFrame) -> DataFrame:
    """``rows(g, lo, hi, comp, node, label, bits)`` -> ``(a, b)`` spanning the links of each group's components; a node is joined to its label first."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.groupby("comp", sort=False):
            part = part.drop_duplicates("node")
            node, label = part["node"].tolist(), part["label"].tolist()
            forest, first = Forest(len(node)), {}
            for k, x in enumerate(label):
                forest.link(first.setdefault(x, k), k)
            if len(node) > 1 and len(first) > 1:
                for i, j in alike([np.frombuffer(x, "<u8") for x in part["bits"]]):
                    forest.link_many(i, j)
            for x, y in forest.edges():
                a.append(node[x])
                b.append(node[y])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.select("g", "lo", "hi", "comp", "node", "label", "bits").groupBy("g", "lo", "hi").applyInPandas(compare, "a long, b long")


def _blocked(rows: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """Add ``blocks``, the number of blocks of the row's component, and ``block``. ``sized(comp, w)`` are the same rows, if they are at hand already."""
    sizes = (rows if sized is None else sized).groupBy("comp").agg(F.ceil(F.sum(F.col("w") + 256) / BLOCK_SHINGLES).alias("blocks"))
    return rows.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Blocked rows sent to every pair of blocks of their component."""
    other = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.withColumn("g", F.col("comp")).withColumn("lo", F.least("block", "_o")).withColumn("hi", F.greatest("block", "_o"))


def verified_links(rows: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """``rows(comp, node, w, bits)``: sets in components of candidates -> ``(a, b)``, links of sets alike to 0.8 or more.

    Sets are connected by the result exactly if a chain of such pairs joins them. Small components are
    compared whole, several to a task. A large one is cut into blocks; the sets of a block are linked first,
    then the smallest of what hangs together in each block, which joins copies without pairing them
    all; only a component still in parts after that is compared over all pairs of its blocks. ``sized(comp, w)`` are
    the same rows, so that they need not be worked out for their sizes as well.
    """
    rows = staged(_blocked(rows, sized), "candidates")
    total = rows.agg(F.sum(F.col("w") + 256).alias("t")).first()["t"] or 0
    shared = F.pmod(F.xxhash64("comp"), F.lit(max(1, -(-total // BLOCK_SHINGLES))))
    small = rows.where("blocks = 1").select(shared.alias("g"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"), "comp", "node", F.col("node").alias("label"), "bits")
    inside = rows.where("blocks > 1").select(F.col("comp").alias("g"), F.col("block").alias("lo"), F.col("block").alias("hi"), "comp", "node", F.col("node").alias("label"), "bits")
    links = staged(_alike_edges(small.unionByName(inside)), "links")
    large = rows.where("blocks > 1")
    if not large.limit(1).count():
        unstage(rows)
        return links

    def labelled(links: DataFrame) -> DataFrame:
        return large.join(connected_components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    firsts = labelled(links).where("label = node").drop("blocks", "block")
    links = staged(links.unionByName(_alike_edges(_all_pairs(_blocked(firsts)))), "links")
    now = labelled(links)
    parts = now.groupBy("comp").agg(F.countDistinct("label").alias("n")).where("n > 1").select("comp")
    links = staged(links.unionByName(_alike_edges(_all_pairs(now.join(parts, "comp")))), "links")
    unstage(rows)
    return links


def near_copy_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, component_id, mark, group)`` for each row of ``docs(doc_id, text)``: the smallest doc_id of its group of near copies.

    Texts are linked if the sets of their ``width``-word shingles have a Jaccard similarity of 0.8 or more,
    and a group is what a chain of links joins. Candidates are sets that share a key (``meeting_keys``), which no
    linked pair lacks, and differ in few parities (``candidate_links``); no set is compared with all others. Texts without words are linked to each other only.
    Null ids are kept and never name a group. ``group`` tells groups apart where an id is repeated over
    different texts or all ids of a group are null, and ``mark``, a hash of the text, rows of one id.
    Tables written on the way are deleted when they have been read for the last time; those that the result reads stay.
    """
    prints = staged(shingle_sets(docs, width), "sets")
    nodes = staged(prints.groupBy("node", "w").agg(F.first("fine").alias("fine"), F.min("doc_id").alias("rep")), "reps")
    rows = staged(prints.select("doc_id", "mark", "node"), "rows")
    links = candidate_links(prints, nodes, last=True)
    candidates = connected_components(links)
    held = staged(nodes.join(candidates, "node").select("node", "w", "rep", F.col("component").alias("comp")), "held")
    unstage(candidates)
    unstage(links)
    # the texts of candidates are read again, one document of each set
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = again.join(held.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    if held.where("rep is null").limit(1).count():
        texts = texts.unionByName(again.where("doc_id is null"))
    sets = shingle_bits(texts, width).join(held.select("node", "w", "comp"), "node")
    links = verified_links(sets.groupBy("comp", "node", "w").agg(F.first("bits").alias("bits")), held.select("comp", "w"))
    comps = connected_components(links)
    named = nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = staged(named.join(ids, "component").select("node", F.col("component").alias("group"), "component_id"), "classes")
    for read in (comps, links, held, nodes):
        unstage(read)
    return rows.join(by_node, "node", "left").select("doc_id", "component_id", "mark", "group")


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest doc_id, null ones last.

    Of rows with that id in the group one text stays (the smallest hash), and of rows equal in id and text the one with the
    smallest remaining columns. Different texts under one id are different documents. All columns are kept.
    """
    groups = near_copy_groups(docs.select("doc_id", "text"), **how)
    per_row = groups.groupBy("group", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "n")).alias("k")
    chosen = staged(per_row.groupBy("group").agg(first).select(F.col("k.doc_id").alias("id"), "k.mark", "k.n"), "chosen")
    unstage(groups)

    def picked(rows: DataFrame) -> DataFrame:
        return docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"]) == rows["mark"]), "left_semi")

    if not chosen.where("n > 1").limit(1).count():
        return picked(chosen)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = picked(chosen.where("n > 1")).groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *rest)).alias("_row"))
    least = least.select("doc_id", "text", *[F.col("_row")[c].alias(c) for c in rest])
    return picked(chosen.where("n = 1")).unionByName(least).select(*docs.columns)
