"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

``LineIndex`` keeps, in one folder, signed postings ``(key, doc_id, refs)`` (insertions add,
deletions subtract), the exact counts of lines merged from them, and one cuckoo
filter for each shard of the frequent ones. Filters can forget: when deletions make a line rare
again, its fingerprint is taken out. Cleaning probes the filters, so only lines
that may be frequent meet the exact counts, which decide about each of them. What a change
leaves is named by a manifest that is written last: an index can be opened again by its folder, and a change that
was cut off leaves no trace but unused files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.shared import release_memory, shared_dir, table

SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KEY = "hi long, lo long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the line's key (ASCII space stripped, A-Z lowered); None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.translate(_LOWER))


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets a key; keys are pairs of 64-bit hashes."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 64, slots: np.ndarray | None = None):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (0.85 * self.SLOTS)))))
        self.slots = np.zeros((size, self.SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(slots=np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        print_ = (hi.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = lo.view(np.uint64) & mask
        return print_, first.astype(np.int64), (first ^ (self._spread(print_) & mask)).astype(np.int64)

    @staticmethod
    def _spread(print_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        p, a, b = self._places(hi, lo)
        return ((self.slots[a] == p[:, None]) | (self.slots[b] == p[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Add every key once; False if the table is too full, and then it must be rebuilt larger."""
        rng, mask = np.random.default_rng(len(hi)), len(self.slots) - 1
        for p, *at in zip(*(x.tolist() for x in self._places(hi, lo))):
            for _ in range(self.KICKS):
                free = next(((i, k) for i in at for k in range(self.SLOTS) if not self.slots[i, k]), None)
                if free:
                    self.slots[free] = p
                    break
                i, k = at[int(rng.integers(len(at)))], int(rng.integers(self.SLOTS))
                p, self.slots[i, k] = int(self.slots[i, k]), p
                at = [i ^ (int(self._spread(np.array([p], np.uint16))[0]) & mask)]
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for p, a, b in zip(*(x.tolist() for x in self._places(hi, lo))):
            hit = next(((i, k) for i in (a, b) for k in range(self.SLOTS) if self.slots[i, k] == p), None)
            if hit:
                self.slots[hit] = 0


def shard_of(lo: np.ndarray, shards: int) -> np.ndarray:
    return ((lo.view(np.uint64) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


POSTINGS, COUNTS, FILTERS = f"{KEY}, doc_id long, refs long", f"{KEY}, n_docs long, max_doc long", "shard long, size long, blob binary"


class LineIndex:
    """Lines of documents, counted exactly, under ``path`` (a folder that all executors can read).

    A line of at least ``min_chars`` code points that at least ``min_docs`` documents hold is
    frequent. Opening a folder that holds an index goes on with it; other bounds than its own raise a ValueError.
    ``insert`` takes ``docs(doc_id, text)``: rows repeated under one doc_id are one document, and an id that is
    held already gets the new lines beside its old ones. ``delete`` takes ``docs(doc_id)`` and takes these
    documents out as they were inserted; ids that aren't held are passed over. Deleting what was inserted
    restores the former state exactly. Rows with a null doc_id are counted nowhere, and lose frequent lines like any document.

    Inserting new documents reads the counts, never older postings. Deleting reads the postings of its documents, and
    of those lines whose last document goes. There is a shard of the filters for every ``shard_keys`` frequent lines, about.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 32 << 20, shard_keys: int = 1 << 16, probe_rows: int = 200_000):
        self.spark, self.path, self.broadcast_bytes, self.shard_keys, self.probe_rows = spark, path.rstrip("/"), broadcast_bytes, shard_keys, probe_rows
        self.state = self._latest() or {"round": 0, "min_chars": min_chars, "min_docs": min_docs, "shards": 1, "postings": [], "ids": [], "counts": None, "filters": None}
        if (self.state["min_chars"], self.state["min_docs"]) != (min_chars, min_docs):
            raise ValueError(f"the index in {path} has other bounds")
        self.min_chars, self.min_docs = min_chars, min_docs

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> dict | None:
        at, files = self._files()
        done = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(at, "manifest-*/_SUCCESS")) or []
        names = sorted(x.getPath().getParent().getName() for x in done)
        return json.loads(self.spark.read.schema("state string").parquet(f"{self.path}/{names[-1]}").first()["state"]) if names else None

    def _table(self, names: str | list[str] | None, schema: str) -> DataFrame:
        names = [names] if isinstance(names, str) else names or []
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _written(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{self.state['round'] + 1:06d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    @property
    def counts(self) -> DataFrame:
        """Documents, and the last of them, of every line that is long enough."""
        return self._table(self.state["counts"], COUNTS)

    @property
    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    @property
    def filters(self) -> DataFrame:
        return self._table(self.state["filters"], FILTERS)

    def _standing(self, postings: DataFrame) -> DataFrame:
        """What postings come to: the lines that documents hold now."""
        return postings.groupBy("hi", "lo", "doc_id").agg(F.sum("refs").alias("refs")).where("refs > 0")

    def insert(self, docs: DataFrame) -> None:
        state = dict(self.state)
        name = self._written(self.postings(docs), "postings")
        found = self._table(name, POSTINGS)
        lines = found.select("hi", "lo", "doc_id").distinct()
        if state["postings"]:
            held = self._table(state["ids"], "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 0")
            again = found.select("doc_id").distinct().join(held, "doc_id", "left_semi")
            if again.limit(1).count():
                old = self._standing(self._table(state["postings"], POSTINGS).join(again, "doc_id", "left_semi"))
                lines = lines.join(old, ["hi", "lo", "doc_id"], "left_anti")
                ids = found.select("doc_id").distinct().join(held, "doc_id", "left_anti")
            else:
                ids = found.select("doc_id").distinct()
        else:
            ids = found.select("doc_id").distinct()
        added = lines.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if state["counts"]:
            added = self.counts.unionByName(added).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        state["ids"] = [*state["ids"], self._written(ids.withColumn("n", F.lit(1).cast("long")), "ids")]
        self._change(state, name, added)

    def delete(self, docs: DataFrame) -> None:
        state = dict(self.state)
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        every = self._table(state["postings"], POSTINGS)
        name = self._written(self._standing(every.join(ids, "doc_id", "left_semi")).withColumn("refs", -F.col("refs")), "postings")
        gone = self._table(name, POSTINGS)
        lost = gone.groupBy("hi", "lo").agg(F.count("*").alias("lost"), F.max("doc_id").alias("top"))
        left = self.counts.join(lost, ["hi", "lo"], "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("lost", F.lit(0))).where("n_docs > 0")
        # lines whose last document went get the last of those that stay
        headless = left.where("top = max_doc").select("hi", "lo")
        rest = self._standing(every.unionByName(gone).join(headless, ["hi", "lo"], "left_semi"))
        last = rest.groupBy("hi", "lo").agg(F.max("doc_id").alias("last"))
        now = left.join(last, ["hi", "lo"], "left").select("hi", "lo", "n_docs", F.coalesce("last", "max_doc").alias("max_doc"))
        state["ids"] = [*state["ids"], self._written(gone.select("doc_id").distinct().withColumn("n", F.lit(-1).cast("long")), "ids")]
        self._change(state, name, now)

    def postings(self, docs: DataFrame) -> DataFrame:
        """``(hi, lo, doc_id, refs)``: each document's lines with the number of times it holds them."""
        least = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                digests, ids, refs = [], [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    held: dict[bytes, int] = {}
                    for line in _lines(text):
                        if key := line_key(line, least):
                            held[key] = held.get(key, 0) + 1
                    digests += held
                    ids += [doc] * len(held)
                    refs += held.values()
                k = _halves(digests)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(ids, pa.int64()), pa.array(refs, pa.int64())], ["hi", "lo", "doc_id", "refs"])
            release_memory()

        rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return rows.mapInArrow(run, POSTINGS)

    def _change(self, state: dict, postings: str, counts: DataFrame) -> None:
        """Write merged counts, bring the filters up to them, and then the manifest that makes it all count."""
        was, old_filters, old_shards = self.frequent, self.filters, state["shards"]
        state |= {"postings": [*state["postings"], postings], "counts": self._written(counts, "counts")}
        now = self._table(state["counts"], COUNTS).where(F.col("n_docs") >= self.min_docs)
        shards = state["shards"] = 1 << max(0, -(-now.count() // self.shard_keys) - 1).bit_length()
        if shards != old_shards:  # every key changes its shard's neighbours: all filters are filled anew
            was, old_filters = was.limit(0), old_filters.limit(0)
        both = now.select("hi", "lo", F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(was.select("hi", "lo", F.lit(0).alias("new"), F.lit(1).alias("old")))
        keys = both.groupBy("hi", "lo").agg(F.max("new").alias("new"), F.max("old").alias("old")).withColumn("shard", _shard(shards))
        state["filters"] = self._written(keys.groupBy("shard").cogroup(old_filters.groupBy("shard")).applyInPandas(_refilled, FILTERS), "filters")
        state["round"] += 1
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.parquet(f"{self.path}/manifest-{state['round']:06d}")
        self.state = state

    def compact(self) -> None:
        """Replace all postings by what they come to, and delete every file that the new manifest doesn't name.

        Tables that were read from the index before must not be used afterwards.
        """
        state = dict(self.state)
        state["postings"] = [self._written(self._standing(self._table(state["postings"], POSTINGS)), "postings")]
        ids = self._table(state["ids"], "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        state["ids"] = [self._written(ids, "ids")]
        state["round"] += 1
        manifest = f"manifest-{state['round']:06d}"
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.parquet(f"{self.path}/{manifest}")
        self.state = state
        named = {*state["postings"], *state["ids"], state["counts"], state["filters"], manifest}
        at, files = self._files()
        for x in files.listStatus(at):
            if x.getPath().getName() not in named:
                files.delete(x.getPath(), True)

    def _suspects(self, docs: DataFrame) -> DataFrame:
        """``(hi, lo, doc_id, row)`` of lines that a filter admits; ``row`` tells texts under a null id apart."""
        size = self.filters.agg(F.sum(F.length("blob"))).first()[0] or 0
        sent = size <= self.broadcast_bytes
        blobs = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in self.filters.collect()} if sent else None)
        least, shards = self.min_chars, self.state["shards"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = None if blobs.value is None else {s: CuckooFilter.from_bytes(x) for s, x in blobs.value.items()}
            for b in batches:
                digests, ids, rows = [], [], []
                for doc, row, text in zip(*(c.to_pylist() for c in b.columns)):
                    held = list(dict.fromkeys(k for line in _lines(text) if (k := line_key(line, least))))
                    digests += held
                    ids += [doc] * len(held)
                    rows += [row] * len(held)
                k, ids, rows = _halves(digests), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())
                if filters is not None and len(k):
                    keep, shard = np.zeros(len(k), bool), shard_of(k[:, 1].copy(), shards)
                    for s, f in filters.items():
                        at = np.flatnonzero(shard == s)
                        keep[at] = f.contains(k[at, 0].copy(), k[at, 1].copy())
                    k, ids, rows = k[keep], ids.filter(pa.array(keep)), rows.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), ids, rows], ["hi", "lo", "doc_id", "row"])
            release_memory()

        lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(), "text").where("text is not null").mapInArrow(run, f"{KEY}, doc_id long, row long")
        return lines if sent else self._probed(lines)

    def _probed(self, lines: DataFrame) -> DataFrame:
        """Lines that a filter admits, for filters that are too large to send: lines go to their shard's filter.

        A shard that many lines fall into, as a very common one does, is split into slices of about
        ``probe_rows`` lines, each beside a copy of the filter.
        """
        shards = self.state["shards"]
        lines = lines.withColumn("shard", _shard(shards))
        slices = lines.groupBy("shard").agg(F.ceil(F.count("*") / self.probe_rows).alias("slices"))
        dealt = lines.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("doc_id", "row"), F.col("slices")))
        copies = self.filters.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))

        def probe(lines: pa.Table, filters: pa.Table) -> pa.Table:
            lines = lines.select(["hi", "lo", "doc_id", "row"])
            if not len(lines) or not len(filters):
                return lines.slice(0, 0)
            held = CuckooFilter.from_bytes(filters["blob"][0].as_py())
            return lines.filter(pa.array(held.contains(lines["hi"].to_numpy(), lines["lo"].to_numpy())))

        pick = dealt.select("shard", "slice", "hi", "lo", "doc_id", "row").groupBy("shard", "slice")
        return pick.cogroup(copies.select("shard", "slice", "blob").groupBy("shard", "slice")).applyInArrow(probe, f"{KEY}, doc_id long, row long")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` cleaned and ``n_lines``, ``n_dropped`` added (replacing columns of these names).

        Frequent lines stay only in the document with the largest doc_id that holds them. A null
        or empty text is one empty line; a text that loses all its lines becomes empty.
        """
        drops = (
            self._suspects(docs).join(self.frequent, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
            .groupBy("doc_id", "row").agg(F.collect_set(F.struct("hi", "lo")).alias("k"))
            .select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("k.hi").alias("_hi"), F.col("k.lo").alias("_lo"))
        )
        docs = docs.drop("n_lines", "n_dropped")
        same = docs["doc_id"].cast("long").eqNullSafe(drops["_id"]) & _row().eqNullSafe(drops["_row"])
        joined = docs.join(drops, same, "left").drop("_id", "_row")
        names, least = docs.columns, self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, counts, dropped = [], [], []
                for text, hi, lo in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "_hi", "_lo"))):
                    lines = _lines(text)
                    counts.append(len(lines))
                    if not hi:
                        texts.append(text or "")
                        dropped.append(0)
                        continue
                    out = {np.array(x, "<i8").tobytes() for x in zip(hi, lo)}
                    kept = [x for x in lines if line_key(x, least) not in out]
                    texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                    dropped.append(len(lines) - len(kept))
                cols = [pa.array(texts, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])
            release_memory()

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return joined.mapInArrow(run, f"{types}, n_lines long, n_dropped long")


def _row() -> Column:
    """Tells rows under a null id apart, by their texts; null under an id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("row")


def _shard(shards: int) -> Column:
    return F.expr(f"cast(pmod(shiftrightunsigned(lo, 40), {shards}) as long)")


def _refilled(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter after its changes; rebuilt from the exact keys if they no longer fit."""
    if not len(keys):
        return old
    new = keys[keys["new"] == 1]
    pair = lambda d: (d["hi"].to_numpy(np.int64), d["lo"].to_numpy(np.int64))
    f = CuckooFilter.from_bytes(bytes(old["blob"].iloc[0])) if len(old) else CuckooFilter(len(new))
    f.delete(*pair(keys[(keys["new"] == 0) & (keys["old"] == 1)]))
    fits = f.insert(*pair(new[new["old"] == 0]))
    room = len(new)
    while not fits:
        room = 2 * room + 64
        f = CuckooFilter(room)
        fits = f.insert(*pair(new))
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "size": [len(new)], "blob": [f.to_bytes()]})


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Index all of ``docs`` and clean it: see ``LineIndex``; the index's folder is not used once the result is written."""
    index = LineIndex(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/shoalgrid/lines-{uuid.uuid4().hex}", min_chars, min_docs)
    index.insert(docs.select("doc_id", "text"))
    return index.clean(docs)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every document; null texts are one empty line."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
