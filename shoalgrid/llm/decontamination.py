"""Benchmark decontamination: a broadcast set of test windows, met by every window of the training texts.

Windows meet on a 64-bit hash and are confirmed word by word within the same join, so the texts are
read once and only confirmed hits (and one row for each document) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.shared import skewed_left_join, staged, table
from shoalgrid.llm.words import BETWEEN, with_text_key, word_list

WINDOW = 10
#: Windows that are broadcast at once, at some 300 bytes each; a larger benchmark is met block by block.
BLOCK = 300_000


def test_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """``(item, size, hash, window)``: each item's distinct windows of ``n`` words, or its one shorter window.

    Ids are taken as strings, null ids as the empty string; rows of one id are one item. Items without words have no window.
    """
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_list(F.col("text")).alias("words")).where("size(words) > 0")
    size = F.least(F.size("words"), F.lit(n))
    each = words.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("start"))
    windows = each.select("item", "size", F.slice("words", F.col("start"), F.col("size")).alias("window"))
    return windows.withColumn("hash", F.xxhash64("window")).distinct()


def _owned(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with the ``owner`` that stands for their set of items, and ``(owner, item)``.

    Most windows of an item belong to it alone, so a document meets few owners however many of its
    windows are hit. A set is told by its size and the combined hashes of its items, without gathering it.
    """
    mark = F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(1), "item")))
    known = staged(windows.groupBy("size", "hash", "window").agg(F.md5(mark.cast("binary")).alias("owner")), "test-windows")
    first = known.groupBy("owner").agg(F.min(F.struct("hash", "window")).alias("x")).select("owner", "x.*")
    return known, windows.select("item", "hash", "window").join(first, ["hash", "window"]).select("owner", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """What of each document occurs in the test items: one row for each row of ``docs``.

    ``docs(doc_id, text)`` and ``items(item_id, text)``; further columns are ignored. Returns ``doc_id,
    _k1, _k2`` (the text's key), ``n_words, n_hit``, ``spans`` (merged runs of hit words, from
    0, ends excluded) and ``items`` (ids of the items with a window in the text, sorted). A
    window is ``n`` consecutive words of an item; an item of fewer words is one window as a whole. Null and empty texts
    have no words; null, equal and repeated ids keep a row each; without items, or without words in them, nothing is hit.

    The windows are broadcast ``block`` at a time, by a hash, each block meeting all texts; with one
    block, the rule, the texts are read once. Rows of one id and text are worked out as one, with their number.
    """
    known, owners = _owned(test_windows(items, n))
    shape = known.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()  # at most n sizes
    sizes = shape["sizes"] or [n]
    blocks = max(1, -(-shape["n"] // block))
    texts = with_text_key(docs.select("doc_id", "text")).withColumn("words", word_list(F.col("text"))).drop("text")
    met = None
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod("hash", F.lit(blocks)) == b)
        here = _met(texts, part, sizes)
        met = here if met is None else met.unionByName(here.where("at > 0"))
    found = met.groupBy("doc_id", "_k1", "_k2").agg(
        F.count(F.when(F.col("at") == 0, 1)).alias("copies"), F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("at") > 0, F.struct("start", "end")))).alias("hits"),
        F.collect_set("owner").alias("owners"),
    )
    merged = _spans(found)
    held = skewed_left_join(merged.withColumn("owner", F.explode_outer("owners")), staged(owners, "test-owners"), ["owner"])
    per = held.groupBy("doc_id", "_k1", "_k2").agg(
        F.first("copies").alias("copies"), F.first("n_words").cast("long").alias("n_words"), F.first("spans").alias("spans"), F.sort_array(F.collect_set("item")).alias("items"),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return per.select("doc_id", "_k1", "_k2", "n_words", n_hit.alias("n_hit"), "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("_copy")


def _met(texts: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """One row at 0 for each text, and one for each of its runs that is a window, confirmed by its words.

    Words stay where they are: all from the list of starts to the filter is one generated loop, which copies
    a text's words for confirmed hits only. As a join key the words would be hashed for every run.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - (min(sizes) - 1), F.lit(0)))
    each = texts.select("doc_id", "_k1", "_k2", "words", F.explode(starts).alias("at"))
    each = each.withColumn("size", F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes))))
    run = F.slice("words", F.col("at"), F.col("size"))
    key = F.when((F.col("at") > 0) & (F.col("at") + F.col("size") <= F.size("words") + 1), F.xxhash64(F.slice("words", F.greatest("at", F.lit(1)), F.col("size"))))
    held = F.broadcast(windows.select("hash", "window", "owner"))
    joined = each.join(held, key == F.col("hash"), "left")
    told = joined.where(((F.col("at") == 0) & (F.col("size") == sizes[0])) | (F.col("hash").isNotNull() & (run == F.col("window"))))
    return told.select("doc_id", "_k1", "_k2", "at", F.size("words").alias("n_words"), (F.col("at") - 1).alias("start"), (F.col("at") + F.col("size") - 1).alias("end"), "owner")


def _spans(found: DataFrame) -> DataFrame:
    """Add ``spans``: the hit words' places in order, then the runs without a gap; linear in the number of hit words."""
    places = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1)))
    found = found.withColumn("_at", F.sort_array(F.array_distinct(places)))
    first = F.filter("_at", lambda p, k: (k == 0) | (F.get("_at", k - 1) < p - 1))
    last = F.filter("_at", lambda p, k: (k == F.size("_at") - 1) | (F.get("_at", k + 1) > p + 1))
    return found.withColumn("spans", F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))).drop("_at")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", n: int = WINDOW) -> DataFrame:
    """``docs`` without what occurs in the test items; all columns are kept.

    ``remove="documents"`` drops every document that is hit. ``"spans"`` cuts the hit words, each
    with what lies before it, out of the texts and leaves the rest as it is, letter case
    included; texts that are hit nowhere stay byte for byte, null ones null.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    hit = contamination(docs, items, n).where("n_hit > 0").groupBy("_k1", "_k2").agg(F.first("spans").alias("_spans"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # so that no name of theirs clashes
    found = skewed_left_join(with_text_key(whole), staged(hit, "hit-texts"), ["_k1", "_k2"])
    if remove == "documents":
        return found.where("_spans is null").select("_row.*")
    pieces = F.regexp_extract_all("text", F.lit(rf"{BETWEEN[:-1]}*[^{BETWEEN[1:-1]}+|{BETWEEN}$"), 0)
    found = found.withColumn("_pieces", F.when(F.col("_spans").isNotNull(), pieces))
    after = F.transform("_spans", lambda s, k: F.slice("_pieces", s["end"] + 1, F.coalesce(F.get("_spans", k + 1)["start"], F.size("_pieces")) - s["end"]))
    kept = F.concat(F.slice("_pieces", F.lit(1), F.get("_spans", F.lit(0))["start"]), F.flatten(after))
    cleaned = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return found.select(*[cleaned.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every document against ``benchmark``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words,
         row_number() OVER () AS row_id FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT row_id, s.size, i, array_to_string(words[i : i + s.size - 1], ' ') AS win
  FROM (SELECT row_id, words, s.size, unnest(range(1, len(words) - s.size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(words) >= s.size) s),
hits AS (
  SELECT dw.row_id, dw.i, dw.size, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
covered AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row_id, i, size FROM hits)) GROUP BY row_id),
found AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY row_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (row_id) LEFT JOIN found f USING (row_id)
"""
