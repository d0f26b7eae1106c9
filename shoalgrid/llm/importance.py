"""Target-distribution importance resampling over hashed n-grams, in Spark SQL functions from end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.shared import staged, table
from shoalgrid.llm.words import shifted, with_text_key, word_list

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("smallint")


def with_features(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``features``, the buckets of all runs of one to three words; nulls fill places where no run starts."""
    if not 0 < buckets <= 32_767:
        raise ValueError("buckets must fit a short")
    found = docs.withColumn("_words", word_list(F.col(text)))
    found = found.withColumn("_pairs", F.zip_with("_words", shifted(F.col("_words"), 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    triples = F.zip_with("_pairs", shifted(F.col("_words"), 2), lambda a, b: _bucket(F.concat(a, F.lit(" "), b), buckets))
    each = F.concat(*[F.transform(c, lambda w: _bucket(w, buckets)) for c in ("_words", "_pairs")], triples)
    return found.withColumns({"n_words": F.size("_words").cast("long"), "features": each}).drop("_words", "_pairs")


def bucket_counts(features: DataFrame) -> DataFrame:
    """``(bucket, n)`` over all features; counted on the map side first, so at most the buckets of a task are shuffled."""
    return features.select(F.explode_outer("features").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` of every bucket: a thousandth logarithms of how much likelier the target holds it, one added to each count."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = both.unionByName(source.sparkSession.range(buckets).select(F.col("id").cast("smallint").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counts = every.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return counts.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id (a null id as an empty text)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000).cast("long")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``(doc_id, _k1, _k2, copy, n_words, n_features, weight, score)`` for each row of ``docs``.

    ``docs(doc_id, text)``, ``target(text)``; further columns are ignored. ``weight`` sums the gains of a
    document's features, repeats counted; ``score`` adds noise that depends on the id alone. Null and empty texts have no
    features and weight 0. Rows of one id and text are summed up as one and told apart by ``copy``
    (from 1), so it matters to no task how many there are. Empty tables are fine on either side.

    Texts are read once: the buckets, two bytes a feature, are written to the shared folder,
    counted, and joined there with the gains (one row a bucket, a bound that does not grow with
    the data). The sum by document is combined on the map side, where a document's features lie together.
    """
    kept = staged(with_features(with_text_key(docs.select("doc_id", "text")), buckets).drop("text"), "features")
    target_counts = bucket_counts(with_features(target.select("text"), buckets))
    table_of_gains = F.broadcast(staged(gains(bucket_counts(kept), target_counts, buckets), "gains"))
    each = kept.select("doc_id", "_k1", "_k2", "n_words", F.posexplode_outer("features").alias("at", "bucket"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0  # one row of each document
    per = each.join(table_of_gains, "bucket", "left").groupBy("doc_id", "_k1", "_k2").agg(
        F.count(F.when(first, 1)).alias("copies"), F.max("n_words").alias("n_words"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"),
    )
    one = per.select("doc_id", "_k1", "_k2", "copies", "n_words", F.expr("n div copies").alias("n_features"), F.expr("sum div copies").alias("weight"))
    scored = one.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return scored.select("doc_id", "_k1", "_k2", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "n_words", "n_features", "weight", "score")


def ranked(rows: DataFrame, order: list[Column], partitions: int | None = None, name: str = "ranked") -> DataFrame:
    """Add ``rank`` (from 1) by ``order``, with no task that sees all rows.

    Rows are range-partitioned and sorted, and written with their place in their partition; a rank is that place plus the
    number of rows in the partitions before, a table with a row for each partition. ``order`` must
    tell rows apart, or equal ones share a partition. The written table stays until the shared folder is cleared.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = staged(placed, name)
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    offsets, before = [], 0
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    starts = spark.createDataFrame(offsets, "_part long, _before long")
    ranks = held.withColumn("_part", part).join(F.broadcast(starts), "_part", "left")
    return ranks.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``importance`` with ``rank``: 1, 2, 3... for the drawn rows, null for others.

    Of the N rows with at least ``least_words`` words, ``floor(share * N)`` with the highest scores are drawn
    without replacement; ties go to the smaller id (null ids first), then by the text's key and the copy.
    """
    scored = importance(docs, target, buckets, seed)
    fit = F.when(F.col("n_words") >= least_words, 0).otherwise(1)
    order = [fit.asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_k1").asc(), F.col("_k2").asc(), F.col("copy").asc()]
    placed = ranked(scored, order, name="scores")
    able = placed.where(F.col("n_words") >= least_words).count()
    drawn = share[0] * able // share[1]
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; of equal rows (id and text) all stay if one is drawn."""
    drawn = resample(docs, target, **settings).where("rank is not null").select("doc_id", "_k1", "_k2").distinct().withColumnRenamed("doc_id", "_id")
    keyed = with_text_key(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"))  # so that no name of theirs clashes
    met = (keyed["doc_id"].eqNullSafe(drawn["_id"])) & (keyed["_k1"] == drawn["_k1"]) & (keyed["_k2"] == drawn["_k2"])
    return keyed.join(drawn, met, "left_semi").select("_row.*")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document, drawn towards ``benchmark``."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 bit by bit into a table of bytes, then over the distinct features byte by byte.
CRC_SQL = r"""
crc0 AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)),
crc1 AS (
  SELECT i, list_reduce(list_prepend(c, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM crc0),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc1)"""


def crc_sql(text: str) -> str:
    """DuckDB's expression for the crc32 of a text, where ``crc(tab)`` is at hand."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST(('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS INTEGER), 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, x: xor(a // 256, tab[CAST(xor(a % 256, x) AS INTEGER) + 1])), 4294967295)"


OP13_SQL = rf"""
WITH {CRC_SQL.strip()},
a AS (
  SELECT 'd' AS side, row_number() OVER () AS row_id, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, row_id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM a),
f AS (
  SELECT side, row_id, array_to_string(words[i : i + k - 1], ' ') AS feature, count(*) AS n
  FROM (SELECT side, row_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 4) t(k) WHERE len(words) >= k) GROUP BY ALL),
h AS (
  SELECT feature, {crc_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), crc),
c AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM f JOIN h USING (feature) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(CAST(s AS DOUBLE)) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(CAST(t AS DOUBLE)) OVER () + 10000)))) AS BIGINT) AS gain FROM c),
d AS (
  SELECT row_id, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN h USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row_id),
z AS (
  SELECT w.doc_id, len(w.words) AS n_words, coalesce(d.n_features, 0) AS n_features, coalesce(d.weight, 0) AS weight,
    CAST(('0x' || substr(sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS u
  FROM w LEFT JOIN d USING (row_id) WHERE side = 'd'),
y AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(u AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM z),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM r
"""
