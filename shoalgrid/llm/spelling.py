"""Spelling variants: words one edit apart, found by their three rarest bigrams, and grouped under the frequent form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.importance import CRC_SQL, crc_sql
from shoalgrid.llm.shared import staged, table, unstage
from shoalgrid.llm.words import ascii_lower

#: What lies between runs of Latin letters.
NO_LETTERS = r"[^A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
#: One in so many runs loses a letter in the query, as its contract says.
MISSPELT = 199
#: One edit touches two bigrams at most, so of any three one is left whole.
RAREST = 3


def word_counts(docs: DataFrame, misspelt: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: runs of Latin letters with A-Z lower-cased, of at least so many code points, that occur at least so often.

    ``docs(doc_id, text)``; null and empty texts have no words. With ``misspelt``, a run whose crc32 (of ``<doc_id>:<run>``,
    a null id as an empty text) it divides first loses the code point that the crc32 picks. Counts are
    combined on the map side, so a word that fills a third of the texts is one row of each task.
    """
    runs = docs.select("doc_id", F.explode_outer(F.split("text", NO_LETTERS)).alias("run")).where(F.char_length("run") >= least_length)
    word = ascii_lower(F.col("run"))
    if misspelt:
        runs = runs.withColumn("run", word)
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        at = F.pmod(h, F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        runs, word = runs.withColumn("run", F.when(F.pmod(h, F.lit(misspelt)) == 0, cut).otherwise(F.col("run"))).where(F.char_length("run") >= least_length), F.col("run")
    return runs.groupBy(word.alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, other)`` both ways round for distinct ``word`` s of four or more code points that one inserted, deleted or replaced code point tells apart.

    Bigrams are ordered by how often they occur, rare ones first; a word is filed under its three
    first ones (by order, then place). Of two words one edit apart, the first bigram in that order that the edit
    leaves whole stands among the three of both, since the edit touches two at most; and the edit lies to its left or to its right. So the
    words meet where all up to that bigram, or all from it on, is the same, and the lengths are the same or one apart:
    equality alone, which limits the place as well, and no pair is lost.
    The table of bigrams, which is broadcast, is bounded by the square of the alphabet. No other side of a join is, here and in
    ``group_variants``: the planner takes a word's six parts for one row, and its broadcast would hold them all in the driver.
    """
    placed = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("at")).withColumn("gram", F.expr("substring(word, at, 2)"))
    counts = placed.groupBy("gram").agg(F.count("*").alias("seen"))
    first = F.slice(F.sort_array(F.collect_list(F.struct("seen", "gram", "at"))), 1, RAREST)
    filed = placed.join(F.broadcast(counts), "gram").groupBy("word").agg(first.alias("first")).select("word", F.explode("first").alias("x"))
    at, size = F.col("x.at"), F.char_length("word")
    sides = F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), at + 1)), F.concat(F.lit(">"), F.substring("word", at, size)))
    held = filed.select("word", size.alias("size"), _letters(F.col("word")).alias("letters"), F.explode(sides).alias("part"))
    sent = held.select(F.col("word").alias("other"), F.col("letters").alias("other_letters"), F.col("size").alias("other_size"), "part", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"))
    pairs = held.join(sent.hint("merge"), ["part", "size"]).where(
        (F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2)
        & ((F.col("size") > F.col("other_size")) | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1),
    ).select("word", "other").distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def _letters(word: Column) -> Column:
    """A bit for each letter that the word holds; one edit changes two at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(63)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.when(c == "", F.lit(0).cast("long")).otherwise(bit(c))))


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each row of ``words(word, n)``, whose words are distinct.

    ``n_near`` counts the near words (``near_words``; those of fewer than four code points have none); ``form`` is the near word
    of largest ``n`` (ties: the smallest) if that is at least ``factor`` (2 or more) times the word's own, else
    null; ``root`` is what following forms ends in, the word itself if it has none. Null words
    or counts are left out; an empty table gives an empty result.

    Each form is ``factor`` times as frequent as its word, so chains are as short as the logarithm of the largest count,
    and the rounds that halve them are known beforehand.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    known = staged(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null and n is not null"), "words")
    counted = known.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = near_words(known.where(F.char_length("word") >= 4).select("word")).join(counted.hint("merge"), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    is_form = -F.col("best.minus") >= F.lit(factor) * F.col("n")
    told = staged(known.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    ), "forms")
    unstage(known)
    largest = told.agg(F.max("n")).first()[0] or 1
    longest = math.ceil(math.log(max(largest, 2), factor)) + 1
    ups = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(longest)))):
        further = ups.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        after = staged(ups.join(further.hint("merge"), "root", "left").select("word", F.coalesce("_up", "root").alias("root")), "roots")
        if ups.inputFiles() and ups.inputFiles()[0].rsplit("/", 1)[0] not in {f.rsplit("/", 1)[0] for f in told.inputFiles()}:
            unstage(ups)
        ups = after
    return told.join(ups.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of the words of ``documents``, one run in ``MISSPELT`` misspelt."""
    return group_variants(word_counts(table(spark, sf_dir, "documents"), MISSPELT)).select("word", "n", "n_near", "form", "form_n", "root")


OP12_SQL = rf"""
WITH RECURSIVE {CRC_SQL.strip()},
r AS (
  SELECT DISTINCT doc_id, run, n FROM (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL) WHERE length(run) >= 6),
h AS (
  SELECT run, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, crc),
m AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other FROM v a JOIN v b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT v.word, w.word FROM v JOIN w ON v.cut = w.word
  UNION SELECT w.word, v.word FROM v JOIN w ON v.cut = w.word),
q AS (
  SELECT p.word, p.other, w.n AS other_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS place, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM p JOIN w ON w.word = p.other),
f AS (
  SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.other_n >= 5 * w.n THEN q.other END AS form, CASE WHEN q.other_n >= 5 * w.n THEN q.other_n END AS form_n
  FROM w LEFT JOIN q ON q.word = w.word AND q.place = 1),
u AS (
  SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT u.word, f.form, steps + 1 FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, (SELECT arg_max(root, steps) FROM u WHERE u.word = f.word) AS root FROM f
"""
