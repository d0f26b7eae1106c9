"""Decontamination, spelling variants and importance resampling, against brute force over small tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from shoalgrid.llm import decontamination, importance, registry, spelling
from shoalgrid.llm.words import word_list

DOCS = "doc_id long, text string, words string, _k1 string, n_words long, hash long"
ITEMS = "item_id long, text string, size string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeñé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, prose(rng.randint(12, 30))) for k in range(12)] + [(12, "Short one, of six words only"), (13, "ÉCOLE x"), (3, prose(14)), (14, ""), (15, None), (None, prose(11)), (16, "?!")]
    items.append((17, items[0][1] + " and more than that"))  # shares windows with item 0
    docs = [(k, prose(rng.randint(0, 80))) for k in range(60)]
    for k in range(60, 100):
        hidden = rng.choice(items)[1] or ""
        docs.append((k, f"{prose(rng.randint(0, 9))}. {hidden.upper() if k % 3 else hidden.replace(' ', ', ')} {prose(rng.randint(0, 9))}" + (" " + hidden if k % 4 == 0 else "")))
    docs += [(200, None), (201, ""), (202, " \n!"), (203, "école x ÉCOLE x x"), (None, docs[70][1]), (None, docs[70][1]), (5, docs[71][1]), (5, docs[71][1]), (5, "x"), (204, (prose(4000) + " " + items[1][1] + " ") * 3)]
    return docs, items


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, corpus):
    at = tmp_path_factory.mktemp("words")
    docs, items = corpus
    spark.createDataFrame([(*d, "w", "k", 7, 1) for d in docs], DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(*i, "s") for i in items], ITEMS).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def by_sql(sf, name, docs=None):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    cur = con.execute(registry.SQL[name])
    return [x[0] for x in cur.description], cur.fetchall()


def same(df, sql):
    names, rows = sql
    order = [names.index(c) for c in df.columns]
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in rows), key=key)


def test_words(spark):
    texts = ["", None, "A-b_c9 É ßX\U0001F600y", " lead", "trail ", "İI"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", word_list(F.col("t")).alias("w")).orderBy("k").collect()
    assert [r["w"] for r in got] == [words_of(t) for t in texts]


def contaminated(text, items, n=10):
    words, hit, found = words_of(text), set(), set()
    for k, t in items:
        w = words_of(t)
        size = min(n, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1) if wins else ():
            if tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add("" if k is None else str(k))
    return words, hit, sorted(found)


def test_op11_equals_brute_force_and_sql(spark, sf, corpus):
    docs, items = corpus
    got = decontamination.op11_decontamination(spark, sf)
    want = []
    for k, t in docs:
        words, hit, found = contaminated(t, items)
        want.append((k, len(words), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert same(got, by_sql(sf, "op11_decontamination"))
    assert sum(r[5] for r in want) > 15


def test_contamination_in_blocks_of_windows(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(decontamination.contamination(docs, items, block=40)) == rows(decontamination.contamination(docs, items))


def test_spans_are_cut_and_the_rest_stays(spark, sf, corpus):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    cut = decontamination.decontaminate(docs, items)
    assert cut.columns == docs.columns
    want = []
    for k, t in corpus[0]:
        _, hit, _ = contaminated(t, corpus[1])
        if hit:
            pieces = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$", t)
            t = "".join(p for i, p in enumerate(pieces) if i not in hit)
        want.append((k, t, "w", "k", 7, 1))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, cut.collect()), key=key) == sorted(want, key=key)
    left = decontamination.decontaminate(docs, items, "documents")
    assert left.count() == sum(not contaminated(t, corpus[1])[1] for _, t in corpus[0])


def test_no_items_or_no_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(docs, items.limit(0)).count() == docs.count()
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "all")


def spell_words(corpus):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghijñéü") for _ in range(rng.randint(6, 11))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "abababab", "babababa", "ababababa"]
    out = []
    for w in base:
        out += [w] * rng.choice([5, 30, 200])
        for _ in range(4):
            i, kind = rng.randrange(len(w)), rng.choice("ird")
            v = w[:i] + ("x" + w[i:] if kind == "i" else "z" + w[i + 1 :] if kind == "r" else w[i + 1 :])
            out += [v] * rng.choice([4, 5, 6, 40])
    rng.shuffle(out)
    return out


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_op12_equals_brute_force_and_sql(spark, tmp_path, corpus):
    words = spell_words(corpus)
    docs = [(k, " ".join(words[k::97]).title() if k % 2 else ", ".join(words[k::97])) for k in range(97)] + [(None, "Abababab! ×÷ " * 3), (None, None), (100, ""), (100, "abababab " * 700)]
    spark.createDataFrame([(*d, "w", "k", 7, 1) for d in docs], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    count = {}
    for k, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, rows = {}, []
    for w in count:
        by = sorted((v for v in count if near(w, v)), key=lambda v: (-count[v], v))
        form[w] = by[0] if by and count[by[0]] >= 5 * count[w] else None
        rows.append([w, count[w], len(by), form[w], count[form[w]] if form[w] else None])
    for r in rows:
        root = r[0]
        while form[root]:
            root = form[root]
        r.append(root)
    got = spelling.op12_spelling(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows))
    assert same(got, by_sql(tmp_path, "op12_spelling"))
    assert sum(r[2] for r in rows) > 100 and any(r[3] for r in rows)


def test_chains_of_forms_end_in_their_root(spark):
    chain = [("aaaabcdefg"[: 4 + k] + "q" * 0, 7**k) for k in range(5)]  # each word one letter longer and seven times as frequent
    got = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame([*chain, (None, 3), ("alone", 1)], "word string, n int")).collect()}
    assert got == {w: chain[-1][0] for w, _ in chain} | {"alone": "alone"}
    assert spelling.group_variants(spark.createDataFrame([], "word string, n int")).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n int"), factor=1)


def test_op13_equals_brute_force_and_sql(spark, sf, corpus):
    features = lambda t: [" ".join(w[i : i + k]) for w in [words_of(t)] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    buckets = lambda t: [zlib.crc32(f.encode()) % 10000 for f in features(t)]
    docs, items = corpus
    s, t = [0] * 10000, [0] * 10000
    for side, table in ((s, docs), (t, items)):
        for _, text in table:
            for b in buckets(text):
                side[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for k, text in docs:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        b = buckets(text)
        weight = sum(gain[x] for x in b)
        rows.append([k, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    ranks = {id(r): p + 1 for p, r in enumerate(able[: 5 * len(able) // 100])}
    want = [(*r[:4], ranks.get(id(r))) for r in rows]
    got = importance.op13_importance(spark, sf)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and ranks
    assert same(got.where("doc_id is not null"), (by := by_sql(sf, "op13_importance"), (by[0], [r for r in by[1] if r[by[0].index("doc_id")] is not None]))[1])


def test_ranks_of_equal_rows_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    many = docs.where("doc_id = 204").crossJoin(spark.range(300)).drop("id")
    got = importance.resample(many, docs, share=(1, 2)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 151)) and len(got) == 300
    assert importance.drawn_documents(many, docs, share=(1, 2)).columns == docs.columns
    assert importance.resample(docs.limit(0), docs).count() == 0
    lone = importance.resample(docs, docs.limit(0)).collect()
    assert len(lone) == docs.count()
    with pytest.raises(ValueError):
        importance.with_features(docs, 40_000)
