"""The queries themselves, over small tables, against brute force."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from shoalgrid.llm import embedding_dedup, mixing, nearest, registry, sharding, simhash
from tests.llm.test_documents import WORD, brute_groups, print_of, texts

TABLES = {}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(11)
    docs = [(k, t, rng.choice(["s1", "s2", "s2", "é", None])) for k, t in enumerate(texts(150))]
    docs += [(500 + k, "the same text in many rows of the table", "s1") for k in range(60)]
    spark.createDataFrame([(k, t, "en", s, 0, "x") for k, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{at}/documents.parquet")
    g = np.random.default_rng(5)
    v = g.standard_normal((700, 12)).astype(np.float32)
    for k in range(0, 400, 5):
        v[k] = v[k + 1] + g.standard_normal(12).astype(np.float32) * g.uniform(0, 0.4)
    v[600:680] = v[600]  # many equal vectors
    rows = [(k, [float(x) for x in row], k // 5 % 3 if k < 600 else 1, 0) for k, row in enumerate(v)]
    rows += [(800, None, 0, 0), (801, [0.0] * 12, 0, 0), (802, [float("nan")] * 12, 0, 0), (803, rows[0][1], None, 0), (804, [1.0, None] + [0.0] * 10, 0, 0), (900, [float("inf")] + [0.0] * 11, 1, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int").write.parquet(f"{at}/embeddings.parquet")
    TABLES.update(documents=docs, embeddings=rows)
    return str(at)


def test_op1(spark, sf):
    got = sharding.op1_sharding(spark, sf).toPandas()
    docs = {k: t for k, t, _ in TABLES["documents"]}
    assert sorted(got["doc_id"]) == sorted(docs) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    n = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert n.max() - n.min() <= 1 and got["shard"].between(0, 23).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for r in got.itertuples():
        t = docs[r.doc_id]
        assert r.size == 8 + len((t or "").encode()) and (t is None or r.text_crc32 == zlib.crc32(t.encode()))


def test_op2_equals_its_sql(spark, sf):
    got = sorted(map(tuple, embedding_dedup.op2_embedding_near_dedup(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({registry.SQL['op2_embedding_near_dedup']})").fetchall()
    assert got == sorted(want)
    by_id = {r[0]: r for r in got}
    assert all(by_id[k][1] >= 79 and by_id[k][2] <= 600 for k in range(600, 680)) and len(got) == 706


def test_op3(spark, sf):
    got = mixing.op3_source_mixing(spark, sf).toPandas()
    source = {k: s for k, _, s in TABLES["documents"]}
    size = {k: len(WORD.findall(t or "")) for k, t, _ in TABLES["documents"]}
    assert sorted(got["doc_id"]) == sorted(size)
    names = ["s1", "s2", "é", None]
    total = [sum(n for k, n in size.items() if source[k] == s) for s in names]
    aims = dict(zip(names, mixing.targets(total, [1, 2, 3, 1])))
    taken = dict.fromkeys(names, 0)
    for r in got.itertuples():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[names.index(s)] and r.target == pytest.approx(aims[s])
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 if r.size == 0 else r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - aims[s]) <= 6 for s in names)
    again = mixing.op3_source_mixing(spark, sf).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_op6(spark, sf):
    got = {r["doc_id"]: r for r in simhash.op6_simhash_near_dedup(spark, sf).collect()}
    docs = TABLES["documents"]
    fps = [print_of(t) for _, t, _ in docs]
    comp = brute_groups([k for k, _, _ in docs], fps, 4)
    assert [(got[k]["fingerprint"], got[k]["component_id"]) for k, _, _ in docs] == [(f"{f:016x}", c) for f, c in zip(fps, comp)]


def test_op10(spark, sf):
    got = nearest.op10_nearest_neighbours(spark, sf).toPandas()
    rows = {k: np.array(v, float) for k, v, _, _ in TABLES["embeddings"] if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    asked = [k for k in rows if k % 100 == 0]
    assert sorted(set(got["query_id"])) == sorted(asked)
    hits = 0
    for q in asked:
        d = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), k) for k, v in rows.items() if k != q)[:10]
        part = got[got["query_id"] == q].sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11))
        found = list(zip(part["score"].tolist(), part["vec_id"].tolist()))
        assert found == sorted(found) and all(s == pytest.approx(float(np.sqrt(((rows[q] - rows[k]) ** 2).sum())), abs=1e-9) for s, k in found)
        hits += len({k for _, k in d} & set(part["vec_id"]))
    assert hits >= 0.9 * 10 * len(asked)
    ties = got[got["query_id"] == 600].sort_values("rank")["vec_id"].tolist()
    assert ties == list(range(601, 611))


def test_ties_beyond_k_are_not_sent(spark):
    q, rows = np.ones((3, 8)), np.ones((900, 8))
    own = np.zeros((3, 900), bool)
    i, j, d = nearest.adaptive_scan(q, rows, 10, nearest.rotation(8), own)
    assert len(i) == 30 and sorted(set(j.tolist())) == list(range(10)) and not d.any()
