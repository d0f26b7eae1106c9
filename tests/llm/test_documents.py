"""SimHash, line dedup, mixing and sharding against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shoalgrid.llm import line_dedup, mixing, sharding, simhash
from shoalgrid.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, unit int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 3, 4) for i, t, s in rows], SCHEMA)


def texts(n=120, seed=2):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 40, 200]))) for _ in range(n)]
    for k in range(10, n, 10):
        w = out[k - 1].split()
        if len(w) > 10:
            w[rng.randrange(len(w))] = "changed"
        out[k] = "\t".join(w)
    return [*out, None, "", " \n ", out[3]]


def print_of(text, width=4):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    if not w:
        return 0
    sh = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, radius):
    comp = list(ids)
    while True:
        new = [min(c for c, g in zip(comp, fps) if (f ^ g).bit_count() <= radius) for f in fps]
        if new == comp:
            return comp
        comp = new


def test_simhash_matches_brute_force(spark):
    rows = [(k, t, "s") for k, t in enumerate(texts())]
    got = {r["doc_id"]: (r["fp"][0] % 2**64, r["component_id"]) for r in simhash.simhash_groups(docs(spark, rows), 4, 4, 1, 4).collect()}
    fps = [print_of(t) for _, t, _ in rows]
    assert [got[k][0] for k in range(len(rows))] == fps
    assert [got[k][1] for k in range(len(rows))] == brute_groups(range(len(rows)), fps, 4)


def test_tiles_lose_no_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(8)]
    fps = sorted(set(near))
    df = spark.createDataFrame([(k, [f - 2**64 if f >= 2**63 else f]) for k, f in enumerate(fps)], "node long, fp array<long>")
    links = simhash.fingerprint_links(df, 4, tile_rows=20)
    comp = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert [comp.get(k, k) for k in range(len(fps))] == brute_groups(range(len(fps)), fps, 4)


def test_simhash_nulls_repeats_and_empty(spark):
    df = docs(spark, [(None, "a b c d e", "s"), (7, "a b c d e", "s"), (7, "a b c d e", "s"), (9, "A b c d  e", "s"), (None, "x y z w v u", "s"), (3, None, "s"), (4, "", "s")])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"] if r["component_id"] is not None else -1) for r in simhash.simhash_groups(df, 4, 4, 1, 4).collect())
    assert got == [(-1, -1), (-1, 7), (3, 3), (4, 3), (7, 7), (7, 7), (9, 7)]
    assert simhash.simhash_groups(docs(spark, [])).count() == 0
    kept = sorted(str(r["doc_id"]) for r in simhash.drop_near_copies(df).collect())
    assert kept == ["3", "7", "None"]  # the null id with the words of 7 is one of its group


def test_near_copies_under_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(900)) for _ in range(50)) for _ in range(4))
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "t"), (2, a, "s"), (3, b + " more", "s"), (None, c, "s"), (None, c + " more", "s"), (None, c, "s"), (None, d, "s"), (5, d, "s"), (6, "", "s"), (None, None, "s")]
    df = docs(spark, rows)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.drop_near_copies(df).collect())
    assert kept[:4] == sorted([("1", a), ("1", b), ("5", d), ("6", "")]) and len(kept) == 5
    assert kept[4][0] == "None" and kept[4][1] in (c, c + " more")
    assert [r["source"] for r in simhash.drop_near_copies(df).where(F.col("text") == b).collect()] == ["s"]


def test_near_copies_at_the_stage_defaults(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    first = [rng.choice(words) for _ in range(300)]
    copy = list(first)
    for k in (20, 90, 200):
        copy[k] = "other"  # a Jaccard similarity of 0.90 in five-word shingles
    half = first[:150] + [rng.choice(words) for _ in range(150)]
    rows = [(1, " ".join(first), "s"), (2, " ".join(copy), "s"), (3, " ".join(half), "s"), (4, " ".join(rng.choice(words) for _ in range(300)), "s")]
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()) == [1, 3, 4]


def brute_near(rows, width=5):
    """The smallest id of each chain of texts whose shingle sets are alike to 0.8."""
    def shingles(t):
        w = (t or "").split()
        return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = up[i], up[j]
                up = [min(x, y) if z in (x, y) else z for z in up]
    return {rows[k][0] for k in set(up)}


@pytest.mark.parametrize("block", [2000, 1 << 18])
def test_near_copies_are_checked_by_shingle_sets(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows = []

    def add(ws):
        rows.append((len(rows), " ".join(ws), "s"))

    for n in (9, 12, 30, 60, 300):
        for _ in range(3):
            first = [rng.choice(words) for _ in range(n)]
            add(first)
            for share in (0.9, 0.84, 0.78, 0.72, 0.65):  # the first part kept, the rest new: near and far on both sides of 0.8
                cut = round((n - 4) * 2 * share / (1 + share)) + 4
                add(first[:cut] + [rng.choice(words) for _ in range(n - cut)])
    for _ in range(40):
        add([rng.choice(words) for _ in range(6)])
    base = [rng.choice(words) for _ in range(120)]
    for k in range(25):  # a group of several blocks
        add(base[:k] + ["other"] + base[k + 1 :])
    rows += [(1000, "", "s"), (1001, None, "s"), (1002, " \n", "s")]
    got = {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()}
    assert got == brute_near(rows)


def brute_lines(rows, least=40, docs_=5):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})

    held = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= docs_ and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINE = "This line is long enough to be counted, ça va: forty and more"


def line_rows():
    rows = [(k, f"own {k} text that nobody else has in this very corpus\n  {LINE.upper().replace("Ç", "ç") if k % 2 else LINE}\t\nshort", "s") for k in range(6)]
    return [*rows, (6, LINE.replace("ç", "Ç"), "s"), (7, None, "s"), (8, "", "s"), (9, f"{LINE}\n{LINE}\n\n", "s"), (None, LINE, "s"), (9, f"{LINE}\nmore", "s"), (10, "x" * 100_000, "s")]


def test_lines_match_brute_force(spark):
    rows = line_rows()
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got], key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_deleting_restores_the_index(spark, tmp_path):
    rows = line_rows()
    first, second = docs(spark, rows[:4]), docs(spark, rows[4:])
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index")
    index.insert(first)
    assert index.frequent.count() == 0
    index.insert(second)
    assert index.frequent.count() == 1
    assert {r["text"] for r in index.clean(first).collect()} != {r["text"] for r in first.collect()}
    index.delete(second)
    assert index.frequent.count() == 0
    assert sorted(r["text"] for r in index.clean(first).collect()) == sorted(r["text"] for r in first.collect())
    blobs = [line_dedup.CuckooFilter.from_bytes(bytes(r["blob"])) for r in index.filters.collect()]
    assert all(not f.slots.any() for f in blobs)


def cleaned(index, df):
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in index.clean(df).collect()], key=str)


@pytest.mark.parametrize("probe_rows", [3, 200_000])
def test_filters_too_large_to_send_are_probed_by_shard(spark, tmp_path, probe_rows):
    rows = [*line_rows(), *[(None, f"{LINE}\nnumber {k}", "s") for k in range(6)]]
    rows += [(100 + k, f"a second line that is long and frequent, number {k % 3} of several", "s") for k in range(30)]
    index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index", broadcast_bytes=-1, shard_keys=1, probe_rows=probe_rows)
    index.insert(docs(spark, rows))
    assert index.state["shards"] == 4 and index.frequent.count() == 4
    assert cleaned(index, docs(spark, rows)) == brute_lines(rows)


def test_an_index_is_opened_again_and_changed_in_steps(spark, tmp_path, monkeypatch):
    rows = [r for r in line_rows() if r[0] is not None]
    rows += [(20 + k, "another line that grows frequent only by the last step, forty and more", "s") for k in range(6)]
    path = f"file://{tmp_path}/index"
    first, second, third = docs(spark, rows[:5]), docs(spark, rows[5:13]), docs(spark, rows[13:])
    line_dedup.LineIndex(spark, path).insert(first)
    read = []
    real = line_dedup.LineIndex._table
    monkeypatch.setattr(line_dedup.LineIndex, "_table", lambda self, names, schema: read.append(names) or real(self, names, schema))
    index = line_dedup.LineIndex(spark, path)
    old = list(index.state["postings"])
    index.insert(second)
    assert not any(n in old for names in read for n in ([names] if isinstance(names, str) else names or []))  # no older posting was read
    index = line_dedup.LineIndex(spark, path)
    index.insert(third)
    every = docs(spark, rows)
    assert cleaned(line_dedup.LineIndex(spark, path), every) == brute_lines(rows)
    line_dedup.LineIndex(spark, path).delete(second.unionByName(docs(spark, [(12345, "not held", "s")])))
    index = line_dedup.LineIndex(spark, path)
    left = rows[:5] + rows[13:]
    kept = {r[0] for r in left}
    assert [x for x in cleaned(index, every) if x[0] in kept] == [x for x in brute_lines(left)]
    index.compact()
    index = line_dedup.LineIndex(spark, path)
    assert len(index.state["postings"]) == 1 and [x for x in cleaned(index, every) if x[0] in kept] == brute_lines(left)
    index.insert(second)
    index.insert(second)  # ids that are held already
    assert cleaned(index, every) == brute_lines(rows)
    with pytest.raises(ValueError, match="other bounds"):
        line_dedup.LineIndex(spark, path, min_docs=3)


def test_a_change_cut_off_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    rows = line_rows()
    path = f"file://{tmp_path}/index"
    index = line_dedup.LineIndex(spark, path)
    index.insert(docs(spark, rows))
    want = cleaned(index, docs(spark, rows))
    monkeypatch.setattr(line_dedup, "_shard", lambda shards: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.delete(docs(spark, rows))
    monkeypatch.undo()
    index = line_dedup.LineIndex(spark, path)
    assert cleaned(index, docs(spark, rows)) == want
    index.delete(docs(spark, rows))
    assert index.frequent.count() == 0 and index.counts.count() == 0


def test_cuckoo_filter_has_no_false_negative():
    import numpy as np

    rng = np.random.default_rng(0)
    k = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    hi, lo = k[:, 0].copy(), k[:, 1].copy()
    f = line_dedup.CuckooFilter(5000)
    assert f.insert(hi, lo)
    assert f.contains(hi, lo).all()
    other = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    assert f.contains(other[:, 0].copy(), other[:, 1].copy()).mean() < 0.01
    f.delete(hi[:2500], lo[:2500])
    assert f.contains(hi[2500:], lo[2500:]).all()
    assert not line_dedup.CuckooFilter(16).insert(hi, lo)


def test_targets_reshare_what_is_capped():
    assert mixing.targets([100.0, 100.0], [1.0, 1.0]) == [100.0, 100.0]
    got = mixing.targets([10.0, 1000.0, 0.0, 500.0], [1.0, 2.0, 3.0, 1.0])
    assert got[0] == 30.0 and got[2] == 0.0 and sum(got) == pytest.approx(1510)
    assert got[1] / 2 == pytest.approx(got[3])
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("leaf_rows", [7, 20_000])
def test_mix_comes_near_its_targets(spark, leaf_rows):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.choice([1, 2, 5, 9, 40, 200])), rng.choice(["a", "b", "b", "b", None, "é"])) for k in range(800)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "\n ", None), (903, "word", "only"), (None, "one two", "a"), (5, rows[5][1], rows[5][2])]
    run = lambda: mixing.mix_sources(docs(spark, rows), leaf_rows=leaf_rows, fan_in=3)
    got = run().toPandas()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    aims = dict(zip(names, mixing.targets([sizes[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))])))
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    for s in names:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert part["target"].iloc[0] == pytest.approx(aims[s]) and part["source_size"].iloc[0] == sizes[s]
        assert abs((part["size"] * part["copies"]).sum() - aims[s]) <= 5
    assert got["copies"].between(0, 3).all()
    again = run().toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_pivot_keeps_words_and_chances():
    import numpy as np

    rng = np.random.default_rng(3)
    size, part = np.array([50.0, 30, 20, 10, 5, 3, 2, 1]), np.array([0.3] * 8)
    total = np.zeros(8)
    for _ in range(4000):
        p, held = mixing.pivot(size, part, rng.random(8))
        assert (p * size).sum() == pytest.approx(36.3)
        assert all(x in (0, 1) for k, x in enumerate(p) if k != held)
        total += p
    assert np.allclose(total / 4000, 0.3, atol=0.03)


def test_mixed_rows_follow_their_copies(spark):
    rows = [(k, "w " * (k + 1), "ab"[k % 2]) for k in range(40)] + [(3, "w " * 4, "b")]
    plan = mixing.mix_sources(docs(spark, rows)).collect()
    out = mixing.mixed(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    unique = {r["doc_id"]: r["copies"] for r in plan if r["doc_id"] != 3}
    seen = defaultdict(int)
    for r in out.collect():
        seen[r["doc_id"]] += 1
    assert all(seen[k] == n for k, n in unique.items())


@pytest.mark.parametrize("leaf_rows", [7, 20_000])
def test_mixed_rows_with_null_and_repeated_ids_are_not_lost(spark, leaf_rows):
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 5, 9, 40]) for _ in range(300)]
    rows = [(None if k % 3 == 0 else k // 4 if k % 3 == 1 else k, " ".join([f"w{k}"] * n), "abc"[k % 5 % 3]) for k, n in enumerate(sizes)]
    rows += [(7, "one two three", "a"), (7, "four five six", "a"), (7, "four five six", "b")] + [(None, "x y", "c")] * 5
    words = lambda got: {s: sum(len(t.split()) for _, t, z in got if z == s) for s in "abc"}
    got = [(r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(docs(spark, rows), leaf_rows=leaf_rows, fan_in=3).collect()]
    have = words(rows)
    aims = dict(zip("abc", mixing.targets([have[s] for s in "abc"], [1, 2, 3])))
    took = words(got)
    assert all(abs(took[s] - aims[s]) <= 5 for s in "abc")
    assert set(got) <= set(rows) and any(i is None for i, _, _ in got)


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(6)
    rows = [(k, f"text {rng.randrange(400)}", "s") for k in range(1000)] + [(5000 + k, "hot", "s") for k in range(500)] + [(9000, None, "s"), (9001, None, "s"), (9002, "", "s"), (None, "text 1", "s"), (1, "text 2", "s")]
    got = sharding.shard_documents(docs(spark, rows), 8).toPandas()
    assert len(got) == len(rows)
    n = got.groupby("shard").size()
    assert len(n) == 8 and n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by_id = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")["shard"]
    groups = defaultdict(set)
    for i, t, _ in rows[2:1000]:
        groups[t].add(by_id[i])
    split = sum(len(s) > 1 for s in groups.values())
    assert split <= 0.15 * len(groups)
    import zlib

    text = {i: t for i, t, _ in rows}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        t = text[int(r.doc_id)]
        if int(r.doc_id) != 1:
            assert r.size == len((t or "").encode()) + 8
            assert t is None or r.text_crc32 == zlib.crc32(t.encode())
    assert sharding.shard_documents(docs(spark, []), 8).count() == 0


def test_groups_up_to_a_shard_stay_whole(spark):
    rows = [(k, f"text {k}", "s") for k in range(1200)]
    for g, size in enumerate((110, 80, 60)):  # a shard has about 181 rows
        rows += [(2000 + 1000 * g + k, f"copies {g}", "s") for k in range(size)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs(spark, rows), 8).collect()}
    for g, size in enumerate((110, 80, 60)):
        assert len({got[2000 + 1000 * g + k] for k in range(size)}) == 1
    rows += [(9000 + k, "huge", "s") for k in range(700)]  # a third of all rows: three shards at least
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs(spark, rows), 8).collect()}
    assert len({got[9000 + k] for k in range(700)}) <= 5


def test_given_links_pull_documents_together(spark):
    rows = [(k, f"t{k}", "s") for k in range(400)]
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 200, 2)] + [(7, 7), (10**9, 3)], "a long, b long")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs(spark, rows), 4, links).collect()}
    cut = sum(got[k] != got[k + 1] for k in range(0, 200, 2))
    assert cut <= 15


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (200, 300), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {50: 50, 100: 50, 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
