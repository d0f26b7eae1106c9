"""Near copies at any size: the keys by which sets meet, and groups against brute force."""

import numpy as np

from shoalgrid.llm import components, shared, simhash


def test_sets_alike_share_a_key():
    """All pairs alike to 0.8 or more do, of any sizes and down to the very limit; few others that share a fifth."""
    g = np.random.default_rng(11)
    draw = lambda n: g.integers(0, 2**64, n, np.uint64)
    missed = met = 0
    for _ in range(3000):
        w = int(g.choice([1, 5, 20, 33, 40, 41, 52, 65, 80, 150, 300, 900])) + int(g.integers(0, 9))
        lost = int(g.integers(0, w // 5 + 1))
        new = max(0, int((w - lost) / 0.8 + 1e-9) - w)  # the union grows as far as the similarity allows
        x = draw(w)
        a, b = np.unique(x), np.unique(np.concatenate([x[lost:], draw(new)]))
        same = len(np.intersect1d(a, b))
        assert 5 * same >= 4 * (len(a) + len(b) - same)
        missed += not len(np.intersect1d(simhash.meeting_keys(a), simhash.meeting_keys(b)))
        other = np.unique(np.concatenate([x[: w // 5], draw(w - w // 5)]))
        met += w > 60 and len(np.intersect1d(simhash.meeting_keys(a), simhash.meeting_keys(other))) > 0
    assert missed == 0
    assert met < 600
    low = np.sort(draw(200) >> np.uint64(3))  # all in an eighth of the range: most parts are empty
    assert len(np.intersect1d(simhash.meeting_keys(low), simhash.meeting_keys(low[20:]))) > 0


def test_near_copies_need_no_comparison_of_all(spark, monkeypatch):
    """Groups as by brute force, though no fingerprints are compared."""

    def refuse(*_, **__):
        raise AssertionError("compares all pairs")

    monkeypatch.setattr(simhash, "fingerprint_links", refuse)
    g = np.random.default_rng(5)
    texts = []
    for size in (12, 36, 44, 60, 120, 400):
        for _ in range(4):
            words = [f"w{x}" for x in g.integers(0, 10**6, size)]
            for k in range(4):
                texts.append(" ".join(words[: size - k * size // 16] + [f"v{x}" for x in g.integers(0, 10**6, k * size // 25)]))
    rows = list(enumerate(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, low = max(up[i], up[j]), min(up[i], up[j])
                up = [low if u == old else u for u in up]
    assert len(set(up)) < len(up)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(up))


def test_tables_on_the_way_do_not_pile_up(spark, tmp_path, monkeypatch):
    """Keys are shuffled in shares, no table stays once it has been read, and the documents kept are the first of each group."""
    held, most, staged = tmp_path / "held", [], simhash.staged

    def watched(df, name):
        out = staged(df, name)
        most.append((name, out.count(), sum(f.stat().st_size for f in held.rglob("*.parquet"))))
        return out

    monkeypatch.setattr(simhash, "staged", watched)
    monkeypatch.setattr(components, "staged", watched)
    g = np.random.default_rng(8)
    base = [[f"w{x}" for x in g.integers(0, 10**6, 300)] for _ in range(12)]
    rows = [(n * 10 + k, " ".join([*words[: 300 - 2 * k], *[f"v{n}{k}"] * k])) for n, words in enumerate(base) for k in range(3)]
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{held}")
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [n * 10 for n in range(12)]
    left = {p.parent.name.rsplit("-", 1)[0] for p in held.rglob("*.parquet")}
    assert left == {"chosen"}, left
    assert max(size for _, _, size in most) == max(size for name, _, size in most if name in ("sets", "reps", "rows", "met"))  # nothing beside the keys later
    met = [n for name, n, _ in most if name == "met"]
    assert len(met) > 1 and max(met) < sum(met) / 2  # no round shuffles half of them


def test_a_common_key_chains_nothing(spark, monkeypatch):
    """Sets that share a key with many others are linked to those only that they may be like, in whatever group they fall."""
    monkeypatch.setattr(simhash, "FEW", 20)
    g = np.random.default_rng(4)
    sets = []
    for size in (10, 30, 31, 90, 400, 499, 500):
        for _ in range(30):
            x = np.unique(g.integers(0, 2**64, size, np.uint64))
            sets += [x, x[: size - size // 12]]
    prints = spark.createDataFrame([(n, [7]) for n in range(len(sets))], "node long, keys array<long>")
    nodes = spark.createDataFrame([(n, len(h), simhash.parities(h).tolist()) for n, h in enumerate(sets)], "node long, w int, fine array<long>")
    links = simhash.candidate_links(prints, nodes).collect()
    got = {(min(r), max(r)) for r in links}
    assert {(n, n + 1) for n in range(0, len(sets), 2)} <= got
    assert len(got) < len(sets)  # the key's sets no longer hang together


def test_a_group_gives_no_rows_for_its_pairs(spark):
    """Links of sets that meet by many keys are fewer than the keys' rows, and connect what pairs of a key connect that parities don't tell apart; keys go over the batches' borders."""
    g = np.random.default_rng(3)
    sets, rows = [], []
    for family in range(5):
        x = g.integers(0, 2**64, int(g.integers(56, 140)), np.uint64)
        for _ in range(40):
            sets.append(np.unique(np.concatenate([x[int(g.integers(0, len(x) // 6)) :], g.integers(0, 2**64, int(g.integers(0, len(x) // 8)), np.uint64)])))
    order = g.permutation(len(sets)).tolist()  # families meet in keys as well
    rows += [(n, [k for k in range(-9, 20) if 10 * k <= at < 10 * k + 60]) for at, n in enumerate(range(len(sets)))]
    rows += [(n, [1000 + at // 9]) for at, n in enumerate(order)]
    marks = [simhash.parities(h).view(np.uint64).tolist() for h in sets]

    def apart(i, j):
        n = min(len(marks[i]), len(marks[j]))
        fold = lambda m: [a ^ b for a, b in zip(m[:n], m[n:])] if len(m) > n else m
        a, b = len(sets[i]), len(sets[j])
        return 5 * min(a, b) < 4 * max(a, b) or 9 * sum((p ^ q).bit_count() for p, q in zip(fold(marks[i]), fold(marks[j]))) > a + b

    def labels(pairs):
        up = list(range(len(sets)))
        for i, j in pairs:
            old, low = max(up[i], up[j]), min(up[i], up[j])
            up = [low if u == old else u for u in up]
        return up

    by_key = {}
    for n, keys in rows:
        for k in keys:
            by_key.setdefault(k, []).append(n)
    want = {(i, j) for held in by_key.values() for i in held for j in held if i < j and not apart(i, j)}
    assert len({len(m) for m in marks}) > 1 and 1 < len(set(labels(want))) < len(sets) / 2
    prints = spark.createDataFrame(rows, "node long, keys array<long>")
    nodes = spark.createDataFrame([(n, len(h), simhash.parities(h).tolist()) for n, h in enumerate(sets)], "node long, w int, fine array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        links = [(r["a"], r["b"]) for r in simhash.candidate_links(prints, nodes).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert labels(links) == labels(want)
    assert len(links) <= sum(len(keys) for _, keys in rows) < len(want)
