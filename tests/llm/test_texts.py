"""Classifiers, SentencePiece, URL filters and the pipeline: held-out accuracy, round trips, brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoalgrid.llm import quality, sentencepiece_codec, toxicity, url_filter
from shoalgrid.llm.shared import labelled_sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids int, host string, rule int"
INSULTS = ["grumbot", "snivelak", "wartface", "dregling"]


def prose(rng, n):
    parts = ["an", "the", "er", "ing", "on", "re", "ti", "ble", "sh", "ea", "nd", "ou"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return words


def toxic_sample(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = prose(rng, rng.randint(20, 120))
        y = int(k % 4 == 0)
        if y:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        out.append((" ".join(w) + ".", y))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit_toxicity(toxic_sample(600, 1), landmarks=64)


def test_toxicity_on_held_out_texts(model):
    held = toxic_sample(300, 2)
    got = model.score([t for t, _ in held]) >= 0.5
    assert np.mean(got == np.array([y for _, y in held])) >= 0.99


@pytest.mark.parametrize("word", ["grum-bot", "g.r.u.m.b.o.t", "snivelaak", "snivxelak", "wartfface", "w a r t f a c e", "DREGLING", "dre7gling", "dregliing"])
def test_toxicity_sees_through_gaps_and_insertions(model, word):
    rng = random.Random(8)
    assert model.score([" ".join([*prose(rng, 30), word, *prose(rng, 30)])])[0] >= 0.5


def test_toxicity_of_empty_odd_and_long_texts(model):
    s = model.score([None, "", " \n", "123 !!", "é", "日本語 " * 50, "the er ing " * 300_000, "x" * 3_000_000, "the er " * 200_000 + "grumbot"])
    assert s.shape == (9,) and np.isfinite(s).all() and (s[:7] < 0.5).all() and s[8] >= 0.5
    assert len(model.score([])) == 0


def test_kernel_is_positive_and_collapses_to_triple_weights():
    words = ["grumbot", "grumxbot", "other", "thing", "snivelak", "gr"]
    strings = [toxicity.letters(w) for w in words]
    z = toxicity.triples(strings)
    assert np.allclose(toxicity.kernel(strings, z), z @ z.T, atol=1e-5)
    assert np.linalg.eigvalsh((z @ z.T).astype(float)).min() > -1e-5
    weight = np.random.default_rng(0).standard_normal(toxicity.A**3).astype(np.float32)
    assert np.allclose(toxicity.strongest(words[:5], weight)[:, 0], z[:5] @ weight, atol=1e-4)
    assert z[0] @ z[1] > 3 * abs(z[0] @ z[2])


def test_sentences_are_labelled_by_their_strongest_word():
    told = toxicity.Sentences.of([("a fine day. you grumbot there! the end", 1), ("grumbot\nall well", 1), ("the fine end. all day", 0), ("", 0)])
    assert len(told.text) == 7 and told.label.tolist() == [1, 1, 0, 0]
    word = {w: k for k, w in enumerate(told.words)}
    at = lambda w: word[toxicity.letters(w)]
    assert told.texts_with(1)[at("grumbot")] == 2 and told.texts_with(0)[at("fine")] == 1
    value = np.zeros(len(told.words))
    value[at("grumbot")], value[at("there")], value[at("day")] = 2.0, 1.0, 1.5
    seen = told.witnesses(value, 0.5)
    assert {told.words[k]: n for k, n in enumerate(seen) if n} == {toxicity.letters("grumbot"): 2, toxicity.letters("there"): 1}
    value[:] = -np.inf
    assert not told.witnesses(value, 0.5).any()


@pytest.mark.parametrize("insult", ["w a r t f a c e", "wartface", "w.a.r.t.f-a-c-e"])
def test_no_cut_of_a_long_text_hides_an_insult(model, insult, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 400)
    rng = random.Random(3)
    for shift in range(0, 30, 3):
        text = "x" * shift + " " + " ".join(prose(rng, 60)) + " " + insult + " " + " ".join(prose(rng, 150))
        cut = text.index(insult)
        whole = model.score([text[max(0, cut - 380 - shift) :]])
        monkeypatch.setattr(toxicity, "PIECE", 1 << 18)
        assert whole[0] == pytest.approx(model.score([text[max(0, cut - 380 - shift) :]])[0]) and whole[0] >= 0.5
        monkeypatch.setattr(toxicity, "PIECE", 400)


def test_a_word_without_end_is_cut_with_an_overlap(model, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 100)
    monkeypatch.setattr(toxicity, "LONGEST", 300)
    for n in range(270, 310):
        assert np.isfinite(model.score(["é" * 100 + "日" * 50 + "x" * n + "grumbot" * 3])).all()
        weight = np.zeros(toxicity.A**3, np.float32)
        weight[toxicity.triples([toxicity.letters("grumbot")])[0] > 0] = 1
        assert toxicity.strongest(["x" * n + "grumbotgrumbot" + "x" * 400], weight)[0, 0] > 2


def test_letters_beyond_ascii_and_signs():
    assert toxicity.letters("É") == toxicity.letters("é") != toxicity.letters("ñ")
    assert toxicity.letters("gr\u200bum\u2019b\U0001f600ot") == toxicity.letters("grumbot")


def test_op4_scores_the_whole_table(spark, tmp_path):
    rows = [(k, t, y) for k, (t, y) in enumerate(toxic_sample(300, 5))]
    spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, "a grumbot", "x"), (3, rows[3][1], "x"), (900, None, "x"), (901, "", None)], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    # labels of the held-out fold are all wrong: they must not be learned
    fold = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    spark.createDataFrame([(k, 1, 1 - y if fold(k) else y) for k, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 304 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    truth = {k: y for k, _, y in rows} | {900: 0, 901: 0}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] is None if r["doc_id"] is None else r["held_out"] == fold(r["doc_id"])
    told = [r for r in got if r["doc_id"] is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in told]) >= 0.98


def test_op7_scores_the_whole_table(spark, tmp_path):
    rows = [(k, t, y) for k, (t, y) in enumerate(quality_sample(400, 5))]
    spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, "text", "x"), (3, rows[3][1], "x"), (900, None, None)], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    spark.createDataFrame([(k, 1 - y if fold(k) else y, 0) for k, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op7_quality(spark, str(tmp_path)).collect()
    assert len(got) == 403 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    truth = {k: y for k, _, y in rows}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == fold(r["doc_id"]) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_quality_scores_keep_rows_and_columns(spark):
    train = quality_sample(200, 1)
    model = quality.fit_additive(quality.feature_rows([t for t, _ in train]), np.array([y for _, y in train]), np.ones(200), rounds=20)
    df = spark.createDataFrame([(1, "a b", "en", "s", 3, "old", 1, "h", 2)] * 2 + [(None,) * 9, (2, "", "en", "s", 0, "old", 1, "h", 2)], SCHEMA)
    got = quality.score_quality(df, model)
    assert got.columns == [c for c in df.columns if c != "score"] + ["score"]
    scores = got.collect()
    assert len(scores) == 4 and len({r["score"] for r in scores if r["doc_id"] == 1}) == 1 and len({r["score"] for r in scores if r["doc_id"] != 1}) == 1
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_fits_without_classes_are_constant(spark):
    assert toxicity.fit_toxicity([]).score(["a", None]).tolist() == [0.5, 0.5]
    assert (toxicity.fit_toxicity([("clean text", 0)] * 30).score(["x"]) < 0.5).all()
    empty = quality.fit_additive(np.empty((0, len(quality.FEATURES))), np.empty(0, int), np.empty(0))
    assert empty.score(["a", None]).tolist() == [0.5, 0.5]


def quality_sample(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = prose(rng, rng.randint(10, 150))
        y = int(k % 3 > 0)
        if not y:
            kind = k % 4
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + rng.choice(["%%%", "###", "&&&"]) for x in w] if kind == 1 else w[:3] * 40 if kind == 2 else [*" | ".join(w).split()]
        out.append((" ".join(w), y))
    return out


def test_quality_on_held_out_texts():
    train, held = quality_sample(600, 1), quality_sample(300, 2)
    x, y = quality.feature_rows([t for t, _ in train]), np.array([y for _, y in train])
    model = quality.fit_additive(x, y, np.ones(len(y)))
    s = model.score([t for t, _ in held])
    assert np.mean((s >= 0.7) == np.array([y for _, y in held])) >= 0.98
    assert np.isfinite(model.score([None, "", "\n", "é" * 10, "w " * 500_000])).all()


def test_interactions_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0)).astype(int)
    model = quality.fit_additive(x, y, np.ones(len(y)), rounds=20)
    assert model.pairs[0][:2] == (3, 7)
    assert np.mean((model.margin(x) > 0) == y) > 0.9


def test_sample_is_bounded_and_leaves_out_the_fold(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)] + [(5, "text 5"), (None, "none"), (301, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(200)] + [(None, 1, 1), (301, 0, 0), (400, 1, 1)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got, totals = labelled_sample(docs, labels, "quality", held, 20)
    out = {t for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0 for t in [f"text {k}"]}
    assert 30 <= len(got) <= 40 and not out & {t for t, _ in got}
    assert all(int(t.split()[1]) % 2 == y for t, y in got if t)
    assert totals[1] >= 75
    assert labelled_sample(docs.limit(0), labels.limit(0), "toxic", held, 20) == ([], {0: 0, 1: 0})


def test_scores_keep_rows_and_columns(spark, model):
    df = spark.createDataFrame([(1, "a grumbot", "en", "s", 3, "old", 1, "h", 2), (1, "a grumbot", "en", "s", 3, "old", 1, "h", 2), (None, None, None, None, None, None, None, None, None)], SCHEMA)
    got = toxicity.score_toxicity(df, model)
    assert got.columns == [c for c in df.columns if c != "score"] + ["score"]
    assert sorted(r["score"] >= 0.5 for r in got.collect()) == [False, True, True]
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


ODD = ["", "  a  b ", " ", "\n\n x\ty", "日本語 テスト 😀é", "▁▁ a▁b", "a▁ b", "<s> x </s> <unk> <0x41>", "\x00 null", "ﬁ Å", "   lots   of    spaces     here", "Hello world. This is a test!", "x" * 5000, "word " * 3000]


def test_pieces_equal_the_library_and_decode_back():
    rng = random.Random(3)
    alphabet = "abc  de\nfé ßñ12.,😀日"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert sentencepiece_codec.parity(texts) == []
    codec = sentencepiece_codec.Codec.load()
    back = codec.decode(codec.encode(texts))
    assert all(a == b for a, b in zip(back, texts) if "▁" not in b)


def test_unigram_models_with_byte_fallback_are_rebuilt():
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)] + [("▁", -3.0, 1), ("▁ab", -1.5, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁a", -2.2, 1)]
    m = sentencepiece_codec.Model(pieces, sentencepiece_codec.UNIGRAM, True)
    t = sentencepiece_codec.build_tokenizer(m)
    ids = t.encode("  ab   é a ", add_special_tokens=False).ids
    assert [pieces[i][0] for i in ids] == ["▁ab", "▁", "<0xC3>", "<0xA9>", "▁a"]
    assert t.decode(ids) == "ab é a"


def test_model_file_is_parsed_like_the_library_does():
    import sentencepiece

    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        m = sentencepiece_codec.parse_model(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    assert [p for p, _, _ in m.pieces] == [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    assert np.allclose([s for _, s, _ in m.pieces], [sp.get_score(k) for k in range(sp.get_piece_size())])


def test_encoded_tables(spark):
    df = spark.createDataFrame([(k, t, "en", "s", 1, "x", 5, "h", 1) for k, t in enumerate([*ODD, None, ODD[1]])], SCHEMA)
    got = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(df))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(ODD) + 2 and rows[len(ODD)]["ids"] == [] and rows[0]["n_tokens"] == 0
    assert all(r["decoded"] == (r["text"] or "") for r in rows.values() if "▁" not in (r["text"] or ""))
    assert sentencepiece_codec.encode_texts(df.limit(0)).count() == 0
    codec = sentencepiece_codec.Codec.load()
    assert codec.decode([[1, 2], None, []]) == ["", "", ""] and codec.decode([[0]])[0].strip() == "⁇"


@pytest.mark.parametrize("ids", [[-1], [5, None], [10**6], [2**40]])
def test_ids_outside_the_model_raise(ids):
    with pytest.raises(ValueError, match="outside the model"):
        sentencepiece_codec.Codec.load().decode([[5], ids])


def test_ids_that_are_no_text_are_marked():
    codec = sentencepiece_codec.Codec.load()
    byte = {p: k for k, (p, _, _) in enumerate(codec.model.pieces)}
    got = codec.decode([[byte["<0xC3>"]], codec.encode(["plain"])[0]])
    assert "\ufffd" in got[0] and got[1] == "plain"


@pytest.mark.parametrize("remembered", [1, 50, 300_000])
def test_units_agree_with_the_library_whatever_is_remembered(remembered, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec.Codec, "REMEMBERED", remembered)
    codec = sentencepiece_codec.Codec.load(verify=True)
    theirs = codec.library.encode([t for t in ODD])
    rng = random.Random(4)
    for _ in range(3):
        texts = [*ODD, None, *(" ".join(prose(rng, 40)) + "\n\n " + " ".join(prose(rng, 5)) for _ in range(20))]
        found = codec.encode_column(pa.array(texts, pa.string()))
        assert found.agrees.all() and found.lists().to_pylist()[: len(ODD)] == theirs
    monkeypatch.setattr(codec, "sizes", None)  # units that can't be told apart are encoded one by one
    codec._forget()
    assert codec.encode(ODD) == theirs


def test_units_that_differ_from_the_library_are_told():
    codec = sentencepiece_codec.Codec.load(verify=True)

    class Other:
        def encode(self, texts, num_threads=1):
            return [x if "odd" not in t else x[:-1] for t, x in zip(texts, real.encode(texts))]

    real, codec.library = codec.library, Other()
    assert codec.encode_column(pa.array(["all is well", "an odd one", "", "well"])).agrees.tolist() == [True, False, True, True]


def test_op5_encodes_the_whole_table(spark, tmp_path):
    rng = random.Random(6)
    texts = [*ODD, None, *(" ".join(prose(rng, 50)) for _ in range(30)), ODD[1]]
    spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    import sentencepiece

    want = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL).encode([t or "" for t in texts])
    got = {r["doc_id"]: r for r in sentencepiece_codec.op5_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k]["ids"] == want[k] and got[k]["n_tokens"] == len(want[k]) and got[k]["parity"]
        assert got[k]["round_trip"] == ("▁" not in (t or ""))


URLS = [None, "", "no scheme", "http://A.NET/x", "https://example.net/en/1?q#f", "https://sub.Example.NET/en/", "https://example.net/de/", "http://example.com/de/9", "http://xexample.com/de/9", "http://example.com/en/", "http://www.a.org/fr/x", "http://org/fr/", "http://org/Fr/", "http://net", "http://net?x=/", "a://b.net/c://d.org/fr/", "http://e.net#/en/", "http://u@h.net:80/p", "http:///x", "HTTP://.net/en/\n/x"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host = raw.translate({k: k + 32 for k in range(65, 91)})
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("bound", [50_000, 0])
def test_urls_match_brute_force(spark, bound):
    df = spark.createDataFrame([(k, u, "old", 5) for k, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string, rule int")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("net", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules, rules_bound=bound).collect()}
    assert got == {k: brute_url(u) for k, u in enumerate([*URLS, URLS[4]])}
    none = url_filter.filter_urls(df, rules.limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(URLS) + 1
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for k, (t, y) in enumerate(toxic_sample(240, 5)):
        rows.append((k, t, "en", "ab"[k % 2], len(t)))
        labels.append((k, 1, y))
    line = "A line that very many of the documents here do share"
    for k in range(300, 310):
        t = " ".join(prose(rng, 80)) + "\n" + line
        rows.append((k, t, "en", "a", len(t)))
    copy = " ".join(prose(rng, 200))
    for k in range(400, 406):
        t = copy if k < 403 else copy + f" end{k}"
        rows.append((k, t, "en", None, len(t)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {k for k, _, y in labels if y}
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        kept.append(docs.collect())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    assert {r["doc_id"] for r in kept[0]} == {r[0] for r in rows} - toxic
    assert {r["doc_id"] for r in kept[1] if line in r["text"]} == {309} and len(kept[1]) == len(kept[0])
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1])
    assert {r["doc_id"] for r in kept[2]} == {r["doc_id"] for r in kept[1]} - set(range(401, 406))
    assert {r["doc_id"] for r in kept[3]} <= {r["doc_id"] for r in kept[2]} and len(kept[4]) == len(kept[3])
    codec = sentencepiece_codec.Codec.load()
    text = {r["doc_id"]: r["text"] for r in kept[3]}
    assert all(codec.decode([r["ids"]])[0] == text[r["doc_id"]] for r in kept[4])
