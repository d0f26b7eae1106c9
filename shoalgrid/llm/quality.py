"""Quality: a generalised additive model with pairwise interactions.

Shallow trees, boosted in a cycle over the features, grow one lookup table for each feature;
then the pairs whose joint tables promise the largest gain get two-dimensional tables the same
way. A score is the sum of table entries at the text's bins, which is a few vectorised look-ups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.shared import crc_mod, labelled_sample, table

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = [ord(c) for c in "#$%&*@^~_=+<>{}[]\\/`"]
FEATURES = [
    "log_chars", "log_words", "upper", "digits", "bang", "bar", "marks", "stops", "commas", "questions", "quotes", "beyond_ascii", "entropy",
    "word_chars", "longest_word", "distinct", "top_word", "top_five", "repeats_next", "bigrams", "capitals", "shouted", "one_letter", "odd_ends",
    "lines_per_word", "distinct_lines", "short_lines", "open_lines",
]


def features(text: str | None) -> list[float]:
    """Counts and shares over the whole text, in the order of ``FEATURES``; an empty text gives zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, letters = hist[_UPPER].sum(), hist[_UPPER].sum() + hist[_LOWER].sum()
    share = hist[hist > 0] / len(raw)
    counts = Counter(words)
    most = [c for _, c in counts.most_common(5)]
    sizes = list(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    plain = sum(c for e, c in ends.items() if 97 <= e <= 122 or 65 <= e <= 90 or e >= 128 or e in b".,;:?")
    return [
        np.log1p(len(raw)), np.log1p(n), upper / max(1, letters), hist[_DIGIT].sum() / len(raw), hist[33] / n, hist[124] / n, hist[_MARKS].sum() / n,
        hist[46] / n, hist[44] / n, hist[63] / n, (hist[34] + hist[39]) / n, hist[128:].sum() / len(raw), float(-(share * np.log2(share)).sum()),
        sum(sizes) / n, np.log1p(max(sizes)), len(counts) / n**0.8, most[0] / n, sum(most) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), sum(w[:1].isupper() for w in words) / n,
        sum(w.isupper() for w in words) / n, sizes.count(1) / n, 1 - plain / n,
        len(lines) / n, len(set(lines)) / max(1, len(lines)), sum(len(x.split(None, 3)) < 4 for x in lines) / max(1, len(lines)), sum(x.rstrip()[-1] not in b".!?" for x in lines) / max(1, len(lines)),
    ]


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Cut points and a table for each feature; coarse cut points and a table for each pair."""

    offset: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.offset)
        for k, (c, t) in enumerate(zip(self.cuts, self.tables)):
            out += t[np.searchsorted(c, x[:, k], side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(feature_rows(texts)), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree with so many leaves over the bins' summed gradients and curvatures."""
    edges = [0, len(g)]
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gl, hl, gr, hr = G[at] - G[a], H[at] - H[a], G[b] - G[at], H[b] - H[at]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
            gain[(hl <= 0) | (hr <= 0)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(at[k]))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut of one axis with a cut of the other on each side: values per cell, and the gain."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            value, gain = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[part].sum(axis=0), hh[part].sum(axis=0)
                v = _tree(gs, hs, ridge, 2)
                value[part] = v[None, :]
                gain += float((gs * v).sum())
            if gain > best:
                best, out = gain, (value.T if turned else value)
    return out, best


def fit_additive(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 5.0) -> AdditiveModel:
    """Fit to 0/1 targets with row weights (scaled to mean 1); a single class gives a constant score."""
    weight = weight * len(weight) / max(1e-12, weight.sum()) if len(weight) else weight
    n1, n = float(weight[y == 1].sum()) if len(y) else 0.0, float(weight.sum()) if len(y) else 0.0
    base = (n1 + 0.5) / (n + 1)
    model = AdditiveModel(float(np.log(base / (1 - base))), [], [], [], [])
    if not len(y) or y.min() == y.max():
        return model
    quantiles = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T]
    model.cuts, model.coarse = quantiles(bins), quantiles(coarse)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    f = np.full(len(y), model.offset)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            if len(t) > 1:
                g, h = slopes()
                step = rate * _tree(np.bincount(at[k], g, len(t)), np.bincount(at[k], h, len(t)), ridge)
                t += step
                f += step[at[k]]
    for k, t in enumerate(model.tables):  # tables are centred, so that the offset is the mean margin
        mean = float((weight * t[at[k]]).sum() / weight.sum())
        t -= mean
        model.offset += mean
    wide = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.coarse)]
    size = [len(c) + 1 for c in model.coarse]

    def joint(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * size[j] + wide[j], v, size[i] * size[j]).reshape(size[i], size[j])

    g, h = slopes()
    gains = []
    for i in range(len(size)):
        for j in range(i + 1, len(size)):
            a, b = joint(i, j, g), joint(i, j, h)
            gains.append((float((a**2 / (b + ridge)).sum() - max((a.sum(0) ** 2 / (b.sum(0) + ridge)).sum(), (a.sum(1) ** 2 / (b.sum(1) + ridge)).sum())), i, j))
    for gain, i, j in sorted(gains, reverse=True)[:n_pairs]:
        if gain > 0:
            model.pairs.append((i, j, np.zeros((size[i], size[j]))))
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * _pair_tree(joint(i, j, g), joint(i, j, h), ridge)[0]
            t += step
            f += step[wide[i], wide[j]]
    return model


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs`` with ``score`` added (a column of that name is replaced): one pass, whole texts, no shuffle.

    Null and empty texts, and texts of white space, have features of zero and are scored by them.
    """
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, score double")


#: The fit reads at most this many labelled texts of each class, whole.
FIT_PER_CLASS = 4000


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> AdditiveModel:
    """The model of the labelled rows of ``docs`` outside the held-out fold (crc32 of the id modulo 4 is 2): a bounded sample, see ``labelled_sample``."""
    held = crc_mod("doc_id", 4) == 2
    sample, totals = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", held, FIT_PER_CLASS)
    y = np.array([y for _, y in sample], int)
    taken = np.bincount(y, minlength=2)
    by_class = np.array([totals[k] / max(1, taken[k]) for k in (0, 1)])
    return fit_additive(feature_rows([t for t, _ in sample]), y, by_class[y])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; a null doc_id is in no fold (``held_out`` null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
