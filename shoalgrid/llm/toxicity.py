"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Strings are compared by the letter triples they share *as subsequences*: the letters of a triple
may stand apart, up to ``REACH`` places, at a cost of ``DECAY`` for each letter between them. An
insult with a letter put in, doubled or spaced out still shares most of its triples with the plain
word. A word's start counts as a letter of its own. Characters other than letters are passed over, and
runs of single letters are read as one word, so that marks and spaces between letters do not hide a word either.

The machine is trained on labelled sentences by multiple-instance learning. Every sentence of a
clean text is negative. Of a toxic text the sentence that scores highest is positive, and the words in it
that score are what stands for it; the other sentences have no label. The first scores are log-odds
of words, later ones the fitted machine's margins, for some rounds. Nyström features ``K(x, Z) K(Z, Z)^-1/2``
over landmark strings ``Z`` of both kinds feed a linear squared-hinge machine. As the kernel is a
product of explicit triple counts, the fitted machine is the same function as one weight per triple, which is
what scoring adds up, vectorised over whole batches of text. A text's ``TOP`` strongest words, each
judged by its strongest window of letters (at most ``WINDOW``), make its probability, by a logistic
function fitted on labelled texts that the machine has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.shared import crc_mod, labelled_sample, release_memory, table

#: a to z, classes of letters beyond ASCII, and the start of a word.
BEYOND, START, A = 26, 31, 32
REACH, DECAY, WINDOW = 4, 0.7, 12
PATTERNS = [(i, k, DECAY ** (k - 2)) for k in range(2, REACH + 1) for i in range(1, k)]
#: Words of a text that count.
TOP = 3
#: Margins are not told apart below this.
LOW = -3.0
#: Texts are worked on in pieces of about PIECE bytes; only a run without a place to cut is longer, up to LONGEST.
PIECE, LONGEST, OVERLAP = 1 << 18, 1 << 22, 64
_SPACE, _SKIP = 254, 255
_CODE = np.full(256, _SKIP, np.uint8)
for _c in range(26):
    _CODE[65 + _c] = _CODE[97 + _c] = _c
_CODE[0xC0:0xF0] = BEYOND
_CODE[list(range(9, 14)) + [32]] = _SPACE


def _norms() -> np.ndarray:
    """Norm by letters of a string whose triples all differ; a function of length alone keeps the kernel positive definite."""
    out = np.ones(WINDOW + 1)
    for n in range(3, WINDOW + 1):
        out[n] = np.sqrt(sum(max(0, n - k) * w * w for _, k, w in PATTERNS))
    return out


NORM = _norms()


def _codes(raw: np.ndarray) -> np.ndarray:
    """Code of each byte: a letter's at its first byte, space, or passed over.

    Letters beyond ASCII fall into classes by their bytes, Latin capitals with their small ones; punctuation and
    signs beyond ASCII (U+2000 to U+2BFF) and characters of four bytes are passed over.
    """
    code = _CODE[raw]
    at = np.flatnonzero(code == BEYOND)
    if len(at):
        lead, second = raw[at].astype(np.int64), raw[np.minimum(at + 1, len(raw) - 1)].astype(np.int64)
        second = np.where(lead == 0xC3, second | 0x20, second)
        third = np.where(lead >= 0xE0, raw[np.minimum(at + 2, len(raw) - 1)], 0)
        code[at] = np.where((lead == 0xE2) & (second < 0xB0), _SKIP, BEYOND + (lead * 31 + second * 7 + third) % (START - BEYOND))
    return code


def _letters(raw: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all words, each after its start, the words' first places, and the words' texts; single-letter words in a row are one word."""
    code = _codes(raw)
    word = np.cumsum(code == _SPACE, dtype=np.int32)
    keep = np.flatnonzero(code < _SPACE)
    code, word, text = code[keep].astype(np.int32), word[keep], text_of[keep]
    if not len(code):
        return code, word, text[:0]
    starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])])
    size = np.diff(np.r_[starts, len(code)])
    owner = text[starts]
    joins = np.r_[False, (size[1:] == 1) & (size[:-1] == 1) & (owner[1:] == owner[:-1])]
    first = starts[~joins]
    out = np.full(len(code) + len(first), START, np.int32)
    at = np.ones(len(code), np.int32)
    at[first] = 2
    out[np.cumsum(at) - 1] = code
    return out, first + np.arange(len(first)), owner[~joins]


def _windows(code: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Normalised weight sum of the strongest window of each word."""
    n = len(code)
    ends = np.append(starts[1:], n)
    size = ends - starts
    end = np.repeat(ends, size)
    here = np.arange(n)
    part = np.zeros(n)
    for i, k, w in PATTERNS:
        if n <= k:
            continue
        at = code[:-k] * (A * A) + code[i : n - k + i] * A + code[k:]
        part[: n - k] += np.where(here[: n - k] + k < end[: n - k], weight[at] * w, 0)
    run = np.r_[0, np.cumsum(part)]
    stop = np.minimum(here + WINDOW, end)
    value = (run[stop] - run[here]) / NORM[np.minimum(np.repeat(size, size), WINDOW)]
    value[(here + WINDOW > end) & (here != np.repeat(starts, size))] = -np.inf
    return np.maximum.reduceat(value, starts)


_CUT = re.compile(rb"[A-Za-z]{2}[ \t\r\n]")


def _pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Bytes of texts joined by line ends, about ``PIECE`` at a time, with each byte's text.

    A long text is cut after a word that ends in two letters, where no word and no run of single letters
    is open; only if there is none for ``LONGEST`` bytes it is cut anywhere, with an overlap longer than a window.
    """
    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        while b:
            cut = back = len(b)
            if cut > PIECE:
                if found := _CUT.search(b, PIECE, LONGEST):
                    cut = back = found.end()
                elif cut > LONGEST:
                    cut = LONGEST
                    back = cut - OVERLAP
                    while 0x80 <= b[back] < 0xC0:
                        back -= 1
            held.append(b[:cut] + b"\n")
            owner.append(i)
            size += cut + 1
            b = b[back:]
            if size >= PIECE:
                yield b"".join(held), np.repeat(np.array(owner, np.int32), [len(x) for x in held])
                held, owner, size = [], [], 0
    if held:
        yield b"".join(held), np.repeat(np.array(owner, np.int32), [len(x) for x in held])


def _best(value: np.ndarray, owner: np.ndarray, n: int, top: int = TOP) -> np.ndarray:
    """The ``top`` largest values of each of ``n`` owners, largest first; -inf where there are fewer."""
    out = np.full((n, top), -np.inf)
    order = np.lexsort((-value, owner))
    value, owner = value[order], owner[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
    keep = place < top
    out[owner[keep], place[keep]] = value[keep]
    return out


def strongest(texts: list[str | None], weight: np.ndarray) -> np.ndarray:
    """The largest normalised weight sums of the words of each text, ``TOP`` of them; -inf where there are fewer words."""
    out = np.full((len(texts), TOP), -np.inf)
    for raw, text_of in _pieces(texts):
        code, starts, owner = _letters(np.frombuffer(raw, np.uint8), text_of)
        if len(code):
            low = int(owner[0])
            here = slice(low, int(owner[-1]) + 1)
            found = _best(_windows(code, starts, weight), owner - low, int(owner[-1]) + 1 - low)
            out[here] = -np.sort(-np.hstack([out[here], found]), axis=1)[:, :TOP]
    return out


def _sparse(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, triple and normalised weight of every triple in the first window of each string of letter codes."""
    code = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    size = np.array([len(x) for x in strings])
    row = np.repeat(np.arange(len(strings)), size)
    inside = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    rows, ats, weights = [], [], []
    for i, k, w in PATTERNS:
        m = max(0, len(code) - k)
        ok = np.flatnonzero((row[:m] == row[k : k + m]) & (inside[:m] < WINDOW))
        rows.append(row[ok])
        ats.append(code[ok] * (A * A) + code[ok + i] * A + code[ok + k])
        weights.append(w / NORM[np.minimum(size[row[ok]], WINDOW)])
    return np.concatenate(rows), np.concatenate(ats), np.concatenate(weights)


def triples(strings: list[bytes]) -> np.ndarray:
    """The explicit feature map of the first window of each string of letter codes, one dense row each."""
    row, at, w = _sparse(strings)
    out = np.zeros((len(strings), A**3), np.float32)
    np.add.at(out, (row, at), w)
    return out


def kernel(strings: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of strings of letter codes against the dense landmark rows."""
    turned, out = np.ascontiguousarray(landmarks.T), []
    for k in range(0, len(strings), 128):
        part = strings[k : k + 128]
        row, at, w = _sparse(part)
        order = np.argsort(row, kind="stable")
        row, values = row[order], turned[at[order]] * w[order, None].astype(np.float32)
        got = np.zeros((len(part), len(landmarks)), np.float32)
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            got[row[starts]] = np.add.reduceat(values, starts, axis=0)
        out.append(got)
    return np.vstack(out).astype(float) if out else np.empty((0, len(landmarks)))


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of strings one after the other, and where each starts."""
    size = np.array([len(x) for x in strings], int)
    return np.frombuffer(b"".join(strings), np.uint8).astype(np.int32), np.cumsum(size) - size


def letters(word: str) -> bytes:
    """Letter codes of a string read as one word, from its start."""
    code = _codes(np.frombuffer(word.encode(), np.uint8))
    return bytes([START]) + code[code < _SPACE].tobytes()


@dataclass
class ToxicityModel:
    """Weights of the triples, and the logistic function of a text's strongest margins."""

    weight: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        return np.maximum(strongest(texts, self.weight) + self.bias, LOW)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) @ self.slopes + self.offset, -30, 30)))


_SENTENCE = re.compile(r"[.!?]+\s|\n")


@dataclass
class Sentences:
    """The distinct words of labelled sentences, and which sentence holds which; sentences are in the order of their texts."""

    words: list[bytes]
    code: np.ndarray
    starts: np.ndarray
    #: One entry for each different word of a sentence, ordered by sentence.
    word: np.ndarray
    sentence: np.ndarray
    #: The text of each sentence, and the label of each text.
    text: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, sample: list[tuple[str, int]]) -> Sentences:
        # texts are read in runs, so that only words and their places are held, not all letters at once
        seen: dict[bytes, int] = {}
        text, held = [], [np.empty(0, np.int64)]
        for at in range(0, len(sample), 256):
            parts = []
            for k in range(at, min(at + 256, len(sample))):
                own = [x for x in _SENTENCE.split(sample[k][0]) if x.strip()]
                text += [k] * len(own)
                parts += own
            first = len(text) - len(parts)
            for raw, owner in _pieces(parts):
                code, starts, of = _letters(np.frombuffer(raw, np.uint8), owner)
                edge = np.append(starts, len(code)).astype(np.int32)
                cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(code.astype(np.uint8))]).dictionary_encode()
                place = np.array([seen.setdefault(w, len(seen)) for w in cut.dictionary.to_pylist()], np.int64)
                held.append(np.unique((of + np.int64(first)) << 32 | place[cut.indices.to_numpy()]) if len(starts) else held[0])
        pairs = np.unique(np.concatenate(held))
        words = list(seen)
        return cls(words, *_joined(words), (pairs & 0xFFFFFFFF).astype(np.int32), (pairs >> 32).astype(np.int32), np.array(text, np.int32), np.array([y for _, y in sample], int))

    def values(self, weight: np.ndarray) -> np.ndarray:
        """The strongest window of each word, worked out for some words at a time."""
        out, bounds = [], np.append(self.starts, len(self.code))
        for k in range(0, len(self.words), 1 << 15):
            first, last = bounds[k], bounds[min(k + (1 << 15), len(self.words))]
            out.append(_windows(self.code[first:last], self.starts[k : k + (1 << 15)] - first, weight))
        return np.concatenate(out)

    def texts_with(self, label: int) -> np.ndarray:
        """The number of texts of a label that hold each word."""
        texts = self.text[self.sentence]
        pairs = np.unique(texts[self.label[texts] == label].astype(np.int64) << 32 | self.word[self.label[texts] == label])
        return np.bincount(pairs & 0xFFFFFFFF, minlength=len(self.words))

    def witnesses(self, value: np.ndarray, least: float) -> np.ndarray:
        """How often each word stands for a positive sentence, by words' values.

        A toxic text's positive sentence is the one with the largest value (of these, the first); the largest word of it
        stands for it, and the next ones, up to ``TOP``, if they have at least ``least``. Words of value -inf stand for nothing.
        """
        of = self.text[self.sentence]
        pos = np.flatnonzero((self.label[of] == 1) & np.isfinite(value[self.word]))
        order = pos[np.lexsort((self.word[pos], self.sentence[pos], -value[self.word[pos]], of[pos]))]
        lead = order[np.unique(of[order], return_index=True)[1]]
        inside = pos[np.isin(self.sentence[pos], self.sentence[lead])]
        inside = inside[np.lexsort((self.word[inside], -value[self.word[inside]], self.sentence[inside]))]
        place = np.arange(len(inside)) - np.searchsorted(self.sentence[inside], self.sentence[inside], "left")
        taken = inside[(place == 0) | ((place < TOP) & (value[self.word[inside]] >= least))]
        return np.bincount(self.word[taken], minlength=len(self.words))


def _altered(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one or two letters put in."""
    for _ in range(1 + int(rng.integers(2)) * (len(word) > 6)):
        at = int(rng.integers(2, len(word))) if len(word) > 2 else len(word)
        word = word[:at] + bytes([int(rng.integers(26))]) + word[at:]
    return word


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge machine by active-set Newton steps; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < 1
        xa = x[on] * weight[on, None]
        new = np.linalg.solve(x[on].T @ xa + reg, xa.T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none below zero, and offset of a logistic function of the columns of ``margin``."""
    on = np.ones(margin.shape[1], bool)
    while True:
        x = np.column_stack([margin[:, on], np.ones(len(margin))])
        w, reg = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
        reg[-1, -1] = 1e-3
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + reg, x.T @ (weight * (p - y)) + reg @ w)
            w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            slopes = np.zeros(margin.shape[1])
            slopes[on] = w[:-1]
            return slopes, float(w[-1])
        on[np.flatnonzero(on)[w[:-1] < 0]] = False


#: Altered copies of each word that stands for a toxic sentence; of every CALIBRATE labelled texts, one is kept for the probabilities.
ALTERED, CALIBRATE = 3, 4
#: Weight of clean texts with one altered word put in, as a share of the toxic texts', when probabilities are fitted.
ALONE = 0.1
RIDGE = 0.1
#: A word stands for a sentence only if toxic texts hold it so many times as often as clean ones.
RATE = 5


def fit_toxicity(sample: list[tuple[str, int]], totals: dict[int, int] | None = None, landmarks: int = 256, rounds: int = 4, negatives: int = 4000, seed: int = 11) -> ToxicityModel:
    """Fit on texts with 0/1 labels; without both classes, or without a word in one of them, the score is a constant."""
    labels = np.array([y for _, y in sample], int)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    totals = totals or {0: n0, 1: n1}
    # one of CALIBRATE of each class, unless there are too few
    apart = np.zeros(len(sample), bool)
    for y in (0, 1):
        of = np.flatnonzero(labels == y)
        apart[of[:: CALIBRATE] if len(of) >= 4 * CALIBRATE else of[:0]] = True
    told = Sentences.of([x for x, a in zip(sample, apart) if not a])
    in_pos, in_neg = (told.texts_with(y) if told.words else np.empty(0, int) for y in (1, 0))
    k1, k0 = (told.label == 1).sum(), (told.label == 0).sum()
    if not in_pos.sum() or not in_neg.sum() or not (in_pos * k0 >= RATE * in_neg * k1)[in_pos > 0].any():
        rate = (totals[1] + 1) / (totals[0] + totals[1] + 2)
        return ToxicityModel(np.zeros(A**3, np.float32), 0.0, np.zeros(TOP), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    value, least = np.log((in_pos + 0.5) / (k1 + 1)) - np.log((in_neg + 0.5) / (k0 + 1)), np.log(20)
    # clean sentences are negative, so a word that they hold about as often, or that may be in toxic ones by chance, can't be what makes a sentence toxic
    may = (in_pos * k0 >= RATE * in_neg * k1) & (in_pos > 0)
    beyond_chance = 2 * in_pos * np.log(np.maximum(in_pos, 1) / np.maximum(in_pos + in_neg, 1) * (k1 + k0) / k1) * may
    may &= beyond_chance >= min(2 * np.log(len(told.words)), beyond_chance.max() / 2)
    clean = np.flatnonzero((in_neg > 0) & ~may)
    usual = clean[np.argsort(-in_neg[clean], kind="stable")]
    hard = np.unique(np.r_[usual[: negatives // 2], rng.permutation(usual[negatives // 2 :])[: negatives // 2]])
    for _ in range(rounds):
        seen = told.witnesses(np.where(may, value, -np.inf), least)
        pos, neg = np.flatnonzero(seen), hard
        # landmarks: the words that stand for most sentences, and the clean words that come nearest to them
        firsts = pos[np.argsort(-seen[pos], kind="stable")][: landmarks // 2]
        near = neg[np.argsort(-value[neg], kind="stable")][: landmarks // 4]
        z_words = [told.words[k] for k in np.unique(np.r_[firsts, near, neg[: landmarks - len(firsts) - len(near)]])]
        z = triples(z_words)
        own, vector = np.linalg.eigh((z @ z.T).astype(float))
        keep = own > 1e-6 * own.max()
        root = vector[:, keep] / np.sqrt(own[keep])
        given = [told.words[k] for k in pos]
        changed = [_altered(w, rng) for w in given for _ in range(ALTERED)]
        x = np.vstack([kernel(given, z), kernel(changed, z), kernel([told.words[k] for k in neg], z)]) @ root
        # the last row: what shares nothing with any landmark is clean
        x = np.column_stack([np.vstack([x, np.zeros(x.shape[1])]), np.ones(len(x) + 1)])
        y = np.r_[np.ones(len(given) + len(changed)), -np.ones(len(neg) + 1)]
        w1, w0 = in_pos[pos].astype(float), np.sqrt(in_neg[neg])
        share = np.r_[w1 / (2 * w1.sum()), np.repeat(w1, ALTERED) / (2 * ALTERED * w1.sum()), w0 / max(1e-9, w0.sum()), 0.5] * len(neg)
        w = _machine(x, y, share, RIDGE)
        weight, bias = (root @ w[:-1]).astype(np.float32) @ z, float(w[-1])
        value, least = told.values(weight) + bias, 0.0
        hard = np.unique(np.r_[hard, clean[np.argsort(-value[clean], kind="stable")[:500]]])
    model = ToxicityModel(weight, bias, np.ones(TOP), 0.0)
    kept = np.flatnonzero(apart) if apart.any() else np.arange(len(sample))
    y = labels[kept]
    by_class = np.array([totals[k] / max(1, (y == k).sum()) for k in (0, 1)])
    margins, share = model.margins([sample[k][0] for k in kept]), by_class[y] * len(y) / max(1, sum(totals.values()))
    # a clean text with one altered word in it is toxic as well
    alone = np.maximum(_windows(*_joined(changed), weight) + bias, LOW)
    host = margins[rng.choice(np.flatnonzero(y == 0), len(alone))] if (y == 0).any() else np.full((len(alone), TOP), LOW)
    alone = -np.sort(-np.column_stack([alone, host]), axis=1)[:, :TOP]
    extra = w1.repeat(ALTERED) / (w1.sum() * ALTERED) * ALONE * share[y == 1].sum()
    model.slopes, model.offset = _logistic(np.vstack([margins, alone]), np.r_[y, np.ones(len(alone), int)], np.r_[share, extra])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` added (a column of that name is replaced): one pass, whole texts, no shuffle.

    Null, empty and letterless texts get the score of the lowest margin. Every row is kept.
    """
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, "score"])
        release_memory()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, score double")


#: The fit reads at most this many labelled texts of each class, whole.
FIT_PER_CLASS = 3000


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """The model of the labelled rows of ``docs`` outside the held-out fold (crc32 of the id modulo 5 is 0): a bounded sample, see ``labelled_sample``."""
    held = crc_mod("doc_id", 5) == 0
    model = fit_toxicity(*labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", held, FIT_PER_CLASS))
    release_memory()
    return model


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; a null doc_id is in no fold (``held_out`` null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
