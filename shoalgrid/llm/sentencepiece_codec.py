"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is read as protobuf wire format, without the sentencepiece library: pieces with
scores and types, the model type, and the normaliser's settings. From these a tokenizer is
rebuilt that gives the same ids: the character map and white-space rules of the normaliser, the
metaspace marker, the piece scores (as a unigram lattice, or as merge ranks for a BPE model) and
byte fallback. Batches are encoded by the library's threads; ``parity`` compares with the
sentencepiece library itself.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from shoalgrid.llm.shared import release_memory, table

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Place of the model; a parameter of every function here.
DEFAULT_MODEL = os.environ.get("SHOALGRID_SP_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@dataclass
class Model:
    """What the file says; field numbers and defaults are those of the public format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_space: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    def special(self, kind: int) -> list[int]:
        return [i for i, p in enumerate(self.pieces) if p[2] == kind]


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one message in wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        match tag & 7:
            case 0:
                yield tag >> 3, varint()
            case 1:
                yield tag >> 3, raw[at : at + 8]
                at += 8
            case 2:
                n = varint()
                yield tag >> 3, raw[at : at + n]
                at += n
            case 5:
                yield tag >> 3, raw[at : at + 4]
                at += 4
            case other:
                raise ValueError(f"wire type {other}")


def parse_model(raw: bytes) -> Model:
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 24:
                    m.suffix_space = bool(v)
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.dummy_prefix = bool(v)
                elif k == 4:
                    m.squeeze = bool(v)
                elif k == 5:
                    m.escape = bool(v)
    return m


def merge_ranks(m: Model) -> list[tuple[str, str]]:
    """Merges of a BPE model in the order of its scores: all ways to cut a piece into two pieces.

    Among the cuts of one piece the order is free: they make the same piece, so the leftmost pair wins.
    """
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for p, s, kind in m.pieces:
        if kind == NORMAL:
            found += [(-s, rank[p], rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    found.sort(key=lambda x: x[:4])
    return [x[4:] for x in found]


def build_tokenizer(m: Model) -> Tokenizer:
    """The tokenizers-library form of a parsed model."""
    if m.suffix_space or not m.escape or m.special(USER):
        raise ValueError("suffix markers, unescaped white space and user-defined pieces are not supported")
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind}")
    unk = m.special(UNKNOWN)
    if m.kind == UNIGRAM:
        low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0)
        never = low - 1e6
        backend = models.Unigram([(p, s if k in (NORMAL, UNKNOWN) else never) for p, s, k in m.pieces], unk_id=unk[0] if unk else None, byte_fallback=m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        backend = models.BPE(vocab, merge_ranks(m), unk_token=m.pieces[unk[0]][0] if unk else None, fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(backend)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if m.dummy_prefix else []
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k == NORMAL):
        # no piece reaches from a letter over a marker: words can be encoded by themselves, and be cached
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return t


@dataclass
class Encoded:
    """Ids of several texts, one after the other: those of text ``k`` are ``ids[ends[k]:ends[k + 1]]``."""

    ids: np.ndarray
    ends: np.ndarray
    #: For each text, whether the sentencepiece library gives the same ids; all true where it was not asked.
    agrees: np.ndarray

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.ends.astype(np.int32)), pa.array(self.ids))


class Codec:
    """Encode and decode columns of texts with one model, given as the bytes of its file.

    Where no piece reaches over a word's start, texts are cut into units: a run of spaces with the word
    after it, or a line end. Units of a batch are counted by Arrow, each distinct one is encoded once and
    remembered, and a text's ids are taken from theirs, array by array. ``verify`` has every distinct
    unit (or whole text, where units don't hold) encoded by the sentencepiece library as well.
    """

    #: Units, and bytes of units, that are remembered; beyond it the memory starts anew.
    REMEMBERED, REMEMBERED_BYTES = 300_000, 16 << 20
    #: Units that are handed to the library as one text.
    JOINED = 256

    def __init__(self, raw: bytes, verify: bool = False):
        m = self.model = parse_model(raw)
        self.tokenizer = build_tokenizer(m)
        self.by_unit = m.dummy_prefix and not m.charsmap and not m.squeeze and self.tokenizer.pre_tokenizer is not None
        control, unknown, byte = (set(m.special(k)) for k in (CONTROL, UNKNOWN, BYTE))
        self.lines_apart = len(byte) == 256 and not any("\n" in p for p, _, _ in m.pieces)
        # the same pieces for units, which carry their markers already; spaces stand between them
        self.units = Tokenizer(self.tokenizer.model)
        self.units.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.sizes = np.array([1 if i in byte else len(p.encode()) for i, (p, _, _) in enumerate(m.pieces)]) if len(byte) == 256 else None
        self.pieces = pa.array([b"" if i in control else b" \xe2\x81\x87 " if i in unknown else bytes([int(p[3:5], 16)]) if i in byte else p.replace(MARK, " ").encode() for i, (p, _, _) in enumerate(m.pieces)], pa.binary())
        self.library = _library(raw) if verify else None
        self._forget()

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL, verify: bool = False) -> Codec:
        with open(path, "rb") as f:
            return cls(f.read(), verify)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.start, self.length, self.same = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        return self.encode_column(pa.array(texts, pa.string())).lists().to_pylist()

    def encode_column(self, column: pa.Array) -> Encoded:
        """Ids of a column of strings; texts that hold the marker itself, and models without units, are encoded whole."""
        texts = column.fill_null("")
        filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        whole = filled & (pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) if self.by_unit else True)
        split = filled & ~whole
        count, agrees, ids = np.zeros(len(texts), np.int64), np.ones(len(texts), bool), np.empty(0, np.int32)
        if split.any():
            ids, count[split], agrees[split] = self._by_units(texts.filter(pa.array(split)))
        if whole.any():
            at = np.flatnonzero(whole)
            given = [texts[int(k)].as_py() for k in at]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]
            if self.library:
                agrees[at] = [a == b for a, b in zip(found, self.library.encode(given, num_threads=1))]
            ends = np.r_[0, np.cumsum(count)]
            of_whole = dict(zip(at.tolist(), found))
            ids = np.concatenate([np.asarray(of_whole[k], np.int32) if k in of_whole else ids[ends[k] : ends[k + 1]] for k in range(len(texts))])
            count[at] = [len(x) for x in found]
        return Encoded(ids, np.r_[0, np.cumsum(count)], agrees)

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of not empty texts without markers, the number of each text's ids, and whether its units agree."""
        marked = pc.binary_join_element_wise("", texts, " ")  # a text counts as after a space
        _, edges, data = marked.buffers()
        edge = np.frombuffer(edges, np.int32)[marked.offset : marked.offset + len(marked) + 1]
        raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]]
        edge = edge - edge[0]
        space = raw == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        if self.lines_apart:
            line = raw == 10
            first |= line
            first[1:] |= line[:-1]
        first[edge[:-1]] = True
        at = np.flatnonzero(first)
        bounds = np.append(at, len(raw)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        unit = self._places(cut.dictionary.to_pylist())[cut.indices.to_numpy()]
        size = self.length[unit]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[unit] - ends + size, size) + np.arange(ends[-1])]
        head = np.searchsorted(at, edge[:-1])
        before = (ends - size)[head]
        agrees = np.logical_and.reduceat(self.same[unit], head)
        return ids, np.diff(np.append(before, ends[-1])), agrees

    def _places(self, units: list[bytes]) -> np.ndarray:
        """Where each unit's ids are remembered; those not known are encoded."""
        new = [u for u in units if u not in self.known]
        if self.known and (len(self.known) + len(new) > self.REMEMBERED or self.held > self.REMEMBERED_BYTES):
            self._forget()
            new = units
        if new:
            ids, size = self._encoded(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.held += sum(map(len, new))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.length, self.ids = np.append(self.length, size), np.append(self.ids, ids)
            self.same = np.append(self.same, self._verified(new, ids, size) if self.library else np.ones(len(new), bool))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def _encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        texts = [u.decode().replace(" ", MARK) for u in units]
        if self.sizes is not None:  # every piece tells how many bytes it stands for, so units can be joined and told apart again
            found = self.units.encode_batch_fast([" ".join(texts[k : k + self.JOINED]) for k in range(0, len(texts), self.JOINED)], add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(e.ids for e in found)), np.int32)
            reached = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(u) + 2 * u.count(b" ") for u in units])
            last = np.searchsorted(reached, wanted)
            if reached[-1] == wanted[-1] and (reached[last] == wanted).all():
                return ids, np.diff(last + 1, prepend=0)
        found = [e.ids for e in self.units.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.int32), np.array(list(map(len, found)))

    def _verified(self, units: list[bytes], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each unit, whether the sentencepiece library gives these ids.

        The library puts a marker before a text by itself, and gives an empty one no ids, so a unit that
        doesn't start with a space, or is nothing else, stands after a line end, whose ids are left out.
        """
        bare = [len(u) > 1 and u[:1] == b" " for u in units]
        theirs = self.library.encode([(u[1:] if b else b"\n" + u).decode() for u, b in zip(units, bare)], num_threads=1)
        theirs = [x if b else x[2:] for x, b in zip(theirs, bare)]
        ends = np.cumsum(size)
        n = np.array(list(map(len, theirs)))
        if (n == size).all():
            wrong = np.array(list(chain.from_iterable(theirs)), np.int32) != ids
            return ~np.isin(np.arange(len(units)), np.searchsorted(ends, np.flatnonzero(wrong), "right"))
        return np.array([x == ids[e - s : e].tolist() for x, e, s in zip(theirs, ends, size)])

    def decode(self, ids: list[list[int] | None]) -> list[str]:
        """Texts of id lists; see ``decode_column``."""
        return self.decode_column(pa.array(ids, pa.list_(pa.int64()))).to_pylist()

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """Texts of a column of id lists: pieces and fallback bytes put together, markers as spaces, the first space taken off.

        Control pieces are passed over and unknown ones read `` ⁇ ``, as the format has it. Null lists
        give empty texts; null ids and ids that the model doesn't have raise a ValueError. Lists
        whose bytes are no UTF-8 are decoded by the library, which marks what is broken.
        """
        size = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        flat = ids.flatten()
        if flat.null_count or (len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(self.pieces)):
            raise ValueError("ids outside the model")
        edge, stream = np.zeros(len(size) + 1, np.int64), np.empty(0, np.uint8)
        if len(flat):
            _, reached, data = self.pieces.take(flat).buffers()
            edge = np.frombuffer(reached, np.int32)[np.r_[0, np.cumsum(size)]].astype(np.int64)
            stream = np.frombuffer(data, np.uint8)[: edge[-1]]
        if self.model.dummy_prefix and len(stream):
            begins = np.flatnonzero(edge[1:] > edge[:-1])
            spaced = begins[stream[edge[begins]] == 32]
            keep = np.ones(len(stream), bool)
            keep[edge[spaced]] = False
            edge = edge - np.searchsorted(spaced, np.arange(len(edge)), "left")
            stream = stream[keep]
        raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(stream)])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            out = []
            for text, x in zip(raw.to_pylist(), ids.to_pylist()):
                try:
                    out.append(text.decode())
                except UnicodeDecodeError:
                    out.append(self.tokenizer.decode(x, skip_special_tokens=False))
            return pa.array(out, pa.string())


def _library(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


@lru_cache(maxsize=2)
def worker_codec(raw: bytes, verify: bool) -> Codec:
    """A worker's codec: what it remembers serves all tasks that the worker runs."""
    return Codec(raw, verify)


def parity(texts: list[str], path: str = DEFAULT_MODEL) -> list[int]:
    """Indices of texts for which ids, or the text decoded from them, differ from the sentencepiece library's."""
    import sentencepiece

    ours, theirs = Codec.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = ours.encode(texts)
    want = theirs.encode(texts)
    back = ours.decode(ids)
    return [k for k, t in enumerate(texts) if ids[k] != want[k] or back[k] != theirs.decode(want[k])]


#: Rows are worked on in slices of about so many bytes, or ids; a longer row is a slice by itself.
SLICE_BYTES, SLICE_IDS = 2 << 20, 1 << 20


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes sum to about ``most``."""
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _lengths(column: pa.Array) -> np.ndarray:
    lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    return lengths.fill_null(0).to_numpy(zero_copy_only=False)


def encode_texts(docs: DataFrame, path: str = DEFAULT_MODEL, text: str = "text", round_trip: str | None = None, parity: str | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``n_tokens long`` added (replacing such columns), and the text kept.

    One pass without a shuffle; whole texts. Null and empty texts have no ids; repeated rows are all
    kept; an empty table gives an empty result. ``round_trip`` names a further column: whether decoding
    the ids gives the text (null: empty) back; a text that holds the marker itself never comes back. ``parity`` names
    another: whether the sentencepiece library encodes the text's units to the same ids. The
    model's bytes are read where the job starts and travel with it, so executors need no such file.
    """
    docs = docs.drop("ids", "n_tokens", *(c for c in (round_trip, parity) if c))

    def work(codec: Codec, column: pa.Array) -> list[pa.Array]:
        found = codec.encode_column(column)
        lists = found.lists()
        out = [lists]
        if round_trip:
            out.append(pc.equal(codec.decode_column(lists), column.fill_null("")))
        return [*out, *([pa.array(found.agrees)] if parity else [])]

    added = {"ids": "array<int>"} | {c: "boolean" for c in (round_trip, parity) if c}
    return _mapped(docs, path, text, work, SLICE_BYTES, added, bool(parity)).withColumn("n_tokens", F.size("ids").cast("long"))


def decode_ids(rows: DataFrame, path: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded string`` added; null lists decode to an empty text. Null ids and ids outside the model raise an error."""
    return _mapped(rows.drop("decoded"), path, ids, lambda codec, column: [codec.decode_column(column)], SLICE_IDS, {"decoded": "string"}, False)


def _mapped(df: DataFrame, path: str, column: str, work: Callable[[Codec, pa.Array], list[pa.Array]], most: int, added: dict[str, str], verify: bool) -> DataFrame:
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        codec = worker_codec(sent.value, verify)
        for b in batches:
            values = b.column(b.schema.get_field_index(column))
            for at, to in _slices(_lengths(values), most):
                yield pa.RecordBatch.from_arrays([*b.slice(at, to - at).columns, *work(codec, values.slice(at, to - at))], [*names, *added])
        release_memory()

    types = ", ".join(f"`{n}` {k}" for n, k in [*df.dtypes, *added.items()])
    return df.mapInArrow(run, types)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, whether decoding them gives the text back, and whether the sentencepiece library agrees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, round_trip="round_trip", parity="parity").select("doc_id", "n_tokens", "ids", "round_trip", "parity")
