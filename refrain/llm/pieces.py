"""SentencePiece encoding by a Viterbi search that words with a common beginning share, and exact decoding.

A text is cut into marked words: runs of spaces with what follows up to the next space. No piece of the vocabulary
crosses such a border, so words are searched on their own, each different one once a batch. They are sorted, which puts
them in the depth-first order of their trie: going from one word to the next, the forward scores of the letters they
begin with stay as they are and only the rest is searched. Scores are the vocabulary's own.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.llm.arrowtext import map_texts

#: Fixed values of the model format: piece types, the mark for a space, and what an unknown letter costs below the worst piece.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
MARK, PENALTY = "▁", 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Different words whose pieces a worker remembers between batches, and letters up to which a word is remembered.
REMEMBERED, LETTERS = 150_000, 64


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    suffixes: dict = field(default_factory=dict)  # trie of reversed pieces; under "" the piece's (id, score)
    words: re.Pattern | None = None

    def __post_init__(self):
        normal = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        least, most = min(normal), max(normal)
        self.unknown_score = least - PENALTY
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.spelled, breaks = [], set("\n\t\r")
        for i, (piece, score, kind) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)):
            text = piece.replace(MARK, " ")
            self.spelled.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else text.encode() if kind in (NORMAL, USER) else b"")
            if kind not in (NORMAL, USER) or not text:
                continue
            if " " in text.lstrip(" "):
                raise ValueError(f"piece {i} crosses a word border")
            if len(text) > 1:
                breaks -= set(text)
            node = self.suffixes
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[""] = (i, len(text) * most - 0.1 if kind == USER else score)
        stop = "".join(re.escape(c) for c in sorted(breaks))
        self.words = re.compile(rf" +[^ {stop}]*|[^ {stop}]+|[{stop}]" if stop else r" +[^ ]*|[^ ]+")
        if len(self.bytes) < 256 and self.bytes:
            raise ValueError("byte pieces are not complete")

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The best pieces of each of the words, as int32 ids; words must be different."""
        out: dict[str, bytes] = {}
        best, back = [0.0], [(0, -1)]  # by letters read: score, and start and id of the last piece
        before = ""
        suffixes, unknown = self.suffixes, self.unknown_score
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, top, last = suffixes, None, None
                start = end
                single = False
                while start:
                    node = node.get(word[start - 1])
                    if node is None:
                        break
                    start -= 1
                    found = node.get("")
                    if found is not None:
                        if start == end - 1:
                            single = True
                        score = best[start] + found[1]
                        if top is None or score >= top:  # of equals the longest piece
                            top, last = score, (start, found[0])
                if not single:
                    score = best[end - 1] + unknown
                    if top is None or score > top:
                        top, last = score, (end - 1, -1)
                best.append(top)
                back.append(last)
            ids: list[int] = []
            at = len(word)
            while at:
                start, piece = back[at]
                if piece >= 0:
                    ids.append(piece)
                elif self.bytes:
                    ids += [self.bytes[b] for b in reversed(word[start:at].encode())]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
                at = start
            out[word] = struct.pack(f"={len(ids)}i", *reversed(ids))
            before = word
        return out

    def encode(self, texts: list[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """Ids of each text as int32 bytes. An empty text has none. ``known`` remembers words from call to call, long ones excepted."""
        known = {} if known is None else known
        if len(known) > REMEMBERED:
            known.clear()
        cut = [self.words.findall(" " + t if self.dummy_prefix else t) if t else [] for t in texts]
        found = self.segment(list(set().union(*cut).difference(known)))
        known.update(found)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in found:
            if len(word) > LETTERS:
                del known[word]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: the exact inverse of ``encode`` with byte pieces."""
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def read_model(data: bytes) -> Vocabulary:
    """Parse a .model file. Only identity normalisation that keeps white space gives exact round trips; others are refused."""
    pieces, scores, types, dummy, plain = [], [], [], True, True
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got[1].decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            types.append(got.get(3, NORMAL))
        elif number == 3:
            got = dict(_fields(value))
            dummy = bool(got.get(3, 1))
            plain = not got.get(2) and not got.get(4, 1)
    if not plain:
        raise ValueError("the model's normaliser changes texts")
    return Vocabulary(pieces, scores, types, dummy)


@lru_cache(maxsize=2)
def _parsed(model: bytes) -> Vocabulary:
    return read_model(model)


def load(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read by the driver and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with ids (array of int) of ``text`` in column ``to``: null for null texts, empty for empty ones.

    All other columns pass through, unless one is called ``to``, which is replaced. Repeated rows get equal ids.
    """
    rows = docs.drop(to)
    names = rows.columns

    def work(batch, texts):
        ids = _parsed(model).encode([t or "" for t in batch.column(names.index(text)).to_pylist()], _known(model))
        valid = batch.column(names.index(text)).is_valid().to_pylist()
        column = pa.array([np.frombuffer(x, np.int32) if v else None for x, v in zip(ids, valid, strict=True)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, column], [*names, to])

    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])
    return map_texts(rows, text, work, schema)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids`` in column ``to`` (replaced if there): null for null ids."""
    kept = rows.drop(to)
    names = kept.columns

    def run(batches):
        for batch in batches:
            texts = [None if x is None else _parsed(model).decode(np.asarray(x, np.int32).tobytes()) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, to])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(to, T.StringType())]))


@lru_cache(maxsize=2)
def _known(model: bytes) -> dict[str, bytes]:
    return {}


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, round_trip) for every row: ids are hashed as little-endian int32, null texts as empty."""
    import hashlib

    def work(batch, texts):
        vocabulary = _parsed(model)
        given = [t or "" for t in batch.column("t").to_pylist()]
        ids = vocabulary.encode(given, _known(model))
        same = [vocabulary.decode(x) == t for x, t in zip(ids, given, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(same)], ["k", "n_tokens", "ids_sha256", "round_trip"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = map_texts(rows, "t", work, f"k {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, round_trip boolean", size=2 << 20)
    return out.toDF(key, "n_tokens", "ids_sha256", "round_trip")
