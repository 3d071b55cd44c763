"""Document quality by a factorisation machine.

Inputs are hashed words, hashed word shapes, structure statistics and length: x is sparse. The score is
sigmoid(w0 + w.x + sum over pairs i<j of <v_i, v_j> x_i x_j); the pair sum is found in time linear in the non-zeros as
half of the sum over factors f of (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import Texts, map_texts, mix
from refrain.llm.sampling import by_class, labelled_texts
from refrain.runtime import discard

#: Byte classes: 0 separator or control, 1 lower-case, 2 upper-case, 3 digit, 4 sentence mark, 5 other ASCII mark, 6 beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:33], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3, 6
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4
_STATS = 14


@dataclass(frozen=True)
class Settings:
    words: int = 1 << 14  # slots of hashed words
    shapes: int = 1 << 9  # slots of hashed word shapes
    factors: int = 8
    sample: int = 2500  # training documents of each label, at most about
    epochs: int = 8
    batch: int = 64
    rate: float = 0.08
    decay: float = 1e-4
    seed: int = 23

    @property
    def dims(self) -> int:
        return self.words + self.shapes + _STATS


def statistics(texts: Texts) -> np.ndarray:
    """Shares and log counts that describe a text's structure, one row each; an empty text's are all 0."""
    starts, ends, first = texts.words()
    n, data = len(texts), texts.data
    size = np.maximum(np.diff(texts.offsets), 1).astype(float)
    n_words = np.diff(first).astype(float)
    per_word = np.maximum(n_words, 1)
    of_byte = np.repeat(np.arange(n), np.diff(texts.offsets))
    cls = _CLASS[data]
    share = np.bincount(of_byte * 7 + cls, minlength=n * 7).reshape(n, 7) / size[:, None]
    lines = np.bincount(of_byte[data == 10], minlength=n)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (cls[1:] >= 4) & (cls[1:] < 6) & (of_byte[1:] == of_byte[:-1])
    lone = np.zeros(n)
    varied = np.zeros(n)
    shout = np.zeros(n)
    if len(starts):
        row = texts.row_of(first)
        lone = np.bincount(row, weights=(cls[starts] >= 4) & (cls[starts] < 6), minlength=n)
        shout = np.bincount(row, weights=(cls[starts] == 2) & (cls[np.minimum(starts + 1, ends - 1)] == 2), minlength=n)
        hashes = texts.word_hashes()
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        varied = np.bincount(r[new], minlength=n).astype(float)
    out = np.column_stack([share[:, 1:], np.bincount(of_byte[same], minlength=n) / size, lone / per_word, shout / per_word, varied / per_word, np.log1p(n_words) / 10, np.log1p(lines) / 5, size / per_word / 20, lines / per_word])
    out[n_words == 0] = 0
    return np.minimum(out, 4.0)


def encode(texts: Texts, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the non-zero inputs, ordered by row; word counts are scaled to length 1 in each row."""
    starts, ends, first = texts.words()
    n, cls = len(texts), _CLASS[texts.data].astype(np.uint64)
    row = texts.row_of(first)
    last, before = ends - 1, np.maximum(ends - 2, starts)
    if len(starts):
        shape = ((cls[starts] * np.uint64(7) + cls[np.minimum(starts + 1, last)]) * np.uint64(7) + cls[before]) * np.uint64(7) + cls[last]
        slots = np.concatenate([(texts.word_hashes() & np.uint64(s.words - 1)).astype(np.int64), s.words + (mix(shape, 5) & np.uint64(s.shapes - 1)).astype(np.int64)])
        keys, counts = np.unique(np.concatenate([row, row]) * s.dims + slots, return_counts=True)
        rows, slots = np.divmod(keys, s.dims)
        values = np.log1p(counts)
        kind = rows * 2 + (slots >= s.words)
        values = values / np.sqrt(np.bincount(kind, weights=values * values, minlength=2 * n))[kind]
    else:
        rows, slots, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    extra = statistics(texts)
    rows = np.concatenate([rows, np.repeat(np.arange(n), _STATS)])
    slots = np.concatenate([slots, np.tile(np.arange(_STATS) + s.words + s.shapes, n)])
    values = np.concatenate([values, extra.ravel()])
    order = np.argsort(rows, kind="stable")
    return rows[order], slots[order], values[order].astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    settings: Settings

    def score(self, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for each of n rows; every row has at least the statistics' slots."""
        first = np.searchsorted(rows, np.arange(n))
        vx = self.factors[slots] * values[:, None]
        sums, squares = np.add.reduceat(vx, first), np.add.reduceat(vx * vx, first)
        z = self.bias + np.add.reduceat(self.linear[slots] * values, first) + 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Fit by Adagrad on about ``settings.sample`` labelled documents of each label, encoded on executors.

    Labels other than 0 and 1 and null ids are left out; a repeated id is one document. Without both labels the score is the share of 1 (0.5 if there are no labels).
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    rows = labelled_texts(docs, by_class(marked, "y", ["k"], settings.sample, settings.seed), text, key)

    def work(batch, texts):
        r, slots, values = encode(texts, settings)
        at = np.searchsorted(r, np.arange(len(texts) + 1))
        packed = [pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(len(texts))], pa.binary()) for x in (slots.astype(np.int32), values)]
        return pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("y"), *packed], ["k", "y", "slots", "values"])

    got = sorted((r["k"], r["y"], bytes(r["slots"]), bytes(r["values"])) for r in map_texts(rows, "text", work, "k string, y int, slots binary, values binary").collect())
    discard(rows)
    y = np.array([r[1] for r in got], float)
    model = Model(0.0, np.zeros(settings.dims, np.float32), np.zeros((settings.dims, settings.factors), np.float32), settings)
    if len(set(y)) < 2:
        model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    rng = np.random.default_rng(settings.seed)
    model.factors = rng.normal(0, 0.02, model.factors.shape).astype(np.float32)
    slots = [np.frombuffer(r[2], np.int32) for r in got]
    values = [np.frombuffer(r[3], np.float32) for r in got]
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    seen_w, seen_v, seen_b = np.full(settings.dims, 1e-3, np.float32), np.full(model.factors.shape, 1e-3, np.float32), 1e-3
    for _ in range(settings.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), settings.batch):
            pick = order[lo : lo + settings.batch]
            r = np.repeat(np.arange(len(pick)), [len(slots[i]) for i in pick])
            s, x = np.concatenate([slots[i] for i in pick]), np.concatenate([values[i] for i in pick])
            g = ((model.score(r, s, x, len(pick)) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            first = np.searchsorted(r, np.arange(len(pick)))
            vx = model.factors[s] * x[:, None]
            sums = np.add.reduceat(vx, first)
            order_s = np.argsort(s, kind="stable")
            used, at = np.unique(s[order_s], return_index=True)
            gw = np.add.reduceat((g[r] * x)[order_s], at) + settings.decay * model.linear[used]
            gv = np.add.reduceat(((g[r] * x)[:, None] * (sums[r] - vx))[order_s], at) + settings.decay * model.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += float(g.sum()) ** 2
            model.linear[used] -= settings.rate * gw / np.sqrt(seen_w[used])
            model.factors[used] -= settings.rate * gv / np.sqrt(seen_v[used])
            model.bias -= settings.rate * float(g.sum()) / seen_b**0.5
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) for every row: the probability of label 1. Null texts count as empty, which have a score too.

    Repeated rows get equal scores; other columns are not read.
    """

    def work(batch, texts):
        return pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(model.score(*encode(texts, model.settings), len(texts)))], ["_key", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return map_texts(rows, "_text", work, f"_key {docs.schema[key].dataType.simpleString()}, score double").toDF(key, "score")
