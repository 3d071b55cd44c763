"""Language identification with error-correcting output codes.

Every language gets a binary codeword. One linear classifier per bit, over hashed byte n-grams, says how strongly a
text takes that bit's value; a text gets the language whose codeword loses least, each bit weighted by how well its
classifier does on training rows kept aside. Closeness of the two best codewords is reported as ambiguity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import SEPARATOR, Texts, map_texts
from refrain.llm.sampling import by_class

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class Settings:
    dims: int = 1 << 13  # hashed n-gram features
    sample: int = 400  # training documents of each language, at most about
    most: int = 6000  # training documents of all languages, at most about
    rounds: int = 200
    rate: float = 0.5
    decay: float = 1e-5
    ambiguous: float = 0.1  # a text is ambiguous if its two best languages' probabilities are closer than this
    seed: int = 11


def codewords(n: int, seed: int) -> np.ndarray:
    """A +1/-1 codeword for each of n classes: all splits of up to 6 classes, else 10*log2(n) balanced random bits.

    Random columns never hold one value only and codewords are pairwise different.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        return np.array([[1 if c == 0 else 1 - 2 * (s >> (c - 1) & 1) for s in range(1, 1 << (n - 1))] for c in range(n)])
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(30):
        code = np.array([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(bits)]).T
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


def features(texts: Texts, dims: int) -> np.ndarray:
    """For each row, square roots of shares of hashed 1-, 2- and 3-byte runs of its letters, ASCII lower-cased, of length 1.

    Separators, ASCII digits and punctuation all count as one space.
    """
    n, folded = len(texts), _FOLD[texts.data]
    plain = SEPARATOR[folded] | ((folded < 128) & ~((folded >= 97) & (folded <= 122)))
    folded = np.where(plain, np.uint8(32), folded).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(texts.offsets))
    out = np.zeros(n * dims, np.float32)
    code = np.zeros(len(folded), np.int64)
    for k in (1, 2, 3):
        size = len(folded) - k + 1
        if size <= 0:
            break
        code = code[:size] * 257 + folded[k - 1 :] + 1
        inside = row[:size] == row[k - 1 :]
        slot = ((code * 0x9E3779B1 + k * 0x85EBCA6B) & 0xFFFFFFFF) * 0x27D4EB2F >> 15 & (dims - 1)
        out += np.bincount((row[:size] * dims + slot)[inside], minlength=n * dims).astype(np.float32)
    out = out.reshape(n, dims)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit
    sharp: float
    settings: Settings

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its probability, and whether the runner-up is close."""
        if self.code.shape[1] == 0:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margins = x @ self.weights + self.bias
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-self.sharp * (losses - losses.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, axis=1)
        return losses.argmin(1), p.max(1), order[:, -1] - order[:, -2] < self.settings.ambiguous


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learn from rows with a language and a text: about ``settings.sample`` of each language, features made on executors.

    Languages are counted over all rows; with many of them each gets an equal part of ``settings.most``. Repeated rows
    are one, and rows without an id are told apart by their text. The driver holds at most about ``settings.most`` rows
    of ``settings.dims`` floats.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("key")).where("lang is not null and text is not null and text <> ''")
    s, known = settings, rows.select("lang").distinct().count()
    sample = by_class(rows, "lang", ["key", "text"], max(1, min(s.sample, s.most // max(1, known))), s.seed)
    dims = s.dims

    def featurise(batch, texts):
        x = features(texts, dims)
        slots = [np.flatnonzero(v) for v in x]
        packed = [pa.array([u.astype(np.int32).tobytes() for u in slots], pa.binary()), pa.array([v[u].tobytes() for u, v in zip(slots, x, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), *packed], ["lang", "key", "slots", "values"])

    got = sorted((r["lang"], r["key"] or "", bytes(r["slots"]), bytes(r["values"])) for r in map_texts(sample, "text", featurise, "lang string, key string, slots binary, values binary").collect())
    languages = sorted({r[0] for r in got})
    code = codewords(len(languages), settings.seed).astype(np.float32)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((dims, 0), np.float32), np.zeros(0, np.float32), np.zeros(0), 1.0, settings)
    x = np.zeros((len(got), dims), np.float32)
    for row, (*_, slots, values) in zip(x, got, strict=True):
        row[np.frombuffer(slots, np.int32)] = np.frombuffer(values, np.float32)
    which = np.searchsorted(languages, [r[0] for r in got])
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 10 * len(languages) else np.zeros(len(x), bool)
    y, use = code[which], ~aside
    balance = (1 / np.bincount(which[use], minlength=len(languages)).clip(1))[which[use]].astype(np.float32)
    w, b = np.zeros((dims, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    seen = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(settings.rounds):  # logistic loss, full batches, per-weight rates
        m = x[use] @ w + b
        g = -(y[use] / (1 + np.exp(np.clip(m * y[use], -30, 30)))) * balance[:, None] / len(languages)
        for at, grad, acc in ((w, x[use].T @ g + settings.decay * w, seen[0]), (b, g.sum(0), seen[1])):
            acc += grad * grad
            at -= settings.rate * grad / np.sqrt(acc)
    check = aside if aside.any() else use
    right = ((x[check] @ w + b) * y[check] > 0).mean(0)
    trust = np.log(np.clip(right, 0.01, 0.995) / (1 - np.clip(right, 0.01, 0.995))).clip(0.01)
    return Model(languages, code, w, b, trust / trust.sum(), 4.0, settings)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred, score (probability, 0 to 1) and ambiguous for every row.

    Null, empty and letterless texts get 'und', score 0, not ambiguous; so does every text if no language was learned.
    Repeated rows each get the same answer; other columns, whatever their names, are not read.
    """
    names = np.array([*model.languages, "und"], object)

    def work(batch, texts):
        column = batch.column("_text")
        letters = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool) & bool(model.languages)
        best, p, close = model.predict(features(texts, model.settings.dims)) if model.languages else (np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool))
        out = [batch.column(f"_{i}") for i in range(len(keep))]
        out += [pa.array(names[np.where(letters, best, -1)]), pa.array(np.where(letters, np.clip(p, 0, 1), 0.0)), pa.array(close & letters)]
        return pa.RecordBatch.from_arrays(out, [*(f"_{i}" for i in range(len(keep))), "lang_pred", "score", "ambiguous"])

    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    schema = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", lang_pred string, score double, ambiguous boolean"
    return map_texts(rows, "_text", work, schema).toDF(*keep, "lang_pred", "score", "ambiguous")
