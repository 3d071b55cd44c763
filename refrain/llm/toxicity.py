"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: word beginnings and whole words that stand out in toxic training documents. Features are
lexicon densities, lexicon hits near second-person words, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import _BYTES, Texts, as_long, map_texts, window_hashes
from refrain.llm.sampling import by_class, labelled_texts
from refrain.runtime import discard

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split()
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
#: Characters often put for letters.
_LEET = _PLAIN.copy()
for _from, _to in zip("0134578@$!", "oieastbasi", strict=True):
    _LEET[ord(_from)] = ord(_to)
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    sample: int = 4000  # training documents of each label, at most about
    lexicon: int = 4096  # learned entries, at most
    least: tuple[int, ...] = (2, 3, 5, 8)  # toxic training documents that must hold an entry; the calibration fold says which
    odds: float = 2.5  # least log odds ratio of an entry
    near: int = 4  # words between a hit and a second-person word
    trees: int = 50
    depth: int = 3
    bins: int = 32
    rate: float = 0.2
    seed: int = 31


def _parts(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words without marks at either end, under a byte table: starts, ends, first word of each row, hashes by prefix length and whole."""
    starts, ends, first = texts.words()
    data = table[texts.data]
    mark = _MARK[texts.data]
    for _ in range(3):
        starts = starts + (mark[np.minimum(starts, len(mark) - 1)] & (ends - starts > 1)) if len(starts) else starts
        ends = ends - (mark[np.maximum(ends - 1, 0)] & (ends - starts > 1)) if len(ends) else ends
    values = data.astype(np.uint64) + np.uint64(1)
    hashes = [window_hashes(values, starts, np.minimum(starts + k, ends), _BYTES) for k in _PREFIXES]
    return starts, ends, first, np.stack([*hashes, window_hashes(values, starts, ends, _BYTES)]) if len(starts) else np.zeros((len(_PREFIXES) + 1, 0), np.uint64)


def _hash_words(words: list[str]) -> np.ndarray:
    found = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
        found.append(window_hashes(b, np.array([0]), np.array([len(b)]), _BYTES)[0])
    return np.sort(np.array(found, np.uint64))


class Lexicon:
    """Weights by hash, looked up through a bit table that turns most words away."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.shape, np.float32)
        if len(self.keys):
            maybe = np.nonzero(self.gate[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == hashes[maybe], self.weights[at], 0)
        return out


_YOU = Lexicon(_hash_words(SECOND_PERSON), np.ones(len(SECOND_PERSON), np.float32))
N_FEATURES = 17


def features(texts: Texts, lexicon: Lexicon, near: int) -> np.ndarray:
    """Dense features of each row; an empty text's are all 0."""
    n, data = len(texts), texts.data
    starts, ends, first, hashes = _parts(texts, _PLAIN)
    size, count = np.diff(texts.offsets).astype(float), np.diff(first).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)
    of_byte = np.repeat(np.arange(n), np.diff(texts.offsets))
    total = lambda values: np.bincount(of_byte, weights=values, minlength=n) / per_byte
    upper, mark, digit = (data >= 65) & (data <= 90), _MARK[data], (data >= 48) & (data <= 57)
    twice = np.zeros(len(data), bool)
    twice[1:] = mark[1:] & (data[1:] == data[:-1])
    out = [total(upper), total(mark), total(digit), total(data == 33), total(data == 63), total(twice)]
    row = texts.row_of(first)
    by_row = lambda values: np.bincount(row, weights=values, minlength=n)
    if len(starts):
        weight = lexicon.weigh(hashes)
        begins, whole = weight[:-1].max(0), weight[-1]
        strongest = np.maximum(begins, whole)
        hit = strongest > 0
        disguised = np.zeros(len(starts), bool)
        inner = np.cumsum(np.concatenate([[0], mark | digit]))
        letters = np.cumsum(np.concatenate([[0], (data >= 128) | upper | ((data >= 97) & (data <= 122))]))
        mixed = (inner[ends] > inner[starts]) & (letters[ends] > letters[starts])
        disguised = mixed & (lexicon.weigh(_parts(texts, _LEET)[3]).max(0) > 0) & ~hit if mixed.any() else disguised
        you = np.cumsum(np.concatenate([[0], _YOU.weigh(hashes[-1])]))
        at = np.arange(len(starts))
        close = you[np.minimum(at + near + 1, first[row + 1])] - you[np.maximum(at - near, first[row])] > 0
        most = np.zeros(n)
        np.maximum.at(most, row[hit], strongest[hit])
        hits = by_row(hit)
        out += [hits / per_word, by_row(whole > 0) / per_word, by_row(strongest) / per_word, np.log1p(hits), most, by_row(hit & close) / per_word, by_row(you[1:] - you[:-1]) / per_word, by_row(disguised) / per_word, by_row(mixed) / per_word, by_row(ends - starts) / per_word / 10, np.log1p(count)]
    else:
        out += [np.zeros(n)] * 11
    out = np.column_stack(out)
    out[count == 0] = 0
    return out


def _grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree for gradients g and curvatures h: split feature, threshold, leaf value; and each row's leaf value."""
    features_, cuts = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    node = np.zeros(len(x), np.int64)
    for level in range(depth):
        width = 1 << level
        best = np.full(width, 1e-6)
        split = [(0, bins)] * width
        for f in range(x.shape[1]):
            slot = node * bins + binned[:, f]
            gs = np.bincount(slot, weights=g, minlength=width * bins).reshape(width, bins).cumsum(1)
            hs = np.bincount(slot, weights=h, minlength=width * bins).reshape(width, bins).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            at = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(width), at] > best):
                best[k], split[k] = gain[k, at[k]], (f, at[k])
        for k in range(width):
            f, at = split[k]
            if at < len(edges[f]):
                features_[width - 1 + k], cuts[width - 1 + k] = f, edges[f][at]
        own = width - 1 + node
        node = node * 2 + (x[np.arange(len(x)), features_[own]] > cuts[own])
    leaves = -np.bincount(node, weights=g, minlength=1 << depth) / (np.bincount(node, weights=h, minlength=1 << depth) + 1)
    return features_, cuts, leaves, leaves[node]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing fit of y on x, as points to interpolate between."""
    at, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, weights=w)
    mean = np.bincount(inverse, weights=w * y) / weight
    blocks: list[list[float]] = []
    for i in range(len(at)):
        blocks.append([mean[i], weight[i], at[i], at[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclass
class Model:
    lexicon: Lexicon
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    points: tuple[np.ndarray, np.ndarray]
    settings: Settings

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        every = np.arange(len(x))
        for features_, cuts, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.settings.depth):
                node = 2 * node + 1 + (x[every, features_[node]] > cuts[node])
            z += self.settings.rate * leaves[node - (1 << self.settings.depth) + 1]
        return z

    def score(self, texts: Texts) -> np.ndarray:
        return np.clip(np.interp(self.raw(features(texts, self.lexicon, self.settings.near)), *self.points), 0, 1)


def _boost(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, s: Settings) -> Model:
    """Trees for the rows x with labels y, not calibrated."""
    model = Model(lexicon, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [], (np.array([0.0]), np.array([0.0])), s)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, s.bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), model.base)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-z))
        *tree, step = _grow(x, edges, binned, p - y, p * (1 - p), s.depth, s.bins)
        model.trees.append(tuple(tree))
        z += s.rate * step
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Learn from about ``settings.sample`` labelled documents of each label, in three hashed folds: lexicon, trees, calibration.

    The sample is written once. Word statistics are gathered on executors and only entries that pass the thresholds reach
    the driver. Of the lexicons for each of ``settings.least`` the one whose trees lose least on the calibration fold is
    kept. Labels other than 0 and 1 and null ids are left out; a repeated id is one document. Without both labels every
    score is the share of 1 (0 without labels).
    """
    s = settings
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    counts = dict(marked.groupBy("y").count().collect())
    nothing = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    if len(counts) < 2:
        return Model(nothing, 0.0, [], (np.array([0.0]), np.array([float(1 in counts)])), s)
    fold = F.pmod(F.xxhash64(F.lit(s.seed + 1), "k"), F.lit(3)).alias("fold")
    rows = labelled_texts(docs, by_class(marked, "y", ["k"], s.sample, s.seed).select("k", "y", fold), text, key)

    def entries(batch, texts):
        *_, first, hashes = _parts(texts, _PLAIN)
        row = np.tile(texts.row_of(first), len(hashes))
        pairs = np.unique(np.stack([row.astype(np.uint64), hashes.ravel()]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
        y = batch.column("y").to_numpy()[pairs[0].astype(np.int64)]
        return pa.RecordBatch.from_arrays([as_long(pairs[1]), pa.array(y)], ["h", "y"])

    found = dict(rows.where("fold = 0").groupBy("y").count().collect())
    toxic, clean = found.get(1, 0), found.get(0, 0)
    seen = map_texts(rows.where("fold = 0"), "text", entries, "h long, y int").groupBy("h").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    words = seen.where(F.col("t") >= min(s.least)).withColumn("odds", odds).where(F.col("odds") >= s.odds).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "h").limit(s.lexicon).collect()
    lexicons = []
    for least in s.least:
        own = [r for r in words if r["t"] >= least]
        lexicons.append(Lexicon(np.array([r["h"] for r in own], np.int64).view(np.uint64), np.array([r["odds"] for r in own], np.float32)))

    def dense(batch, texts):
        x = np.concatenate([features(texts, lexicon, s.near) for lexicon in lexicons], axis=1)
        return pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("y"), batch.column("fold").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["k", "y", "fold", "x"])

    got = sorted((r["k"], r["y"], r["fold"], tuple(r["x"])) for r in map_texts(rows.where("fold > 0"), "text", dense, "k string, y int, fold long, x array<double>").collect())
    discard(rows)
    y, folds = np.array([r[1] for r in got], float), np.array([r[2] for r in got])
    if not len(y):
        return Model(nothing, 0.0, [], (np.array([0.0]), np.array([0.0])), s)
    x = np.array([r[3] for r in got]).reshape(len(y), len(lexicons), N_FEATURES)
    weight = np.where(y == 1, *(counts[v] / max(1, min(counts[v], s.sample)) for v in (1, 0)))
    fit = folds == 1 if len({*y[folds == 1]}) == 2 and len({*y[folds == 2]}) == 2 else np.ones(len(y), bool)
    use = ~fit if (~fit).any() else fit
    best = None
    for i, lexicon in enumerate(lexicons):
        model = _boost(x[fit, i], y[fit], lexicon, s)
        z = model.raw(x[use, i])
        loss = float((np.logaddexp(0, np.where(y[use] == 1, -z, z)) * weight[use]).sum())
        if best is None or loss < best[0]:
            best = loss, model, z
    _, model, z = best
    model.points = isotonic(z, y[use], weight[use])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and score, the calibrated probability of toxicity, for every row.

    Null texts count as empty; an empty text has all features 0 and the score that these give. Repeated rows get equal
    scores. A column of ``docs`` called score may be kept only under another name.
    """

    def work(batch, texts):
        return pa.RecordBatch.from_arrays([*(batch.column(f"_{i}") for i in range(len(keep))), pa.array(model.score(texts))], [*(f"_{i}" for i in range(len(keep))), "score"])

    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    schema = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep)) + "score double"
    return map_texts(rows, "_text", work, schema).toDF(*keep, "score")


def reject(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``; null texts score as empty ones."""
    return map_texts(docs, text, lambda batch, texts: batch.filter(pa.array(model.score(texts) < threshold)), docs.schema)
