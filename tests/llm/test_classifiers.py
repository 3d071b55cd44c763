"""Language, quality and toxicity: held-out accuracy on small made-up texts, and odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.llm import language, quality, toxicity
from refrain.llm.arrowtext import texts_of
from refrain.llm.sampling import by_class, held_out, labelled_texts
from tests.llm.conftest import documents, prose

import pyarrow as pa

STEMS = {"en": ("the", "ing", "re", "wh", "ou"), "de": ("sch", "ung", "ein", "ü", "ß"), "fr": ("eau", "ç", "que", "é", "oi")}


def texts(*values):
    return texts_of(pa.array(list(values)))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30, STEMS[lang]), lang, "s") for i, lang in enumerate(rng.choices(list(STEMS), k=300))]
    return documents(spark, rows).cache()


def test_codewords():
    for n in (0, 1, 2, 3, 6, 7, 30):
        code = language.codewords(n, 1)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == (n if n != 1 else 1)
        if n > 1:
            assert (np.abs(code.sum(0)) < n).all()


def test_language(spoken, odd, none):
    model = language.train(spoken.where(~held_out()))
    out = language.identify(spoken, model).join(spoken.select("doc_id", "lang"), "doc_id")
    right, n = out.where(held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right > 0.97 and n > 50
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (30, 31, 32, 34):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["ambiguous"]) == ("und", 0.0, False)
    assert by_id[33]["lang_pred"] in STEMS
    assert language.identify(none, model).count() == 0


def test_language_without_training_rows(odd, none):
    assert {r["lang_pred"] for r in language.identify(odd, language.train(none)).collect()} == {"und"}
    one = language.train(odd.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in language.identify(odd, one).collect()} == {"und", "fr"}


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 123456789)] + [(None,)], "doc_id long")
    for r in rows.select("doc_id", held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).withColumn("id", F.col("id").cast("string"))
    got = dict(by_class(rows, "y", ["id"], 500, 1).groupBy("y").count().collect())
    assert all(350 < n < 650 for n in got.values()) and len(got) == 2


def test_sample_is_bounded_where_ids_repeat_or_are_null(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"), F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = dict(by_class(rows, "lang", ["doc_id", "text"], 300, 1).groupBy("lang").count().collect())
    assert all(220 < n < 380 for n in got.values()) and len(got) == 2
    assert by_class(rows.withColumn("text", F.lit("same")), "lang", ["doc_id", "text"], 30_000, 1).count() == 2
    one = spark.range(5000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("words "), "id").alias("text"))
    assert labelled_texts(one, spark.createDataFrame([(7, 1)], "k long, y int"), "text", "doc_id").count() == 1
    model = language.train(rows)
    assert model.languages == ["a", "b"]


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(360):
        text, kind = prose(rng, rng.randint(30, 80)), i % 3
        words = text.split()
        if kind == 1:
            text = " | ".join(words).upper() + "!!"
        if kind == 2:
            for _ in range(8):
                words.insert(rng.randint(0, len(words)), rng.choice(["gorkan", "gorkish", "GORKE", "plumfug"]))
            text = " ".join(words)
        rows.append((i, text, "en", "s"))
        marks.append((i, int(kind != 1), int(kind == 2)))
    return documents(spark, rows).cache(), spark.createDataFrame([*marks, (None, 1, 1), (9999, 0, 1), (1, None, None), (2, 7, 7)], "doc_id long, quality int, toxic int")


def test_quality(marked, odd, none):
    docs, labels = marked
    model = quality.train(docs, labels.where(~held_out()))
    out = quality.score(docs, model).join(labels.where("quality in (0, 1)"), "doc_id").where(held_out())
    right = out.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (30, 31)}) == 1
    assert quality.score(none, model).count() == 0
    only = quality.train(docs, labels.where("quality = 1"))
    assert all(r["score"] > 0.5 for r in quality.score(odd, only).collect())
    assert quality.score(odd, quality.train(docs, labels.limit(0))).first()["score"] == 0.5


def test_pair_sum_identity():
    rng = np.random.default_rng(0)
    s = quality.Settings()
    model = quality.Model(0.1, rng.normal(size=s.dims).astype(np.float32), rng.normal(size=(s.dims, s.factors)).astype(np.float32) / 4, s)
    rows, slots, values = quality.encode(texts("a b a c", ""), s)
    for i, z in enumerate(model.score(rows, slots, values, 2)):
        at, x = slots[rows == i], values[rows == i].astype(float)
        pairs = sum(float(model.factors[at[a]].astype(float) @ model.factors[at[b]].astype(float)) * x[a] * x[b] for a in range(len(at)) for b in range(a))
        want = 1 / (1 + np.exp(-(0.1 + float(model.linear[at].astype(float) @ x) + pairs)))
        assert abs(z - want) < 1e-4


def test_toxicity(marked, odd, none):
    docs, labels = marked
    model = toxicity.train(docs, labels.where(~held_out()))
    out = toxicity.score(docs, model).join(labels.where("toxic in (0, 1)"), "doc_id").where(held_out()).withColumn("p", (F.col("score") >= 0.7).cast("int"))
    found, false = out.agg(F.avg(F.when(F.col("toxic") == 1, F.col("p"))), F.avg(F.when(F.col("toxic") == 0, F.col("p")))).first()
    assert found > 0.9 and false < 0.03
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] < 0.7 for r in got)
    assert toxicity.score(none, model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def plain_trees(model, x):
    """Each row through each tree, one step at a time."""
    out = []
    for row in x:
        z = model.base
        for split, cuts, leaves in model.trees:
            at = 0
            while at < len(split):
                at = 2 * at + (2 if row[split[at]] > cuts[at] else 1)
            z += model.settings.rate * leaves[at - len(split)]
        out.append(z)
    return out


def test_trees_against_brute_force():
    """The first split is the best of all thresholds, boosting lowers the loss, and scoring equals a walk down each tree."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    s = toxicity.Settings(trees=12)
    model = toxicity._boost(x, y, toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.float32)), s)
    assert np.allclose(model.raw(x), plain_trees(model, x))
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(300, p * (1 - p))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gain = {(f, c): part(x[:, f] <= c) + part(x[:, f] > c) for f in range(4) for c in range(11)}
    (f, c), _ = max(gain.items(), key=lambda kv: kv[1])
    split, cuts, _ = model.trees[0]
    assert split[0] == f and part(x[:, f] <= cuts[0]) + part(x[:, f] > cuts[0]) >= 0.999 * gain[f, c]
    loss = lambda z: np.logaddexp(0, np.where(y == 1, -z, z)).mean()
    assert loss(model.raw(x)) < 0.6 * loss(np.full(300, model.base))


def test_isotonic_against_brute_force():
    """The fit is the least-squares one among all non-decreasing step functions."""
    from itertools import product

    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        y, w = rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
        at, fit = toxicity.isotonic(np.arange(n, dtype=float), y, w)
        got = np.interp(np.arange(n), at, fit)
        best = min(
            sum((w[b] * (y[b] - np.average(y[b], weights=w[b])) ** 2).sum() for b in blocks)
            for cuts in product((0, 1), repeat=n - 1)
            for blocks in [np.split(np.arange(n), np.flatnonzero(cuts) + 1)]
            if (np.diff([np.average(y[b], weights=w[b]) for b in blocks]) >= 0).all()
        )
        assert (np.diff(got) >= -1e-12).all() and abs((w * (y - got) ** 2).sum() - best) < 1e-9


def test_decoding_against_brute_force(spoken):
    """Language and probability from the definition: each codeword's weighted logistic loss, bit by bit."""
    from math import exp, log1p

    model = language.train(spoken)
    x = language.features(texts("the thing", "eau que", "schein", "x"), model.settings.dims)
    best, p, _ = model.predict(x)
    for row, b, q in zip(x, best, p, strict=True):
        losses = []
        for word in model.code:
            margins = [sum(float(row[i]) * float(model.weights[i, j]) for i in np.flatnonzero(row)) + float(model.bias[j]) for j in range(len(word))]
            losses.append(sum(t * log1p(exp(-m * c)) for t, m, c in zip(model.trust, margins, word, strict=True)))
        assert b == int(np.argmin(losses))
        assert abs(q - 1 / sum(exp(-model.sharp * (v - min(losses))) for v in losses)) < 1e-4


def test_features_against_brute_force():
    """Counts of 1- to 3-byte runs of the folded text, hashed one by one."""
    for text in ("Abc, déf 9", "aaaa", "é", " "):
        folded = [32 if b in b" \t\n\x0b\x0c\r" or b < 128 and not chr(b).isalpha() else ord(chr(b).lower()) if b < 128 else b for b in text.encode()]
        want = np.zeros(256)
        for k in (1, 2, 3):
            for i in range(len(folded) - k + 1):
                code = 0
                for b in folded[i : i + k]:
                    code = code * 257 + b + 1
                want[((code * 0x9E3779B1 + k * 0x85EBCA6B & 0xFFFFFFFF) * 0x27D4EB2F >> 15) & 255] += 1
        want = np.sqrt(want) / max(np.sqrt(want.sum()), 1e-9)
        assert np.allclose(language.features(texts(text), 256)[0], want, atol=1e-6)


def test_isotonic():
    x, y = np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1])
    at, fit = toxicity.isotonic(x, y, np.ones(5))
    assert np.allclose(np.interp([1, 2, 3, 4], at, fit), [0, 1 / 3, 1 / 3, 1]) and (np.diff(fit) >= 0).all()


def test_disguised_words_count():
    def key(w):
        return toxicity._hash_words([w])

    lexicon = toxicity.Lexicon(key("idiot"), np.ones(1, np.float32))
    plain, leet, clean = toxicity.features(texts("you idiot", "you 1d10t", "you there"), lexicon, 4)
    assert plain[6] > 0 and plain[11] > 0 and leet[13] > 0 and clean[[6, 11, 13]].sum() == 0
