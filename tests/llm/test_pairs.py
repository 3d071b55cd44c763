"""Similarity joins and substring removal against brute force, and odd inputs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from refrain.llm import editprint, jaccard, relative, vectors
from refrain.llm.blocks import forest
from refrain.llm.components import components
from tests.llm.conftest import documents, prose


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [0, 20_000])
def test_components(spark, monkeypatch, few):
    import refrain.llm.components

    monkeypatch.setattr(refrain.llm.components, "FEW", few)
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (300, 301), (301, 300)]
    frame = spark.createDataFrame([*links, (None, 5), (5, None)], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    want = reach({n for l in links for n in l}, links)
    assert got == {n: c for n, c in want.items() if any(n in l for l in links if l[0] != l[1])}
    assert components(frame.limit(0)).count() == 0


def test_forest():
    root = forest(6, np.array([4, 1, 2]), np.array([5, 2, 0]))
    assert root.tolist() == [0, 0, 0, 3, 4, 4]


def brute_vectors(rows):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    component = reach([i for i, _ in rows if i is not None], links)
    return {i: (sum(a == i for a, _ in links), component[i], component[i] == i) for i, _ in rows if i is not None}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(200)]
    rows += [(200 + i, [float(np.float32(x)) for x in centre[0] + 0.02 * rng.normal(size=16)]) for i in range(80)]  # more than a window
    rows += [(300, rows[0][1]), (301, None), (302, []), (303, [0.0] * 16), (304, [float("nan")] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [float("inf")] * 16), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, k string, payload string").repartition(4)
    settings = vectors.Settings(widest=32, block=32)
    got = vectors.near_duplicates(frame, settings=settings).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == brute_vectors(rows)
    assert [(r["n_links"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, True)]
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def beside(rng, x, cosine):
    """A unit vector at the given cosine to each row of x."""
    step = rng.normal(size=x.shape)
    step -= (step * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * step / np.linalg.norm(step, axis=1, keepdims=True)


def around(rng, n, cosine):
    """n unit vectors of 64 numbers whose cosine to each other is about ``cosine``."""
    side = rng.normal(size=(n, 64))
    side[:, 0] = 0
    return np.sqrt(cosine) * np.eye(64)[0] + np.sqrt(1 - cosine) * side / np.linalg.norm(side, axis=1, keepdims=True)


def in_parts(x, parts=4):
    """Vectors as an Arrow table of (vec_id, embedding)."""
    import pyarrow as pa

    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
    return pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": lists})


def true_links(x):
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 1000):
        out[lo : lo + 1000] = (x[lo : lo + 1000] @ x.T >= 0.95).sum(1) - 1
    return out


def test_vectors_that_lie_unevenly(spark):
    """20,000 vectors: a third in one clump, others in loose clusters and alone; lone pairs just above the cosine in all of them."""
    rng = np.random.default_rng(7)
    clump = around(rng, 7000, 0.8)
    centres = rng.normal(size=(40, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    loose = beside(rng, centres[rng.integers(0, 40, 7000)], 0.8)
    alone = rng.normal(size=(6000, 64))
    alone /= np.linalg.norm(alone, axis=1, keepdims=True)
    pairs = beside(rng, np.concatenate([clump[:500], loose[:500], alone[:500]]), 0.952)
    x = np.concatenate([clump, loose, alone, pairs])
    frame = spark.createDataFrame(in_parts(x)).repartition(4)
    want = true_links(x)
    assert want.sum() >= 3000
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(frame).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.995 * want.sum()


@pytest.mark.parametrize("lone, dense, blind, settings", [(40_000, 3000, False, {}), (40_000, 3000, True, {}), (16_000, 1000, False, {"carry": 1, "block": 256})])
def test_vectors_of_one_dense_place(spark, monkeypatch, lone, dense, blind, settings):
    """Links where few vectors lie, but densely, so that the passes of the others are not enough; the last case takes rounds of passes."""
    rng = np.random.default_rng(9)
    alone = rng.normal(size=(lone, 64))
    alone /= np.linalg.norm(alone, axis=1, keepdims=True)
    rare = around(rng, dense, 0.82)
    x = np.concatenate([alone, rare, beside(rng, rare[:1000], 0.952)])
    want = true_links(x)
    assert want[:lone].sum() == 0 and want.sum() >= 2000
    if blind:  # the plan of a sample that met lone ones only
        plan, even = vectors.plan, 2.0 ** (vectors.STEP * np.arange(13))[None, :, None]
        monkeypatch.setattr(vectors, "plan", lambda runs, n, s: plan(np.maximum(1, n / even), n, s))
    frame = spark.createDataFrame(in_parts(x)).repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(frame, settings=vectors.Settings(**settings)).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.995 * want.sum()


@pytest.mark.parametrize("window", [1, 6, 40])
def test_crowded_vectors_against_brute_force(spark, window):
    """However the ordered rows are dealt, each pass tells of each vector how many signs whatever lies beyond its window shares with it at most."""
    rng = np.random.default_rng(6)
    x = np.concatenate([around(rng, 90, 0.97), rng.normal(size=(40, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "c long, payload binary")
    s, passes, first, deep = vectors.Settings(), 3, 5, 4
    want = set()
    for p in range(passes):
        order = vectors._order(x, first + p, s)
        at = sorted(range(len(x)), key=lambda i: (order[i], i))
        for k, i in enumerate(at):
            beyond = [at[m] for m in (k - window, k + window) if 0 <= m < len(at)]
            depth = max((s.signs - int(order[i] ^ order[j]).bit_length() + 1 for j in beyond), default=0)
            want |= {(i, p, depth)} if depth > deep else set()
    assert len(want) > 100
    for parts in (1, 7, 200):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [(r["a"], r["p"], r["d"]) for r in vectors._candidates(classes, window, passes, np.float64, s, first, deep).collect() if r["p"] is not None]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(got) == len(set(got)) and set(got) == want


def test_vectors_in_groups_of_more_than_a_block(spark):
    """Near copies that are one component, and a clump that is none though its candidates touch."""
    rng = np.random.default_rng(8)
    copies = beside(rng, np.repeat(rng.normal(size=(1, 64)) / 8, 900, 0) / np.linalg.norm(np.ones(1)), 0.99)
    copies /= np.linalg.norm(copies, axis=1, keepdims=True)
    x = np.concatenate([copies, around(rng, 900, 0.88)])
    frame = spark.createDataFrame(in_parts(x)).repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame, settings=vectors.Settings(block=128, widest=32)).collect()}
    want = true_links(x)
    assert all(got[i][0] <= n for i, n in enumerate(want)) and sum(n for n, _ in got.values()) >= 0.99 * want.sum()
    assert {c for i, (_, c) in got.items() if i < 900} == {0}


def test_plan_reaches_the_recall_at_least_cost():
    s = vectors.Settings()
    depth = vectors.STEP * np.arange(13)
    even = np.maximum(1, 1_000_000 / 2.0**depth)[None, :, None].repeat(3, 0).repeat(5, 2)  # every sign halves the vectors
    slow = np.maximum(1, 1_000_000 / 1.3**depth)[None, :, None].repeat(3, 0).repeat(5, 2)
    for runs in (even, slow):
        window, passes = vectors.plan(runs, 1_000_000, s)
        agree = (1 - s.differ) ** depth
        found = (agree * np.minimum(1, window / runs[0, :, 0])).max()
        assert (1 - found) ** passes <= 1 - s.recall < (1 - found) ** (passes - 1)
    assert np.prod(vectors.plan(slow, 1_000_000, s)) > np.prod(vectors.plan(even, 1_000_000, s))
    window, passes = vectors.plan(np.full((3, 13, 5), 10**9), 10**9, s)
    assert passes == s.most and window >= s.widest // 2


def test_least_forest():
    rng = np.random.default_rng(3)
    a, b, w = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 9, 300)
    pick = vectors.least_forest(50, a, b, w)
    left, total = reach(range(50), []), 0
    for k in sorted(range(300), key=lambda k: w[k]):  # edge by edge, the least first
        if left[a[k]] != left[b[k]]:
            low, high = sorted((left[a[k]], left[b[k]]))
            left = {n: low if c == high else c for n, c in left.items()}
            total += w[k]
    assert w[pick].sum() == total and reach(range(50), zip(a[pick], b[pick], strict=True)) == left
    assert len(vectors.least_forest(5, a[:0], b[:0], w[:0])) == 0


def test_windows_over_partitions(spark):
    """However the ordered rows are dealt, the same neighbours meet; partitions of a row or two included."""
    rng = np.random.default_rng(5)
    x = beside(rng, np.repeat(rng.normal(size=(30, 64)) / 8, 4, 0), 0.97)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "c long, payload binary")
    s, found = vectors.Settings(), []
    for parts in (1, 7, 200):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        edges = vectors._candidates(classes, 6, 3, np.float64, s).collect()
        found.append(reach(range(len(x)), [(r["a"], r["b"]) for r in edges]))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2]


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    component = reach(sets, links)
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i] or i, i)
    return {i: (least[sets[i] or i], sum(a == i for a, _ in links), component[i], component[i] == i) for i in sets}


@pytest.mark.parametrize("tight", [False, True])
def test_jaccard(spark, odd_rows, tight):
    rng = random.Random(6)
    rows = list(odd_rows)
    base = prose(rng, 60).split()
    for i in range(70):  # one large group of near copies, not all of which link
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(60)] = f"w{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(words), "en", "s"))
    for i in range(40):
        one = prose(rng, 80).split()
        rows.append((200 + 2 * i, " ".join(one), "en", "s"))
        one[rng.randrange(80)] = "changed"
        rows.append((201 + 2 * i, " ".join(one), "en", "s"))
    settings = jaccard.Settings(small=4, last=5, block_rows=16) if tight else jaccard.Settings()
    got = jaccard.similar_documents(documents(spark, rows), settings=settings).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == brute_jaccard(rows)


def test_jaccard_misses_as_few_as_stated(spark):
    """Lone pairs at the threshold whose buckets are split in every run, as those of a large shared passage are."""
    import pyarrow as pa

    s = jaccard.Settings(small=1, dense=1.1, last=8, missed=0.01)
    rng = np.random.default_rng(12)
    n = 1500
    a = rng.integers(-(2**31), 2**31, (n, s.tokens), dtype=np.int32)
    b = np.where(rng.random((n, s.tokens)) < 0.8, a, rng.integers(-(2**31), 2**31, (n, s.tokens), dtype=np.int32))
    both = np.concatenate([a, b])
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, both.size + 1, s.tokens, dtype=np.int32)), pa.array(both.ravel()))
    classes = spark.createDataFrame(pa.table({"c": pa.array(np.arange(2 * n)), "tokens": tokens})).repartition(4).cache()
    found = jaccard._candidates(classes, s).where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct().where(f"b = a + {n}").count()
    assert n - found <= 1.5 * s.missed * n


def test_jaccard_empty(none):
    assert jaccard.similar_documents(none).count() == 0


def brute_windows(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                s = tuple(w[p : p + window])
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 7])
def test_substrings(spark, odd_rows, window):
    rng = random.Random(8)
    passage = prose(rng, 55)
    rows = list(odd_rows) + [(500 + i, prose(rng, rng.randint(0, 90)) + " " + " ".join(passage.split()[rng.randint(0, 3) :]) + "\n" + prose(rng, 20), "en", "s") for i in range(25)]
    rows += [(600, "x y " * 120, "en", "s"), (601, "x y " * 70, "en", "s"), (602, "x " * 300, "en", "s")]
    got = relative.deduplicate(documents(spark, rows), window).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr) == brute_windows(rows, window)


def test_substrings_by_shuffles(spark, odd_rows):
    """The same without any broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = relative.deduplicate(documents(spark, odd_rows), 50).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr) == brute_windows(odd_rows, 50)


def test_substrings_of_rows_that_share_an_id(spark):
    rng = random.Random(11)
    p, q, r = (prose(rng, 60) for _ in range(3))
    rows = [(1, p, "en", "s"), (2, p + " end", "en", "s"), (2, q, "en", "s"), (2, p, "en", "s"), (2, "new " + q, "en", "s"), (3, q + " " + r, "en", "s"), (3, q + " " + r, "en", "s")]
    got = [(x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in relative.deduplicate(documents(spark, rows)).collect()]
    want = [(1, 60, 0, p), (2, 61, 60, "end"), (2, 60, 0, q), (2, 60, 60, ""), (2, 61, 0, "new " + q), *[(3, 120, 60, r)] * 2]
    assert sorted(got) == sorted(want)


def test_factors_name_their_source(spark, odd_rows):
    """Every factor equals its source word by word, and together they cover the words removed."""
    rng = random.Random(8)
    passage = prose(rng, 90).split()
    rows = list(odd_rows) + [(500 + i, " ".join([prose(rng, rng.randint(0, 40)), *passage[rng.randint(0, 9) : rng.randint(70, 90)], prose(rng, 20)]), "en", "s") for i in range(25)]
    rows += [(600, "x y " * 120, "en", "s"), (601, "x y " * 70, "en", "s"), (602, " ".join(passage[:60]) + " x y" * 60, "en", "s")]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows if i is not None}
    seen = 0
    for r in relative.deduplicate(documents(spark, rows)).collect():
        gone, own = set(), words.get(r["doc_id"])
        for first, end, source, at in r["factors"] or ():
            ref = words[source]
            assert source < r["doc_id"] and end - first >= 50 and own[first:end] == ref[at : at + end - first]
            gone.update(range(first, end))
            seen += 1
        assert len(gone) == r["n_removed"]
    assert seen > 25


def test_parse_follows_one_source():
    row, start = np.array([0, 0, 0, 0, 1, 1]), np.array([3, 4, 5, 9, 10, 11])
    source, at = np.array([7, 7, 8, 8, 8, 8]), np.array([0, 1, 40, 44, 45, 46])
    begins, ends = relative.parse(row, start, source, at, 50)
    assert (begins.tolist(), ends.tolist()) == ([0, 2, 3, 4], [54, 55, 59, 61])
    assert [x.tolist() for x in relative.parse(*[np.zeros(0, np.int64)] * 4, 50)] == [[], []]


def test_substrings_empty(none):
    assert relative.deduplicate(none).count() == 0


def brute_edited(rows):
    import xxhash

    def place(r):
        h = xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()
        return r[0] is not None, r[0] if r[0] is not None else 0, h - 2**64 if h >= 2**63 else h

    order = [(i, t or "") for i, t, *_ in sorted(rows, key=place)]
    out = []
    for n, (i, t) in enumerate(order):
        after, half = order[(n + 1) % len(order)][1], len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + after[:half], t, after))
    return out


def plain_print(text, s):
    """The fingerprint from its definition: each walk step by step, each slot the least-ranked step's byte."""
    M = 2**64 - 1

    def mixed(x, seed):
        x = (x + (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019)) & M
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
        return x ^ x >> 31

    code = [(ord(c) ^ (ord(c) >> 8) * 31 ^ ord(c) >> 16) & 255 for c in text]
    out = []
    for walk in range(s.walks):
        seed, at, step, least, own = s.seed + 2 * walk, 0, 0, [None] * s.slots, [0] * s.slots
        while at < len(code):
            value = 0
            for c in code[at : at + s.context]:
                value = (value * 0x01000193 + c + 1) & 0xFFFFFFFF
            value = ((value * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % 255 + 1
            for slot in range(s.slots):
                rank = mixed(step * 4096 + slot, seed + 1)
                if least[slot] is None or rank < least[slot]:
                    least[slot], own[slot] = rank, value
            at += (mixed((step % editprint.PERIOD) * 256 + code[at], seed) >> 63) + 1
            step += 1
        out += own
    return bytes(out)


def plain_likeness(a, b):
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / len(a) - 1 / 255) / (1 - 1 / 255)))


def test_prints_against_brute_force():
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(40)] + ["", "a", "ab", "éж🙂" * 9]
    s = editprint.Settings()
    got = editprint.fingerprints(texts, editprint.plans(s))
    assert [p.tobytes() for p in got] == [plain_print(t, s) for t in texts]


def test_prints_of_long_texts_against_brute_force():
    """Texts read past the steps that a fresh plan knows: all of them counts, whatever was read before."""
    rng = random.Random(12)
    texts = [prose(rng, 3000) for _ in range(2)]
    texts.append(texts[0][:9000] + prose(rng, 2000))  # alike in as much as a fresh plan's steps read
    s = editprint.Settings()
    assert min(len(t) for t in texts) > 2 * 9000
    for text in texts:
        want = plain_print(text, s)
        read = editprint.plans(s)
        for _ in range(2):  # the second time the plan is as long as the text
            assert editprint.fingerprints([text], read)[0].tobytes() == want
    short = [prose(rng, 5) for _ in range(editprint.FEW)]
    assert [p.tobytes() for p in editprint.fingerprints(short + texts, editprint.plans(s))] == [plain_print(t, s) for t in short + texts]


@pytest.mark.parametrize("parts", [1, 9])
def test_fingerprints(spark, odd, odd_rows, parts):
    import hashlib

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = editprint.with_edited(odd).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    shared = editprint.plans(editprint.Settings())
    edited = brute_edited(odd_rows)
    own, other, after = (editprint.fingerprints([r[k] for r in edited], shared) for k in (3, 2, 4))
    want = [
        (i, n, hashlib.sha256(e.encode()).hexdigest(), p.tobytes().hex(), q.tobytes().hex(), round(plain_likeness(p, q), 9), round(plain_likeness(p, r), 9))
        for (i, n, e, *_), p, q, r in zip(edited, own, other, after, strict=True)
    ]
    assert sorted(((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=repr) == sorted(want, key=repr)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[0]["fingerprint"] == by_id[20]["fingerprint"] != by_id[1]["fingerprint"]
    assert by_id[2]["near_edited"] > 0.3 > by_id[2]["near_next"]


def test_fingerprints_of_ids_of_any_type(spark):
    rows = [(f"{i:02d}", prose(random.Random(i), 30)) for i in range(12)]
    wide = editprint.with_edited(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    for kind in ("smallint", "int", "decimal(9,0)", "date"):
        cast = f"cast(cast(doc_id as int) as {kind})" if kind != "date" else "date_add(date'2020-01-01', cast(doc_id as int))"
        one = spark.createDataFrame(rows, "doc_id string, text string").selectExpr(f"{cast} doc_id", "text").repartition(3)
        out = editprint.with_edited(one)
        assert out.schema["doc_id"].dataType == one.schema["doc_id"].dataType
        assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(tuple(r)[1:] for r in wide)
    empty_ids = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")
    assert editprint.with_edited(empty_ids).count() == 12


def test_fingerprints_alone(spark, none):
    one = editprint.with_edited(documents(spark, [(5, "abcd", "en", "s")])).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(4, 1.0)]
    assert editprint.with_edited(none).count() == 0


def test_walks_agree_one_by_one_and_together():
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(60)] + ["", "a", "é" * 500]
    shared = editprint.plans(editprint.Settings())
    together = editprint.fingerprints(texts, shared)
    assert all((editprint.fingerprints([t], editprint.plans(editprint.Settings()))[0] == row).all() for t, row in zip(texts, together, strict=True))


def test_near_copies(spark, odd, none):
    got = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in editprint.near_copies(odd).collect() if r["doc_id"] is not None}
    assert got[20] == (0, 0) and got[21][1] == 0 and got[22][1] == 1 and got[2] == (2, 2)
    assert all(got[i] == (i, i) for i in (30, 31, 33))
    assert editprint.near_copies(none).count() == 0


def test_near_copies_against_brute_force(spark):
    """Copies with a few edits each: what bands and verification link is all that the likeness of all pairs links, but for the stated loss."""
    rng = random.Random(14)
    texts = []
    for _ in range(60):
        one = prose(rng, 80)
        texts.append(one)
        for _ in range(rng.randint(0, 3)):
            words = one.split()
            words[rng.randrange(80)] = "changed"
            texts.append(" ".join(words))
    s = editprint.Settings()
    prints = editprint.fingerprints(texts, editprint.plans(s))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if plain_likeness(prints[i], prints[j]) >= s.alike]
    want = reach(range(len(texts)), links)
    got = {r["doc_id"]: r["component_id"] for r in editprint.near_copies(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert len(links) > 60 and sum(got[i] != c for i, c in want.items()) <= 2
    assert all(want[i] == want[c] for i, c in got.items())


def test_copies_beside_edited_texts(spark, odd, none):
    out = editprint.with_copies(odd)
    got = {r["doc_id"]: (r["class_id"], r["component_id"], r["fingerprint"]) for r in out.collect()}
    assert out.count() == odd.count() and got[20][:2] == (0, 0) and got[None][:2] == (None, None)
    assert editprint.with_copies(none).count() == 0
