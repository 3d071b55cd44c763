"""Jaccard similarity join of word n-gram sets by chosen paths.

Documents with equal sets are one class. Every class is embedded as a row of min-hashes, tokens that two sets share with
a probability equal to their similarity. A run splits the classes by one sampled token after another: those that chose
the same tokens so far are in one bucket. Buckets that are small are compared by brute force on the min-hashes, and so,
in blocks, are large ones whose members are alike on average: splitting would not part them, only lose pairs. Other
large buckets are split again, by two tokens each time, so that a similar pair rarely loses all common paths; what is
still large after the last split is compared in blocks. Each run has min-hashes of its own, so runs are independent;
enough are made that a pair at the threshold is missed with the wanted small probability, even if its buckets are split
down to the last level in every run. Brute force compares a byte of each min-hash of all runs. Classes that look alike in some bucket are put
in one candidate group, and inside each group all pairs are tested on their exact sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import Texts, as_long, map_texts, mix, window_hashes
from refrain.llm.blocks import compare_in_blocks
from refrain.llm.components import components
from refrain.runtime import cut, discard, join_small


@dataclass(frozen=True)
class Settings:
    words: int = 5
    numerator: int = 4  # similarity 4/5 or more links
    denominator: int = 5
    first: int = 3  # tokens chosen before buckets are first looked at
    last: int = 6  # tokens of the deepest split
    dense: float = 0.5  # average share of min-hashes that a bucket's members have in common with its first, from which it is not split
    small: int = 256  # classes in a bucket that is compared whole
    missed: float = 0.0002  # of pairs at the threshold, wanted after all runs, splits and comparisons
    alike: float = 0.62  # least share of equal min-hashes of a candidate; what it loses at the threshold counts as missed
    block_rows: int = 2048
    block_cost: int = 1 << 21  # n-grams in a block
    seed: int = 53

    @property
    def width(self) -> int:
        """Min-hashes of a run: the first tokens, and two for each split."""
        return self.first + 2 * (self.last - self.first)

    def loses(self, runs: int) -> float:
        """Bound of the probability that a pair at the threshold is lost: by all runs, or by the cut of all their min-hashes."""
        same = self.numerator / self.denominator
        found = same**self.first * (1 - (1 - same) ** 2) ** (self.last - self.first)  # split at every level
        n = runs * self.width
        cut_off = sum(comb(n, i) * same**i * (1 - same) ** (n - i) for i in range(ceil(self.alike * n)))
        return (1 - found) ** runs + cut_off

    @cached_property
    def runs(self) -> int:
        return next(r for r in range(1, 1000) if self.loses(r) <= self.missed)

    @property
    def tokens(self) -> int:
        """Min-hashes of a class."""
        return self.runs * self.width


def sets_of(texts: Texts, k: int) -> list[np.ndarray]:
    """The ascending hashes of each text's different k-word runs; a shorter text's only run is all its words; no words, none."""
    hashes = texts.word_hashes()
    _, _, first = texts.words()
    runs, _, at = texts.shingles(k, hashes)
    count = np.diff(first)
    whole = window_hashes(hashes, first[:-1], first[1:]) if len(hashes) else np.zeros(len(texts), np.uint64)
    return [np.unique(runs[at[i] : at[i + 1]]) if count[i] >= k else whole[i : i + 1] if count[i] else runs[:0] for i in range(len(texts))]


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes and the size of each set."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for seed in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat, seed))])
        out.append(total[at[1:]] - total[at[:-1]])
    return out[0], out[1], sizes


def sketches(docs: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """(k, a, b, n, tokens): digest, size and min-hashes of each row's set; without words the tokens are null."""
    rng = np.random.default_rng(s.seed)
    factor = rng.integers(1, 1 << 63, s.tokens, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, s.tokens, dtype=np.uint64)

    def work(batch, texts):
        sets = sets_of(texts, s.words)
        a, b, n = _digests(sets)
        some = np.flatnonzero(n)
        tokens = np.zeros((len(n), s.tokens), np.uint32)
        if len(some):
            flat, begin = np.concatenate(sets), np.concatenate([[0], np.cumsum(n[some])[:-1]])
            for i in range(s.tokens):
                tokens[some, i] = np.minimum.reduceat((flat * factor[i] + shift[i]) >> np.uint64(32), begin).astype(np.uint32)
        rows = pa.array([tokens[i].view(np.int32) if n[i] else None for i in range(len(n))], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("k"), as_long(a), as_long(b), pa.array(n.astype(np.int32)), rows], ["k", "a", "b", "n", "tokens"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_texts(rows, "t", work, f"k {docs.schema[key].dataType.simpleString()}, a long, b long, n int, tokens array<int>")


def _alike(s: Settings):
    def similar(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = (np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in side]).T) for side in (left, right))
        out = np.zeros((a.shape[1], b.shape[1]), bool)
        step = max(1, (1 << 17) // b.shape[1])
        for lo in range(0, a.shape[1], step):
            same = np.zeros((len(a[0, lo : lo + step]), b.shape[1]), np.uint16)
            for x, y in zip(a[:, lo : lo + step], b, strict=True):
                same += x[:, None] == y[None, :]
            out[lo : lo + step] = same >= s.alike * s.tokens
        return out

    return similar


def _exact(s: Settings):
    def similar(left: list[bytes], right: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(p, np.uint64) for p in (*left, *right)]
        size = np.array([len(x) for x in sets])
        value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        use = count[column] > 1
        number = np.cumsum(count > 1) - 1
        row, column, wide = row[use], number[column[use]], int((count > 1).sum())
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, wide, 2048):
            a, b = np.searchsorted(column, [lo, lo + 2048])
            part = np.zeros((len(sets), min(2048, wide - lo)), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            common += part[: len(left)] @ part[len(left) :].T
        both = size[: len(left), None] + size[None, len(left) :]
        return (s.numerator + s.denominator) * common.astype(np.int64) >= s.numerator * both

    return similar


def _candidates(classes: DataFrame, s: Settings) -> DataFrame:
    """(a, b): a forest over classes that look alike in some bucket."""
    pick = lambda i: F.element_at("tokens", F.col("r") * s.width + i + 1)
    rows = classes.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(s.runs - 1))))
    rows = cut(rows.select("r", "c", F.xxhash64("r", *(pick(d) for d in range(s.first))).alias("path")))
    done, used = [], [rows]
    for depth in range(s.first, s.last + 1):
        sizes = cut(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))  # written, so that a hot bucket's rows can be split
        rows = cut(rows.join(sizes, "path"))
        used += [sizes, rows]
        if depth == s.last:
            done.append(rows.select("path", "c", "size"))
            break
        done.append(rows.where(F.col("size") <= s.small).select("path", "c", "size"))
        large = rows.where(F.col("size") > s.small)
        if large.isEmpty():
            break
        large = cut(large.join(classes.select("c", "tokens"), "c"))
        heads = cut(large.groupBy("path").agg(F.min_by("tokens", "c").alias("head")))
        same = F.size(F.filter(F.zip_with("tokens", "head", lambda a, b: a == b), lambda x: x)) / s.tokens
        alike = cut(join_small(large, heads, "path", "inner").groupBy("path").agg(F.avg(same).alias("alike")))
        large = cut(join_small(large, alike, "path", "inner"))
        used += [large, heads, alike]
        done.append(large.where(F.col("alike") >= s.dense).select("path", "c", "size"))
        split = F.explode(F.array(*(F.xxhash64("path", F.lit(i), pick(i)) for i in (2 * depth - s.first, 2 * depth - s.first + 1))))
        rows = cut(large.where(F.col("alike") < s.dense).select("r", "c", split.alias("path")))
        used.append(rows)
    buckets = reduce(DataFrame.union, done).withColumnRenamed("path", "g")
    groups = cut(buckets.groupBy("g").agg(F.ceil(F.max("size") / (4 * s.small)).cast("int").alias("blocks")))

    def packed(batches):
        for batch in batches:
            lists = batch.column("tokens")
            data = [np.asarray(x.values).astype(np.uint8).tobytes() for x in lists]  # a byte differs with a probability of 255/256 if the hash does
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("item"), batch.column("weight"), pa.array(data, pa.binary())], ["g", "item", "weight", "payload"])

    items = buckets.join(classes.select("c", "tokens"), "c").select("g", F.col("c").alias("item"), F.lit(1).cast("long").alias("weight"), "tokens")
    items = items.mapInArrow(packed, "g long, item long, weight long, payload binary")
    found = cut(compare_in_blocks(items, groups, _alike(s)).select(F.col("item").alias("a"), F.col("root").alias("b")))
    discard(*used, groups)
    return found


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, class_id, n_links, component_id, kept) for each id.

    class_id is the least id with the same set of n-grams; n_links the other documents of similarity
    numerator/denominator or more, class members included; component_id the least id reachable by links; kept whether
    that is the document itself. Texts without words (null and empty ones) and rows with a null id link with nothing.
    Rows that repeat an id are one document, the one of least digest. Ids are integers. An empty table gives no rows.
    """
    s = settings
    found = sketches(docs, key, text, s)
    members = cut(found.groupBy("k").agg(F.min(F.struct("a", "b", "n", "tokens")).alias("v")).select("k", "v.*"))
    slim = cut(members.select("k", "a", "b", F.when(F.col("k").isNotNull(), F.col("n")).alias("n")))
    classes = cut(members.where("n > 0 and k is not null").groupBy("a", "b", "n").agg(F.min("k").cast("long").alias("c"), F.count("*").alias("weight"), F.first("tokens").alias("tokens")))
    discard(members)
    pairs = _candidates(classes, s)
    groups = cut(components(pairs).select(F.col("node").alias("c"), F.col("component").alias("g")))
    chosen = cut(groups.join(classes.select("c", "a", "b", "n", "weight"), "c"))
    sizes = chosen.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / s.block_rows), F.ceil(F.sum("n") / s.block_cost)).cast("int").alias("blocks"))
    sizes = cut(sizes)
    rows = docs.select(F.col(key).cast("long").alias("c"), F.col(text).alias("t"))
    rows = join_small(rows, chosen, "c", "inner")

    def exact_sets(batch, texts):
        sets = sets_of(texts, s.words)
        a, b, n = _digests(sets)
        same = (a.view(np.int64) == batch.column("a").to_numpy()) & (b.view(np.int64) == batch.column("b").to_numpy())
        keep = np.flatnonzero(same)
        columns = [batch.column(c).take(pa.array(keep)) for c in ("g", "c", "weight")]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["g", "item", "weight", "payload"])

    items = map_texts(rows, "t", exact_sets, "g long, item long, weight long, payload binary")
    units = cut(compare_in_blocks(items, sizes, _exact(s)))
    linked = components(units.select(F.col("item").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("least"))
    links = units.groupBy(F.col("item").alias("c")).agg(F.sum("links").alias("others"))
    result = cut(classes.select("a", "b", "n", "c", "weight").join(links, "c", "left").join(linked, "c", "left"))
    discard(pairs, groups, chosen, sizes, units, classes)
    out = slim.join(result, ["a", "b", "n"], "left")
    out = out.select(
        F.col("k").alias(key),
        F.coalesce("c", F.col("k").cast("long")).alias("class_id"),
        F.coalesce(F.col("weight") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "c", F.col("k").cast("long")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
