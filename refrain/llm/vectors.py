"""Near-duplicate vectors by sorted projection passes.

A pass orders all vectors lexicographically by concatenated random hashes, the signs of random projections, and compares
each with its neighbours: those at most ``window`` places after it. What travels through a pass is the order, the id and a
bit sketch of further signs, never the vector. Neighbours whose sketches differ in no more bits than a pair at the cosine
can differ in are candidates; of those found together a least spanning forest by differing bits is kept, so that a
vector's nearest neighbour stays linked with it. The candidates of all passes are united into groups, and inside each
group all pairs are tested exactly, in blocks. Groups of more than a block are first freed of doubtful candidates by
the exact cosine, so that clumps of vectors that are merely alike do not become one group.

A window is bounded, so a pass finds a pair at the cosine only if both agree in so many signs that no more than a window
of vectors agree in them too. How many signs that takes depends on how densely the vectors lie. Each pass counts it for
every vector: those a window before and after it tell how many signs suffice. Vectors whose passes do not add up to the
recall, because they lie more densely than others, go through further passes among themselves, planned for them alone;
when that costs as much as comparing them all, they become one group, whose pairs are tested exactly.

A sample says only how the work is cut, not what recall is reached: the vectors that share the first signs of some
sampled ones are counted over the whole table, and window and number of passes are the cheapest that reach the recall
for these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import comb, pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import grouped_stream
from refrain.llm.blocks import compare_in_blocks, forest
from refrain.llm.components import components
from refrain.runtime import cut, discard, join_small


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    recall: float = 0.995  # wanted for a pair that just reaches the cosine, found through no other vector
    missed: float = 1e-4  # of such pairs, lost by the sketches at most
    signs: int = 48  # of the order of a pass
    words: int = 4  # of 64 bits in a sketch
    sample: int = 500  # vectors, about, whose surroundings are counted to plan a round of passes
    trials: int = 4  # passes in which they are counted
    carry: int = 600  # comparisons that cost as much as carrying a vector through a pass
    widest: int = 1 << 16  # window, at most
    most: int = 4000  # passes, at most
    block: int = 2048  # vectors in a block of a group
    seed: int = 41

    @property
    def differ(self) -> float:
        """Probability that a pair that just reaches the cosine differs in a sign."""
        return float(np.arccos(self.cosine) / pi)

    def most_bits(self, bits: int, missed: float) -> int:
        """Bits in which all but a share ``missed`` of pairs at the cosine differ at most."""
        left, at = 1.0, -1
        while left > missed and at < bits:
            at += 1
            left -= comb(bits, at) * self.differ**at * (1 - self.differ) ** (bits - at)
        return at

    @property
    def lost(self) -> list[float]:
        """Logarithm of the chance that a pass misses a partner at the cosine, where those that agree in 0, 1 .. signs are found."""
        found = (1 - self.differ) ** np.arange(self.signs + 1)
        return [*np.log1p(-np.minimum(found, 1 - 1e-12)).tolist(), 0.0]  # the last: not even those that agree in all

    def enough_signs(self, passes: int) -> int:
        """The most signs of which that many passes, each finding a partner that agrees in them, reach the recall."""
        return min(self.signs, int(np.log1p(-((1 - self.recall) ** (1 / passes))) / np.log1p(-self.differ)))


#: Rows of a sorted stream that are compared together; candidate pairs held before they are reduced to a forest.
CHUNK, HELD = 8192, 1 << 19


def plan(runs: np.ndarray, n: int, s: Settings) -> tuple[int, int]:
    """(window, passes) of least cost. runs: how many of the n vectors share the first 0, STEP, 2 STEP .. signs of sampled ones, by (trial, depth, vector).

    A pass finds a partner that agrees in the first d signs for certain if the run of those signs fits a window, and
    with at least the window's share of the run if not. Passes are independent. If no window up to ``s.widest`` reaches
    the recall in ``s.most`` passes, it is the one that comes nearest.
    """
    agree = (1 - s.differ) ** (STEP * np.arange(runs.shape[1]))[None, :, None]
    best = None
    for window in [32 << i for i in range(40) if 32 << i < 2 * min(max(n, 32), s.widest)]:
        found = np.minimum((agree * np.minimum(1, window / np.maximum(runs, 1))).max(1), 1 - 1e-12)
        lost = np.log1p(-found).mean(0)  # of each vector's partner, for a pass
        count = np.arange(1, s.most + 1)
        missed = np.exp(count[:, None] * lost[None]).mean(1)
        enough = np.flatnonzero(missed <= 1 - s.recall)
        needed = int(count[enough[0]]) if len(enough) else s.most
        rank = (1, -needed * (s.carry + min(window, n))) if len(enough) else (0, -missed[-1])
        if best is None or rank > best[0]:
            best = rank, (window, needed)
    return best[1]


#: Signs between two depths at which surroundings are counted.
STEP = 4


def _valid(vectors: DataFrame, key: str, vector: str, dtype: type) -> DataFrame:
    """(k, payload): the vector's numbers as bytes, null where it can't link; float columns take four bytes a number."""

    def work(batches):
        for batch in batches:
            lists = batch.column("v")
            lengths = np.diff(np.asarray(lists.offsets))
            flat = lists.values.slice(lists.offsets[0].as_py(), int(lengths.sum()))
            values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)) + 0.0
            at = np.concatenate([[0], np.cumsum(lengths)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            size = np.concatenate([[0], np.cumsum(values != 0)])
            good = (bad[at[1:]] == bad[at[:-1]]) & (size[at[1:]] > size[at[:-1]])
            out = [values[at[i] : at[i + 1]].astype(dtype).tobytes() if good[i] else None for i in range(len(lengths))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], ["k", "payload"])

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("k"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("v"))
    return rows.mapInArrow(work, f"k {kind}, payload binary")


def _dtype(narrow: bool) -> type:
    return np.float32 if narrow else np.float64


def _unit(payload: list[bytes], dtype: type) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.frombuffer(p, dtype) for p in payload]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small numbers leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near(cosine: float, dtype: type):
    def similar(left: list[bytes], right: list[bytes]) -> np.ndarray:
        out = np.zeros((len(left), len(right)), bool)
        for size in {len(p) for p in left} & {len(p) for p in right}:  # vectors of other lengths never link
            a, b = [[i for i, p in enumerate(side) if len(p) == size] for side in (left, right)]
            out[np.ix_(a, b)] = _unit([left[i] for i in a], dtype) @ _unit([right[i] for i in b], dtype).T >= cosine
        return out

    return similar


def _planes(size: int, kind: int, number: int, signs: int, s: Settings) -> np.ndarray:
    return np.random.default_rng([s.seed, size, kind, number]).normal(size=(size, signs))


def _order(x: np.ndarray, p: int, s: Settings) -> np.ndarray:
    """The concatenated signs of pass p as a number that orders like them."""
    return ((x @ _planes(x.shape[1], 1, p, s.signs, s)) > 0) @ (1 << np.arange(s.signs, dtype=np.int64)[::-1])


def _sketch(x: np.ndarray, s: Settings) -> np.ndarray:
    """s.words numbers of 64 signs each."""
    bits = (x @ _planes(x.shape[1], 2, 0, 64 * s.words, s)) > 0
    return np.packbits(bits, axis=1).view(np.int64)


def _by_size(batch: pa.RecordBatch, dtype: type):
    """(places, unit vectors) for each length of vector in the batch."""
    payload = batch.column("payload").to_pylist()
    lengths = np.array([len(p) for p in payload])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, _unit([payload[i] for i in at], dtype)


def _surroundings(classes: DataFrame, n: int, dtype: type, s: Settings, first: int = 0) -> np.ndarray:
    """``runs`` of ``plan`` for passes from ``first`` on: counted over all vectors for about ``s.sample`` of them, chosen by hash."""
    some = classes.where(F.pmod(F.xxhash64(F.lit(s.seed), "d"), F.lit(1 << 30)) < int(min(1.0, s.sample / max(1, n)) * (1 << 30)))
    got = [bytes(r["payload"]) for r in some.select("payload").collect()] or [bytes(classes.first()["payload"])]
    own = pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["payload"])
    depths = range(0, s.signs + 1, STEP)
    orders = np.zeros((s.trials, len(got)), np.int64)
    for at, x in _by_size(own, dtype):
        for t in range(s.trials):
            orders[t, at] = _order(x, first + t, s)
    # By trial and depth, the different first signs of the sample.
    wanted = [[np.unique(orders[t] >> (s.signs - d)) for d in depths] for t in range(s.trials)]
    begins = np.cumsum([0, *(len(w) for trial in wanted for w in trial)])

    def work(batches):
        counts = np.zeros(begins[-1], np.int64)
        for batch in batches:
            for _, x in _by_size(batch, dtype):
                for t in range(s.trials):
                    order = np.sort(_order(x, first + t, s))
                    for k, d in enumerate(depths):
                        w = wanted[t][k]
                        lo, hi = (np.searchsorted(order, (w + e) << (s.signs - d)) for e in (0, 1))
                        counts[begins[t * len(depths) + k] :][: len(w)] += hi - lo
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["at", "n"])

    total = np.zeros(begins[-1], np.int64)
    for r in classes.select("payload").mapInArrow(work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each prefix of the sample
        total[r["at"]] = r["n"]
    runs = np.zeros((s.trials, len(depths), len(got)), np.int64)
    for t in range(s.trials):
        for k, d in enumerate(depths):
            runs[t, k] = total[begins[t * len(depths) + k] + np.searchsorted(wanted[t][k], orders[t] >> (s.signs - d))]
    return runs


def least_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a least spanning forest of n nodes: each tree joins another by its least edge, until none can."""
    order = np.lexsort((b, a, weight))
    a, b, root, chosen, left = a[order], b[order], np.arange(n), [], np.arange(len(order))
    while True:
        x, y = root[a[left]], root[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return order[np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64)]
        least = np.full(n, len(order))
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        pick = np.unique(least[least < len(order)])
        chosen.append(pick)
        root = forest(n, root[a[pick]], root[b[pick]])[root]


def neighbours(passes: np.ndarray, sketch: np.ndarray, begin: int, window: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of a least forest of candidates among ordered rows: i < j <= i + window, j from ``begin`` on, in one pass."""
    n, bits = len(passes), sketch.view(np.uint64)
    first, every = s.most_bits(64, s.missed / 10), s.most_bits(64 * s.words, s.missed)
    held = [np.zeros((3, 0), np.int64)]

    def reduced() -> np.ndarray:
        i, j, d = np.concatenate(held, axis=1)
        return np.stack([i, j, d])[:, least_forest(n, i, j, d)]

    for o in range(1, min(window, n - 1) + 1):
        lo = max(0, begin - o)
        near = np.flatnonzero(np.bitwise_count(bits[lo : n - o, 0] ^ bits[lo + o :, 0]) <= first) + lo
        near = near[passes[near] == passes[near + o]]
        if len(near):
            d = np.bitwise_count(bits[near] ^ bits[near + o]).sum(1, dtype=np.int64)
            near, d = near[d <= every], d[d <= every]
            held.append(np.stack([near, near + o, d]))
            if sum(h.shape[1] for h in held) > HELD:
                held = [reduced()]
    return tuple(reduced())


def _chunks(batches, names: list[str]):
    """The columns of Arrow batches as arrays of CHUNK rows, the last of fewer, whatever the batches' own sizes."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]))
            n += batch.num_rows
        while n >= CHUNK:
            rows = np.concatenate(held)
            yield rows[:CHUNK]
            held, n = [rows[CHUNK:]], n - CHUNK
    if n:
        yield np.concatenate(held)


def crowded(before: np.ndarray, after: np.ndarray, deep: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and depths above ``deep`` of rows (o, ..) of which each in ``after`` is a window after that in ``before``.

    Whatever shares ``depth`` signs with either row lies within a window of it on that side.
    """
    differ = before[:, 0] ^ after[:, 0]
    depth = s.signs + 1 - np.frexp(differ.astype(np.float64))[1]  # one more than the signs that both share
    at = np.flatnonzero((differ >> s.signs == 0) & (depth > deep))
    return at, depth[at]


def _windowed(window: int, s: Settings, deep: int):
    """Over sorted rows (o, c, s0 ..): edges (a, b, d), crowded rows (a, null, depth) with their pass as p, and the rows within a window of either end of the partition."""
    names = ["o", "c", *(f"s{i}" for i in range(s.words))]
    empty = np.zeros((0, len(names)), np.int64)

    def out(a, b=None, d=None, p=None, pid=None, pos=None, rest=None) -> pa.RecordBatch:
        missing = lambda kind: pa.nulls(len(a), kind)
        columns = [pa.array(a), pa.array(b) if b is not None else missing(pa.int64()), pa.array(d.astype(np.int32)) if d is not None else missing(pa.int32())]
        columns += [pa.array(p.astype(np.int32)) if p is not None else missing(pa.int32())]
        columns += [missing(pa.int32()), missing(pa.int64())] if rest is None else [pa.array(np.full(len(a), pid, np.int32)), pa.array(pos)]
        columns += [missing(pa.int64()) if rest is None else pa.array(np.ascontiguousarray(rest[:, i])) for i in (0, *range(2, len(names)))]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "d", "p", "pid", "pos", "o", *names[2:]])

    def work(batches):
        pid = TaskContext.get().partitionId()
        before, seen, head = empty, 0, empty
        for rows in _chunks(batches, names):
            both = np.concatenate([before, rows])
            i, j, d = neighbours(both[:, 0] >> s.signs, np.ascontiguousarray(both[:, 2:]), len(before), window, s)
            if len(i):
                yield out(np.minimum(both[i, 1], both[j, 1]), np.maximum(both[i, 1], both[j, 1]), d)
            at, depth = crowded(both[:-window], both[window:], deep, s)
            for dense in (both[at], both[at + window]) if len(at) else ():
                yield out(dense[:, 1].copy(), d=depth, p=dense[:, 0] >> s.signs)
            if len(head) < window:
                head = np.concatenate([head, rows[: window - len(head)]])
            before, seen = both[-window:], seen + len(rows)
        if seen:
            yield out(head[:, 1].copy(), pid=pid, pos=np.arange(len(head)), rest=head)
            tail = before[max(0, len(before) - (seen - len(head))) :] if seen > len(head) else empty
            if len(tail):
                yield out(tail[:, 1].copy(), pid=pid, pos=np.arange(seen - len(tail), seen), rest=tail)

    return work


def _across(ends: DataFrame, window: int, s: Settings, deep: int) -> DataFrame:
    """Edges (a, b, d) between rows of different partitions, and rows that those crowd: the last rows of each meet the window of rows that follow it.

    Rows in each partition, one number for each, come to the driver, which tells whose first rows follow whose last ones.
    """
    counts = sorted((r["pid"], r["n"]) for r in ends.groupBy("pid").agg((F.max("pos") + 1).alias("n")).collect())
    dealt = []
    for i, (pid, n) in enumerate(counts):
        dealt.append((pid, pid, n - window, n))
        reach = window
        for other, m in counts[i + 1 :]:
            dealt.append((other, pid, 0, reach))
            reach -= m
            if reach <= 0:
                break
    table = ends.sparkSession.createDataFrame(dealt, "pid int, edge int, low long, high long")
    rows = ends.join(F.broadcast(table), "pid").where("low <= pos and pos < high")  # a few rows for each partition

    def work(group: pa.Table) -> pa.Table | None:
        c, o = group.column("c").to_numpy(), group.column("o").to_numpy()
        i, j, d = neighbours(o >> s.signs, np.column_stack([group.column(f"s{k}").to_numpy() for k in range(s.words)]), 0, window, s)
        # The last rows are a window at most, so of two rows a window apart one is of them and the other is not.
        at, depth = crowded(o[:-window, None], o[window:, None], deep, s)
        dense = np.concatenate([at, at + window])
        return pa.table(
            {
                "a": np.concatenate([np.minimum(c[i], c[j]), c[dense]]),
                "b": pa.chunked_array([pa.array(np.maximum(c[i], c[j])), pa.nulls(len(dense), pa.int64())]),
                "d": np.concatenate([d, depth, depth]).astype(np.int32),
                "p": pa.chunked_array([pa.nulls(len(i), pa.int32()), pa.array((o[dense] >> s.signs).astype(np.int32))]),
            }
        )

    return grouped_stream(rows, ["edge"], ["pid", "pos"], work, "a long, b long, d int, p int")


def _candidates(classes: DataFrame, window: int, passes: int, dtype: type, s: Settings, first: int = 0, deep: int | None = None) -> DataFrame:
    """(a, b, p, d): the candidates of passes from ``first`` on, each pair once, p null; a table made by ``cut``.

    With ``deep`` also (c, null, p, depth), a row for each vector and pass in which only partners are found for certain
    that agree in ``depth`` signs, more than ``deep`` (more than there are: none is).
    """
    deep = s.signs + 1 if deep is None else deep
    names = [f"s{i}" for i in range(s.words)]

    def keyed(batches):
        for batch in batches:
            for at, x in _by_size(batch, dtype):
                own = [batch.column("c").take(pa.array(at)), *(pa.array(np.ascontiguousarray(v)) for v in _sketch(x, s).T)]
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(_order(x, first + p, s) + (p << s.signs)), *own], ["o", "c", *names])

    rows = classes.select("c", "payload").mapInArrow(keyed, "o long, c long, " + ", ".join(f"{c} long" for c in names))
    kind = "a long, b long, d int, p int, pid int, pos long, o long, " + ", ".join(f"{c} long" for c in names)
    found = cut(rows.repartitionByRange("o", "c").sortWithinPartitions("o", "c").mapInArrow(_windowed(window, s, deep), kind))
    over = _across(found.where("pid is not null").select("pid", "pos", "o", F.col("a").alias("c"), *names), window, s, deep)
    met = found.where("pid is null").select("a", "b", "d", "p").union(over)
    met = cut(met.groupBy("a", "b", "p").agg(F.when(F.col("p").isNull(), F.min("d")).otherwise(F.max("d")).alias("d")))
    discard(found)
    return met


def _all_candidates(classes: DataFrame, n: int, dtype: type, s: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, d): candidates by as many rounds of passes as each of the n vectors needs, and the tables made by ``cut`` that hold them.

    A round's vectors are those whose passes so far don't reach the recall. If all pairs of them are no more work than
    the passes that they need, or no passes are enough, or a round hardly makes them fewer, they all become candidates.
    """
    whole = n <= min(s.widest, s.block)
    window, passes = (max(n, 1), 1) if whole else plan(_surroundings(classes, n, dtype, s), n, s)
    left, first, edges, used = classes.select("d", "c", "payload", F.lit(0.0).alias("lost")), 0, [], []
    while True:
        deep = s.enough_signs(passes)
        met = _candidates(left, window, passes, dtype, s, first, deep)
        edges.append(met.where("p is null").select("a", "b", "d"))
        more = F.get(F.array(*map(F.lit, s.lost)), F.col("d"))
        dense = cut(met.where("p is not null").groupBy(F.col("a").alias("c")).agg(F.count("*").alias("times"), F.sum(more).alias("more")))
        lost = F.col("lost") + F.col("more") + (passes - F.col("times")) * s.lost[deep]
        after = join_small(left, dense, "c", "inner").select("d", "c", "payload", lost.alias("lost"))
        after = cut(after.where(F.col("lost") > float(np.log1p(-s.recall))))
        used += [met, dense, after]
        left, first, before, n = after, first + passes, n, after.count()
        if not n:
            break
        window, passes = (n, 1) if n <= s.block else plan(_surroundings(left, n, dtype, s, first), n, s)
        if passes * (s.carry + window) >= n or passes == s.most or n > 0.9 * before:
            least = left.agg(F.min("c")).first()[0]
            edges.append(left.where(F.col("c") > least).select(F.lit(least).cast("long").alias("a"), F.col("c").alias("b"), F.lit(0).alias("d")))
            break
    return reduce(DataFrame.union, edges), used


def _groups(edges: DataFrame, classes: DataFrame, dtype: type, s: Settings) -> DataFrame:
    """(c, g): candidate groups. Edges of more differing bits than a pair at the cosine has on average must pass the exact test in groups of more than a block."""
    groups = cut(components(edges).select(F.col("node").alias("c"), F.col("component").alias("g")))
    large = cut(groups.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > s.block).select("g"))
    if large.isEmpty():
        return groups
    inside = edges.join(groups.join(large, "g", "left_semi").select(F.col("c").alias("a")), "a")
    doubt = F.col("d") > int(64 * s.words * s.differ)
    payload = classes.select("c", "payload")
    pairs = inside.where(doubt).join(payload.toDF("a", "x"), "a").join(payload.toDF("b", "y"), "b")

    def exact(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            keep = np.zeros(len(x), bool)
            same = np.array([len(p) == len(q) for p, q in zip(x, y, strict=True)], bool)
            for size in {len(x[i]) for i in np.flatnonzero(same)}:
                at = [i for i in np.flatnonzero(same) if len(x[i]) == size]
                keep[at] = (_unit([x[i] for i in at], dtype) * _unit([y[i] for i in at], dtype)).sum(1) >= s.cosine - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep))

    kept = cut(inside.where(~doubt).select("a", "b").union(pairs.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")))
    freed = components(kept).select(F.col("node").alias("c"), F.col("component").alias("g"))
    out = cut(groups.join(large, "g", "left_anti").select("c", "g").union(freed))
    discard(groups, large, kept)
    return out


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(key, n_links, component_id, kept) for each id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, have no links and
    are their own component. Equal vectors are one class and link with each other. Rows that repeat an id are one vector,
    the least by bytes. Vectors of different lengths don't link. Only key and vector are read. An empty table gives no rows.
    A link is found with a probability of about ``recall`` or more, wherever its vectors lie: the passes are counted for
    every vector, and those of which no passes are enough are compared whole, as are tables of no more different vectors
    than a block.
    """
    s = settings
    dtype = _dtype(vectors.schema[vector].dataType.elementType.simpleString() == "float")
    members = cut(_valid(vectors, key, vector, dtype).groupBy("k").agg(F.min("payload").alias("payload")).withColumn("d", F.when(F.col("k").isNotNull(), F.sha2("payload", 256))))
    classes = members.where("payload is not null and k is not null").groupBy("d").agg(F.min("k").cast("long").alias("c"), F.count("*").alias("weight"), F.first("payload").alias("payload"))
    classes = cut(classes)
    n = classes.count()
    edges, held = _all_candidates(classes, n, dtype, s)
    groups = _groups(edges, classes, dtype, s)
    sizes = cut(groups.groupBy("g").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks")))
    items = join_small(classes, groups, "c", "inner").select("g", F.col("c").alias("item"), "weight", "payload")
    units = cut(compare_in_blocks(items, sizes, _near(s.cosine, dtype)))
    links = units.groupBy(F.col("item").alias("c")).agg(F.sum("links").alias("others"))
    component = components(units.select(F.col("item").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("least"))
    found = cut(classes.select("d", "c", "weight").join(links, "c", "left").join(component, "c", "left"))
    out = join_small(members.select("k", "d"), found, "d", "left")
    n_links = F.coalesce(F.col("weight") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long")
    component_id = F.coalesce("least", "c", F.col("k").cast("long"))
    out = out.select(F.col("k").alias(key), n_links.alias("n_links"), component_id.alias("component_id"))
    discard(*held, groups, sizes, units, classes)
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
