"""Document fingerprints by randomised edit embedding.

A random walk reads a text from left to right. At every step it looks at the character under it and moves on by one or
two, as a shared random function of step number and character says. Two texts that differ by few edits are read by walks
that, after each edit, fall into step again after a short while and then see the same characters at the same steps: the
texts' edit distance has become a Hamming distance between what the walks saw.

A fingerprint samples that embedding. Two walks of their own randomness are taken. Each of a walk's slots gives every step a random rank, shared by all texts, and
keeps what was seen at the least-ranked step of the walk: a byte hashed from the characters there. Texts of equal
walks have equal slots; a text that is longer or shorter keeps most. The likeness of two fingerprints is the
share of equal slots, less what chance gives. Bands of sampled slots find candidate pairs, the likeness verifies them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import mix, slices
from refrain.llm.blocks import compare_in_blocks
from refrain.llm.components import components
from refrain.runtime import cut, discard


@dataclass(frozen=True)
class Settings:
    walks: int = 2
    slots: int = 32  # of each walk
    context: int = 4  # characters hashed into a slot's byte
    bands: int = 10
    rows: int = 3  # slots of a band
    alike: float = 0.7  # least likeness of near copies
    seed: int = 71


#: With fewer walks than this left, they are taken one after another.
FEW = 24
#: Steps after which the moves repeat.
PERIOD = 1 << 15


class _Plan:
    """Shared randomness: the moves of each step, and at which steps which slots have a new least rank."""

    def __init__(self, s: Settings, walk: int):
        self.s, self.steps, self.seed = s, 0, s.seed + 2 * walk
        self.moves = np.zeros((0, 256), np.uint8)
        self.records: dict[int, np.ndarray] = {}
        self.least = np.full(s.slots, 2**64 - 1, np.uint64)
        self._sorted, self._sorted_at, self._rows = [], 0, []

    def upto(self, steps: int) -> None:
        """Extend the plan; what was fixed before stays as it is."""
        while self.steps < steps:
            lo, hi = self.steps, self.steps + 4096
            at = np.arange(lo, hi, dtype=np.uint64)
            ranks = mix(at[:, None] * np.uint64(4096) + np.arange(self.s.slots, dtype=np.uint64), self.seed + 1)
            before = np.minimum.accumulate(np.vstack([self.least[None], ranks]), axis=0)[:-1]
            step, slot = np.nonzero(ranks < before)
            for k in np.unique(step):
                self.records[lo + int(k)] = slot[step == k]
            self.least = np.minimum(self.least, ranks.min(0))
            self.steps = hi

    def next_record(self, step: int) -> int | None:
        """The first step from ``step`` on, within the plan's present end, at which a slot changes; the plan is extended past ``step``."""
        self.upto(step + 1)
        if self._sorted_at != self.steps:
            self._sorted, self._sorted_at = sorted(self.records), self.steps
        k = bisect_left(self._sorted, step)
        return self._sorted[k] if k < len(self._sorted) else None

    def move_bytes(self, step: int) -> bytes:
        """As ``move``, for a loop in Python."""
        step &= PERIOD - 1
        if step >= len(self._rows):
            self.move(step)
            self._rows += [self.moves[k].tobytes() for k in range(len(self._rows), len(self.moves))]
        return self._rows[step]

    def move(self, step: int) -> np.ndarray:
        """One or two for each of 256 character codes at this step; the table repeats after PERIOD steps."""
        step &= PERIOD - 1
        while step >= len(self.moves):
            lo = len(self.moves)
            at = np.arange(lo, lo + 2048, dtype=np.uint64)[:, None] * np.uint64(256) + np.arange(256, dtype=np.uint64)
            self.moves = np.vstack([self.moves, (mix(at, self.seed) >> np.uint64(63)).astype(np.uint8) + 1])
        return self.moves[step]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each code point of all texts, and each text's first."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return ((points ^ (points >> 8) * 31 ^ (points >> 16)) & 255).astype(np.uint8), first


def plans(s: Settings) -> list[_Plan]:
    return [_Plan(s, w) for w in range(s.walks)]


def fingerprints(texts: list[str], shared: list[_Plan]) -> np.ndarray:
    """A row of bytes for each text, all walks' slots in turn; an empty text's are all 0, others' are 1 to 255."""
    codes, first = _codes(texts)
    if not len(codes):
        return np.zeros((len(texts), sum(p.s.slots for p in shared)), np.uint8)
    seen, context = np.zeros(len(codes), np.uint32), shared[0].s.context
    for k in range(context):
        seen[: len(codes) - k] = seen[: len(codes) - k] * np.uint32(0x01000193) + codes[k:] + np.uint32(1)
    # What lies past a text's end must not count: the last characters are hashed again with what is there.
    for k in range(1, context):
        at = first[1:][np.diff(first) >= k] - k
        value = np.zeros(len(at), np.uint32)
        for m in range(k):
            value = value * np.uint32(0x01000193) + codes[at + m] + np.uint32(1)
        seen[at] = value
    seen = (((seen * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)
    return np.hstack([_walk(codes, first, seen, p) for p in shared])


def _walk(codes: np.ndarray, first: np.ndarray, seen: np.ndarray, plan: _Plan) -> np.ndarray:
    """What one walk leaves in its slots, for all texts at once as long as many are left."""
    out = np.zeros((len(first) - 1, plan.s.slots), np.uint8)
    order = np.argsort(-np.diff(first), kind="stable")
    active = order[np.diff(first)[order] > 0]
    at, end = first[active].copy(), first[active + 1]
    step = 0
    while len(active) >= FEW:
        plan.upto(step + 1)
        slots = plan.records.get(step)
        if slots is not None:
            out[active[:, None], slots] = seen[at][:, None]
        at += plan.move(step)[codes[at]]
        step += 1
        on = at < end
        if not on.all():
            active, at, end = active[on], at[on], end[on]
    for text, where, stop in zip(active.tolist(), at.tolist(), end.tolist(), strict=True):
        _walk_on(out[text], codes[where:stop].tobytes(), seen[where:stop], step, plan)
    return out


def _walk_on(own: np.ndarray, data: bytes, seen: np.ndarray, step: int, plan: _Plan) -> None:
    """The rest of one walk from ``step`` on, without numpy's cost of a call for each step."""
    i, n = 0, len(data)
    while i < n:
        stop = plan.next_record(step)
        until = stop if stop is not None else plan.steps  # records past the plan's end are not known yet
        while step < until and i < n:
            i += plan.move_bytes(step)[data[i]]
            step += 1
        if i < n and step == stop:
            own[plan.records[step]] = seen[i]
            i += plan.move_bytes(step)[data[i]]
            step += 1


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots of fingerprint rows, corrected for chance, 0 to 1."""
    return np.clip(((a == b).mean(1) - 1 / 255) / (1 - 1 / 255), 0, 1)


#: Bytes of text whose walks are taken together.
TOGETHER = 4_000_000
_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(keys: pa.Array, texts: list[str], after: list[str], own: np.ndarray, next_: np.ndarray, shared: list[_Plan]) -> list[pa.Array]:
    """Result columns for texts with the fingerprints ``own``, each followed by a document with text ``after`` and fingerprint ``next_``."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
    other = fingerprints(edited, shared)
    return [
        keys,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([x.tobytes().hex() for x in own], pa.string()),
        pa.array([x.tobytes().hex() for x in other], pa.string()),
        pa.array(likeness(own, other), pa.float64()),
        pa.array(likeness(own, next_), pa.float64()),
    ]


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """For every row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document's in ascending order of id, after the last the first. Ids are of any type that orders. Null texts
    are empty, null ids come first; rows that repeat an id follow each other in order of a hash of the text. A lone
    document is its own next. The likeness of two empty texts is 1. An empty table gives no rows.

    Documents are ordered by one shuffle, on ranges of id and hash, so that no id makes a partition large. Each partition
    is read as a stream; its last document meets the next partition's first in a second step over those alone, a pair for
    each partition. A text is held in memory whole, with some numbers for each character.
    """
    s = settings
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", *(c.split()[0] for c in _RESULT.split(", ")), "pid", "last", "t"]

    def run(batches):
        shared, pid = plans(s), TaskContext.get().partitionId()
        held = None  # the row read last, whose successor is to come

        def end(row, last):
            nothing = [pa.nulls(1, f.type) for f in result_types]
            return pa.RecordBatch.from_arrays([row.column("k"), *nothing, pa.array([pid], pa.int32()), pa.array([last]), row.column("t")], names)

        result_types = [pa.field("", t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)]
        for batch in batches:
            for part, _ in slices(batch, "t", TOGETHER):
                if held is None:
                    yield end(part.slice(0, 1), False)
                    rows = part
                else:
                    rows = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                held, n = rows.slice(rows.num_rows - 1), rows.num_rows - 1
                if n:
                    texts = rows.column("t").to_pylist()
                    own = fingerprints(texts, shared)
                    columns = _compared(rows.column("k").slice(0, n), texts[:-1], texts[1:], own[:-1], own[1:], shared)
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.string()))], names)
        if held is not None:
            yield end(held, True)

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    found = cut(ordered.mapInArrow(run, f"k {kind}, {_RESULT}, pid int, last boolean, t string"))
    ends = found.where("pid is not null").select("k", "pid", "last", "t")
    used = sorted(r["pid"] for r in ends.where("last").select("pid").collect())  # a number for each partition
    follows = docs.sparkSession.createDataFrame([(p, used[(i + 1) % len(used)]) for i, p in enumerate(used)], "pid int, next int")
    first = ends.where("not last").select(F.col("pid").alias("next"), F.col("t").alias("after"))
    pairs = ends.where("last").join(F.broadcast(follows), "pid").join(first, "next").select("k", "t", "after")

    def over(batches):
        shared = plans(s)
        for batch in batches:
            for part, _ in slices(batch, "t", TOGETHER):
                texts, after = part.column("t").to_pylist(), part.column("after").to_pylist()
                prints = fingerprints(texts + after, shared)
                yield pa.RecordBatch.from_arrays(_compared(part.column("k"), texts, after, prints[: len(texts)], prints[len(texts) :], shared), names[:7])

    return found.where("pid is null").select(*names[:7]).union(pairs.mapInArrow(over, f"k {kind}, {_RESULT}")).toDF(key, *names[1:7])


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, print) for every row, the fingerprint as bytes; a null text counts as empty."""

    def run(batches):
        shared = plans(settings)
        for batch in batches:
            for part, _ in slices(batch, "t", TOGETHER):
                prints = fingerprints([t or "" for t in part.column("t").to_pylist()], shared)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([p.tobytes() for p in prints], pa.binary())], ["k", "print"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, print binary").toDF(key, "print")


def linked_prints(prints: DataFrame, key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """(key, class_id, component_id) for each id of (key, print): equal fingerprints are a class, verified likeness links classes.

    Each band hashes some sampled slots. Only bands that two classes share are gone into: their classes meet in blocks,
    so a large band is no one task's, and are linked if the likeness of their whole fingerprints is ``alike`` or more.
    Of a pair at likeness x all bands miss a share of (1 - x**rows)**bands. Fingerprints of nothing and rows with a null
    id stay alone; rows that repeat an id are one document, that of the least fingerprint. Ids are integers.
    """
    s = settings
    members = cut(prints.select(F.col(key).cast("long").alias("k"), "print").groupBy("k").agg(F.min("print").alias("print")))
    zero = bytearray(s.walks * s.slots)
    classes = cut(members.where((F.col("print") != F.lit(zero)) & F.col("k").isNotNull()).groupBy("print").agg(F.min("k").alias("c")))
    rng = np.random.default_rng(s.seed)
    sampled = [rng.choice(s.walks * s.slots, s.rows, replace=False) for _ in range(s.bands)]
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.substring("print", int(i) + 1, 1) for i in at)) for b, at in enumerate(sampled)))
    rows = classes.select(F.explode(bands).alias("g"), "c")
    groups = cut(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / 512).cast("int").alias("blocks")))
    met = rows.join(groups.select("g"), "g").join(classes.select("c", F.col("print").alias("payload")), "c")  # fingerprints travel only where classes met
    met = met.select("g", F.col("c").alias("item"), F.lit(1).cast("long").alias("weight"), "payload")

    def similar(left, right):
        a, b = (np.stack([np.frombuffer(p, np.uint8) for p in side]) for side in (left, right))
        return np.stack([likeness(np.broadcast_to(x, b.shape), b) >= s.alike for x in a])

    pairs = cut(compare_in_blocks(met, groups, similar).where("item <> root").select(F.col("item").alias("a"), F.col("root").alias("b")).distinct())
    linked = components(pairs).select(F.col("node").alias("c"), F.col("component").alias("least"))
    found = cut(classes.join(linked, "c", "left"))
    out = members.withColumn("print", F.when(F.col("k").isNotNull(), F.col("print"))).join(found, "print", "left")
    discard(groups, pairs, classes)
    return out.select(F.col("k").alias(key), F.coalesce("c", "k").alias("class_id"), F.coalesce("least", "c", "k").alias("component_id"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, class_id, component_id) for each id, by ``linked_prints`` of the documents' fingerprints. Empty and null texts stay alone."""
    return linked_prints(fingerprint_documents(docs, key, text, settings), key, settings)


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``with_edited`` with class_id and component_id of ``linked_prints``, from the same fingerprints; null ids have neither."""
    edited = cut(with_edited(docs, key, text, settings))
    linked = linked_prints(edited.select(key, F.unhex("fingerprint").alias("print")), key, settings)
    linked = linked.where(F.col(key).isNotNull()).withColumnRenamed(key, "k")
    return edited.join(linked, edited[key].cast("long") == linked["k"], "left").drop("k")
