"""Connected components of an edge table by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.blocks import forest
from refrain.runtime import cut, discard

#: Edges up to which one task does it all at once; a table of more is worked on by rounds.
FEW = 20_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: link each larger neighbour to the least node near by. Small: link smaller ones and the node itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Written first: then both sides of the join start at an exchange, where the rows of a node with many edges can be split.
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
    joined = both.join(least, both["a"] == least["u"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = cut(out.where("a <> b").distinct())
    discard(least)
    return out


def _at_once(edges: DataFrame) -> DataFrame:
    """The same for at most FEW edges, in one task."""

    def work(batches):
        a, b = (np.concatenate([x, *y]) for x, *y in zip([np.zeros(0, np.int64)] * 2, *([c.to_numpy() for c in batch.columns] for batch in batches), strict=True))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        if len(nodes):
            root = forest(len(nodes), place[: len(a)], place[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return edges.repartition(1).mapInArrow(work, "node long, component long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Edges with a null end or equal ends link nothing; repeated edges count once; no edges give an empty table.
    Each round is written to the shared folder; the rounds needed grow with the logarithm of the longest chain.
    """
    now = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    if now.count() <= FEW:
        return _at_once(now)
    seen = None
    while True:
        large = _star(now, large=True)
        after = _star(large, large=False)
        discard(now, large)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
