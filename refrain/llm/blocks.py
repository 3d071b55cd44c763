"""All-pairs comparison inside groups, cut into blocks so that no task holds more than a bounded part of a group.

A group of n items is dealt into blocks by a hash of the item; every pair of blocks is one unit of work, of at most two
blocks' rows and cost. What comes back is linear in the items: for each item its number of links in that unit (weighted),
and a spanning forest of the links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.arrowtext import grouped_stream
from refrain.runtime import join_small


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node reachable over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def compare_in_blocks(items: DataFrame, groups: DataFrame, similar: Callable[[list, list], np.ndarray]) -> DataFrame:
    """(item, links, root) for the items of each group, one row for each unit in which the item has a link.

    A task holds two blocks: payloads, and a matrix of their products. A single payload, however large, is held whole.
    items: g long, item long, weight long, payload binary. groups, made by ``cut``: g long, blocks int.
    ``similar`` gets the payloads of both sides and returns a matrix of booleans. ``links`` sums the weights of linked
    items; ``root`` is an item linked with this one in the same unit, possibly over others. An item that comes twice counts once.
    """
    dealt = join_small(items, groups, "g", "inner")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "item"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "item", "weight", "payload")

    def work(table: pa.Table) -> pa.Table | None:
        item, at = np.unique(table.column("item").to_numpy(), return_index=True)
        if len(item) < 2:
            return None
        own, weight = table.column("own").to_numpy()[at], table.column("weight").to_numpy()[at]
        payload = table.column("payload").take(pa.array(at)).to_pylist()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return None
        linked = similar([payload[x] for x in left], [payload[x] for x in right])
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(item), np.int64)
        for lo in range(0, len(left), 256):  # a matrix of booleans is widened for the product, so some rows at a time
            links[left[lo : lo + 256]] += linked[lo : lo + 256] @ weight[right]
            if i != j:
                links[right] += weight[left[lo : lo + 256]] @ linked[lo : lo + 256]
        a, b = np.nonzero(linked)
        root = forest(len(item), left[a], right[b])
        keep = np.flatnonzero(links)
        return pa.table({"item": item[keep], "links": links[keep], "root": item[root[keep]]})

    return grouped_stream(dealt, ["g", "i", "j"], ["item"], work, "item long, links long, root long")
