"""Bounded-memory parsing of unbounded streams: the dictionary of each stream is state between micro-batches."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from refrain.operators.dictionaries import ROOT, FrequentPrefixes, RecentPrefixes
from refrain.operators.phrases import SCHEMA, Phrases, TRIE, NODE


def stream_lz78(chunks: DataFrame, k: int, max_freq: int = 1 << 10, evict: str = "frequency") -> DataFrame:
    """Phrases of streams that arrive as chunks: stream_id long, chunk long, bytes binary, last boolean.

    Chunks of one micro-batch are taken in order of ``chunk``; batches must not arrive out of order. A chunk marked
    ``last`` ends its stream: the open phrase comes out and the state goes. Phrases equal those of the batch parser over
    the joined chunks. A null chunk is empty. State is one dictionary of at most k entries for each open stream.
    """

    def run(key, frames, state: GroupState):
        if state.exists:
            dictionary, node, length, seq, pos = pickle.loads(state.get[0])
        else:
            dictionary = FrequentPrefixes(k + 1, max_freq) if evict == "frequency" else RecentPrefixes(k)
            node, length, seq, pos = ROOT, 0, 0, 0
        rows = pd.concat(list(frames)).sort_values("chunk")
        out = Phrases()
        out.start(int(key[0]))
        out.seq, out.pos = seq, pos
        for data in rows["bytes"]:
            for c in data or b"":
                child = dictionary.extend(node, c)
                if child < 0:
                    out.add(NODE, length + 1, node=dictionary.name(node), literal=c)
                    node, length = ROOT, 0
                else:
                    node, length = child, length + 1
        if rows["last"].any():
            if length:
                out.add(TRIE, length, node=dictionary.name(node))
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps((dictionary, node, length, out.seq, out.pos)),))
        yield out.batch().to_pandas()

    return chunks.groupBy("stream_id").applyInPandasWithState(run, SCHEMA, "state binary", "append", GroupStateTimeout.NoTimeout)
