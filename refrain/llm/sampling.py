"""Held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.runtime import cut


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def by_class(rows: DataFrame, label: str, keys: list[str], most: int, seed: int) -> DataFrame:
    """About ``most`` different rows of each label, chosen by a hash of ``keys``; every label's rows are counted, none is cut off by order.

    The number kept is binomial around ``most``; labels with fewer rows keep them all. ``keys`` should tell rows apart:
    rows equal in all of them, nulls included, come once. Columns of ``rows`` pass through.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each label
    keep = F.lit(False)
    u = F.pmod(F.xxhash64(F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), F.lit(1 << 20))
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (u < int((1 << 20) * min(1.0, most / n))))
    return rows.where(keep).dropDuplicates([label, *keys])


def labelled_texts(docs: DataFrame, sample: DataFrame, text: str, key: str) -> DataFrame:
    """``sample`` (k, ...) with the text of each id, as a written table; of rows that repeat an id one, the least by hash and text.

    The sample must be bounded: it is broadcast to the documents, whose texts are then read only where they are wanted.
    """
    found = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "k")
    rest = [c for c in sample.columns if c != "k"]
    found = found.groupBy("k", *rest).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return cut(found.select("k", *rest, F.col("least.text").alias("text")))
