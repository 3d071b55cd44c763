"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source that should give a share w of the mixture has a mean repetition rate r = w * rows wanted / rows it has. Every
document gets a count drawn from a Poisson distribution of mean r by inverting it at a number hashed from its id, so
the draw needs no state, is the same on every run and survives lost executors. Documents are repeated count times and
ordered by a hash, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.runtime import cut, join_small

#: A mean above this is split into equal parts, each drawn by itself: sums of Poisson counts are Poisson.
PART = 16.0
#: Terms of each inverted distribution. For a mean of PART at most, the rest has less weight than a unit of the hash.
TERMS = 96
DRAWS = 4503599627370496.0  # 2**52


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by colons: its first 13 hexadecimal digits."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / DRAWS


def _cumulative(mean: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0 .. TERMS - 1."""
    zero = F.exp(-mean)
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"), (acc["c"] + acc["p"] * mean / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / k)).alias("all")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all")), step, lambda acc: acc["all"])


def rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, total: float | None) -> DataFrame:
    """(source, rate, parts, cumulative) for each source with rows and a positive weight: its mean rate and how it is drawn.

    Without weights every source counts alike, null among them. Weights are scaled over the sources present; ``total``
    defaults to the number of rows that have one of these sources.
    """
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v and v > 0], "name string, weight double")
        counts = counts.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    sums = counts.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    rate = F.col("weight") / F.col("all_weight") * (F.lit(float(total)) if total is not None else F.col("all_rows")) / F.col("rows")
    out = counts.crossJoin(F.broadcast(sums)).select("source", rate.alias("rate"))  # sums is one row
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return out.withColumn("cumulative", _cumulative(F.col("rate") / F.col("parts")))


def counted(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """(row, id, rate, count) for every row of ``docs`` whose source has a rate: the row whole, its id as text, and the drawn count (which may be 0)."""
    table = cut(rates(docs, source, weights, total).withColumnRenamed("source", "name"))
    # The row travels as one struct, so that none of its columns can clash with those of this plan.
    rows = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"))
    rows = join_small(rows, table, F.col("source").eqNullSafe(F.col("name")), "inner")
    number = lambda part: uniform(F.lit(seed), F.col("id"), part.cast("string"))
    draw = lambda u: F.size(F.filter("cumulative", lambda c: c < u))
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), number)  # hashed once, not for each term
    drawn = F.aggregate(F.transform(numbers, draw), F.lit(0), lambda a, b: a + b)
    return rows.select("row", "id", "rate", drawn.alias("count"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, total: float | None = None, seed: str = "mix", to: str = "_copy") -> DataFrame:
    """``docs`` replicated to the target weights in a globally shuffled order, with the copy's number (from 1) added as ``to``.

    Without weights rows with a null source are a source of their own; with weights they have that of None, and rows of
    no weight go. Rows with a null id draw like an empty id; repeated rows draw the same count each. An empty table stays
    empty. All input columns keep their names and values, whatever they are called; one called ``to`` is refused. The
    order is by MD5 of seed, id and copy, then id and copy.
    """
    if to in docs.columns:
        raise ValueError(f"the documents have a column {to}; name another with to=")
    rows = counted(docs, key, source, weights, total, seed).where("count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    place = F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.col("id"), F.col("copy").cast("string")))
    return rows.orderBy(place, "id", "copy").select("row.*", F.col("copy").alias(to))
