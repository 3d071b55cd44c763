"""A pipeline over ``documents`` in stages, each applying one operator of refrain.llm and writing its rows.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents. Rows with a null text pass through every filter; rows with a null id are never near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import jaccard, mixing, personal, pieces, toxicity
from refrain.llm.sampling import held_out
from refrain.runtime import cut, discard, join_small, prepare, tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones outside the held-out fold, scores 0.7 or more go."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return toxicity.reject(docs.select(*COLUMNS), toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more, the one of least id stays, and of a repeated id one row."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    found = jaccard.similar_documents(docs)
    gone = cut(found.where("not kept and doc_id is not null").select("doc_id"))
    out = join_small(docs, gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        discard(repeated)
        return out
    once = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return out.join(repeated, "doc_id", "left_anti").union(once)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows."""
    prepare(spark)
    return personal.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source, none included, gets an equal expected share of as many rows as there are, in a globally shuffled order."""
    prepare(spark)
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every row; null ids for a null text."""
    prepare(spark)
    out = pieces.encode(docs.select("doc_id", "source", "text"), pieces.load())
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("personal", hide_personal),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Learned scores and Viterbi searches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is written to the shared folder and read again.

    Tables that a stage wrote for itself, and its input if a stage made it, are deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with tables() as made:
            after = cut(stage(spark, docs, sf_dir))
            made.remove(after)
        discard(docs)
        docs = after
    return docs
