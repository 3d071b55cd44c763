"""The registered queries of this subpackage and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import editprint, jaccard, language, mixing, personal, pieces, quality, relative, toxicity, vectors
from refrain.llm.sampling import held_out


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.train(docs.where(~held_out()))
    out = language.identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows that may be learned from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = quality.score(docs, quality.train(docs, _labels(spark, sf_dir)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source an equal share of as many rows as there are; a row for each copy, in shuffled order."""
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", F.col("_copy").cast("long").alias("copy"))


OP4_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT sum(rows) FROM n)::DOUBLE / rows AS rate FROM n),
q AS (SELECT source, greatest(1, ceil(rate / {mixing.PART}))::INT AS parts, rate / greatest(1, ceil(rate / {mixing.PART})) AS mean FROM r),
terms AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM q
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k + 1 < {mixing.TERMS}),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM terms GROUP BY source),
u AS (SELECT doc_id, documents.source, unnest(range(1, parts + 1)) AS part FROM documents JOIN q ON documents.source IS NOT DISTINCT FROM q.source),
drawn AS (SELECT doc_id, u.source, sum(len(list_filter(cs, lambda c: c < (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT::DOUBLE + 0.5) / {mixing.DRAWS}))) AS n
  FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id, u.source)
SELECT doc_id, source, unnest(range(1, n::BIGINT + 1)) AS copy FROM drawn WHERE n > 0
"""


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links, min(reach.b) AS component_id, v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_documents(spark, sf_dir), pieces.load())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.with_copies(_documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relative.deduplicate(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS MATERIALIZED (SELECT h, min(doc_id) AS lo FROM p GROUP BY h),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT p.doc_id, p.i FROM p JOIN m ON p.h = m.h WHERE lo < p.doc_id), (SELECT unnest(range(50)) AS j)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.i) AS t, count(*) AS n FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY each.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(_documents(spark, sf_dir))
    count = lambda spans, kind: F.size(F.filter(F.split(spans, ","), lambda s: s.startswith(kind))).cast("long")
    base = (count("base", k + ":").alias(f"n_{k}") for k in personal.BASE)
    more = (count("spans", "secret:").alias("n_secret"), F.size(F.filter(F.split("spans", ","), lambda s: s != "")).cast("long").alias("n_spans"))
    return found.select("doc_id", *base, F.sha2("base", 256).alias("base_sha256"), "spans", *more)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b, m = na.n AND m = nb.n AS same FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 9 * m >= 4 * (na.n + nb.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, least(w.doc_id, (SELECT min(b) FROM links WHERE a = w.doc_id AND same)) AS class_id, (SELECT count(*) FROM links WHERE a = w.doc_id)::BIGINT AS n_links,
  min(reach.b) AS component_id, w.doc_id = min(reach.b) AS kept
FROM w JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""

QUERIES = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_vectors": op5_vectors,
    "op6_pieces": op6_pieces,
    "op7_fingerprints": op7_fingerprints,
    "op8_substrings": op8_substrings,
    "op9_personal": op9_personal,
    "op10_jaccard": op10_jaccard,
}
ORACLES = {"op4_mixing": OP4_SQL, "op5_vectors": OP5_SQL, "op8_substrings": OP8_SQL, "op10_jaccard": OP10_SQL}
