"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept. All but the last return the columns
of ``documents``. Ids may be null or repeat: a row without an id can't be linked
to others and stays in the deduplication of near copies; rows that share an id
share the decision on it, but of rows equal in id and text one stays. Empty
tables pass through. Columns beside doc_id, text, lang and source only travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeveil.llm import exact_dedup, minhash, packing, quality_model, queries, simhash
from lakeveil.llm.common import materialize, table, unwrapped, wrapped


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.7, the threshold of ``predicted``; null and empty texts score by the bias alone, repeated rows alike."""
    scored = quality_model.score_documents(docs, table(spark, sf_dir, "labels"), keep_columns=True)
    return unwrapped(scored.where("score >= 0.7"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; null and empty texts are equal."""
    found = materialize(exact_dedup.exact_dedup(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept"), "exact")
    rows = wrapped(docs).withColumn("text_sha", F.sha2(exact_dedup.normalised(F.col("row.text")), 256))
    keep = found.where("kept").select("id", "sha")
    left = rows.join(keep, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha") == F.col("sha")), "left_semi")
    if not found.groupBy("id", "sha").count().where("count > 1").isEmpty():
        left = left.withColumn("row_id", F.col("row.doc_id")).dropDuplicates(["row_id", "text_sha"])
    return unwrapped(left, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts whose five-word shingles have a Jaccard coefficient of 0.8 or more.

    Near copies are found by SimHash, through the operator of ``op2_simhash``: the
    members of each of its components are compared by their exact sets. Most pairs
    near 0.8 differ in more bits than it covers; these are found by MinHash bands.
    A null or blank text is one empty shingle; rows with a null id stay.
    """
    prints = simhash.near_duplicates(docs.where("doc_id is not null").select("doc_id", "text"), shingle=5)
    alike = prints.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.lit("simhash"), "component_id").alias("key"))
    later = minhash.later_copies(docs, found=alike)
    return unwrapped(wrapped(docs).join(later, F.col("row.doc_id") == F.col("doc_id"), "left_anti"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the budget of each domain, language and source reaches, the document at its end whole; one epoch at most. A null language or source is one of its own, null texts have no tokens."""
    levels = queries.mixture_levels()
    taken = queries.mix(docs, epochs=1).where("copies > 0 or taken > 0").select(F.col("doc_id").alias("id"), *[F.col(k).alias(f"its_{k}") for k in levels]).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[F.coalesce(c.cast("string"), F.lit("")).alias(f"at_{k}") for k, c in levels.items()])
    on = F.col("row.doc_id").eqNullSafe(F.col("id"))
    for k in levels:
        on = on & (F.col(f"at_{k}") == F.col(f"its_{k}"))
    return unwrapped(rows.join(taken, on, "left_semi"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of 2048 tokens; null texts are the end alone, repeated rows pieces of their own."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("packing", pack)]

#: SQL can't express the classifier; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
