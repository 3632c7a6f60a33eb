"""From documents to packed batches of clean, distinct and mixed text.

Each stage takes ``(spark, docs, sf_dir)``; ``docs`` has the columns of documents. The toxicity and
mixing stages learn from the ``labels`` table of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import mixing, neardup, packing, pii, toxicity
from passagework.llm.queries import MIX_TARGETS, PACK, PII_KEY
from passagework.session import materialize, ship_package, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def same_row(docs: DataFrame, decided: DataFrame) -> Column:
    """Decisions belong to an id and a text: ids may be null or repeated."""
    return docs["doc_id"].eqNullSafe(decided["_id"]) & (F.xxhash64(docs["text"]) == decided["_hash"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.3 or more.

    Null and empty texts score like any clean text and stay, repeated rows stay or go together, other rows of an id are
    judged on their own; an empty table gives no row.
    """
    ship_package(tune(spark))
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3, text_hash="_hash")
    toxic = scored.where("predicted = 1").select(F.col("doc_id").alias("_id"), "_hash").distinct()
    return docs.join(toxic, same_row(docs, toxic), "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Of rows with one id and one text the first stays; such rows alone are gone through once more. Null, empty and blank
    texts have no shingles, link with nothing and stay; an empty table gives no row.
    """
    ship_package(tune(spark))
    groups = neardup.near_duplicates(docs, shingle=5, share=(80, 100), text_hash="_hash")
    kept = groups.where("kept").groupBy(F.col("doc_id").alias("_id"), "_hash").agg(F.count("*").alias("_rows"))
    stay = docs.join(kept, same_row(docs, kept))
    once = stay.where("_rows = 1").select(*COLUMNS)
    return once.unionByName(stay.where("_rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for personal data; ``n_chars`` counts anew.

    A null text stays null, empty ones empty; every row stays, repeated or not; an empty table gives no row.
    """
    tune(spark)
    out = pii.replace_personal_data(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its copies say, which brings the quality classes to their weights.

    A row's rate follows from its id and text, so rows of one id with other texts keep their own. Null and empty texts have no tokens and the
    rate of their posterior; repeated rows are mixed each; an empty table gives no row.
    """
    tune(spark)
    rates = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", MIX_TARGETS, text_hash="_hash")
    copies = rates.groupBy(F.col("doc_id").alias("_id"), "_hash").agg(F.max("copies").alias("_copies"))
    joined = docs.join(copies, same_row(docs, copies)).where("_copies > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in its bucket's batches.

    Null and empty texts have no tokens and take a place like others; repeated rows take one each; an empty table gives no row.
    """
    tune(spark)
    return packing.pack(docs, **PACK)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_domains),
    ("packing", pack_batches),
]
# Aho-Corasick scores, sketches and fitted rates have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage is written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
