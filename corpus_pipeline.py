"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

Every stage but the last returns the columns of ``documents``.  Defined cases are those of the
operators; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import language, mixing, ngram_join, phrase_index, token_files
from ledgerspark.llm.common import small, staged
from ledgerspark.llm.queries import tokenizer_path

# the best language must be likelier than all others together
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model knows; without any to learn, keep all."""
    model = language.train(docs)
    if not model.languages:
        return docs
    judged = language.identify(docs, model, "_lang_found", "_lang_score")
    known = (F.col("_lang_found") != language.UNKNOWN) & (F.col("_lang_score") >= LEAST_SCORE)
    return judged.where(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group; equal rows count once.

    Texts without words are in no group and stay.
    """
    groups = staged(ngram_join.near_duplicates(docs).where("group is not null"))
    row = F.struct("doc_id", "tag")
    firsts = groups.groupBy(F.col("group").alias("_group")).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    many = groups.join(small(staged(firsts.where("_n > 1"))), F.col("group") == F.col("_group"))
    later = staged(many.where(row > F.col("_first")).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct())
    equal = staged(many.where(row == F.col("_first")).groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).count().where("count > 1"))
    tag = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (tag == F.col("_tag"))
    kept = docs.join(small(later), same, "left_anti")
    # a row that stands several times, text included; all others need no comparison
    again = small(equal.select("_id", "_tag"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").union(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = phrase_index.contamination(docs, items).where("contaminated")
    hit = staged(hit.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tag"))
    return docs.join(small(hit), same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut documents so that the sources come near their target shares."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what they hold of each document."""
    return token_files.read_documents(token_files.write_sequences(docs, tokenizer_path()))


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mix sources", mix_sources),
    ("token files", write_tokens),
]

# the first stage is a trained model and the last one runs a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
