"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm import decontaminate, mixing, ngram_join, quality, queries, token_files
from kerbflow.llm._cluster import set_aside, sized, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the upper grade reaches ``quality.KEEP``.

    Null and empty texts are judged by the thresholds alone; repeated rows stay or go together.
    """
    docs, back = set_aside(docs, ("expected_grade", "tail"))
    model = quality.fit_quality(docs, queries.quality_ratings(spark, sf_dir))
    return quality.score_quality(docs, model).where(F.col("tail") >= quality.KEEP).select(*docs.columns).withColumnsRenamed(back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the least doc_id, once.

    Texts without words stay, repeated rows once.  A row without doc_id stays unless its
    component has one with.
    """
    found = ngram_join.ngram_components(docs).where("n_shingles = 0 or doc_id <=> component_id").groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count("*").alias("__kept_rows"))
    found = written(found, "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__kept_id"))
    # by shuffle at every size, once: how many ids are kept follows the corpus; only ids of several rows are made distinct
    single = docs.join(found.where("__kept_rows = 1").hint("merge"), same, "left_semi")
    several = docs.join(sized(found.where("__kept_rows > 1")), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts hold none."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, as often as the mix takes them.

    Null and empty texts have no words to give and are not in the mix.
    """
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and each document's place in them; null texts hold the end id alone."""
    return token_files.token_digest(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
