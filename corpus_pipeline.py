"""From raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet and reads them again for the next one, which
cuts the lineage: a lost executor costs the stage at hand.

1. Quality classifier: documents that are not predicted to be of good quality go.
2. N-gram Jaccard join: of each component of near copies, the document of the smallest id stays.
3. Benchmark decontamination: documents with a passage of a benchmark item go.
4. PII: personal data in the remaining texts is replaced.
5. Packing: pieces of documents with their sequences, as ``op7_packing`` returns them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkscore.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from linkscore.storage import materialized


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.of_good_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs, pii.KEY).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("PII", replace_personal_data),
    ("packing", pack_sequences),
]

#: The first stage is a trained model; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
