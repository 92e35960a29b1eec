"""Training-corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents; n_chars follows the text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweek.llm import decontaminate, line_dedup, raking, simhash, toxicity
from cellweek.llm.common import materialize, read_table
from cellweek.llm.queries import mixing_columns


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the fitted model calls toxic."""
    labels = read_table(spark, sf_dir, "labels").where(toxicity.learns(F.col("doc_id")))
    scored = toxicity.score_texts(docs, toxicity.train(docs, labels))
    return scored.where("predicted = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least ten documents share."""
    kept = line_dedup.drop_repeated_lines(docs, min_docs=10, min_chars=1)
    kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs, shingle=3, max_bits=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by raked weights, with n_tokens, weight and probability."""
    return raking.mix(docs, mixing_columns())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


# The classifier and the fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None
