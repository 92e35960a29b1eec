"""Registered queries of the operators, each over its whole table with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweek.llm import (
    chunk_prints,
    decontaminate,
    hmm,
    html_text,
    licenses,
    line_dedup,
    raking,
    secret_scan,
    simhash,
    spelling,
    topk_search,
    toxicity,
    treap_search,
)
from cellweek.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = raking.mix(docs, mixing_columns())
    return mixed.select("doc_id", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


def mixing_columns() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.form_topic()}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(toxicity.learns(F.col("doc_id")))
    scored = toxicity.score_texts(docs, toxicity.train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (~toxicity.learns(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_prints.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("consistent", F.round("consistent", 6))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"), least_letters=5, least=3, modulus=97)


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_hmm": op2_hmm,
    "op3_licenses": op3_licenses,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op6_mix_sources": op6_mix_sources,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_decontaminate": op9_decontaminate,
    "op10_main_text": op10_main_text,
    "op11_topk_search": op11_topk_search,
    "op12_spelling": op12_spelling,
    "op13_treap_search": op13_treap_search,
}
