"""The llm queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import chat_format, common, decontamination, quality_rules, source_divergence, vector_codes


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.decontamination import matches

    return matches(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.simhash_dedup import near_duplicates

    return near_duplicates(common.read_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.token_output import read_tokens, write_tokens

    path = common.scratch_path(spark, "tokens")
    write_tokens(common.read_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.suffix_dedup import report

    return report(common.read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.token_counts import token_counts

    return token_counts(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.packing import pack

    return pack(common.read_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.sharding import sharded_documents

    return sharded_documents(common.read_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.html_text import extract

    out = extract(common.read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.toxicity import score, train

    docs = common.read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read_table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.quality_rules import verdicts

    return verdicts(common.read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(common.read_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(chat_format.PROBE_ID, i, r, chat_format.PROBE) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    path = common.scratch_path(spark, "chat")
    chat_format.write_formatted(talks.unionByName(probe), path)
    return chat_format.digests(chat_format.read_formatted(spark, path))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(common.read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_simhash_near_dedup, op3_token_output, op4_suffix_dedup, op5_token_counts, op6_packing, op7_sharding, op8_html_extraction, op9_toxicity, op10_quality_rules, op11_source_divergence, op12_chat_format, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.oracle_sql(),
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op11_source_divergence": source_divergence.oracle_sql(),
    "op12_chat_format": chat_format.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
