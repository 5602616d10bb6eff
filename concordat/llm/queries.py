"""The operators as queries over the given tables: (session, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import chat_format, exact_dedup, heap_clusters, mixing, ngram_join, ordinal_quality, packing, power_packing, repetition, secret_scan, sketch_search, token_counts, warc
from concordat.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.emitted(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_quality.score(docs, ordinal_quality.train(docs, table(spark, sf_dir, "labels")))


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    turns = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), turns.alias("t")).select("conv_id", "t.turn", "t.role", said.alias("text"))
    events = chat_format.conversation_events(rows.unionByName(added))
    return chat_format.digests(chat_format.render(chat_format.fold_events(events)))


def op11_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power_packing.pack(table(spark, sf_dir, "documents"))


def op13_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_warc": op2_warc,
    "op3_source_mixing": op3_source_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_separator_scan": op7_separator_scan,
    "op9_repetition_rules": op9_repetition_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_sketch_search": op11_sketch_search,
    "op12_power_of_two_packing": op12_power_of_two_packing,
    "op13_heap_clusters": op13_heap_clusters,
}
