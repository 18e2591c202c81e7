"""Queries that apply each operator to its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from corpusloom.llm import pii, piece_coding, secrets, source_audit, sqltext, toxicity, vector_codes
from corpusloom.llm.chat_collapse import collapsed
from corpusloom.llm.decontaminate import benchmark_passages
from corpusloom.llm.exact_dedup import exact_duplicates
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.substring_dedup import without_repeats
from corpusloom.llm.url_filter import Rule, judged
from corpusloom.queries import Query

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), payload="ids_crc32")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "pages"), RULES)


def _digested(found: DataFrame, base: list[str], as_text) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans."""
    of = lambda names: F.filter("spans", lambda s: s["kind"].isin(names))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(as_text(of(base)), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    return _digested(found, [k.name for k in pii.KINDS if k.base], pii.as_text)


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return collapsed(table(spark, folder, "conversations"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return _digested(found, ["assign", "access", "hex"], secrets.as_text)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a null text or id stay; see `piece_coding.encoded`."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_coding.decoded(piece_coding.encoded(table(spark, folder, "documents"), model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that are null or not finite are left out; see `vector_codes.compressed`."""
    coded, book = vector_codes.compressed(table(spark, folder, "embeddings"))
    hexed = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    found = vector_codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(vector_codes.codebook_digest(book)))
    return found.select("vec_id", hexed.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls are empty strings; see `source_audit.divergence`."""
    return source_audit.divergence(table(spark, folder, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": Query(op1_minhash_near_dedup, sqltext.NEAR_DEDUP),
    "op2_packing": Query(op2_packing, None),
    "op3_url_filter": Query(op3_url_filter, sqltext.URL_FILTER),
    "op4_pii": Query(op4_pii, None),
    "op5_exact_dedup": Query(op5_exact_dedup, sqltext.EXACT_DEDUP),
    "op6_chat_format": Query(op6_chat_format, sqltext.CHAT_FORMAT),
    "op7_secrets": Query(op7_secrets, None),
    "op8_substring_dedup": Query(op8_substring_dedup, sqltext.SUBSTRING_DEDUP),
    "op9_toxicity": Query(op9_toxicity, None),
    "op10_decontamination": Query(op10_decontamination, None),
    "op11_pieces": Query(op11_pieces, None),
    "op12_vector_codes": Query(op12_vector_codes, sqltext.VECTOR_CODES),
    "op13_source_audit": Query(op13_source_audit, sqltext.SOURCE_AUDIT),
}
