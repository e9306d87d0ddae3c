"""Queries of the corpus operators, each over its whole table, and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality_rules
from .best_fit_packing import pack_documents
from .html_text import extract_text
from .jaccard_join import near_duplicates
from .secret_scan import find_secrets, spans_text
from .shared import shared_folder, table
from .substring_dedup import remove_repeats
from .spaced_seeds import contaminated
from .token_files import ids_crc32, read_tokens, write_tokens
from .toxicity import toxicity
from .warc import archived


def op1_substring_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op2_secret_scan(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.sha2(spans_text(F.col("spans"), ("assign", "access", "hex")), 256)
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), base.alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), count("guess").alias("n_guess"))


def op3_token_files(spark, sf_dir):
    path = shared_folder(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return ids_crc32(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("content")


def op5_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_spaced_seeds(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_words")


def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    found = archived(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def queries() -> dict:
    found = (
        op1_substring_dedup,
        op2_secret_scan,
        op3_token_files,
        op4_quality_rules,
        op5_jaccard_join,
        op6_toxicity,
        op7_spaced_seeds,
        op8_best_fit_packing,
        op9_warc,
        op10_html_text,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op4_quality_rules": quality_rules.SQL}
