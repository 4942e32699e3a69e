"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from citesieve.llm import (bpe, exact_dedup, filter_audit, html_density, jaccard_join, line_dedup, phrases, quality_rules, secret_scan, source_mix,
                           suffix_dedup, url_filter, warc_segments)
from citesieve.llm.common import new_folder, read
from citesieve.llm.oracles import ORACLES  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op2_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return source_mix.mix_sources(read(spark, sf, "documents"), ["doc_id", "source"], staged=True).drop("copies")


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf, "documents"))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "_lines.n_lines", "_lines.n_removed", F.sha2(F.coalesce("_lines.text", F.lit("")), 256).alias("kept_sha256"))


def op5_warc_segments(spark: SparkSession, sf: str) -> DataFrame:
    return warc_segments.archive_pages(read(spark, sf, "pages"), new_folder(spark, "warc"))


def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_classes(read(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan_secrets(read(spark, sf, "documents").select("doc_id", "text")))


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = suffix_dedup.suffix_dedup(read(spark, sf, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                       F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_html_density(spark: SparkSession, sf: str) -> DataFrame:
    found = html_density.extract_main_text(read(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read(spark, sf, "documents").select("doc_id", "text"), bpe.public_vocabulary()))


def op11_phrase_mining(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine_phrases(read(spark, sf, "documents"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf, "documents"), read(spark, sf, "labels"))


#: The rules of the query: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_source_mix, op3_exact_dedup, op4_line_dedup, op5_warc_segments, op6_jaccard_join,
                                   op7_secret_scan, op8_suffix_dedup, op9_html_density, op10_bpe, op11_phrase_mining, op12_filter_audit,
                                   op13_url_filter)} | {"pipeline": corpus_pipeline.run}

