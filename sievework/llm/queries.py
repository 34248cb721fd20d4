"""The queries opN_<name> over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import ann, coding, extract, lines, ngrams, packing, phrases, quality, search, secrets, simhash, suffixes, warc
from sievework.llm.common import own_dir, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.digest(warc.read_warc(spark, folder, payloads=False))


def op3_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.coding_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op7_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.digest(lines.drop_frequent_lines(docs))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.digest(extract.extract_texts(table(spark, sf_dir, "pages")))


def op12_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.rank(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan,
        op2_warc_archive,
        op3_backoff_scores,
        op4_bpe_coding,
        op5_power_packing,
        op6_quality_rules,
        op7_permutation_search,
        op8_suffix_dedup,
        op9_line_dedup,
        op10_simhash_components,
        op11_host_paths,
        op12_suffix_phrases,
        op13_clustered_search,
    )
}
