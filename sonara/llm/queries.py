"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import debruijn, filter_audit, merkle, mil_toxicity, ngram_join, oracles, packing, pu_quality, quality_rules, sharding, simhash, sstable, tiling, url_filter
from .common import table
from .tokens import vocabulary_path

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op2_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removal_digest(table(spark, sf_dir, "documents"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pu_quality.score(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op8_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil_toxicity.score(docs, mil_toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), capacity=4096, end_id=1)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_tiling, op3_url_filter, op4_sharding, op5_quality_rules, op6_debruijn, op7_pu_quality, op8_mil_toxicity, op9_sstable, op10_packing, op11_filter_audit, op12_simhash, op13_merkle)}

ORACLE_SQL = {
    "op1_ngram_join": oracles.NGRAM_JOIN,
    "op3_url_filter": oracles.URL_FILTER,
    "op5_quality_rules": oracles.quality_rules_sql(),
    "op6_debruijn": oracles.DEBRUIJN,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op13_merkle": oracles.merkle_sql(),
}
