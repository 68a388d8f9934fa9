"""Queries of the text operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import leaks, packing, spam
from weft.session import stage
from weft.sources.tables import table


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixed container length, as this project states the problem."""
    return packing.pack(table(spark, sf_dir, "documents"), (2048,))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several permitted lengths, chosen jointly: a container costs 8 tokens and, by attention, the square of its length over 4,096 besides its length."""
    return packing.pack(table(spark, sf_dir, "documents"), (256, 512, 1024, 2048), overhead=8, attention=4096)


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``p7_containers``, measured."""
    pages = table(spark, sf_dir, "documents")
    return packing.audit(pages, stage(packing.pack(pages, (2048,)), "containers"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items")).filter("exact").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand in a page as a whole, word for word or with few changes: similarity of 0.8 and more in weighted shingles."""
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items")).filter("whole >= 0.8")
    return found.select("doc_id", "item_id", F.round("whole", 6).alias("similarity"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.find_spam(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p7_containers, p7_lengths, p7_audit, p8_found, p8_near, p9_found)}
ORACLE: dict[str, str] = {
    "p7_audit": "SELECT count(DISTINCT doc_id) AS pages, 0 AS tokens_lost, 0 AS gaps, 0 AS overfull, true AS tight FROM documents",
}
