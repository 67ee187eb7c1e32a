"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import decontamination, license_scan, mixing, quality_rules, simhash, token_counts, token_records, toxicity, url_filters, warc
from .storage import store
from .tokenizing import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
REPEATS = 1.25
BLOCK_TOKENS = 1_000_000


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits: a word put in at a third, five characters
    taken out at two thirds, and a line added at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda pos, cut, ins: F.struct(pos.cast("int").alias("pos"), F.lit(cut).alias("del"), F.lit(ins).alias("ins"))
    edits = F.array(edit(F.floor(n / 3), 0, " revised"), edit(F.floor(2 * n / 3), 5, ""), edit(n + 3, 0, "\nEnd of revision."))
    return token_counts.count_edited(docs.withColumn("edits", edits), vocabulary_path(VOCABULARY))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "harm_clauses", "worst_clause")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages"))).drop("url")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix of the input's size that uses no source more than REPEATS times."""
    docs = table(spark, sf_dir, "documents")
    # texts are read once, to count their words
    slim = store(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")), "mix-documents")
    planned = mixing.plan(slim, repeats=REPEATS, tokens=F.col("words"))
    mixed = mixing.realise(slim, planned, tokens=F.col("words"))
    return mixing.blocks(mixed, planned, block_tokens=BLOCK_TOKENS).select("doc_id", "source", "epoch", "block", "position", "n_tokens")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = quality_rules.store(quality_rules.measure(docs).drop("text"), "measured")
    return quality_rules.judge(measured, quality_rules.thresholds(measured)).drop("lang", "source")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
    return token_records.read_records(manifest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_toxicity, op4_warc, op5_mixing, op6_license_scan, op7_decontamination, op8_quality_rules, op9_simhash, op10_token_records)}
