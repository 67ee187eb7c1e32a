"""A training-corpus pipeline: quality rules, near-dedup, decontamination, mixing, token records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, mixing, quality_rules, similar, simhash, token_records
from quillon.llm.queries import REPEATS, VOCABULARY
from quillon.llm.storage import store
from quillon.llm.tokenizing import vocabulary_path
from quillon.session import ship, table

#: The stages encode texts with a byte-level BPE and near-dedup by XXH64, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go; repeated rows and ties stand or fall together, as their measures are
    equal; long texts are measured whole; null languages and sources are groups like any other.  An empty table
    stays empty.  Columns called like the rules' own come back as they were.
    """
    ship(spark)
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by op9's fingerprints and links.

    The smallest id stays (null ids last), one row of it.  Null and empty texts form one group; long texts are
    hashed whole; an empty table stays empty.  Columns called like working ones come back as they were.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def similar_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar at 0.8; odd rows as for near_dedup."""
    ship(spark)
    return similar.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows stand or fall together; long texts are searched whole;
    an empty table stays empty, and an empty benchmark keeps everything.  No column is added, so none can clash.
    """
    ship(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix of the sources, of the input's size, that repeats none more than REPEATS times.

    A null source is a source; null and empty texts hold no tokens and stay with their source's passes; rows that
    share an id and a source stand or fall together; an empty table stays empty.  Rows repeat as their source's
    passes say, with the documents' own columns alone.
    """
    ship(spark)
    return mixing.mix(docs, mixing.plan(docs, repeats=REPEATS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id records, written and read back: one row a document, in the files' order.

    Null and empty texts have the end id alone; null ids come first; repeated rows each have a record; long texts
    are encoded whole; an empty table gives no record.  Other columns, whatever their names, are ignored.
    """
    ship(spark)
    return token_records.read_records(token_records.write_records(docs, vocabulary_path(VOCABULARY)))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("token records", tokens)]

#: The same with near-dedup by similarity: ``pipeline`` keeps op9's contract, which its test and figures are made for.
SIMILAR_STAGES = [("similarity near-dedup", similar_dedup) if stage is near_dedup else (name, stage) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str, stages: list | None = None) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and reread as the next one's."""
    docs, stages = table(spark, sf_dir, "documents"), stages or STAGES
    for i, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i < len(stages) - 1:
            docs = store(docs, "stage")
    return docs


def run_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SIMILAR_STAGES)
