"""A corpus pipeline of five operators of risklake.llm, each a stage over what the one before kept.

Toxic documents go, one document of each near-duplicate group stays, documents with a benchmark passage go, sources are
mixed to weights 1, 2, 3 (a document that the mix takes more than once is repeated, one that it takes in part is cut to
those blocks), and what is left is dealt out to shards.

Cases. A null or empty text is scored like any other, all of them are near-duplicates of one another (one stays), they have no benchmark
passage and size zero in the mix. Of rows that repeat, or that share a doc_id and a text, one stays after the second stage, always the
same one. Ties in the mix and in the deal are broken by hashes. A null source is a source of its own, the last. Other columns are kept, whatever
their names; those that a stage adds give way within it. Empty documents give an empty table with the columns of the last stage. The
table of a stage is deleted once the next one's is written; the last one's stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risklake.llm import decontaminate, mixing, sharding, simhash, toxicity
from risklake.llm.common import remove, settle_at, table

N_SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", deal_to_shards),
]
#: SQL can express neither the first stage nor the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = settle_at(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
