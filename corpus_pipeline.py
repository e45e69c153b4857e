"""A training corpus from raw documents: language, near duplicates, contamination, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the shared folder and reads it again as
the next stage's documents. All stages but the last return the columns of `documents`. Stages compute on what their predecessor kept:
the language model is learned from the stage's own documents, and mixing weights hold for the sources that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosopon.llm import decontaminate, langid, mixing, sharding, simhash
from prosopon.llm.common import table
from prosopon.session import cut_lineage

LEAST_SCORE = 0.5
WEIGHTS = (3.0, 1.0, 2.0)
SHARDS = 16


def told_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: text without letters and texts with a score below LEAST_SCORE go."""
    return langid.accepted(docs, LEAST_SCORE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints: the one with the smallest id."""
    return simhash.deduplicated(docs, radius=3, shingle=3)


def without_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as the sources' budgets take them."""
    return mixing.write_out(mixing.mix(docs, mixing.cyclic_weights(docs, WEIGHTS)))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture with size, checksum, shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language ID", told_languages),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_contamination),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The language model, the fingerprints' hash and the splitters have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = cut_lineage(docs, f"stage-{place}")
    return docs
