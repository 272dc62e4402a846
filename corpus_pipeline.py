"""A training corpus from ``documents``: quality rules, near-duplicates, mixing and packing, in stages that are tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import mixing, packing, quality, simhash
from driftline.llm.shared import discard, materialize, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules and their host's verdict keep: null, empty and very short texts go. Repeated rows are
    judged one by one; columns may have any names; an empty table gives an empty one."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that of the smallest doc_id; equal rows are folded, rows that share a
    doc_id but not a component are all kept, and one without a doc_id is kept where its component has no other."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of blocks drawn to the sources' targets: a document whose words lie in more than one block appears in
    parts, and one that is drawn twice twice. A null source is a source; rows without words are not taken."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in windows of 2048 tokens, as op1 returns them; a null text is its end token alone."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Fingerprints, permutations and token ids are not SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result but the last is written to the shared folder and read again, and what
    a stage wrote on its way is removed with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            made = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", outlives=True)
        if before is not None:
            discard(before)
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
