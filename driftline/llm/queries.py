"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html_text, licenses, mixing, packing, quality, simhash, token_counts, warc
from .sql import CHAT_SQL, QUALITY_SQL, WARC_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def chat_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) in several layouts from (conv_id, turn, role, text): a conversation of one question and its
    answer becomes a prompt or an instruction, others lists of messages or single turns, by the conversation's id."""
    said = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text"))).alias("said"))
    asked, answer = "said[0].text", "said[1].text"
    pair = "size(said) = 2 AND said[0].turn = 0 AND said[0].role = 'user' AND said[1].turn = 1 AND said[1].role = 'assistant'"
    kinds = {
        f"pmod(conv_id, 4) = 0 AND {pair}": f"array(to_variant_object(named_struct('prompt', {asked}, 'response', {answer}, 'source', 'table')))",
        f"pmod(conv_id, 4) = 1 AND {pair}": f"array(to_variant_object(named_struct('instruction', {asked}, 'input', '', 'output', {answer})))",
        "pmod(conv_id, 4) = 2": "transform(said, t -> to_variant_object(named_struct('turn', t.turn, 'messages', array(named_struct('role', t.role, 'content', t.text, 'weight', 1)))))",
        "pmod(conv_id, 4) = 3 AND NOT exists(said, t -> t.role IN ('human', 'gpt', 'bot'))": "transform(said, t -> to_variant_object(named_struct('id', conv_id, 'turn', t.turn, 'conversations', array(named_struct('from', CASE t.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE t.role END, 'value', t.text)))))",
    }
    cases = " ".join(f"WHEN {test} THEN {made}" for test, made in kinds.items())
    return said.select("conv_id", F.explode(F.expr(f"CASE {cases} ELSE transform(said, t -> to_variant_object(t)) END")).alias("record"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_records(chat_records(rows.unionByName(extra)))
    spoken = F.array_join(F.transform("back_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return made.select("conv_id", F.size("back_turns").cast("long").alias("n_turns"), F.sha2(F.encode(spoken, "utf-8"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "utf-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 100).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", "text", place.alias("path")), "doc_id", "path")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", *quality.BASE, "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_simhash, op3_chat, op4_token_counts, op5_licenses, op6_mixing, op7_ann, op8_warc, op9_html, op10_quality)}
ORACLE_SQL = {"op3_chat": CHAT_SQL, "op8_warc": WARC_SQL, "op10_quality": QUALITY_SQL}
