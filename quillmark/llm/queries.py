"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import chat, embed_dedup, mixing, ngram_join, packing, pii, quality, substring, toxicity, url_filter
from quillmark.llm._common import values
from quillmark.llm.sql import oracles

#: Folder of the public tokenizers; the same on every machine.
TOKENIZERS = os.environ.get("QUILLMARK_TOKENIZERS", "")
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = values(spark, [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(given.unionByName(more), tokenizer("byte_bpe_50k.json"))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    done = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"), "pii.spans")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    done = mixing.mix_documents(docs, mixing.word_count(F.col("text")))
    return done.select("doc_id", "source", "size", "source_size", "target", "taken", "positions")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return done.select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return done.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "cut.n_sentences", "cut.n_removed", "cut.removed_words", "cut.spans", "cut.text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_ngram_jaccard_join, op2_packing, op3_chat_formatting, op4_quality_rules, op5_personal_data, op6_mixing, op7_embedding_near_dedup, op8_url_filters, op9_toxicity, op10_substring_dedup)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return oracles(RULES)
