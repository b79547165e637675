"""The training-data pipeline: toxicity, near-duplicates, personal data, mixing, packing, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import mixing, ngram_join, packing, pii, toxicity
from quillmark.llm._common import discard, materialize
from quillmark.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the threshold of their language go. Null and empty texts are scored as texts without words;
    repeated rows go or stay together; without labels of both classes every row stays. Other columns, of any names, stay
    as they are; an empty table stays empty."""
    packed = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("row"))
    scored = toxicity.score_toxicity(packed, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(~F.col("toxic")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at Jaccard 0.8 the one with the smallest id stays. Null and blank texts and null
    ids stay; rows of one id with different texts are told apart, equal rows are copies. Other columns stay as they are; an
    empty table stays empty."""
    return ngram_join.keep_one_per_group(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are generalised and disclosing terms go; every row stays, null texts too. n_chars follows the
    text. Equal texts get equal results and count once. Other columns, of any names, stay as they are; an empty table stays
    empty."""
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    clean = pii.find_personal_data(packed)
    text = F.col("pii.redacted")
    made = {"text": text, "n_chars": F.when(text.isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return clean.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order, repeated or left out as the target weights ask: texts without words are left out, a last repeat
    can be cut after a word. n_chars follows the text. Null sources are a source, ties go by id, repeated rows each have their
    place. Other columns, of any names, stay as they are; an empty table stays empty."""
    mixed = mixing.curriculum(docs)
    return mixed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids. Null and empty texts have the end id alone; repeated rows are packed as often as
    they occur; a long text is cut into pieces; an empty table gives no rows."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_each_group), ("personal_data", sanitise), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Training a classifier and running a tokenizer are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each stage's result written durably before the next and deleted after it. The
    last stage's input stays, since its result is read lazily."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
