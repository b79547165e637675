"""The verdict on each document: its candidate, why it is accepted, or why the answer is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.settings import DEFAULTS, Settings


def evidence_bits(anchor_bits: Column, explained: Column) -> Column:
    return F.greatest(anchor_bits, F.lit(0.0)) - F.log2(F.greatest(1 - explained, F.lit(1e-6)))


def separation(lead: Column) -> Column:
    """1 - 2^-lead; 0 without a lead."""
    return F.when(lead > 0, 1 - F.pow(F.lit(2.0), -lead)).otherwise(0.0)


def support(score: Column, explained: Column) -> Column:
    return 1 - (1 - score) * (1 - explained)


def decide(scores: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per document: (doc_id, doctype_id, abstained, confidence, margin, support, coverage, route, reason, runners_up).

    scores: (doc_id, doctype_id, bits, score, explained, lexical_coverage, anchor_coverage, sole_owner) of every class
    for every document. Classes are ranked by evidence bits, then id. A candidate is identified if both channels
    concur (each is positive and not below the runner-up's), or if it alone owns decisive evidence; it is accepted
    if its lead, support and coverage reach their floors. Unknown is an answer, with all failed gates as reason.
    """
    s = scores.withColumn("b", F.round(evidence_bits(F.col("bits"), F.col("explained")), 6))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("b")).alias("k"), "doctype_id", "b", "bits", "score", "explained", F.greatest("lexical_coverage", "anchor_coverage").alias("cov"), "sole_owner")))
    d = s.groupBy("doc_id").agg(ranked.alias("r")).select("doc_id", F.get("r", F.lit(0)).alias("c"), F.get("r", F.lit(1)).alias("n"), F.transform(F.slice("r", 2, 3), lambda x: x["doctype_id"]).alias("runners_up"))
    leads = lambda x: (F.col(f"c.{x}") > 0) & (F.col(f"c.{x}") >= F.col(f"n.{x}"))
    concurs = F.coalesce(leads("bits") & leads("explained"), F.lit(False))  # without a runner-up nothing concurs
    d = d.withColumn("route", F.when(concurs, "concurrence").when(F.coalesce("c.sole_owner", F.lit(False)), "conclusive"))
    d = d.withColumn("margin", F.round(separation(F.col("c.b") - F.coalesce("n.b", F.lit(0.0))), 6)).withColumn("support", F.round(support(F.col("c.score"), F.col("c.explained")), 6)).withColumn("coverage", F.col("c.cov"))
    gates = {"margin": settings.least_lead, "support": settings.least_support, "coverage": settings.least_coverage}
    failed = F.array_compact(F.array(F.when(F.col("route").isNull(), F.lit("not identified")), *[F.when(F.col(g) < least, F.lit(f"{g} below {least:g}")) for g, least in gates.items()]))
    confidence = F.when(F.col("route").isNull(), 0.0).otherwise(F.round(F.least(*[F.col(g) / (F.col(g) + least) for g, least in gates.items()]), 4))
    d = d.withColumn("reason", F.array_join(failed, "; "))
    return d.select("doc_id", F.when(F.col("reason") == "", F.col("c.doctype_id")).otherwise("unknown").alias("doctype_id"), F.col("c.doctype_id").alias("candidate"), (F.col("reason") != "").alias("abstained"), confidence.alias("confidence"), "margin", "support", "coverage", F.coalesce("route", F.lit("")).alias("route"), "reason", F.array_join("runners_up", ",").alias("runners_up"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, outcome): agree, disagree, one_abstained, both_abstained or single_avenue of two classifications."""
    a, b = (x.select("doc_id", F.col("doctype_id").alias(n)) for x, n in ((first, "a"), (second, "b")))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    unknown = (F.col("a") == "unknown").cast("int") + (F.col("b") == "unknown").cast("int")
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(~both, "single_avenue").when(unknown == 2, "both_abstained").when(unknown == 1, "one_abstained").when(F.col("a") == F.col("b"), "agree").otherwise("disagree").alias("outcome"))


def fuse(prior: Column, anchor: Column, lexical: Column, embedding: Column, settings: Settings = DEFAULTS) -> Column:
    """The audit ranking: a weighted sum of the channels."""
    return prior + settings.fuse_anchor * anchor + settings.fuse_lexical * lexical + settings.fuse_embedding * embedding


def top(scores: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return scores.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
