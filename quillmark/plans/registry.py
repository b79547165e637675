"""A small registry of document types for corpora of prose, and checks of any registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.validators import VALIDATORS
from quillmark.tables import local_rows

ANCHORS = [
    ("licensed", 0, "licensed under the", False, None), ("licensed", 1, "General Public License", True, None), ("licensed", 2, "Apache License", True, None), ("licensed", 3, "MIT", False, None),
    ("prose_en", 0, "of the", False, None), ("prose_en", 1, "and", True, "body"), ("prose_en", 2, "that", False, None),
    ("prose_de", 0, "in der", False, None), ("prose_de", 1, "und", True, "body"), ("prose_de", 2, "nicht", False, None),
    ("prose_fr", 0, "dans la", False, None), ("prose_fr", 1, "et", True, None), ("prose_fr", 2, "elle", False, None), ("prose_fr", 3, "de la", True, None),
    ("prose_es", 0, "de los", False, None), ("prose_es", 1, "ción", True, None), ("prose_es", 2, "que", False, "body"), ("prose_es", 3, "de la", True, None),
]
NEGATIVES = [("prose_en", 0, "licensed under"), ("prose_de", 0, "the"), ("prose_fr", 0, "und"), ("prose_es", 0, "les")]
CONFUSABLES = [("prose_fr", "prose_es")]
PATTERNS = [("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"), ("address", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), ("licence", "[Vv]ersion [0-9.]+")]
KINDS = [("passport", "identity", True, False, False), ("return", "tax", False, True, True), ("statement", "financial", False, False, True), ("deed", "corporate", False, False, False), ("letter", "other", False, False, False)]
MARKERS = ["and the", "ing th", "de la"]


def anchors(spark: SparkSession) -> DataFrame:
    return local_rows(spark, ANCHORS, "doctype_id string, ord int, text string, decisive boolean, zone string")


def negatives(spark: SparkSession) -> DataFrame:
    return local_rows(spark, NEGATIVES, "doctype_id string, ord int, text string")


def confusables(spark: SparkSession) -> DataFrame:
    """Pairs of doctypes that look alike: (doctype_id, other_id)."""
    return local_rows(spark, CONFUSABLES, "doctype_id string, other_id string")


def patterns(spark: SparkSession) -> DataFrame:
    return local_rows(spark, PATTERNS, "name string, pattern string")


TYPES = ("string", "date", "number", "name", "address", "id", "bool")


def spec_violations(specs: DataFrame, doctypes: DataFrame) -> DataFrame:
    """(doctype_id, name, problem) of declared fields: unknown doctypes, types and validators, and names given twice."""
    one = lambda when, problem: specs.where(when).select("doctype_id", "name", F.lit(problem).alias("problem"))
    lost = specs.join(doctypes.select("doctype_id"), "doctype_id", "left_anti").select("doctype_id", "name", F.lit("unknown_doctype").alias("problem"))
    twice = specs.groupBy("doctype_id", "name").count().where("count > 1").select("doctype_id", "name", F.lit("duplicate_name").alias("problem"))
    return lost.union(twice).union(one(~F.col("type").isin(*TYPES), "unknown_type")).union(one(F.col("validator").isNotNull() & ~F.col("validator").isin(*VALIDATORS), "unknown_validator"))


def decisive_collisions(anchor_table: DataFrame) -> DataFrame:
    """(claim, doctypes): decisive texts that several doctypes claim."""
    key = T.skeleton(T.fold(F.col("text")))
    g = anchor_table.where("decisive").select(key.alias("claim"), "doctype_id").distinct().groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set("doctype_id")), ",").alias("doctypes"), F.count("*").alias("n"))
    return g.where("n > 1").drop("n")


def dangling_confusables(confusables: DataFrame, doctypes: DataFrame) -> DataFrame:
    return confusables.join(doctypes.select(F.col("doctype_id").alias("other_id")), "other_id", "left_anti")


def listed(doctypes: DataFrame, country: str | None = None, category: str | None = None) -> DataFrame:
    """The doctypes of a country (those without one serve every country) and a category, in the order of their ids."""
    d = doctypes
    if country is not None:
        d = d.where((F.col("country") == country.upper()) | F.col("country").isNull())
    if category is not None:
        d = d.where(F.col("category") == category)
    return d.orderBy("doctype_id")


def cross_violations(doctypes: DataFrame, anchors_: DataFrame, confusables_: DataFrame, validators: DataFrame) -> DataFrame:
    """(doctype_id, problem, detail) of what tables of a registry say about each other: anchors, confusables and validators of
    doctypes that don't exist; a doctype confusable with itself; no anchor at all; the same anchor twice; a validator that is unknown."""
    known = doctypes.select("doctype_id").distinct()
    row = lambda df, problem, detail: df.select("doctype_id", F.lit(problem).alias("problem"), detail.alias("detail"))
    lost = lambda df, what: row(df.join(known, "doctype_id", "left_anti").select("doctype_id").distinct(), "unknown_doctype", F.lit(what))
    other = confusables_.join(known.withColumnRenamed("doctype_id", "other_id"), "other_id", "left_anti")
    twice = anchors_.groupBy("doctype_id", T.skeleton(T.fold(F.col("text"))).alias("t")).count().where("count > 1")
    out = lost(anchors_, "anchors").unionByName(lost(confusables_, "confusables")).unionByName(lost(validators, "validators"))
    out = out.unionByName(row(other.where("doctype_id != other_id"), "unknown_confusable", F.col("other_id"))).unionByName(row(confusables_.where("doctype_id = other_id"), "confusable_with_itself", F.col("other_id")))
    out = out.unionByName(row(known.join(anchors_.select("doctype_id").distinct(), "doctype_id", "left_anti"), "no_anchor", F.lit(""))).unionByName(row(twice, "anchor_twice", F.col("t")))
    return out.unionByName(row(validators.where(~F.col("validator").isin(*VALIDATORS)), "unknown_validator", F.col("validator")))
