"""Blocks of plain text, and what a document's pages and blocks say about its structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.settings import DEFAULTS, Settings


LINE_END = r"\r\n|[\n\r\u000B\u000C\u0085  ]"


def clean_block(text: Column) -> Column:
    """Control characters become spaces, and white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " "), r"\s+", " "))


def text_lines(text: Column) -> Column:
    """The cleaned lines of a whole text that aren't empty."""
    return F.filter(F.transform(F.split(text, LINE_END), clean_block), lambda x: x != "")


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", caps: Settings | None = None) -> DataFrame:
    """One body block on page 1 per line with text: (doc_id, seq, page, zone, text). seq is reading order from 0.

    Whole texts; caps is for untrusted files: with it lines and their characters are bounded, and a further column
    truncated says for each row whether its text, or its document, was cut."""
    if caps is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(text_lines(F.col(text_col))).alias("seq", "text")).select("doc_id", "seq", F.lit(1).alias("page"), F.lit("body").alias("zone"), "text")
    d = docs.select(F.col(id_col).alias("doc_id"), text_lines(F.col(text_col)).alias("_l"))
    rows = d.select("doc_id", (F.size("_l") > caps.most_blocks).alias("_more"), F.posexplode(F.slice("_l", 1, caps.most_blocks)).alias("seq", "_t"))
    return rows.select("doc_id", "seq", F.lit(1).alias("page"), F.lit("body").alias("zone"), F.substring("_t", 1, caps.most_block_chars).alias("text"), (F.col("_more") | (F.length("_t") > caps.most_block_chars)).alias("truncated"))


def limit_chars(blocks: DataFrame, most_chars: int) -> DataFrame:
    """The blocks of each document that begin within its character budget, and whether they were all."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = blocks.withColumn("_used", F.sum(F.length("text")).over(w))
    return used.where(F.col("_used") - F.length("text") < most_chars).withColumn("truncated", F.col("_used") > most_chars).drop("_used")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds place: by page, blocks with a rectangle first, then by bands of 0.6 mean heights, then by left edge, then seq."""
    page = Window.partitionBy("doc_id", "page")
    band = F.greatest(F.avg(F.col("y1") - F.col("y0")).over(page) * 0.6, F.lit(1e-9))
    row = F.bround(((F.col("y0") + F.col("y1")) / 2) / band)
    return blocks.withColumn("_row", row).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", F.col("y0").isNull(), "_row", "x0", "seq"))).drop("_row")


def structural_features(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document: page_count, aspect_ratio, landscape, digital of the first page, block_count, char_count, title_block_count."""
    first = F.min_by(F.struct("width", "height", "unit", "angle"), "page")
    p = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), first.alias("p"))
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("block_count"), (F.sum(F.length("text")) + F.count("*") - 1).alias("char_count"), F.count_if(F.col("zone").isin("title", "heading")).alias("title_block_count"), F.max("page").alias("last"))
    aspect = F.when(F.col("p.height") > 0, F.round(F.col("p.width") / F.col("p.height"), 4)).otherwise(0.0)
    return b.join(p, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("pages", "last", F.lit(0)).cast("long").alias("page_count"), F.coalesce(aspect, F.lit(0.0)).alias("aspect_ratio"), F.coalesce(aspect > 1.05, F.lit(False)).alias("landscape"),
        F.coalesce((F.col("p.unit") == "inch") & (F.abs(F.col("p.angle")) < 0.5), F.lit(False)).alias("digital"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("block_count", "char_count", "title_block_count")],
    )


def structural_prior(features: DataFrame, doctypes: DataFrame) -> DataFrame:
    """(doc_id, doctype_id, prior): weak physical evidence of each class, between -2 and 1.5.

    features has page_count, landscape, table_count, mark_count and has_mrz; doctypes (a small table) has category,
    wants_mrz, wants_marks and wants_tables."""
    c, n, one = F.col("category"), F.col("page_count"), (F.col("page_count") == 1) & F.col("landscape")
    points = lambda when, x: F.when(when, x).otherwise(0.0)
    identity = F.when(n >= 5, -1.2).when(n >= 3, -0.4).when(n > 0, 0.15).otherwise(0.0) + points(one, 0.25) + points(F.col("table_count") >= 3, -0.3)
    business = points(n >= 3, 0.3) + points(F.col("table_count") >= 1, 0.15) + points(one, -0.3)
    tax = points(F.col("table_count") >= 1, 0.1) + points(F.col("mark_count") >= 1, 0.1)
    total = F.when(c == "identity", identity).when(c.isin("corporate", "financial"), business).when(c == "tax", tax).otherwise(0.0)
    total += points(F.col("wants_mrz"), F.when(F.col("has_mrz"), 0.8).otherwise(-0.3)) + points(F.col("wants_marks"), F.when(F.col("mark_count") > 0, 0.3).otherwise(-0.2)) + points(F.col("wants_tables") & (F.col("table_count") > 0), 0.1)
    return features.join(F.broadcast(doctypes)).select("doc_id", "doctype_id", F.round(F.greatest(F.lit(-2.0), F.least(F.lit(1.5), total)), 4).alias("prior"))
