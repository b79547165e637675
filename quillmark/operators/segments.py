"""Runs of equal pages, candidate boundaries of bundles, spans, and their absorption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.settings import DEFAULTS, Settings


def page_islands(pages: DataFrame) -> DataFrame:
    """(doc_id, page, doctype_id, confidence) -> runs of one doctype on consecutive page numbers."""
    w = Window.partitionBy("doc_id").orderBy("page")
    new = (F.lag("doctype_id").over(w).eqNullSafe(F.col("doctype_id"))) & (F.lag("page").over(w) == F.col("page") - 1)
    p = pages.withColumn("_new", (~F.coalesce(new, F.lit(False))).cast("int")).withColumn("segment", F.sum("_new").over(w))
    return p.groupBy("doc_id", "segment", "doctype_id").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.round(F.avg("confidence"), 4).alias("confidence"))


def candidate_boundaries(pages: DataFrame, markers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, page, signal): pages that may begin a document; of several signals the first one counts.

    pages: (doc_id, page, width, height, text_adequate, image_fraction, text). adequacy: both pages were measured, differ,
    and the inadequate one shows a picture, or the share of pictures crosses image_dominance; geometry: a side
    changes by more than the tolerance; first_page_anchor: a marker (a small table of lower-case texts) is on
    the page and on no earlier page of its document."""
    w = Window.partitionBy("doc_id").orderBy("page")
    before = lambda c: F.lag(c).over(w)
    p = pages.select("*", *[before(c).alias(f"_{c}") for c in ("page", "width", "height", "text_adequate", "image_fraction")])
    picture = F.when(F.col("text_adequate"), F.col("_image_fraction")).otherwise(F.col("image_fraction"))
    flips = (F.col("text_adequate") != F.col("_text_adequate")) & (picture > 0)
    crosses = (F.col("image_fraction") >= settings.image_dominance) != (F.col("_image_fraction") >= settings.image_dominance)
    side = lambda c: F.abs(F.col(c) - F.col(f"_{c}")) / F.greatest(c, f"_{c}") > settings.geometry_tolerance
    known = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("_width") > 0) & (F.col("_height") > 0)
    seen = pages.join(F.broadcast(markers.select("marker")), F.lower("text").contains(F.col("marker"))).groupBy("doc_id", "marker").agg(F.min("page").alias("page"))
    marked = seen.select("doc_id", "page").distinct().withColumn("_marked", F.lit(True))
    yes = lambda c: F.coalesce(c, F.lit(False))
    p = p.join(marked, ["doc_id", "page"], "left").where(F.col("_page").isNotNull())
    signal = F.when(yes(flips) | yes(crosses), "adequacy").when(yes(known & (side("width") | side("height"))), "geometry").when(yes(F.col("_marked")), "first_page_anchor")
    return p.select("doc_id", "page", signal.alias("signal")).where("signal is not null")


def spans(pages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(doc_id, page) -> (doc_id, span, start_page, end_page): a new span at each boundary and each gap in the numbers."""
    w = Window.partitionBy("doc_id").orderBy("page")
    p = pages.select("doc_id", "page").distinct().join(boundaries.select("doc_id", "page", F.lit(1).alias("_b")), ["doc_id", "page"], "left")
    new = F.col("_b").isNotNull() | F.coalesce(F.lag("page").over(w) != F.col("page") - 1, F.lit(True))
    return p.withColumn("span", F.sum(new.cast("int")).over(w)).groupBy("doc_id", "span").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))


def absorb(classified: DataFrame) -> DataFrame:
    """(doc_id, span, start_page, end_page, doctype_id) -> segments: an unidentified span joins the one it directly follows,
    leading unidentified ones join the first that follows them directly, and equal neighbours merge.

    As windows over a document's spans: chains of spans without a gap, each unknown filled from the known one before it in
    its chain, else from the first; then islands of equal types."""
    w = Window.partitionBy("doc_id").orderBy("start_page")
    chain = Window.partitionBy("doc_id", "_chain").orderBy("start_page")
    known = F.when(F.col("doctype_id") != "unknown", F.col("doctype_id"))
    c = classified.withColumn("_gap", F.coalesce(F.lag("end_page").over(w) + 1 != F.col("start_page"), F.lit(True))).withColumn("_chain", F.sum(F.col("_gap").cast("int")).over(w))
    before = F.last(known, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(known, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = c.withColumn("_type", F.coalesce(before, after, F.lit("unknown")))
    c = c.withColumn("_new", F.col("_gap") | (F.col("_type") != F.coalesce(F.lag("_type").over(w), F.lit("")))).withColumn("segment", F.sum(F.col("_new").cast("int")).over(w).cast("int"))
    return c.groupBy("doc_id", "segment", F.col("_type").alias("doctype_id")).agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page")).select("doc_id", "segment", "start_page", "end_page", "doctype_id")


def page_slice(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks of page ranges as documents of their own, named doc#pA-B."""
    j = blocks.join(ranges, "doc_id").where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    return j.withColumn("doc_id", F.format_string("%s#p%d-%d", F.col("doc_id").cast("string"), F.col("start_page"), F.col("end_page"))).drop("start_page", "end_page")
