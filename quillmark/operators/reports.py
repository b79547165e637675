"""Tools around a corpus: zones from type sizes, bundles and their truth, exemplars, probes, calibration and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators.lexical import class_counts

# fixed values: weights of what a registry declares about a class, by where it stands
SOURCE_WEIGHTS = {"label": 6.0, "anchor": 3.0, "authority": 3.0, "field_label": 2.0, "alias": 1.5, "note": 0.8}
# fixed values: methods of telling documents apart by sight that were measured and given up: AUC and best precision
RETIRED = [("sift", 0.568, 0.022), ("skeleton", 0.627, 0.067), ("layout_signature", 0.846, 0.080), ("emblem", 0.554, 0.000)]
HEADING_RATIO, TITLE_RATIO, TITLE_BAND, EDGE_BAND, SHORT, REPEAT_SHARE = 1.15, 1.30, 0.35, 0.08, 120, 0.5


def declared_counts(declared: DataFrame) -> DataFrame:
    """(class, source, text) -> (class, term, n): term counts of what is declared about classes, by the source's weight."""
    w = F.create_map(*[x for k, v in SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    parts = declared.withColumn("_w", F.coalesce(F.try_element_at(w, F.col("source")), F.lit(1.0))).withColumn("class", F.concat_ws("\u0001", "class", F.col("_w").cast("string")))
    return weighed(class_counts(parts.select("class", "text")))


def weighed(counts: DataFrame) -> DataFrame:
    """Counts whose class carries its weight -> counts by class."""
    c = F.split("class", "\u0001")
    return counts.select(c[0].alias("class"), "term", (F.col("n") * c[1].cast("double")).alias("n")).groupBy("class", "term").agg(F.sum("n").alias("n"))


def fitted_counts(labelled: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of a labelled corpus (class, text), with what is declared added, and the average number of tokens: (counts, (average_length))."""
    c = class_counts(labelled)
    if declared is not None:
        c = c.unionByName(declared_counts(declared)).groupBy("class", "term").agg(F.sum("n").alias("n"))
    return c, labelled.agg(F.round(F.avg(F.size(T.skeleton_tokens(F.col("text")))), 4).alias("average_length"))


def inferred_zones(lines: DataFrame) -> DataFrame:
    """(doc_id, page, seq, text, size, y0, height) -> zone of each line, for evaluation.

    The body's size is the one with most characters. furniture: a line in the top or bottom band that is a page number or
    whose text, digits aside, stands in the band on at least half of several pages; title: on page 1, near its top, clearly
    larger than the body and of the largest size there; heading: larger than the body and short; else body."""
    chars = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"))
    body = chars.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("_body"))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    edge = (F.col("y0") < EDGE_BAND * F.col("height")) | (F.col("y0") > (1 - EDGE_BAND) * F.col("height"))
    l = lines.join(body, "doc_id").join(pages, "doc_id").withColumn("_edge", edge).withColumn("_key", F.regexp_replace(T.fold(F.col("text")), "[0-9]+", "#"))
    seen = l.where("_edge").groupBy("doc_id", "_key").agg(F.count_distinct("page").alias("_seen"))
    l = l.join(seen, ["doc_id", "_key"], "left")
    number = F.trim("text").rlike(r"^(?:(?i:page|p\.?)\s*)?[0-9]+(?:\s*(?:/|of)\s*[0-9]+)?$")
    furniture = F.col("_edge") & (number | (F.col("_pages") >= 2) & (F.coalesce("_seen", F.lit(0)) >= F.col("_pages") * REPEAT_SHARE))
    top = ~furniture & (F.col("page") == 1) & (F.col("y0") < TITLE_BAND * F.col("height")) & (F.col("size") >= TITLE_RATIO * F.col("_body"))
    l = l.withColumn("_top", F.max(F.when(top, F.col("size"))).over(Window.partitionBy("doc_id")))
    zone = F.when(furniture, "furniture").when(top & (F.col("size") == F.col("_top")), "title").when((F.col("size") >= HEADING_RATIO * F.col("_body")) & (F.length("text") <= SHORT), "heading").otherwise("body")
    return l.select("doc_id", "page", "seq", "text", zone.alias("zone"))


def channel_leaders(trails: DataFrame) -> DataFrame:
    """(doc_id, evidence) with lines like `anchor: name (0.9)` -> (doc_id, channel, leader, weight): each channel's first."""
    lines = trails.select("doc_id", F.posexplode(F.split("evidence", "\n")).alias("k", "line"))
    p = r"^(\w+): (.*) \((-?[0-9.]+)\)$"
    got = lines.select("doc_id", "k", *[F.regexp_extract("line", p, n).alias(c) for n, c in ((1, "channel"), (2, "leader"), (3, "w"))]).where("channel != ''")
    w = Window.partitionBy("doc_id", "channel").orderBy("k")
    return got.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "channel", "leader", F.col("w").cast("double").alias("weight"))


def bundles(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle, ord, source, pages) -> where each member stands (bundle, ord, source, start_page, end_page), and the pages
    after the first at which a member begins (bundle, page): the truth that a splitter is held against."""
    w = Window.partitionBy("bundle").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = members.withColumn("end_page", F.sum("pages").over(w).cast("long")).withColumn("start_page", F.col("end_page") - F.col("pages") + 1)
    return m.select("bundle", "ord", "source", "start_page", "end_page"), m.where("start_page > 1").select("bundle", F.col("start_page").alias("page"))


def bundle_recall(predicted: DataFrame, true: DataFrame, shapes: DataFrame) -> DataFrame:
    """Boundaries (bundle, page) found, missed and false by shape (bundle, shape), and over all as shape `all`."""
    j = predicted.distinct().withColumn("p", F.lit(True)).join(true.distinct().withColumn("t", F.lit(True)), ["bundle", "page"], "full_outer").join(shapes, "bundle")
    g = j.groupingSets([[F.col("shape")], []], F.col("shape")).agg(F.count_if(F.col("p") & F.col("t")).alias("found"), F.count_if(F.col("p").isNull()).alias("missed"), F.count_if(F.col("t").isNull()).alias("false_ones"))
    part = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return g.select(F.coalesce("shape", F.lit("all")).alias("shape"), "found", "missed", "false_ones", part("found", "false_ones").alias("precision"), part("found", "missed").alias("recall"))


def exemplars(doctypes: DataFrame, anchors: DataFrame, most: int = 6) -> DataFrame:
    """Texts that stand for each doctype: its label; authority and label; each language's first three anchors (those pinned
    to a zone, then decisive ones, then the rest). Equal texts once, at most so many: (doctype_id, ord, text)."""
    a = anchors.withColumn("_k", F.row_number().over(Window.partitionBy("doctype_id", "lang").orderBy(F.col("zone").isNull(), ~F.col("decisive"), "ord"))).where("_k <= 3")
    joined = a.groupBy("doctype_id", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda x: x["text"]), " ").alias("text"))
    rows = doctypes.select("doctype_id", F.lit(0).alias("o"), F.lit("").alias("l"), F.col("label").alias("text"))
    rows = rows.union(doctypes.where("authority is not null").select("doctype_id", F.lit(1), F.lit(""), F.concat_ws(" ", "authority", "label"))).union(joined.select("doctype_id", F.lit(2), "lang", "text"))
    once = rows.groupBy("doctype_id", "text").agg(F.min(F.struct("o", "l")).alias("at"))
    ranked = once.withColumn("ord", F.row_number().over(Window.partitionBy("doctype_id").orderBy("at", "text")))
    return ranked.where(F.col("ord") <= most).select("doctype_id", "ord", "text")


def platt(score: Column, a: float, b: float) -> Column:
    """Calibrated probability of a score."""
    return 1 / (1 + F.exp(F.lit(a) * score + F.lit(b)))


def fit_platt(scored: DataFrame, steps: int = 500, rate: float = 0.05, bins: int = 200) -> tuple[float, float]:
    """(a, b) of platt() for scores between 0 and 1 with answers (score, correct), by gradient descent on the mean log loss.

    The data is read once: it is summed over equal bins of scores, each of which stands for its mean score, and the
    descent runs on those sums."""
    g = scored.where("score is not null and correct is not null").withColumn("_b", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    rows = g.groupBy("_b").agg(F.avg("score").alias("s"), F.count("*").alias("n"), F.sum(F.col("correct").cast("double")).alias("y")).orderBy("_b").collect()  # at most `bins` rows
    import numpy as np

    if not rows:
        return -1.0, 0.0
    s, n, y = (np.array([r[k] for r in rows], float) for k in ("s", "n", "y"))
    a, b = -1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(a * s + b))
        d = (y - n * p) / n.sum()
        a, b = a - rate * float((d * s).sum()), b - rate * float(d.sum())
    return a, b


def corpus_report(score: DataFrame) -> DataFrame:
    """corpus_score() rows -> (ord, line): a report as lines of a Markdown table, the total first."""
    names = [c for c in score.columns]
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    head = [(0, "| " + " | ".join(names) + " |"), (1, "|" + " --- |" * len(names))]
    body = score.select((F.row_number().over(Window.orderBy(*[F.col(c) != "*" for c in names[:2]], *names[:2])) + 1).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |")).alias("line"))  # a report's rows
    from quillmark.tables import local_rows

    return local_rows(score.sparkSession, head, "ord int, line string").unionByName(body)
