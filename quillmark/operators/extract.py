"""Fields: candidates from patterns and tables, their resolution, grounding of answers, and drafts of schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.settings import DEFAULTS, Settings
from quillmark.tables import registry_side

# fixed values: what a locator's find is worth before anything else is known, and what validation makes of it
PRIORS = {"kv": 0.90, "mrz": 0.97, "table": 0.78, "label": 0.76, "mark": 0.86, "regex": 0.50}
FACTORS = {"checksum": 1.25, "format": 1.10, "none": 1.0, "soft": 0.85, "rejected": 0.30}


def pattern_candidates(blocks: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, name, value, zone, seq, confidence): matches of regular expressions; of equal values the best stays.

    patterns is a small table (name, pattern) and is broadcast; the prior grows with the zone."""
    m = blocks.join(registry_side(patterns)).select("doc_id", "name", "zone", "seq", F.explode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("value"))
    bonus = F.when(F.col("zone") == "title", 0.10).when(F.col("zone") == "heading", 0.06).when(F.col("zone") == "table", 0.04).otherwise(0.0)
    m = m.withColumn("confidence", F.round(F.least(F.lit(0.68), F.lit(PRIORS["regex"]) + bonus), 4))
    w = Window.partitionBy("doc_id", "name", "value").orderBy(F.col("confidence").desc(), "seq")
    return m.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def letter_runs(key: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a string; shorter ones whole."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (n - 1), F.lit(1))), lambda i: F.substr(key, i, F.lit(n))))


def pair_candidates(pairs: DataFrame, labels: DataFrame, least: float = 88.0) -> DataFrame:
    """(doc_id, name, value, confidence) of key-value pairs whose key is a field's label, or like one.

    Keys meet the labels (a registry table, name and label) in a hash join on runs of three letters, of which alike strings
    share one; the similarity is computed for the pairs that meet, once each, and not for those that are equal."""
    key = lambda c: F.trim(F.regexp_replace(T.fold(F.col(c)), r"[^\p{L}\p{N}]+", " "))
    p = pairs.select("doc_id", "value", "confidence", key("key").alias("_key")).where("_key != ''").withColumn("_row", F.monotonically_increasing_id())
    l = labels.select("name", key("label").alias("_label")).where("_label != ''").distinct()
    met = p.withColumn("_g", F.explode(letter_runs(F.col("_key")))).join(registry_side(l.withColumn("_g", F.explode(letter_runs(F.col("_label"))))), "_g").select("_row", "doc_id", "value", "confidence", "_key", "name", "_label").distinct()
    same, other = met.where("_key = _label").withColumn("_s", F.lit(100.0)), met.where("_key != _label").withColumn("_s", T.similarity(F.col("_label"), F.col("_key")))
    trust = F.least(F.lit(0.97), PRIORS["kv"] * F.col("_s") / 100 * F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))))
    return same.unionByName(other).where(F.col("_s") >= least).select("doc_id", "name", F.col("value"), F.round(trust, 4).alias("confidence"))


def table_candidates(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, name, value, confidence): the cell below a header cell, or else right of it, whose text is a label.

    cells: (doc_id, table_id, row, col, row_span, col_span, text, is_header); spans are honoured."""
    h = cells.join(registry_side(labels.select("name", T.fold(F.col("label")).alias("_l"))), T.fold(F.col("text")) == F.col("_l")).select("doc_id", "table_id", "name", F.col("row").alias("r"), F.col("col").alias("c"), F.col("row_span").alias("rs"), F.col("col_span").alias("cs"), "is_header")
    j = h.join(cells.select("doc_id", "table_id", "row", "col", "row_span", "col_span", "text"), ["doc_id", "table_id"])
    below = (F.col("row") == F.col("r") + F.col("rs")) & (F.col("col") < F.col("c") + F.col("cs")) & (F.col("col") + F.col("col_span") > F.col("c"))
    right = (F.col("col") == F.col("c") + F.col("cs")) & (F.col("row") < F.col("r") + F.col("rs")) & (F.col("row") + F.col("row_span") > F.col("r"))
    prefer = F.when(F.col("is_header"), below).otherwise(right)
    return j.where(below | right).where(F.trim("text") != "").select("doc_id", "name", F.col("text").alias("value"), F.when(prefer, PRIORS["table"]).otherwise(0.60).alias("confidence"))


def candidate_score(prior: Column, confidence: Column, kind: Column) -> Column:
    factor = F.element_at(F.create_map(*[x for k, v in FACTORS.items() for x in (F.lit(k), F.lit(v))]), kind)
    return F.least(F.lit(0.995), prior * confidence * factor)


def resolve(candidates: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, name, value, normalized, score, verification, error, accepted, locator, multi) -> the chosen rows with ord.

    Accepted ones come first, by score, then verification, then without error, then locator; without any, the best
    refused one is reported. Fields of several values keep up to `most` different ones."""
    c = candidates.withColumn("_best", F.max(F.col("accepted").cast("int")).over(Window.partitionBy("doc_id", "name"))).where("accepted or _best = 0")
    order = [F.col("score").desc(), F.col("verification").desc(), F.col("error") != "", "locator", "value"]
    same = Window.partitionBy("doc_id", "name", F.lower("normalized")).orderBy(*order)
    c = c.withColumn("_d", F.row_number().over(same)).where("_d = 1")
    c = c.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(*order))).where((F.col("ord") == 1) | (F.col("multi") & F.col("accepted") & (F.col("ord") <= most)))
    return c.withColumn("confidence", F.round(F.when(F.col("verification") >= 2, F.greatest("score", F.lit(0.90))).otherwise(F.col("score")), 4)).drop("_best", "_d")


def outcome(fields: DataFrame, specs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per document: missing_required, needs_review and fill_rate of its doctype's declared fields.

    fields: (doc_id, doctype_id, name, value, confidence, validator_error), specs: (doctype_id, name, required)."""
    docs = fields.select("doc_id", "doctype_id").distinct()
    every = docs.join(registry_side(specs), "doctype_id").join(fields.select("doc_id", "name", "value", "confidence", "validator_error"), ["doc_id", "name"], "left")
    full = F.coalesce("value", F.lit("")) != ""
    doubt = full & ((F.col("confidence") < settings.accept_confidence) | (F.coalesce("validator_error", F.lit("")) != ""))
    g = every.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("required") & ~full, F.col("name")))), ",").alias("missing_required"), F.max(doubt).alias("_doubt"), F.round(F.avg(full.cast("double")), 4).alias("fill_rate"))
    return g.select("doc_id", "missing_required", (F.col("_doubt") | (F.col("missing_required") != "")).alias("needs_review"), "fill_rate")


def grounded(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """answers (doc_id, name, value, quote) with grounded: the quote stands in the text, and the value in the quote."""
    f = lambda c: T.fold(F.col(c))
    j = answers.join(texts.select("doc_id", F.col("text").alias("_t")), "doc_id", "left")
    return j.withColumn("grounded", F.coalesce((f("quote") != "") & (f("value") != "") & f("_t").contains(f("quote")) & f("quote").contains(f("value")), F.lit(False))).drop("_t")


def fill_missing(fields: DataFrame, produced: DataFrame) -> DataFrame:
    """fields (doc_id, name, value, source) with the values a tier produced, where there was none; nothing is overwritten."""
    j = fields.join(produced.select("doc_id", "name", F.col("value").alias("_v"), F.col("source").alias("_s")), ["doc_id", "name"], "left")
    empty = F.coalesce("value", F.lit("")) == ""
    return j.select("doc_id", "name", F.when(empty, F.col("_v")).otherwise(F.col("value")).alias("value"), F.when(empty & F.col("_v").isNotNull(), F.col("_s")).otherwise(F.col("source")).alias("source"))


def induce_fields(pairs: DataFrame, least_support: float = 0.6) -> DataFrame:
    """(doc_id, key, value) -> draft fields: keys as snake names that enough documents have, with a suggested type."""
    p = pairs.withColumn("name", T.slug(F.col("key"))).where("name != ''")
    n = p.select(F.count_distinct("doc_id").alias("n"))
    shape = F.when(F.col("value").rlike(r"^\s*[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\s*$"), "date").when(F.col("value").rlike(r"^[\s$€£+-]*[0-9][0-9.,' ]*$"), "number").otherwise("string")
    g = p.withColumn("_shape", shape).groupBy("name").agg(F.count_distinct("doc_id").alias("support"), F.avg((F.col("_shape") == "date").cast("double")).alias("_d"), F.avg((F.col("_shape") == "number").cast("double")).alias("_n"))
    kept = g.join(F.broadcast(n)).where(F.col("support") >= F.greatest(F.lit(1), F.ceil(F.col("n") * least_support)))
    return kept.select("name", "support", F.when(F.col("_d") >= 0.6, "date").when(F.col("_n") >= 0.6, "number").otherwise("string").alias("type"))


def induce_labels(labels: DataFrame, least: float = 90.0) -> DataFrame:
    """(origin, doc_id, label) -> (origin, label, support): labels that are alike form a cluster named after the commonest one.

    Greedy and dependent on order, so labels are first counted, then clustered by one task an origin, the commonest first."""
    counted = labels.withColumn("label", T.fold(F.col("label"))).groupBy("origin", "label").agg(F.collect_set("doc_id").alias("docs"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        clusters: list[tuple[str, set]] = []
        for r in sorted(g.itertuples(), key=lambda r: (-len(r.docs), r.label)):
            for name, docs in clusters:
                if T.label_similarity(name, r.label) >= least:
                    docs.update(r.docs)
                    break
            else:
                clusters.append((r.label, set(r.docs)))
        return pd.DataFrame([(g.origin.iloc[0], name, len(docs)) for name, docs in clusters], columns=["origin", "label", "support"])

    return counted.groupBy("origin").applyInPandas(run, "origin string, label string, support long")


def schema_version(specs: DataFrame) -> DataFrame:
    """(doctype_id, ord, name, type, pattern, validator, locators) -> (doctype_id, version): a digest of the declared fields."""
    one = F.concat_ws(":", "name", "type", F.coalesce("pattern", F.lit("")), F.coalesce("validator", F.lit("")), F.array_join("locators", ","))
    g = specs.groupBy("doctype_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("s")))).alias("x"))
    return g.select("doctype_id", F.concat(F.lit("reg-"), F.substring(F.sha2(F.array_join(F.transform("x", lambda v: v["s"]), "|").cast("binary"), 256), 1, 12)).alias("version"))
