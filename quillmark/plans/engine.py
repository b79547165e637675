"""The engine's entry points: classify, segment, compare, extract, process and induce, each from tables to a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators import anchors as A
from quillmark.operators import extract as X
from quillmark.operators import forms, identify, layout, lexical, process, segments, verdict
from quillmark.settings import DEFAULTS, Settings
from quillmark.tables import local_rows, written


@dataclass
class Registry:
    """The tables that say what there is to find. Each is a small table; identifiers and specs may be missing."""

    anchors: DataFrame  # doctype_id, ord, text, decisive, zone
    negatives: DataFrame  # doctype_id, ord, text
    confusables: DataFrame  # doctype_id, other_id
    profiles: DataFrame  # class, term, z, weight
    patterns: DataFrame | None = None  # doctype_id, ord, pattern
    validators: DataFrame | None = None  # doctype_id, ord, validator
    labels: DataFrame | None = None  # name, label, type, pattern, weight
    specs: DataFrame | None = None  # doctype_id, name, type, validator, multi, required, pii, spec_ord


def classify(docs: DataFrame, registry: Registry, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, text) -> every document's doctype, or unknown and why. A document without tokens has no row in any channel
    and comes out as unknown with the reason `no_text`; an empty registry makes all of them so."""
    blocks, zones = layout.text_blocks(docs), A.plain_zone_texts(docs)
    found = written(A.anchor_hits(blocks, registry.anchors, settings, zones))
    checks = local_rows(docs.sparkSession, [], "doc_id bigint, doctype_id string, verified boolean, format_ok boolean, corroborated boolean").select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "doctype_id", "verified", "format_ok", "corroborated")
    if registry.patterns is not None and registry.validators is not None:
        labels = local_rows(docs.sparkSession, [], "doctype_id string, validator string, label string")
        checks = written(identify.evidence(docs, registry.patterns, registry.validators, labels).select("doc_id", "doctype_id", "verified", "format_ok", "corroborated"))
    hits = A.anchor_scores(found, A.negative_hits(blocks, registry.negatives, zones), registry.anchors, checks, settings).select("doc_id", "doctype_id", "bits", "score", F.col("coverage").alias("anchor_coverage"))
    muted = A.muted_peers(registry.confusables, identify.muted_claims(zones, registry.anchors))
    owner = identify.conclusive(found, A.uncontested(found, registry.anchors), checks, muted).withColumn("_owner", F.lit(True))
    lex = lexical.bm25(blocks, registry.profiles, settings).select("doc_id", F.col("class").alias("doctype_id"), "explained", F.col("coverage").alias("lexical_coverage"))
    s = lex.join(hits, ["doc_id", "doctype_id"], "left").join(owner, ["doc_id", "doctype_id"], "left")
    decided = verdict.decide(s.na.fill(0.0, ["bits", "score", "anchor_coverage"]).withColumn("sole_owner", F.coalesce("_owner", F.lit(False))).drop("_owner"), settings)
    blank = docs.select("doc_id").join(decided.select("doc_id"), "doc_id", "left_anti")
    none = blank.select("doc_id", *[v.alias(c) for c, v in (("doctype_id", F.lit("unknown")), ("candidate", F.lit(None).cast("string")), ("abstained", F.lit(True)), ("confidence", F.lit(0.0)), ("margin", F.lit(0.0)), ("support", F.lit(0.0)), ("coverage", F.lit(0.0)), ("route", F.lit("")), ("reason", F.lit("no_text")), ("runners_up", F.lit("")))])
    return decided.unionByName(none)


def span_texts(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, text) and (doc_id, start_page, end_page) -> one document a span: (doc_id as doc#pA-B, of, start_page, end_page, text)."""
    j = pages.select("doc_id", "page", "text").join(spans.select("doc_id", "start_page", "end_page"), "doc_id").where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    t = j.groupBy("doc_id", "start_page", "end_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("#p"), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    return t.select(name.alias("doc_id"), F.col("doc_id").alias("of"), "start_page", "end_page", "text")


def segment(pages: DataFrame, markers: DataFrame, classify_texts: Callable[[DataFrame], DataFrame], rounds: int = 8, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages of bundles -> their segments (doc_id, segment, start_page, end_page, doctype_id).

    Spans between candidate boundaries are classified whole, unidentified ones are absorbed by their neighbours, and the
    ranges that have grown are classified again, until nothing changes (each round but the last has fewer ranges, and there
    are at most so many). classify_texts: (doc_id, text) -> (doc_id, doctype_id)."""
    now = written(segments.spans(pages, segments.candidate_boundaries(pages, markers, settings)).select("doc_id", "start_page", "end_page"))
    known = None
    for _ in range(rounds):
        new = now if known is None else now.join(known.select("doc_id", "start_page", "end_page"), ["doc_id", "start_page", "end_page"], "left_anti")
        texts = span_texts(pages, new)
        answers = texts.join(classify_texts(texts.select("doc_id", "text")).select("doc_id", "doctype_id"), "doc_id", "left").select(F.col("of").alias("doc_id"), "start_page", "end_page", F.coalesce("doctype_id", F.lit("unknown")).alias("doctype_id"))
        known = written(answers if known is None else known.unionByName(answers))
        typed = now.join(known, ["doc_id", "start_page", "end_page"])
        merged = written(segments.absorb(typed.withColumn("span", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_page")))))
        grown = merged.join(now, ["doc_id", "start_page", "end_page"], "left_anti").limit(1).count()
        now = merged.select("doc_id", "start_page", "end_page")
        if not grown:
            return merged
    return merged


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """What two classifications of the same documents come to."""
    return verdict.compare(first, second)


def extract(classified: DataFrame, blocks: DataFrame, pages: DataFrame, registry: Registry, pairs: DataFrame | None = None, as_of_year: int = 2026) -> DataFrame:
    """The fields of classified documents, from labels, key-value pairs and machine-readable zones:
    (doc_id, doctype_id, name, ord, value, normalized, confidence, verification, locator, validator_error)."""
    parts = [forms.label_candidates(blocks, pages, registry.labels).select("doc_id", "name", "value", "confidence", F.lit("label").alias("locator"))]
    parts.append(forms.zone_fields(blocks, as_of_year).select("doc_id", "name", "value", "confidence", F.lit("mrz").alias("locator")))
    if pairs is not None:
        parts.append(X.pair_candidates(pairs, registry.labels.select("name", "label")).select("doc_id", "name", "value", "confidence", F.lit("kv").alias("locator")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    typed = every.join(classified.where("not abstained").select("doc_id", "doctype_id"), "doc_id").withColumn("quality", F.lit(1.0))
    return process.extract_fields(typed, registry.specs)


def run(docs: DataFrame, blocks: DataFrame, pages: DataFrame, registry: Registry, answers: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """classify, extract and process in one: each document's outcome, what it lacks, and whether a person has to look."""
    c = written(classify(docs, registry, settings).select("doc_id", "doctype_id", "abstained"))
    return process.process(c, registry.specs, written(extract(c, blocks, pages, registry)), answers, settings)


def induce(pairs: DataFrame, least_support: float = 0.6) -> DataFrame:
    """Draft fields of an unseen form from key-value pairs of several of its documents."""
    return X.induce_fields(pairs, least_support)
