"""Registered queries of the document-typing operators, over the tables of a folder, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import validators as V
from quillmark.operators import anchors as A
from quillmark.operators import evaluate, extract, identify, layout, lexical, review, segments, verdict
from quillmark.plans import registry as R
from quillmark.plans.oracles import ORACLES
from quillmark.sources.ingest import html_blocks
from quillmark.tables import local_rows, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_blocks(spark, sf_dir):
    return layout.text_blocks(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.col("seq").cast("long").alias("seq"), "zone", "text")


def doc_normal_forms(spark, sf_dir):
    f = T.fold(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(f.cast("binary")).alias("folded"), F.md5(T.skeleton(f).cast("binary")).alias("skeleton"), F.size(T.tokens(T.skeleton(f))).cast("long").alias("n_tokens"), F.md5(T.redact(F.col("text")).cast("binary")).alias("redacted"), F.md5(T.slug(F.col("text")).cast("binary")).alias("slug"))


def _blocks(spark, sf_dir):
    return layout.text_blocks(documents(spark, sf_dir).select("doc_id", "text"))


def doc_terms(spark, sf_dir):
    return lexical.document_terms(_blocks(spark, sf_dir))


def doc_lengths(spark, sf_dir):
    return lexical.document_lengths(_blocks(spark, sf_dir))


def doc_bigrams(spark, sf_dir):
    b = lexical.block_tokens(_blocks(spark, sf_dir))
    return b.select(F.explode(T.ngrams(F.col("tokens"), 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def caps_tokens(spark, sf_dir):
    return A.caps_skeletons(_blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_caps"))


def _profiles(spark, sf_dir):
    d = documents(spark, sf_dir)
    return lexical.text_profiles(d.select(F.concat(F.lit("prose_"), "lang").alias("class"), "text"))


def _zones(spark, sf_dir):
    return A.plain_zone_texts(documents(spark, sf_dir))


def term_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir).select("class", "term", "z", "weight")


def profile_doc_freq(spark, sf_dir):
    return lexical.idf(_profiles(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


def _scores(spark, sf_dir):
    return lexical.text_bm25(documents(spark, sf_dir).select("doc_id", "text"), _profiles(spark, sf_dir))


def bm25_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


def softmax_rank(spark, sf_dir):
    s = lexical.softmax(lexical.robust_z(_scores(spark, sf_dir)))
    return verdict.top(s, "doc_id", [F.round("p", 6).desc(), F.col("class")], 2).select("doc_id", "class", F.round("z", 3).alias("z"), F.round("p", 3).alias("p"))


def anchor_hits(spark, sf_dir):
    return A.anchor_hits(_blocks(spark, sf_dir), R.anchors(spark), zones=_zones(spark, sf_dir)).select("doc_id", "doctype_id", F.col("ord").cast("long").alias("ord"), "zone", "match", "weight")


def negative_hits(spark, sf_dir):
    return A.negative_hits(_blocks(spark, sf_dir), R.negatives(spark), _zones(spark, sf_dir)).groupBy("doctype_id").agg(F.count("*").alias("n"))


def _anchor_scores(spark, sf_dir):
    b, a, z = _blocks(spark, sf_dir), R.anchors(spark), _zones(spark, sf_dir)
    return A.anchor_scores(A.anchor_hits(b, a, zones=z), A.negative_hits(b, R.negatives(spark), z), a)


def anchor_bits(spark, sf_dir):
    return _anchor_scores(spark, sf_dir).select("doc_id", "doctype_id", "bits", "score", "coverage")


def contested_claims(spark, sf_dir):
    hits = A.anchor_hits(_blocks(spark, sf_dir), R.anchors(spark), zones=_zones(spark, sf_dir))
    return A.uncontested(hits, R.anchors(spark)).groupBy("doctype_id").agg(F.count("*").alias("n"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document's class, or unknown and why."""
    a = R.anchors(spark)
    z = written(A.plain_zone_phrases(documents(spark, sf_dir), a, R.negatives(spark)))
    found = written(A.anchor_hits(_blocks(spark, sf_dir), a, zones=z))
    hits = A.anchor_scores(found, A.negative_hits(_blocks(spark, sf_dir), R.negatives(spark), z), a).select("doc_id", "doctype_id", "bits", "score", F.col("coverage").alias("anchor_coverage"))
    muted = A.muted_peers(R.confusables(spark), identify.muted_claims(z, a))
    none = local_rows(spark, [], "doc_id bigint, doctype_id string, verified boolean, corroborated boolean")  # prose has no identifiers
    owner = identify.conclusive(found, A.uncontested(found, a), none, muted).withColumn("_owner", F.lit(True))
    lex = _scores(spark, sf_dir).select("doc_id", F.col("class").alias("doctype_id"), "explained", F.col("coverage").alias("lexical_coverage"))
    s = lex.join(hits, ["doc_id", "doctype_id"], "left").join(owner, ["doc_id", "doctype_id"], "left")
    return verdict.decide(s.na.fill(0.0, ["bits", "score", "anchor_coverage"]).withColumn("sole_owner", F.coalesce("_owner", F.lit(False))).drop("_owner"))


def verdict_gates(spark, sf_dir):
    return verdicts(spark, sf_dir).select("doc_id", "doctype_id", "candidate", "abstained", "margin", "support", "coverage", "route", "reason", "runners_up")


def luhn_sweep(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9][0-9 -]{11,22}[0-9]"), F.lit(0))).alias("raw")).withColumn("digits", F.regexp_replace("raw", "[^0-9]", ""))
    return found.where(F.length("digits").between(13, 19)).select("doc_id", "digits", V.luhn(F.col("digits")).alias("ok")).groupBy("doc_id", "digits", "ok").agg(F.count("*").alias("n"))


def pattern_fields(spark, sf_dir):
    c = extract.pattern_candidates(_blocks(spark, sf_dir), R.patterns(spark))
    return c.select("doc_id", "name", "value", "zone", F.col("seq").cast("long").alias("seq"), "confidence")


def validated_numbers(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(((F.col("o_orderkey") * 48271) % 1000000000).cast("string"), 9, "0").alias("v"))
    one = [n.select("o_orderkey", F.lit(k).alias("validator"), V.check(k, F.col("v")).alias("a")) for k in ("ssn", "ein", "itin", "sin_luhn")]
    u = one[0].union(one[1]).union(one[2]).union(one[3])
    return u.select("o_orderkey", "validator", "a.ok", "a.normalized", "a.error")


def structural_facts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), (F.col("page_id") % 7 * 200 + 400).cast("double").alias("width"), F.lit(792.0).alias("height"), F.when(F.col("page_id") % 2 == 0, "inch").otherwise("pixel").alias("unit"), F.lit(0.0).alias("angle"))
    f = layout.structural_features(pages, _blocks(spark, sf_dir))
    kinds = local_rows(spark, R.KINDS, "doctype_id string, category string, wants_mrz boolean, wants_marks boolean, wants_tables boolean")
    extra = f.withColumn("table_count", F.col("doc_id") % 4).withColumn("mark_count", F.col("doc_id") % 3).withColumn("has_mrz", F.col("doc_id") % 5 == 0)
    return layout.structural_prior(extra, kinds).join(f, "doc_id").select("doc_id", "doctype_id", "prior", "page_count", "aspect_ratio", "landscape", "digital", "block_count", "char_count")


def page_islands(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(F.length("text") > 200, "long").otherwise("short").alias("doctype_id"), (F.length("text") / 1024).alias("confidence"))
    return segments.page_islands(c).select("doc_id", "doctype_id", "start_page", "end_page", "confidence")


def _bundle(spark, sf_dir):
    c, n = table(spark, sf_dir, "conversations"), F.length("text")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(n > 900, 700.0).otherwise(612.0).alias("width"), F.lit(792.0).alias("height"), (n >= 60).alias("text_adequate"), ((n % 10) / 10).alias("image_fraction"), "text")


def bundle_boundaries(spark, sf_dir):
    markers = local_rows(spark, [(m,) for m in R.MARKERS], "marker string")
    return segments.candidate_boundaries(_bundle(spark, sf_dir), markers)


def bundle_spans(spark, sf_dir):
    return segments.spans(_bundle(spark, sf_dir), bundle_boundaries(spark, sf_dir)).select("doc_id", F.col("span").cast("long").alias("span"), "start_page", "end_page")


def absorbed_segments(spark, sf_dir):
    long = _bundle(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("_last"))
    s = segments.spans(_bundle(spark, sf_dir), bundle_boundaries(spark, sf_dir)).join(long, "doc_id")
    return segments.absorb(s.select("doc_id", "span", "start_page", "end_page", F.when(F.col("start_page") % 2 == 1, "unknown").otherwise("report").alias("doctype_id")))


def grounded_values(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    whole = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    answers = c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("f"), F.col("turn")).alias("name"), F.substring("text", 5, 12).alias("value"), F.when(F.col("turn") % 3 == 2, F.reverse("text")).otherwise(F.substring("text", 1, 60)).alias("quote"))
    return extract.grounded(answers, whole).select("doc_id", "name", "grounded")


def induced_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return extract.induce_fields(e)


def knn_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = evaluate.nearest(e, e, 5)
    return verdict.top(n.withColumn("mean", F.round("mean", 6)), "query_id", [F.col("mean").desc(), F.col("label")], 1).select("query_id", "label", F.round("mean", 4).alias("mean"))


def review_enqueue(spark, sf_dir):
    d = documents(spark, sf_dir)
    classified = d.select("doc_id", (F.col("n_chars") < 300).alias("abstained"))
    fields = d.select("doc_id", F.col("source").alias("name"), F.when(F.col("n_chars") % 3 > 0, F.substring("text", 1, 8)).alias("value"), ((F.col("n_chars") % 100) / 100).alias("confidence"), F.when(F.col("n_chars") % 7 == 0, "checked").alias("validator_error"), (F.col("n_chars") % 2 == 0).alias("required"), (F.col("lang") == "en").alias("pii"), (F.col("n_chars") % 5 == 0).alias("checksum"))
    return review.enqueue(classified, fields).select("id", "doc_id", "field_name", "reason", F.col("required_approvals").cast("long").alias("required_approvals"))


def _decisions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "approve").when(F.col("event_id") % 3 == 1, "correct").otherwise("reject")
    return e.select(F.concat(F.lit("item"), (F.col("user_id") % 50).cast("string")).alias("item_id"), F.col("event_id").alias("seq"), kind.alias("decision"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("r"), (F.col("event_id") % 6).cast("string"))).alias("reviewer"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("value"))


def review_fold(spark, sf_dir):
    items = _decisions(spark, sf_dir).select(F.col("item_id").alias("id")).distinct()
    return review.fold_single(items, _decisions(spark, sf_dir))


def review_double_entry(spark, sf_dir):
    items = _decisions(spark, sf_dir).select(F.col("item_id").alias("id"), F.lit(2).alias("required_approvals")).distinct()
    return review.fold(items, _decisions(spark, sf_dir))


def corpus_score(spark, sf_dir):
    j = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    out = F.when(F.col("n_chars") < 300, "abstained").when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").otherwise("wrong")
    return evaluate.corpus_score(j.select(out.alias("outcome"), "lang", "source"), ("lang", "source"))


def compared(spark, sf_dir):
    d = documents(spark, sf_dir)
    name = lambda k: F.when(F.col("n_chars") % k == 0, "unknown").otherwise(F.col("lang"))
    a, b = d.select("doc_id", name(3).alias("doctype_id")), d.where("n_chars > 100").select("doc_id", F.when(F.col("n_chars") % 11 == 0, F.col("source")).otherwise(name(4)).alias("doctype_id"))
    return verdict.compare(a, b).groupBy("outcome").agg(F.count("*").alias("n"))


def event_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type", evaluate.histogram(F.col("value"), [1, 10, 50, 100]).alias("bucket")).agg(F.count("*").alias("n"))


def event_sessions(spark, sf_dir):
    return evaluate.sessions(table(spark, sf_dir, "events"), 30).select("user_id", F.col("session").cast("long").alias("session"), "started", "ended", "n")


def page_blocks(spark, sf_dir):
    return html_blocks(table(spark, sf_dir, "pages")).select("doc_id", "seq", "zone", "text")


def pricing_summary(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    g = item.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))
    return g.select("l_returnflag", "l_linestatus", F.round("sum_qty", 2).alias("sum_qty"), F.round("revenue", 0).alias("revenue"), "n")


ALL = (doc_blocks, doc_normal_forms, doc_terms, doc_lengths, doc_bigrams, caps_tokens, term_profiles, profile_doc_freq, bm25_scores, softmax_rank, anchor_hits, negative_hits, anchor_bits, contested_claims, verdict_gates, luhn_sweep, pattern_fields, validated_numbers, structural_facts, page_islands, bundle_boundaries, bundle_spans, absorbed_segments, grounded_values, induced_fields, knn_topk, review_enqueue, review_fold, review_double_entry, corpus_score, compared, event_metrics, event_sessions, page_blocks, pricing_summary)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillmark.plans import forms_catalog

    return {f.__name__: f for f in ALL} | forms_catalog.queries()


def oracle_sql() -> dict[str, str]:
    from quillmark.plans import forms_oracles

    return ORACLES | forms_oracles.ORACLES
