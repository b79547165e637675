"""From classified documents to fields: extraction end to end, schema versions, tiers with a ledger, and the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import validators as V
from quillmark.operators import extract as X
from quillmark.operators import forms
from quillmark.settings import DEFAULTS, Settings
from quillmark.tables import registry_side

# fixed values: the order in which locators are asked, and that of verification levels
LOCATORS = ("mrz", "kv", "mark", "table", "label", "regex")
LEVELS = ("none", "format", "checksum")
TIERS = ("T1", "T2", "T3", "T4")
MOST_QUERY_FIELDS = 20
# fixed values: confidence of a grounded answer by what its value proves
GROUNDED = {"missing": 0.30, "loose": 0.45, "quoted": 0.55, "typed": 0.65, "verified": 0.80}


def locator_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LOCATORS]), name)


def judged(candidates: DataFrame, specs: DataFrame) -> DataFrame:
    """candidates (doc_id, doctype_id, name, value, confidence, locator, quality) with what validation says:
    normalized, error, verification (0 to 2), accepted and score. quality is how sure the text layer is (1 if unknown).

    specs: (doctype_id, name, type, validator, multi), a registry table."""
    c = candidates.join(registry_side(specs.select("doctype_id", "name", "type", "validator", "multi")), ["doctype_id", "name"])
    names = [r.validator for r in specs.where("validator is not null").select("validator").distinct().collect()]  # a registry's validators
    value = F.when(F.col("type") == "bool", F.coalesce(forms.as_bool(F.col("value")), F.lit(""))).otherwise(F.col("value"))
    answer, level = F.struct(F.lit(True).alias("ok"), F.col("value").alias("normalized"), F.lit("").alias("error")), F.lit("none")
    for n in names:
        answer = F.when(F.col("validator") == n, V.check(n, F.col("value"))).otherwise(answer)
        level = F.when(F.col("validator") == n, V.verification(n)).otherwise(level)
    c = c.withColumn("value", value).where((F.col("value") != "") & forms.has_shape(F.col("value"), F.col("type")) | F.col("validator").isNotNull())
    c = c.withColumn("a", answer).withColumn("level", F.when(~F.col("a.ok"), "rejected").when(F.col("a.error") != "", "soft").otherwise(level))
    score = X.candidate_score(F.lit(1.0), F.col("confidence") * F.coalesce("quality", F.lit(1.0)), F.col("level"))
    proof = F.when(F.col("level") == "checksum", 2).when(F.col("level") == "format", 1).otherwise(0)
    return c.select("doc_id", "doctype_id", "name", "value", "locator", "multi", F.coalesce(F.when(F.col("a.normalized") == "", F.col("value")).otherwise(F.col("a.normalized")), F.col("value")).alias("normalized"), F.coalesce("a.error", F.lit("")).alias("error"), F.col("a.ok").alias("accepted"), proof.alias("verification"), F.round(score, 4).alias("score"))


def until_verified(candidates: DataFrame) -> DataFrame:
    """Candidates of the locators up to the first, in their order, that has a checksum-verified value."""
    w = Window.partitionBy("doc_id", "name")
    first = F.min(F.when((F.col("verification") == 2) & F.col("accepted"), locator_rank(F.col("locator")))).over(w)
    return candidates.withColumn("_f", first).where(F.col("_f").isNull() | (locator_rank(F.col("locator")) <= F.col("_f"))).drop("_f")


def extract_fields(candidates: DataFrame, specs: DataFrame) -> DataFrame:
    """All locators' candidates -> the chosen values of each document's fields: judged, cut after a verified locator,
    resolved. (doc_id, doctype_id, name, ord, value, normalized, confidence, verification, locator, error)."""
    r = X.resolve(until_verified(judged(candidates, specs)))
    return r.select("doc_id", "doctype_id", "name", "ord", F.when(F.col("accepted"), F.col("value")).alias("value"), "normalized", "confidence", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("verification") + 1).alias("verification"), "locator", F.col("error").alias("validator_error"))


def declared(classified: DataFrame, specs: DataFrame) -> DataFrame:
    """Every declared field of every document that was not abstained on: (doc_id, doctype_id, name, required, pii, ord)."""
    return classified.where("not abstained").select("doc_id", "doctype_id").join(registry_side(specs), "doctype_id")


def with_fields(classified: DataFrame, specs: DataFrame, fields: DataFrame) -> DataFrame:
    """declared() with the first value of each field, nulls where there is none."""
    first = fields.where("ord = 1").select("doc_id", "name", "value", "confidence", "verification", "locator", "validator_error")
    return declared(classified, specs).join(first, ["doc_id", "name"], "left")


def query_fields(missing: DataFrame, most: int = MOST_QUERY_FIELDS) -> DataFrame:
    """(doc_id, name, ord) -> (doc_id, names): the fields to ask for, as names that a query may have (letters, digits,
    underscores), each once, in declared order, at most so many."""
    n = missing.withColumn("name", T.slug(F.col("name"))).where("name != ''").groupBy("doc_id", "name").agg(F.min("ord").alias("ord"))
    top = n.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "name"))).where(F.col("_k") <= most)
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda x: x["name"]), ",").alias("names"))


def flattened(payload: Column, depth: int = 2) -> Column:
    """A vendor's field object {name: {content, value..., confidence, valueObject}} as array<struct(name, value, confidence)>;
    objects inside give names joined by dots, to the given depth."""
    leaf = "struct<content:string,valueString:string,confidence:double,valueObject:{}>"
    kind = leaf.format("string")
    for _ in range(depth - 1):
        kind = leaf.format(f"map<string,{kind}>")
    one = lambda name, v: F.struct(name.alias("name"), F.coalesce(v["content"], v["valueString"]).alias("value"), v["confidence"].alias("confidence"))
    m = F.from_json(payload, f"map<string,{kind}>")
    entries = F.coalesce(F.map_entries(m), F.array())
    top = F.transform(entries, lambda e: one(e["key"], e["value"]))
    if depth > 1:
        inner = F.flatten(F.transform(entries, lambda e: F.coalesce(F.transform(F.map_entries(e["value"]["valueObject"]), lambda x: one(F.concat(e["key"], F.lit("."), x["key"]), x["value"])), F.array().cast("array<struct<name:string,value:string,confidence:double>>"))))
        top = F.concat(top, inner)
    return F.filter(top, lambda x: F.coalesce(x["value"], F.lit("")) != "")


def grounded_confidence(quoted: Column, typed: Column, verified: Column) -> Column:
    """What an answer is worth: one without its quote in the text is missing."""
    return F.when(~quoted, GROUNDED["missing"]).when(verified, GROUNDED["verified"]).when(typed, GROUNDED["typed"]).otherwise(GROUNDED["quoted"])


def tier_pass(fields: DataFrame, answers: DataFrame, tier: str) -> tuple[DataFrame, DataFrame]:
    """One tier: fields (doc_id, name, value, source) with its answers (doc_id, name, value, state) where a value was
    missing, and its ledger (doc_id, tier, state, asked, filled): skipped if nothing was missing, the state that the answers'
    table gives a document (ran, misconfigured, unavailable, error), else skipped."""
    empty = F.coalesce("value", F.lit("")) == ""
    need = fields.groupBy("doc_id").agg(F.count_if(empty).alias("asked"))
    state = answers.groupBy("doc_id").agg(F.min("state").alias("state"))
    usable = answers.where("state = 'ran' and coalesce(value, '') != ''").select("doc_id", "name", "value", F.lit(tier).alias("source"))
    after = X.fill_missing(fields, usable)
    gained = fields.where(empty).select("doc_id", "name").join(usable, ["doc_id", "name"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("filled"))
    ledger = need.join(state, "doc_id", "left").join(gained, "doc_id", "left")
    said = F.when(F.col("asked") == 0, "skipped").otherwise(F.coalesce("state", F.lit("skipped")))
    return after, ledger.select("doc_id", F.lit(tier).alias("tier"), said.alias("state"), F.when(said == "ran", F.col("asked")).otherwise(F.lit(0).cast("long")).alias("asked"), F.when(said == "ran", F.coalesce("filled", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("filled"))


def tiers(fields: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tiers T2 to T4 one after the other, each for what is still missing: (fields, ledger). answers has a column tier.
    No tier is called from here: answers are a table that someone else has filled."""
    ledger = None
    for t in TIERS[1:]:
        fields, one = tier_pass(fields, answers.where(F.col("tier") == t), t)
        ledger = one if ledger is None else ledger.unionByName(one)
    return fields, ledger


def process(classified: DataFrame, specs: DataFrame, fields: DataFrame, answers: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, doctype_id, status, missing_required, needs_review, fill_rate, review): each document's outcome.

    status: abstained, complete or incomplete; review: why a person has to look (classification_abstained,
    missing_required, unverified_fields), or empty."""
    every = with_fields(classified, specs, fields)
    if answers is not None:
        filled, _ = tiers(every.select("doc_id", "name", "value", F.col("locator").alias("source")), answers)
        every = every.drop("value").join(filled.select("doc_id", "name", "value", "source"), ["doc_id", "name"])
        every = every.withColumn("confidence", F.coalesce("confidence", F.when(F.col("value").isNotNull(), F.lit(GROUNDED["quoted"]))))
    full = F.coalesce("value", F.lit("")) != ""
    doubt = full & ((F.coalesce("confidence", F.lit(0.0)) < settings.accept_confidence) | (F.coalesce("validator_error", F.lit("")) != ""))
    g = every.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("required") & ~full, F.struct("spec_ord", "name")))), lambda x: x["name"]), ",").alias("missing_required"), F.coalesce(F.bool_or(doubt), F.lit(False)).alias("_doubt"), F.round(F.avg(full.cast("double")), 4).alias("fill_rate"))
    j = classified.select("doc_id", "doctype_id", "abstained").join(g, "doc_id", "left")
    miss = F.coalesce("missing_required", F.lit(""))
    why = F.when(F.col("abstained"), "classification_abstained").when(miss != "", "missing_required").when(F.coalesce("_doubt", F.lit(False)), "unverified_fields").otherwise("")
    status = F.when(F.col("abstained"), "abstained").when(miss == "", "complete").otherwise("incomplete")
    return j.select("doc_id", "doctype_id", status.alias("status"), miss.alias("missing_required"), (why != "").alias("needs_review"), F.coalesce("fill_rate", F.lit(0.0)).alias("fill_rate"), why.alias("review"))


def version_key(version: Column) -> Column:
    """Numeric parts of a version, for comparison: 10 comes after 9."""
    return F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """(doctype_id, version, active) -> the active version of each doctype, else its latest by number."""
    w = Window.partitionBy("doctype_id").orderBy(F.coalesce("active", F.lit(False)).desc(), version_key(F.col("version")).desc(), F.col("version").desc())
    return schemas.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields (doctype_id, name, type, required) of two versions -> (doctype_id, name, change, additive): a new field is
    additive if it isn't required; a field that goes, changes its type or becomes required is not."""
    a, b = (x.select("doctype_id", "name", F.struct("type", "required").alias(k)) for x, k in ((old, "a"), (new, "b")))
    j = a.join(b, ["doctype_id", "name"], "full_outer")
    change = F.when(F.col("a").isNull(), F.when(F.col("b.required"), "added_required").otherwise("added")).when(F.col("b").isNull(), "removed").when(F.col("a.type") != F.col("b.type"), "retyped").when(F.col("b.required") & ~F.col("a.required"), "made_required")
    return j.withColumn("change", change).where("change is not null").select("doctype_id", "name", "change", (F.col("change") == "added").alias("additive"))


def merge_views(views: DataFrame) -> DataFrame:
    """Views of parts of a document (doc_id, part, page, languages) -> its pages renumbered in the order of parts, with all
    languages once: (doc_id, page, part, part_page, languages)."""
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "page"))
    langs = views.select("doc_id", F.explode_outer("languages").alias("l")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("languages"))
    return views.select("doc_id", page.cast("long").alias("new"), "part", F.col("page").alias("part_page")).join(langs, "doc_id").select("doc_id", F.col("new").alias("page"), "part", "part_page", "languages")
