"""Identifiers in texts, claims that can't be heard, and the one doctype that owns a document's near-proof evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import validators as V
from quillmark.operators.anchors import framed
from quillmark.tables import registry_side

# fixed values: shapes worth a validator's look
SHAPES = {
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", "itin": r"(?<![0-9])9[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9])", "ein": r"(?<![0-9])[0-9]{2}-[0-9]{7}(?![0-9])",
    "sin_luhn": r"(?<![0-9])[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}(?![0-9])", "curp": r"(?U)\b[A-Z]{4}[0-9]{6}[HMX][A-Z]{5}[0-9A-Z][0-9]\b", "rfc": r"(?U)\b[A-ZÑ&]{3,4}[0-9]{6}[0-9A-Z]{3}\b",
}
CAPS = (3, 6)  # most hits of a tier's trail, and most matched terms shown


def matches(text: Column, pattern: str) -> Column:
    """array<struct(raw, start)> of the matches of a pattern; start in code points. Offsets come from what lies between."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = lambda k: F.length(F.array_join(F.slice(between, F.lit(1), k + 1), "")) + F.when(k > 0, F.length(F.array_join(F.slice(found, F.lit(1), F.greatest(k, F.lit(1))), ""))).otherwise(0)
    return F.transform(found, lambda m, k: F.struct(m.alias("raw"), start(k).alias("start")))


def sweep(docs: DataFrame, names: tuple[str, ...] = tuple(SHAPES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, validator, raw, normalized, verified, error, start): the valid identifiers of each text in the order of
    their places, equal ones (by validator and normal form) once. Refused values are left out, soft findings kept."""
    up = F.upper(F.col(text_col))
    found = lambda name: F.transform(matches(F.col("_u"), SHAPES[name]), lambda m: F.struct(F.lit(name).alias("validator"), m["raw"].alias("raw"), m["start"].alias("start")))
    each = F.concat(*[found(n) for n in names])
    rows = docs.select(F.col(id_col).alias("doc_id"), up.alias("_u")).where(F.col("_u").rlike("[0-9]{2}")).select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.*")
    answer = None
    for n in names:
        one = V.check(n, F.col("raw"))
        answer = F.when(F.col("validator") == n, one) if answer is None else answer.when(F.col("validator") == n, one)
    ok = rows.withColumn("a", answer).where("a.ok").select("doc_id", "validator", "raw", "start", F.col("a.normalized").alias("normalized"), F.col("a.error").alias("error"))
    first = ok.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "validator", "normalized").orderBy("start"))).where("_k = 1")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "validator"))
    return first.select("doc_id", place.alias("ord"), "validator", "raw", "normalized", (F.col("validator").isin(*V.CHECKSUM) & (F.col("error") == "")).alias("verified"), "error", "start")


def td3_zone(text: Column) -> Column:
    """The two lines of a passport's zone in a text, or null: the first pair of lines with 44 zone characters of which one
    begins as a passport's does. Guillemets are read as fillers, and blanks inside lines don't count."""
    lines = F.transform(F.split(F.translate(F.upper(text), "«‹", "<<"), r"\R"), lambda x: F.regexp_extract(F.replace(x, F.lit(" "), F.lit("")), "[A-Z0-9<]{44}", 0))
    kept = F.filter(lines, lambda x: x != "")
    pairs = F.filter(F.transform(kept, lambda x, k: F.struct(x.alias("a"), F.get(kept, k + 1).alias("b"))), lambda p: p["a"].rlike("^P[A-Z<][A-Z<]{3}") & p["b"].isNotNull())
    return F.get(F.transform(pairs, lambda p: F.concat(p["a"], F.lit("\n"), p["b"])), F.lit(0))


def usable_patterns(patterns: DataFrame) -> DataFrame:
    """The rows of a small table (…, pattern) whose pattern compiles; others can match nothing and must not end a query."""
    jvm, good = patterns.sparkSession._jvm, []
    for r in patterns.select("pattern").distinct().collect():  # a registry's patterns
        try:
            jvm.java.util.regex.Pattern.compile(r.pattern)
            good.append(r.pattern)
        except Exception:
            continue
    return patterns.where(F.col("pattern").isin(*good)) if good else patterns.limit(0)


def evidence(docs: DataFrame, patterns: DataFrame, validators: DataFrame, labels: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """(doc_id, doctype_id, value, validator, verified, format_ok, corroborated): what doctypes' identifier patterns find.

    patterns (doctype_id, ord, pattern), validators (doctype_id, ord, validator) and labels (doctype_id, validator, label) are
    registry tables and are broadcast. Of a doctype's validators a checksum that accepts wins, else the first that
    accepts. A value is corroborated if a label of that validator is printed on its line or the line above. zones: doctypes
    (doctype_id) that declare a passport zone; an accepted zone corroborates itself."""
    d = docs.select("doc_id", F.split(F.upper("text"), "\n").alias("l")).select("doc_id", F.posexplode("l").alias("k", "line"), F.col("l")).select("doc_id", "k", "line", F.concat_ws("\n", F.get("l", F.col("k") - 1), "line").alias("window"))
    found = d.join(registry_side(usable_patterns(patterns)), F.regexp(F.col("line"), F.col("pattern"))).select("doc_id", "doctype_id", "window", "k", F.posexplode(F.regexp_extract_all("line", F.col("pattern"), F.lit(0))).alias("j", "value"))
    found = found.withColumn("value", F.trim("value")).where("value != ''")
    one = found.groupBy("doc_id", "doctype_id", "value").agg(F.min_by("window", F.struct("k", "j")).alias("window"))
    j = one.join(registry_side(validators), "doctype_id", "left")
    names = [r.validator for r in validators.select("validator").distinct().collect()]  # a registry's validators
    ok = F.lit(False)
    for n in names:
        a = V.check(n, F.col("value"))
        ok = F.when(F.col("validator") == n, a["ok"] & ((a["error"] == "") | (~F.lit(n in V.CHECKSUM)))).otherwise(ok)
    graded = j.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("sum_", F.col("ok") & F.col("validator").isin(*V.CHECKSUM))
    best = graded.groupBy("doc_id", "doctype_id", "value", "window").agg(F.min_by(F.struct("validator", "ok", "sum_"), F.struct(~F.col("sum_"), ~F.col("ok"), F.coalesce("ord", F.lit(0)))).alias("b"))
    best = best.select("doc_id", "doctype_id", "value", "window", F.when(F.col("b.ok"), F.col("b.validator")).alias("validator"), F.col("b.sum_").alias("verified"), (F.col("b.ok") & ~F.col("b.sum_")).alias("format_ok"))
    near = best.join(registry_side(labels.select("doctype_id", "validator", framed(T.skeleton(T.fold(F.col("label")))).alias("_l"))), ["doctype_id", "validator"], "left")
    hit = F.coalesce(framed(T.skeleton(T.fold(F.col("window")))).contains(F.col("_l")), F.lit(False))
    out = near.groupBy("doc_id", "doctype_id", "value", "validator", "verified", "format_ok").agg(F.max(hit).alias("corroborated"))
    if zones is None:
        return out
    td3 = docs.select("doc_id", td3_zone(F.col("text")).alias("z")).where("z is not null").join(registry_side(zones.select("doctype_id")))  # one row a doctype that declares a zone
    td3 = td3.withColumn("_a", V.check("mrz_td3", F.col("z")))
    good = F.coalesce("_a.ok", F.lit(False))
    return out.unionByName(td3.select("doc_id", "doctype_id", F.replace(F.substring(F.split("z", "\n")[1], 1, 9), F.lit("<"), F.lit("")).alias("value"), F.when(good, "mrz_td3").alias("validator"), good.alias("verified"), F.lit(False).alias("format_ok"), F.lit(True).alias("corroborated")))


def muted_claims(zone_texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, doctype_id, ord): decisive anchors pinned to a zone that a document lacks, whose text stands elsewhere in it.
    They could not be heard, which is no evidence of absence."""
    a = anchors.where("decisive and zone is not null").select("doctype_id", "ord", F.col("zone").alias("pinned"), framed(T.skeleton(T.fold(F.col("text")))).alias("_a"))
    whole = zone_texts.where("skeleton != '  '").groupBy("doc_id").agg(F.collect_set("zone").alias("has"), F.array_join(F.collect_list("skeleton"), "|").alias("all"))
    return whole.join(registry_side(a), F.col("all").contains(F.col("_a")) & ~F.array_contains("has", F.col("pinned"))).select("doc_id", "doctype_id", "ord")


def conclusive(hits: DataFrame, own: DataFrame, checks: DataFrame, peers: DataFrame) -> DataFrame:
    """(doc_id, doctype_id): the one doctype with near-proof evidence, if exactly one has it and no confusable peer was muted.

    hits: (doc_id, doctype_id) with any anchor; own: those with a decisive anchor that no other doctype claims; checks: see
    evidence(), of which a verified value counts if it is corroborated or its doctype has any anchor; peers: (doc_id,
    doctype_id) with a muted peer."""
    anchored = hits.select("doc_id", "doctype_id", F.lit(True).alias("_any")).distinct()
    sure = checks.where("verified").join(anchored, ["doc_id", "doctype_id"], "left").where("corroborated or _any").select("doc_id", "doctype_id")
    owners = own.select("doc_id", "doctype_id").union(sure).distinct()
    one = owners.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("doctype_id").alias("doctype_id")).where("n = 1")
    return one.select("doc_id", "doctype_id").join(peers.select("doc_id", "doctype_id").distinct(), ["doc_id", "doctype_id"], "left_anti")


def considered(scores: DataFrame, k: int = 4) -> DataFrame:
    """The k doctypes of each document with the most support among those with evidence: (doc_id, place, doctype_id, support)."""
    w = Window.partitionBy("doc_id").orderBy(F.col("support").desc(), "doctype_id")
    return scores.where("evidence > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("doc_id", "place", "doctype_id", "support")


def trail(parts: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, tier, detail, weight) -> (doc_id, evidence): per document its tiers' heaviest findings, `most` of each, as
    one line a finding, tiers in order."""
    w = Window.partitionBy("doc_id", "tier").orderBy(F.col("weight").desc(), "detail")
    kept = parts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    line = F.struct("tier", "_k", F.format_string("%s: %s (%.4f)", "tier", "detail", "weight").alias("s"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n").alias("evidence"))
