"""Registered queries of identifiers, forms, extraction, tiers and reports, with DuckDB SQL for each.

Forms are laid out from the rows of the given tables, so that the SQL can say from those rows what has to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import validators as V
from quillmark.operators import anchors as A
from quillmark.operators import evaluate, forms, identify, layout, lexical, process, reports, segments, verdict
from quillmark.operators import extract as X
from quillmark.plans import registry as R
from quillmark.plans.oracles import q, values
from quillmark.sources import intake
from quillmark.tables import local_rows



def nine_digits():
    return F.lpad(((F.col("o_orderkey") * 48271) % 1000000000).cast("string"), 9, "0")


# fixed values: published specimens of machine-readable zones
ZONES = [
    (1, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"),
    (2, "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"),
    (3, "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"),
    (4, "some text\nP<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C46UTO7408122F1204159ZE184226B<<<<<10\nmore"),
    (5, "no zone here\nP<UTO"),
]
VECTORS = [
    ("ssn", "123-45-6789"), ("ssn", "000-12-3456"), ("ssn", "987-65-4320"), ("ein", "12-3456789"), ("ein", "07-1234567"), ("itin", "912-50-1234"), ("itin", "912-93-1234"), ("sin_luhn", "130 692 544"), ("sin_luhn", "130692545"),
    ("sin_luhn", "046454286"), ("curp", "HEGG560427MVZRRL04"), ("curp", "HEGG560427MVZRRL05"), ("rfc", "GODE561231GR8"), ("rfc", "GODE561231GR7"), ("rfc", "GODE561231"), ("mrz_td3", ZONES[0][1]), ("mrz_td3", ZONES[3][1].split("\n", 1)[1].rsplit("\n", 1)[0]),
    ("mrz_td1", ZONES[1][1]), ("mrz_td2", ZONES[2][1]), ("iso_date", "2020-01-31"), ("iso_date", "2026-02-30"), ("generic_date", "1 de enero de 2020"), ("generic_date", "01/02/2020"), ("generic_date", "31/13/1999"), ("name", "  Anna Maria  Eriksson "), ("name", "1"),
    ("address", "12 Long Street\nTown"), ("address", "12"), ("amount", "$1,234.56"), ("amount", "(1,234.56)"), ("amount", "1.234,56"), ("amount", "twelve"), ("unheard_of", "x"), ("ssn", ""),
]
# expected answers of VECTORS, in their order: ok, normalized, error
ANSWERS = [
    (True, "123-45-6789", ""), (False, "", "invalid_area:000"), (False, "", "reserved_for_advertising:never_issued"), (True, "12-3456789", ""), (False, "", "invalid_irs_prefix:07"), (True, "912-50-1234", ""), (False, "", "invalid_group:93"), (True, "130-692-544", ""), (False, "", "luhn_check_failed"),
    (True, "046-454-286", "unassigned_prefix:0"), (True, "HEGG560427MVZRRL04", ""), (False, "", "check_digit_failed:5!=4"), (True, "GODE561231GR8", ""), (True, "GODE561231GR7", "check_digit_soft_fail:7!=8"), (True, "GODE561231", "no_homoclave:check_digit_unavailable"), (True, ZONES[0][1], ""), (False, "", "check_digit_failed:document_number,composite"),
    (True, ZONES[1][1], ""), (True, ZONES[2][1], ""), (True, "2020-01-31", ""), (False, "", "not_a_calendar_date"), (True, "2020-01-01", ""), (True, "2020-02-01", "ambiguous_day_month:assumed_DMY"), (False, "", "not_a_calendar_date"), (True, "Anna Maria Eriksson", ""), (False, "", "no_letters"),
    (True, "12 Long Street, Town", ""), (False, "", "too_short:2"), (True, "1234.56", ""), (True, "-1234.56", ""), (True, "1234.56", ""), (False, "", "no_digits"), (True, "x", "unknown_validator:unheard_of"), (False, "", "empty_value"),
]
SPECS = [("account", "holder", "string", None, False, True, True, 0), ("account", "opened", "date", "iso_date", False, True, False, 1), ("account", "balance", "number", "amount", False, False, False, 2), ("account", "segment", "string", None, False, False, False, 3), ("account", "tax_number", "id", "sin_luhn", False, True, True, 4), ("account", "resident", "bool", None, False, False, False, 5)]
SPEC_SCHEMA = "doctype_id string, name string, type string, validator string, multi boolean, required boolean, pii boolean, spec_ord int"
LABELS = [("holder", "Customer name", "string", None, 1.0), ("opened", "Date opened", "date", None, 1.0), ("balance", "Balance", "number", None, 1.0), ("segment", "Market segment", "string", None, 1.0), ("home", "Home address", "address", None, 1.0)]
LABEL_SCHEMA = "name string, label string, type string, pattern string, weight double"


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifier_sweep(spark, sf_dir):
    d, s = F.col("d"), lambda a, n: F.substring("d", a, n)
    text = F.concat(F.lit("Ref "), F.col("o_orderkey").cast("string"), F.lit("\nSSN "), s(1, 3), F.lit("-"), s(4, 2), F.lit("-"), s(6, 4), F.lit(" EIN "), s(1, 2), F.lit("-"), s(3, 7), F.lit("\nSIN: "), s(1, 3), F.lit(" "), s(4, 3), F.lit(" "), s(7, 3))
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderkey", nine_digits().alias("d")).select("doc_id", text.alias("text"))
    r = identify.sweep(docs)
    return r.select("doc_id", F.col("ord").cast("long").alias("ord"), "validator", "raw", "normalized", "verified", "error", F.col("start").cast("long").alias("start"))


def validator_vectors(spark, sf_dir):
    rows = local_rows(spark, [(k, n, v) for k, (n, v) in enumerate(VECTORS)], "id int, validator string, value string")
    answer = None
    for n in dict.fromkeys(n for n, _ in VECTORS):
        a = V.check(n, F.col("value"))
        answer = F.when(F.col("validator") == n, a) if answer is None else answer.when(F.col("validator") == n, a)
    return rows.withColumn("a", answer).select("id", "validator", "a.ok", "a.normalized", "a.error")


def zone_fields(spark, sf_dir):
    b = local_rows(spark, ZONES, "doc_id int, text string").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("seq"), "text")
    return forms.zone_fields(b, 2026).select("doc_id", "kind", "name", "value", "verified", "confidence")


def passport_zones(spark, sf_dir):
    return local_rows(spark, ZONES, "doc_id int, text string").select("doc_id", F.md5(identify.td3_zone(F.col("text")).cast("binary")).alias("zone"))


def _forms(spark, sf_dir):
    """A form for each customer: (doc_id, seq, page, text, zone, x0, y0, x1, y1) and its page of 1000 by 1400."""
    c = _t(spark, sf_dir, "customer")
    name, day = F.col("c_name"), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")), "yyyy-MM-dd")
    put = lambda seq, text, x0, y0, x1, y1, zone="body": F.struct(F.lit(seq).alias("seq"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(zone).alias("zone"), *[F.lit(float(v)).alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
    blocks = F.array(
        put(0, "ACCOUNT FORM", 300, 40, 700, 80, "title"), put(1, F.concat(F.lit("1. Customer name: "), name, F.lit("  Market segment: "), F.col("c_mktsegment")), 100, 150, 800, 170), put(2, "Date opened", 100, 300, 260, 320), put(3, day, 280, 301, 420, 321),
        put(4, "Balance", 100, 500, 220, 520), put(5, F.format_number(F.col("c_acctbal"), 2), 100, 530, 220, 550), put(6, "Please have your balance and customer name ready when you call us.", 100, 700, 800, 720),
        put(7, "Home address", 100, 900, 300, 920), put(8, F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")), 100, 930, 300, 950), put(9, F.concat(F.lit("Street "), (F.col("c_custkey") % 97).cast("string")), 100, 955, 300, 975), put(10, "Stranger text far away", 100, 1200, 300, 1220),
    )
    b = c.select(F.col("c_custkey").alias("doc_id"), F.inline(blocks)).withColumn("page", F.lit(1))
    return b, c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1000.0).alias("width"), F.lit(1400.0).alias("height"))


def _labelled(spark, sf_dir):
    b, p = _forms(spark, sf_dir)
    return forms.label_candidates(b, p, local_rows(spark, LABELS, LABEL_SCHEMA))


def label_fields(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "name", "value", "confidence", "how")


def mark_fields(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("n"))
    box = lambda x0, y0, x1, y1: [F.lit(float(v)).alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))]
    blocks = c.select("doc_id", F.inline(F.array(F.struct(F.lit(0).alias("seq"), F.lit("Kind of customer").alias("text"), *box(100, 100, 400, 120)), F.struct(F.lit(1).alias("seq"), F.lit("Person").alias("text"), *box(140, 140, 240, 160)), F.struct(F.lit(2).alias("seq"), F.lit("Company").alias("text"), *box(440, 140, 560, 160)), F.struct(F.lit(3).alias("seq"), F.lit("Resident").alias("text"), *box(140, 600, 260, 620))))).withColumn("page", F.lit(1))
    marks = c.select("doc_id", F.inline(F.array(F.struct(F.lit(0).alias("mark"), (F.col("n") % 2 == 0).alias("selected"), *box(110, 140, 130, 160)), F.struct(F.lit(1).alias("mark"), (F.col("n") % 3 == 0).alias("selected"), *box(410, 140, 430, 160)), F.struct(F.lit(2).alias("mark"), (F.col("n") % 5 == 0).alias("selected"), *box(110, 600, 130, 620))))).withColumn("page", F.lit(1))
    pages = c.select("doc_id", F.lit(1).alias("page"), F.lit(1000.0).alias("width"), F.lit(1400.0).alias("height"))
    labels = local_rows(spark, [("kind", "Kind of customer", "string"), ("resident", "Resident", "bool")], "name string, label string, type string")
    return forms.mark_candidates(marks, blocks, pages, labels)


def _specs(spark):
    return local_rows(spark, SPECS, SPEC_SCHEMA)


def _candidates(spark, sf_dir):
    found = _labelled(spark, sf_dir).where("name != 'home'").select("doc_id", "name", "value", "confidence", F.lit("label").alias("locator"))
    c = _t(spark, sf_dir, "customer")
    nine = F.lpad(((F.col("c_custkey") * 7919 + 130692544) % 1000000000).cast("string"), 9, "0")
    kv = c.select(F.col("c_custkey").alias("doc_id"), F.lit("tax_number").alias("name"), nine.alias("value"), F.lit(0.9).alias("confidence"), F.lit("kv").alias("locator"))
    other = c.select(F.col("c_custkey").alias("doc_id"), F.lit("tax_number").alias("name"), F.lit("130692544").alias("value"), F.lit(0.5).alias("confidence"), F.lit("regex").alias("locator"))
    mark = c.select(F.col("c_custkey").alias("doc_id"), F.lit("resident").alias("name"), F.when(F.col("c_nationkey") % 3 == 0, "Yes.").when(F.col("c_nationkey") % 3 == 1, "unchecked").otherwise("perhaps").alias("value"), F.lit(0.86).alias("confidence"), F.lit("mark").alias("locator"))
    return found.unionByName(kv).unionByName(other).unionByName(mark).select("doc_id", F.lit("account").alias("doctype_id"), "name", "value", "confidence", "locator", F.lit(1.0).alias("quality"))


def extracted_fields(spark, sf_dir):
    return process.extract_fields(_candidates(spark, sf_dir), _specs(spark)).select("doc_id", "name", "value", "normalized", "confidence", "verification", "locator", "validator_error")


def _classified(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("account").alias("doctype_id"), (F.col("c_custkey") % 11 == 0).alias("abstained"))


def processed_documents(spark, sf_dir):
    f = process.extract_fields(_candidates(spark, sf_dir), _specs(spark))
    return process.process(_classified(spark, sf_dir), _specs(spark), f)


def _sparse(spark, sf_dir):
    """Fields a to c of each customer, some without a value, and the tiers' answers for them."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    field = lambda n, k: F.struct(F.lit(n).alias("name"), F.when(F.col("doc_id") % k > 0, F.concat(F.lit(n), F.col("doc_id").cast("string"))).alias("value"), F.when(F.col("doc_id") % k > 0, "local").alias("source"), F.lit(ord(n) - 97).alias("ord"))
    fields = c.select("doc_id", F.inline(F.array(field("a", 2), field("b", 3), field("c", 5))))
    say = lambda t, n, k, v: F.struct(F.lit(t).alias("tier"), F.lit(n).alias("name"), F.when(F.col("doc_id") % k == 0, "unavailable").otherwise("ran").alias("state"), F.lit(v).alias("value"))
    answers = c.select("doc_id", F.inline(F.array(say("T2", "a", 4, "from T2"), say("T3", "b", 7, "from T3"), say("T3", "a", 7, "late"))))
    return fields, answers


def tier_ledger(spark, sf_dir):
    return process.tiers(*_tier_inputs(spark, sf_dir))[1]


def _tier_inputs(spark, sf_dir):
    f, a = _sparse(spark, sf_dir)
    return f.select("doc_id", "name", "value", "source"), a


def tier_fields(spark, sf_dir):
    return process.tiers(*_tier_inputs(spark, sf_dir))[0]


def query_names(spark, sf_dir):
    f, _ = _sparse(spark, sf_dir)
    return process.query_fields(f.where("value is null").withColumn("name", F.concat(F.lit(" The "), F.upper("name"), F.lit("-field!"))), 2)


def vendor_fields(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    body = F.to_json(F.create_map(F.lit("kind"), F.struct(F.col("event_type").alias("content"), F.lit(0.5).alias("confidence"), F.lit(None).cast("map<string,struct<content:string>>").alias("valueObject")), F.lit("who"), F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast("double").alias("confidence"), F.create_map(F.lit("id"), F.struct(F.col("user_id").cast("string").alias("content"))).alias("valueObject"))))
    return e.select("event_id", body.alias("body")).select("event_id", F.inline(process.flattened(F.col("body")))).select(F.col("event_id").alias("doc_id"), "name", "value")


def schema_latest(spark, sf_dir):
    rows = [("a", "reg-2", False), ("a", "reg-10", False), ("a", "reg-9", False), ("b", "1.2", True), ("b", "1.10", False), ("c", "7", None)]
    return process.latest_schemas(local_rows(spark, rows, "doctype_id string, version string, active boolean")).select("doctype_id", "version")


def schema_changes(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    row = lambda kind, need: n.select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("doctype_id"), F.col("n_name").alias("name"), kind.alias("type"), need.alias("required"), F.col("n_nationkey").alias("k"))
    old = row(F.lit("string"), F.lit(False)).where("k % 7 != 0")
    new = row(F.when(F.col("n_nationkey") % 5 == 0, "date").otherwise("string"), F.col("n_nationkey") % 4 == 0).where("k % 6 != 0")
    return process.schema_changes(old, new)


def page_adequacy(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(F.col("conv_id") % 9 == 0, F.repeat(F.lit("x"), 200)).when(F.col("conv_id") % 9 == 1, F.concat(F.repeat(F.lit("�"), 500), F.substring("text", 1, 100))).otherwise(F.col("text")).alias("text"), ((F.col("turn") % 4) / 4).alias("image_fraction"))
    return intake.read_channel(intake.adequacy(c)).select("doc_id", "page", "alnum", "adequate", "reason", "channel")


def input_channels(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    given = lambda k, v: F.when(F.col("event_id") % k == 0, v)
    r = e.select(F.col("event_id").alias("doc_id"), given(7, F.lit("i")).alias("ingest"), given(5, F.lit(" ")).alias("layout"), given(3, F.lit("r")).alias("read"), given(2, F.col("event_type")).alias("text"))
    return intake.chosen_input(r)


def capped_views(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return intake.capped_view(layout.text_blocks(d), 3, 500).select("doc_id", F.col("seq").cast("long").alias("seq"), "truncated")


def envelope_blocks(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    entry = F.transform("t", lambda x: F.struct(F.when(x["turn"] % 2 == 0, F.struct((x["turn"] + 1).alias("page"))).alias("page"), F.when(x["turn"] % 2 == 1, x["turn"] + 1).alias("page_number"), F.array(F.struct(x["text"].alias("text"), F.when(x["turn"] == 0, "title").alias("role"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox"))).alias("paragraphs")))
    rows = c.select("doc_id", F.to_json(F.struct(entry.alias("pages"))).alias("payload"))
    return intake.envelope_blocks(rows).select("doc_id", "page", "seq", "zone", F.md5(F.col("text").cast("binary")).alias("text"), F.col("box.x1").alias("x1"))


def inferred_zones(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    line = lambda seq, text, size, y0: F.struct(F.lit(seq).alias("seq"), text.alias("text"), F.lit(float(size)).alias("size"), F.lit(float(y0)).alias("y0"))
    page = F.col("turn") + 1
    lines = F.array(line(0, F.concat(F.lit("Report "), page.cast("string")), 9, 10), line(1, F.substring("text", 1, 20), 20, 100), line(2, F.substring("text", 1, 30), 14, 300), line(3, F.substring("text", 1, 400), 10, 400), line(4, F.concat(F.lit("Page "), page.cast("string")), 9, 780))
    rows = c.select(F.col("conv_id").alias("doc_id"), page.cast("long").alias("page"), F.lit(792.0).alias("height"), F.inline(lines))
    return reports.inferred_zones(rows).select("doc_id", "page", "seq", "zone")


def _members(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 4 + 1).alias("pages"))


def bundle_members(spark, sf_dir):
    return reports.bundles(_members(spark, sf_dir))[0]


def bundle_recall(spark, sf_dir):
    _, true = reports.bundles(_members(spark, sf_dir))
    said = true.where("page % 3 != 0").unionByName(true.where("page % 5 = 0").withColumn("page", F.col("page") + 100))
    shapes = _members(spark, sf_dir).select("bundle").distinct().withColumn("shape", F.when(F.col("bundle") % 2 == 0, "even").otherwise("odd"))
    return reports.bundle_recall(said, true, shapes)


def exemplar_texts(spark, sf_dir):
    types = local_rows(spark, [("a", "Form A", "Office"), ("b", "Form B", None), ("c", "Form C", "Form")], "doctype_id string, label string, authority string")
    anchors = local_rows(spark, [("a", "en", 0, "plain one", False, None), ("a", "en", 1, "sure one", True, None), ("a", "en", 2, "top one", False, "title"), ("a", "en", 3, "left out", False, None), ("a", "fr", 4, "un", False, None), ("b", "en", 0, "Form B", False, None)], "doctype_id string, lang string, ord int, text string, decisive boolean, zone string")
    return reports.exemplars(types, anchors)


def retired_methods(spark, sf_dir):
    return local_rows(spark, reports.RETIRED, "method string, auc double, precision double")


def declared_profiles(spark, sf_dir):
    n = _t(spark, sf_dir, "part")
    declared = n.select(F.col("p_brand").alias("class"), F.lit("label").alias("source"), F.col("p_name").alias("text")).union(n.select("p_brand", F.lit("alias"), "p_type")).union(n.select("p_brand", F.lit("note"), F.lit("of the widget")))
    return reports.declared_counts(declared).select("class", "term", F.round("n", 4).alias("n"))


def fitted_length(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("lang").alias("class"), "text")
    return reports.fitted_counts(d)[1]


def _support(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select(F.col("p_size").alias("doc_id"), F.col("p_name").alias("doctype_id"), ((F.col("p_partkey") * 37 % 101) / 1000).alias("support"), ((F.col("p_partkey") % 5) - 1).cast("double").alias("evidence")).groupBy("doc_id", "doctype_id").agg(F.max("support").alias("support"), F.max("evidence").alias("evidence"))


def considered_types(spark, sf_dir):
    return identify.considered(_support(spark, sf_dir)).select("doc_id", F.col("place").cast("long").alias("place"), "doctype_id", "support")


def _trail(spark, sf_dir):
    s = _support(spark, sf_dir)
    return identify.trail(s.select("doc_id", F.when(F.col("evidence") > 1, "anchor").otherwise("lexical").alias("tier"), F.col("doctype_id").alias("detail"), F.col("support").alias("weight")), 2)


def evidence_trail(spark, sf_dir):
    return _trail(spark, sf_dir)


def channel_leaders(spark, sf_dir):
    return reports.channel_leaders(_trail(spark, sf_dir))


PLAIN_ANCHORS = [(t, o, s, d, z) for t, o, s, d, z in R.ANCHORS]
MUTED = [("sealed", 0, "of the", True, "title"), ("sealed", 1, "nowhere printed at all", True, "title"), ("open", 0, "and", True, "body")]


def _zone_texts(spark, sf_dir):
    return A.plain_zone_texts(_t(spark, sf_dir, "documents"))


def muted_claims(spark, sf_dir):
    return identify.muted_claims(_zone_texts(spark, sf_dir), local_rows(spark, MUTED, "doctype_id string, ord int, text string, decisive boolean, zone string"))


def conclusive_owners(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    hits = A.anchor_hits(layout.text_blocks(d), R.anchors(spark), zones=_zone_texts(spark, sf_dir))
    checks = d.select("doc_id", F.lit("licensed").alias("doctype_id"), F.lit(True).alias("verified"), (F.col("n_chars") % 2 == 0).alias("corroborated")).where("doc_id % 4 = 0")
    peers = d.where("doc_id % 6 = 0").select("doc_id", F.lit("prose_en").alias("doctype_id"))
    return identify.conclusive(hits, A.uncontested(hits, R.anchors(spark)), checks, peers)


def identifier_evidence(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), nine_digits().alias("d"), "o_orderstatus")
    text = F.concat(F.when(F.col("o_orderstatus") == "F", "Social Insurance Number").otherwise("Some number"), F.lit("\n"), F.substring("d", 1, 3), F.lit(" "), F.substring("d", 4, 3), F.lit(" "), F.substring("d", 7, 3))
    patterns = local_rows(spark, [("card", 0, "[0-9]{3} [0-9]{3} [0-9]{3}"), ("card", 1, "("), ("letter", 0, "[0-9]{3} [0-9]{3}$")], "doctype_id string, ord int, pattern string")
    validators = local_rows(spark, [("card", 0, "sin_luhn")], "doctype_id string, ord int, validator string")
    labels = local_rows(spark, [("card", "sin_luhn", "social insurance number")], "doctype_id string, validator string, label string")
    return identify.evidence(o.select("doc_id", text.alias("text")), patterns, validators, labels)


def context_blocks(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("seq"), "text")
    return forms.context(c, c.where("length(text) % 7 = 0"), 1).select("doc_id", "seq")


def merged_views(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("doc_id"), F.col("conv_id").alias("part"), F.col("turn").alias("page"), F.array(F.col("role")).alias("languages"))
    return process.merge_views(c)


def corpus_report(spark, sf_dir):
    j = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    out = F.when(F.col("n_chars") < 300, "abstained").when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").otherwise("wrong")
    return reports.corpus_report(evaluate.corpus_score(j.select(out.alias("outcome"), "lang", "source"), ("lang", "source")).select("lang", "source", "correct", "wrong", "abstained")).select(F.col("ord").cast("long").alias("ord"), "line")


def run_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return intake.run_summary(e.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("outcome"), F.when(F.col("user_id") % 2 == 0, "a").alias("doctype_id"), ((F.col("event_id") % 97) / 100).alias("confidence"), ((F.col("event_id") % 3) / 2).alias("fill_rate")))


def json_responses(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    return intake.responses(n)


def review_list(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return intake.queue_rows(e.select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "pending").otherwise("approved").alias("status"), F.col("ts").alias("created_at")), 25).select("id", "created_at")


def reading_order(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    y = ((F.col("event_id") * 7) % 50 * 12).cast("double")
    x = ((F.col("event_id") * 13) % 400).cast("double")
    b = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("page"), *[F.when(F.col("event_id") % 10 > 0, v).alias(c) for c, v in (("x0", x), ("y0", y), ("x1", x + 50), ("y1", y + 10))])
    return layout.reading_order(b).select("doc_id", "seq", F.col("place").cast("long").alias("place"))


def calibrated_scores(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") * 37 % 101) / 101).alias("score"))
    a, b = reports.fit_platt(e.select("score", (F.col("score") > 0.5).alias("correct")))
    return e.select("id", F.round(reports.platt(F.col("score"), a, b), 6).alias("p"))


def page_types(spark, sf_dir):
    """Per-page classification: each turn is a page, scored by itself, then runs of one type are islands."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("page").cast("string"))
    pages = c.select(key.alias("doc_id"), "text")
    z = A.plain_zone_texts(pages)
    a = R.anchors(spark)
    scores = A.anchor_scores(A.anchor_hits(layout.text_blocks(pages), a, zones=z), A.negative_hits(layout.text_blocks(pages), R.negatives(spark), z), a)
    best = verdict.top(scores, "doc_id", [F.col("bits").desc(), F.col("doctype_id")], 1).where("bits > 0")
    j = c.select("doc_id", "page", key.alias("k")).join(best.select(F.col("doc_id").alias("k"), "doctype_id", "score"), "k", "left")
    return segments.page_islands(j.select("doc_id", "page", F.coalesce("doctype_id", F.lit("unknown")).alias("doctype_id"), F.coalesce("score", F.lit(0.0)).alias("confidence"))).select("doc_id", "doctype_id", "start_page", "end_page")


def table_overlaps(spark, sf_dir):
    """Paragraph spans against table spans of a layout payload: what overlaps is in the table zone."""
    from quillmark.sources import ingest

    n = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    para = lambda k: F.struct(F.concat(F.lit("p"), F.lit(k)).alias("content"), F.array(F.struct((F.col("doc_id") % 10 + k * 10).alias("offset"), F.lit(5).alias("length"))).alias("spans"))
    body = F.struct(F.struct(F.array(*[para(k) for k in range(3)]).alias("paragraphs"), F.array(F.struct(F.array(F.struct(F.lit(12).alias("offset"), F.lit(6).alias("length"))).alias("spans"))).alias("tables")).alias("analyzeResult"))
    return ingest.layout_blocks(ingest.layout_payloads(n.select("doc_id", F.to_json(body).alias("payload")))).select("doc_id", F.col("seq").cast("long").alias("seq"), "zone")


def registry_violations(spark, sf_dir):
    types = local_rows(spark, [("a", "US", "tax"), ("b", None, "tax"), ("c", "CA", "identity")], "doctype_id string, country string, category string")
    anchors = local_rows(spark, [("a", "Form 1"), ("a", "form 1"), ("b", "Form 2"), ("x", "Lost")], "doctype_id string, text string")
    like = local_rows(spark, [("a", "b"), ("a", "z"), ("c", "c")], "doctype_id string, other_id string")
    checks = local_rows(spark, [("a", "ssn"), ("y", "nope")], "doctype_id string, validator string")
    return R.cross_violations(types, anchors, like, checks)


def listed_types(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("doctype_id"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("country"), F.when(F.col("n_nationkey") % 2 == 0, "tax").otherwise("other").alias("category"))
    return R.listed(n, "r2", "tax").select("doctype_id")


ALL = (registry_violations, listed_types, identifier_sweep, validator_vectors, zone_fields, passport_zones, label_fields, mark_fields, extracted_fields, processed_documents, tier_ledger, tier_fields, query_names, vendor_fields, schema_latest, schema_changes, page_adequacy, input_channels, capped_views, envelope_blocks, inferred_zones, bundle_members, bundle_recall, exemplar_texts, retired_methods, declared_profiles, fitted_length, considered_types, evidence_trail, channel_leaders, muted_claims, conclusive_owners, identifier_evidence, context_blocks, merged_views, corpus_report, run_summary, json_responses, review_list, reading_order, calibrated_scores, page_types, table_overlaps)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
