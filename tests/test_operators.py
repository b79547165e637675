"""Operators that SQL doesn't check: segments, review, extraction, readers, streams."""

import io
import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.operators import evaluate, extract, layout, review, segments, verdict
from quillmark.plans import registry
from quillmark.sources import formats, ingest, readers
from quillmark.streaming import review as stream


def test_absorb(spark):
    rows = [(1, 1, 1, 2, "unknown"), (1, 2, 3, 3, "a"), (1, 3, 4, 5, "unknown"), (1, 4, 6, 6, "a"), (1, 5, 7, 7, "b"), (2, 1, 1, 1, "a"), (2, 2, 3, 3, "a"), (3, 1, 1, 1, "unknown"), (3, 2, 5, 5, "unknown")]
    got = segments.absorb(spark.createDataFrame(rows, "doc_id long, span int, start_page long, end_page long, doctype_id string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 6, "a"), (1, 2, 7, 7, "b"), (2, 1, 1, 1, "a"), (2, 2, 3, 3, "a"), (3, 1, 1, 1, "unknown"), (3, 2, 5, 5, "unknown")]


def test_page_slice(spark):
    blocks = spark.createDataFrame([(1, k, k, "t") for k in range(1, 5)], "doc_id long, seq int, page int, text string")
    got = segments.page_slice(blocks, spark.createDataFrame([(1, 2, 3)], "doc_id long, start_page int, end_page int")).collect()
    assert [(r.doc_id, r.page) for r in sorted(got)] == [("1#p2-3", 2), ("1#p2-3", 3)]


def test_double_entry_states():
    i = review.Item(2)
    assert [i.decide("approve", "ann"), i.decide("approve", "ann"), i.decide("approve", " "), i.decide("approve", "bob"), i.decide("reject", "cy")] == ["ok", "same_reviewer", "no_reviewer", "ok", "already_decided"]
    assert (i.status, i.reviewer) == ("approved", "bob")
    i = review.Item(2)
    assert [i.decide("correct", "ann", "1"), i.decide("correct", "bob", "2"), i.decide("correct", "ann", "3"), i.decide("correct", "bob", "3")] == ["ok", "mismatch", "ok", "ok"]
    assert (i.status, i.entered) == ("corrected", "3")
    i = review.Item(1)
    assert [i.decide("correct", "ann", " "), i.decide("nod", "ann"), i.decide("reject", "ann")] == ["no_value", "unknown_decision", "ok"] and i.status == "rejected"


def decisions(n):
    r = random.Random(n)
    return [(f"i{r.randrange(12)}", k, r.choice(["approve", "correct", "reject"]), r.choice(["a", "b", "c", None, " "]), r.choice(["x", "y", None])) for k in range(n)]


@pytest.mark.parametrize("required", [1, 2])
def test_fold_in_batch_and_stream(spark, tmp_path, required):
    rows = decisions(90)
    want = {}
    for i, _, d, who, v in rows:
        item = want.setdefault(i, [review.Item(required), 0])
        item[1] += item[0].decide(d, who, v) != "ok"
    df = spark.createDataFrame(rows, "item_id string, seq long, decision string, reviewer string, value string")
    items = df.select(F.col("item_id").alias("id"), F.lit(required).alias("required_approvals")).distinct()
    got = {r.id: (r.status, r.reviewer, r.corrected_value, r.refused) for r in review.fold(items, df).collect()}
    assert got == {i: (x.status, x.reviewer, x.entered, n) for i, (x, n) in want.items()}
    if required == 1:
        one = {r.id: (r.status, r.refused) for r in review.fold_single(items, df).collect()}
        assert one == {i: (x.status, n) for i, (x, n) in want.items()}
    schema = df.withColumn("required_approvals", F.lit(required)).schema
    for k, part in enumerate((rows[:40], rows[40:])):
        spark.createDataFrame([(*r, required) for r in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.apply_decisions(source).writeStream.format("memory").queryName(f"decided{required}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    seen = spark.table(f"decided{required}").collect()
    assert len(seen) == len(rows)
    last = {r.item_id: r for r in sorted(seen, key=lambda r: r.seq)}
    assert {i: r.status for i, r in last.items()} == {i: x.status for i, (x, _) in want.items()}


def test_enqueue_skips_known_items(spark):
    classified = spark.createDataFrame([(1, True), (2, False)], "doc_id long, abstained boolean")
    fields = spark.createDataFrame([(2, "a", None, 0.9, None, True, False, False), (2, "b", "v", 0.5, None, False, True, True), (2, "c", "v", 0.9, "bad", False, False, False), (2, "d", "v", 0.9, None, False, False, False), (1, "a", None, 0.1, None, True, False, False)], "doc_id long, name string, value string, confidence double, validator_error string, required boolean, pii boolean, checksum boolean")
    got = review.enqueue(classified, fields, spark.createDataFrame([("2:c",)], "id string")).collect()
    assert sorted((r.id, r.reason, r.required_approvals) for r in got) == [("1:__document__", "abstained", 1), ("2:a", "missing_required", 1), ("2:b", "below_confidence_threshold", 2)]


def test_resolution(spark):
    c = spark.createDataFrame([(1, "n", "A", "A", 0.7, 0, "", True, "kv", False), (1, "n", "B", "B", 0.8, 1, "", True, "regex", False), (1, "m", "x", "x", 0.5, 0, "", True, "kv", True), (1, "m", "X", "X", 0.4, 0, "", True, "kv", True), (1, "m", "y", "y", 0.3, 2, "", True, "kv", True), (1, "r", "z", "z", 0.2, 0, "bad", False, "kv", False)], "doc_id long, name string, value string, normalized string, score double, verification int, error string, accepted boolean, locator string, multi boolean")
    got = sorted((r.name, r.ord, r.value, r.confidence) for r in extract.resolve(c).collect())
    assert got == [("m", 1, "x", 0.5), ("m", 2, "y", 0.9), ("n", 1, "B", 0.8), ("r", 1, "z", 0.2)]
    fields = spark.createDataFrame([(1, "t", "a", "v", 0.9, ""), (1, "t", "b", "", 0.0, "")], "doc_id long, doctype_id string, name string, value string, confidence double, validator_error string")
    specs = spark.createDataFrame([("t", "a", True), ("t", "b", True), ("t", "c", False)], "doctype_id string, name string, required boolean")
    assert tuple(extract.outcome(fields, specs).first()) == (1, "b", True, 0.3333)


def test_candidates_of_pairs_and_tables(spark):
    labels = spark.createDataFrame([("born", "Date of birth"), ("total", "Total")], "name string, label string")
    pairs = spark.createDataFrame([(1, "Date of Birth:", "1999", 1.0), (1, "Dat of birth", "2000", 0.2), (1, "Colour", "red", 1.0)], "doc_id long, key string, value string, confidence double")
    assert sorted((r.name, r.value) for r in extract.pair_candidates(pairs, labels).collect()) == [("born", "1999"), ("born", "2000")]
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 1, "Item", True), (1, 0, 0, 1, 1, 2, "Total", True), (1, 0, 1, 0, 1, 1, "Tea", False), (1, 0, 1, 1, 1, 1, "5", False), (1, 0, 1, 2, 1, 1, "EUR", False)], "doc_id long, table_id int, row int, col int, row_span int, col_span int, text string, is_header boolean")
    assert sorted((r.value, r.confidence) for r in extract.table_candidates(cells, labels).collect()) == [("5", 0.78), ("EUR", 0.78)]
    f = spark.createDataFrame([(1, "a", None, None), (1, "b", "x", "kv")], "doc_id long, name string, value string, source string")
    p = spark.createDataFrame([(1, "a", "new", "tier"), (1, "b", "other", "tier")], "doc_id long, name string, value string, source string")
    assert sorted(tuple(r) for r in extract.fill_missing(f, p).collect()) == [(1, "a", "new", "tier"), (1, "b", "x", "kv")]
    drafts = extract.induce_labels(spark.createDataFrame([("kv", 1, "Invoice number"), ("kv", 2, "Invoice numbr"), ("kv", 3, "Invoice number"), ("kv", 3, "Total")], "origin string, doc_id long, label string"))
    assert sorted(tuple(r) for r in drafts.collect()) == [("kv", "invoice number", 3), ("kv", "total", 1)]
    s = spark.createDataFrame([("t", 0, "a", "string", None, None, ["kv"]), ("t", 1, "b", "date", None, "iso_date", ["kv", "label"])], "doctype_id string, ord int, name string, type string, pattern string, validator string, locators array<string>")
    assert extract.schema_version(s).first().version == extract.schema_version(s.orderBy(F.desc("ord"))).first().version


def test_verdict_needs_a_runner_up(spark):
    cols = "doc_id long, doctype_id string, bits double, score double, explained double, lexical_coverage double, anchor_coverage double, sole_owner boolean"
    rows = [(1, "a", 4.0, 0.9, 0.5, 0.5, 0.5, False), (1, "b", 1.0, 0.5, 0.1, 0.1, 0.1, False), (2, "a", 4.0, 0.9, 0.5, 0.5, 0.5, False), (3, "a", 0.0, 0.0, 0.0, 0.0, 0.0, False), (3, "b", 0.0, 0.0, 0.0, 0.0, 0.0, False), (4, "a", 4.0, 0.9, 0.5, 0.5, 0.5, True)]
    got = {r.doc_id: r for r in verdict.decide(spark.createDataFrame(rows, cols)).collect()}
    assert (got[1].doctype_id, got[1].route) == ("a", "concurrence") and got[4].route == "conclusive"
    assert got[2].abstained and got[2].reason == "not identified" and got[3].doctype_id == "unknown" and got[3].confidence == 0.0


def test_registry_checks(spark):
    specs = spark.createDataFrame([("t", "a", "string", None), ("t", "a", "date", "iso_date"), ("x", "b", "blob", "nope")], "doctype_id string, name string, type string, validator string")
    types = spark.createDataFrame([("t",)], "doctype_id string")
    assert sorted(tuple(r) for r in registry.spec_violations(specs, types).collect()) == [("t", "a", "duplicate_name"), ("x", "b", "unknown_doctype"), ("x", "b", "unknown_type"), ("x", "b", "unknown_validator")]
    assert [tuple(r) for r in registry.decisive_collisions(registry.anchors(spark)).collect()] == [("de 1a", "prose_es,prose_fr")]


def test_reading_order_and_limits(spark):
    b = spark.createDataFrame([(1, 0, 1, 50.0, 0.0, 60.0, 10.0, "b"), (1, 1, 1, 0.0, 1.0, 10.0, 11.0, "a"), (1, 2, 1, 0.0, 40.0, 10.0, 50.0, "c"), (1, 3, 1, None, None, None, None, "d")], "doc_id long, seq int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.text for r in layout.reading_order(b).orderBy("place").collect()] == ["a", "b", "c", "d"]
    cut = layout.limit_chars(spark.createDataFrame([(1, k, "xxxx") for k in range(5)], "doc_id long, seq int, text string"), 10)
    assert sorted((r.seq, r.truncated) for r in cut.collect()) == [(0, False), (1, False), (2, True)]


def test_evaluation(spark):
    p, t = (spark.createDataFrame(x, "file string, page int") for x in ([("a", 1), ("a", 3)], [("a", 1), ("a", 2)]))
    assert tuple(evaluate.boundary_score(p, t).first()) == (1, 1, 1, 0.5, 0.5)


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = "xmlns:w='urn:w'"
DOCX = package({"word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Title'/></w:pPr><w:r><w:t>Deed</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>"})
XLSX = package({
    "xl/workbook.xml": "<workbook xmlns:r='urn:r'><sheets><sheet name='Costs' sheetId='1' r:id='rId1'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='rId1' Target='worksheets/sheet9.xml'/></Relationships>",
    "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><t>Price</t></si></sst>", "xl/worksheets/sheet9.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row><c r='A2' t='inlineStr'><is><t>Tea</t></is></c><c r='C2'><v>5</v></c></row></sheetData></worksheet>",
})
PPTX = package({
    "ppt/presentation.xml": "<p xmlns:r='urn:r'><sldIdLst><sldId id='256' r:id='rId2'/></sldIdLst></p>", "ppt/_rels/presentation.xml.rels": "<Relationships><Relationship Id='rId2' Target='slides/slide1.xml'/></Relationships>",
    "ppt/slides/slide1.xml": "<sld><sp><nvPr><ph type='title'/></nvPr><p><r><t>Plan</t></r></p></sp><sp><p><r><t>Point</t></r></p></sp></sld>",
})
ODT = package({"mimetype": formats.ODT, "content.xml": "<d xmlns:t='urn:t'><body><t:h t:outline-level='1'>Act</t:h><t:h t:outline-level='2'>Part</t:h><t:p>Words</t:p></body></d>"})
MAIL = b"From: a@b.example\nTo: c@d.example\nSubject: Hello\nContent-Type: text/plain\n\nBody line\n"
HTML = b"<!doctype html><html><head><title>T</title><style>x</style></head><body><nav>Menu</nav><h1>One</h1><h2>Two</h2><p>Para <b>bold</b></p><table><tr><th>K</th><th>V</th></tr><tr><td>a</td><td>1</td></tr></table></body></html>"
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Caf\'e9 \u8364?5\par Next{\*\gen x}}"


def zones(data, name=""):
    status, media, reason, _, blocks, cells = ingest.read_one(data, name)
    assert status == "ok", reason
    return media.rpartition(".")[2], [(z, t) for _, _, z, t in blocks], [c[4] for c in cells]


def test_readers():
    assert zones(DOCX) == ("document", [("furniture", "Top"), ("title", "Deed"), ("body", "Some text")], ["A", "1"])
    assert zones(XLSX) == ("sheet", [("heading", "Costs"), ("table", "Name Price"), ("table", "Tea 5")], ["Name", "", "Price", "Tea", "", "5"])
    assert zones(PPTX) == ("presentation", [("title", "Plan"), ("body", "Point")], [])
    assert zones(ODT) == ("text", [("title", "Act"), ("heading", "Part"), ("body", "Words")], [])
    assert zones(MAIL)[1] == [("title", "Hello"), ("furniture", "From: a@b.example"), ("furniture", "To: c@d.example"), ("body", "Body line")]
    assert zones(HTML)[1:] == ([("title", "T"), ("furniture", "Menu"), ("title", "One"), ("heading", "Two"), ("body", "Para bold")], ["K", "V", "a", "1"])
    assert zones(RTF)[1] == [("body", "Café €5"), ("body", "Next")]
    assert zones(b"name;price\ntea;5\n", "x.csv")[1:] == ([("table", "name price"), ("table", "tea 5")], ["name", "price", "tea", "5"])
    assert zones("é\n\n b ".encode("cp1252"), "x.txt")[1] == [("body", "é"), ("body", "b")]
    assert zones("﻿hi".encode("utf-16"), "x.txt")[1][0][1].strip("﻿") == "hi"


def test_refusals():
    bomb = package({"word/document.xml": "<a>" + " " * (30 << 20) + "</a>"})
    for data, status, reason in ((b"", "error", "empty_file"), (bomb, "error", "compression_ratio"), (b"%PDF-1.7 ...", "needs_ocr", "no_text_layer_reader"), (b"\x89PNG\r\n\x1a\n" + b"\0" * 20, "needs_ocr", "no_text_layer_reader"), (b"PK\x03\x04broken", "error", "corrupt_archive"), (package({"word/document.xml": "<!DOCTYPE a><a/>"}), "error", "xml_doctype"), (bytes(range(1, 32)) * 20, "error", "not_text")):
        assert ingest.read_one(data)[0::2][:2] == (status, reason)
    tight = formats.Limits(blocks=2, chars=1000)
    assert ingest.read_one(b"a\nb\nc", "x.txt", tight)[3] == ["blocks"]


def test_files_as_a_table(spark, tmp_path):
    for name, data in (("a.docx", DOCX), ("b.txt", b"hello"), ("c.bin", b"\x00\x01" * 50)):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.status, len(r.blocks)) for r in ingest.ingest_folder(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("ok", 3) and got["b.txt"] == ("ok", 1) and got["c.bin"][0] == "error"
    f = spark.read.format("binaryFile").load(str(tmp_path)).select("path", formats.magic_type(F.col("content")).alias("m"))
    assert {r.path.rsplit("/", 1)[1]: r.m for r in f.collect()} == {"a.docx": "application/zip", "b.txt": None, "c.bin": None}


def test_layout_payloads(spark):
    layout_ = {"analyzeResult": {"content": "x", "pages": [{"pageNumber": 1, "width": 8.5, "height": 11, "unit": "inch", "angle": 0}], "paragraphs": [{"content": "Head", "role": "title", "boundingRegions": [{"pageNumber": 1, "polygon": [1, 2, 5, 2, 5, 4, 1, 4]}], "spans": [{"offset": 0, "length": 4}]}, {"content": "cell", "spans": [{"offset": 10, "length": 4}]}], "tables": [{"rowCount": 1, "columnCount": 1, "spans": [{"offset": 8, "length": 10}], "cells": [{"kind": "columnHeader", "rowIndex": 0, "columnIndex": 0, "content": "cell"}]}], "keyValuePairs": [{"key": {"content": "k"}, "value": {"content": "v"}, "confidence": 0.5}]}}
    read = {"analyzeResult": {"readResults": [{"page": 2, "lines": [{"text": "line", "boundingBox": [0, 0, 1, 0, 1, 1, 0, 1]}]}]}}
    p = ingest.layout_payloads(spark.createDataFrame([(1, json.dumps(layout_)), (2, json.dumps(read)), (3, "{}")], "doc_id long, payload string"))
    assert {r.doc_id: r.kind for r in p.select("doc_id", "kind").collect()} == {1: "layout", 2: "read", 3: "unknown"}
    got = sorted((r.doc_id, r.seq, r.page, r.zone, r.text, r.box and tuple(r.box)) for r in ingest.layout_blocks(p).collect())
    assert got == [(1, 0, 1, "title", "Head", (1, 2, 5, 4)), (1, 1, 1, "table", "cell", None), (2, 0, 2, "body", "line", (0, 0, 1, 1))]
    assert [tuple(r) for r in ingest.layout_pairs(p).collect()] == [(1, "k", "v", 0.5)] and ingest.layout_cells(p).first().is_header


def test_rtf_fuzz():
    r = random.Random(2)
    for _ in range(300):
        readers.rtf_text("".join(r.choice(["{", "}", "\\par ", "\\'e9", "\\u233?", "x", "\\*", "\\uc2 ", " "]) for _ in range(30)))
    assert list(itertools.islice(formats.HEADERS, 1))
