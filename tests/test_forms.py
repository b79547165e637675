"""Forms, identifiers, tiers, mail stores, pictures and intake on small inputs, odd ones included."""

import struct

import pytest
from pyspark.sql import functions as F

from quillmark.operators import evaluate, extract, forms, identify, process, reports
from quillmark.sources import formats, ingest, intake
from quillmark.tables import local_rows, registry_side


def compound(streams):
    """A compound file of 512-byte sectors with these small streams: header, table, directory, small table, small data."""
    names, mini, starts, chain = list(streams), b"", [], []
    for n in names:
        data, first = streams[n], len(mini) // 64
        parts = max(1, -(-len(data) // 64))
        starts.append((first, len(data)))
        chain += [*range(first + 1, first + parts), 0xFFFFFFFE]
        mini += data.ljust(64 * parts, b"\0")
    mini_sectors = -(-len(mini) // 512)
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)
    directory = entry("Root Entry", 5, 0, len(mini)) + b"".join(entry(n, 2, a, b) for n, (a, b) in zip(names, starts))
    directory = directory.ljust(-(-len(directory) // 512) * 512, b"\0")
    small = b"".join(struct.pack("<I", x) for x in chain)
    small = small.ljust(-(-len(small) // 512) * 512, b"\xff")
    sectors = [mini.ljust(512 * mini_sectors, b"\0"), directory, small]
    table, at, firsts = [], 0, []
    for part in sectors:
        n = len(part) // 512
        firsts.append(at)
        table += [*range(at + 1, at + n), 0xFFFFFFFE]
        at += n
    table += [0xFFFFFFFD] + [0xFFFFFFFF] * (127 - len(table))
    directory = directory[:116] + struct.pack("<IQ", firsts[0], len(mini)) + directory[128:]
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, firsts[1], 0, 4096, firsts[2], len(small) // 512, 0xFFFFFFFE, 0, at)
    return (head + b"\xff" * (512 - len(head))) + sectors[0] + directory + small + b"".join(struct.pack("<I", x) for x in table)


def wide(s):
    return s.encode("utf-16-le")


def test_mail_stores():
    data = compound({"__substg1.0_0037001F": wide("Offer"), "__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_0C1F001E": b"ann@a.example", "__substg1.0_0E04001F": wide("bob@b.example"), "__substg1.0_3707001F": wide("plan.pdf"), "__substg1.0_1000001F": wide("First line\r\nSecond é")})
    status, media, reason, _, blocks, _ = ingest.read_one(data, "x.msg")
    assert (status, media, reason) == ("ok", "application/x-ole-storage", "")
    assert [(z, t) for _, _, z, t in blocks] == [("title", "Offer"), ("furniture", "From: Ann ann@a.example"), ("furniture", "To: bob@b.example"), ("furniture", "Attachment: plan.pdf"), ("body", "First line"), ("body", "Second é")]
    html = compound({"__substg1.0_10130102": b"<html><body><h1>Top</h1><p>Text</p></body></html>"})
    assert [(z, t) for _, _, z, t in ingest.read_one(html)[4]] == [("title", "Top"), ("body", "Text")]
    assert ingest.read_one(compound({"WordDocument": b"x" * 100}))[0::2][:2] == ("error", "unsupported_type")
    assert ingest.read_one(data[:700])[0] == "error" and ingest.read_one(data[:8] + b"\0" * 600)[2] == "corrupt_compound_file"
    loop = bytearray(data)
    loop[-512:-508] = struct.pack("<I", 0)  # the first sector follows itself
    assert ingest.read_one(bytes(loop))[0] in ("error", "ok")


def test_time_limit_and_pictures_in_packages():
    from tests.test_operators import package

    assert ingest.read_one(b"a\nb", "x.txt", formats.Limits(seconds=-1.0))[2] == "time_limit"
    scan = package({"word/document.xml": "<w:document xmlns:w='urn:w'><w:body/></w:document>", "word/media/image1.png": "x", "word/media/image2.jpeg": "x"})
    assert ingest.read_one(scan)[0::2][:2] == ("needs_ocr", "embedded_images")
    assert formats.embedded_images(scan) == ["word/media/image1.png", "word/media/image2.jpeg"]


def test_sizes_of_pictures(spark):
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000") + b"\xff\xfe\x00\x05abc" + bytes.fromhex("FFC0001108002A00640301110002110103")
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 640) + struct.pack("<HHII", 257, 4, 1, 480) + struct.pack("<I", 38) + struct.pack("<H", 1) + struct.pack("<HHII", 256, 4, 1, 7) + struct.pack("<I", 8)
    assert formats.tiff_frames(tiff) == [(640, 480), (7, 0)] and formats.tiff_frames(b"II*\0") == [] and formats.tiff_frames(b"x") == []
    df = spark.createDataFrame([(1, bytearray(jpeg)), (2, bytearray(b"\xff\xd8\xff")), (3, bytearray(b"none"))], "id int, c binary")
    got = {r.id: r.s for r in df.select("id", intake.image_frames(F.col("c")).alias("s")).collect()}
    assert tuple(got[1]) == (100, 42) and got[2] is None and got[3] is None


def test_label_edges(spark):
    pages = spark.createDataFrame([(k, 1, 1000.0, 1400.0) for k in range(1, 9)], "doc_id long, page int, width double, height double")
    rows = [
        (1, 0, "Roll number:", None), (1, 1, "12345", None),  # reading order, a shaped value
        (2, 0, "Roll number:", None), (2, 1, "Name:", None),  # a caption follows
        (3, 0, "Roll number:", None), (3, 1, "2.", None),  # the form's own numbering
        (4, 0, "Full name and address of the person", None),  # part of a longer phrase
        (5, 0, "Name (as shown on the card)", (100.0, 100.0, 300.0, 120.0)), (5, 1, "ANNA", (100.0, 125.0, 200.0, 145.0)),
        (6, 0, "Name", (100.0, 100.0, 200.0, 120.0)), (6, 1, "Roll number", (220.0, 100.0, 320.0, 120.0)), (6, 2, "BO", (330.0, 100.0, 400.0, 120.0)),  # a caption between is skipped
        (7, 0, "Name: Ann Smith  Roll number: 77", (0.0, 0.0, 500.0, 20.0)), (8, 0, "", None), (8, 1, None, None),
    ]
    blocks = spark.createDataFrame([(d, s, 1, t, "body", *(b or (None,) * 4)) for d, s, t, b in rows], "doc_id long, seq int, page int, text string, zone string, x0 double, y0 double, x1 double, y1 double")
    labels = local_rows(spark, [("roll", "Roll number", "id", None, 1.0), ("name", "Name", "string", None, 1.0), ("name", "address", "string", None, 1.0)], "name string, label string, type string, pattern string, weight double")
    got = {(r.doc_id, r.name): (r.value, r.how) for r in forms.label_candidates(blocks, pages, labels).collect()}
    assert got[1, "roll"] == ("12345", "next line") and (2, "roll") not in got and (3, "roll") not in got and not any(d == 4 for d, _ in got)
    assert got[5, "name"] == ("ANNA", "below") and got[6, "name"] == ("BO", "right") and got[7, "name"] == ("Ann Smith", "same line") and got[7, "roll"] == ("77", "same line")
    assert forms.label_candidates(blocks.limit(0), pages, labels).collect() == []


def test_marks_without_a_rectangle(spark):
    cols = "x0 double, y0 double, x1 double, y1 double"
    marks = spark.createDataFrame([(1, 0, 1, True, None, None, None, None), (1, 1, 1, True, 10.0, 10.0, 20.0, 20.0)], f"doc_id long, mark int, page int, selected boolean, {cols}")
    blocks = spark.createDataFrame([(1, 0, 1, "left one", -60.0, 10.0, 0.0, 20.0), (1, 1, 1, "below", 10.0, 22.0, 40.0, 32.0)], f"doc_id long, seq int, page int, text string, {cols}")
    pages = spark.createDataFrame([(1, 1, 1000.0, 1400.0)], "doc_id long, page int, width double, height double")
    assert {r.mark: r.option for r in forms.bound_marks(marks, blocks, pages).collect()} == {0: "", 1: "left one"}


def test_booleans_and_shapes(spark):
    df = spark.createDataFrame([(v,) for v in ("Yes.", " no ", "X", "perhaps", "", None, "not checked")], "v string")
    assert [r.b for r in df.select(forms.as_bool(F.col("v")).alias("b")).collect()] == ["true", "false", "true", None, None, None, "false"]
    t = spark.createDataFrame([("date", "2020-01-02"), ("date", "soon"), ("number", "(1,234.50)"), ("number", "many"), ("id", "AB-12"), ("id", "lower case"), ("string", "anything"), ("bool", "maybe")], "k string, v string")
    assert [r.ok for r in t.select(forms.has_shape(F.col("v"), F.col("k")).alias("ok")).collect()] == [True, False, True, False, True, False, True, False]


def test_sweep_on_odd_texts(spark):
    text = "SIN 130 692 544, again 130-692-544; CURP HEGG560427MVZRRL04 and RFC GODE561231GR7"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing 12")], "doc_id long, text string")
    got = [(r.ord, r.validator, r.raw, r.verified, r.start) for r in sorted(identify.sweep(docs).collect())]
    assert got[0][1:] == ("sin_luhn", "130 692 544", True, 4) and [g[1] for g in got] == ["sin_luhn", "curp", "rfc"]
    assert all(text[g[4] : g[4] + len(g[2])] == g[2] for g in got) and got[2][3] is False
    bad = local_rows(spark, [("a", 0, "("), ("a", 1, "[0-9]+")], "doctype_id string, ord int, pattern string")
    assert [r.pattern for r in identify.usable_patterns(bad).collect()] == ["[0-9]+"] and identify.usable_patterns(bad.limit(1)).collect() == []


def test_owner_needs_to_be_alone_and_heard(spark):
    pair = "doc_id long, doctype_id string"
    hits = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (4, "a")], pair)
    own = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (4, "a")], pair)
    checks = spark.createDataFrame([(3, "c", True, True), (5, "c", True, False), (1, "a", True, False)], f"{pair}, verified boolean, corroborated boolean")
    got = identify.conclusive(hits, own, checks, spark.createDataFrame([(4, "a")], pair)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a"), (3, "c")]


def test_stop_after_a_verified_locator(spark):
    c = spark.createDataFrame([(1, "n", "kv", 2, True), (1, "n", "label", 0, True), (2, "n", "kv", 2, False), (2, "n", "label", 0, True), (1, "n", "mrz", 0, True)], "doc_id long, name string, locator string, verification int, accepted boolean")
    assert sorted((r.doc_id, r.locator) for r in process.until_verified(c).collect()) == [(1, "kv"), (1, "mrz"), (2, "kv"), (2, "label")]


def test_versions_go_by_number(spark):
    s = spark.createDataFrame([("a", "v9", False), ("a", "v10", False), ("b", "1", None)], "doctype_id string, version string, active boolean")
    assert sorted((r.doctype_id, r.version) for r in process.latest_schemas(s).collect()) == [("a", "v10"), ("b", "1")]


def test_keys_that_are_like_labels(spark):
    labels = local_rows(spark, [("total", "Total"), ("born", "Date of birth")], "name string, label string")
    pairs = spark.createDataFrame([(1, "Totl", "5", None), (1, "zzz", "6", 1.0), (1, None, "7", 1.0), (1, "birth of Date", "8", 1.0), (1, "TOTAL:", "9", 0.1), (1, "TOTAL:", "9", 0.1)], "doc_id long, key string, value string, confidence double")
    got = sorted((r.name, r.value, r.confidence) for r in extract.pair_candidates(pairs, labels).collect())
    assert [g[:2] for g in got] == [("born", "8"), ("total", "5"), ("total", "9"), ("total", "9")] and got[2][2] == 0.45


def test_neighbours_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(evaluate, "KNN_BLOCK", 7)
    r = np.random.default_rng(2)
    v = r.standard_normal((30, 5))
    rows = [(k, [float(x) for x in v[k]], int(k % 3)) for k in range(30)] + [(40, [0.0] * 5, 1), (41, None, 1), (None, [1.0] * 5, 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(x.query_id, x.label): x.mean for x in evaluate.nearest(e, e, 4).collect()}
    u = v.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for k in range(30):
        for c in range(3):
            cos = sorted((float(u[k] @ u[j]) for j in range(30) if j % 3 == c and j != k), reverse=True)[:4]
            assert abs(got[k, c] - sum(cos) / 4) < 1e-9
    assert len(got) == 90


def test_calibration(spark):
    df = spark.range(4000).select((F.col("id") % 100 / 100).alias("score"), (F.col("id") % 100 > F.col("id") % 37).alias("correct"))
    a, b = reports.fit_platt(df, steps=3000, rate=0.5)
    p = [1 / (1 + 2.718281828 ** (a * s + b)) for s in (0.05, 0.5, 0.95)]
    assert p[0] < p[1] < p[2] and reports.fit_platt(df.limit(0)) == (-1.0, 0.0)


def test_tables(spark, tmp_path):
    odd = [(1, "it's \\ \"so\"", None, True, 1.5, ["a", "b"])]
    assert tuple(local_rows(spark, odd, "a int, b string, c string, d boolean, e double, f array<string>").first()) == (1, "it's \\ \"so\"", None, True, 1.5, ["a", "b"])
    assert local_rows(spark, [], "a int").collect() == []
    assert registry_side(spark.range(5), 3).count() == 5
    items = spark.createDataFrame([("x", "pending"), ("y", "approved")], "id string, status string")
    intake.review_table(items, str(tmp_path / "q"))
    intake.review_table(items.where("status = 'pending'").withColumn("id", F.lit("z")), str(tmp_path / "q"))
    assert sorted((r.id, r.status) for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [("y", "approved"), ("z", "pending")]


@pytest.mark.parametrize("policy,channel", [("trust", "text"), ("verify", "recognise"), ("always_ocr", "recognise")])
def test_channels(spark, policy, channel):
    p = spark.createDataFrame([(1, 1, "ab" * 60, 0.9)], "doc_id long, page int, text string, image_fraction double")
    assert intake.read_channel(intake.adequacy(p), policy, engine=True).first().channel == channel


def test_engine_end_to_end(spark):
    from quillmark.operators import lexical
    from quillmark.plans import engine

    invoice, letter = "INVOICE of goods delivered\nTotal amount due for goods\nInvoice total and tax", "Dear friend we write a letter\nWith kind regards and wishes from us"
    labelled = spark.createDataFrame([("invoice", invoice), ("letter", letter)], "class string, text string")
    registry = engine.Registry(
        local_rows(spark, [("invoice", 0, "goods delivered", True, None), ("letter", 0, "kind regards", True, None)], "doctype_id string, ord int, text string, decisive boolean, zone string"),
        local_rows(spark, [("letter", 0, "amount due")], "doctype_id string, ord int, text string"), local_rows(spark, [("invoice", "letter")], "doctype_id string, other_id string"),
        lexical.log_odds_profiles(lexical.class_counts(labelled)), local_rows(spark, [("invoice", 0, "[0-9]{3} [0-9]{3} [0-9]{3}")], "doctype_id string, ord int, pattern string"), local_rows(spark, [("invoice", 0, "sin_luhn")], "doctype_id string, ord int, validator string"),
        local_rows(spark, [("total", "Total", "number", None, 1.0)], "name string, label string, type string, pattern string, weight double"),
        local_rows(spark, [("invoice", "total", "number", "amount", False, True, False, 0)], "doctype_id string, name string, type string, validator string, multi boolean, required boolean, pii boolean, spec_ord int"),
    )
    docs = spark.createDataFrame([(1, invoice + "\nTotal: 12.50"), (2, letter), (3, "nothing that anyone knows"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in engine.classify(docs, registry).collect()}
    assert (got[1].doctype_id, got[2].doctype_id, got[3].doctype_id) == ("invoice", "letter", "unknown") and got[4].reason == got[5].reason == "no_text" and len(got) == 5
    blocks = spark.createDataFrame([(1, 0, 1, "Total: 12.50", "body", None, None, None, None)], "doc_id long, seq int, page int, text string, zone string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 1.0, 1.0)], "doc_id long, page int, width double, height double")
    out = {r.doc_id: (r.status, r.missing_required, r.review) for r in engine.run(docs, blocks, pages, registry).collect()}
    assert out[1] == ("complete", "", "") and out[2][0] in ("complete", "incomplete") and out[3] == ("abstained", "", "classification_abstained")
    one = engine.compare(engine.classify(docs, registry), engine.classify(docs, registry)).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in one} == {"agree": 2, "both_abstained": 3}


def test_segments_are_classified_again_when_they_grow(spark):
    from quillmark.plans import engine

    text = ["A one", "x", "B two", "y", "y", "A three"]
    pages = spark.createDataFrame([(1, k + 1, 612.0 if k not in (1, 3) else 500.0, 792.0, True, 0.0, t) for k, t in enumerate(text)], "doc_id long, page long, width double, height double, text_adequate boolean, image_fraction double, text string")
    seen = []

    def by_first_letter(texts):
        seen.append(texts.count())
        return texts.select("doc_id", F.when(F.col("text").startswith("A"), "a").when(F.col("text").startswith("B"), "b").otherwise("unknown").alias("doctype_id"))

    got = engine.segment(pages, local_rows(spark, [("three",)], "marker string"), by_first_letter)
    assert sorted((r.start_page, r.end_page, r.doctype_id) for r in got.collect()) == [(1, 2, "a"), (3, 5, "b"), (6, 6, "a")]
    assert len(seen) == 2 and seen[1] == 2


def test_forms_broadcast_nothing_that_grows(spark):
    """Pages, blocks and marks have known small sizes here, and still none of them is a side to broadcast."""
    ids = spark.range(4).withColumnRenamed("id", "doc_id").withColumn("page", F.lit(1))
    pages = ids.withColumn("width", F.lit(1000.0)).withColumn("height", F.lit(1400.0))
    box = lambda *v: [F.lit(float(x)).alias(k) for x, k in zip(v, ("x0", "y0", "x1", "y1"))]
    block = lambda seq, text, *v: F.struct(F.lit(seq).alias("seq"), F.lit(text).alias("text"), F.lit("body").alias("zone"), *box(*v))
    blocks = ids.select("doc_id", "page", F.inline(F.array(block(0, "Home address, street", 100, 100, 300, 120), block(1, "Home address", 100, 200, 300, 220), block(2, "1 Road", 100, 225, 300, 245), block(3, "Town", 100, 250, 300, 270))))
    labels = local_rows(spark, [("home", "Home address", "address", None, 1.0), ("home", "address", "address", None, 1.0), ("kind", "Town", "string", None, 1.0)], "name string, label string, type string, pattern string, weight double")
    marks = ids.select("doc_id", "page", F.lit(0).alias("mark"), F.lit(True).alias("selected"), *box(80, 250, 95, 270))
    found, ticked = forms.label_candidates(blocks, pages.unionByName(pages), labels), forms.mark_candidates(marks, blocks, pages, labels)
    for df in (found, ticked):
        assert "BroadcastHashJoin [doc_id" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.seq, r.value, r.how) for r in found.where("name = 'home'").collect())
    assert got == [(k, s, v, h) for k in range(4) for s, v, h in ((1, "1 Road", "below"),)]  # each line once, though two labels fit it and its page is given twice
    assert sorted((r.name, r.value) for r in ticked.collect()) == [("home", "Town")] * 4 + [("kind", "Town")] * 4
