"""What comes in and what is done about it: page adequacy, channels, precedence of inputs, envelopes, recogniser lines and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.settings import DEFAULTS, Settings
from quillmark.sources.ingest import rectangle

# fixed values: what a page's text layer needs to count as its text
LEAST_ALNUM, MOST_REPEAT, MOST_CONTROL, MOST_IMAGE = 40, 0.90, 0.50, 0.60
CHANNELS = ("ingest", "layout", "read", "layout_json", "envelope", "text")  # the first that is given counts


def adequacy(pages: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, page, text, image_fraction) with alnum, adequate and reason.

    Too few letters and digits: no. strict also asks whether one glyph makes up most of the text, whether control or
    replacement characters do, and whether an image covers the page."""
    t = F.coalesce("text", F.lit(""))
    solid = F.regexp_replace(t, r"\s", "")
    glyphs = F.filter(F.split(solid, ""), lambda c: c != "")
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    # the commonest glyph: runs of the sorted glyphs
    most = F.aggregate(F.array_sort(glyphs), F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("top")), lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["top"], F.when(a["c"] == c, a["n"] + 1).otherwise(1)).alias("top")))["top"]
    n = F.greatest(F.length(solid), F.lit(1))
    controls = F.length(F.regexp_replace(t, r"[^\x{FFFD}\x00-\x08\x0e-\x1f\x7f-\x9f]", ""))
    image = F.coalesce("image_fraction", F.lit(0.0))
    p = pages.withColumn("alnum", alnum.cast("long")).withColumn("_repeat", most / n).withColumn("_control", controls / F.greatest(F.length(t), F.lit(1)))
    why = F.when(F.col("alnum") < LEAST_ALNUM, "too_few_characters")
    if strict:
        why = why.when(F.col("_repeat") > MOST_REPEAT, "one_repeated_glyph").when(F.col("_control") > MOST_CONTROL, "control_glyphs").when(image >= MOST_IMAGE, "picture_page")
    return p.withColumn("reason", F.coalesce(why, F.lit(""))).withColumn("adequate", F.col("reason") == "").drop("_repeat", "_control")


def read_channel(pages: DataFrame, policy: str = "verify", engine: bool = False) -> DataFrame:
    """Adds channel to adequacy() rows: text, recognise, or none if a page needs a recogniser and there is no engine.

    policy: trust takes a text layer that has characters, verify one that is adequate, always_ocr none."""
    lexical = {"trust": F.col("alnum") >= LEAST_ALNUM, "verify": F.col("adequate"), "always_ocr": F.lit(False)}[policy]
    return pages.withColumn("channel", F.when(lexical, "text").otherwise("recognise" if engine else "none"))


def chosen_input(requests: DataFrame) -> DataFrame:
    """requests with a column for each of CHANNELS -> (doc_id, channel, payload): the first that is given; a request with
    none has channel null, which is an error to its sender."""
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    channel, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(CHANNELS):
        if c in requests.columns:
            channel, payload = F.when(given(c), c).otherwise(channel), F.when(given(c), F.col(c)).otherwise(payload)
    return requests.select("doc_id", channel.alias("channel"), payload.alias("payload"))


ENVELOPE = (
    "pages array<struct<page struct<page int, number int, width double, height double, unit string, languages array<string>, paragraphs array<struct<text string, role string, bbox array<double>>>, lines array<struct<text string, bbox array<double>>>>, "
    "page_number int, width double, height double, unit string, languages array<string>, paragraphs array<struct<text string, role string, bbox array<double>>>, lines array<struct<text string, bbox array<double>>>>>"
)
ENVELOPE_ROLES = {"title": "title", "sectionHeading": "heading", "pageHeader": "furniture", "pageFooter": "furniture", "pageNumber": "furniture"}


def envelope_blocks(rows: DataFrame, json_col: str = "payload") -> DataFrame:
    """(doc_id, page, seq, zone, text, box) of recogniser envelopes: entries with a page each, bare or wrapped, numbered by what
    they say, else by their place; paragraphs, else lines. seq runs through the document in page order."""
    e = rows.select("doc_id", F.posexplode(F.from_json(json_col, ENVELOPE)["pages"]).alias("k", "e"))
    pick = lambda c: F.coalesce(F.col(f"e.page.{c}"), F.col(f"e.{c}"))
    number = F.coalesce("e.page.page", "e.page.number", "e.page_number", F.col("k") + 1)
    role = F.create_map(*[x for k, v in ENVELOPE_ROLES.items() for x in (F.lit(k), F.lit(v))])
    block = lambda zone, text, box: F.struct(zone.alias("zone"), F.trim(text).alias("text"), rectangle(box).alias("box"))
    para = F.filter(F.transform(F.coalesce(pick("paragraphs"), F.array()), lambda p: block(F.coalesce(F.try_element_at(role, F.coalesce(p["role"], F.lit(""))), F.lit("body")), p["text"], p["bbox"])), lambda b: b["text"] != "")
    line = F.filter(F.transform(F.coalesce(pick("lines"), F.array()), lambda p: block(F.lit("body"), p["text"], p["bbox"])), lambda b: b["text"] != "")
    b = e.select("doc_id", number.cast("int").alias("page"), "k", para.alias("p"), line.alias("l")).select("doc_id", "page", "k", F.posexplode(F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("l"))).alias("j", "b"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "k", "j")) - 1
    return b.select("doc_id", "page", seq.cast("long").alias("seq"), "b.zone", "b.text", "b.box")


def recognised_blocks(lines: DataFrame) -> DataFrame:
    """Recogniser lines (doc_id, page, ord, text, box array of 4 or more numbers, confidence) -> body blocks in pixels."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")) - 1
    return lines.where(F.trim("text") != "").select("doc_id", "page", seq.cast("long").alias("seq"), F.lit("body").alias("zone"), F.trim("text").alias("text"), rectangle(F.col("box")).alias("box"), "confidence")


def capped_view(blocks: DataFrame, most_blocks: int, most_chars: int) -> DataFrame:
    """The first blocks of each document within both bounds, and whether any was left out: what a service shows of a view."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    b = blocks.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    b = b.withColumn("_ok", (F.col("_n") <= most_blocks) & (F.col("_c") <= most_chars)).withColumn("truncated", ~F.min("_ok").over(Window.partitionBy("doc_id")))
    return b.where("_ok").drop("_n", "_c", "_ok")


def image_frames(content: Column) -> Column:
    """struct(width, height) of JPEG columns by their first frame header, found without decoding; null for others.

    Segments are walked by their lengths; a file whose header is further than the walk goes has none."""
    h = F.hex(content)
    at = lambda k, n: F.conv(F.substr(h, 2 * k + 1, F.lit(2 * n)), 16, 10).cast("int")
    frame = lambda k: F.substr(h, 2 * k + 1, F.lit(4)).isin("FFC0", "FFC1", "FFC2", "FFC3")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(2), lambda a, _: F.when(frame(a) | (a + 9 >= F.length(content)), a).otherwise(a + 2 + F.coalesce(at(a + 2, 2), F.lit(0))))
    return F.when(h.startswith("FFD8FF") & frame(walk), F.struct(at(walk + 7, 2).alias("width"), at(walk + 5, 2).alias("height")))


def queue_rows(items: DataFrame, most: int) -> DataFrame:
    """The review list: pending items, the oldest first, at most so many."""
    return items.where("status = 'pending'").orderBy("created_at", "id").limit(most)


def responses(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, body): each row as a JSON answer, nulls kept."""
    return rows.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "false"}).alias("body"))


def review_table(items: DataFrame, path: str) -> None:
    """Write the queue as a table of one folder a status, replacing only the statuses that have rows."""
    items.write.mode("overwrite").partitionBy("status").option("partitionOverwriteMode", "dynamic").parquet(path)


def run_summary(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(metric, label, value) of a run's outcomes (doc_id, outcome, doctype_id, confidence, fill_rate): counters by outcome and
    doctype, and the cumulative confidence histogram, as a scraper would read them."""
    bounds = (0.25, 0.5, 0.75, 0.9)
    by = lambda c, m: rows.groupBy(F.col(c).alias("label")).agg(F.count("*").cast("double").alias("value")).select(F.lit(m).alias("metric"), F.coalesce("label", F.lit("none")).alias("label"), "value")
    h = rows.agg(*[F.count_if(F.col("confidence") <= b).cast("double").alias(f"b{k}") for k, b in enumerate(bounds)], F.count("confidence").cast("double").alias("b9"))
    pairs = F.array(*[F.struct(F.lit(f"{b:g}").alias("label"), F.col(f"b{k}").alias("value")) for k, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("label"), F.col("b9").alias("value")))
    hist = h.select(F.inline(pairs)).select(F.lit("confidence_le").alias("metric"), "label", "value")
    fill = rows.agg(F.round(F.avg("fill_rate"), 4).alias("value")).select(F.lit("fill_rate").alias("metric"), F.lit("mean").alias("label"), "value")
    return by("outcome", "documents").unionByName(by("doctype_id", "doctypes")).unionByName(hist).unionByName(fill)
