"""Files and layout payloads as tables of blocks, cells and pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources import compound, formats, readers

RESULT = (
    "path string, status string, media_type string, reason string, limits_hit array<string>, "
    "blocks array<struct<seq int, page int, zone string, text string>>, "
    "cells array<struct<table_id int, page int, `row` int, col int, text string, is_header boolean>>"
)


def read_one(data: bytes, name: str = "", limits: formats.Limits = formats.LIMITS) -> tuple:
    """(status, media_type, reason, limits_hit, blocks, cells) of a file: ok, needs_ocr or error; errors are rows, not exceptions."""
    view, media = readers.View(limits), ""
    try:
        if not data:
            raise formats.Refused("empty_file")
        if len(data) > limits.bytes:
            raise formats.Refused("file_too_large")
        media = formats.detect(data, name)
        reader = compound.message if media == "application/x-ole-storage" else readers.READERS.get(media)
        if reader is None:
            status = ("needs_ocr", "no_text_layer_reader") if media.startswith("image/") or media == "application/pdf" else ("error", "unsupported_type")
            return status[0], media, status[1], [], [], []
        reader(data, view)
        if not view.blocks and not view.cells:
            if media in (*formats.PARTS.values(), formats.ODT) and formats.embedded_images(data, limits):
                return "needs_ocr", media, "embedded_images", view.hit, [], []
            raise formats.Refused("no_text")
    except formats.Refused as e:
        return "error", media, str(e), view.hit, [], []
    except (KeyError, IndexError, ValueError, LookupError) as e:
        return "error", media, f"malformed:{type(e).__name__}", view.hit, [], []
    return "ok", media, "", view.hit, view.blocks, view.cells


def ingest(files: DataFrame, limits: formats.Limits = formats.LIMITS) -> DataFrame:
    """(path, content) -> one row per file. Files are read by batches of a partition; nothing is shuffled."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, *read_one(bytes(c) if c is not None else b"", p or "", limits)) for p, c in zip(pdf.path, pdf.content)]
            yield pd.DataFrame(rows, columns=["path", "status", "media_type", "reason", "limits_hit", "blocks", "cells"])

    return files.select("path", "content").mapInPandas(run, RESULT)


def ingest_folder(spark: SparkSession, path: str) -> DataFrame:
    return ingest(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limits: formats.Limits = formats.UNLIMITED) -> DataFrame:
    """(doc_id, seq, page, zone, text, limits_hit) of HTML text columns. Whole texts; with limits, for pages of strangers,
    limits_hit names on every block of a document what was left out of it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, h in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                view = readers.View(limits)
                if h:
                    readers.html_text(h, view)
                rows += [(i, *b, ",".join(view.hit)) for b in view.blocks]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "page", "zone", "text", "limits_hit"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInPandas(run, "doc_id long, seq int, page int, zone string, text string, limits_hit string")


# layout payloads as JSON

LAYOUT = (
    "analyzeResult struct<content string, pages array<struct<pageNumber int, width double, height double, unit string, angle double, "
    "lines array<struct<content string, polygon array<double>>>, selectionMarks array<struct<state string, polygon array<double>>>>>, "
    "paragraphs array<struct<content string, role string, boundingRegions array<struct<pageNumber int, polygon array<double>>>, spans array<struct<offset long, length long>>>>, "
    "tables array<struct<rowCount int, columnCount int, spans array<struct<offset long, length long>>, cells array<struct<kind string, rowIndex int, columnIndex int, rowSpan int, columnSpan int, content string>>>>, "
    "keyValuePairs array<struct<key struct<content string>, value struct<content string>, confidence double>>, "
    "readResults array<struct<page int, width double, height double, unit string, lines array<struct<text string, boundingBox array<double>>>>>>"
)
# fixed values: paragraph roles and their zones
ROLES = {"title": "title", "sectionHeading": "heading", "pageHeader": "furniture", "pageFooter": "furniture", "pageNumber": "furniture", "footnote": "body", "formulaBlock": "body"}


def rectangle(polygon: Column) -> Column:
    """struct(x0, y0, x1, y1) of 4 numbers, or of 6 or more in pairs; else null."""
    xs, ys = (F.filter(polygon, (lambda x, i: i % 2 == 0) if k == 0 else (lambda x, i: i % 2 == 1)) for k in (0, 1))
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when((F.size(polygon) == 4) | ((F.size(polygon) >= 6) & (F.size(polygon) % 2 == 0)), box)


def layout_payloads(rows: DataFrame, json_col: str = "payload") -> DataFrame:
    """rows with `layout`, the parsed payload, and `kind`: layout, read, or unknown."""
    p = rows.withColumn("layout", F.from_json(json_col, LAYOUT)["analyzeResult"])
    return p.withColumn("kind", F.when(F.col("layout.readResults").isNotNull(), "read").when(F.col("layout.pages").isNotNull() | F.col("layout.paragraphs").isNotNull() | F.col("layout.content").isNotNull(), "layout").otherwise("unknown"))


def layout_blocks(payloads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, seq, page, zone, text, box): paragraphs, else lines, else the content; text inside a table's span is in the table zone."""
    role = F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))])
    inside = lambda p: F.exists(F.coalesce("layout.tables", F.array()), lambda t: F.exists(t["spans"], lambda s: F.exists(p["spans"], lambda q: (q["offset"] < s["offset"] + s["length"]) & (s["offset"] < q["offset"] + q["length"]))))
    one = lambda page, zone, text, polygon: F.struct(page.cast("int").alias("page"), zone.alias("zone"), text.alias("text"), rectangle(polygon).alias("box"))
    region = lambda p: F.get(p["boundingRegions"], F.lit(0))
    paragraphs = F.transform("layout.paragraphs", lambda p: one(F.coalesce(region(p)["pageNumber"], F.lit(1)), F.when(F.coalesce(inside(p), F.lit(False)), "table").otherwise(F.coalesce(F.try_element_at(role, F.coalesce(p["role"], F.lit(""))), F.lit("body"))), p["content"], region(p)["polygon"]))
    lines = F.flatten(F.transform("layout.pages", lambda g: F.transform(F.coalesce(g["lines"], F.array()), lambda x: one(g["pageNumber"], F.lit("body"), x["content"], x["polygon"]))))
    read = F.flatten(F.transform("layout.readResults", lambda g: F.transform(F.coalesce(g["lines"], F.array()), lambda x: one(g["page"], F.lit("body"), x["text"], x["boundingBox"]))))
    whole = F.array(one(F.lit(1), F.lit("body"), F.col("layout.content"), F.lit(None).cast("array<double>")))
    some = lambda a: F.when(F.size(a) > 0, a)
    chosen = F.coalesce(some(read), some(paragraphs), some(lines), whole)
    x = payloads.where("kind != 'unknown'").select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(chosen, lambda b: F.trim(b["text"]) != "")).alias("seq", "b"))
    return x.select("doc_id", "seq", "b.page", "b.zone", "b.text", "b.box")


def layout_pairs(payloads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    x = payloads.select(F.col(id_col).alias("doc_id"), F.inline("layout.keyValuePairs"))
    return x.select("doc_id", F.col("key.content").alias("key"), F.col("value.content").alias("value"), "confidence")


def layout_cells(payloads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    t = payloads.select(F.col(id_col).alias("doc_id"), F.posexplode("layout.tables").alias("table_id", "t")).select("doc_id", "table_id", F.explode("t.cells").alias("c"))
    return t.select("doc_id", "table_id", F.col("c.rowIndex").alias("row"), F.col("c.columnIndex").alias("col"), F.coalesce("c.rowSpan", F.lit(1)).alias("row_span"), F.coalesce("c.columnSpan", F.lit(1)).alias("col_span"), F.col("c.content").alias("text"), (F.coalesce("c.kind", F.lit("")).isin("columnHeader", "rowHeader")).alias("is_header"))
