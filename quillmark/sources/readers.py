"""Readers of single files: each yields blocks (zone, page, text) and tables of cells, within the limits."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import time
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

from quillmark.sources import formats
from quillmark.sources.formats import LIMITS, Limits, Refused


class View:
    """Collects a document's blocks and tables; what goes beyond a limit is left out and named in limits_hit."""

    def __init__(self, limits: Limits = LIMITS):
        self.limits, self.blocks, self.cells, self.tables, self.chars, self.hit = limits, [], [], 0, 0, []
        self.until = time.monotonic() + limits.seconds

    def _over(self, name: str) -> bool:
        if name not in self.hit:
            self.hit.append(name)
        return False

    def block(self, text: str | None, zone: str = "body", page: int = 1) -> bool:
        if time.monotonic() > self.until:
            raise Refused("time_limit")
        text = re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", text or "")).strip()
        if not text:
            return False
        if page > self.limits.pages:
            return self._over("pages")
        if len(self.blocks) >= self.limits.blocks:
            return self._over("blocks")
        if len(text) > self.limits.block_chars:
            self._over("block_chars")
            text = text[: self.limits.block_chars]
        if self.chars + len(text) > self.limits.chars:
            return self._over("chars")
        self.chars += len(text)
        self.blocks.append((len(self.blocks), page, zone, text))
        return True

    def table(self, rows: list[list[str]], header: bool = False, page: int = 1, blocks: bool = False) -> None:
        """A grid of cells; blocks also adds each row as a block of the table zone."""
        if self.tables >= self.limits.tables:
            self._over("tables")
            return
        if len(rows) > self.limits.rows:
            self._over("rows")
        self.tables += 1
        for r, row in enumerate(rows[: self.limits.rows]):
            for c, text in enumerate(row):
                if len(self.cells) >= self.limits.cells:
                    self._over("cells")
                    return
                self.cells.append((self.tables - 1, page, r, c, re.sub(r"\s+", " ", text or "").strip(), header and r == 0))
            if blocks:
                self.block(" ".join(x.strip() for x in row if x and x.strip()), "table", page)


def plain(data: bytes, view: View) -> None:
    for line in formats.decode_text(data)[0].splitlines():
        view.block(line)


def comma_separated(data: bytes, view: View) -> None:
    text = formats.decode_text(data)[0]
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=formats.csv_delimiter(text) or ",") if any(x.strip() for x in r)]
    number = re.compile(r"[\s$€£+-]*[0-9][0-9.,% ]*")
    view.table(rows, header=bool(rows) and all(x.strip() and not number.fullmatch(x.strip()) for x in rows[0]), blocks=True)


# fixed values: RTF destinations whose text isn't the document's, and words that stand for characters
_RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr footnote generator listtable listoverridetable rsidtbl themedata xmlnstbl latentstyles datastore".split())
_RTF_CHARS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_text(source: str) -> str:
    """The text of an RTF file: groups of other destinations are skipped, escapes become their characters."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skipped, fallback, pending = False, 1, 0
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?[0-9]+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)", source):
        hexed, word, number, symbol, brace, text = m.groups()
        if brace == "{":
            stack.append((skipped, fallback))
        elif brace == "}":
            skipped, fallback = stack.pop() if stack else (False, 1)
        elif symbol == "*" or word in _RTF_SKIPPED:
            skipped = True
        elif word == "uc":
            fallback = int(number or 1)
        elif skipped:
            continue
        elif word == "u":
            out.append(chr(int(number or 0) % 65536))
            pending = fallback
        elif word:
            out.append(_RTF_CHARS.get(word, ""))
        elif hexed:
            if pending:
                pending -= 1
            else:
                out.append(bytes([int(hexed, 16)]).decode("cp1252", "replace"))
        elif symbol:
            out.append({"~": "\xa0", "_": "-", "\n": "\n", "\r": "\n"}.get(symbol, symbol if symbol in "\\{}" else ""))
        elif text:
            cut = min(pending, len(text))
            pending -= cut
            out.append(text[cut:])
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def rtf(data: bytes, view: View) -> None:
    for line in rtf_text(data.decode("latin-1")).split("\n"):
        view.block(line)


class _Html(HTMLParser):
    # fixed values: what HTML elements mean
    ZONES = {"title": "title", "h1": "title"} | {f"h{k}": "heading" for k in range(2, 7)}
    FURNITURE = frozenset(("header", "footer", "nav"))
    SKIPPED = frozenset(("script", "style", "noscript", "template", "svg"))
    BREAKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure form head hr html legend li main ol option p pre section table tbody td tfoot th thead tr ul".split()) | set(ZONES) | FURNITURE

    def __init__(self, view: View):
        super().__init__(convert_charrefs=True)
        self.view, self.text, self.zone, self.furniture, self.skipped = view, [], None, 0, 0
        self.tables: list[dict] = []

    def end_block(self) -> None:
        text, self.text = "".join(self.text), []
        if self.tables and self.tables[-1]["cell"] is not None:
            self.tables[-1]["cell"].append(text)
            text = ""
        self.view.block(text, "furniture" if self.furniture else self.zone or "body")

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skipped += 1
        if self.skipped:
            return
        if tag in self.BREAKS:
            self.end_block()
        if tag in self.FURNITURE:
            self.furniture += 1
        elif tag in self.ZONES:
            self.zone = self.ZONES[tag]
        elif tag == "table":
            self.tables.append({"rows": [], "cell": None, "th": False})
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.tables:
            self.close_cell()
            t = self.tables[-1]
            t["rows"] = t["rows"] or [[]]
            t["th"] |= tag == "th" and len(t["rows"]) == 1
            t["cell"] = []

    def close_cell(self):
        t = self.tables[-1]
        if t["cell"] is not None:
            t["rows"][-1].append(" ".join(t["cell"]))
            t["cell"] = None

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped:
            return
        if tag in self.BREAKS:
            self.end_block()
        if tag in self.FURNITURE:
            self.furniture = max(0, self.furniture - 1)
        elif tag in self.ZONES:
            self.zone = None
        elif tag in ("td", "th", "tr") and self.tables:
            self.close_cell()
        elif tag == "table" and self.tables:
            self.close_cell()
            t = self.tables.pop()
            self.view.table([r for r in t["rows"] if r], t["th"])

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


def html_text(text: str, view: View) -> None:
    parser = _Html(view)
    parser.feed(text)
    parser.close()
    while parser.tables:
        parser.handle_endtag("table")
    parser.end_block()


def html(data: bytes, view: View) -> None:
    html_text(formats.decode_text(data)[0], view)


def mail(data: bytes, view: View) -> None:
    """Subject as title, addresses and date as furniture, the plain part else the HTML one; attachments are only listed."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    view.block(str(m["subject"] or ""), "title")
    for name in ("from", "to", "cc", "date", "reply-to"):
        if m[name]:
            view.block(f"{name.title()}: {m[name]}", "furniture")
    parts = [p for _, p in zip(range(view.limits.parts), m.walk())]
    body = m.get_body(("plain",)) or m.get_body(("html",))
    if body is not None:
        content = body.get_content()
        if body.get_content_subtype() == "html":
            html_text(content, view)
        else:
            for line in content.splitlines():
                view.block(line)
    for p in parts:
        if p.get_content_disposition() == "attachment":
            view.block(f"Attachment: {p.get_filename() or 'unnamed'}", "furniture")


def parse_xml(data: bytes) -> ET.Element:
    """XML without a document type: no entities are ever declared."""
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", data, re.I) or re.search(rb"<\x00?!\x00?D\x00?O\x00?C", data):
        raise Refused("xml_doctype")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise Refused("malformed_xml") from e


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _text(e: ET.Element) -> str:
    """Text of an office paragraph: runs, tabs and breaks."""
    return "".join((x.text or "") if _name(x) == "t" else "\t" if _name(x) == "tab" else "\n" if _name(x) in ("br", "cr") else "" for x in e.iter())


def docx(data: bytes, view: View) -> None:
    z = formats.open_archive(data)

    def body(parent: ET.Element, zone: str | None) -> None:
        for e in parent:
            if _name(e) == "p":
                style = next((_attr(x, "val") or "" for x in e.iter() if _name(x) == "pStyle"), "")
                view.block(_text(e), zone or ("title" if style == "Title" else "heading" if re.match(r"(?i)heading|subtitle", style) else "body"))
            elif _name(e) == "tbl":
                rows = [[" ".join(_text(p) for p in c.iter() if _name(p) == "p") for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
                head = next((True for x in e.iter() if _name(x) == "tblHeader"), False)
                view.table(rows, head)
            elif _name(e) in ("sdt", "sdtContent", "body", "ins", "customXml"):
                body(e, zone)

    for n in sorted(z.namelist()):
        if re.fullmatch(r"word/header[0-9]*\.xml", n):
            body(parse_xml(formats.read_member(z, n)), "furniture")
    body(parse_xml(formats.read_member(z, "word/document.xml")), None)
    for n in sorted(z.namelist()):
        if re.fullmatch(r"word/footer[0-9]*\.xml", n):
            body(parse_xml(formats.read_member(z, n)), "furniture")


def _relations(z, name: str) -> dict[str, str]:
    folder, _, leaf = name.rpartition("/")
    path = f"{folder}/_rels/{leaf}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in parse_xml(formats.read_member(z, path)):
        target = r.get("Target", "")
        out[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
    return out


def xlsx(data: bytes, view: View) -> None:
    """A page for each sheet in the workbook's order, its name as a heading."""
    z = formats.open_archive(data)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _name(t) == "t") for si in parse_xml(formats.read_member(z, "xl/sharedStrings.xml")) if _name(si) == "si"]
    rels = _relations(z, "xl/workbook.xml")
    sheets = [s for s in parse_xml(formats.read_member(z, "xl/workbook.xml")).iter() if _name(s) == "sheet"]
    for page, s in enumerate(sheets, 1):
        view.block(s.get("name"), "heading", page)
        path = rels.get(_attr(s, "id") or "", f"xl/worksheets/sheet{page}.xml")
        if path not in z.namelist():
            continue
        rows = []
        for r in (x for x in parse_xml(formats.read_member(z, path)).iter() if _name(x) == "row"):
            row: list[str] = []
            for c in (x for x in r if _name(x) == "c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                row += [""] * (max(at - 1, len(row) if not at else 0) - len(row))
                v = next((x.text or "" for x in c if _name(x) == "v"), "")
                if c.get("t") == "s":
                    v = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
                elif c.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if _name(t) == "t")
                elif c.get("t") == "b":
                    v = {"1": "TRUE", "0": "FALSE"}.get(v, v)
                row.append(v)
            if any(row):
                rows.append(row)
        if rows:
            view.table(rows, all(x.strip() and not re.fullmatch(r"-?[0-9.]+", x) for x in rows[0]), page, blocks=True)


def pptx(data: bytes, view: View) -> None:
    """A page for each slide in the presentation's order; title placeholders are titles."""
    z = formats.open_archive(data)
    rels = _relations(z, "ppt/presentation.xml")
    order = [rels.get(_attr(s, "id") or "") for s in parse_xml(formats.read_member(z, "ppt/presentation.xml")).iter() if _name(s) == "sldId"]
    # an id attribute without a namespace is the slide's number: only the relation counts
    if not all(order):
        order = [rels.get(next((v for k, v in s.attrib.items() if k.startswith("{")), "")) for s in parse_xml(formats.read_member(z, "ppt/presentation.xml")).iter() if _name(s) == "sldId"]
    for page, path in enumerate((p for p in order if p in z.namelist()), 1):
        for shape in (x for x in parse_xml(formats.read_member(z, path)).iter() if _name(x) in ("sp", "tbl")):
            if _name(shape) == "tbl":
                view.table([[" ".join(_text(p) for p in c.iter() if _name(p) == "p") for c in r if _name(c) == "tc"] for r in shape if _name(r) == "tr"], page=page)
                continue
            kind = next((x.get("type") for x in shape.iter() if _name(x) == "ph"), None)
            for p in (x for x in shape.iter() if _name(x) == "p"):
                view.block(_text(p), "title" if kind in ("title", "ctrTitle") else "body", page)


def odt(data: bytes, view: View) -> None:
    root = parse_xml(formats.read_member(formats.open_archive(data), "content.xml"))

    def walk(e: ET.Element) -> None:
        kind = _name(e)
        if kind == "h":
            view.block("".join(e.itertext()), "title" if _attr(e, "outline-level") in (None, "1") else "heading")
        elif kind == "p":
            view.block("".join(e.itertext()))
        elif kind == "table":
            view.table([[" ".join("".join(p.itertext()) for p in c.iter() if _name(p) == "p") for c in r if _name(c) == "table-cell"] for r in e.iter() if _name(r) == "table-row"])
        elif kind not in ("tracked-changes", "annotation", "sequence-decls"):
            for x in e:
                walk(x)

    walk(root)


READERS = {"text/plain": plain, "text/csv": comma_separated, "application/rtf": rtf, "text/html": html, "message/rfc822": mail, formats.ODT: odt} | dict(zip(formats.PARTS.values(), (docx, xlsx, pptx)))
