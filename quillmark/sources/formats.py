"""What a file is, by its content: media types, text encodings, and the caps of ingestion."""

from __future__ import annotations

import re
import zipfile
from dataclasses import dataclass
from io import BytesIO

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: first bytes of formats, as hex
MAGIC = {
    "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": "474946383", "image/tiff": "49492A00", "image/tiff ": "4D4D002A", "image/bmp": "424D",
    "application/zip": "504B0304", "application/x-ole-storage": "D0CF11E0A1B11AE1", "application/rtf": "7B5C727466",
}
# fixed values: parts that tell office packages apart
PARTS = {"word/document.xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt/presentation.xml": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
ODT = "application/vnd.oasis.opendocument.text"


@dataclass(frozen=True)
class Limits:
    bytes: int = 32 << 20
    pages: int = 200
    blocks: int = 50_000
    chars: int = 4 << 20
    block_chars: int = 32 << 10
    rows: int = 5_000
    cells: int = 100_000
    tables: int = 2_000
    parts: int = 256
    archive_entries: int = 4_096
    archive_bytes: int = 256 << 20
    ratio: int = 500
    seconds: float = 20.0
    images: int = 10


LIMITS = Limits()
_ALL = 1 << 62
#: For texts that are one's own: nothing is left out.
UNLIMITED = Limits(_ALL, _ALL, _ALL, _ALL, _ALL, _ALL, _ALL, _ALL, _ALL, _ALL, _ALL, _ALL, float("inf"), _ALL)


class Refused(ValueError):
    """A file that isn't read, and why."""


def magic_type(content: Column) -> Column:
    """The media type that a binary column's first bytes show, without a UDF; null if they show none."""
    head, out = F.hex(F.substring(content, 1, 16)), F.lit(None).cast("string")
    for media, magic in MAGIC.items():
        out = F.when(head.startswith(magic), F.lit(media.strip())).otherwise(out)
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise(out)
    out = F.when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("68656963", "6D696631", "68656978"), "image/heic").otherwise(out)
    return F.when(F.instr(F.hex(F.substring(content, 1, 1024)), "255044462D") > 0, "application/pdf").otherwise(out)


def image_size(content: Column) -> Column:
    """struct(width, height) of PNG, GIF and BMP columns, from their headers; null for others."""
    h = F.hex(F.substring(content, 1, 32))
    big = lambda at, n: F.conv(F.substring(h, 2 * at + 1, 2 * n), 16, 10).cast("int")
    little = lambda at: F.conv(F.concat(F.substring(h, 2 * at + 3, 2), F.substring(h, 2 * at + 1, 2)), 16, 10).cast("int")
    size = lambda w, x: F.struct(w.alias("width"), x.alias("height"))
    return F.when(h.startswith(MAGIC["image/png"]), size(big(16, 4), big(20, 4))).when(h.startswith("474946383"), size(little(6), little(8))).when(h.startswith("424D"), size(little(18), little(22)))


def tiff_frames(data: bytes) -> list[tuple[int, int]]:
    """(width, height) of each image of a TIFF file, by its directories; at most 1,000, and a loop ends."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None or int.from_bytes(data[2:4], order) != 42:
        return []
    out, seen, at = [], set(), int.from_bytes(data[4:8], order)
    while at and at not in seen and at + 2 <= len(data) and len(out) < 1000:
        seen.add(at)
        n, size = int.from_bytes(data[at : at + 2], order), {}
        for k in range(n):
            e = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind = int.from_bytes(e[:2], order), int.from_bytes(e[2:4], order)
            if tag in (256, 257):
                size[tag] = int.from_bytes(e[8:10] if kind == 3 else e[8:12], order)
        out.append((size.get(256, 0), size.get(257, 0)))
        at = int.from_bytes(data[at + 2 + 12 * n : at + 6 + 12 * n], order)
    return out


def embedded_images(data: bytes, limits: Limits = LIMITS) -> list[str]:
    """The first pictures inside an office package."""
    z = open_archive(data, limits)
    return [n for n in z.namelist() if re.search(r"(?:^|/)(?:media|Pictures)/[^/]+\.(?:png|jpe?g|gif|bmp|tiff?)$", n, re.I)][: limits.images]


def open_archive(data: bytes, limits: Limits = LIMITS) -> zipfile.ZipFile:
    """A zip file whose directory promises nothing beyond the limits."""
    try:
        z = zipfile.ZipFile(BytesIO(data))
    except (zipfile.BadZipFile, ValueError, EOFError) as e:
        raise Refused("corrupt_archive") from e
    entries = z.infolist()
    if len(entries) > limits.archive_entries:
        raise Refused("too_many_entries")
    if sum(e.file_size for e in entries) > limits.archive_bytes:
        raise Refused("archive_too_large")
    if any(e.file_size > limits.ratio * max(e.compress_size, 1) and e.file_size > 1 << 20 for e in entries):
        raise Refused("compression_ratio")
    return z


def read_member(z: zipfile.ZipFile, name: str, limits: Limits = LIMITS) -> bytes:
    """A member, read no further than its declared size and the ratio allow."""
    info = z.getinfo(name)
    most = min(limits.archive_bytes, max(1 << 20, limits.ratio * max(info.compress_size, 1)))
    with z.open(info) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise Refused("member_too_large")
    return data


def decode_text(data: bytes) -> tuple[str, str]:
    """(text, encoding): by its mark, as UTF-8 with few control characters, as UTF-16 by its zero bytes, else as cp1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    controls = lambda s: sum(c < " " and c not in "\t\n\r\f\v" for c in s)
    try:
        s = data.decode("utf-8")
        if controls(s) <= 0.02 * max(len(s), 1):
            return s, "utf-8"
    except UnicodeDecodeError:
        pass
    if len(data) >= 4:
        even, odd = data[::2].count(0), data[1::2].count(0)
        if max(even, odd) > 0.3 * len(data) / 2:
            name = "utf-16-le" if odd > even else "utf-16-be"
            return data.decode(name, "replace"), name
    s = data.decode("cp1252", "replace")
    if controls(s) > 0.02 * max(len(s), 1) or s.count("�") > 0.02 * max(len(s), 1):
        raise Refused("not_text")
    return s, "cp1252"


HEADERS = frozenset("from to cc bcc subject date message-id mime-version content-type received reply-to return-path sender".split())


def looks_like_email(text: str) -> bool:
    """A block of header lines at the start, two of them of known names."""
    names = []
    for line in text.lstrip("﻿\r\n").split("\n"):
        line = line.rstrip("\r")
        if not line:
            break
        if line[0] in " \t" and names:
            continue
        m = re.match(r"([A-Za-z][A-Za-z0-9-]*):", line)
        if not m:
            return False
        names.append(m[1].lower())
    return len(names) >= 2 and len(HEADERS & set(names)) >= 2


def csv_delimiter(text: str) -> str | None:
    """The delimiter that occurs equally often, at least once, in each of the first lines; None if there is none."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    if len(lines) < 2:
        return None
    for d in ",;\t|":
        counts = {len(re.sub(r'"[^"]*"', "", x).split(d)) - 1 for x in lines}
        if len(counts) == 1 and counts != {0}:
            return d
    return None


def detect(data: bytes, filename: str = "") -> str:
    """The media type of a file; its name only decides between kinds of text."""
    head = data[:16].hex().upper()
    if head.startswith("52494646") and head[16:24] == "57454250":
        return "image/webp"
    if head[8:16] == "66747970" and data[8:12] in (b"heic", b"heix", b"mif1", b"hevc", b"msf1", b"avif"):
        return "image/avif" if data[8:12] == b"avif" else "image/heic"
    for media, magic in MAGIC.items():
        if head.startswith(magic):
            if media == "application/zip":
                z = open_archive(data)
                names = set(z.namelist())
                for part, kind in PARTS.items():
                    if part in names:
                        return kind
                if "mimetype" in names and read_member(z, "mimetype").strip() == ODT.encode():
                    return ODT
            return media.strip()
    if b"%PDF-" in data[:1024]:
        return "application/pdf"
    text, _ = decode_text(data)
    ext = filename.lower().rpartition(".")[2]
    start = text.lstrip()[:2000].lower()
    if looks_like_email(text) or ext == "eml" and ":" in start.split("\n")[0]:
        return "message/rfc822"
    if re.match(r"(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|body)\b", start, re.S) or ext in ("html", "htm") and "<" in start:
        return "text/html"
    if ext == "csv" or ext not in ("txt", "md") and csv_delimiter(text):
        return "text/csv"
    return "text/plain"
