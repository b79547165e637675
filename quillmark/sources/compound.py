"""Compound files (OLE2): their directory and streams, and the mail messages that are stored in them."""

from __future__ import annotations

import struct

from quillmark.sources.formats import Refused
from quillmark.sources.readers import View, html_text

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
MOST_ENTRIES = 8192
# fixed values: property tags of a message, and the types of text
SUBJECT, SENDER, SENDER_MAIL, TO, CC, BODY, HTML = "0037", "0C1A", "0C1F", "0E04", "0E03", "1000", "1013"
FILE_NAMES, WIDE, NARROW, BINARY = ("3707", "3704"), "001F", "001E", "0102"
PREFIX = "__substg1.0_"


class Compound:
    """A compound file: streams by name. Every chain is bounded by the number of its sectors, so a loop ends."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8].hex() != "d0cf11e0a1b11ae1":
            raise Refused("corrupt_compound_file")
        self.data = data
        shift, small = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or small != 6:
            raise Refused("corrupt_compound_file")
        self.size, self.small = 1 << shift, 1 << small
        first_dir, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_small, _, more, n_more = struct.unpack_from("<IIIII", data, 56)
        table = [x for x in struct.unpack_from("<109I", data, 76) if x < END]
        for _ in range(min(n_more, len(data) // self.size + 1)):  # further sectors of the table of tables
            if more >= END:
                break
            part = struct.unpack_from(f"<{self.size // 4}I", self._sector(more))
            table += [x for x in part[:-1] if x < END]
            more = part[-1]
        self.next = [x for s in table for x in struct.unpack_from(f"<{self.size // 4}I", self._sector(s))]
        self.entries: dict[str, tuple[int, int]] = {}
        root = (END, 0)
        directory = self._chain(first_dir, self.next, self._sector)
        for at in range(0, min(len(directory), 128 * MOST_ENTRIES) - 127, 128):
            n, kind = struct.unpack_from("<HB", directory, at + 64)
            start, size = struct.unpack_from("<IQ" if self.size == 4096 else "<II", directory, at + 116)
            if kind == 5:
                root = (start, size)
            elif kind == 2 and 2 <= n <= 64:
                self.entries.setdefault(directory[at : at + n - 2].decode("utf-16-le", "replace"), (start, size))
        mini = self._chain(first_small, self.next, self._sector)
        self.small_next = list(struct.unpack_from(f"<{len(mini) // 4}I", mini))
        self.mini = self._chain(root[0], self.next, self._sector)[: root[1]]

    def _sector(self, k: int) -> bytes:
        part = self.data[(k + 1) * self.size : (k + 2) * self.size]
        if not part:
            raise Refused("corrupt_compound_file")
        return part.ljust(self.size, b"\0")

    def _chain(self, at: int, following: list[int], sector) -> bytes:
        out = []
        while at < END:
            if at >= len(following) or len(out) > len(following):
                raise Refused("corrupt_compound_file")
            out.append(sector(at))
            at = following[at]
        return b"".join(out)

    def read(self, name: str, most: int) -> bytes:
        """At most so many bytes of a stream; nothing if there is none."""
        if name not in self.entries:
            return b""
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start, self.next, self._sector)[: min(size, most)]
        return self._chain(start, self.small_next, lambda k: self.mini[k * self.small : (k + 1) * self.small])[: min(size, most)]


def message(data: bytes, view: View) -> None:
    """A stored mail message, zoned as a mail file is: subject, envelope and names of attachments, body (plain, else HTML)."""
    file, most = Compound(data), view.limits.chars
    streams = {}
    for name in file.entries:
        if name.startswith(PREFIX):
            streams.setdefault(name[len(PREFIX) :].upper(), name)

    def text(tag: str, bound: int) -> str:
        for kind, code in ((WIDE, "utf-16-le"), (NARROW, "cp1252")):
            if tag + kind in streams:
                return file.read(streams[tag + kind], bound).decode(code, "replace").rstrip("\0")
        return ""

    if not streams:
        raise Refused("unsupported_type")
    view.block(text(SUBJECT, 2 * view.limits.block_chars), "title")
    sender = f"{text(SENDER, 4096)} {text(SENDER_MAIL, 4096)}".strip()
    if sender:
        view.block(f"From: {sender}", "furniture")
    for tag, label in ((TO, "To"), (CC, "Cc")):
        if value := text(tag, 8192):
            view.block(f"{label}: {value}", "furniture")
    names = dict.fromkeys(n for tag in FILE_NAMES if (n := text(tag, 1024).strip()))
    for n in names:
        view.block(f"Attachment: {n}", "furniture")
    body = text(BODY, most)
    if body.strip():
        for line in body.splitlines():
            view.block(line)
        return
    page = text(HTML, most) or file.read(streams.get(HTML + BINARY, ""), most).decode("utf-8", "replace")
    if page.strip():
        html_text(page, view)
