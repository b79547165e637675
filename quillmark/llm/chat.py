"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered as one text: every turn is a role line between control strings, then
its text, then an end string. Control strings inside texts are escaped reversibly: the first character of
each escape or control opener is doubled in front by ESCAPE. The rendered text is encoded once with
offsets; the loss mask of tokens comes from intersecting the sorted spans of assistant turns with the
sorted token spans by binary search. Reading back parses the rendered text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import arrow_map

OPEN, MIDDLE, CLOSE, ESCAPE = "⟪", "⟫\n", "⟬\n", "⟭"  # turn start, end of role, end of turn, escape
CONTROLS = (OPEN, "⟫", "⟬", ESCAPE)
OTHER_CONTROLS = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")  # of common templates, broken up inside texts
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    """Put ESCAPE before every control character, and after the first character of other templates' control strings."""
    for c in (ESCAPE, *CONTROLS[:3]):
        text = text.replace(c, ESCAPE + c)
    for c in OTHER_CONTROLS:
        if c in text:
            text = text.replace(c, c[0] + ESCAPE + "." + c[1:])
    return text


def unescape(text: str) -> str:
    """The inverse of escape()."""
    parts, out = text.split(ESCAPE), []
    out.append(parts[0])
    k = 1
    while k < len(parts):
        p = parts[k]
        if p == "" and k + 1 < len(parts):  # ESCAPE ESCAPE: one ESCAPE, then plain text
            out.append(ESCAPE + parts[k + 1])
            k += 2
        elif p[:1] == ".":  # a broken-up control string
            out.append(p[1:])
            k += 1
        else:  # the control character itself
            out.append(p)
            k += 1
    return "".join(out)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and the spans of the escaped texts that are trained on."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        if role == TRAINED_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans




def _find(s: str, what: str, start: int) -> int:
    """The first place from start where `what` isn't escaped; escapes before start don't count."""
    at = s.find(what, start)
    while at >= 0:
        n = at
        while n > start and s[n - 1] == ESCAPE:
            n -= 1
        if (at - n) % 2 == 0:
            return at
        at = s.find(what, at + 1)
    return -1


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(rendered):
        if rendered[at] != OPEN:
            raise ValueError(f"no turn begins at {at}")
        mid = _find(rendered, MIDDLE[0], at + 1)
        end = _find(rendered, CLOSE[0], mid + len(MIDDLE))
        if mid < 0 or end < 0:
            raise ValueError(f"the turn at {at} has no end")
        turns.append((unescape(rendered[at + 1 : mid]), unescape(rendered[mid + len(MIDDLE) : end])))
        at = end + len(CLOSE)
    return turns


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens (start, end) that overlap a span. Both are sorted; spans don't overlap. A token that
    crosses a span's border belongs to it if it has a character inside."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    s = np.array(spans, np.int64)
    k = np.searchsorted(s[:, 1], offsets[:, 0], side="right")  # the first span that ends after the token's start
    inside = np.minimum(k, len(s) - 1)
    return (k < len(s)) & (offsets[:, 1] > s[inside, 0]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(rendered: str, offsets: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """The stretches of text that the masked tokens cover, in order; tokens next to each other make one stretch. A token
    that crosses the border of a span counts up to the border; one that touches no span counts whole."""
    chosen = offsets[mask]
    chosen = chosen[chosen[:, 1] > chosen[:, 0]]
    if not len(chosen):
        return []
    start, end = chosen[:, 0].copy(), chosen[:, 1].copy()
    if spans:
        s = np.array(spans, np.int64)
        k = np.minimum(np.searchsorted(s[:, 1], start, side="right"), len(s) - 1)
        inside = (end > s[k, 0]) & (start < s[k, 1])
        start, end = np.where(inside, np.maximum(start, s[k, 0]), start), np.where(inside, np.minimum(end, s[k, 1]), end)
    # several tokens can share one character
    before = np.r_[0, np.maximum.accumulate(end)[:-1]]
    fresh = end > before
    start, end, before = np.maximum(start, before)[fresh], end[fresh], before[fresh]
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    last = np.r_[first[1:] - 1, len(start) - 1]
    return [rendered[a:b] for a, b in zip(start[first], end[last])]


def _format(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        tok.encode_special_tokens = True
        for whole in batches:
            for from_row in range(0, whole.num_rows, 256):
                b = whole.slice(from_row, 256)
                made = [render([(r or "", t or "") for r, t in zip(roles, texts)]) for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                rows = []
                for conv, (text, spans), enc in zip(b.column(0).to_pylist(), made, tok.encode_batch([m[0] for m in made], add_special_tokens=False)):
                    offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
                    mask = mask_tokens(offsets, spans)
                    turns = parse(text)
                    loss = "".join(unescape(x) for x in masked_text(text, offsets, mask, spans))
                    rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text), text, enc.ids, mask.tolist(), [x for s in spans for x in s]))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "ids", "loss_mask", "loss_spans"])

    return run


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per conversation: its rendered text, ids, loss mask, spans, and digests
    read back from the rendered text.

    Turns go in the order of turn (nulls first), then role and text. Null roles and texts are empty; repeated rows
    are repeated turns; a null conv_id is a conversation of its own. An empty table gives no rows; other columns are not
    used. A conversation is one value and so is held by one task; conversations are spread by a hash of their id. Texts of
    any length are encoded whole. A turn's equal numbers are ties, which role and text break.
    """
    t = turns.select("conv_id", F.struct(F.col("turn").alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", F.col("x.role").alias("roles"), F.col("x.text").alias("texts"))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<long>"
    return arrow_map(t, _format(tokenizer_path), schema)
