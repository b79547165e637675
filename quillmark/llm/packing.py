"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n * n (attention). Pieces are
dealt in descending length to the sequence with the lowest cost that still has room for them; a piece
that fits nowhere whole is cut at the free room of the cheapest open sequence. Packing works on windows
of consecutive documents inside each input partition, so there is no shuffle, memory is bounded by the
window (and one document), and a lost task is simply run again with the same result.

The room offered to a window equals its tokens: full sequences, and for the rest sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillmark.llm._common import arrow_map, utf8

LENGTH = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096  # relative cost of a token, and of a pair of tokens
WINDOW = 1 << 20  # tokens gathered before a window is packed
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_length long, sequence_cost double"


class PieceIds(dict):
    """Ids of a whole text. The tokenizer splits a text into pieces and encodes each by itself, so ids are memoised by
    piece, within a bound. Texts of the first 256 code points are split here by the tokenizer's own pattern
    (they are in normal form, and lower-casing is character by character); others go through the tokenizer in
    chunks between ASCII white space, which it drops and never looks across."""

    LIMIT = 600_000
    LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t-\r \x85\xa0{LETTERS}{DIGITS}]+")

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(tokenizer_path)
        self._model = self._t.model
        self._chunks: dict[bytes, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in shown]
        self._byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        symbols = piece if piece.isascii() and piece.isprintable() else "".join(map(self._byte.__getitem__, piece.encode("utf-8")))
        ids = self[piece] = array("I", [t.id for t in self._model.tokenize(symbols)]).tobytes()
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        ids = self._chunks.get(chunk)
        if ids is None:
            if len(self._chunks) >= self.LIMIT // 4:
                self._chunks.clear()
            ids = self._chunks[chunk] = array("I", self._t.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not text:
            return b""
        if "<|" not in text and (text.isascii() or max(text) <= "\xff"):
            return b"".join(map(self.__getitem__, self.SPLIT.findall(text.lower())))
        return b"".join(map(self._chunk, utf8(text).split()))


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Room of the sequences for so many tokens: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack_window(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; every sequence is filled to its capacity."""
    cap = np.array(capacities(sum(lengths), length), np.int64)
    free, cost = cap.copy(), np.zeros(len(cap))
    queue = sorted(((n - s if n - s < length else length, d, s) for d, n in enumerate(lengths) for s in range(0, n, length)), key=lambda p: (-p[0], p[1], p[2]))
    out, at = [], 0
    open_ = np.arange(len(cap))
    while at < len(queue):
        n, doc, start = queue[at]
        at += 1
        while n:
            fits = free[open_] >= n
            if fits.any():
                choice = open_[fits]
                s, take = choice[np.argmin(cost[choice])], n
            else:  # cut: the cheapest sequence that has room takes what it can
                s = open_[np.argmin(cost[open_])]
                take = int(free[s])
            out.append((doc, start, take, int(s), int(cap[s] - free[s])))
            free[s] -= take
            cost[s] += LINEAR * take + QUADRATIC * take * take
            if not free[s]:
                open_ = open_[open_ != s]
            start, n = start + take, n - take
    return out


def _pack(tokenizer_path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = PieceIds(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        held, tokens, next_id = [], 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

        def flush():
            nonlocal held, tokens, next_id
            pieces = pack_window([len(ids) // 4 for _, ids in held])
            room = capacities(tokens)
            cost = np.zeros(len(room))
            for _, _, n, s, _ in pieces:
                cost[s] += LINEAR * n + QUADRATIC * n * n
            rows = [(held[d][0], start, n, zlib.crc32(memoryview(held[d][1])[4 * start : 4 * (start + n)]), len(held[d][1]) // 4, next_id + s, at, room[s], float(cost[s])) for d, start, n, s, at in pieces]
            next_id += len(room)
            held, tokens = [], 0
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost")
            return pa.record_batch([pa.array(v, pa.float64() if k == 8 else pa.int64()) for k, v in enumerate(zip(*rows))], list(names))

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = ids_of.encode(t.as_py()) + end
                held.append((i, ids))
                tokens += len(ids) // 4
                if tokens >= window:
                    yield flush()
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document's ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    sequence's length and estimated cost.

    A null or empty text has the end id alone. Repeated rows are packed as often as they occur; a null id stays
    null. Pieces with equal lengths go in the order of their rows. An empty table gives no rows. Other columns
    are not returned. tokenizer_path must be readable on every executor.
    """
    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), _pack(tokenizer_path, window), SCHEMA)
