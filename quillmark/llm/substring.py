"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From each sentence on, and back from each sentence, the shortest run of at least RUN
sentences with at least MIN_WORDS words is hashed, so each repeated passage of that size is covered by such runs.
Runs are joined globally on their hash; of equal runs the first (by document id, text hash and place) stays, and
the sentences of every other one are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import arrow_map, bound_batches, materialize

RUN, MIN_WORDS = 2, 20
LENGTHS = 32  # a run's place is LENGTHS * (its first sentence) + its number of sentences; each sentence has a word, so MIN_WORDS bounds that number
_END = re.compile(r"[.!?。！？]*[。！？]|[.!?]+(?=[\s]|$)|\n")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences: cut after closing marks before white space, after full-width ones, and at line ends. They cover the text."""
    if not text:
        return []
    out, at = [], 0
    for m in _END.finditer(text):
        end = m.end()
        while end < len(text) and text[end].isspace():
            end += 1
        if end > at and text[at:end].strip():
            out.append((at, end))
            at = end
    if at < len(text):
        if text[at:].strip() or not out:
            out.append((at, len(text)))
        else:
            out[-1] = (out[-1][0], len(text))
    return out


def n_words(words: list[str]) -> int:
    """The words between blanks; two characters of a script without blanks are one word."""
    n = len(words)
    for w in words:
        if not w.isascii() and (k := len(_UNSPACED.findall(w))) > 2:
            n += (k - 1) // 2
    return n


def runs_of(sizes: list[int]) -> list[tuple[int, int]]:
    """(first sentence, number of sentences) of the shortest runs of at least RUN sentences and MIN_WORDS words that begin, or end, at each sentence."""
    n, sums = len(sizes), [0, *accumulate(sizes)]
    out, end = [], 0
    for k in range(n - RUN + 1):
        end = max(end, k + RUN)
        while end < n and sums[end] - sums[k] < MIN_WORDS:
            end += 1
        if sums[end] - sums[k] < MIN_WORDS:
            break
        out.append((k, end - k))
    seen, start = set(out), 0
    for end in range(RUN, n + 1):
        while start + 1 <= end - RUN and sums[end] - sums[start + 1] >= MIN_WORDS:
            start += 1
        if sums[end] - sums[start] >= MIN_WORDS and (start, end - start) not in seen:
            out.append((start, end - start))
    return out


def run_hashes(text: str | None) -> list[tuple[int, int]]:
    """(place, hash) of every run; case and white space don't count."""
    words = [text[a:b].lower().split() for a, b in sentences(text)]
    lines = [" ".join(w) for w in words]
    return [(k * LENGTHS + n, xxhash.xxh3_64_intdigest("\n".join(lines[k : k + n]).encode("utf-8", "surrogatepass")) - (1 << 63)) for k, n in runs_of([n_words(w) for w in words])]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for from_row in range(0, whole.num_rows, 2000):
            b = whole.slice(from_row, 2000)
            ids, ties, places, hashes = [], [], [], []
            for i, tie, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = run_hashes(t.as_py())
                ids += [i] * len(found)
                ties += [tie] * len(found)
                places += [p for p, _ in found]
                hashes += [h for _, h in found]
            yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(places, pa.int32())], ["h", "id", "tie", "place"])


def _cut(text: pd.Series, places: pd.Series) -> pd.DataFrame:
    rows = []
    for t, p in zip(text, places):
        s = sentences(t)
        gone = {k // LENGTHS + j for k in (p if p is not None else ()) for j in range(k % LENGTHS)}
        cut = [s[k] for k in sorted(gone)]
        merged: list[list[int]] = []
        for a, b in cut:
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        kept = t if not gone or t is None else "".join(t[a:b] for k, (a, b) in enumerate(s) if k not in gone)
        rows.append((kept, len(s), len(gone), sum(len(t[a:b].split()) for a, b in cut), ",".join(f"{a}:{b}" for a, b in merged)))
    return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "removed_words", "spans"])


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `cut`: struct(text, n_sentences, n_removed, removed_words, spans): the text without sentences that a
    non-first repeated run covers, and what went (`start:end` in code points, adjacent ones joined).

    Null and blank texts stay as they are. Identical rows (same id and text) are one document: all get the same
    result. A null id comes first in the order. Runs that repeat inside one text count too. Every row is returned
    once with all its columns (one named cut is replaced, others may have any names); an empty table stays empty. A text of
    any length is cut whole, by one task; a run's commonest passage is spread by the join's split of skewed keys.
    """
    bound_batches(docs.sparkSession)
    t = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_tie"))
    runs = materialize(arrow_map(t.select(F.col("_id").alias("id"), "_tie", F.col("_text").alias("text")).where(F.length("text") > 0), _runs, "h long, id long, tie long, place int"))
    repeated = materialize(runs.groupBy("h").agg(F.min(F.struct("id", "tie", "place")).alias("first"), F.max(F.struct("id", "tie", "place")).alias("last")).where("first < last").select("h", "first"))
    # always by shuffle: the repeated runs and the texts that hold them grow with the corpus
    later = runs.join(repeated.hint("merge"), "h").where(F.struct("id", "tie", "place") != F.col("first")).groupBy("id", "tie").agg(F.collect_set("place").alias("_places"))
    later = materialize(later)
    cut = F.pandas_udf(_cut, "text string, n_sentences int, n_removed int, removed_words long, spans string")
    joined = t.join(later.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tie") == F.col("tie")), "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "cut"], cut(F.col("_text"), F.col("_places")).alias("cut"))
