"""Text normalisation as Spark columns: folding, accents, confusable glyphs, tokens, n-grams, cleaning."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: glyphs that recognisers confuse, and what they become
CONFUSED, CONFUSED_TO = "oilsb", "01158"


def _latin_accents() -> tuple[str, str]:
    """Lower-case Latin letters below U+0250 that decompose to one ASCII letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code).casefold()) if not unicodedata.combining(c))
        if unicodedata.name(chr(code), "").startswith("LATIN") and len(base) == 1 and base.isascii() and chr(code) == chr(code).casefold():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _latin_accents()


def fold(text: Column) -> Column:
    """Case-folded and white space collapsed, for text in normal form C of Latin, Greek or Cyrillic letters. Null is empty."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def deaccent(folded: Column) -> Column:
    """Latin letters without their accents; other scripts keep their marks."""
    return F.translate(folded, ACCENTED, PLAIN)


def skeleton(folded: Column) -> Column:
    """Without accents, and with confusable glyphs made equal."""
    return F.translate(deaccent(folded), CONFUSED, CONFUSED_TO)


_BOTH = str.maketrans(CONFUSED, CONFUSED_TO)
_FROM = ACCENTED + "".join(c for c in CONFUSED if c not in ACCENTED)
_TO = PLAIN.translate(_BOTH) + CONFUSED_TO


def skeleton_tokens(text: Column) -> Column:
    """tokens(skeleton(fold(text))) with one translation; white space needs no collapsing to be a gap."""
    return tokens(F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), _FROM, _TO))


def tokens(folded: Column) -> Column:
    """Runs of letters and digits; combining marks continue a token."""
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))


def legacy_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters without the underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W_][\w\p{M}&&[^_]]*"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Space-joined n-grams of an array of words. Pairs, the usual case, are made element by element."""
    if n == 2:
        return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def clean_value(text: Column) -> Column:
    """White space collapsed in every line, blank lines dropped, and separators stripped from the ends."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, "\n"), r"^[ :;,\-–—=|]+|[ :;,\-–—=|]+$", "")


def strip_fill_rules(text: Column) -> Column:
    """Without the rules that blank forms print to write on."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"_{2,}|\.{4,}|…+|·{2,}|•{2,}", " "), r"\s+", " "))


def has_substance(text: Column) -> Column:
    return strip_fill_rules(text).rlike(r"[\p{L}\p{N}]")


def slug(text: Column) -> Column:
    """A name of lower-case letters, digits and single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def redact(value: Column) -> Column:
    """All but the last four characters masked; short values wholly."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(4))))


def log_id(doc_id: Column) -> Column:
    """What logs show of a document's id."""
    return F.substring(F.sha2(doc_id.cast("string").cast("binary"), 256), 1, 8)


# exact forms for any script, as Arrow functions


def fold_any(text: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").casefold()).strip()


def deaccent_any(folded: str) -> str:
    if folded.isascii():
        return folded
    latin = lambda c: c.isascii() or unicodedata.name(c, "").startswith("LATIN")
    return "".join("".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)) if latin(c) else c for c in folded)


def normal_forms(text: Column) -> Column:
    """struct(folded, plain, skeleton, tokens) of any script, in one pass."""
    table, token = str.maketrans(CONFUSED, CONFUSED_TO), re.compile(r"[^\W_]+")

    def pieces(s: str) -> list[str]:
        out, now = [], ""
        for c in s:
            if c.isalnum() or (now and unicodedata.category(c).startswith("M")):
                now += c
            elif now:
                out.append(now)
                now = ""
        return out + ([now] if now else [])

    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            f = fold_any(t)
            p = deaccent_any(f)
            rows.append((f, p, p.translate(table), token.findall(p.translate(table)) if f.isascii() else pieces(p.translate(table))))
        return pd.DataFrame(rows, columns=["folded", "plain", "skeleton", "tokens"])

    return F.pandas_udf(run, "folded string, plain string, skeleton string, tokens array<string>")(text)


# fuzzy similarity: 200 * longest common subsequence / total length


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one of at most its length, edges included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)) if b[max(0, k) : k + n])


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def label_similarity(label: str, text: str) -> float:
    """How well a normalised label names a text: the best of the ratios, 96 if its words occur in the text in order
    and next to each other, and the partial ratio for labels of at least six characters that aren't longer."""
    if not label or not text:
        return 0.0
    best = max(ratio(label, text), token_sort_ratio(label, text))
    if f" {label} " in f" {text} ":
        best = max(best, 100.0 if label == text else 96.0)
    if 6 <= len(label) <= len(text):
        best = max(best, partial_ratio(label, text))
    return best


def similarity(label: Column, text: Column) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series([label_similarity(x or "", y or "") for x, y in zip(a, b)]), "double")(label, text)
