"""Passes over whole plain texts, as Arrow functions: hashed counts of all terms, exact counts of some, and which terms and
phrases each text prints. Words are those of functions.text.skeleton_tokens()."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.tables import bounded_batches

BUCKETS = 1 << 16
MOST_WORDS = 300_000  # normalised words that a task keeps at a time
MOST_COUNTS = 200_000  # counted terms, or classes times buckets, likewise
MOST_CLASSES = 32


def _marks() -> str:
    """The ranges of all combining marks, for a character class."""
    codes = [c for c in (*range(0x20000), *range(0xE0000, 0xE1000)) if unicodedata.category(chr(c)).startswith("M")]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


_WORD = rf"[^\W_]+(?:[{_marks()}]+[^\W_]*)*"
WORD, WORD_OR_END = re.compile(_WORD), re.compile(rf"{_WORD}|[\n\r\x0b\x0c\x85\u2028\u2029]")
SOMETHING = re.compile(r"[^\x00-\x20\x7f-\x9f\u2028\u2029]")  # what makes a line more than an empty one
_SKELETON = str.maketrans(T._FROM, T._TO)


def skeleton(word: str) -> str:
    return word.lower().replace("ß", "ss").translate(_SKELETON)


def in_capitals(word: str) -> bool:
    return word == word.upper() and word != word.lower()


def _table(form) -> bytes:
    """What becomes of each Latin-1 character: a form of those of words, a blank for others."""
    return bytes(ord(form(c)) if WORD.match(c) and c != "ß" else 32 for c in map(chr, range(256)))


# texts in Latin-1 are translated byte by byte; a lower-case letter among capitals becomes a byte that no phrase has
PLAIN, BARE = _table(str.lower), _table(skeleton)
LINED = bytes(10 if c in b"\n\r\x0b\x0c\x85" else BARE[c] for c in range(256))
CAPITAL = _table(lambda c: skeleton(c) if c == c.upper() else "\1")


def latin(text: str) -> bytes | None:
    """The text in Latin-1, with question marks for what is no part of a word; None where that would lose a letter, a mark
    or the end of a line."""
    text = text.replace("ß", "ss")
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        if any(c > "\xff" and (WORD_OR_END.match(c) or unicodedata.category(c)[0] == "M") for c in set(text)):
            return None
        return text.encode("latin-1", "replace")


def skeletons(text: str) -> list[str]:
    """The skeleton tokens of any text, with None for the end of a line. The lower case of a capital sigma depends on its neighbours."""
    return [None if WORD.match(x) is None else skeleton(x) for x in WORD_OR_END.findall(text.lower() if "Σ" in text else text)]


def capitals(text: str) -> set[str]:
    """The skeletons of the words that a text prints in capitals."""
    return {skeleton(x) for x in set(WORD.findall(text)) if in_capitals(x)}


class Vocabulary(dict):
    """A skeleton, in Latin-1 bytes or as a string -> its number, with what class counts ask about it."""

    def __init__(self, stop: list[str]):
        super().__init__()
        self.stop, self.skeletons, self.hashes, self.content, self.long = frozenset(stop), [], array("Q"), array("B"), array("B")

    def __missing__(self, word: bytes | str) -> int:
        if isinstance(word, bytes):
            self[word] = k = self[word.decode("latin-1")]
            return k
        self[word] = k = len(self.skeletons)
        self.skeletons.append(word)
        self.hashes.append(zlib.crc32(word.encode("utf-8", "surrogatepass")))
        self.content.append(word not in self.stop)
        self.long.append(len(word) > 1)
        return k

    def terms(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The counted unigrams and bigrams of texts: numbers, buckets, first numbers, second numbers, buckets."""
        ids = []
        for t in texts:
            x = latin(t)
            ids.extend(map(self.__getitem__, x.translate(BARE).split() if x is not None else filter(None, skeletons(t))))
            ids.append(-1)
        ids = np.array(ids, np.int64)
        hashes, content, long = np.array(self.hashes), np.array(self.content, bool), np.array(self.long, bool)
        if not self.skeletons:
            return (ids[:0],) * 5
        a, b = ids[:-1], ids[1:]
        two = (a >= 0) & (b >= 0) & (content[a] | content[b])
        one = ids[(ids >= 0) & content[ids] & long[ids]]
        a, b = a[two], b[two]
        bucket = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        return one, bucket(hashes[one] + np.uint64(1)), a, b, bucket(hashes[a] * np.uint64(0xBF58476D1CE4E5B9) + hashes[b] * np.uint64(0x94D049BB133111EB))


def _by_class(batch: pa.RecordBatch) -> dict:
    groups = defaultdict(list)
    for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if t:
            groups[c].append(t)
    return groups


def bucket_counts(labelled: DataFrame, stop: list[str]) -> DataFrame:
    """(class, text) -> (class, bucket, n): lexical.class_counts() summed by a hash of the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Vocabulary(stop), {}

        def told() -> Iterator[pa.RecordBatch]:
            for c, n in sums.items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(k), pa.string()), pa.array(k), pa.array(n[k])], ["class", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for c, texts in _by_class(batch).items():
                _, one, _, _, two = words.terms(texts)
                if c not in sums:
                    if len(sums) >= MOST_CLASSES:
                        yield from told()
                    sums[c] = np.zeros(BUCKETS)
                sums[c] += np.bincount(one, minlength=BUCKETS) + 0.75 * np.bincount(two, minlength=BUCKETS)
            if len(words) > MOST_WORDS:
                words = Vocabulary(stop)
        yield from told()

    bounded_batches(labelled.sparkSession)
    rows = labelled.select("class", "text").mapInArrow(run, "class string, bucket long, n double")
    return rows.groupBy("class", "bucket").agg(F.sum("n").alias("n"))


def counts_in_buckets(labelled: DataFrame, stop: list[str], wanted: np.ndarray) -> DataFrame:
    """(class, text) -> (class, term, n): the rows of lexical.class_counts() whose term falls into a wanted bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Vocabulary(stop), Counter()

        def told() -> Iterator[pa.RecordBatch]:
            keys = list(found)
            for k in range(0, len(keys), 10_000):
                part = keys[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.string()), pa.array([t for _, t in part], pa.string()), pa.array([found[x] for x in part], pa.float64())], ["class", "term", "n"])
            found.clear()

        for batch in batches:
            for c, texts in _by_class(batch).items():
                one, at_one, a, b, at_two = words.terms(texts)
                kept, s = wanted[at_two], words.skeletons
                for k, n in zip(*(x.tolist() for x in np.unique(one[wanted[at_one]], return_counts=True))):
                    found[c, s[k]] += n
                for k, n in zip(*(x.tolist() for x in np.unique(a[kept] << 32 | b[kept], return_counts=True))):
                    found[c, f"{s[k >> 32]} {s[k & 0xFFFFFFFF]}"] += 0.75 * n
                if len(found) > MOST_COUNTS:
                    yield from told()
            if len(words) > MOST_WORDS:
                words = Vocabulary(stop)
        yield from told()

    bounded_batches(labelled.sparkSession)
    rows = labelled.select("class", "text").mapInArrow(run, "class string, term string, n double")
    return rows.groupBy("class", "term").agg(F.sum("n").alias("n"))


def known_terms(docs: DataFrame, terms: list[str], length: str, short: int) -> DataFrame:
    """The rows of lexical.weighted_terms() of plain texts (doc_id, text) for the given terms and for their length, summed
    for each text."""
    single = frozenset(t for t in terms if " " not in t)
    double = frozenset(t for t in terms if " " in t)
    tiny = frozenset(t for t in single if len(t) <= short)
    seen = {x: t for t in single for x in (t, t.encode("latin-1", "replace")) if x == t or x.decode("latin-1") == t}
    pairs = {tuple(y.split(" " if y == t else b" ")): t for t in double for y in (t, t.encode("latin-1", "replace")) if y == t or y.decode("latin-1") == t}
    first = frozenset(a for a, _ in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                x = latin(text)
                w = x.translate(LINED).replace(b"\n", b" \2 ").split() if x is not None else skeletons(text)
                n = Counter([seen[t] for t in w if t in seen])
                n.update([pairs[t] for t in [(w[i], w[i + 1]) for i, a in enumerate(w[:-1]) if a in first] if t in pairs])
                out = [(t, int(t in tiny), float(x)) for t, x in n.items()]
                marked = [t for t in n if t in tiny]
                if marked and x is not None:
                    printed = b" %b " % x.translate(CAPITAL)
                    marked = [t for t in marked if b" %b " % t.encode("latin-1") in printed]
                if marked:
                    out += [(t, 2, 0.0) for t in capitals(text).intersection(marked)]
                out.append((length, 0, float(len(w) - w.count(None if x is None else b"\2"))))
                rows += out
                of += [k] * len(out)
            if rows:
                t, kind, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(t, pa.string()), pa.array(kind, pa.int32()), pa.array(x, pa.float64())], ["doc_id", "term", "kind", "x"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, kind int, x double")


def zone_phrases(docs: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """anchors.plain_zone_texts() reduced to some phrases, given as (plain, skeleton) space-framed strings: plain and skeleton
    hold those that the text has, with bars between them, so that they contain a listed phrase if the text does. caps:
    which of the phrases' single words the text prints in capitals."""
    plain, bare = (sorted({p[k] for p in phrases}) for k in (0, 1))
    coded = [{p: p.encode("latin-1") for p in listed if p.encode("latin-1", "replace").decode("latin-1") == p} for listed in (plain, bare)]
    alone = frozenset(s for s in bare if len(s.split()) == 1)
    joined = lambda found: f"|{'|'.join(found)}|"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if not text or not SOMETHING.search(text):
                    continue
                x = latin(text)
                if x is not None:
                    p, s = (b" %b " % b" ".join(x.translate(form).split()) for form in (PLAIN, BARE))
                    empty, found = s == b"  ", [[t for t, y in listed.items() if y in whole] for listed, whole in zip(coded, (p, s))]
                    printed = b" %b " % x.translate(CAPITAL)
                    caps = [t for t in found[1] if t in alone and coded[1][t] in printed]
                else:
                    w = WORD.findall(text.lower() if "Σ" in text else text)
                    p, s = f" {' '.join(t.lower().replace('ß', 'ss') for t in w)} ", f" {' '.join(map(skeleton, w))} "
                    empty, found = s == "  ", [[t for t in listed if t in whole] for listed, whole in ((plain, p), (bare, s))]
                    caps = [t for t in alone if t in s]
                caps = sorted(capitals(text).intersection(t.strip() for t in caps)) if caps else []
                rows.append(("  ", "  ", caps) if empty else (*map(joined, found), caps))
                of.append(k)
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(["body"] * len(of)), pa.array(a), pa.array(b), pa.array(c, pa.list_(pa.string()))], ["doc_id", "zone", "plain", "skeleton", "caps"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, zone string, plain string, skeleton string, caps array<string>")
