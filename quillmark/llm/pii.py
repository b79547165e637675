"""Personal data, and information-theoretic sanitisation of the terms that reveal it.

Base spans (e-mail, IPv4, payment card, phone) are found by rule. The corpus then says which other words
disclose a person: for each protected entity e (the value of a base span) and each term t of the texts that
hold it, p(e | t) is the share of the distinct texts with t that hold e. A term is sensitive if the lower bound of
p(e | t) at Z standard errors (Wilson) is at least MIN_SHARE, and its pointwise mutual information
log2(p(e | t) / p(e)) is at least MIN_BITS. Such terms become spans of kind `term` wherever they stand. A run of
characters that by itself carries SECRET_BITS of information, with letters and digits, names its holder as an
entity does (keys, tokens): it becomes a span of kind `secret`. Redaction generalises base spans and secrets to
their kind and removes the terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import BROADCAST_ROWS, arrow_map, bound_batches, materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SECRET = "secret"
Z, MIN_SHARE, MIN_BITS = 1.96, 0.5, 3.0
LEAST_TEXTS = 4  # the bound of p(e | t) is below MIN_SHARE with fewer texts, so rarer entities are not paired
SECRET_CHARS, SECRET_BITS = 20, 64.0
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a start inside a run of digits can't match where its first digit doesn't
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of KINDS; null text: none."""
    if not text:
        return []
    found = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            at = m.start()
            while at > done and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                found.append(("email", at, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def terms_of(text: str) -> set[str]:
    """The terms of a text: its lower-cased runs of two letters or more."""
    return {t.lower() for t in _LETTERS.findall(text)}


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Runs of SECRET_CHARS characters or more, with letters and digits, whose characters carry at least SECRET_BITS bits by
    their own frequencies."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        digits = sum("0" <= c <= "9" for c in run)
        if digits >= 4 and any(c.isalpha() for c in run):
            n = len(run)
            if sum(k * math.log2(n / k) for k in Counter(run).values()) >= SECRET_BITS:
                out.append((SECRET, *m.span()))
    return out


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def entities_of(text: str) -> set[int]:
    """Hashes of the protected entities of a text."""
    return {text_hash(f"{kind}:{text[a:b]}") for kind, a, b in base_spans(text)}


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(e, h) for t in b.column(0).to_pylist() if t for found in (entities_of(t),) if found for h in (text_hash(t),) for e in found]
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["entity", "text_hash"])


def _pairs(wanted: frozenset[int] | None):
    """(term, entity, text_hash) of the texts that hold entities, of the wanted ones only if these are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, entities, texts = [], [], []
            for v in b.column(0):
                t = v.as_py()
                found = entities_of(t) if t else set()
                found = found & wanted if wanted is not None else found
                if found:
                    own, h = terms_of(t), text_hash(t)
                    for e in found:
                        terms += own
                        entities += [e] * len(own)
                        texts += [h] * len(own)
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array(entities, pa.int64()), pa.array(texts, pa.int64())], ["term", "entity", "text_hash"])

    return run


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, text_hash) of each text's distinct terms."""
    for b in batches:
        terms, texts = [], []
        for v in b.column(0):
            t = v.as_py()
            found = terms_of(t) if t else ()
            terms += found
            texts += [text_hash(t)] * len(found) if found else []
            if len(terms) > 200_000:
                yield pa.record_batch([pa.array(terms, pa.string()), pa.array(texts, pa.int64())], ["term", "text_hash"])
                terms, texts = [], []
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array(texts, pa.int64())], ["term", "text_hash"])


def _counting(most: dict[str, int]):
    """(term, over, texts): what a task knows of each term: the hashes of the texts that hold it, or over and none of them if
    these are more than most[term], with which the term can't be sensitive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int] | None] = {}
        for b in batches:
            for v in b.column(0):
                t = v.as_py()
                found = terms_of(t) & most.keys() if t else ()
                h = text_hash(t) if found else 0
                for w in found:
                    own = seen.setdefault(w, set())
                    if own is not None:
                        own.add(h)
                        if len(own) > most[w]:
                            seen[w] = None
        rows = list(seen.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.record_batch([pa.array([w for w, _ in part], pa.string()), pa.array([x is None for _, x in part], pa.bool_()), pa.array([sorted(x or ()) for _, x in part], pa.list_(pa.int64()))], ["term", "over", "texts"])

    return run


def most_texts(hits: int) -> int:
    """The most texts with a term of which so many hold an entity, for the bound of the share to reach MIN_SHARE."""
    n = hits
    while True:
        n += 1
        p = hits / n
        if (p + Z * Z / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n) < MIN_SHARE:
            return n - 1


def lower_bound(hits: Column, n: Column) -> Column:
    """Wilson's lower bound of the share hits / n at Z standard errors."""
    p = hits / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def sensitive_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, bits): the terms of the corpus that disclose a protected entity, with their largest mutual information.
    Equal texts count once; every count is exact."""
    texts = docs.select(F.col(text_col).alias("text"))
    held = arrow_map(texts, _entities, "entity long, text_hash long").distinct()
    entities = materialize(held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= LEAST_TEXTS))
    n_texts = texts.where("text != ''").select(F.xxhash64("text").alias("h")).distinct().count()
    n = entities.count()
    # both passes go over the corpus even without a candidate, so that the work is alike at every size; a checked number is sent as a set
    wanted = frozenset(r.entity for r in entities.select("entity").collect()) if n <= BROADCAST_ROWS // 10 else None
    together = arrow_map(texts, _pairs(wanted), "term string, entity long, text_hash long").distinct()
    counts = materialize(together.groupBy("term", "entity").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= LEAST_TEXTS).join(entities, "entity"))
    candidates = materialize(counts.groupBy("term").agg(F.max("n_et").alias("most")))
    n = candidates.count()
    if n <= BROADCAST_ROWS // 10:
        known = materialize(arrow_map(texts, _counting({r.term: most_texts(r.most) for r in candidates.collect()}), "term string, over boolean, texts array<long>"))
        over = known.where("over").select("term").distinct()
        held = known.where("not over").join(over, "term", "left_anti").select("term", F.explode("texts").alias("text_hash"))
    else:
        held = arrow_map(texts, _holding, "term string, text_hash long").join(candidates.select("term"), "term")
    n_t = materialize(held.distinct().groupBy("term").agg(F.count("*").alias("n_t")))
    bits = F.log2(F.col("n_et") / F.col("n_t") / (F.col("n_e") / F.lit(float(max(n_texts, 1)))))
    return counts.join(n_t, "term").where((lower_bound(F.col("n_et"), F.col("n_t")) >= MIN_SHARE) & (bits >= MIN_BITS)).groupBy("term").agg(F.max(bits).alias("bits"))


def all_spans(text: str | None, terms: frozenset[str]) -> tuple[list, list]:
    base = base_spans(text)
    extra = secret_spans(text) if text else []
    extra = [x for x in extra if not any(a < x[2] and x[1] < b for _, a, b in base)]
    if text and terms and not terms.isdisjoint(terms_of(text)):
        taken = [*base, *extra]
        for m in _LETTERS.finditer(text):
            if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in taken):
                extra.append((TERM, *m.span()))
    return base, extra


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans become <KIND>; terms are removed with nothing in their place. Overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], "" if kind == TERM else f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column `pii`: struct(n_email, n_ip, n_card, n_phone, base, spans, redacted).

    base and spans are `kind:start:end` in code points, end exclusive, comma-joined, by start, then kind as
    listed, then secrets and terms. Null text: no spans, and redacted is null. Every row of docs is returned once, with all
    its columns (one named pii is replaced); repeated rows get equal results and count once in the corpus; an empty
    table stays empty. Texts of any length are read whole. A share or bound equal to its threshold is reached.
    """
    bound_batches(docs.sparkSession)
    terms = materialize(sensitive_terms(docs, text_col).select("term"))
    n = terms.count()
    result = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string"

    def describe(text, chosen):
        base, extra = all_spans(text, chosen)
        k = [s[0] for s in base]
        order = (*KINDS, SECRET, TERM)
        write = lambda spans: ",".join(f"{x}:{a}:{b}" for x, a, b in spans)
        spans = sorted(base + extra, key=lambda s: (s[1], order.index(s[0])))
        return (k.count("email"), k.count("ip"), k.count("card"), k.count("phone"), write(base), write(spans), None if text is None else redact(text, spans))

    names = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted"]
    if n <= BROADCAST_ROWS // 10:
        chosen = frozenset(r.term for r in terms.collect())

        @F.pandas_udf(result)
        def spans_of(text: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([describe(t, chosen) for t in text], columns=names)

        return docs.withColumn("pii", spans_of(F.col(text_col)))

    @F.pandas_udf(result)
    def spans_with(text: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(t, frozenset(o) if o is not None else frozenset()) for t, o in zip(text, own)], columns=names)

    held = materialize(arrow_map(docs.select(F.col(text_col)), _holding, "term string, text_hash long").distinct().join(terms, "term").groupBy("text_hash").agg(F.collect_set("term").alias("_own")))

    @F.pandas_udf("long")
    def hash_of(text: pd.Series) -> pd.Series:
        return pd.Series([None if not t else text_hash(t) for t in text], dtype="Int64")

    # texts without terms are spread by their row number, so that no task gets all of them
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(hash_of(F.col(text_col)), F.monotonically_increasing_id()).alias("_h"))
    joined = keyed.join(held.hint("merge"), keyed["_h"] == held["text_hash"], "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "pii"], spans_with(F.col("_row")[text_col], F.col("_own")).alias("pii"))
