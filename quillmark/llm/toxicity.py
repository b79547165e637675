"""Convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of hashed ones, of the word and of its beginnings; filters of widths 1 to 3 slide over
the whole text, each filter's largest response is kept (max pooling, through a ReLU), and a logistic unit scores the
pooled responses. Embeddings, filters and the unit are trained together from a random start. Every labelled row that
isn't held out is used: three quarters train, in shards whose models are averaged after each pass, and the rest
calibrate the decision thresholds by language. The score depends on the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import bound_batches, materialize, mix, small
from quillmark.llm.words import Stretch, stretches

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
PAD = BUCKETS  # the embedding that stays zero
SHARD, MOST_SHARDS = 4000, 32  # training texts that the driver learns by itself, else of a shard, of which there are so many at most
PASSES, CHUNK = 4, 512  # passes over all shards; texts that a shard's task holds and shuffles at a time
GRAIN = 1000  # thresholds come from counts of scores in steps of one in GRAIN
LEAST_POSITIVES = 20  # of a language, for a threshold of its own
DEFAULT_THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)  # lengths of word beginnings, in bytes
EPOCHS, BATCH, RATE, SEED = 12, 16, 0.1, 11
BLOCK = 2048  # words that are scored at a time
DROP = 0.2  # share of the words that a training step leaves out
START = {"embed": 0.03, "filters": 0.5, "out": 0.3}  # deviations of the random start


_FOLD = np.arange(256, dtype=np.uint8)  # second bytes of U+00C0 to U+00DE, lowered
_FOLD[0x80:0x9F] += 0x20
_FOLD[0x97] = 0x97
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _features(part: Stretch) -> np.ndarray:
    """A row of buckets for every word: of the word without case and ASCII marks around it, and of its beginnings of
    PREFIXES bytes where more follow (unused places hold PAD)."""
    data, start, length = part.data, part.start.copy(), part.length.copy()
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    data[second] = _FOLD[data[second]]
    for _ in range(4):  # marks after and before the word become blanks
        at = start + np.maximum(length, 1) - 1
        cut = _MARK[data[at]] & (length > 0)
        data[at[cut]] = 32
        length -= cut
        cut = _MARK[data[np.minimum(start, len(data) - 1)]] & (length > 0)
        data[start[cut]] = 32
        start += cut
        length -= cut
    rows = np.full((len(start), 1 + len(PREFIXES)), PAD, np.int32)
    if not len(start):
        return rows
    run, at = Stretch(part.row, data, start, length, part.first).prefix_sums()
    if not len(run):
        return rows
    before = np.where(at > 0, run[np.minimum(at, len(run)) - 1], np.uint64(0))
    for k, n in enumerate((None, *PREFIXES)):
        has = length > (n or 0)
        size = length[has] if n is None else n
        rows[has, k] = (mix(run[at[has] + size - 1] - before[has] + np.uint64(k + 1)) >> np.uint64(40)) % np.uint64(BUCKETS)
    return rows


def features_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of the words, first word of each text and the end) of stretches of a column, in order."""
    for part in stretches(texts):
        yield _features(part), part.first


@dataclass
class Model:
    embed: np.ndarray  # (BUCKETS + 1, DIM), last row zero
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def score_texts(m: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text of a column. A convolution is the sum of the filters' responses to the words at its places."""
    embed = m.embed.astype(np.float32)
    weights = np.hstack([m.filters[w][j] for w in WIDTHS for j in range(w)]).astype(np.float32)
    gap, scores = max(WIDTHS), [np.zeros(0)]  # empty words after each text, so that no window spans two texts
    for feats, first in features_of(texts):
        e = embed[feats[:, 0]]  # sums below go element by element, in one order: a text's score is the same in any company
        for k in range(1, feats.shape[1]):
            e += embed[feats[:, k]]
        n_texts = len(first) - 1
        g = np.zeros((len(feats) + gap * (n_texts + 1), weights.shape[1]), np.float32)
        shift = np.repeat(np.arange(n_texts) * gap, np.diff(first))
        for a in range(0, len(feats), BLOCK):
            part, to = e[a : a + BLOCK], np.arange(a, min(a + BLOCK, len(feats)))
            total = part[:, :1] * weights[0]
            for k in range(1, DIM):
                total += part[:, k : k + 1] * weights[k]
            g[to + shift[a : a + BLOCK]] = total
        starts, n, pooled, at = first[:-1] + np.arange(n_texts) * gap, len(feats) + gap * n_texts, [], 0
        for w in WIDTHS:
            r = g[: n + 1, at : at + FILTERS].copy()
            for j in range(1, w):
                r += g[j : n + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            ends = starts + np.diff(first) + gap - w + 1  # the last window ends with the text's empty words
            pooled.append(np.maximum(np.maximum.reduceat(r, np.stack([starts, ends], axis=1).reshape(-1), axis=0)[::2] + m.bias[w], 0))
        z = (np.hstack(pooled).astype(np.float64) * m.out).sum(axis=1) + m.out_bias
        scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(scores)


def docs_of(texts: pa.Array) -> list[np.ndarray]:
    return [f[a:b].astype(np.uint16) for f, first in features_of(texts) for a, b in zip(first[:-1], first[1:])]  # PAD fits


class Trainer:
    """A model and its Adagrad state, from a seeded random start or a copy of another's."""

    def __init__(self, start: dict | None = None):
        self.v = {k: x.copy() for k, x in start.items()} if start else self.fresh()

    @staticmethod
    def fresh() -> dict[str, np.ndarray]:
        r = np.random.default_rng(SEED)
        units = FILTERS * len(WIDTHS)
        v = {"embed": r.normal(0, START["embed"], (BUCKETS + 1, DIM))}
        v["embed"][PAD] = 0
        v |= {f"f{w}": r.normal(0, START["filters"], (w, DIM, FILTERS)) for w in WIDTHS} | {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
        v |= {"out": r.normal(0, START["out"], units), "out_bias": np.full(1, -1.0)}
        return v | {f"seen_{k}": np.full(BUCKETS + 1, 1e-4) if k == "embed" else np.full_like(x, 1e-3) for k, x in list(v.items())}

    def model(self) -> Model:
        return Model(self.v["embed"], {w: self.v[f"f{w}"] for w in WIDTHS}, {w: self.v[f"b{w}"] for w in WIDTHS}, self.v["out"], float(self.v["out_bias"][0]))

    def step(self, key: str, gradient: np.ndarray, rate: float) -> None:
        self.v[f"seen_{key}"] += gradient * gradient
        self.v[key] -= rate * gradient / np.sqrt(self.v[f"seen_{key}"])

    def learn(self, docs: list[np.ndarray], y: np.ndarray, rate: float, r: np.random.Generator) -> None:
        """One pass over some texts, in batches of whole texts with some words left out."""
        v, per_word, order = self.v, 1 + len(PREFIXES), r.permutation(len(docs))
        gap = np.full((max(WIDTHS), per_word), PAD, np.uint16)  # empty words after each text
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids = np.concatenate([x for k in chosen for x in (docs[k], gap)])
            ends = np.cumsum([len(docs[k]) + len(gap) for k in chosen])
            starts = np.r_[0, ends[:-1]]
            ids[r.random(len(ids)) < DROP] = PAD
            e = v["embed"][ids].sum(axis=1)
            tops, pooled = {}, []
            for w in WIDTHS:
                size = len(ids) - w + 1
                response = sum(e[j : size + j] @ v[f"f{w}"][j] for j in range(w))
                tops[w] = np.stack([a + response[a : b - w + 1].argmax(axis=0) for a, b in zip(starts, ends)])
                pooled.append(np.maximum(np.take_along_axis(response, tops[w], 0) + v[f"b{w}"], 0))
            h = np.hstack(pooled)
            g = 1 / (1 + np.exp(-np.clip(h @ v["out"] + v["out_bias"], -30, 30))) - y[chosen]
            dh = g[:, None] * v["out"] * (h > 0)
            rows, moves = [], []
            for q, w in enumerate(WIDTHS):
                d = dh[:, q * FILTERS : (q + 1) * FILTERS]
                by_place = [e[tops[w] + j] for j in range(w)]  # (texts, filters, DIM)
                for j in range(w):
                    rows.append(ids[tops[w] + j].reshape(-1))
                    moves.append(np.repeat((d[:, :, None] * v[f"f{w}"][j].T).reshape(-1, DIM), per_word, axis=0))
                self.step(f"f{w}", np.stack([np.einsum("kfd,kf->df", x, d) for x in by_place]), rate)
                self.step(f"b{w}", d.sum(axis=0), rate)
            self.step("out", h.T @ g, rate)
            self.step("out_bias", g.sum(keepdims=True), rate)
            touched, place = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(touched), DIM))
            np.add.at(total, place, np.concatenate(moves))
            v["seen_embed"][touched] += (total * total).sum(axis=1)
            v["embed"][touched] -= rate * total / np.sqrt(v["seen_embed"][touched])[:, None]
            v["embed"][PAD] = 0


def train(texts: list[str | None], y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Fit by Adagrad from a seeded random start. No count or weight of a word is given: what the filters respond to is
    learned from the labels through the max pooling."""
    t, docs, r = Trainer(), docs_of(pa.array(texts, pa.string())), np.random.default_rng(SEED + 1)
    for epoch in range(epochs):
        t.learn(docs, y, RATE / (1 + epoch / 4), r)
    return t.model()


def averaged(start: dict[str, np.ndarray], ends: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The mean of shards' ends; a bucket's embedding, of those that moved it."""
    out = {}
    for k, x in start.items():
        moves = [e[k] - x for e in ends]
        moved = sum((m != 0).any(axis=1, keepdims=True) for m in moves) if k == "embed" else sum(m != 0 for m in moves) if k == "seen_embed" else len(ends)
        out[k] = x + sum(moves) / np.maximum(moved, 1)
    return out


def train_shards(rows: DataFrame, shards: int, passes: int = PASSES) -> Model:
    """train() for any number of texts: rows (shard, order_, toxic, text). Each pass goes over every row; a task holds
    CHUNK texts of a shard at a time."""
    state = Trainer.fresh()
    state = {k: x.astype(np.float32) for k, x in state.items()}
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "order_", "doc_id", "toxic")
    for number in range(passes):
        sent = rows.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], number=number, sent=sent) -> Iterator[pa.RecordBatch]:
            shard, t, r, texts, y = None, None, None, [], []

            def learn() -> None:
                if texts:
                    t.learn(docs_of(pa.array(texts, pa.string())), np.array(y), RATE / (1 + number), r)
                    texts.clear(), y.clear()

            def end() -> pa.RecordBatch:
                learn()
                flat = np.concatenate([t.v[k].reshape(-1) for k in sorted(t.v)]).astype(np.float32)
                return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "end": pa.array([flat.tobytes()], pa.binary())})

            for b in batches:
                for s, c, text in zip(b["shard"].to_pylist(), b["toxic"].to_pylist(), b["text"].to_pylist()):
                    if s != shard:
                        if t:
                            yield end()
                        shard, t, r = s, Trainer(sent.value), np.random.default_rng([SEED, number, s])
                    texts.append(text), y.append(c)
                    if len(texts) == CHUNK:
                        learn()
            if t:
                yield end()

        ends = []
        for x in sorted(dealt.select("shard", "toxic", "text").mapInArrow(run, "shard int, end binary").collect(), key=lambda x: x.shard):
            flat, at, one = np.frombuffer(x.end, np.float32), 0, {}
            for k in sorted(state):
                one[k] = flat[at : at + state[k].size].reshape(state[k].shape)
                at += state[k].size
            ends.append(one)
        state = averaged(state, ends)
        sent.unpersist()
    return Trainer(state).model()


def best_threshold(scores: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold with the best F1 (n: how often each score and label stands), in the middle of the gap it falls into; ties go to the one nearest 0.5."""
    order = np.argsort(-scores, kind="stable")
    n = np.ones(len(scores), int) if n is None else n
    s, t, k = scores[order], np.cumsum((y * n)[order]), np.cumsum(n[order])
    f1 = 2 * t / (k + (y * n).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores fall on one side
    after = np.r_[s[1:], 0.0]
    mid = (s + after) / 2
    best = np.flatnonzero(f1 == f1.max())
    return float(mid[best[np.argmin(np.abs(mid[best] - 0.5))]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def scorer(m: Model):
    m.embed = m.embed.astype(np.float32)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(score_texts(m, pa.array(texts, pa.string(), from_pandas=True)))

    return score


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all labelled rows that aren't held out; None if a class is missing. A quarter of them, by a hash of the
    id, calibrates the thresholds; if a class were missing among the rest, they train too."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    # one row of each id, the least text of repeated ones
    met = docs.select("doc_id", F.struct("text", "lang").alias("x")).join(small(usable, usable.count()), "doc_id").groupBy("doc_id", "toxic").agg(F.min("x").alias("x"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    rows = materialize(met.select("doc_id", "toxic", "x.text", "x.lang", order.alias("order_"), (F.pmod(order, F.lit(4)) > 0).alias("learn")))
    n = {(r.toxic, r.learn): r["count"] for r in rows.groupBy("toxic", "learn").count().collect()}
    if {c for c, _ in n} != {0, 1}:
        return None
    split = (0, True) in n and (1, True) in n
    learn = rows.where("learn") if split else rows
    size = sum(k for (_, x), k in n.items() if x or not split)
    if size <= SHARD:
        have = sorted(learn.select("doc_id", "toxic", "text").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.toxic))  # at most SHARD rows
        m = train([r.text for r in have], np.array([r.toxic for r in have]))
    else:
        shards = min(MOST_SHARDS, -(-size // SHARD))
        m = train_shards(learn.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(shards)).cast("int")), shards)
    rest = rows.where("not learn") if split else rows
    step = F.floor(scorer(m)("text") * GRAIN).cast("int")
    counts: dict[str, list] = {}
    for r in rest.select(F.coalesce("lang", F.lit("")).alias("lang"), step.alias("at"), "toxic").groupBy("lang", "at", "toxic").count().collect():  # languages times steps
        counts.setdefault(r.lang, []).append((r.at, r.toxic, r["count"]))
    for lang, listed in sorted(counts.items()):
        if sum(k for _, c, k in listed if c) >= LEAST_POSITIVES:
            listed = sorted(listed)
            at, y, k = (np.array(x) for x in zip(*listed))
            m.thresholds[lang] = float(np.clip(best_threshold((at + 0.5) / GRAIN, y, k), 0.1, 0.9))
    return m


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score, threshold and toxic (score >= threshold): every row, with all its columns (those of these names are replaced).

    Null and empty texts get the score of a text without words. Without labels of both classes every score is 0.
    A language without enough labelled positives has DEFAULT_THRESHOLD; a score equal to its threshold is toxic.
    Repeated rows get equal results; an empty table stays empty. Texts of any length are read whole. Labels other than
    0 and 1 and null ids in labels are ignored; a null lang is a language of its own.
    """
    bound_batches(docs.sparkSession)
    m = fit(docs, labels)
    if m is None:
        scored = docs.withColumn("score", F.lit(0.0))
    else:
        scored = docs.withColumn("score", scorer(m)(F.col("text")))
    limits = m.thresholds if m else {}
    threshold = F.lit(DEFAULT_THRESHOLD)
    for lang, v in sorted(limits.items()):
        threshold = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(v)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))
