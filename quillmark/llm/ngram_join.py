"""N-gram Jaccard self-join by a universe-partition pigeonhole, with exact verification.

Sets of 5-word shingles x and y have Jaccard >= 0.8 only if their symmetric difference is at most
H = (|x| + |y|) / 9. Shingles are hashed into segments; the number of segments depends on the size
band (powers of two). If x and y differ by at most H, then among the first segments of x that hold
H + 1 units of error budget at least one agrees within its budget:

* rare shingles go to the first segments, with budget 1: the segment's whole subset is indexed;
* frequent shingles (hashed counts over the whole corpus) go to fewer, larger segments that come last,
  with budget 2: the subset and its one-deletion neighbourhood are indexed. Long posting lists are
  reached only by documents that consist of frequent shingles (the cost-based allocation).

Both sides walk the segments in the same order and stop when their budget is spent, so a document
has about a quarter as many signatures as shingles. A band in which some set cannot fill its budget is
indexed with one segment a shingle, where it always can.

Candidates: each document is first verified against the smallest document of the group that shares most
signatures with it. Then only groups whose members are still in different components are looked at: blocks of
their members, in the order of set size, are compared by a parity sketch (whose distance never exceeds the
symmetric difference), and each block passes on no more pairs than would join its components (a spanning forest
of the pairs that the sketches allow, nearest first). If all of these prove to be links, no other pair of the
block can change a component. Where one proves not to be, the documents that sketches connect to it are
compared by their whole sets, each against the documents outside the largest component. So no step lists the
pairs of a group, and a large group of copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm._common import arrow_map, discard, longs, materialize, mix, small
from quillmark.llm.components import connected_components
from quillmark.llm.words import stretches

WORDS = 5  # words in a shingle
COUNTERS = 1 << 20  # hashed counters of shingles
HOT_SHARE = 0.001  # a shingle in more documents than this share is frequent
FINE_BELOW = 64  # sets below this size are indexed with one segment a shingle
BLOCK = 512  # rows of a block when the members of a mixed group are compared
SPREAD = 512  # documents that one task compares with a block by whole sets
LN_MOST = 223_150  # a little above 10^6 ln(5 / 4); 5 / 4 is the largest ratio of the sizes of linked sets

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)  # any odd numbers


def shingles_of(w: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a sequence of word hashes; with fewer than five words the whole sequence is one."""
    if len(w) < WORDS:
        return mix((w * _C[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w))) if len(w) else w
    n = len(w) - WORDS + 1
    acc = w[:n] * _C[0]
    for j in range(1, WORDS):
        acc += w[j : n + j] * _C[j]
    return np.unique(mix(acc))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, in order."""
    for part in stretches(texts):
        h = part.hashes()
        for a, b in zip(part.first[:-1], part.first[1:]):
            yield shingles_of(h[a:b])


def allowed(x: int, y: int) -> int:
    """Largest symmetric difference of sets of these sizes at Jaccard 0.8."""
    return (x + y) // 9


def _schemes(n: int) -> list[tuple[int, int]]:
    """(band, most error) of each scheme a set of n takes part in: its own band, and the one below if a partner may be there."""
    band = n.bit_length() - 1
    out = [(band, allowed(n, n * 5 // 4))]
    top = (1 << band) - 1
    if band and n * 4 <= top * 5:
        out.append((band - 1, allowed(n, top)))
    return out


def signatures(s: np.ndarray, hot: np.ndarray, fine: frozenset[int]) -> tuple[np.ndarray, list[int]]:
    """The signatures of a shingle set, and the bands in which its budget cannot be filled."""
    out, failed = [], []
    for band, most in _schemes(len(s)):
        is_hot = hot[(s >> np.uint64(44)).astype(np.int64)]
        key = mix(s ^ np.uint64(0x5851F42D4C957F2D + band))
        if (2 << band) <= FINE_BELOW or band in fine:
            seg, budget_two = (key >> np.uint64(1)) | (is_hot.astype(np.uint64) << np.uint64(63)), None
        else:
            m, tail = (3 << band) // 4, (3 << band) // 8
            at = (key >> np.uint64(32)).astype(np.int64)
            seg = np.where(is_hot, m + at % tail, at % m)
            budget_two = m
        order = np.argsort(seg, kind="stable")
        seg, tok = seg[order], mix(s[order] + np.uint64(0x2545F4914F6CDD1D))
        start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[start, len(seg)])
        credit = np.ones(len(start), np.int64) if budget_two is None else np.where((seg[start] >= budget_two) & (size >= 2), 2, 1)
        before = np.cumsum(credit) - credit
        k = int(np.searchsorted(before, most, "right"))  # segments begun with at most `most` spent
        if before[-1] + credit[-1] < most + 1:
            failed.append(band)
        total = np.add.reduceat(tok, start)
        salt = mix(seg[start].astype(np.uint64) * np.uint64(64) + np.uint64(band))
        out.append(mix(total[:k] ^ salt[:k]))
        if budget_two is not None and (two := credit[:k] == 2).any():
            which = np.repeat(np.arange(len(start)), size)
            ours = (which < k) & np.r_[two, np.zeros(len(start) - k, bool)][which]
            out.append(mix((total[which[ours]] - tok[ours]) ^ salt[which[ours]]))
    return np.concatenate(out), failed


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes in a power-of-two number of bits, twice the set's size at most and 64 at least."""
    bits = max(64, 1 << len(s).bit_length())
    at = (mix(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def _scan(hot_bits: int):
    """Per document its size and a 128-bit hash of its set; per task the hashed counters far above their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(hot_bits, np.int32), 0
        shift = np.uint64(64 - hot_bits.bit_length() + 1)
        for b in batches:
            n, h1, h2, bits = [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64)))
                h2.append(int(mix(s ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)))
                bits.append(sketch(s).tobytes() if len(s) else b"")
                np.add.at(counts, (s >> shift).astype(np.int64), 1)
            docs += len(n)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), longs(np.array(h1, np.uint64)), longs(np.array(h2, np.uint64)), pa.array(bits, pa.binary())], ["doc_id", "n", "h1", "h2", "sketch"])
        if docs:
            mean = counts.mean()
            at = np.flatnonzero(counts > mean + 4 * np.sqrt(mean) + max(1, HOT_SHARE * docs / 2))
            k = len(at) + 1  # negative n marks counters; the first has the number of documents
            yield pa.record_batch([pa.nulls(k, pa.int64()), longs(np.full(k, -1)), longs(np.r_[-1, at]), longs(np.r_[docs, counts[at]].astype(np.int64)), pa.nulls(k, pa.binary())], ["doc_id", "n", "h1", "h2", "sketch"])

    return run


def _index(hot: bytes, fine: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = np.unpackbits(np.frombuffer(hot, np.uint8)).astype(bool), set()

        def rows(sigs, ids):
            return pa.record_batch([longs(np.concatenate(sigs)), longs(np.repeat(np.array([i for i, _ in ids], np.int64), [k for _, k in ids]))], ["sig", "node"])

        for b in batches:
            sigs, ids, held = [], [], 0
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1))):
                if i is None or len(s) == 0:
                    continue
                own = (len(s), int(s.sum(dtype=np.uint64)))
                if own in seen:  # a copy in this task: its set is indexed already
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(own)
                g, failed = signatures(s, mask, fine)
                for f in failed:  # signature 0 is kept for these marks; two of each, so that they survive as a group
                    g = np.r_[g, np.zeros(2, np.uint64)]
                marks = [n for f in failed for n in (-1 - f, -65 - f)]
                sigs.append(g)
                ids += [(i, len(g) - len(marks)), *((n, 1) for n in marks)]
                held += len(g)
                if held > 500_000:
                    yield rows(sigs, ids)
                    sigs, ids, held = [], [], 0
            if sigs:
                yield rows(sigs, ids)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())], ["node", "bits"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, sketch_a, sketch_b) -> the pairs (a, b) that sizes and sketches allow."""
    for b in batches:
        keep = []
        for n, m, x, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
            ok = bool(x and y) and 5 * min(n, m) >= 4 * max(n, m)
            if ok:
                w = min(len(x), len(y)) // 8
                ok = 9 * int(np.bitwise_count(fold(np.frombuffer(x, np.uint64), w) ^ fold(np.frombuffer(y, np.uint64), w)).sum()) <= n + m
            keep.append(ok)
        yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, bits): the whole shingle sets of the documents with these ids. Ids are broadcast if their count allows, else joined by shuffle."""
    nodes = materialize(nodes.select("node").distinct())
    wanted = docs.join(small(nodes, nodes.count()), docs.doc_id == nodes.node).select("node", "text")
    return arrow_map(wanted, _sets, "node long, bits binary")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by their whole sets. Sets are made for the documents of the pairs only."""
    sets = materialize(sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs))
    second = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("b"), F.col("bits").alias("bits_b"))
    joined = pairs.join(sets.select(F.col("node").alias("a"), "bits"), "a").join(second, "b").select("a", "b", "bits", "bits_b")
    links = materialize(arrow_map(joined, _verify, "a long, b long").distinct())
    discard(sets)
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, bits_a, bits_b) -> the pairs (a, b) with 100 * common >= 80 * union."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True)) if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) else 0
            keep.append(100 * common >= 80 * (len(x) + len(y) - common))
        yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def spanning(a: np.ndarray, b: np.ndarray, order: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) of a least spanning forest over the labels, by ascending order (Boruvka)."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label, out, left = label.copy(), [], np.arange(len(a))
    while True:
        la, lb = label[a[left]], label[b[left]]
        apart = la != lb
        left, la, lb = left[apart], la[apart], lb[apart]
        if not len(left):
            return np.unique(np.array(out, np.int64))
        best = np.full(int(label.max()) + 1, len(order), np.int64)
        np.minimum.at(best, la, rank[left])
        np.minimum.at(best, lb, rank[left])
        for e in np.unique(best[best < len(order)]):
            e = order[e]
            x, y = label[a[e]], label[b[e]]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                out.append(int(e))


def _allowed_pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, share of the allowed distance in 1/2^20) of the rows of one (sig, p, q) whose components differ and whose sizes and sketches allow a link."""
    same = rows[0][1] == rows[0][2]
    left, comp, n, node = (np.array([r[k] for r in rows], np.int64) for k in (3, 5, 6, 4))
    words = np.array([len(r[7]) // 8 for r in rows])
    found = []
    for w in np.unique(words):
        for v in (w, 2 * w):  # a set of up to 5/4 the size has a sketch of the same or twice the length
            li, ri = np.flatnonzero(words == w), np.flatnonzero(words == v)
            if not len(ri):
                continue
            lb = np.frombuffer(b"".join(rows[k][7] for k in li), np.uint64).reshape(len(li), -1)
            rb = np.frombuffer(b"".join(rows[k][7] for k in ri), np.uint64).reshape(len(ri), -1)
            if v > w:
                rb = rb[:, :w] ^ rb[:, w:]
            for k, i in enumerate(li):
                ok = (comp[ri] != comp[i]) & (5 * np.minimum(n[ri], n[i]) >= 4 * np.maximum(n[ri], n[i]))
                ok &= (ri > i) if v == w else True
                if not same:
                    ok &= left[ri] != left[i]
                at = np.flatnonzero(ok)
                if len(at):
                    far = np.bitwise_count(rb[at] ^ lb[k]).sum(axis=1, dtype=np.int64)
                    most = n[i] + n[ri[at]]
                    near = 9 * far <= most
                    found.append((np.full(near.sum(), i), ri[at][near], (far[near] << 20) // most[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, p, q): pairs that would join the components of the rows, as far as sketches allow."""

    def pairs(rows):
        if len({r[5] for r in rows}) < 2:
            return
        i, j, far = _allowed_pairs(rows)
        if len(i):
            node = np.array([r[4] for r in rows], np.int64)
            low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            label = np.unique(np.array([r[5] for r in rows], np.int64), return_inverse=True)[1]
            for e in spanning(i, j, np.lexsort((high, low, far)), label):
                yield int(low[e]), int(high[e])

    def batch(found):
        return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    group, key = [], None
    for b in batches:
        found = set()
        for r in zip(*(b.column(k).to_pylist() for k in ("sig", "p", "q", "is_left", "node", "component", "n", "sketch"))):
            if (r[0], r[1], r[2]) != key:
                found.update(pairs(group))
                group, key = [], (r[0], r[1], r[2])
            group.append(r)
        yield batch(found)
    yield batch(set(pairs(group)))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (s, block, salt, small first): links of each row with the small rows of its block, by whole sets;
    none between components that others of them join already."""
    key, small = None, []
    values = owner = sizes = None
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for b in batches:
        out = []
        for s, block, salt, is_small, node, comp, bits in zip(*(b.column(k).to_pylist() for k in ("s", "block", "salt", "small", "node", "component", "bits"))):
            if (s, block, salt) != key:
                key, small, values, root = (s, block, salt), [], None, {}
            mine = np.frombuffer(bits, np.uint64)
            if is_small:
                small.append((node, comp, mine))
                continue
            if values is None:
                sizes = np.array([len(x[2]) for x in small], np.int64)
                values, owner = np.concatenate([x[2] for x in small]), np.repeat(np.arange(len(small)), sizes)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            common = np.bincount(owner[at], minlength=len(small))
            for k in np.flatnonzero(100 * common >= 80 * (sizes + len(mine) - common)):
                x, y = find(comp), find(small[k][1])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((max(node, small[k][0]), min(node, small[k][0])))
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def settled(tried: DataFrame, links: DataFrame, comps: DataFrame, docs: DataFrame) -> DataFrame:
    """Further links among documents that the tried pairs connect, where some of these pairs are none.

    tried: the pairs passed on; links: those that are links; comps: (node, component) of all links so far, with
    every end of a tried pair. A document outside the largest component of what it is connected to meets all the
    others, in blocks of BLOCK; the others are spread over salts."""
    of = lambda k: comps.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    failed = materialize(tried.join(links, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("c_a != c_b").select("a", "b", "c_a", "c_b"))
    if not failed.limit(1).count():
        return failed.select("a", "b")
    # connected: components joined by tried pairs; a tried pair inside a component adds nothing
    spans = materialize(connected_components(failed.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))))
    members = materialize(comps.join(spans.select(F.col("node").alias("component"), F.col("component").alias("s")), "component").select("s", "component", "node"))
    counted = members.groupBy("s", "component").count()
    largest = materialize(counted.groupBy("s").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("largest"), F.sum("count").alias("k")))
    m = members.join(largest, "s")
    small = m.where("component != largest").withColumn("block", ((F.row_number().over(Window.partitionBy("s").orderBy("node")) - 1) / BLOCK).cast("int"))
    small = materialize(small.select("s", "component", "node", "block", "k"))
    blocks = small.groupBy("s").agg((F.max("block") + 1).alias("blocks"))
    salts = F.floor((F.col("k") - 1) / SPREAD).cast("int") + 1
    others = m.join(blocks, "s").select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(False).alias("small"), "node", "component")
    copies = small.select("s", "block", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("small"), "node", "component")
    sets = materialize(sets_of(members.select("node"), docs))
    rows = others.unionByName(copies).join(sets, "node").repartition("s", "block", "salt").sortWithinPartitions("s", "block", "salt", F.col("small").desc(), "node")
    found = materialize(arrow_map(rows.select("s", "block", "salt", "small", "node", "component", "bits"), _settle, "a long, b long").distinct())
    for t in (failed, spans, members, largest, small, sets):
        discard(t)
    return found


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Null or blank text: n_shingles 0, linked with nothing. Rows that share an id are one node. A null id
    links with nothing and has a null component. Repeated texts link; a pair at exactly 0.8 links. A text of any
    length is one set, made by one task. An empty table gives no rows. Other columns are not returned.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = materialize(arrow_map(docs, _scan(COUNTERS), "doc_id long, n long, h1 long, h2 long, sketch binary"))
    meta = scan.where("n >= 0")

    counted = scan.where("n < 0").groupBy("h1").agg(F.sum("h2").alias("c"))
    n_docs = (counted.where("h1 < 0").agg(F.max("c")).first()[0]) or 0
    rows = meta.agg(F.sum("n")).first()[0] or 0
    least = 2 * rows / COUNTERS + max(8, HOT_SHARE * n_docs)
    mask = np.zeros(COUNTERS, np.uint8)
    mask[[r.h1 for r in counted.where((F.col("h1") >= 0) & (F.col("c") >= least)).collect()]] = 1  # at most COUNTERS rows
    hot = np.packbits(mask).tobytes()

    index = lambda fine: arrow_map(docs, _index(hot, fine), "sig long, node long")
    by_sig = Window.partitionBy("sig")
    shared_of = lambda rows: rows.withColumn("leader", F.min("node").over(by_sig)).withColumn("last", F.max("node").over(by_sig)).where("leader < last").drop("last")
    shared = materialize(shared_of(index(frozenset())))
    unfilled = [-1 - r.node for r in shared.where("sig = 0 and node >= -64").select("node").distinct().collect()]  # at most 64 bands
    if unfilled:
        discard(shared)
        shared = materialize(shared_of(index(frozenset(unfilled)).where("sig != 0")))

    # first round: each document against the leader with which it shares most signatures
    first = shared.where("node != leader").groupBy("node", "leader").count().groupBy("node").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    about = meta.where("n > 0 and doc_id is not null").select("doc_id", "n", "sketch").dropDuplicates(["doc_id", "n", "sketch"])
    one, two = (about.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    near = first.select(F.col("node").alias("a"), F.col("leader").alias("b")).join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    links = verified(materialize(arrow_map(near, _possible, "a long, b long").distinct()), docs)

    # exact copies: everyone links with the smallest id of the same set
    copies = materialize(meta.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"))
    same = materialize(meta.where("n > 0").join(copies, ["h1", "h2", "n"]).where("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    edges = materialize(links.union(same).distinct())
    comps = materialize(connected_components(edges))

    # second round: groups of a signature that hold several components; of exact copies the smallest is enough
    nodes = materialize(about.join(same.select(F.col("a").alias("doc_id")), "doc_id", "left_anti").join(comps, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "doc_id").alias("component"), "n"))
    # groups with the same members give the same pairs: of those with equal sums of two hashes of the members one stays
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), "node").cast("decimal(20,0)")).over(by_sig)
    groups = shared.select("sig", "node").join(nodes, "node").withColumn("lo", F.min("component").over(by_sig)).withColumn("hi", F.max("component").over(by_sig)).where("lo < hi")
    groups = materialize(groups.select("sig", "node", "component", "n", F.count("*").over(by_sig).alias("k"), F.xxhash64(total(1)).alias("t1"), F.xxhash64(total(2)).alias("t2")))
    chosen = groups.groupBy("k", "t1", "t2").agg(F.min("sig").alias("sig")).select("sig")
    reach = Window.partitionBy("sig").orderBy("size")
    block = lambda c: ((c - 1) / BLOCK).cast("int")
    rows = groups.join(chosen, "sig", "left_semi").select("sig", "node", "component", "n", (F.ln("n") * 1_000_000).cast("long").alias("size")).distinct()
    rows = rows.withColumn("own", block(F.row_number().over(by_sig.orderBy("size", "node")))).withColumn("to", block(F.count("*").over(reach.rangeBetween(Window.unboundedPreceding, LN_MOST)))).withColumn("from", block(F.count("*").over(reach.rangeBetween(Window.unboundedPreceding, -LN_MOST)) + 1))
    dealt = rows.withColumn("other", F.explode(F.sequence("from", "to"))).select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("is_left"), "node", "component", "n")
    dealt = dealt.join(about.select(F.col("doc_id").alias("node"), "n", "sketch"), ["node", "n"]).repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")
    tried = materialize(arrow_map(dealt.select("sig", "p", "q", "is_left", "node", "component", "n", "sketch"), _cross, "a long, b long").distinct())
    for t in (shared, groups, nodes):
        discard(t)
    if tried.limit(1).count():
        more = verified(tried, docs)
        edges = materialize(edges.union(more))
        comps = materialize(connected_components(edges))
        ends = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
        alone = ends.join(comps, "node", "left_anti").select("node", F.col("node").alias("component"))
        last = settled(tried, more, materialize(comps.select("node", "component").union(alone)), docs)
        if last.limit(1).count():
            comps = materialize(connected_components(edges.union(last)))
    return meta.join(comps, meta.doc_id == comps.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicate rows of docs stays: the one with the smallest doc_id.

    Only a row whose own text links goes: rows that share an id but not their texts are told apart, and rows without
    words (null and blank texts) stay, all of them, as does a null id. Of rows with equal ids and texts one stays, the
    one whose other columns are least. Columns of docs may have any names. An empty table stays empty.
    """
    key = F.xxhash64("doc_id", "text")
    often = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 and doc_id is not null").select(F.col("doc_id").alias("_often")))
    n = often.count()
    d = docs.select("doc_id", "text")
    # rows of a repeated id are nodes of their own, named by a negative hash of id and text
    apart = F.lit(-(1 << 62)) - F.shiftrightunsigned(key, 2)
    if n:
        d = d.join(small(often.withColumn("_is", F.lit(True)), n), F.col("doc_id") == F.col("_often"), "left")
        d = d.select(F.when(F.col("_is"), apart).otherwise(F.col("doc_id")).alias("node"), "doc_id", "text")
    else:
        d = d.withColumn("node", F.col("doc_id"))
    comps = ngram_jaccard_components(d, "node").where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id")
    if not n:
        gone = materialize(comps.where("component_id != node").select("node").distinct())
        return docs.join(small(gone, gone.count()), docs.doc_id == gone.node, "left_anti").select(*docs.columns)
    ids = d.where("node < 0").select("node", "doc_id").distinct()
    named = comps.distinct().join(ids.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "component_id", F.when(F.col("_n").isNull(), F.col("node")).otherwise(F.col("doc_id")).alias("doc_id"))
    best = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("x")).select(F.col("x.node").alias("node"))
    gone = materialize(named.select("node").join(best, "node", "left_anti"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", words.alias("_words"), apart.alias("_key"))
    whole = whole.join(small(often.withColumn("_is", F.lit(True)), n), F.col("doc_id") == F.col("_often"), "left")
    whole = whole.withColumn("_node", F.when(F.col("_is"), F.col("_key")).otherwise(F.col("doc_id")))
    kept = whole.join(small(gone, gone.count()), F.col("_node") == F.col("node"), "left_anti")
    once = kept.where("_is and _words").groupBy("_node").agg(F.min("_row").alias("_row")).select("_row")
    return kept.where("_is is null or not _words").select("_row").unionByName(once).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
