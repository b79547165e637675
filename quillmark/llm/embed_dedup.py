"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised; h(v) = floor((a.v + b) / W) with Gaussian a and uniform b quantises a random
projection. Several such values and the label make a bucket of one of several tables. Their numbers follow the
largest label's vectors: so many values that few unrelated vectors share a bucket, and so many tables that a pair at
the least cosine is found with probability 0.98. Only buckets that hold two different vectors are looked at: their
members meet in blocks, cosines are computed in double precision, and a pair counts in the first table in which its
two vectors share a bucket, so it counts once without any list of pairs. Equal vectors are one representative with a
count beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm._common import arrow_map, longs, materialize, mix, small
from quillmark.llm.components import connected_components

LEAST_COSINE = 0.98
WIDTH = 1.6
NEAR_SHARE, FAR_SHARE = 0.90, 0.41  # a value is equal for vectors at cosine 0.98, and at cosine 0, with these probabilities
MISS, STRANGERS = 0.02, 0.2  # a pair at cosine 0.98 is missed, and a vector's bucket holds so many unrelated ones, at most
SEED = 7
BLOCK = 512


def plan(largest: int) -> tuple[int, int]:
    """(tables, values in each) for labels of up to so many vectors."""
    values = max(4, math.ceil(math.log(max(1, largest) / STRANGERS) / -math.log(FAR_SHARE)))
    return math.ceil(math.log(MISS) / math.log(1 - NEAR_SHARE**values)), values


def projections(dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([SEED, dim])
    return r.standard_normal((n, dim)).T, r.uniform(0, WIDTH, n)


def table_keys(vectors: np.ndarray, label: np.ndarray, tables: int, values: int) -> np.ndarray:
    """uint64 bucket keys (rows, tables) of normalised vectors."""
    a, b = projections(vectors.shape[1], tables * values)
    q = np.floor((vectors @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, values)
    key = mix(label.astype(np.int64).view(np.uint64)[:, None] + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    for j in range(values):
        key = mix(key ^ (q[:, :, j] * np.uint64(0xD6E8FEB86659FD93)))
    return key


def unit_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in double precision with length 1) of each number of components."""
    sizes = np.asarray(column.value_lengths())
    starts = np.cumsum(sizes) - sizes
    flat = np.asarray(column.flatten()).astype(np.float64)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        v = flat[starts[at][:, None] + np.arange(dim)]
        v /= np.abs(v).max(axis=1, keepdims=True)
        yield at, v / np.linalg.norm(v, axis=1, keepdims=True)


def _buckets(tables: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, label = (np.asarray(b.column(k)) for k in (0, 1))
            for at, v in unit_vectors(b.column(2)):
                keys = table_keys(v, label[at], tables, values)
                yield pa.record_batch([longs(np.repeat(rep[at], tables)), longs(keys.reshape(-1))], ["rep", "bucket"])

    return run


def _links(tables: int, values: int):
    """Rows sorted by (bucket, p, q): (rep, links counted here, a linked rep of its local component)."""

    def block(t: pa.Table) -> list[tuple]:
        bucket, p, q, rep, copies, label = (np.asarray(t.column(k)) for k in ("bucket", "p", "q", "rep", "copies", "label"))
        left = np.asarray(t.column("is_left"))
        linked = np.zeros((len(rep), len(rep)), bool)
        keys = np.zeros((len(rep), tables), np.uint64)
        for at, v in unit_vectors(t.column("embedding").combine_chunks()):
            linked[np.ix_(at, at)] = v @ v.T >= LEAST_COSINE
            keys[at] = table_keys(v, label[at], tables, values)
        linked &= (label[:, None] == label[None, :]) & (rep[:, None] != rep[None, :])
        if p[0] != q[0]:  # only pairs across the two blocks
            linked &= left[:, None] != left[None, :]
        i, j = np.nonzero(np.triu(linked))
        if not len(i):
            return []
        table = np.argmax(keys[i] == bucket[:1].view(np.uint64)[0], axis=1)  # the table of this bucket
        first = np.argmax(keys[i] == keys[j], axis=1) == table
        add = np.zeros(len(rep), np.int64)
        np.add.at(add, i[first], copies[j[first]])
        np.add.at(add, j[first], copies[i[first]])
        name = rep.copy()
        order = {r: k for k, r in enumerate(rep.tolist())}
        while True:  # smallest reachable rep in this block
            new = np.minimum(name, np.where(linked, name[None, :], np.int64(2**62)).min(axis=1))
            new = np.minimum(new, new[[order[x] for x in new.tolist()]])
            if (new == name).all():
                break
            name = new
        at = np.flatnonzero(linked.any(axis=1))
        return list(zip(rep[at].tolist(), add[at].tolist(), name[at].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of a group that may go on in the next batch

        def record(rows):
            return pa.record_batch([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or ((), (), ()))], ["rep", "links", "other"])

        for b in batches:
            if not b.num_rows:
                continue
            t, out = pa.Table.from_batches([b]), []
            keys = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in ("bucket", "p", "q")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            if held and held[0].slice(0, 1).select(["bucket", "p", "q"]).to_pylist() != t.slice(0, 1).select(["bucket", "p", "q"]).to_pylist():
                out += block(pa.concat_tables(held))
                held = []
            for a, e in zip(cuts[:-1], cuts[1:]):
                held.append(t.slice(a, e - a))
                if e < len(keys):
                    whole = pa.concat_tables(held)
                    if whole.num_rows > 1:
                        out += block(whole)
                    held = []
            yield record(out)
        if held:
            yield record(block(pa.concat_tables(held)))

    return run


def embedding_components(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept: one row per input row.

    Vectors link if their labels are equal and not null and their cosine is at least LEAST_COSINE. Vectors that are
    null, empty, zero or hold null or non-finite components, and those without a label, link with nothing; vectors of
    different lengths never link. A cosine equal to LEAST_COSINE links. Repeated rows are vectors of their own and link;
    rows with one vec_id are one node. A null vec_id links with nothing. An empty table gives no rows. Other columns,
    of whatever names, are not returned.
    """
    t = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    usable = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x != 0)")
    good = t.where(usable).withColumn("h", F.xxhash64("label", "embedding"))
    reps = materialize(good.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))

    tables, values = plan(reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    by = Window.partitionBy("bucket")
    rows = arrow_map(reps.select("rep", "label", "embedding"), _buckets(tables, values), "rep long, bucket long")
    busy = materialize(rows.withColumn("n", F.count("*").over(by)).where("n > 1"))
    numbered = busy.withColumn("own", ((F.row_number().over(by.orderBy("rep")) - 1) / BLOCK).cast("int")).withColumn("blocks", ((F.col("n") - 1) / BLOCK).cast("int") + 1)
    dealt = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("is_left"), "rep")
    dealt = dealt.join(reps.select("rep", "copies", "label", "embedding"), "rep").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    found = materialize(arrow_map(dealt.select("bucket", "p", "q", "is_left", "rep", "copies", "label", "embedding"), _links(tables, values), "rep long, links long, other long"))

    copies = good.select("vec_id", "label", "h", "embedding").join(reps.select("label", "h", "embedding", "rep", "copies"), ["label", "h", "embedding"]).select("vec_id", "rep", "copies")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = materialize(connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))))
    per_rep = reps.select("rep", "copies").join(counts, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_rep = materialize(per_rep)
    linked = copies.join(small(per_rep, per_rep.count()), "rep").select("vec_id", "n_links", "component_id")
    rest = t.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
