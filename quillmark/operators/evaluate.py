"""Scores of a labelled corpus, metrics of runs, and nearest neighbours of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_score(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(outcome, *by) -> totals over all and over each column of by: correct, wrong, abstained, accuracy, precision when answered.

    Outcomes other than these three count nowhere."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    sets = [[], *[[F.col(c)] for c in by]]
    g = rows.groupingSets(sets, *[F.col(c) for c in by]).agg(n("correct").alias("correct"), n("wrong").alias("wrong"), n("abstained").alias("abstained"))
    sent, answered = F.col("correct") + F.col("wrong") + F.col("abstained"), F.col("correct") + F.col("wrong")
    share = lambda a, b: F.round(F.when(b > 0, a / b), 4)
    return g.select(*[F.coalesce(F.col(c).cast("string"), F.lit("*")).alias(c) for c in by], "correct", "wrong", "abstained", share(F.col("correct"), sent).alias("accuracy"), share(F.col("correct"), answered).alias("precision"), share(F.col("abstained"), sent).alias("abstention"))


def boundary_score(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """(file, page) of both -> found, missed and false boundaries, with precision and recall."""
    p, t = predicted.select("file", "page").distinct().withColumn("p", F.lit(1)), true.select("file", "page").distinct().withColumn("t", F.lit(1))
    j = p.join(t, ["file", "page"], "full_outer")
    g = j.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("found"), F.count_if(F.col("p").isNull()).alias("missed"), F.count_if(F.col("t").isNull()).alias("false"))
    return g.withColumn("precision", F.col("found") / (F.col("found") + F.col("false"))).withColumn("recall", F.col("found") / (F.col("found") + F.col("missed")))


def histogram(value: Column, bounds: list[float]) -> Column:
    """The first bound that a value doesn't exceed, as text; +Inf beyond the last."""
    out = None
    for b in bounds:
        out = F.when(value <= b, f"{b:g}") if out is None else out.when(value <= b, f"{b:g}")
    return out.otherwise("+Inf")


KNN_BLOCK = 4096  # vectors of a side that one task compares


def nearest(queries: DataFrame, exemplars: DataFrame, k: int) -> DataFrame:
    """(query_id, label, mean): mean cosine of a query's k nearest exemplars (vec_id, embedding, label) of each label; a vector
    is not its own exemplar. Null and zero vectors have no neighbours.

    Both sides are cut into blocks by a hash of their ids, and each pair of blocks is one task of bounded size, which
    passes on k cosines for each query and label; these are merged. One plan for any number of exemplars."""
    import numpy as np
    import pandas as pd

    usable = "vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x != 0) and forall(embedding, x -> x is not null)"
    q, e = queries.where(usable).select("vec_id", "embedding"), exemplars.where(usable).where("label is not null").select("vec_id", "embedding", "label")
    nq, ne = (max(1, -(-x.count() // KNN_BLOCK)) for x in (q, e))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = q.withColumn("qb", block(nq)).withColumn("eb", F.explode(F.sequence(F.lit(0), F.lit(ne - 1))))
    e = e.withColumn("eb", block(ne)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            unit = lambda col: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(np.stack([np.asarray(x, np.float64) for x in col]))
            c = unit(a.embedding) @ unit(b.embedding).T
            c[a.vec_id.to_numpy()[:, None] == b.vec_id.to_numpy()[None, :]] = -np.inf
            for label, at in b.groupby("label").indices.items():
                best = -np.sort(-c[:, at], axis=1)[:, :k]
                rows.append(pd.DataFrame({"query_id": a.vec_id.to_numpy(), "label": label, "top": [[float(x) for x in r if x > -np.inf] for r in best]}))
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "label": [], "top": []})

    label = dict(exemplars.dtypes)["label"]
    near = q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInPandas(run, f"query_id long, label {label}, top array<double>")
    top = near.groupBy("query_id", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, k).alias("top")).where(F.size("top") > 0)  # k for each block of exemplars
    return top.select("query_id", "label", (F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")).alias("mean"))


def sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """(user_id, session, started, ended, n): events of a user with no gap longer than gap_minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.lag("ts").over(w) < F.col("ts") - F.expr(f"interval {gap_minutes} minutes"), F.lit(True))
    return events.withColumn("session", F.sum(new.cast("int")).over(w)).groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
