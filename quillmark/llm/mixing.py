"""Mixing sources to target weights along a time-varying curriculum.

Each source s has an integrable weight schedule w_s(t) = 1 + a_s (2t - 1) over training time t in [0, 1],
|a_s| <= 1; its cumulative demand is the integral D_s(t) = t + a_s (t^2 - t), with D_s(0) = 0 and
D_s(1) = 1. A document's words fill an interval of its source's demand; inverting D_s at the middle of
that interval gives its training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm._common import discard, materialize, small, values

WEIGHTS = (5, 2, 1)  # repeating over the sources in order
MOST_REPEATS = 3
RAMPS = (-0.5, 0.0, 0.5)  # a_s, repeating likewise: from early to late sources
SEED = 0x6D6978  # of the order of documents within a source
BUCKET_ROWS = 20_000  # documents in a bucket of a source's order, on average


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(stats: DataFrame) -> DataFrame:
    """Adds k, each source's place by code point (null last), without bringing all sources into one task."""
    spark = stats.sparkSession
    ordered = stats.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = materialize(ordered.select(F.spark_partition_id().alias("part"), "source", "source_size"))
    counts, before, offsets = sorted((r.part, r["count"]) for r in ordered.groupBy("part").count().collect()), 0, []
    for part, n in counts:  # one row a partition
        offsets.append((part, before))
        before += n
    if not offsets:
        return ordered.select("source", "source_size", F.lit(0).cast("long").alias("k"))
    table = F.broadcast(values(spark, offsets, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.join(table, "part").select("source", "source_size", (place - 1 + F.col("before")).cast("long").alias("k"))


def _nth(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (k % len(values) + 1).cast("int"))


def targets(stats: DataFrame) -> DataFrame:
    """(source, source_size) -> also weight, ramp and target: weighted shares of the whole size, none above
    MOST_REPEATS times its source; what is above is shared anew by weight. The driver sees sums only."""
    t = materialize(ranked_sources(stats).withColumn("weight", _nth(WEIGHTS, F.col("k"))).withColumn("ramp", _nth(RAMPS, F.col("k"))).withColumn("capped", F.col("source_size") == 0))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    while True:
        fixed, weight, n = t.agg(F.sum(F.expr(f"if(capped, source_size * {MOST_REPEATS}, 0)")), F.sum(F.expr("if(capped, 0D, weight)")), F.sum(F.col("capped").cast("long"))).first()
        level = (total - fixed) / weight if weight else 0.0
        new = F.col("capped") | (F.col("weight") * level > F.col("source_size") * MOST_REPEATS)
        m = t.agg(F.sum(new.cast("long"))).first()[0]
        if m == n:
            return t.withColumn("target", F.when(F.col("capped"), F.col("source_size") * float(MOST_REPEATS)).otherwise(F.col("weight") * F.lit(level)))
        after = materialize(t.withColumn("capped", new))
        discard(t)
        t = after


def invert_demand(u: Column, ramp: Column) -> Column:
    """t with t + ramp (t^2 - t) = u: the root of ramp t^2 + (1 - ramp) t - u in [0, 1], in its stable form."""
    b = F.lit(1.0) - ramp
    return F.least(F.lit(1.0), 2 * u / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * ramp * u))))


def planned(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", seed: int = SEED, payload: tuple[str, ...] = ()) -> DataFrame:
    """mix_documents() before its rows are sorted."""
    names = {"_size": size, "_source": F.col(source_col), "_id": F.col(id_col)}
    keep = [c for c in payload]
    t = docs.select(*[v.alias(k) for k, v in names.items()], *[F.col(c).alias(f"_p_{c}") for c in keep])
    t = t.withColumn("_size", F.coalesce(F.col("_size").cast("long"), F.lit(0))).withColumn("_hash", F.xxhash64(F.lit(seed), "_id", "_size"))
    slim = materialize(t.select("_size", "_source", "_id", "_hash"))
    t = t if keep else slim
    per_source = materialize(slim.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows")))
    rows = per_source.agg(F.sum("rows")).first()[0] or 0
    bits = min(40, max(4, (rows // BUCKET_ROWS).bit_length() + 6))  # also of a hot source each bucket stays small
    t, slim = (x.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits)) for x in (t, slim))
    plan = targets(per_source.select(F.col("_source").alias("source"), "source_size"))

    by_bucket = slim.groupBy("_source", "_bucket").agg(F.sum("_size").alias("in_bucket"))
    # prefix sums over a source's buckets, themselves in two levels: coarse ranges of buckets, then buckets of a range
    by_bucket = materialize(by_bucket.withColumn("range", F.shiftrightunsigned("_bucket", bits // 2)))
    coarse = by_bucket.groupBy("_source", "range").agg(F.sum("in_bucket").alias("in_range"))
    coarse = coarse.withColumn("before_range", F.sum("in_range").over(Window.partitionBy("_source").orderBy("range")) - F.col("in_range")).drop("in_range")
    w = Window.partitionBy("_source", "range").orderBy("_bucket")
    starts = by_bucket.withColumn("inner", F.sum("in_bucket").over(w) - F.col("in_bucket")).alias("b").join(coarse.alias("c"), F.col("b._source").eqNullSafe(F.col("c._source")) & (F.col("b.range") == F.col("c.range")))
    starts = starts.select(F.col("b._source").alias("source"), "_bucket", (F.col("inner") + F.col("before_range")).alias("before"))
    starts = starts.join(plan.select(F.col("source").alias("s"), "source_size", "target", "ramp"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = materialize(starts.withColumnRenamed("_bucket", "b"))

    within = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_id", *[f"_p_{c}" for c in keep if "map<" not in dict(docs.dtypes)[c]])
    t = t.withColumn("_run", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    t = t.join(small(starts, starts.count()), F.col("_source").eqNullSafe(F.col("source")) & (F.col("_bucket") == F.col("b")))
    t = t.withColumn("_at", F.col("before") + F.col("_run"))
    t = t.withColumn("_goal", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    t = t.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_goal") - F.col("passes") * F.col("source_size") - F.col("_at"))))
    t = t.withColumn("taken", F.col("passes") * F.col("_size") + F.col("part"))
    repeats = F.when(F.col("_size") > 0, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(0).cast("int")
    middle = lambda r: (r * F.col("source_size") + F.col("_at") + F.col("_size") / 2.0) / F.greatest("_goal", F.lit(1))
    every = F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS)), lambda r: invert_demand(F.least(F.lit(1.0), middle(r)), F.col("ramp")))
    t = t.withColumn("positions", F.slice(every, F.lit(1), repeats)).withColumn("position", F.get("positions", F.lit(0)))
    t = t.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target", "taken", "passes", "part", "positions", "position", *[F.col(f"_p_{c}").alias(c) for c in keep])
    return t


def mix_documents(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", seed: int = SEED, payload: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with size, source_size, target, taken, passes (its whole repeats), part (words of a
    last, partial repeat) and positions (one for each repeat, ascending; empty if the mix takes nothing).

    Within a source documents go in a seeded hash order. Each takes part in floor(target / source_size) whole
    repeats; the first ones in the order also fill the rest of the target, the last of them in part. Rows are
    range-sorted by their first position (those not taken last).

    Null sources are a source of their own (last). Null sizes count 0. Documents of size 0 are never taken.
    Repeated rows and ties are told apart by a count in their order and each has its own place; an empty table
    gives no rows. Columns of docs named like the result's are replaced; payload columns are carried.
    """
    t = planned(docs, size, source_col, id_col, seed, payload)
    return t.repartitionByRange(F.col("position").asc_nulls_last(), F.col(id_col)).sortWithinPartitions(F.col("position").asc_nulls_last(), F.col(id_col))


def curriculum(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix as a table with the columns of docs, in training order: one row per repeat, a partial repeat cut
    after its words; documents that the mix does not take are absent.

    Null and blank texts have size 0 and so are absent; a null doc_id is an id like others; of repeated rows each has
    its own place; rows with equal positions go by doc_id; an empty table gives no rows. docs may have columns of any
    names, also those of mix_documents(). A long text is one value, held by one task; a text moves twice.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", text_col)]
    # the other columns travel in one struct, so that no name of theirs can clash
    packed = docs.select("doc_id", "source", F.struct(F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("row"))
    m = planned(packed, word_count(F.col("row.text")), payload=("row",))
    rows = m.select("doc_id", "source", "row", "passes", "part", F.posexplode("positions").alias("_pass", "_position"))
    rows = rows.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id")
    word_ends = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # one word in each piece
    cut = F.array_join(F.slice(word_ends, F.lit(1), F.col("part").cast("int")), "")
    made = {text_col: F.when(F.col("_pass") < F.col("passes"), F.col("row.text")).otherwise(cut), "doc_id": F.col("doc_id"), "source": F.col("source")} | {c: F.col(f"row.c{k}") for k, c in enumerate(others)}
    return rows.select(*[made[c].alias(c) for c in docs.columns])
