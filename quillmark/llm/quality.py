"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into buckets whose number grows with the corpus. Two multinomials with additive
smoothing are counted: over all trusted texts, and over the whole corpus. A document's score is its mean
log-likelihood ratio per n-gram (length-normalised). Every document is decided by one threshold, which the trusted
texts set: as far below their lower quartile as a fixed number of their quartile distances. All of it is built-in
expressions; the ratios are a table that the n-grams are joined with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import materialize, small

BUCKETS = 1 << 14  # at least
AT_CHARS, AT_BUCKETS, GROWTH = 25_000_000, 1 << 17, 0.4  # buckets follow the corpus as distinct n-grams do, by a power below 1
PACK = 64  # buckets in a row of the ratio table
PACKED_ROWS = 1 << 20  # a ratio table of so many rows (256 MB) may be broadcast
SMOOTHING = 1.0
DISTANCES, LEAST_DISTANCE = 6.0, 0.01  # quartile distances below the trusted lower quartile, and the least such distance
SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = "' \\t\\n\\u000B\\f\\r'"


def _words(text: str, change: str = "{}") -> str:
    """SQL for the words of a text, changed before it is split (lower({}), say).

    The condition on the row number always holds. It keeps the optimizer from moving a filter below this step and
    so from splitting the text again for every element that a lambda looks at."""
    return rf"if(monotonically_increasing_id() < 0 or not coalesce({text} rlike r'[^\x20\x09-\x0D]', false), array(), split(btrim({change.format(text)}, {_BLANKS}), r'{SPACE}'))"


def words_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _w, the words of the whole text."""
    return docs.withColumn("_w", F.expr(_words(f"`{text_col}`")))


def words_and_grams(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Adds _g, the buckets of the lower-cased unigrams and bigrams of the whole text."""
    d = docs.withColumn("_l", F.expr(_words(f"`{text_col}`", "lower({})")))
    one, two = f"cast(pmod(xxhash64(x), {buckets}) as int)", f"cast(pmod(xxhash64(x, y), {buckets}) as int)"
    return d.withColumn("_g", F.expr(f"if(size(_l) = 0, array(), concat(transform(_l, x -> {one}), zip_with(slice(_l, 1, size(_l) - 1), slice(_l, 2, size(_l)), (x, y) -> {two})))")).drop("_l")


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """AT_BUCKETS for a corpus of AT_CHARS code points, growing by the power GROWTH of its size; at least BUCKETS."""
    n = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(BUCKETS, int(AT_BUCKETS * (n / AT_CHARS) ** GROWTH) // PACK * PACK)


def with_trust(docs: DataFrame, trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, _t): _t is 1 for rows whose doc_id is trusted, else null."""
    chosen = materialize(trusted.where("doc_id is not null").select("doc_id").distinct())
    return docs.join(small(chosen.withColumn("_t", F.lit(1)), chosen.count()), "doc_id", "left").select(text_col, "_t")


def ratio_table(docs: DataFrame, buckets: int, text_col: str = "text") -> DataFrame:
    """(pack, ratios): log(p_target / p_raw) of the buckets from pack * PACK on. docs: (text, _t) of with_trust()."""
    grams = words_and_grams(docs, text_col, buckets).select(F.explode_outer("_g").alias("g"), "_t").where("g is not null")
    counted = materialize(grams.groupBy("g").agg(F.count("*").alias("raw"), F.count("_t").alias("target")))
    raw, target = (x or 0 for x in counted.agg(F.sum("raw"), F.sum("target")).first())
    more = SMOOTHING * buckets
    ratio = F.log((F.col("target") + SMOOTHING) / (target + more)) - F.log((F.col("raw") + SMOOTHING) / (raw + more))
    packed = counted.select(F.expr(f"cast(g div {PACK} as int)").alias("pack"), F.struct((F.col("g") % PACK).alias("k"), ratio.cast("float").alias("v")).alias("e"))
    packed = packed.groupBy("pack").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return materialize(packed.select("pack", F.expr(f"transform(sequence(0, {PACK - 1}), k -> m[k])").alias("ratios")))


def mean_ratios(docs: DataFrame, buckets: int, text_col: str = "text") -> DataFrame:
    """(_key, ratio, trusted) for each distinct text with words; _key is the hash of the text. Equal texts leave the mean as it is."""
    table = ratio_table(docs, buckets, text_col)
    keyed = words_and_grams(docs.withColumn("_key", F.xxhash64(text_col)), text_col, buckets).select("_key", "_t", "_g")  # the key once a text, not once a gram
    grams = keyed.select("_key", "_t", F.explode_outer("_g").alias("g")).where("g is not null")  # explode would filter on _g, and so compute it again for every element
    grams = grams.select("_key", "_t", F.expr(f"cast(g div {PACK} as int)").alias("pack"), (F.col("g") % PACK).alias("k"))
    table = F.broadcast(table) if buckets <= PACK * PACKED_ROWS else table.hint("shuffle_hash")
    return grams.join(table, "pack").groupBy("_key").agg(F.avg(F.get("ratios", F.col("k"))).alias("ratio"), F.max("_t").alias("trusted"))


def threshold(ratios: DataFrame) -> float:
    """DISTANCES quartile distances of the trusted texts' ratios below their lower quartile; 0 without trusted texts.
    The quartiles come from counts of ratios in steps of 0.001, so they are the same whatever the order of rows."""
    steps = ratios.where("trusted = 1").groupBy(F.floor(F.col("ratio") * 1000).alias("step")).count().orderBy("step").collect()  # ratios are logarithms: a few thousand steps
    total = sum(r["count"] for r in steps)
    if not total:
        return 0.0
    at, quartiles, seen = [total / 4, 3 * total / 4], [], 0
    for r in steps:
        seen += r["count"]
        while len(quartiles) < 2 and seen >= at[len(quartiles)]:
            quartiles.append(r.step / 1000)
    return quartiles[0] - DISTANCES * max(LEAST_DISTANCE, quartiles[1] - quartiles[0])


def judge_quality(docs: DataFrame, trusted: DataFrame, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio and kept.

    Null or blank text: no words, ratio 0, base_failed. base_failed: fewer than 50 words, or more than half of them
    in three-word windows that occur twice or more in the text. least: the threshold, else threshold() of this run; a
    ratio equal to it is kept. Without trusted rows the ratio comes from the smoothed uniform target. Repeated rows get
    equal results; an empty table stays empty. Texts of any length are read whole, by one task each. Columns of docs
    with the names of the result are replaced.
    """
    ratios = materialize(mean_ratios(with_trust(docs, trusted, text_col), bucket_count(docs, text_col), text_col))
    least = threshold(ratios) if least is None else least
    ratios = ratios.select("_key", F.col("ratio").alias("_ratio"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")
    t = f"coalesce(`{text_col}`, '')"
    d = words_of(docs.drop(*[n for n in names if n != text_col]), text_col).withColumn("_key", F.xxhash64(text_col))
    d = d.withColumn("n_words", F.expr("cast(size(_w) as long)")).withColumn("word_chars", F.expr("cast(length(array_join(_w, '')) as long)"))
    d = d.withColumn("n_symbols", F.expr(f"cast(regexp_count({t}, r'[#*$%&|<>]') as long)"))
    d = d.withColumn("_lines", F.expr(rf"filter(split({t}, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')")).withColumn("n_dup_lines", F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)"))
    # three-word windows: hash in the high bits, place in the low ones; after sorting, equal windows are neighbours
    d = d.withColumn("_p", F.expr("length(bin(size(_w)))"))
    d = d.withColumn("_s", F.expr("if(size(_w) < 4, array(), sort_array(slice(transform(_w, (x, i) -> shiftleft(xxhash64(x, get(_w, i + 1), get(_w, i + 2)), _p) | i), 1, size(_w) - 2)))"))
    same = "shiftrightunsigned(x, _p) = shiftrightunsigned(y, _p) and " + " and ".join(f"get(_w, cast(x & (shiftleft(1L, _p) - 1) as int) + {k}) = get(_w, cast(y & (shiftleft(1L, _p) - 1) as int) + {k})" for k in range(3))
    d = d.withColumn("_e", F.expr(f"if(size(_s) < 2, array(), zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (x, y) -> {same}))"))  # each is equal to the next
    d = d.withColumn("_at", F.expr("sort_array(transform(filter(_s, (x, i) -> coalesce(get(_e, i - 1), false) or coalesce(get(_e, i), false)), x -> cast(x & (shiftleft(1L, _p) - 1) as int)))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(_at, (x, i) -> least(3, coalesce(get(_at, i + 1) - x, 3))), 0L, (a, x) -> a + x)"))
    d = d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    d = d.drop("_w", "_lines", "_p", "_s", "_e", "_at").join(ratios.hint("merge"), "_key", "left").withColumn("ratio", F.coalesce("_ratio", F.lit(0.0)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least)).drop("_key", "_ratio")
