"""Zone-weighted terms, class profiles by log-odds, and BM25 scores of every class for every document."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import passes
from quillmark.settings import DEFAULTS, Settings
from quillmark.tables import written

# fixed values: function words of English, Spanish, Portuguese and French
STOPWORDS = (
    "a an and or of the to in on for by with no not is are as at from de del la el los las un una y e o en por con para sobre su sus "
    "da do das dos um uma que se ao aos le les des du et au aux sur pour"
).split()


def skeleton_stopwords() -> list[str]:
    return sorted({w.translate(str.maketrans(T.CONFUSED, T.CONFUSED_TO)) for w in STOPWORDS})


def zone_weight(zone: Column, settings: Settings = DEFAULTS) -> Column:
    w = F.lit(settings.zone_weights["body"])
    for name, value in settings.zone_weights.items():
        w = F.when(zone == name, value).otherwise(w)
    return w


def block_tokens(blocks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, zone, weight, tokens): the skeleton tokens of each block."""
    return blocks.select("doc_id", "zone", zone_weight(F.col("zone"), settings).alias("weight"), T.skeleton_tokens(F.col("text")).alias("tokens"))


def capitals(text: Column) -> Column:
    """The skeletons of a text's tokens in capitals, as an array."""
    return F.transform(F.filter(T.tokens(text), lambda w: (w == F.upper(w)) & (w != F.lower(w))), lambda w: T.skeleton(T.fold(w)))


def caps_skeletons(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, token): skeletons of the tokens that a document prints in capitals somewhere, of at most so many characters."""
    words = blocks.select("doc_id", F.explode(F.array_distinct(capitals(F.col("text")))).alias("token"))
    return (words if most is None else words.where(F.length("token") <= most)).distinct()


LENGTH = ""  # stands for a document's weighted length among its terms; no token is empty


def weighted_terms(blocks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, term, kind, x): what each block adds to its document's terms. kind 0 always counts, 1 if the document prints
    the term in capitals somewhere, and 2 says that it does. Each block is tokenised once; no row moves."""
    short = lambda w: F.length(w) <= settings.caps_length
    b = blocks.select("doc_id", zone_weight(F.col("zone"), settings).alias("weight"), T.skeleton_tokens(F.col("text")).alias("w"), F.filter(capitals(F.col("text")), short).alias("caps"))
    row = lambda term, kind, n: F.struct(term.alias("term"), kind.alias("kind"), n.alias("n"))
    one, none = F.lit(1), F.lit(0)
    every = F.concat(
        F.transform("w", lambda w: row(w, F.when(short(w), one).otherwise(none), one)), F.transform(T.ngrams(F.col("w"), 2), lambda w: row(w, none, one)),
        F.transform(F.array_distinct("caps"), lambda w: row(w, F.lit(2), none)), F.array(row(F.lit(LENGTH), none, F.size("w"))),
    )
    return b.select("doc_id", "weight", F.explode(every).alias("e")).select("doc_id", "e.term", "e.kind", (F.col("weight") * F.col("e.n")).alias("x"))


def summed_terms(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """weighted_terms() -> (doc_id, term, tf); short unigrams stay only with a capital mark."""
    g = rows.groupBy("doc_id", "term").agg(F.sum(F.when(F.col("kind") < 2, F.col("x"))).alias("tf"), F.max("kind").alias("_kind"), F.min("kind").alias("_least"))
    return g.where((F.col("_least") == 0) | (F.col("_least") == 1) & (F.col("_kind") == 2)).select("doc_id", "term", "tf")


def document_terms(blocks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, term, tf): weighted counts of unigrams and of bigrams within a block. Unigrams of up to caps_length
    characters count only if the document prints them in capitals. One shuffle, after partial sums."""
    return summed_terms(weighted_terms(blocks, settings).where(F.col("term") != LENGTH), settings)


def document_lengths(blocks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, length): weighted number of unigrams, of documents that have any."""
    n = block_tokens(blocks, settings).groupBy("doc_id").agg(F.sum(F.col("weight") * F.size("tokens")).alias("length"))
    return n.where("length > 0")


def class_counts(labelled: DataFrame) -> DataFrame:
    """(class, text) -> (class, term, n): skeleton unigrams of more than one character that aren't function words, and
    bigrams with at least one content word at 0.75."""
    stop = skeleton_stopwords()
    t = labelled.select("class", T.skeleton_tokens(F.col("text")).alias("w"))
    content = lambda w: ~w.isin(*stop)
    one = F.transform(F.filter("w", lambda w: (F.length(w) > 1) & content(w)), lambda w: F.struct(w.alias("term"), F.lit(1.0).alias("n")))
    two = F.transform(F.filter(T.ngrams(F.col("w"), 2), lambda w: content(F.substring_index(w, " ", 1)) | content(F.substring_index(w, " ", -1))), lambda w: F.struct(w.alias("term"), F.lit(0.75).alias("n")))
    return t.select("class", F.explode(F.concat(one, two)).alias("x")).groupBy("class", F.col("x.term").alias("term")).agg(F.sum("x.n").alias("n"))


def profile_scores(settings: Settings = DEFAULTS) -> Column:
    """z of a term in a class from n, y_w (of the term), n_c (of the class) and total."""
    a0 = settings.prior_strength
    alpha, rest = F.lit(a0) * F.col("y_w") / F.col("total"), F.greatest(F.col("y_w") - F.col("n"), F.lit(0.0))
    inside, outside = F.col("n") + alpha, rest + alpha
    delta = F.ln(inside / F.greatest(F.col("n_c") + a0 - F.col("n") - alpha, F.lit(1e-9))) - F.ln(outside / F.greatest(F.col("total") - F.col("n_c") + a0 - rest - alpha, F.lit(1e-9)))
    return delta / F.sqrt(1 / inside + 1 / outside)


def log_odds_profiles(counts: DataFrame, settings: Settings = DEFAULTS, sizes: DataFrame | None = None) -> DataFrame:
    """(class, term, n) -> (class, term, z, weight): log-odds with an informative Dirichlet prior; the terms with the
    largest positive z of each class, with weights that sum to 1. Equal z go by term.

    The counts meet their totals in one pass: the classes of a term are one group of a shuffle by term; class and corpus
    totals are small aggregates of the same counts, whose shuffle is reused. sizes: (class, n_c), where counts lack terms
    that can't be in a profile."""
    per_class = counts.groupBy("class").agg(F.sum("n").alias("n_c")) if sizes is None else sizes
    total = per_class.agg(F.sum("n_c").alias("total"))
    j = counts.withColumn("y_w", F.sum("n").over(Window.partitionBy("term"))).join(F.broadcast(per_class.crossJoin(total)), "class")  # one row a class
    z = j.select("class", "term", profile_scores(settings).alias("z")).where("z > 0")
    top = z.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.round("z", 9).desc(), "term"))).where(F.col("k") <= settings.profile_terms)
    return top.select("class", "term", F.round("z", 4).alias("z"), F.round(F.col("z") / F.sum("z").over(Window.partitionBy("class")), 6).alias("weight"))


def most_z(least: dict, sizes: dict, settings: Settings = DEFAULTS) -> dict:
    """What z a term can have at most in each class whose n is below least in every class, sizes being the classes' n_c.

    With x = n + alpha and y = rest + alpha, z is at most ln(A / y) * sqrt(y), A = x * (total - n_c + a0) / (n_c + a0 - x), which
    is largest, 2 / e * sqrt(A), at y = A / e^2; and alpha is at most a0 / total of the sum of least."""
    total, a0 = sum(sizes.values()), settings.prior_strength
    alpha = a0 * min(1.0, sum(least.values()) / max(total, 1.0))
    x = {c: least[c] + alpha for c in sizes}
    return {c: 2 / math.e * math.sqrt(x[c] * max(total - n + a0, 1e-9) / (n + a0 - x[c])) if n + a0 > x[c] else math.inf for c, n in sizes.items()}


FEW_TERMS = 1_000_000  # so many are counted at once


def text_profiles(labelled: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """log_odds_profiles(class_counts(labelled)) of (class, text), as a written table, without a row for each term of the corpus.

    A first pass counts all terms by a hash. Terms of the heaviest buckets of a class are then counted exactly; most_z()
    says what z any other term can have. If that reaches a profile's last term, or a profile isn't full, more buckets are counted, at last
    all of them. The result is exact at every step."""
    stop = skeleton_stopwords()
    buckets = written(passes.bucket_counts(labelled, stop))
    per_class = written(buckets.groupBy("class").agg(F.sum("n").alias("n_c")))
    sizes = {r["class"]: r.n_c for r in per_class.collect()}  # one row a class
    for share in (0.98, 0.9, 0.0) if sum(sizes.values()) > FEW_TERMS else (0.0,):
        least = {r["class"]: r.least if share else 0.0 for r in buckets.groupBy("class").agg(F.percentile("n", F.lit(share)).alias("least"), F.count("*").alias("k")).collect()}
        bound = F.create_map(*[F.lit(x) for c, n in least.items() if c is not None for x in (c, n)]) if set(least) - {None} else None
        heavy = F.lit(True) if not share or bound is None else F.coalesce(F.col("n") >= bound[F.col("class")], F.col("n") >= F.lit(least.get(None, 0.0)))
        wanted = np.zeros(passes.BUCKETS, bool)
        wanted[[r.bucket for r in buckets.where(heavy).select("bucket").distinct().collect()]] = True  # at most BUCKETS rows
        out = written(log_odds_profiles(passes.counts_in_buckets(labelled, stop, wanted), settings, per_class))
        last = {r["class"]: (r.k, r.z) for r in out.groupBy("class").agg(F.count("*").alias("k"), F.min("z").alias("z")).collect()}
        limit = most_z(least, sizes, settings)
        if not share or all(last.get(c, (0, 0.0))[0] == settings.profile_terms and last[c][1] - 0.001 > limit[c] for c in sizes if c is not None):
            return out


def idf(profiles: DataFrame) -> DataFrame:
    """(term, df, idf) over the profiles of all classes."""
    n = profiles.select(F.count_distinct("class").alias("n_classes"))
    return profiles.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", F.ln(1 + (F.col("n_classes") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(blocks: DataFrame, profiles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, class, raw, explained, coverage) of every class for every document with tokens, zeros included.

    profiles are at most profile_terms rows a class, so they are broadcast. A block's terms meet them before any
    shuffle; what is left is shuffled once, by document, and its length goes along as a term of its own that every class
    has at weight 0: so documents without a hit come out with zeros. profiles is used more than once and should be a
    written table."""
    p = _weights(profiles)
    return _bm25(weighted_terms(blocks, settings).join(F.broadcast(p.select("term").distinct()), "term", "left_semi"), p, settings)


def text_bm25(docs: DataFrame, profiles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """bm25() of plain texts (doc_id, text), whose lines are all body blocks. profiles should be a written table."""
    terms = [r.term for r in profiles.select("term").distinct().collect()]  # at most profile_terms a class
    return _bm25(passes.known_terms(docs, terms, LENGTH, settings.caps_length), _weights(profiles), settings)


def _weights(profiles: DataFrame) -> DataFrame:
    p = profiles.join(idf(profiles), "term").select("class", "term", "weight", "idf")
    return p.unionByName(profiles.select("class").distinct().select("class", F.lit(LENGTH).alias("term"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("idf")))


def _bm25(rows: DataFrame, p: DataFrame, settings: Settings) -> DataFrame:
    terms = summed_terms(rows.repartition("doc_id"), settings).withColumn("length", F.max(F.when(F.col("term") == LENGTH, F.col("tf"))).over(Window.partitionBy("doc_id"))).where("length > 0")
    norm = settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("length") / settings.average_length)
    hit = terms.join(F.broadcast(p), "term").withColumn("sat", F.col("tf") / (F.col("tf") + norm))
    got = hit.groupBy("doc_id", "class").agg(F.sum(F.col("weight") * F.col("idf") * F.col("sat") * (settings.bm25_k1 + 1)).alias("raw"), F.sum(F.col("weight") * F.greatest("idf", F.lit(0.0)) * F.col("sat")).alias("shown"), F.sum("weight").alias("seen"))
    per_class = p.groupBy("class").agg(F.sum("weight").alias("mass"), F.sum(F.col("weight") * F.greatest("idf", F.lit(0.0))).alias("available"))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return got.join(F.broadcast(per_class), "class").select("doc_id", "class", F.round("raw", 6).alias("raw"), part(F.col("shown"), F.col("available")).alias("explained"), part(F.col("seen"), F.col("mass")).alias("coverage"))


def robust_z(scores: DataFrame, by: str = "doc_id", value: str = "raw") -> DataFrame:
    """Adds z: distance from the median in 1.4826 median absolute deviations; by the standard deviation where that is 0; else 0."""
    w = Window.partitionBy(by)
    s = scores.withColumn("_m", F.percentile(value, F.lit(0.5)).over(w)).withColumn("_sd", F.stddev_pop(value).over(w))
    s = s.withColumn("_mad", 1.4826 * F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).over(w))
    scale = F.when(F.col("_mad") >= 1e-9, F.col("_mad")).otherwise(F.col("_sd"))
    return s.withColumn("z", F.when(scale < 1e-9, 0.0).otherwise((F.col(value) - F.col("_m")) / scale)).drop("_m", "_sd", "_mad")


def softmax(scores: DataFrame, by: str = "doc_id", value: str = "z", settings: Settings = DEFAULTS) -> DataFrame:
    """Adds p: the temperature softmax over the rows of a document."""
    w = Window.partitionBy(by)
    e = F.exp((F.col(value) - F.max(value).over(w)) / settings.temperature)
    return scores.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")
