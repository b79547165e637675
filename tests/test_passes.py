"""Passes over whole texts give what the expressions on blocks and tokens give, and no row for each term of a corpus."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import anchors as A
from quillmark.operators import layout, lexical, passes
from quillmark.plans import catalog
from quillmark.plans import registry as R
from quillmark.tables import local_rows, written

ODD = [
    "Straße und GROẞE Straße\r\nthe ΟΔΟΣ. ΟΔΥΣΣΕΥΣ'Α of the", "été and ÉTÉ ção of the und", "“MIT” licensed – under the “MIT”", "mit M1T m1T lic­ensed", None, "", "  \t\n", "...\n---", "“…”",
    "привет и ПРИВЕТ the Œuvre de la mer DE LA", "a b\x0bc\x0cd\x85e\x1cf of\nthe of  the", "ª º ² ½ µ ÿ Ÿ licènsed ünder the QUÊ de lós İstanbul ŉ ﬁn 𝔘nd ١٢", "AND And and UND und ET et 101 LOL lol ción CIÓN",
]
WORDS = "the of and und nicht que de la les licensed under MIT AND ção Ação straße STRASSE œuvre ΟΔΟΣ привет 10 o1l lo1 x É quê àñd".split()


def texts():
    rng = random.Random(3)
    gaps = [" ", "\n", "\r\n", ", ", " – ", " ", "\x85", ".\t"]
    return ODD + ["".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"))


def rows(df, *names):
    return sorted(map(repr, df.select(*names).collect()))


def test_known_terms_are_the_weighted_terms(spark, docs):
    blocks = layout.text_blocks(docs)
    terms = [r.term for r in lexical.document_terms(blocks).select("term").distinct().collect()][::2]
    want = lexical.weighted_terms(blocks).where(F.col("term").isin([*terms, lexical.LENGTH]))
    got = passes.known_terms(docs, terms, lexical.LENGTH, 3)
    total = lambda x: lexical.summed_terms(x).where("term != '' or tf > 0")
    assert rows(total(got), "doc_id", "term", "tf") == rows(total(want), "doc_id", "term", "tf")


def test_phrases_give_the_hits_of_the_texts(spark, docs):
    blocks, a, n = layout.text_blocks(docs), R.anchors(spark), R.negatives(spark)
    z, whole = written(A.plain_zone_phrases(docs, a, n)), A.plain_zone_texts(docs)
    got, want = A.anchor_hits(blocks, a, zones=z), A.anchor_hits(blocks, a, zones=whole)
    assert rows(got, *want.columns) == rows(want, *want.columns) and want.where("match = 'skeleton'").count() and want.where("doctype_id = 'licensed' and ord = 3").count()
    assert rows(A.negative_hits(blocks, n, z), "doc_id", "doctype_id", "ord") == rows(A.negative_hits(blocks, n, whole), "doc_id", "doctype_id", "ord")
    assert rows(z.where("skeleton != '  '"), "doc_id", "zone") == rows(whole.where("skeleton != '  '"), "doc_id", "zone")


def test_profiles_of_few_buckets_are_exact(spark, docs, monkeypatch):
    rng, vocabulary = random.Random(5), [f"w{k}" for k in range(400)]
    prose = [(c, " ".join(rng.choices(vocabulary, [1 / (1 + (k * s) % 397) for k in range(400)], k=300))) for c, s in (("a", 1), ("b", 3), (None, 7)) for _ in range(120)]
    labelled = spark.createDataFrame(prose + [(("a", "b")[k % 2], t) for k, t in enumerate(texts())], "class string, text string")
    want = lexical.log_odds_profiles(lexical.class_counts(labelled))
    asked, counted = [], passes.counts_in_buckets
    monkeypatch.setattr(passes, "counts_in_buckets", lambda x, stop, wanted: asked.append(int(wanted.sum())) or counted(x, stop, wanted))
    monkeypatch.setattr(lexical, "FEW_TERMS", 0)
    assert rows(lexical.text_profiles(labelled), *want.columns) == rows(want, *want.columns)
    assert asked == sorted(asked) and asked[0] < passes.BUCKETS // 4


def test_no_other_term_has_a_larger_z(spark):
    rng = random.Random(8)
    sizes = {"a": 3000.0, "b": 500.0, "c": 1.0}
    least = {"a": 40.0, "b": 9.0, "c": 0.5}
    limit, most = lexical.most_z(least, sizes), {}
    cases = []
    for _ in range(2000):
        n = {c: rng.random() ** 3 * least[c] for c in sizes}
        cases += [(c, n[c], sum(n.values()), sizes[c], sum(sizes.values())) for c in sizes if n[c]]
    for r in local_rows(spark, cases, "class string, n double, y_w double, n_c double, total double").select("class", lexical.profile_scores().alias("z")).collect():
        most[r["class"]] = max(most.get(r["class"], 0.0), r.z)
    assert all(most[c] <= limit[c] for c in sizes) and max(limit.values()) < 100


def test_verdicts_make_no_row_for_each_term(spark):
    df = catalog.verdict_gates(spark, "/root/testdata/sf0.001")
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 200
