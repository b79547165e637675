"""The pipeline against its stages' rules, and the operators' SQL, on the smallest tables."""

import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import pii, queries, toxicity
from tests.llm.test_pairs import brute_components, roots, shingles
from tests.llm.test_texts import WORD, brute_spans, brute_targets, brute_terms

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = c.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "personal_data", "mixing", "packing"]
    kept = corpus_pipeline.drop_toxic(spark, docs, DIR).cache()
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() <= docs.count()  # a few dozen labels: it may find none
    one = corpus_pipeline.one_of_each_group(spark, kept, DIR).cache()
    groups = brute_components([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (n, c) in groups.items() if n == 0 or c == i)
    clean = corpus_pipeline.sanitise(spark, one, DIR).cache()
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(texts[r.doc_id]) and r.text != texts[r.doc_id]:
            assert len(r.text) < len(texts[r.doc_id])  # a disclosing term went
    mixed = corpus_pipeline.mix_sources(spark, clean, DIR).cache()
    assert mixed.columns == docs.columns
    n = lambda df: df.agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)")))).first()[0]
    assert math.isclose(n(mixed), n(clean), rel_tol=0.01)
    packed = corpus_pipeline.pack_sequences(spark, mixed, DIR).toPandas()
    rooms = packed.groupby("sequence_id").agg(n=("length", "sum"), room=("sequence_length", "first"))
    assert (rooms.n == rooms.room).all() and np.isin(packed.doc_id, [r.doc_id for r in mixed.collect()]).all()


def small_tables(spark, folder):
    """documents and labels with toxic texts, groups of copies, personal data, null, blank, repeated and long texts, odd ids."""
    r = random.Random(31)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs, labels = [], []
    for k in range(260):
        t = text(r.choice([5, 30, 90]))
        if k % 5 == 0:
            t = t.replace(" ", " vileness ", 1)
        elif k % 7 == 0:
            t += f" write to jo{k}@mail.example now"
        docs.append((k, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])))
        labels.append((k, 1, int(k % 5 == 0)))
    base = text(120)
    docs += [(1000 + k, base if k < 4 else base.replace(" ", f" n{k} ", 1), "en", "a") for k in range(9)]
    docs += [(2000 + k, f"ask the keeper zebrakim at kim@zoo.example or {text(12)}", "en", "b") for k in range(6)]
    docs += [(3000, None, "en", "a"), (3001, "", "en", None), (3002, " \n\t", None, "c"), (3003, text(30_000), "en", "c"), (3004, 'token = "908038b7daaf91e730d2f64001c52934d43d9336"', "en", "c")]
    docs += [(3005, "one id with two texts, this is the first of them", "en", "b"), (3005, "and here is another text that shares the number", "en", "b"), (3006, "repeated row of some words", "en", "b"), (3006, "repeated row of some words", "en", "b"), (3007, None, "en", "b"), (3007, None, "en", "b")]
    # columns of the stages' own names, with values of their own
    rows = [(i, t, lang, source, len(t) if t is not None else 0, "x", 7, 1.5, "y") for i, t, lang, source in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long, pii string, size int, score double, component_id string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_run_equals_a_plain_version(spark, tmp_path):
    rows = small_tables(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    # toxicity: each text scored alone
    m = toxicity.fit(docs, labels)
    score = lambda t: toxicity.score_texts(m, pa.array([t], pa.string()))[0]
    left = [x for x in rows if score(x[1]) < m.thresholds.get(x[2] or "", toxicity.DEFAULT_THRESHOLD)]
    assert 0.6 * len(rows) < len(left) < len(rows)
    # near-duplicates: groups of rows by their own texts
    sets = [shingles(x[1]) for x in left]
    links = [(a, b) for a in range(len(left)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = roots(range(len(left)), links)
    best = {}
    for k, x in enumerate(left):
        if sets[k] and (group[k] not in best or x[0] < left[best[group[k]]][0]):
            best[group[k]] = k
    left = [x for k, x in enumerate(left) if not sets[k] or best[group[k]] == k]
    assert sum(x[0] == 3005 for x in left) == 2 and sum(x[0] == 3006 for x in left) == 1 and sum(x[0] == 3007 for x in left) == 2 and sum(1000 <= x[0] < 1009 for x in left) == 1
    # personal data
    terms = frozenset(brute_terms([x[1] for x in left]))
    clean = []
    for x in left:
        base = brute_spans(x[1])
        extra = pii.all_spans(x[1], terms)[1]
        clean.append((x[0], pii.redact(x[1], base + extra) if x[1] is not None else None, x[3]))
    assert any("<SECRET>" in (t or "") for _, t, _ in clean) and any("<EMAIL>" in (t or "") for _, t, _ in clean) and not any("@" in (t or "") for _, t, _ in clean)
    # mixing: the words that each source gives are its target, to the word
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in clean:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    per_doc = {}
    for p in packed:
        per_doc.setdefault(p.doc_id, []).append(p)
    taken = dict.fromkeys(sizes, 0)
    for i, pieces in per_doc.items():
        ours = [(t, s) for k, t, s in clean if k == i]
        # every text of this id, whole and cut after each of its words
        known = {}
        for t, s in ours:
            ends = [w.end() for w in WORD.finditer(t or "")]
            for n, e in enumerate(ends, 1):
                if n == len(ends) or len(ends) < 2000:
                    cut = (t or "") if n == len(ends) else t[:e]
                    known.setdefault(len(ids(cut)), []).append((n, s, ids(cut)))
        for doc_tokens in {p.doc_tokens for p in pieces}:
            mine = [p for p in pieces if p.doc_tokens == doc_tokens]
            fits = [(n, s, x) for n, s, x in known.get(doc_tokens, []) if all(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in mine)]
            copies = sum(p.length for p in mine) / doc_tokens
            assert copies == int(copies)
            if fits:
                taken[fits[0][1]] += fits[0][0] * int(copies)
            else:
                assert i == 3003  # the long text, cut somewhere
                taken["c"] += sum(p.length for p in mine) - int(copies)
    for s, w in want.items():
        if s != "c":
            assert abs(taken[s] - w) <= 1, (s, taken[s], w)
    rooms = {}
    for p in packed:
        rooms.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_length))
    for parts in rooms.values():
        at = 0
        for offset, n, room in sorted(parts):
            assert offset == at
            at += n
        assert at == room <= 4096
    assert not any(i in per_doc for i in (3000, 3001, 3002, 3007))  # nothing to take


def test_stages_keep_the_columns_and_run_on_nothing(spark, tmp_path):
    small_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {(x.pii, x["size"], x.score, x.component_id) for x in out.select("pii", "size", "score", "component_id").distinct().collect()} == {("x", 7, 1.5, "y")}, name
    none = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []
