"""Operators on pairs against brute force: n-gram Jaccard join, embedding near-dedup, substring dedup."""

import random
import re

import numpy as np
import pyarrow as pa

from quillmark.llm import components, embed_dedup, ngram_join, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    name = {n: n for n in nodes}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        name[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(ids, links).items()}


def near_copies(r, n):
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, "one"), (5, "a b c d"), (6, "A b\tc  d"), (7, "a b c d e")]
    while len(rows) < n:
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 5, 6, 9, 14, 40, 70, 130, 300]))]
        if r.random() < 0.3:
            at = r.randrange(len(base))
            base[at:at] = passage
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            d = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
                at = r.randrange(len(d))
                if r.random() < 0.5:
                    d[at] = r.choice(vocabulary)
                else:
                    d[at : at + 1] = []
                if not d:
                    d = ["x"]
            rows.append((len(rows), " ".join(d)))
    return rows


def test_ngram_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0.01)
    rows = near_copies(random.Random(3), 700)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_ngram_join_with_a_large_group(spark):
    r = random.Random(5)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for k in range(400):
        d = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6])):
            d[r.randrange(len(d))] = f"n{r.randrange(10**6)}"
        rows.append((k, " ".join(d)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_components(rows)


def test_every_pair_within_the_bound_shares_a_signature():
    r = np.random.default_rng(2)
    hot = np.zeros(1 << 20, bool)
    for trial in range(1500):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop = int(r.integers(0, len(x) // 5 + 1))
        add = int(r.integers(0, len(x) // 5 + 1))
        y = np.unique(np.r_[x[r.permutation(len(x))[drop:]], r.integers(0, 2**63, add).astype(np.uint64)])
        common = len(np.intersect1d(x, y))
        if trial % 2:
            hot[:] = False
            hot[(x[: len(x) // int(r.integers(1, 4))] >> np.uint64(44)).astype(np.int64)] = True
        (gx, fx), (gy, fy) = (ngram_join.signatures(s, hot, frozenset()) for s in (x, y))
        if 5 * common >= 4 * (len(x) + len(y) - common) and not fx and not fy:
            assert len(np.intersect1d(gx, gy)), (n, drop, add)
        for f in (fx, fy):
            fine = frozenset(f)
            assert not ngram_join.signatures(x if f is fx else y, hot, fine)[1]
        h = len(x) + len(y) - 2 * common
        sx, sy = ngram_join.sketch(x), ngram_join.sketch(y)
        w = min(len(sx), len(sy))
        assert int(np.bitwise_count(ngram_join.fold(sx, w) ^ ngram_join.fold(sy, w)).sum()) <= h


def test_ngram_join_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_components(none).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(twice).collect()) == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 2, None)]


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, "other words all of them here", "s"), (4, None, "s"), (5, "", None), (None, "a b c d e f g", "s")]
    kept = ngram_join.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"]


def test_rows_of_one_id_are_told_apart(spark):
    t, u, long = "a b c d e f g", "quite other words in this text here", " ".join(f"l{k}" for k in range(30_000))
    rows = [(7, None, "x", 1), (7, u, "x", 1), (7, u, "a", 2), (8, u + " ", "x", 1), (1, t, None, 1), (9, t, "x", 1), (9, "nobody else says any of this", "x", 1), (5, "", "x", 1), (5, "", "x", 1), (10, long, "x", 1), (11, long + " end", "x", 1)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, node string, component_id int, k string")
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:8], r.node) for r in kept.collect()), key=repr)
    assert got == sorted([(7, "", "x"), (7, "quite ot", "a"), (1, "a b c d ", None), (9, "nobody e", "x"), (5, "", "x"), (5, "", "x"), (10, "l0 l1 l2", "x")], key=repr)
    assert ngram_join.keep_one_per_group(docs.limit(0)).collect() == []


def test_pairs_at_the_bound_of_sketches(spark, monkeypatch):
    """Many pairs just below and just above 0.8, in blocks and salts of a few rows: sketches allow pairs that are no links."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "SPREAD", 5)
    r, rows = random.Random(17), []
    base = [f"b{k}" for k in range(120)]
    for k in range(160):
        d = list(base)
        for at in r.sample(range(0, 120, 6), r.choice([1, 2, 2, 3])):
            d[at] = f"n{r.randrange(40)}"
        rows.append((k * 3 + 1, " ".join(d)))
    want = brute_components(rows)
    assert 20 < len({c for _, c in want.values()}) < 150
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_jaccard_components(df).collect()} == want


def test_spanning_forest():
    r = np.random.default_rng(3)
    for _ in range(200):
        n, m = int(r.integers(2, 30)), int(r.integers(1, 80))
        a, b, label = r.integers(0, n, m), r.integers(0, n, m), r.integers(0, n, n)
        label = np.unique(label, return_inverse=True)[1]
        got = ngram_join.spanning(a, b, r.permutation(m), label)
        start = [(-1 - int(label[k]), k) for k in range(n)]
        every = roots({x for p in start for x in p}, start + list(zip(a.tolist(), b.tolist())))
        few = roots({x for p in start for x in p}, start + [(int(a[e]), int(b[e])) for e in got])
        assert every == few and len(got) == len(set(label.tolist())) - len(set(every.values()))


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == roots({n for p in real for n in p}, real)


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((60, 64))
    rows = []
    for k in range(600):
        v = base[r.integers(60)] + r.choice([0.0, 0.05, 0.1, 0.13]) * r.standard_normal(64)
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3) if k % 11 else None))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 64, 1), (1003, [float("nan")] * 64, 1), (1004, [1.0, None] * 32, 1), (1005, [float("inf")] + [0.0] * 63, 1)]
    rows += [(1006 + k, rows[1][1], rows[1][2]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {x.vec_id: x for x in embed_dedup.embedding_components(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float64), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([c for _, _, c in good])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(good), dtype=bool)
    true, found = near.sum(axis=1), np.array([got[i].n_links for i, _, _ in good])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    want = roots([i for i, _, _ in good], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(near))])
    assert sum(got[i].component_id == c for i, c in want.items()) >= 0.9 * len(want)
    for i in range(1000, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_large_group_of_near_vectors(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal(64)
    rows = [(k, [float(x) for x in base + 0.02 * r.standard_normal(64)], 1) for k in range(1300)]
    got = embed_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert all(x.component_id == 0 for x in got) and sum(x.n_links for x in got) >= 0.99 * 1300 * 1299
    assert max(x.n_links for x in got) <= 1299
    assert embed_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_numbers_of_tables_follow_the_vectors():
    r = np.random.default_rng(1)
    for largest in (1, 200, 5000, 10**6):
        tables, values = embed_dedup.plan(largest)
        assert 1 - (1 - embed_dedup.NEAR_SHARE**values) ** tables >= 0.98 and largest * embed_dedup.FAR_SHARE**values <= 0.2 or largest < 2
    tables, values = embed_dedup.plan(5000)
    u = r.standard_normal((2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = r.standard_normal((2000, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    label = np.zeros(2000, np.int64)
    keys = [embed_dedup.table_keys(c * u + np.sqrt(1 - c * c) * w, label, tables, values) for c in (1.0, 0.98, 0.0)]
    assert np.mean((keys[0] == keys[1]).any(axis=1)) > 0.97 and np.mean(keys[0] == keys[2]) < 2 * embed_dedup.FAR_SHARE**values


def test_embeddings_at_the_bound_with_clashing_columns(spark):
    v, w = [0.981, 0.19, 0.0], [1.0, 0.0, 0.0]  # cosine a little above 0.98
    rows = [(1, v, 3, "x", 0), (2, w, 3, "x", 0), (2, w, 3, "x", 0), (None, w, 3, "x", 0), (4, [1.0, 0.0], 3, "x", 0), (5, [0.9799, 0.2, 0.0], 3, "x", 0), (6, [-x for x in w], 3, "x", 0)]
    got = embed_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string, rep int"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    near = lambda x, y: unit(x) @ unit(y) >= 0.98
    assert near(v, w) and not near(rows[5][1], w)
    by = {(x.vec_id, x.n_links, x.component_id) for x in got.collect()}
    assert {b[0]: b[2] for b in by}[4] == 4 and {b[0]: b[2] for b in by}[6] == 6 and {b[0]: b[2] for b in by}[2] in (1, 2) and (None, 0, None) in by


def plain_sentences(t):
    """Sentences by a walk over characters: cut after marks before white space or the end, after full-width marks, after line ends."""
    out, start, i = [], 0, 0
    while i < len(t):
        end = None
        if t[i] == "\n":
            end = i + 1
        elif t[i] in ".!?。！？":
            j = i
            while j < len(t) and t[j] in ".!?。！？":
                j += 1
            wide = [k for k in range(i, j) if t[k] in "。！？"]
            if wide:
                end = wide[-1] + 1
            elif j == len(t) or t[j].isspace():
                end = j
            else:
                i = j
                continue
        if end is None:
            i += 1
            continue
        while end < len(t) and t[end].isspace():
            end += 1
        if t[start:end].strip():
            out.append(t[start:end])
            start = end
        i = end
    if t[start:].strip() or start < len(t) and not out:
        out.append(t[start:])
    elif start < len(t):
        out[-1] += t[start:]
    return out


def brute_cut(rows):
    """By the rule itself: every shortest run from a start or back from an end, looked up by its words; later ones go."""
    least, texts = substring.MIN_WORDS, {i: plain_sentences(t) for i, t in rows}
    first, found = {}, {}
    for i in sorted(texts):
        s, size = texts[i], [len(x.split()) for x in texts[i]]
        runs = set()
        for a in range(len(s)):
            for e in range(a + 2, len(s) + 1):
                if sum(size[a:e]) >= least and (e - a == 2 or sum(size[a : e - 1]) < least or sum(size[a + 1 : e]) < least):
                    runs.add((a, e))
        found[i] = {(a, e): "\n".join(" ".join(x.lower().split()) for x in s[a:e]) for a, e in runs}
        for at in sorted(found[i]):
            first.setdefault(found[i][at], (i, at))
    out = {}
    for i, t in rows:
        gone = {k for (a, e), words in found[i].items() if first[words] != (i, (a, e)) for k in range(a, e)}
        out[i] = "".join(x for k, x in enumerate(texts[i]) if k not in gone) if gone else t
    return out


def test_sentences_against_a_walk():
    r = random.Random(14)
    for _ in range(5000):
        t = "".join(r.choice([*"ab .!?\n", "。", "！", "\t", " "]) for _ in range(r.randrange(16)))
        assert [t[a:b] for a, b in substring.sentences(t)] == plain_sentences(t), repr(t)


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(f"w{r.randrange(4000)}" for _ in range(r.randrange(1, 14))) + r.choice([".", "!", "?", ".\n"]) for _ in range(400)]
    passage = pool[:5]
    rows = []
    for k in range(150):
        s = [r.choice(pool[5:]) if r.random() < 0.3 else " ".join(f"u{r.randrange(10**6)}" for _ in range(8)) + "." for _ in range(r.randrange(0, 15))]
        if r.random() < 0.3:
            at = r.randrange(len(s) + 1)
            s[at:at] = passage
        rows.append((k, " ".join(s)))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int").repartition(3)
    got = substring.remove_repeated_spans(df)
    assert got.columns == ["doc_id", "text", "h", "cut"]
    assert {x.doc_id: x.cut.text for x in got.collect()} == brute_cut(rows)


def test_substring_dedup_odd_rows(spark):
    t = "This is the first sentence of some text here, and it goes on. And this is the second one of it, which ends now. "
    rows = [(1, t), (1, t), (2, t), (3, None), (4, ""), (5, "  "), (None, "short. x. y."), (6, t + t)]
    clash = spark.createDataFrame([(*x, "a", "b", 1) for x in rows], "doc_id long, text string, id string, tie string, _text int")
    assert substring.remove_repeated_spans(clash).columns == [*clash.columns, "cut"] and {(x.id, x.tie, x["_text"]) for x in substring.remove_repeated_spans(clash).collect()} == {("a", "b", 1)}
    long = " ".join(f"Sentence {k} of a very long text has its own words x{k}." for k in range(4000))
    kept = {x.doc_id: x.cut.text for x in substring.remove_repeated_spans(spark.createDataFrame([(1, long), (2, "Before. " + long)], "doc_id long, text string")).collect()}
    assert kept == {1: long, 2: "Before. "}
    got = substring.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.cut.text)
    assert by == {1: [t, t], 2: [""], 3: [None], 4: [""], 5: ["  "], None: ["short. x. y."], 6: [""]}
    assert substring.remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_substring_dedup_of_short_sentences(spark):
    r = random.Random(11)
    own = lambda n: " ".join(" ".join(f"u{r.randrange(10**9)}" for _ in range(6)) + "." for _ in range(n))
    passage = " ".join(f"a{k} b{k} c{k}." for k in range(20))  # 60 words
    words = " ".join(f"W{k}!!" for k in range(60))
    han = "".join("".join(chr(0x4E00 + r.randrange(20000)) for _ in range(7)) + "。" for _ in range(10))
    rows = [(k, f"{own(2)} {t} {own(2)}") for k, t in enumerate((passage, passage, words, words, han, han))]
    got = {x.doc_id: x.cut.text for x in substring.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, t in enumerate((passage, words, han)):
        assert got[2 * k] == rows[2 * k][1]
        assert got[2 * k + 1].split() == rows[2 * k + 1][1].replace(t, "").split()


def test_runs_cover_every_passage():
    r = random.Random(12)
    for _ in range(300):
        sizes = [r.choice([1, 1, 2, 3, 5, 12]) for _ in range(r.randrange(14))]
        runs = substring.runs_of(sizes)
        assert len(set(runs)) == len(runs) and all(n >= substring.RUN and n < substring.LENGTHS and sum(sizes[k : k + n]) >= substring.MIN_WORDS for k, n in runs)
        for a in range(len(sizes)):
            for b in range(a + substring.RUN, len(sizes) + 1):
                inside = {k + j for k, n in runs if a <= k and k + n <= b for j in range(n)}
                assert inside == (set(range(a, b)) if sum(sizes[a:b]) >= substring.MIN_WORDS else set())


def test_sentences_cover_the_text():
    for t in ("", "a", ". . .", "A b. C d!\n\nE", "  lead. x", "no end", "a.b.c d. ", "\n\n"):
        s = substring.sentences(t)
        assert "".join(t[a:b] for a, b in s) == t
    assert pa.array(["x"]).type == pa.string()
