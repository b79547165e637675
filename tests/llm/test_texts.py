"""Packing, chat formatting, quality, personal data, mixing, URL filters, toxicity and the pipeline."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import chat, mixing, packing, pii, quality, toxicity, url_filter
from quillmark.llm.queries import RULES, tokenizer
from quillmark.llm.words import stretches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  ", "a", "Ünï çode ﬁ ½ <|endoftext|> it's", "\x1c\x85 x", "x" * 5000]


def words_table(r, n):
    v = [f"w{k}" for k in range(200)]
    return [(k, " ".join(r.choice(v) for _ in range(r.choice([0, 3, 40, 400])))) for k in range(n)]


def test_words_of_columns():
    r = random.Random(1)
    texts = [*ODD, *("".join(r.choice("aB é\n\t") for _ in range(r.randrange(30))) for _ in range(500))]
    got = [h[a:b].tolist() for s in stretches(pa.array(texts)) for h in [s.hashes()] for a, b in zip(s.first[:-1], s.first[1:])]
    one, back = {}, {}
    assert len(got) == len(texts)
    for t, hashes in zip(texts, got):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        assert len(w) == len(hashes)
        for a, b in zip(w, hashes):
            assert one.setdefault(a, b) == b and back.setdefault(b, a) == a


def test_piece_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, ours, r = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), packing.PieceIds(tokenizer("word_bpe_49k.json")), random.Random(3)
    parts = [*"abzA'ÉéßñÑİıſḰ  \x85\x1c\x0b.,!?-_0129½²<>|\xa0\xad", "<|endoftext|>", "'s", "'LL", "中", "ﬁ", "ª", "º", "µ", "ÿ", "Ÿ", "×", "Σς"]
    for text in [*ODD[1:], *("".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(5000))]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = [*enumerate(ODD), *((k + 100, x) for k, x in words_table(random.Random(2), 150)), (7, "a"), (None, "b c")]
    rows.append((500, "long " * 9000))
    got = packing.pack(spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, length int").repartition(3), tokenizer("word_bpe_49k.json")).collect()
    ids = {}
    for i, x in rows:
        ids.setdefault(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4"))
    docs, seqs = {}, {}
    for p in got:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        docs.setdefault(p.doc_id, []).append((p.start, p.length))
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length, p.sequence_length))
    for i, pieces in docs.items():
        if i == 7:
            pieces = sorted(pieces)[::2]
        assert sum(n for _, n in pieces) == len(ids[i]) and len({s for s, _ in pieces}) == len(pieces)
    for pieces in seqs.values():
        at = 0
        for offset, n, room in sorted(pieces):
            assert offset == at and room <= 4096
            at += n
        assert at == room and (room == 4096 or room & (room - 1) == 0)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer("word_bpe_49k.json")).collect() == []


def test_packing_balances_cost():
    r = random.Random(4)
    lengths = [r.choice([5, 50, 300, 900, 5000]) for _ in range(900)]
    cost = {}
    for _, _, n, s, _ in packing.pack_window(lengths):
        cost[s] = cost.get(s, 0) + n + n * n / 4096
    full = [c for s, c in cost.items() if c < 8192]
    assert np.std(full) / np.mean(full) < 0.4


def brute_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(), sum(len(b) for a, b in t if a == "assistant"), hashlib.sha256("".join(b for a, b in t if a == "assistant").encode()).hexdigest()) for c, t in out.items()}


def test_chat_round_trip(spark):
    r, parts = random.Random(6), ["a ", "é", "\n", " ", *chat.CONTROLS, *chat.OTHER_CONTROLS, ".", "中文", "🙂", "  x"]
    rows = [(r.randrange(60), k % 7, r.choice(["user", "assistant", "system", None]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randrange(12)))])) for k in range(600)]
    rows += [(None, 0, "user", "x"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer("byte_bpe_50k.json")).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == brute_chat(rows)
    for x in got:
        assert not any(c in x.formatted for c in chat.OTHER_CONTROLS) and len(x.ids) == len(x.loss_mask) and x.formatted_chars == len(x.formatted)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), tokenizer("byte_bpe_50k.json")).collect() == []


def test_the_digest_follows_the_mask():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    turns = [("user", "what ⟪ is it?"), ("assistant", "\n é🙂 it is </s> this ⟭ answer, all of it"), ("user", "ok"), ("assistant", ""), ("assistant", "…and more")]
    rendered, spans = chat.render(turns)
    offsets = np.array(tok.encode(rendered, add_special_tokens=False).offsets, np.int64)
    mask = chat.mask_tokens(offsets, spans)
    read = lambda m: [chat.unescape(x) for x in chat.masked_text(rendered, offsets, m, spans)]
    assert read(mask) == [t for r, t in turns if r == "assistant" and t]
    whole = "".join(read(mask))
    at = np.flatnonzero(mask)
    for k in (at[0], at[len(at) // 2], at[-1]):  # a hole
        less = mask.copy()
        less[[j for j in at if offsets[j][0] < offsets[k][1] and offsets[j][1] > offsets[k][0]]] = False
        assert len("".join(read(less))) < len(whole)
    for k in (0, int(np.flatnonzero(~mask)[3]), len(mask) - 1):  # a stray token
        more = mask.copy()
        more[k] = True
        assert mask[k] or len("".join(read(more))) > len(whole)
    assert read(np.zeros(len(mask), bool)) == [] and len(chat.masked_text(rendered, offsets, np.ones(len(mask), bool), [])) == 1


def test_chat_with_clashing_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "hi", "x", 5), (1, 1, "assistant", "word " * 60_000, "y", 6), (2, 0, "assistant", "same", "x", 1), (2, 0, "assistant", "same", "x", 1)]
    got = {x.conv_id: x for x in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string, n_turns int"), tokenizer("byte_bpe_50k.json")).collect()}
    assert got[1].loss_chars == 300_000 and got[2].n_turns == 2 and got[2].loss_chars == 8


def brute_quality(t):
    w = WORD.findall(t or "")
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    repeat = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    base = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), base)


def brute_ratios(rows, trusted, buckets, bucket_of):
    """Mean log-likelihood ratios by a separate count of words and pairs of words, and the threshold that trusted texts set."""
    grams = {}
    for k, (i, t) in enumerate(rows):
        w = [x.lower() for x in WORD.findall(t or "")]
        grams[k] = [bucket_of[x] for x in [*w, *zip(w, w[1:])]]
    raw, target = np.ones(buckets), np.ones(buckets)
    for k, (i, _) in enumerate(rows):
        np.add.at(raw, grams[k], 1)
        if i in trusted:
            np.add.at(target, grams[k], 1)
    table = np.log(target / target.sum()) - np.log(raw / raw.sum())
    ratio = {k: float(np.mean(table[g])) if g else 0.0 for k, g in grams.items()}
    texts = {t: ratio[k] for k, (i, t) in enumerate(rows) if i in trusted and grams[k]}
    steps = sorted(math.floor(v * 1000) / 1000 for v in texts.values())
    low, high = (steps[math.ceil(len(steps) * q) - 1] for q in (0.25, 0.75))
    return ratio, low - quality.DISTANCES * max(quality.LEAST_DISTANCE, high - low)


def hashed_grams(spark, rows, buckets):
    """The bucket of every word and pair of words of rows, hashed one by one."""
    seen = set()
    for _, t in rows:
        w = [x.lower() for x in WORD.findall(t or "")]
        seen.update((x, None) for x in w)
        seen.update(zip(w, w[1:]))
    df = spark.createDataFrame([(a, b) for a, b in seen], "a string, b string")
    got = df.select("a", "b", F.expr(f"pmod(if(b is null, xxhash64(a), xxhash64(a, b)), {buckets})").alias("g")).collect()
    return {(x.a if x.b is None else (x.a, x.b)): x.g for x in got}


def test_quality_against_brute_force(spark):
    r = random.Random(7)
    rows = [*enumerate(ODD), (7, "a b c a b c"), (8, "a a a a"), (9, "x\ny\nx\n\n \n\tx"), (10, "one # two ** <|> &"), (11, "\u2028a\u2028 b\xa0c")]
    rows += [(20 + k, "\n".join(" ".join(f"q{r.randrange(r.choice([3, 30, 900]))}" for _ in range(r.choice([1, 5, 60]))) for _ in range(r.randrange(1, 6)))) for k in range(150)]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_words int, ratio string").repartition(3)
    trusted = {i for i, _ in rows if i % 2}
    got = quality.judge_quality(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    assert got.columns[:2] == ["doc_id", "text"] and len(set(got.columns)) == len(got.columns)
    want, least = brute_ratios(rows, trusted, quality.BUCKETS, hashed_grams(spark, rows, quality.BUCKETS))
    want = {i: want[k] for k, (i, _) in enumerate(rows)}
    for x in got.collect():
        t = dict(rows)[x.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_quality(t), t
        assert math.isclose(x.ratio, want[x.doc_id], abs_tol=1e-6)
        if abs(x.ratio - least) > 1e-6:
            assert x.kept == (not x.base_failed and x.ratio >= least)
    assert quality.judge_quality(df.limit(0), spark.createDataFrame([], "doc_id long")).collect() == []


def test_quality_threshold_and_ties(spark):
    rows = [(k, " ".join(f"z{(k * 7 + j) % 90}" for j in range(60))) for k in range(40)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = quality.judge_quality(df, spark.createDataFrame([], "doc_id long"), least=0.5).collect()
    ratio = {x.doc_id: x.ratio for x in got}
    assert len(got) == 43 and not any(x.kept for x in got if x.ratio < 0.5)
    at = quality.judge_quality(df, spark.createDataFrame([], "doc_id long"), least=ratio[5]).collect()
    assert next(x for x in at if x.doc_id == 5).kept  # a ratio equal to the threshold
    junk = [(1000 + k, " ".join(f"j{(k * 13 + j) % 97}" for j in range(60))) for k in range(10)]
    both = spark.createDataFrame(rows + junk, "doc_id long, text string")
    kept = {x.doc_id: x.kept for x in quality.judge_quality(both, spark.createDataFrame([(k,) for k in range(40)], "doc_id long")).collect()}
    assert all(kept[k] for k, _ in rows) and not any(kept[k] for k, _ in junk)


def test_quality_gathers_with_the_corpus(spark, monkeypatch):
    every = spark.range(200_100).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id") % 50).alias("text"))
    assert quality.judge_quality(every, every.select("doc_id")).where("abs(ratio) > 1e-9").count() == 0  # all trusted rows are counted
    r = random.Random(10)
    rows = [(k, " ".join(f"q{r.randrange(900)}" for _ in range(r.choice([0, 1, 70, 200])))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = sum(len(t) for _, t in rows)
    assert quality.bucket_count(df) == quality.BUCKETS
    monkeypatch.setattr(quality, "AT_CHARS", n // 4)
    buckets = quality.bucket_count(df)
    assert buckets % quality.PACK == 0 and abs(buckets / (quality.AT_BUCKETS * 4**quality.GROWTH) - 1) < 0.01
    want, _ = brute_ratios(rows, {i for i, _ in rows if i % 2}, buckets, hashed_grams(spark, rows, buckets))
    for rows_of_table in (quality.PACKED_ROWS, 0):  # broadcast and shuffled
        monkeypatch.setattr(quality, "PACKED_ROWS", rows_of_table)
        got = quality.judge_quality(df, df.where("doc_id % 2 = 1").select("doc_id")).collect()
        assert len(got) == len(rows) and all(math.isclose(x.ratio, want[x.doc_id], abs_tol=1e-6) for x in got)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and sum((int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10))) for k, c in enumerate(reversed(d))) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_against_the_patterns():
    r, parts = random.Random(8), [*"ab.@-+ 01259()\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "255", "٣"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_personal_data_and_disclosing_terms(spark):
    rows = [(k, f"number {k} of many words, please ask zebrafish keeper jo@zoo.example for more {k * 7}") for k in range(20)] + [(100 + k, f"please ask many words for more number {k}") for k in range(300)]
    rows += [(900, None), (901, ""), (902, "the zebrafish swims")]
    got = {x.doc_id: x.pii for x in pii.find_personal_data(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pii int")).collect()}
    assert got[3].n_email == 1 and "<EMAIL>" in got[3].redacted and "zebrafish" not in got[3].redacted and "please" in got[3].redacted
    assert got[902].spans == "term:4:13" and got[902].redacted == "the  swims"
    assert (got[900].redacted, got[900].spans, got[901].redacted) == (None, "", "") and got[105].spans == ""
    assert pii.redact("abcdef", [("email", 1, 3), ("ip", 2, 4)]) == "a<EMAIL>ef"
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_terms(texts):
    """The disclosing terms by plain counts over distinct texts."""
    texts = sorted({t for t in texts if t})
    n = len(texts) + 0
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)} for t in texts}
    holds = {t: {(k, t[a:b]) for k, a, b in brute_spans(t)} for t in texts}
    out = {}
    for e in set().union(*holds.values()):
        with_e = [t for t in texts if e in holds[t]]
        for w in set().union(*(words[t] for t in with_e)):
            both, n_t = sum(w in words[t] for t in with_e), sum(w in words[t] for t in texts)
            p, z = both / n_t, 1.96
            low = (p + z * z / (2 * n_t) - z * math.sqrt(p * (1 - p) / n_t + z * z / (4 * n_t * n_t))) / (1 + z * z / n_t)
            bits = math.log2(p / (len(with_e) / n))
            if low >= 0.5 and bits >= 3:
                out[w] = max(bits, out.get(w, 0))
    return out


def test_disclosing_terms_against_brute_force(spark, monkeypatch):
    r = random.Random(21)
    people = [("kim", "kim@a.example"), ("li", "+1 555 010 99 00"), ("averyverylongfamilyname" * 20, "10.1.2.3"), ("bo", "bo@b.example")]
    filler = [f"{a}{b}" for a in "abcdefgh" for b in ("lor", "mip", "tas")]
    texts = []
    for k in range(260):
        w = [r.choice(filler) for _ in range(r.choice([4, 30]))]
        if k % 6 == 0:
            name, e = people[k // 6 % 4]
            w.insert(0, e)
            if r.random() < 0.9:
                w.insert(r.randrange(len(w)), name.title())
        elif k % 31 == 0:
            w.append(r.choice(people)[0])
        texts.append(" ".join(w))
    texts += texts[:40]  # copies count once
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, term string, _h string").repartition(3)
    want = brute_terms(texts)
    assert {"kim", "li"} <= set(want)
    for bound in (pii.BROADCAST_ROWS, 0):  # sets, and joins
        monkeypatch.setattr(pii, "BROADCAST_ROWS", bound)
        got = {x.term: x.bits for x in pii.sensitive_terms(df).collect()}
        assert set(got) == set(want) and all(math.isclose(got[w], want[w]) for w in want)
        rows = pii.find_personal_data(df)
        assert rows.columns == [*df.columns, "pii"] and rows.count() == len(texts)
        for x in rows.collect():
            terms = {x.text[int(a) : int(b)].lower() for k, a, b in (y.split(":") for y in x.pii.spans.split(",") if y) if k == "term"}
            assert terms == {w.lower() for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\S+@\S+", "", x.text))} & set(want)


def test_secrets():
    key = "908038b7daaf91e730d2f64001c52934d43d9336"
    assert pii.all_spans(f'a token = "{key}" here', frozenset())[1] == [("secret", 11, 51)]
    for t in ("a" * 60 + "1234", "averyveryverylongordinaryword", "2024-01-02-2024-01-02-2024", "x" * 19 + "1", "1" * 50):
        assert pii.all_spans(t, frozenset())[1] == [], t
    assert pii.redact(f"k={key}!", [("secret", 2, 42)]) == "k=<SECRET>!"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = set(s for s in names if sizes[s] == 0), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        new = {s for s in free if w[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= new


def test_mixing(spark):
    r = random.Random(9)
    rows = [(k, " ".join("w" for _ in range(r.choice([0, 1, 5, 50, 300]))), r.choice(["a", "b", "c", "d", None, "é", "big", "big", "big"])) for k in range(500)] + [(1000, None, "tiny"), (1001, "x y", "tiny2"), (3, "w w", "a"), (3, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_documents(df, mixing.word_count(F.col("text"))).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), {}
    assert len(got) == len(rows)
    for x in got:
        assert math.isclose(x.target, want[x.source], rel_tol=1e-9) and x.source_size == sizes[x.source] and 0 <= x.taken <= 3 * x.size
        assert len(x.positions) == x.passes * (x.size > 0) + (x.part > 0) and x.positions == sorted(x.positions) and all(0 <= p <= 1 for p in x.positions)
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.mix_documents(df.repartition(2), mixing.word_count(F.col("text"))).collect()
    assert sorted((x.doc_id, x.taken, x.positions) for x in again) == sorted((x.doc_id, x.taken, x.positions) for x in got)
    c = mixing.curriculum(df.withColumn("n_chars", F.length("text"))).collect()
    words = {}
    for x in c:
        words[x.source] = words.get(x.source, 0) + len(WORD.findall(x.text))
    assert all(words.get(s, 0) == round(want[s]) for s in sizes)
    assert mixing.curriculum(df.limit(0)).collect() == []


def test_mixing_with_clashing_columns_and_long_texts(spark):
    rows = [(k, "w " * (k % 5 * 20), "ab"[k % 2]) for k in range(60)] + [(None, "w w", "a"), (None, "w w", "a"), (99, "w " * 40_000, "b"), (98, None, None)]
    df = spark.createDataFrame([(*x, "own", 1.5, "p", 7) for x in rows], "doc_id long, text string, source string, size string, target double, part string, row int")
    plain = {(x.doc_id, x.taken) for x in mixing.mix_documents(df.select("doc_id", "text", "source"), mixing.word_count(F.col("text"))).collect()}
    assert {(x.doc_id, x.taken) for x in mixing.mix_documents(df, mixing.word_count(F.col("text"))).collect()} == plain
    c = mixing.curriculum(df)
    assert c.columns == df.columns and {(x["size"], x.target, x.part, x["row"]) for x in c.collect()} == {("own", 1.5, "p", 7)}
    assert sum(len(WORD.findall(x.text)) for x in c.collect()) == sum(t for _, t in plain) + sum(t for i, t in plain if i is None) * (len([1 for x in rows if x[0] is None]) - len([1 for i, _ in plain if i is None]))


def test_curriculum_follows_its_schedule():
    t = np.linspace(0, 1, 11)
    for a in mixing.RAMPS:
        u = t + a * (t * t - t)
        b = 1 - a
        assert np.allclose(2 * u / (b + np.sqrt(b * b + 4 * a * u)), t)


def test_url_filters(spark):
    rows = [(1, "http://WWW.A.org/x?y", None), (2, "https://example.org/es/1", ""), (3, "https://b.example.org/en/12", ""), (4, "http://c.com/de/1", "<a href='http://bad.net/'>"), (5, "http://bad.net", "<a HREF=//c.com/de>"), (6, None, None), (7, "nohost", ""), (8, "://", ""), (9, "http://notexample.orgx/", ""), (10, "http://q.net/", '<a href="https://a.org/z">'), (11, "http://r.net/#", '<a href="http://bad.net">'), (12, "x://d.com/fr/", ""), (13, "http://example.org", "")]
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert got[1] == ("www.a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("example.org/en/1", "block") and got[4][2:] == ("com/de/", "block")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9][2:] == (None, "allow") and got[12][2:] == ("com/fr/", "allow") and got[13] == ("example.org", "", None, "block")  # its host has a blocked page and no allowed one
    assert got[5] == ("bad.net", "", None, "block") and got[11][3] == "block" and got[10][3] == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []


def test_propagation_equals_power_iteration(spark):
    r = random.Random(5)
    links = {(f"h{r.randrange(12)}", f"h{r.randrange(12)}"): r.randrange(1, 4) for _ in range(40)}
    links = {k: n for k, n in links.items() if k[0] != k[1]}
    seeds = {"h0": 0.5, "h3": 0.25}
    score = dict(seeds)
    for _ in range(200):
        new = {h: s * (1 - url_filter.DAMPING) for h, s in seeds.items()}
        for (a, b), n in links.items():
            out = sum(m for (x, _), m in links.items() if x == a)
            new[b] = new.get(b, 0) + url_filter.DAMPING * score.get(a, 0) * n / out
        score = new
    got = url_filter.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed double"), spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "from string, to string, n long"), "from", "to")
    assert all(math.isclose(score.get(x.host, 0), x.score, abs_tol=1e-5) for x in got.collect())


def test_url_filters_clashes_chains_and_ties(spark):
    chain = [(k, f"http://c{k}.net/", f'<a href="http://c{k + 1}.net/">', "h", "r") for k in range(1, 30)] + [(30, "http://c30.net/", '<a href="//x.com/de/">', "h", "r"), (31, "http://x.com/de/1", None, "h", "r")]
    rows = [*chain, (31, "http://x.com/de/1", None, "h", "r"), (None, None, None, None, None), (50, "http://" + "l" * 100_000 + ".org/x", "y" * 100_000, "h", "r"), (51, "http://both.org/1", None, "h", "r"), (52, "http://sub.both.org/", None, "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = url_filter.judge_urls(df, RULES)
    assert sorted(got.columns) == sorted({*df.columns, "host", "path", "rule", "verdict", "trust", "distrust"}) and got.count() == len(rows)
    by = {x.page_id: x for x in got.collect()}
    assert by[1].verdict == "block" and by[30].verdict == "block" and by[31].rule == "com/de/"  # distrust runs back along 30 links
    assert by[None].verdict == "allow" and by[50].rule == "org/" and len(by[50].host) == 100_004
    assert url_filter.matching_rule is not None and by[52].rule == "org/"


def toxic_rows(r, n):
    rows, labels = [], []
    for k in range(n):
        w = [f"w{r.randrange(400)}" for _ in range(r.choice([5, 30, 120]))]
        bad = k % 5 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["Vile!", "vile,", "foulness", "foulest"])
        rows.append((k, " ".join(w), "en" if k % 3 else "de"))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(random.Random(3), 900)
    docs = spark.createDataFrame([*rows, (5000, None, None), (5001, "", "en"), (None, "vile", "xx")], "doc_id long, text string, lang string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [x for x in got if x.doc_id in truth and x.held]
    assert all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None) and len(held) > 150
    assert np.mean([(x.score >= 0.3) == bool(truth[x.doc_id]) for x in held]) > 0.95
    blank = [x.score for x in got if x.doc_id in (5000, 5001)]
    assert len(got) == len(rows) + 3 and blank[0] == blank[1] and all(0 <= x.score <= 1 for x in got)
    none = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("toxic or score != 0").count() == 0 and none.count() == len(rows) + 3


def naive_score(m, text):
    """The score by plain loops over words, windows and filters."""
    rows = [f for f, _ in toxicity.features_of(pa.array([text], pa.string()))]
    words = [m.embed[list(x)].sum(axis=0) for f in rows for x in f] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    z = m.out_bias
    for q, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(words[k + j] @ m.filters[w][j][:, f]) for j in range(w)) for k in range(len(words) - w + 1))
            z += m.out[q * toxicity.FILTERS + f] * max(0.0, best + m.bias[w][f])
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_scores_equal_a_naive_convolution():
    rows, labels = toxic_rows(random.Random(6), 200)
    m = toxicity.train([t for _, t, _ in rows], np.array([y for _, y in labels]), epochs=2)
    texts = [None, "", " ", "vile", "... !", "w1 foulness w2", *[t for _, t, _ in rows[:25]], " ".join(f"w{k % 700}" for k in range(40_000)) + " foulest"]
    assert np.allclose(toxicity.score_texts(m, pa.array(texts, pa.string())), [naive_score(m, t) for t in texts], atol=1e-4)


def ranked_share(scores, y):
    """Share of (positive, negative) pairs in the right order."""
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in scores[y == 1] for b in scores[y == 0]]))


def test_the_convolution_learns_from_a_random_start():
    rows, labels = toxic_rows(random.Random(8), 900)
    texts, y = [t for _, t, _ in rows], np.array([c for _, c in labels])
    auc = [ranked_share(toxicity.score_texts(toxicity.train(texts[:600], y[:600], epochs=n), pa.array(texts[600:])), y[600:]) for n in (0, toxicity.EPOCHS)]
    assert auc[0] < 0.7 and auc[1] > 0.95


def test_scores_do_not_depend_on_neighbours():
    rows, labels = toxic_rows(random.Random(4), 300)
    m = toxicity.train([t for _, t, _ in rows], np.array([y for _, y in labels]))
    texts = [t for _, t, _ in rows] + [None, "", " ", '"vile"', "..."]
    together = toxicity.score_texts(m, pa.array(texts))
    alone = [toxicity.score_texts(m, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_toxicity_with_clashing_columns_and_ties(spark):
    rows, labels = toxic_rows(random.Random(9), 200)
    docs = spark.createDataFrame([(*x, 0.5, "t", True, 1) for x in [*rows, rows[0], rows[0]]], "doc_id long, text string, lang string, score double, threshold string, toxic boolean, held_out int")
    odd = spark.createDataFrame([*labels, labels[0], (None, 1), (3, 7), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, odd)
    assert sorted(got.columns) == sorted(docs.columns) and got.count() == 202
    assert len({x.score for x in got.where("doc_id = 0").collect()}) == 1 and all(x.toxic == (x.score >= x.threshold) for x in got.collect())


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    rows, labels = toxic_rows(random.Random(12), 6500)  # more rows of a class than one task learns
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen, plain, best = [], toxicity.train_shards, toxicity.best_threshold
    monkeypatch.setattr(toxicity, "SHARD", 1500)
    monkeypatch.setattr(toxicity, "train_shards", lambda r, shards: (seen.append((r.count(), r.select("shard").distinct().count(), shards)), plain(r, shards))[1])
    monkeypatch.setattr(toxicity, "best_threshold", lambda s, y, n: (seen.append(int(n.sum())), best(s, y, n))[1])
    m = toxicity.fit(docs, marks)
    usable = sum(zlib.crc32(str(k).encode()) % 4 != 2 for k, _ in labels)
    (learned, used, shards), *rest = seen
    assert learned + sum(rest) == usable and used == shards > 1  # each row trains or calibrates
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    auc = ranked_share(toxicity.score_texts(m, pa.array([rows[k][1] for k in held])), np.array([labels[k][1] for k in held]))
    again = toxicity.fit(docs, marks)
    assert auc > 0.95 and again.thresholds == m.thresholds and np.array_equal(again.embed, m.embed)


def test_equal_texts_have_equal_scores():
    rows, labels = toxic_rows(random.Random(9), 60)
    m = toxicity.train([t for _, t, _ in rows], np.array([y for _, y in labels]), epochs=1)
    for _, t, _ in rows[:20]:
        assert len({float(x) for k in range(12) for x in toxicity.score_texts(m, pa.array(["w " * k, t, t]))[1:]}) == 1


def test_thresholds():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.5)
    assert 0.3 < toxicity.best_threshold(np.array([0.5, 0.5, 0.3, 0.1]), np.array([1, 0, 0, 0])) < 0.5
