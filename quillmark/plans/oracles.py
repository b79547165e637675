"""DuckDB SQL for the queries of the catalog, built from shared pieces."""

from __future__ import annotations

from quillmark.functions import text as T
from quillmark.functions.validators import EIN_PREFIXES
from quillmark.operators.lexical import skeleton_stopwords
from quillmark.plans import registry as R


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '\s+', ' ', 'g'))"


def skeleton(x: str) -> str:
    return f"translate(translate({x}, {q(T.ACCENTED)}, {q(T.PLAIN)}), '{T.CONFUSED}', '{T.CONFUSED_TO}')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[\x00-\x1f\x7f-\x{{9f}}]', ' ', 'g'), '\s+', ' ', 'g'))"


def values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else q(v) if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows) + ")"


LINES = r"'\r\n|[\n\r\v\f\x{85}\x{2028}\x{2029}]'"
BLOCKS = f"blocks AS (SELECT doc_id, unnest(range(len(l))) AS seq, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, {LINES}), lambda x: {clean('x')}), lambda x: x <> '') AS l FROM documents))"
TOKENS = f"toks AS (SELECT doc_id, seq, {tokens(skeleton(fold('text')))} AS w FROM blocks)"
CAPS = f"caps AS (SELECT DISTINCT doc_id, {skeleton(fold('w'))} AS token FROM (SELECT doc_id, unnest({tokens('text')}) AS w FROM blocks) WHERE w = upper(w) AND w <> lower(w))"
BIGRAM = "unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
TERMS = (
    "one AS (SELECT doc_id, unnest(w) AS term FROM toks), "
    f"terms AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, term FROM one WHERE length(term) > 3 UNION ALL SELECT o.doc_id, o.term FROM one o SEMI JOIN caps c ON o.doc_id = c.doc_id AND o.term = c.token WHERE length(o.term) <= 3 UNION ALL SELECT doc_id, {BIGRAM} FROM toks) GROUP BY ALL), "
    "lengths AS (SELECT doc_id, sum(len(w))::DOUBLE AS length FROM toks WHERE len(w) > 0 GROUP BY doc_id)"
)
_STOP = "(" + ", ".join(q(w) for w in skeleton_stopwords()) + ")"
PROFILES = (
    f"ct AS (SELECT 'prose_' || lang AS class, {tokens(skeleton(fold('text')))} AS w FROM documents), "
    f"cnt AS (SELECT class, term, sum(n) AS n FROM (SELECT class, term, 1.0::DOUBLE AS n FROM (SELECT class, unnest(w) AS term FROM ct) WHERE length(term) > 1 AND term NOT IN {_STOP} "
    f"UNION ALL SELECT class, term, 0.75::DOUBLE FROM (SELECT class, {BIGRAM} AS term FROM ct) WHERE NOT (split_part(term, ' ', 1) IN {_STOP} AND split_part(term, ' ', 2) IN {_STOP})) GROUP BY ALL), "
    "tot AS (SELECT sum(n) AS total FROM cnt), pc AS (SELECT class, sum(n) AS n_c FROM cnt GROUP BY class), pt AS (SELECT term, sum(n) AS y_w FROM cnt GROUP BY term), "
    "z0 AS (SELECT class, term, n, n_c, total, 500 * y_w / total AS a, greatest(y_w - n, 0) AS r FROM cnt JOIN pc USING (class) JOIN pt USING (term), tot), "
    "z1 AS (SELECT class, term, (ln((n + a) / greatest(n_c + 500 - n - a, 1e-9)) - ln((r + a) / greatest(total - n_c + 500 - r - a, 1e-9))) / sqrt(1 / (n + a) + 1 / (r + a)) AS z FROM z0), "
    "z2 AS (SELECT * FROM z1 WHERE z > 0 QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(z, 9) DESC, term) <= 40), "
    "prof AS (SELECT class, term, round(z, 4) AS z, round(z / sum(z) OVER (PARTITION BY class), 6) AS weight FROM z2), "
    "idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(DISTINCT class) FROM prof) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM prof GROUP BY term)"
)
BM25 = (
    "p AS (SELECT class, term, weight, idf FROM prof JOIN idf USING (term)), "
    "hit AS (SELECT t.doc_id, p.class, p.weight, p.idf, t.tf / (t.tf + 1.2 * (1 - 0.75 + 0.75 * l.length / 400.0)) AS sat FROM terms t JOIN p USING (term) JOIN lengths l ON t.doc_id = l.doc_id), "
    "got AS (SELECT doc_id, class, sum(weight * idf * sat * 2.2) AS raw, sum(weight * greatest(idf, 0) * sat) AS shown, sum(weight) AS seen FROM hit GROUP BY ALL), "
    "mass AS (SELECT class, sum(weight) AS mass, sum(weight * greatest(idf, 0)) AS available FROM p GROUP BY class), "
    "bm AS (SELECT l.doc_id, m.class, round(coalesce(raw, 0), 6) AS raw, round(coalesce(shown / available, 0), 6) AS explained, round(coalesce(seen / mass, 0), 6) AS coverage FROM lengths l CROSS JOIN mass m LEFT JOIN got g ON g.doc_id = l.doc_id AND g.class = m.class)"
)


def framed(x: str) -> str:
    return f"' ' || array_to_string({tokens(x)}, ' ') || ' '"


ANCHORS = (
    f"anc AS (SELECT *, {framed(fold('text'))} AS ap, {framed(skeleton(fold('text')))} AS ask, CASE WHEN len(string_split(trim(text), ' ')) >= 3 OR length(trim(text)) >= 18 THEN 1.0 WHEN len(string_split(trim(text), ' ')) = 2 OR length(trim(text)) >= 10 THEN 0.6 WHEN length(trim(text)) >= 5 THEN 0.35 ELSE 0.15 END AS spec FROM {values(R.ANCHORS)} v(doctype_id, ord, text, decisive, zone)), "
    f"full_text AS (SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS t FROM blocks GROUP BY doc_id), zt AS (SELECT doc_id, {framed(fold('t'))} AS plain, {framed(skeleton(fold('t')))} AS skel FROM full_text), "
    "ah AS (SELECT z.doc_id, a.doctype_id, a.ord, 'body' AS zone, CASE WHEN contains(z.plain, a.ap) THEN 'token' ELSE 'skeleton' END AS match, a.decisive, a.text AS anchor, a.ask, a.spec FROM zt z JOIN anc a ON contains(z.skel, a.ask) WHERE a.zone IS NULL OR a.zone = 'body'), "
    "hits AS (SELECT doc_id, doctype_id, ord, zone, match, decisive, round(spec * CASE WHEN match = 'token' THEN 1.0 ELSE 0.95 END * CASE WHEN decisive THEN 2.0 ELSE 1.0 END, 6) AS weight FROM ah h WHERE length(trim(anchor)) > 4 OR EXISTS (SELECT 1 FROM caps c WHERE c.doc_id = h.doc_id AND c.token = trim(h.ask)))"
)
NEGATIVES = f"neg AS (SELECT DISTINCT z.doc_id, n.doctype_id, n.ord FROM zt z JOIN (SELECT doctype_id, ord, {framed(skeleton(fold('text')))} AS a FROM {values(R.NEGATIVES)} v(doctype_id, ord, text)) n ON contains(z.skel, n.a))"
SCORES = (
    "ar AS (SELECT doc_id, doctype_id, sum(weight) AS raw, sum(hit) AS n FROM (SELECT doc_id, doctype_id, weight::DOUBLE AS weight, 1 AS hit FROM hits UNION ALL SELECT doc_id, doctype_id, -1.0, 0 FROM neg) GROUP BY ALL), "
    "asc_ AS (SELECT doc_id, doctype_id, round(greatest(raw, 0), 6) AS bits, round(least(0.97, 1 - pow(0.5, greatest(raw, 0))), 4) AS score, round(coalesce(n / (SELECT count(*) FROM anc a WHERE a.doctype_id = ar.doctype_id), 0), 4) AS coverage FROM ar)"
)
_LEX = f"WITH {BLOCKS}, {TOKENS}, {CAPS}, {TERMS}"
_ANC = f"WITH {BLOCKS}, {CAPS}, {ANCHORS}"
_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({d}), i, 1) AS INT) ELSE CAST(substr(reverse({d}), i, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse({d}), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_BUNDLE = "bundle AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN length(text) > 900 THEN 700.0 ELSE 612.0 END AS width, length(text) >= 60 AS ok, (length(text) % 10) / 10 AS img, text FROM conversations)"
_MARKERS = "(VALUES " + ", ".join(f"({q(m)})" for m in R.MARKERS) + ") m(marker)"
_BOUNDS = (
    f"seen AS (SELECT DISTINCT doc_id, page FROM (SELECT b.doc_id, m.marker, min(b.page) AS page FROM bundle b JOIN {_MARKERS} ON contains(lower(b.text), m.marker) GROUP BY ALL)), "
    "lagged AS (SELECT b.*, s.page IS NOT NULL AS marked, lag(b.page) OVER w AS p0, lag(width) OVER w AS w0, lag(ok) OVER w AS ok0, lag(img) OVER w AS img0 FROM bundle b LEFT JOIN seen s ON s.doc_id = b.doc_id AND s.page = b.page WINDOW w AS (PARTITION BY b.doc_id ORDER BY b.page)), "
    "bounds AS (SELECT doc_id, page, CASE WHEN (ok <> ok0 AND CASE WHEN ok THEN img0 ELSE img END > 0) OR (img >= 0.6) <> (img0 >= 0.6) THEN 'adequacy' WHEN abs(width - w0) / greatest(width, w0) > 0.02 THEN 'geometry' WHEN marked THEN 'first_page_anchor' END AS signal FROM lagged WHERE p0 IS NOT NULL)"
)
_DECISIONS = "dec AS (SELECT 'item' || (user_id % 50) AS item_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'correct' ELSE 'reject' END AS decision, CASE WHEN event_id % 4 > 0 THEN 'r' || (event_id % 6) END AS reviewer, CASE WHEN event_id % 5 > 0 THEN event_type END AS value FROM events)"
_KIND_SQL = (
    "CASE WHEN category = 'identity' THEN CASE WHEN n >= 5 THEN -1.2 WHEN n >= 3 THEN -0.4 WHEN n > 0 THEN 0.15 ELSE 0 END + CASE WHEN n = 1 AND land THEN 0.25 ELSE 0 END + CASE WHEN tabs >= 3 THEN -0.3 ELSE 0 END "
    "WHEN category IN ('corporate', 'financial') THEN CASE WHEN n >= 3 THEN 0.3 ELSE 0 END + CASE WHEN tabs >= 1 THEN 0.15 ELSE 0 END + CASE WHEN n = 1 AND land THEN -0.3 ELSE 0 END "
    "WHEN category = 'tax' THEN CASE WHEN tabs >= 1 THEN 0.1 ELSE 0 END + CASE WHEN marks >= 1 THEN 0.1 ELSE 0 END ELSE 0 END "
    "+ CASE WHEN mrz THEN CASE WHEN doc_id % 5 = 0 THEN 0.8 ELSE -0.3 END ELSE 0 END + CASE WHEN wm THEN CASE WHEN marks > 0 THEN 0.3 ELSE -0.2 END ELSE 0 END + CASE WHEN wt AND tabs > 0 THEN 0.1 ELSE 0 END"
)

ORACLES = {
    "doc_blocks": f"WITH {BLOCKS} SELECT doc_id, seq, 'body' AS zone, text FROM blocks",
    "doc_normal_forms": f"SELECT doc_id, md5({fold('text')}) AS folded, md5({skeleton(fold('text'))}) AS skeleton, len({tokens(skeleton(fold('text')))}) AS n_tokens, md5(CASE WHEN length(text) <= 4 THEN repeat('*', length(text)) ELSE repeat('*', length(text) - 4) || right(text, 4) END) AS redacted, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM documents",
    "doc_terms": f"{_LEX} SELECT doc_id, term, tf FROM terms",
    "doc_lengths": f"{_LEX} SELECT doc_id, length FROM lengths",
    "doc_bigrams": f"WITH {BLOCKS}, {TOKENS} SELECT bigram, count(*) AS n FROM (SELECT {BIGRAM} AS bigram FROM toks) GROUP BY bigram",
    "caps_tokens": f"WITH {BLOCKS}, {CAPS} SELECT doc_id, count(*) AS n_caps FROM caps GROUP BY doc_id",
    "term_profiles": f"WITH {PROFILES} SELECT class, term, z, weight FROM prof",
    "profile_doc_freq": f"WITH {PROFILES} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_scores": f"{_LEX}, {PROFILES}, {BM25} SELECT doc_id, class, raw, explained, coverage FROM bm",
    "softmax_rank": f"{_LEX}, {PROFILES}, {BM25}, r0 AS (SELECT doc_id, class, raw FROM bm), r1 AS (SELECT *, median(raw) OVER (PARTITION BY doc_id) AS m, stddev_pop(raw) OVER (PARTITION BY doc_id) AS sd FROM r0), r2 AS (SELECT *, 1.4826 * median(abs(raw - m)) OVER (PARTITION BY doc_id) AS mad FROM r1), r3 AS (SELECT *, CASE WHEN (CASE WHEN mad >= 1e-9 THEN mad ELSE sd END) < 1e-9 THEN 0.0 ELSE (raw - m) / (CASE WHEN mad >= 1e-9 THEN mad ELSE sd END) END AS z FROM r2), r4 AS (SELECT *, exp((z - max(z) OVER (PARTITION BY doc_id)) / 0.6) AS e FROM r3), r5 AS (SELECT doc_id, class, z, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM r4) SELECT doc_id, class, round(z, 3) AS z, round(p, 3) AS p FROM r5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 6) DESC, class) <= 2",
    "anchor_hits": f"{_ANC} SELECT doc_id, doctype_id, ord::BIGINT AS ord, zone, match, weight::DOUBLE AS weight FROM hits",
    "negative_hits": f"{_ANC}, {NEGATIVES} SELECT doctype_id, count(*) AS n FROM neg GROUP BY doctype_id",
    "anchor_bits": f"{_ANC}, {NEGATIVES}, {SCORES} SELECT doc_id, doctype_id, bits, score::DOUBLE AS score, coverage FROM asc_",
    "contested_claims": f"{_ANC}, claims AS (SELECT {skeleton(fold('text'))} AS claim FROM anc WHERE decisive GROUP BY ALL HAVING count(DISTINCT doctype_id) > 1) SELECT h.doctype_id, count(*) AS n FROM hits h JOIN anc a ON a.doctype_id = h.doctype_id AND a.ord = h.ord WHERE h.decisive AND {skeleton(fold('a.text'))} NOT IN (SELECT claim FROM claims) GROUP BY h.doctype_id",
    "verdict_gates": f"{_LEX}, {PROFILES}, {BM25}, {ANCHORS}, {NEGATIVES}, {SCORES}, claims AS (SELECT {skeleton(fold('text'))} AS claim FROM anc WHERE decisive GROUP BY ALL HAVING count(DISTINCT doctype_id) > 1), own AS (SELECT DISTINCT h.doc_id, h.doctype_id FROM hits h JOIN anc a ON a.doctype_id = h.doctype_id AND a.ord = h.ord WHERE h.decisive AND {skeleton(fold('a.text'))} NOT IN (SELECT claim FROM claims)), alone AS (SELECT doc_id, min(doctype_id) AS owner FROM own GROUP BY doc_id HAVING count(*) = 1), s0 AS (SELECT b.doc_id, b.class AS id, coalesce(a.bits, 0) AS bits, coalesce(a.score, 0) AS score, b.explained AS ex, greatest(b.coverage, coalesce(a.coverage, 0)) AS cov FROM bm b LEFT JOIN asc_ a ON a.doc_id = b.doc_id AND a.doctype_id = b.class), s1 AS (SELECT *, round(greatest(bits, 0) - log2(greatest(1 - ex, 1e-6)), 6) AS b FROM s0), s2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC, id) AS k FROM s1), s3 AS (SELECT c.doc_id, c.id AS candidate, CASE WHEN c.bits > 0 AND c.ex > 0 AND c.bits >= n.bits AND c.ex >= n.ex THEN 'concurrence' WHEN o.owner = c.id THEN 'conclusive' ELSE '' END AS route, round(CASE WHEN c.b - coalesce(n.b, 0) > 0 THEN 1 - pow(2.0, -(c.b - coalesce(n.b, 0))) ELSE 0 END, 6) AS margin, round(1 - (1 - c.score) * (1 - c.ex), 6) AS support, c.cov AS coverage FROM s2 c LEFT JOIN s2 n ON n.doc_id = c.doc_id AND n.k = 2 LEFT JOIN alone o ON o.doc_id = c.doc_id WHERE c.k = 1), s4 AS (SELECT *, array_to_string(list_filter([CASE WHEN route = '' THEN 'not identified' END, CASE WHEN margin < 0.04 THEN 'margin below 0.04' END, CASE WHEN support < 0.3 THEN 'support below 0.3' END, CASE WHEN coverage < 0.2 THEN 'coverage below 0.2' END], lambda x: x IS NOT NULL), '; ') AS reason FROM s3) SELECT s4.doc_id, CASE WHEN reason = '' THEN candidate ELSE 'unknown' END AS doctype_id, candidate, reason <> '' AS abstained, margin, support, coverage, route, reason, (SELECT string_agg(id, ',' ORDER BY k) FROM s2 WHERE s2.doc_id = s4.doc_id AND k BETWEEN 2 AND 4) AS runners_up FROM s4",
    "luhn_sweep": f"WITH f AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[0-9][0-9 -]{{11,22}}[0-9]')), '[^0-9]', '', 'g') AS digits FROM documents) SELECT doc_id, digits, {_LUHN.format(d='digits')} AS ok, count(*) AS n FROM f WHERE length(digits) BETWEEN 13 AND 19 GROUP BY ALL",
    "pattern_fields": f"WITH {BLOCKS} SELECT doc_id, name, value, 'body' AS zone, min(seq) AS seq, 0.5::DOUBLE AS confidence FROM (" + " UNION ALL ".join(f"SELECT doc_id, seq, {q(n)} AS name, unnest(regexp_extract_all(text, {q(p)})) AS value FROM blocks" for n, p in R.PATTERNS) + ") GROUP BY doc_id, name, value",
    "validated_numbers": f"WITH n AS (SELECT o_orderkey, lpad(((o_orderkey * 48271) % 1000000000)::VARCHAR, 9, '0') AS d FROM orders), e AS (SELECT o_orderkey, d, 'ssn' AS validator, CASE WHEN d BETWEEN '987654320' AND '987654329' THEN 'reserved_for_advertising:never_issued' WHEN substr(d, 1, 3) IN ('000', '666') OR d[1] = '9' THEN 'invalid_area:' || substr(d, 1, 3) WHEN substr(d, 4, 2) = '00' THEN 'invalid_group:00' WHEN substr(d, 6) = '0000' THEN 'invalid_serial:0000' END AS bad, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6) AS good, '' AS soft FROM n UNION ALL SELECT o_orderkey, d, 'ein', CASE WHEN substr(d, 1, 2) NOT IN ({', '.join(q(p) for p in EIN_PREFIXES)}) THEN 'invalid_irs_prefix:' || substr(d, 1, 2) END, substr(d, 1, 2) || '-' || substr(d, 3), '' FROM n UNION ALL SELECT o_orderkey, d, 'itin', CASE WHEN d[1] <> '9' THEN 'invalid_prefix:' || d[1] || '!=9' WHEN NOT (substr(d, 4, 2) BETWEEN '50' AND '65' OR substr(d, 4, 2) BETWEEN '70' AND '88' OR substr(d, 4, 2) BETWEEN '90' AND '92' OR substr(d, 4, 2) >= '94') THEN 'invalid_group:' || substr(d, 4, 2) WHEN substr(d, 6) = '0000' THEN 'invalid_serial:0000' END, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6), '' FROM n UNION ALL SELECT o_orderkey, d, 'sin_luhn', CASE WHEN NOT ({_LUHN.format(d='d')}) THEN 'luhn_check_failed' END, substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7), CASE WHEN d[1] IN ('0', '8') THEN 'unassigned_prefix:' || d[1] ELSE '' END FROM n) SELECT o_orderkey, validator, bad IS NULL AS ok, CASE WHEN bad IS NULL THEN good ELSE '' END AS normalized, coalesce(bad, soft) AS error FROM e",
    "structural_facts": f"WITH {BLOCKS}, b AS (SELECT doc_id, count(*) AS bc, sum(length(text)) + count(*) - 1 AS cc FROM blocks GROUP BY doc_id), p AS (SELECT page_id AS doc_id, round((page_id % 7 * 200 + 400) / 792.0, 4) AS ar FROM pages), f AS (SELECT doc_id, 1 AS n, coalesce(ar, 0.0)::DOUBLE AS ar, coalesce(ar > 1.05, false) AS land, coalesce(p.doc_id % 2 = 0, false) AS digital, coalesce(bc, 0) AS bc, coalesce(cc, 0) AS cc, doc_id % 4 AS tabs, doc_id % 3 AS marks FROM b FULL JOIN p USING (doc_id)), k AS (SELECT * FROM {values(R.KINDS)} v(doctype_id, category, mrz, wm, wt)) SELECT doc_id, doctype_id, round(greatest(-2.0, least(1.5, {_KIND_SQL})), 4)::DOUBLE AS prior, 1::BIGINT AS page_count, ar AS aspect_ratio, land AS landscape, digital, bc AS block_count, cc::BIGINT AS char_count FROM f, k",
    "page_islands": "WITH p AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS doctype_id, length(text) / 1024 AS c FROM conversations), n AS (SELECT *, CASE WHEN lag(doctype_id) OVER w = doctype_id AND lag(page) OVER w = page - 1 THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) AS s FROM n) SELECT doc_id, doctype_id, min(page) AS start_page, max(page) AS end_page, round(avg(c), 4) AS confidence FROM i GROUP BY doc_id, s, doctype_id",
    "bundle_boundaries": f"WITH {_BUNDLE}, {_BOUNDS} SELECT * FROM bounds WHERE signal IS NOT NULL",
    "bundle_spans": f"WITH {_BUNDLE}, {_BOUNDS}, s AS (SELECT b.doc_id, b.page, CASE WHEN x.page IS NOT NULL OR coalesce(lag(b.page) OVER w <> b.page - 1, true) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT doc_id, page FROM bundle) b LEFT JOIN (SELECT doc_id, page FROM bounds WHERE signal IS NOT NULL) x ON x.doc_id = b.doc_id AND x.page = b.page WINDOW w AS (PARTITION BY b.doc_id ORDER BY b.page)), t AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS span FROM s) SELECT doc_id, span, min(page) AS start_page, max(page) AS end_page FROM t GROUP BY doc_id, span",
    "grounded_values": f"WITH t AS (SELECT conv_id, {fold(chr(34) + 't' + chr(34))} AS f FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)), a AS (SELECT conv_id, 'f' || turn AS name, {fold('substr(text, 5, 12)')} AS v, {fold('CASE WHEN turn % 3 = 2 THEN reverse(text) ELSE substr(text, 1, 60) END')} AS qt FROM conversations) SELECT a.conv_id AS doc_id, a.name, (qt <> '' AND v <> '' AND contains(f, qt) AND contains(qt, v)) AS grounded FROM a JOIN t ON t.conv_id = a.conv_id",
    "induced_fields": r"WITH e AS (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events), p AS (SELECT event_id, regexp_replace(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, json_extract_string(props, '$.' || k) AS v FROM e) SELECT name, count(DISTINCT event_id) AS support, CASE WHEN avg(CASE WHEN regexp_matches(v, '^\s*[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\s*$') THEN 1 ELSE 0 END) >= 0.6 THEN 'date' WHEN avg(CASE WHEN regexp_matches(v, '^[\s$€£+-]*[0-9][0-9.,'' ]*$') THEN 1 ELSE 0 END) >= 0.6 THEN 'number' ELSE 'string' END AS type FROM p WHERE name <> '' GROUP BY name HAVING count(DISTINCT event_id) >= greatest(1, ceil((SELECT count(DISTINCT event_id) FROM p) * 0.6))",
    "knn_topk": "WITH s AS (SELECT a.vec_id AS query_id, b.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY c DESC) AS k FROM s), m AS (SELECT query_id, label, round(avg(c), 6) AS mean FROM k WHERE k <= 5 GROUP BY ALL) SELECT query_id, label, round(mean, 4) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mean DESC, label) = 1",
    "review_enqueue": "SELECT substr(regexp_replace(doc_id::VARCHAR, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) || ':' || f AS id, doc_id, f AS field_name, reason, ap::BIGINT AS required_approvals FROM (SELECT doc_id, '__document__' AS f, 'abstained' AS reason, 1 AS ap FROM documents WHERE n_chars < 300 UNION ALL SELECT doc_id, source, CASE WHEN NOT has AND n_chars % 2 = 0 THEN 'missing_required' WHEN has AND n_chars % 100 / 100 < 0.6 THEN 'below_confidence_threshold' WHEN has AND n_chars % 7 = 0 THEN 'validator_error' END, CASE WHEN lang = 'en' AND n_chars % 5 = 0 THEN 2 ELSE 1 END FROM (SELECT *, n_chars % 3 > 0 AND substr(text, 1, 8) <> '' AS has FROM documents WHERE n_chars >= 300)) WHERE reason IS NOT NULL",
    "review_fold": f"WITH {_DECISIONS}, v AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS k FROM dec WHERE trim(coalesce(reviewer, '')) <> '' AND (decision IN ('approve', 'reject') OR decision = 'correct' AND trim(coalesce(value, '')) <> '')), f AS (SELECT * FROM v WHERE k = 1), n AS (SELECT item_id, count(*) AS n FROM dec GROUP BY item_id) SELECT n.item_id AS id, coalesce(CASE f.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'correct' THEN 'corrected' END, 'pending') AS status, f.reviewer, CASE WHEN f.decision = 'correct' THEN trim(f.value) END AS corrected_value, n.n - CASE WHEN f.item_id IS NULL THEN 0 ELSE 1 END AS refused FROM n LEFT JOIN f ON f.item_id = n.item_id",
    "corpus_score": "WITH o AS (SELECT lang, source, CASE WHEN n_chars < 300 THEN 'abstained' WHEN quality = 1 AND toxic = 0 THEN 'correct' ELSE 'wrong' END AS x FROM documents JOIN labels USING (doc_id)), g AS (SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) FILTER (x = 'correct') AS correct, count(*) FILTER (x = 'wrong') AS wrong, count(*) FILTER (x = 'abstained') AS abstained FROM o GROUP BY GROUPING SETS ((), (lang), (source))) SELECT *, round(correct / (correct + wrong + abstained), 4) AS accuracy, round(CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) END, 4) AS precision, round(abstained / (correct + wrong + abstained), 4) AS abstention FROM g",
    "compared": "WITH a AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'unknown' ELSE lang END AS t FROM documents), b AS (SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN source WHEN n_chars % 4 = 0 THEN 'unknown' ELSE lang END AS t FROM documents WHERE n_chars > 100) SELECT CASE WHEN a.t IS NULL OR b.t IS NULL THEN 'single_avenue' WHEN a.t = 'unknown' AND b.t = 'unknown' THEN 'both_abstained' WHEN a.t = 'unknown' OR b.t = 'unknown' THEN 'one_abstained' WHEN a.t = b.t THEN 'agree' ELSE 'disagree' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1",
    "event_metrics": "SELECT date_trunc('hour', ts) AS hour, event_type, CASE WHEN value <= 1 THEN '1' WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE '+Inf' END AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": "WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w < ts - INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM s) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM t GROUP BY ALL",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL",
}
