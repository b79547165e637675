"""DuckDB SQL for the queries of the forms catalog: computed from the given tables, or expected rows where the input is a fixture."""

from __future__ import annotations

import hashlib

from quillmark.functions.validators import EIN_PREFIXES
from quillmark.plans import forms_catalog as C
from quillmark.plans import oracles as O
from quillmark.plans import registry as R
from quillmark.plans.oracles import q, values

_D = "lpad(((o_orderkey * 48271) % 1000000000)::VARCHAR, 9, '0')"
_LUHN = O._LUHN


def rows(names: str, given: list[tuple], types: str) -> str:
    """SELECT of literal rows with types."""
    cols = names.split()
    return "SELECT " + ", ".join(f"{c}::{t} AS {c}" for c, t in zip(cols, types.split())) + f" FROM {values(given)} v({', '.join(cols)})"


_NAMES = {"document_code": "P", "issuing_state": "UTO", "surname": "ERIKSSON", "given_names": "ANNA MARIA", "document_number": "L898902C3", "nationality": "UTO", "date_of_birth": "1974-08-12", "sex": "F", "expiry_date": "2012-04-15", "personal_number": "ZE184226B"}
_CARD = {**{k: v for k, v in _NAMES.items() if k != "personal_number"}, "document_code": "I", "document_number": "D23145890"}
_ZONE_ROWS = [(i, kind, n, v, ok, 0.97 if ok else 0.55) for i, kind, fields, ok in ((1, "TD3", _NAMES, True), (2, "TD1", _CARD, True), (3, "TD2", _CARD, True), (4, "TD3", _NAMES | {"document_number": "L898902C4"}, False)) for n, v in fields.items()]
_TD3 = [(1, hashlib.md5(C.ZONES[0][1].encode()).hexdigest()), (2, None), (3, None), (4, hashlib.md5(C.ZONES[3][1].split("\n", 1)[1].rsplit("\n", 1)[0].encode()).hexdigest()), (5, None)]

SWEEP = (
    f"WITH n AS (SELECT o_orderkey AS doc_id, {_D} AS d FROM orders), p AS (SELECT *, length(doc_id::VARCHAR) AS w FROM n), "
    "h AS (SELECT doc_id, 'ssn' AS validator, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6) AS raw, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6) AS normalized, '' AS error, w + 9 AS start, false AS sum_ FROM p WHERE NOT (d BETWEEN '987654320' AND '987654329' OR substr(d, 1, 3) IN ('000', '666') OR d[1] = '9' OR substr(d, 4, 2) = '00' OR substr(d, 6) = '0000') "
    "UNION ALL SELECT doc_id, 'itin', substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6), substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6), '', w + 9, false FROM p WHERE d[1] = '9' AND (substr(d, 4, 2) BETWEEN '50' AND '65' OR substr(d, 4, 2) BETWEEN '70' AND '88' OR substr(d, 4, 2) BETWEEN '90' AND '92' OR substr(d, 4, 2) >= '94') AND substr(d, 6) <> '0000' "
    f"UNION ALL SELECT doc_id, 'ein', substr(d, 1, 2) || '-' || substr(d, 3), substr(d, 1, 2) || '-' || substr(d, 3), '', w + 25, false FROM p WHERE substr(d, 1, 2) IN ({', '.join(q(x) for x in EIN_PREFIXES)}) "
    f"UNION ALL SELECT doc_id, 'sin_luhn', substr(d, 1, 3) || ' ' || substr(d, 4, 3) || ' ' || substr(d, 7), substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7), CASE WHEN d[1] IN ('0', '8') THEN 'unassigned_prefix:' || d[1] ELSE '' END, w + 41, d[1] NOT IN ('0', '8') FROM p WHERE {_LUHN.format(d='d')}) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, validator) AS ord, validator, raw, normalized, sum_ AS verified, error, start::BIGINT AS start FROM h"
)

_BALANCE = "ltrim(format('{:,.2f}', c_acctbal), '-')"
_DAY = "strftime(DATE '2001-01-01' + (c_custkey % 3000)::INT, '%Y-%m-%d')"
_FOUND = (
    "found AS (SELECT c_custkey AS doc_id, 'holder' AS name, c_name AS value, 0.6691 AS confidence, 'same line' AS how FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, 0.7872, 'same line' FROM customer "
    f"UNION ALL SELECT c_custkey, 'opened', {_DAY}, 0.7503, 'right' FROM customer UNION ALL SELECT c_custkey, 'balance', {_BALANCE}, 0.6708, 'below' FROM customer "
    "UNION ALL SELECT c_custkey, 'home', 'Nation ' || c_nationkey || chr(10) || 'Street ' || (c_custkey % 97), 0.6708, 'below' FROM customer)"
)
_TAX = "lpad(((c_custkey * 7919 + 130692544) % 1000000000)::VARCHAR, 9, '0')"
_FIELDS = (
    f"tax AS (SELECT c_custkey AS doc_id, {_TAX} AS d FROM customer), fields AS ("
    "SELECT doc_id, name, value, value AS normalized, confidence::DOUBLE AS confidence, 'none' AS verification, 'label' AS locator FROM found WHERE name IN ('holder', 'segment') UNION ALL SELECT doc_id, name, value, value, 0.8253, 'format', 'label' FROM found WHERE name = 'opened' "
    "UNION ALL SELECT doc_id, name, value, replace(value, ',', ''), 0.7379, 'format', 'label' FROM found WHERE name = 'balance' "
    f"UNION ALL SELECT doc_id, 'tax_number', CASE WHEN good THEN d ELSE '130692544' END, CASE WHEN good THEN substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7) ELSE '130-692-544' END, CASE WHEN good THEN 0.995 ELSE 0.9 END, 'checksum', CASE WHEN good THEN 'kv' ELSE 'regex' END FROM (SELECT *, {_LUHN.format(d='d')} AS good FROM tax) "
    "UNION ALL SELECT c_custkey, 'resident', CASE c_nationkey % 3 WHEN 0 THEN 'true' ELSE 'false' END, CASE c_nationkey % 3 WHEN 0 THEN 'true' ELSE 'false' END, 0.86, 'none', 'mark' FROM customer WHERE c_nationkey % 3 < 2)"
)
_SPARSE = (
    "f AS (SELECT c_custkey AS doc_id, n AS name, CASE WHEN c_custkey % k > 0 THEN n || c_custkey END AS value, ord FROM customer, (VALUES ('a', 2, 0), ('b', 3, 1), ('c', 5, 2)) v(n, k, ord)), "
    "filled AS (SELECT doc_id, name, CASE WHEN value IS NOT NULL THEN value WHEN name = 'a' AND doc_id % 4 > 0 THEN 'from T2' WHEN name = 'a' AND doc_id % 7 > 0 THEN 'late' WHEN name = 'b' AND doc_id % 7 > 0 THEN 'from T3' END AS v, CASE WHEN value IS NOT NULL THEN 'local' WHEN name = 'a' AND doc_id % 4 > 0 THEN 'T2' WHEN name = 'a' AND doc_id % 7 > 0 THEN 'T3' WHEN name = 'b' AND doc_id % 7 > 0 THEN 'T3' END AS source FROM f)"
)
_MEM = "m AS (SELECT o_custkey AS bundle, o_orderkey AS ord, o_orderpriority AS source, o_orderkey % 4 + 1 AS pages FROM orders), w AS (SELECT *, sum(pages) OVER (PARTITION BY bundle ORDER BY ord)::BIGINT AS end_page FROM m), b AS (SELECT bundle, ord, source, end_page - pages + 1 AS start_page, end_page FROM w)"
_SUP = "s AS (SELECT p_size AS doc_id, p_name AS doctype_id, max((p_partkey * 37 % 101) / 1000) AS support, max((p_partkey % 5) - 1) AS evidence FROM part GROUP BY ALL)"
_TRAIL = f"WITH {_SUP}, t AS (SELECT doc_id, CASE WHEN evidence > 1 THEN 'anchor' ELSE 'lexical' END AS tier, doctype_id AS detail, support AS weight FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tier ORDER BY weight DESC, detail) AS k FROM t), e AS (SELECT * FROM k WHERE k <= 2)"
_ZT = f"WITH {O.BLOCKS}, {O.CAPS}, {O.ANCHORS}"

ORACLES = {
    "absorbed_segments": f"WITH {O._BUNDLE}, {O._BOUNDS}, s AS (SELECT b.doc_id, b.page, CASE WHEN x.page IS NOT NULL OR coalesce(lag(b.page) OVER w <> b.page - 1, true) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT doc_id, page FROM bundle) b LEFT JOIN (SELECT doc_id, page FROM bounds WHERE signal IS NOT NULL) x ON x.doc_id = b.doc_id AND x.page = b.page WINDOW w AS (PARTITION BY b.doc_id ORDER BY b.page)), t AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page) AS span FROM s), sp AS (SELECT doc_id, min(page) AS a, max(page) AS z FROM t GROUP BY doc_id, span), k AS (SELECT *, CASE WHEN a % 2 = 1 THEN NULL ELSE 'report' END AS known, CASE WHEN coalesce(lag(z) OVER w + 1 <> a, true) THEN 1 ELSE 0 END AS gap FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY a)), c AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY a) AS chain FROM k), y AS (SELECT *, CASE WHEN count(known) OVER (PARTITION BY doc_id, chain) > 0 THEN 'report' ELSE 'unknown' END AS typ FROM c), n AS (SELECT *, CASE WHEN gap = 1 OR typ <> lag(typ) OVER (PARTITION BY doc_id ORDER BY a) THEN 1 ELSE 0 END AS fresh FROM y), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS seg FROM n) SELECT doc_id, seg::INT AS segment, min(a) AS start_page, max(z) AS end_page, typ AS doctype_id FROM g GROUP BY doc_id, seg, typ",
    "registry_violations": rows("doctype_id problem detail", [("x", "unknown_doctype", "anchors"), ("y", "unknown_doctype", "validators"), ("a", "unknown_confusable", "z"), ("c", "confusable_with_itself", "c"), ("c", "no_anchor", ""), ("a", "anchor_twice", "f0rm 1"), ("y", "unknown_validator", "nope")], "VARCHAR VARCHAR VARCHAR"),
    "listed_types": "SELECT n_name AS doctype_id FROM nation WHERE (n_regionkey <= 1 OR n_regionkey = 2) AND n_nationkey % 2 = 0",
    "identifier_sweep": SWEEP,
    "validator_vectors": rows("id validator ok normalized error", [(k, n, ok, norm, e) for k, ((n, _), (ok, norm, e)) in enumerate(zip(C.VECTORS, C.ANSWERS))], "INT VARCHAR BOOLEAN VARCHAR VARCHAR").replace("\\n", "\n"),
    "zone_fields": rows("doc_id kind name value verified confidence", _ZONE_ROWS, "INT VARCHAR VARCHAR VARCHAR BOOLEAN DOUBLE"),
    "passport_zones": rows("doc_id zone", _TD3, "INT VARCHAR"),
    "label_fields": f"WITH {_FOUND} SELECT doc_id, name, value, confidence::DOUBLE AS confidence, how FROM found",
    "mark_fields": "WITH c AS (SELECT c_custkey AS doc_id, c_nationkey AS n FROM customer) SELECT doc_id, 'resident' AS name, CASE WHEN n % 5 = 0 THEN 'true' ELSE 'false' END AS value, 0.86::DOUBLE AS confidence, 2 AS mark FROM c UNION ALL SELECT doc_id, 'kind', 'Person', CASE WHEN n % 3 = 0 THEN 0.656 ELSE 0.82 END, 0 FROM c WHERE n % 2 = 0 UNION ALL SELECT doc_id, 'kind', 'Company', CASE WHEN n % 2 = 0 THEN 0.656 ELSE 0.82 END, 1 FROM c WHERE n % 3 = 0",
    "extracted_fields": f"WITH {_FOUND}, {_FIELDS} SELECT doc_id, name, value, normalized, confidence::DOUBLE AS confidence, verification, locator, '' AS validator_error FROM fields",
    "processed_documents": f"WITH {_FOUND}, {_FIELDS}, g AS (SELECT doc_id, round(count(*) / 6, 4) AS r FROM fields GROUP BY doc_id) SELECT g.doc_id, 'account' AS doctype_id, CASE WHEN g.doc_id % 11 = 0 THEN 'abstained' ELSE 'complete' END AS status, '' AS missing_required, g.doc_id % 11 = 0 AS needs_review, CASE WHEN g.doc_id % 11 = 0 THEN 0.0 ELSE r END AS fill_rate, CASE WHEN g.doc_id % 11 = 0 THEN 'classification_abstained' ELSE '' END AS review FROM g",
    "tier_fields": f"WITH {_SPARSE} SELECT doc_id, name, v AS value, source FROM filled",
    "tier_ledger": f"WITH {_SPARSE}, a AS (SELECT doc_id, count(*) FILTER (value IS NULL) AS m2, count(*) FILTER (value IS NULL AND NOT (name = 'a' AND doc_id % 4 > 0)) AS m3, count(*) FILTER (value IS NULL AND name = 'a' AND doc_id % 4 > 0) AS g2, count(*) FILTER (value IS NULL AND doc_id % 7 > 0 AND (name = 'b' OR name = 'a' AND doc_id % 4 = 0)) AS g3, count(*) FILTER (value IS NULL AND NOT coalesce((SELECT x.v IS NOT NULL FROM filled x WHERE x.doc_id = f.doc_id AND x.name = f.name), false)) AS m4 FROM f GROUP BY doc_id), s AS (SELECT *, CASE WHEN m2 = 0 THEN 'skipped' WHEN doc_id % 4 = 0 THEN 'unavailable' ELSE 'ran' END AS s2, CASE WHEN m3 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'unavailable' ELSE 'ran' END AS s3 FROM a) SELECT doc_id, 'T2' AS tier, s2 AS state, CASE WHEN s2 = 'ran' THEN m2 ELSE 0 END AS asked, CASE WHEN s2 = 'ran' THEN g2 ELSE 0 END AS filled FROM s UNION ALL SELECT doc_id, 'T3', s3, CASE WHEN s3 = 'ran' THEN m3 ELSE 0 END, CASE WHEN s3 = 'ran' THEN g3 ELSE 0 END FROM s UNION ALL SELECT doc_id, 'T4', 'skipped', 0, 0 FROM s",
    "query_names": f"WITH {_SPARSE}, k AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM f WHERE value IS NULL) SELECT doc_id, string_agg('the_' || name || '_field', ',' ORDER BY k) AS names FROM k WHERE k <= 2 GROUP BY doc_id",
    "vendor_fields": "SELECT event_id AS doc_id, 'kind' AS name, event_type AS value FROM events UNION ALL SELECT event_id, 'who.id', user_id::VARCHAR FROM events",
    "schema_latest": rows("doctype_id version", [("a", "reg-10"), ("b", "1.2"), ("c", "7")], "VARCHAR VARCHAR"),
    "schema_changes": "WITH o AS (SELECT 't' || n_regionkey AS t, n_name AS n FROM nation WHERE n_nationkey % 7 <> 0), w AS (SELECT 't' || n_regionkey AS t, n_name AS n, n_nationkey % 5 = 0 AS d, n_nationkey % 4 = 0 AS r FROM nation WHERE n_nationkey % 6 <> 0), j AS (SELECT coalesce(o.t, w.t) AS doctype_id, coalesce(o.n, w.n) AS name, CASE WHEN o.n IS NULL THEN CASE WHEN r THEN 'added_required' ELSE 'added' END WHEN w.n IS NULL THEN 'removed' WHEN d THEN 'retyped' WHEN r THEN 'made_required' END AS change FROM o FULL JOIN w ON o.t = w.t AND o.n = w.n) SELECT *, change = 'added' AS additive FROM j WHERE change IS NOT NULL",
    "page_adequacy": r"WITH c AS (SELECT conv_id AS doc_id, turn AS page, CASE conv_id % 9 WHEN 0 THEN repeat('x', 200) WHEN 1 THEN repeat(chr(65533), 500) || substr(text, 1, 100) ELSE text END AS t, (turn % 4) / 4 AS img FROM conversations), a AS (SELECT *, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS alnum, regexp_replace(t, '\s', '', 'g') AS solid FROM c), g AS (SELECT doc_id, page, max(n) AS top FROM (SELECT doc_id, page, ch, count(*) AS n FROM (SELECT doc_id, page, unnest(string_split(solid, '')) AS ch FROM a) GROUP BY ALL) GROUP BY ALL), r AS (SELECT a.*, CASE WHEN alnum < 40 THEN 'too_few_characters' WHEN top / greatest(length(solid), 1) > 0.9 THEN 'one_repeated_glyph' WHEN (length(t) - length(replace(t, chr(65533), ''))) / length(t) > 0.5 THEN 'control_glyphs' WHEN img >= 0.6 THEN 'picture_page' ELSE '' END AS reason FROM a JOIN g USING (doc_id, page)) SELECT doc_id, page, alnum, reason = '' AS adequate, reason, CASE WHEN reason = '' THEN 'text' ELSE 'none' END AS channel FROM r",
    "input_channels": "SELECT event_id AS doc_id, CASE WHEN event_id % 7 = 0 THEN 'ingest' WHEN event_id % 3 = 0 THEN 'read' WHEN event_id % 2 = 0 THEN 'text' END AS channel, CASE WHEN event_id % 7 = 0 THEN 'i' WHEN event_id % 3 = 0 THEN 'r' WHEN event_id % 2 = 0 THEN event_type END AS payload FROM events",
    "capped_views": f"WITH {O.BLOCKS}, c AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER w AS c FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), k AS (SELECT *, n <= 3 AND c <= 500 AS ok, bool_or(NOT (n <= 3 AND c <= 500)) OVER (PARTITION BY doc_id) AS truncated FROM c) SELECT doc_id, seq, truncated FROM k WHERE ok",
    "envelope_blocks": "SELECT conv_id AS doc_id, (turn + 1)::INT AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE WHEN turn = 0 THEN 'title' ELSE 'body' END AS zone, md5(trim(text)) AS text, 3.0::DOUBLE AS x1 FROM conversations WHERE trim(text) <> ''",
    "inferred_zones": "WITH c AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations), l AS (SELECT doc_id, page, unnest([0, 1, 2, 3, 4]) AS seq, unnest(['Report ' || page, substr(text, 1, 20), substr(text, 1, 30), substr(text, 1, 400), 'Page ' || page]) AS t, unnest([9, 20, 14, 10, 9]) AS size, unnest([10, 100, 300, 400, 780]) AS y FROM c), z AS (SELECT doc_id, size, sum(length(t)) AS n FROM l GROUP BY ALL), b AS (SELECT doc_id, arg_max(size, n * 1000 - size) AS body FROM z GROUP BY doc_id), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY doc_id), j AS (SELECT l.*, body, pages, seq = 4 OR seq = 0 AND pages >= 2 AS fur FROM l JOIN b USING (doc_id) JOIN p USING (doc_id)), t AS (SELECT *, NOT fur AND page = 1 AND y < 0.35 * 792 AND size >= 1.3 * body AS top FROM j), x AS (SELECT *, max(CASE WHEN top THEN size END) OVER (PARTITION BY doc_id) AS best FROM t) SELECT doc_id, page, seq, CASE WHEN fur THEN 'furniture' WHEN top AND size = best THEN 'title' WHEN size >= 1.15 * body AND length(t) <= 120 THEN 'heading' ELSE 'body' END AS zone FROM x",
    "bundle_members": f"WITH {_MEM} SELECT * FROM b",
    "bundle_recall": f"WITH {_MEM}, t AS (SELECT DISTINCT bundle, start_page AS page FROM b WHERE start_page > 1), p AS (SELECT bundle, page FROM t WHERE page % 3 <> 0 UNION SELECT bundle, page + 100 FROM t WHERE page % 5 = 0), j AS (SELECT coalesce(p.bundle, t.bundle) AS bundle, p.page IS NOT NULL AS pp, t.page IS NOT NULL AS tt FROM p FULL JOIN t ON p.bundle = t.bundle AND p.page = t.page), g AS (SELECT CASE WHEN bundle % 2 = 0 THEN 'even' ELSE 'odd' END AS shape, * FROM j), c AS (SELECT coalesce(shape, 'all') AS shape, count(*) FILTER (pp AND tt) AS found, count(*) FILTER (NOT pp) AS missed, count(*) FILTER (NOT tt) AS false_ones FROM g GROUP BY GROUPING SETS ((shape), ())) SELECT *, round(found / nullif(found + false_ones, 0), 4) AS precision, round(found / nullif(found + missed, 0), 4) AS recall FROM c",
    "exemplar_texts": rows("doctype_id ord text", [("a", 1, "Form A"), ("a", 2, "Office Form A"), ("a", 3, "top one sure one plain one"), ("a", 4, "un"), ("b", 1, "Form B"), ("c", 1, "Form C"), ("c", 2, "Form Form C")], "VARCHAR INT VARCHAR"),
    "retired_methods": rows("method auc precision", [("sift", 0.568, 0.022), ("skeleton", 0.627, 0.067), ("layout_signature", 0.846, 0.08), ("emblem", 0.554, 0.0)], "VARCHAR DOUBLE DOUBLE"),
    "declared_profiles": f"WITH d AS (SELECT p_brand AS class, 6.0 AS w, p_name AS t FROM part UNION ALL SELECT p_brand, 1.5, p_type FROM part UNION ALL SELECT p_brand, 0.8, 'of the widget' FROM part), k AS (SELECT class, w, {O.tokens(O.skeleton(O.fold('t')))} AS w_ FROM d), one AS (SELECT class, w, unnest(w_) AS term FROM k), two AS (SELECT class, w, unnest(list_transform(range(1, len(w_)), lambda i: w_[i] || ' ' || w_[i + 1])) AS term FROM k) SELECT class, term, round(sum(n), 4)::DOUBLE AS n FROM (SELECT class, term, w AS n FROM one WHERE length(term) > 1 AND term NOT IN {O._STOP} UNION ALL SELECT class, term, 0.75 * w FROM two WHERE NOT (split_part(term, ' ', 1) IN {O._STOP} AND split_part(term, ' ', 2) IN {O._STOP})) GROUP BY class, term",
    "fitted_length": f"SELECT round(avg(len({O.tokens(O.skeleton(O.fold('text')))})), 4) AS average_length FROM documents",
    "considered_types": f"WITH {_SUP}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY support DESC, doctype_id) AS place FROM s WHERE evidence > 0) SELECT doc_id, place, doctype_id, support::DOUBLE AS support FROM k WHERE place <= 4",
    "evidence_trail": f"{_TRAIL} SELECT doc_id, string_agg(tier || ': ' || detail || ' (' || printf('%.4f', weight) || ')', chr(10) ORDER BY tier, k) AS evidence FROM e GROUP BY doc_id",
    "channel_leaders": f"{_TRAIL} SELECT doc_id, tier AS channel, detail AS leader, round(weight, 4)::DOUBLE AS weight FROM e WHERE k = 1",
    "muted_claims": f"{_ZT} SELECT doc_id, 'sealed' AS doctype_id, 0 AS ord FROM zt WHERE contains(skel, {q(' 0f the ')}) AND skel <> '  '",
    "conclusive_owners": f"{_ZT}, claims AS (SELECT {O.skeleton(O.fold('text'))} AS claim FROM anc WHERE decisive GROUP BY ALL HAVING count(DISTINCT doctype_id) > 1), own AS (SELECT DISTINCT h.doc_id, h.doctype_id FROM hits h JOIN anc a ON a.doctype_id = h.doctype_id AND a.ord = h.ord WHERE h.decisive AND {O.skeleton(O.fold('a.text'))} NOT IN (SELECT claim FROM claims)), sure AS (SELECT d.doc_id, 'licensed' AS doctype_id FROM documents d WHERE d.doc_id % 4 = 0 AND (n_chars % 2 = 0 OR EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = d.doc_id AND h.doctype_id = 'licensed'))), o AS (SELECT * FROM own UNION SELECT * FROM sure), one AS (SELECT doc_id, min(doctype_id) AS doctype_id FROM o GROUP BY doc_id HAVING count(*) = 1) SELECT * FROM one WHERE NOT (doctype_id = 'prose_en' AND doc_id % 6 = 0)",
    "identifier_evidence": f"WITH n AS (SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS near, {_D} AS d FROM orders), g AS (SELECT *, {_LUHN.format(d='d')} AND d[1] NOT IN ('0', '8') AS good FROM n) SELECT doc_id, 'card' AS doctype_id, substr(d, 1, 3) || ' ' || substr(d, 4, 3) || ' ' || substr(d, 7) AS value, CASE WHEN good THEN 'sin_luhn' END AS validator, good AS verified, false AS format_ok, good AND near AS corroborated FROM g UNION ALL SELECT doc_id, 'letter', substr(d, 4, 3) || ' ' || substr(d, 7), NULL, false, false, false FROM g",
    "context_blocks": "WITH h AS (SELECT conv_id AS doc_id, turn AS seq, CASE WHEN length(text) % 7 = 0 THEN 1 END AS h FROM conversations), n AS (SELECT *, max(h) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) SELECT doc_id, seq FROM n WHERE near = 1",
    "merged_views": "WITH c AS (SELECT conv_id % 20 AS doc_id, conv_id AS part, turn, role FROM conversations), l AS (SELECT doc_id, string_agg(DISTINCT role, ',' ORDER BY role) AS languages FROM c GROUP BY doc_id) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, turn) AS page, part, turn AS part_page, languages FROM c JOIN l USING (doc_id)",
    "corpus_report": "WITH o AS (SELECT lang, source, CASE WHEN n_chars < 300 THEN 'abstained' WHEN quality = 1 AND toxic = 0 THEN 'correct' ELSE 'wrong' END AS x FROM documents JOIN labels USING (doc_id)), g AS (SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) FILTER (x = 'correct') AS c, count(*) FILTER (x = 'wrong') AS w, count(*) FILTER (x = 'abstained') AS a FROM o GROUP BY GROUPING SETS ((), (lang), (source))) SELECT 0::BIGINT AS ord, '| lang | source | correct | wrong | abstained |' AS line UNION ALL SELECT 1, '| --- | --- | --- | --- | --- |' UNION ALL SELECT row_number() OVER (ORDER BY lang <> '*', source <> '*', lang, source) + 1, '| ' || lang || ' | ' || source || ' | ' || c || ' | ' || w || ' | ' || a || ' |' FROM g",
    "run_summary": "WITH e AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'none' END AS t, (event_id % 97) / 100 AS c, (event_id % 3) / 2 AS f FROM events) SELECT 'documents' AS metric, event_type AS label, count(*)::DOUBLE AS value FROM e GROUP BY ALL UNION ALL SELECT 'doctypes', t, count(*)::DOUBLE FROM e GROUP BY ALL UNION ALL SELECT 'confidence_le', l, (SELECT count(*) FROM e WHERE c <= b)::DOUBLE FROM (VALUES ('0.25', 0.25), ('0.5', 0.5), ('0.75', 0.75), ('0.9', 0.9), ('+Inf', 9.0)) v(l, b) UNION ALL SELECT 'fill_rate', 'mean', round(avg(f), 4) FROM e",
    "json_responses": "SELECT n_nationkey AS doc_id, '{\"doc_id\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"region\":' || CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR ELSE 'null' END || '}' AS body FROM nation",
    "review_list": "SELECT event_id::VARCHAR AS id, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts, event_id::VARCHAR LIMIT 25",
    "reading_order": "WITH b AS (SELECT user_id AS doc_id, event_id AS seq, event_id % 3 AS page, CASE WHEN event_id % 10 > 0 THEN (event_id * 13) % 400 END AS x, CASE WHEN event_id % 10 > 0 THEN (event_id * 7) % 50 * 12 END AS y FROM events), r AS (SELECT *, (y + 5) / 6.0 AS m FROM b) SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page, y IS NULL, round_even(m, 0), x, seq) AS place FROM r",
    "table_overlaps": "SELECT o_orderkey AS doc_id, k AS seq, CASE WHEN o_orderkey % 10 + k * 10 < 18 AND o_orderkey % 10 + k * 10 + 5 > 12 THEN 'table' ELSE 'body' END AS zone FROM orders, range(3) r(k)",
}
