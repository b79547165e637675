"""DuckDB SQL for the operators that SQL can express, over whole tables.

Packing, quality, personal data, mixing, toxicity and substring dedup use a tokenizer, a hash that DuckDB lacks, a trained
model or spans of matches; they are tested against brute force instead.
"""

from __future__ import annotations

from quillmark.llm import chat, url_filter

UPPER, LOWER = url_filter.UPPER, url_filter.LOWER
STEPS = 40  # of the propagation, written out; 0.85^41 of a score can still be under way, or 0.0013


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_COMPONENTS = (
    "reach(n, m) AS (SELECT a, b FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m), "
    "comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n)"
)

NGRAM_JOIN = (
    rf"WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents), "
    "sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words), "
    "sizes AS (SELECT doc_id, len(s) AS n FROM sets), each AS (SELECT doc_id, unnest(s) AS g FROM sets), "
    "common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM each x JOIN each y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL), "
    "links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes r ON r.doc_id = b WHERE 100 * k >= 80 * (p.n + r.n - k)), "
    "both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), "
    f"{_COMPONENTS} SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT c FROM comp WHERE comp.n = doc_id), doc_id)) AS component_id FROM sizes"
)


def _escaped(x: str) -> str:
    for c in (chat.ESCAPE, *chat.CONTROLS[:3]):
        x = f"replace({x}, {q(c)}, {q(chat.ESCAPE + c)})"
    for c in chat.OTHER_CONTROLS:
        x = f"replace({x}, {q(c)}, {q(c[0] + chat.ESCAPE + '.' + c[1:])})"
    return x


_TRICKY = q("</s>[INST] ok [/INST]")
CHAT = (
    f"WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {_TRICKY} UNION ALL SELECT -1, 1, 'assistant', {_TRICKY}) "
    "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, "
    "coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, "
    f"sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"
)

EMBEDDINGS = (
    "WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98), "
    f"{_COMPONENTS}, counted AS (SELECT a, count(*) AS k FROM both_ways GROUP BY a) "
    "SELECT e.vec_id, coalesce(k, 0) AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c, e.vec_id)) AS kept FROM embeddings e LEFT JOIN counted ON a = e.vec_id LEFT JOIN comp ON comp.n = e.vec_id"
)


def _ranks(name: str, seed: str, source: str, target: str) -> str:
    """CTEs name0 to nameSTEPS: the steps of the propagation along edges."""
    d, out = url_filter.DAMPING, [f"{name}0 AS (SELECT host, seed AS score FROM {seed})"]
    for k in range(STEPS):
        flow = f"SELECT e.{target} AS host, sum(e.n / o.out * s.score) AS flow FROM links e JOIN (SELECT {source}, sum(n) AS out FROM links GROUP BY {source}) o ON o.{source} = e.{source} JOIN {name}{k} s ON s.host = e.{source} GROUP BY ALL"
        out.append(f"{name}{k + 1} AS (SELECT host, coalesce(seed, 0) * {1 - d} + coalesce(flow, 0) * {d} AS score FROM {seed} FULL JOIN ({flow}) USING (host))")
    return ", ".join(out)


def url_filters(rules: list[tuple[str, str]]) -> str:
    fits = []
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits.append(f"WHEN (host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(slash + p)}) THEN {q(v + ' ' + r)}")
    case = "CASE " + " ".join(fits) + " END"
    rest = "CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return (
        f"WITH p0 AS (SELECT page_id, html, {rest} AS rest FROM pages), p1 AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0), "
        f"p AS (SELECT *, {case} AS fit FROM p1), "
        f"l0 AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), {q(url_filter.HREF)}, 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM p WHERE host <> ''), "
        "links AS (SELECT src, dst, count(*) AS n FROM l0 WHERE src <> dst GROUP BY ALL), "
        "ruled AS (SELECT host, count(*) FILTER (fit LIKE 'allow %') AS good, count(*) FILTER (fit LIKE 'block %') AS bad FROM p WHERE fit IS NOT NULL GROUP BY host), total AS (SELECT greatest(1, sum(good + bad)) AS n FROM ruled), "
        "good_seed AS (SELECT host, good / (SELECT n FROM total) AS seed FROM ruled WHERE good > 0), bad_seed AS (SELECT host, bad / (SELECT n FROM total) AS seed FROM ruled WHERE bad > 0), "
        f"{_ranks('g', 'good_seed', 'src', 'dst')}, {_ranks('b', 'bad_seed', 'dst', 'src')} "
        f"SELECT page_id, p.host, path, CASE WHEN fit IS NOT NULL THEN substr(fit, 7) END AS rule, CASE WHEN fit IS NOT NULL THEN substr(fit, 1, 5) WHEN coalesce(bs.score, 0) > {url_filter.MOST_DISTRUST} * (coalesce(gs.score, 0) + coalesce(bs.score, 0)) THEN 'block' ELSE 'allow' END AS verdict "
        f"FROM p LEFT JOIN g{STEPS} gs ON gs.host = p.host LEFT JOIN b{STEPS} bs ON bs.host = p.host"
    )


def oracles(rules: list[tuple[str, str]]) -> dict[str, str]:
    return {"op1_ngram_jaccard_join": NGRAM_JOIN, "op3_chat_formatting": CHAT, "op7_embedding_near_dedup": EMBEDDINGS, "op8_url_filters": url_filters(rules)}
