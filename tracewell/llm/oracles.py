"""DuckDB SQL that says independently what the operators return, where SQL can express it."""

from __future__ import annotations

from tracewell.llm import license_scan, quality


def quality_sql() -> str:
    """Operator 1. Groups are small here, so the sketches' quantiles are exact ones: the value of rank ceil(p n)."""
    rate = {"symbols": "n_symbols / greatest(word_chars, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "word_length": "word_chars / greatest(n_words, 1)"}
    quantiles, fences, tests = [], [], []
    for m, (low, high, reach, least, below) in quality.RULES.items():
        quantiles += [f"quantile_disc({m}, {quality.QUANTILES[k]}) AS {m}_{end}" for k, end in ((low, "lower"), (high, "upper"))]
        scale = f"{reach} * greatest({m}_upper - {m}_lower, {least})"
        fences.append((f"high_{m}", f"{m}_upper + {scale}"))
        tests.append(f"{m} <= high_{m}")
        if below:
            fences.append((f"low_{m}", f"{m}_lower - {scale}"))
            tests.append(f"{m} >= low_{m}")
    quantiles, stand = ", ".join(quantiles), ", ".join(f"{e} AS {k}" for k, e in fences)
    weight = f"({quality.PRIOR_ROWS} / CAST({{0}}.n + {quality.PRIOR_ROWS} AS DOUBLE))"
    drawn = lambda own, above: ", ".join(f"{own}.{k} + ({above}.{k} - {own}.{k}) * {weight.format(own)} AS {k}" for k, _ in fences)
    level = lambda *by: f"SELECT {''.join(f'{b}, ' for b in by)}n, {stand} FROM (SELECT {''.join(f'{b}, ' for b in by)}count(*) AS n, {quantiles} FROM x WHERE NOT base_failed{' GROUP BY ' + ', '.join(by) if by else ''})"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g5 AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g5) WHERE c > 1),
cov AS (SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT t.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t JOIN w USING (r) LEFT JOIN cov USING (r)),
x AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, {', '.join(f'{e} AS {k}' for k, e in rate.items())} FROM m),
g AS ({level("lang", "source")}), h AS ({level("lang")}), e AS ({level()}),
hl AS (SELECT h.lang, {drawn("h", "e")} FROM h, e),
l AS (SELECT g.lang, g.source, {drawn("g", "hl")} FROM g JOIN hl ON g.lang IS NOT DISTINCT FROM hl.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {' AND '.join(tests)}, false) AS kept
FROM x LEFT JOIN l ON x.lang IS NOT DISTINCT FROM l.lang AND x.source IS NOT DISTINCT FROM l.source
"""


def license_sql() -> str:
    """Operator 8, on word sequences: phrases by their words, notices by pairs on diagonals that are merged and verified."""
    table = ", ".join(f"({n}, '{label}', {str(n < len(license_scan.BASE)).lower()}, {len(text.split()) - 1}, '{text}')" for n, (text, label) in enumerate([*license_scan.BASE.items(), *license_scan.NOTICES.items()]))
    share = f"CASE WHEN size < {license_scan.WHOLE} THEN size ELSE {license_scan.SHARE} * size END"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
k(template, label, base, size, text) AS (VALUES {table}),
kp AS (SELECT template, label, base, size, i - 1 AS t, string_split(text, ' ')[i] || ' ' || string_split(text, ' ')[i + 1] AS pair FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM k)),
dp AS (SELECT r, i - 1 AS p, ws[i] || ' ' || ws[i + 1] AS pair FROM (SELECT r, ws, unnest(range(1, len(ws))) AS i FROM t)),
v AS (SELECT r, template, label, base, size, t, p, p - t AS d FROM dp JOIN kp USING (pair)),
dg AS (SELECT r, template, label, base, size, d, count(*) AS votes FROM v GROUP BY ALL),
ph AS (SELECT r, label, d AS start FROM dg WHERE base AND votes = size),
sp AS (SELECT r, template, d, sum(apart) OVER (PARTITION BY r, template ORDER BY d) AS span FROM (SELECT r, template, d, CASE WHEN d - lag(d) OVER (PARTITION BY r, template ORDER BY d) <= {license_scan.MERGE} THEN 0 ELSE 1 END AS apart FROM dg WHERE NOT base)),
fs AS (SELECT v.r, v.template, v.label, v.size, span, count(DISTINCT t) AS pairs, max(p) + 2 - min(p) AS words FROM v JOIN sp ON v.r = sp.r AND v.template = sp.template AND v.d = sp.d GROUP BY ALL),
found AS (SELECT r, label, true AS base, start, 1.0 AS score FROM ph UNION ALL SELECT r, label, false, NULL, pairs / size FROM fs WHERE pairs >= {share} AND pairs >= {license_scan.DENSITY} * words),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM t LEFT JOIN a USING (r)
"""


def hard_negatives_sql() -> str:
    """Operator 11, by all pairs of anchors and rows."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def merkle_sql() -> str:
    """Operator 12: trees and folds as recursions over levels; CRC-32 bit by bit."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda n_chars: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"
    level = lambda tree: f"SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {tree} WHERE n > 1 GROUP BY g, level, i // 2, n"
    beside = lambda tree, at: f"SELECT r, level, string_agg(d, '' ORDER BY i) AS d FROM (SELECT s.r, t.level, t.i, t.d FROM {at} s JOIN {tree} t ON s.g = t.g AND t.i // 2 = (s.i >> t.level) // 2 AND t.i <> (s.i >> t.level) AND t.n > 1) GROUP BY r, level"
    step = "sha256(CASE WHEN (f.i >> f.level) % 2 = 1 THEN coalesce(b.d, '') || f.d ELSE f.d || coalesce(b.d, '') END)"
    return rf"""
WITH RECURSIVE c AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS crc FROM documents),
h AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS shown FROM c),
l AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
t(g, level, i, n, d) AS (SELECT g, 0, i, n, leaf FROM l UNION ALL {level("t")}),
subs AS (SELECT g, d FROM t WHERE n = 1),
u0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d, row_number() OVER () AS r FROM subs),
u(g, level, i, n, d) AS (SELECT g, 0, i, n, d FROM u0 UNION ALL {level("u")}),
b AS ({beside("t", "l")}), ub AS ({beside("u", "u0")}),
f(r, i, n, level, d) AS (SELECT r, i, n, 0, shown FROM l UNION ALL SELECT f.r, f.i, (f.n + 1) // 2, f.level + 1, {step} FROM f LEFT JOIN b ON f.r = b.r AND f.level = b.level WHERE f.n > 1),
uf(r, ur, i, n, level, d) AS (SELECT f.r, u0.r, u0.i, u0.n, 0, f.d FROM f JOIN l ON f.r = l.r JOIN u0 ON l.g = u0.name WHERE f.n = 1 UNION ALL SELECT f.r, f.ur, f.i, (f.n + 1) // 2, f.level + 1, {step} FROM uf f LEFT JOIN ub b ON f.ur = b.r AND f.level = b.level WHERE f.n > 1),
p AS (SELECT r, string_agg(d, '' ORDER BY level) AS d FROM b GROUP BY r), up AS (SELECT r, string_agg(d, '' ORDER BY level) AS d FROM ub GROUP BY r)
SELECT l.doc_id, l.leaf, u0.d AS subroot, u.d AS root, sha256(coalesce(p.d, '') || coalesce(up.d, '')) AS proof_sha256, uf.d AS folded_root, uf.d = u.d AS verified
FROM l JOIN u0 ON l.g = u0.name JOIN u ON u.n = 1 LEFT JOIN p ON l.r = p.r LEFT JOIN up ON u0.r = up.r JOIN uf ON l.r = uf.r AND uf.n = 1
"""
