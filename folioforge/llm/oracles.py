"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"

_MEASURES = rf"""
w AS (SELECT doc_id, source, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
                OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM b)
"""

_HOSTS = """
h AS (SELECT source, count(*) AS n, count_if(failed) AS k FROM f GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS tn, sum(k)::DOUBLE AS tk, count(*)::DOUBLE AS th FROM h),
s AS (SELECT any_value(tn) AS tn, any_value(tk) / greatest(any_value(tn), 1) AS p, any_value(th) AS th,
             sum(n * pow(k / n - tk / tn, 2)) AS ss, sum(n * n)::DOUBLE AS n2 FROM h, t),
r AS (SELECT p, least(0.5, greatest(0.001, coalesce(
             (ss - (th - 1) * p * (1 - p)) / nullif(p * (1 - p) * (tn - n2 / tn - th + 1), 0), 0.5)))::DOUBLE AS rho FROM s),
hr AS (SELECT source, n, p, 1 / rho - 1 AS strength, (k + p * (1 / rho - 1)) / (n + (1 / rho - 1)) AS rate FROM h, r),
hv AS (SELECT source, rate, coalesce((rate - p) / nullif(sqrt(greatest(0, rate * (1 - rate)) / (n + strength + 1)), 0), 0) AS z FROM hr)
"""

OP8 = f"""WITH {_MEASURES}, {_HOSTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate >= 0.9 OR (z > -0.2533471031357998 AND failed)) AS kept
FROM f LEFT JOIN hv ON f.source IS NOT DISTINCT FROM hv.source"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS tw,
             coalesce(sum(3 * source_size) OVER c, 0) AS cap_before, coalesce(sum(weight) OVER c, 0) AS w_before,
             count(*) OVER c AS pos
      FROM k WINDOW c AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, (total - cap_before)::DOUBLE / (tw - w_before)::DOUBLE AS lam FROM o),
lv AS (SELECT coalesce(arg_min(lam, pos) FILTER (WHERE weight * lam < 3 * source_size), 1e300) AS lam FROM e),
g AS (SELECT source, source_size, least(weight * lv.lam, (3 * source_size)::DOUBLE)::DOUBLE AS target FROM e, lv),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS copies FROM g),
q AS (SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS after,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS same, count(*) OVER (PARTITION BY d.source, d.h) AS c,
             row_number() OVER (PARTITION BY d.source, d.h) AS rn
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN copies >= 3 THEN 0 WHEN after <= rest THEN 1
                              WHEN same > 0 AND after - same <= rest AND rn <= floor((rest - (after - same)) * c / same + 0.5) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM dwin d JOIN win w ON w.n = d.n AND w.k = d.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id"""

OP5 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{SPACE}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(root) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id"""


_TERMS = rf"""
d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
gt AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
lv AS (SELECT d.lang, count(DISTINCT k.term)::HUGEINT AS v, coalesce(any_value(k.n), 0)::HUGEINT AS total
       FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN (SELECT lang, term, sum(n) OVER (PARTITION BY lang) AS n FROM kept) k USING (lang) GROUP BY d.lang),
g AS (SELECT d.lang, d.source, coalesce(sum(gt.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN gt USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(gt.n, 0) AS n, 1 + (1000000000 * (coalesce(gt.n, 0) + 2)) // (g.total + 2 * lv.v) AS p
      FROM g JOIN lv USING (lang) JOIN kept k USING (lang) LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source AND gt.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 2)) // (lv.total + 2 * lv.v) AS q FROM kept k JOIN lv USING (lang))
"""

OP11 = f"""WITH {_TERMS},
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tm AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pr
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM tm)
WHERE rank <= 10"""

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
_RUN, _ACCESS, _HEX = "[A-Za-z0-9+/_-]{16,}", "AKIA[A-Z0-9]+", "[0-9a-f]+"


def _spans(kind: str, of: str, key: str, text: str, pattern: str) -> str:
    """Matches in a text as rows (key, kind, start, value) by the lengths of all before."""
    return f"""(SELECT {key}, '{kind}' AS kind, m AS value, sum(length(gap) + length(m)) OVER (PARTITION BY {key} ORDER BY i) - length(m) AS start
    FROM (SELECT {key}, i, gaps[i] AS gap, ms[i] AS m
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i
                FROM (SELECT {key}, regexp_split_to_array({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS ms FROM {of}))))"""


OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
cut AS (SELECT r, regexp_split_to_array(t, '{_ASSIGN}') AS ps, regexp_extract_all(t, '{_ASSIGN}') AS ms FROM d),
piece AS (SELECT r, i, ps[i] AS piece, coalesce(sum(length(ps[i]) + coalesce(length(ms[i]), 0)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
          FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM cut)),
runs AS (SELECT s.r, 'owned' AS kind, s.value, s.start + piece.first AS start
         FROM {_spans("owned", "piece", "r, i0", "piece", _RUN).replace("SELECT r, i0, regexp", "SELECT r, i AS i0, regexp")} s JOIN piece ON piece.r = s.r AND piece.i = s.i0
         WHERE regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[A-Za-z]') AND NOT regexp_matches(s.value, 'AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}')),
base AS (SELECT r, kind, start, start + length(value) AS stop, regexp_extract(value, '{_ASSIGN}', 2) AS value FROM {_spans("assign", "d", "r", "t", _ASSIGN)} WHERE length(regexp_extract(value, '{_ASSIGN}', 2)) >= 8
         UNION ALL SELECT r, kind, start, start + length(value), value FROM {_spans("access", "d", "r", "t", _ACCESS)} WHERE length(value) >= 16
         UNION ALL SELECT r, kind, start, start + length(value), value FROM {_spans("hex", "d", "r", "t", _HEX)} WHERE length(value) >= 32),
c AS (SELECT * FROM base UNION ALL SELECT r, kind, start, start + length(value), value FROM runs),
own AS (SELECT value, count(DISTINCT coalesce(lower(string_split(source, '/')[1]), chr(0))) <= 2 AS specific, bool_or(kind = 'assign') AS known
        FROM c JOIN d USING (r) GROUP BY value),
j AS (SELECT r, kind, start, stop, specific FROM c JOIN own USING (value)
      WHERE kind <> 'owned' OR (specific AND (known OR (length(value) >= 20 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
                                                        AND len(list_distinct(string_split(value, ''))) >= 10)))),
s AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, list_position(['assign', 'access', 'hex', 'owned'], kind)) AS spans,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, list_position(['assign', 'access', 'hex'], kind)) FILTER (WHERE kind <> 'owned') AS base,
             count_if(specific) AS n_live, count_if(NOT specific) AS n_example
      FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN s USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op5_ngram_jaccard": OP5, "op8_quality_rules": OP8, "op10_mix_sources": OP10, "op11_source_divergence": OP11, "op13_secret_scan": OP13}
