"""DuckDB SQL for the pN_ queries that SQL can express."""

from driftline.llm import generated as G

P1 = """
WITH s AS (SELECT pair_index, path, line, max(score) v FROM target_statements WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
f AS (SELECT pair_index, path, 0 AS line, max(confidence) v FROM target_files WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL),
r AS (
  SELECT 'statements' AS list_name, *, row_number() OVER (PARTITION BY pair_index ORDER BY v DESC, path, line) k FROM s
  UNION ALL SELECT 'files', *, row_number() OVER (PARTITION BY pair_index ORDER BY v DESC, path) FROM f)
SELECT list_name, pair_index, path, line FROM r WHERE k <= CASE list_name WHEN 'files' THEN 5 ELSE 10 END
"""

_SETS = r"""
WITH d AS (SELECT DISTINCT side_id, unnest(file_names) x FROM sides),
e AS (SELECT DISTINCT side_id, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^(?:\./+)+', '') x FROM d WHERE x IS NOT NULL AND NOT regexp_full_match(x, '\s*')),
n AS (SELECT side_id, count(*) n FROM e WHERE x <> '' GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT e.side_id, x, n FROM e JOIN n USING (side_id) WHERE x <> ''),
o AS (SELECT a.side_id side_id_a, b.side_id side_id_b FROM m a JOIN m b ON a.x = b.x AND a.side_id < b.side_id GROUP BY ALL
  HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6)
"""

P4 = _SETS + "SELECT side_id_a, side_id_b FROM o"

P4_LINKS = _SETS + """,
l AS (SELECT side_id, list_sort(list(x)) s FROM m GROUP BY 1),
c AS (SELECT side_id, min(side_id) OVER (PARTITION BY s) class_side_id FROM l),
k AS (SELECT u, count(*) links FROM (SELECT side_id_a u FROM o UNION ALL SELECT side_id_b FROM o) GROUP BY 1)
SELECT side_id, class_side_id, coalesce(links, 0) links FROM c LEFT JOIN k ON u = side_id
"""

_PLAIN = r"regexp_replace(regexp_replace(lower(regexp_replace({u}, '[?#].*$', '', 's')), '^\s+', ''), '[\s/]+$', '')"
_FORGE = r"^(?:[a-z][a-z+.-]*://)?(?:[^/@]*@)?(?:www\.|api\.)?([^/]+)/(?:repos/)?([^/]+)/([^/]+?)(?:\.git)?/(pull|issue|commit)s?/([0-9a-z]+).*$"


def _artifact(u: str) -> str:
    return rf"CASE WHEN NOT regexp_full_match({u}, '\s*') THEN regexp_replace(regexp_replace({_PLAIN.format(u=u)}, '{_FORGE}', '\1/\2/\3/\4/\5', 's'), '^[a-z]+://(?:www\.)?', '') END"


P3 = rf"""
WITH RECURSIVE c AS (SELECT DISTINCT case_id, {_artifact('source_url')} s, {_artifact('target_url')} t FROM practical_localization_results_14),
n AS (SELECT DISTINCT case_id, unnest([s, t]) a FROM c), k AS (SELECT DISTINCT a FROM n WHERE regexp_matches(a, '/commit/[0-9a-f]{{7,40}}$')),
f AS (SELECT x.a short, min(y.a) nxt, list(y.a) ys FROM k x JOIN k y ON starts_with(y.a, x.a) AND y.a <> x.a GROUP BY 1),
r AS (SELECT short, list_sort(ys)[-1] whole FROM f WHERE len(list_filter(ys, lambda y: NOT starts_with(y, nxt))) = 0),
m AS (SELECT DISTINCT case_id, coalesce(whole, a) a FROM n LEFT JOIN r ON short = a WHERE a IS NOT NULL),
e AS (SELECT DISTINCT x.case_id p, y.case_id q FROM m x JOIN m y USING (a)),
reach AS (SELECT DISTINCT case_id p, case_id q FROM c UNION SELECT reach.p, e.q FROM reach JOIN e ON reach.q = e.p)
SELECT min(q) AS group_case_id, p AS case_id FROM reach WHERE p IS NOT NULL GROUP BY p
"""

_Q = lambda pattern: pattern.replace("'", "''")
_TIDY = lambda c: rf"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^(?:\./+)+', '')"
_NUMBER = r"(?:0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?)"
_RUNS = rf"(?:[A-Za-z0-9+/=_-]{{{G.RUN},}}|(?:\\x?[0-9a-fA-F]{{2,3}}){{20,}}|(?:%[0-9A-Fa-f]{{2}}){{30,}})"


def _of_language(table: dict, i: int) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in table.items() if k != "other") + f" ELSE {table['other'][i]} END"


def _machine_files() -> str:
    lang = r"CASE WHEN ext IN ('js', 'mjs', 'jsx') THEN 'js' WHEN ext IN ('ts', 'tsx') THEN 'ts' WHEN ext = 'css' THEN 'css' WHEN ext = 'py' THEN 'py' WHEN ext IN ('c', 'h', 'cc', 'cpp') THEN 'c' ELSE 'other' END"
    is_ = lambda p: f"regexp_matches(path, '{_Q(p)}')"
    return rf"""
WITH s AS (SELECT DISTINCT side_id, pair_index, role, file_names FROM sides),
l AS (SELECT side_id, {_TIDY('path')} path, text t FROM patch_statements p JOIN (SELECT DISTINCT side_id, pair_index, role FROM s) s ON s.pair_index = p.pair_index AND s.role = p.side),
f AS (SELECT DISTINCT side_id, path FROM (SELECT side_id, {_TIDY('p')} path FROM (SELECT side_id, unnest(file_names) p FROM s) UNION ALL SELECT side_id, path FROM l) WHERE path <> ''),
m AS (SELECT side_id, path, t, length(t) n, length(t) - length(regexp_replace(t, '\s', '', 'g')) white, length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) word,
    len(regexp_extract_all(t, '\b{_NUMBER}\b')) numbers, length(regexp_replace(t, '\b{_NUMBER}[uUlL]*\b|[\s,;{{}}\[\]()]', '', 'g')) besides,
    length(t) - length(regexp_replace(t, '(?:0[xX])?[0-9a-fA-F]{{12,}}', '', 'g')) digits, coalesce(list_sum(list_transform(regexp_extract_all(t, '{_RUNS}'), lambda x: length(x))), 0) encoded,
    regexp_matches(t, '{_Q(G.COMMENT)}') said, {lang} lang
  FROM (SELECT *, regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) ext FROM l WHERE length(t) > 0)),
d AS (SELECT *, CASE WHEN numbers >= 8 AND besides / greatest(n - white, 1) <= 0.1 OR digits / n >= 0.6 AND n >= 40 OR encoded / n >= 0.5 THEN n ELSE 0 END data FROM m),
a AS (SELECT side_id, path, any_value(lang) lang, sum(n) n, max(n) longest, avg(n) mean, sum(white) white, sum(word) word, sum(data) data,
    bool_or(said AND regexp_matches(t, '{_Q(G.GENERATED)}')) gen, bool_or(said AND regexp_matches(t, '{_Q(G.COPIED)}')) cop FROM d GROUP BY 1, 2)
SELECT side_id, path, CASE WHEN {is_(G.PLACES)} THEN 'vendored by place' WHEN {is_(G.NAMES)} THEN 'generated by name' WHEN {is_(G.MINIFIED_NAMES)} THEN 'minified by name' WHEN {is_(G.NO_CODE)} THEN NULL
  WHEN gen THEN 'generated by header' WHEN cop THEN 'vendored by header' WHEN data >= {G.DATA[1]} AND data / n >= {G.DATA[0]} THEN 'data by layout'
  WHEN longest >= {_of_language(G.MINIFIED, 0)} AND mean >= {_of_language(G.MINIFIED, 1)} AND white / n <= {_of_language(G.MINIFIED, 2)} AND word / n <= {_of_language(G.MINIFIED, 3)} THEN 'minified by layout' END reason
FROM f LEFT JOIN a USING (side_id, path)"""


P5 = f"SELECT side_id, path FROM ({_machine_files()}) WHERE reason IS NOT NULL"
P5_REASONS = f"SELECT reason, count(*) AS files FROM ({_machine_files()}) WHERE reason IS NOT NULL GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p3_found": P3, "p3_star_rounds": P3, "p4_found": P4, "p4_links": P4_LINKS, "p5_found": P5, "p5_reasons": P5_REASONS}
