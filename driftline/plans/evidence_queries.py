"""Evidence, votes, evaluation and vocabulary over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.text import patch_pattern
from driftline.operators import evidence as V
from driftline.operators import symbols as Y
from driftline.plans.common import RANKED_FILES, RANKED_STATEMENTS, STATEMENTS, TRUTH_RANGES, files_sql, ranked_files, ranked_statements, side_files, statements, truth_ranges
from driftline.plans.text_queries import _PT, _TOK
from driftline.runtime import table


def weighted_lines(spark, d):
    return V.weighted_lines(ranked_statements(spark, d), ["pair_index"], 20).select("pair_index", "path", "line", "score")


SQL_LINES = f"""
WITH s AS (SELECT pair_index, path, line, round(sum((CASE method WHEN 'semantic' THEN 1.18 WHEN 'graphqa' THEN 1.10 ELSE 1 END)::DOUBLE * (score + 1.0::DOUBLE / (rank + 2))) + 0.05::DOUBLE * count(DISTINCT method), 6) score FROM {RANKED_STATEMENTS} GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path, line) <= 20"""


def final_files(spark, d):
    f = ranked_files(spark, d).filter("method = 'agent'")
    s = ranked_statements(spark, d).filter("method = 'agent'")
    return V.final_files(f, s, 8).select("pair_index", "path", "score")


SQL_FINAL = f"""
WITH s AS (SELECT pair_index, path, max(score) score FROM (SELECT pair_index, path, score FROM {RANKED_FILES} WHERE method = 'agent' UNION ALL SELECT pair_index, path, score FROM {RANKED_STATEMENTS} WHERE method = 'agent') GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path) <= 8"""


def evidence_files(spark, d):
    f = ranked_files(spark, d).filter("method = 'agent'")
    t = table(spark, d, "target_statements").filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("method") == "agent"))
    s = t.groupBy("pair_index", "path").agg(F.max("score").alias("score"), F.max(F.when(F.col("symbol_score") <= 1, F.col("symbol_score"))).alias("symbol_score"))
    return V.files_from_evidence(f, s, 8).select("pair_index", "path", "score")


SQL_EVIDENCE = f"""
WITH f AS (SELECT pair_index, path, score, 0.55::DOUBLE * score + 0.02::DOUBLE * greatest(0, 21 - rank) v FROM {RANKED_FILES} WHERE method = 'agent'),
s AS (SELECT pair_index, path, max(score) s, coalesce(max(symbol_score) FILTER (symbol_score <= 1), 0) y FROM target_statements WHERE score IS NOT NULL AND NOT isnan(score) AND method = 'agent' GROUP BY ALL),
b AS (SELECT pair_index, path, round(max(v), 6) score FROM (SELECT pair_index, path, v FROM f UNION ALL SELECT s.pair_index, s.path, 0.52::DOUBLE * s.s + 0.35::DOUBLE * coalesce(f.score, 0) + 0.13::DOUBLE * y FROM s LEFT JOIN f ON f.pair_index = s.pair_index AND f.path = s.path) GROUP BY ALL)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path) <= 8"""


def patch_routing(spark, d):
    p = statements(spark, d).filter("side = 'Source'").groupBy("pair_index").agg(F.collect_set("path").alias("paths"), F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n").alias("text"))
    return V.routing(p)


_ANY = lambda c, ws: " OR ".join(f"contains({c}, '{w}')" for w in ws)
SQL_ROUTING = f"""
WITH p AS (SELECT pair_index, lower(string_agg(coalesce(text, ''), chr(10))) t, bool_or(contains(path, '_test.') OR contains(lower(path), '/test')) h FROM {STATEMENTS} WHERE side = 'Source' GROUP BY 1)
SELECT pair_index, h OR {_ANY('t', ['test', 'regression'])} AS test, {_ANY('t', ['func ', 'type ', 'var ', 'const ', 'signature', 'rename', 'refactor'])} AS symbol,
  {_ANY('t', ['delete', 'remove', 'protocol', 'handler', 'flag', 'rpc', 'api', 'json', 'marshal', 'import'])} AS deletion_interface_build FROM p"""


def symbol_impact(spark, d):
    t = V.symbol_terms(statements(spark, d).filter("side = 'Source'"))
    return V.impact_candidates(side_files(spark, d, "Infestor"), t, 0.04, 0.46)


SQL_IMPACT = rf"""
WITH s AS (SELECT pair_index, text FROM {STATEMENTS} WHERE side = 'Source' AND text IS NOT NULL),
w AS (SELECT pair_index, lower(unnest(list_concat(list_concat(regexp_extract_all(text, '\b(?:func|type|var|const)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(text, '\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)), list_filter(regexp_extract_all(text, '{_TOK}'), lambda x: length(x) >= 6)))) t FROM s),
q AS (SELECT pair_index, list(DISTINCT t) terms FROM w GROUP BY 1),
j AS (SELECT pair_index, path, len(list_intersect(a, terms))::DOUBLE / (len(a) + len(terms) - len(list_intersect(a, terms))) j FROM (SELECT pair_index, path, {_PT('path')} a FROM {files_sql('Infestor')}) JOIN q USING (pair_index))
SELECT pair_index, path, round(0.46::DOUBLE + j, 6) AS score FROM j WHERE j > 0.04"""


def prediction_summary(spark, d):
    """File and statement hits of each method's first statements, tolerance 5."""
    r = ranked_statements(spark, d).filter("rank <= 50")
    out = None
    for m in ("agent", "clone", "graphqa", "lexical", "semantic"):
        e = V.summary(V.evaluate(r.filter(F.col("method") == m), truth_ranges(spark, d))).withColumn("method", F.lit(m))
        out = e if out is None else out.unionByName(e)
    return out


SQL_SUMMARY = f"""
WITH r AS (SELECT * FROM {RANKED_STATEMENTS} WHERE rank <= 50), g AS (SELECT * FROM {TRUTH_RANGES}),
f AS (SELECT DISTINCT method, pair_index FROM r SEMI JOIN (SELECT DISTINCT pair_index, path FROM g) USING (pair_index, path)),
s AS (SELECT DISTINCT r.method, r.pair_index FROM r JOIN g ON r.pair_index = g.pair_index AND r.path = g.path AND r.line BETWEEN g."start" - 5 AND g."end" + 5),
n AS (SELECT DISTINCT method, pair_index FROM r)
SELECT n.method, count(*) AS pairs, count(f.pair_index) AS file_hits, count(s.pair_index) AS statement_hits, round(count(f.pair_index) / count(*), 4) AS file_rate, round(count(s.pair_index) / count(*), 4) AS statement_rate
FROM n LEFT JOIN f ON f.method = n.method AND f.pair_index = n.pair_index LEFT JOIN s ON s.method = n.method AND s.pair_index = n.pair_index GROUP BY 1"""


def token_vocabulary(spark, d):
    """The 500 most frequent code tokens of candidate lines, with ids from 2."""
    t = table(spark, d, "target_statements").select(F.explode(F.transform(F.regexp_extract_all("line_text", F.lit(_TOK), F.lit(0)), lambda x: F.lower(x))).alias("token"))
    return V.vocabulary(t, "token", 502)


SQL_VOCAB = rf"SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 1)::INT AS id FROM (SELECT lower(unnest(regexp_extract_all(line_text, '{_TOK}'))) token, count(*) n FROM target_statements GROUP BY 1 ORDER BY n DESC, token LIMIT 500)"


def directional_similarity(spark, d):
    s = statements(spark, d).filter("text is not null")
    return V.directional_similarity(s.filter("side = 'Source'"), s.filter("side = 'Infestor'"))


def statement_evidence(spark, d):
    p = table(spark, d, "target_statements").select("pair_index", "path", "line", "line_text").dropna().distinct()
    return V.statement_evidence(p, statements(spark, d).filter("side = 'Infestor' and kind = 'deleted' and text is not null"))


def intent_blocks(spark, d):
    s = statements(spark, d)
    pattern = s.filter("side = 'Source'").groupBy("pair_index").agg(patch_pattern(F.array_join(F.collect_list("text"), "\n")).alias("pattern"))
    i = Y.source_intents(s.filter("side = 'Source' and text is not null"))
    cand = table(spark, d, "target_statements").filter("target_symbol is not null and path is not null and line_text is not null")
    y = cand.groupBy("pair_index", "path", F.col("target_symbol").alias("name")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_join(F.sort_array(F.collect_set("line_text")), "\n").alias("text"))
    return V.intent_blocks(i, y.join(pattern, "pair_index"), F.col("pattern"))


QUERIES = {
    "weighted_lines": (weighted_lines, SQL_LINES),
    "final_files": (final_files, SQL_FINAL),
    "evidence_files": (evidence_files, SQL_EVIDENCE),
    "patch_routing": (patch_routing, SQL_ROUTING),
    "symbol_impact": (symbol_impact, SQL_IMPACT),
    "prediction_summary": (prediction_summary, SQL_SUMMARY),
    "token_vocabulary": (token_vocabulary, SQL_VOCAB),
    "directional_similarity": (directional_similarity, None),
    "statement_evidence": (statement_evidence, None),
    "intent_blocks": (intent_blocks, None),
}
