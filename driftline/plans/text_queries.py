"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import paths as P
from driftline.functions import text as X
from driftline.plans.common import PATHS, all_paths, strip_sql
from driftline.runtime import table

_TOK = r"[A-Za-z_][A-Za-z0-9_]*|\d+"
_TOK3 = _TOK + r"|[^\sA-Za-z0-9_]"


def path_tokens(spark, d):
    return all_paths(spark, d).select("path", F.explode(P.path_tokens(F.col("path"))).alias("token"))


SQL_PATH_TOKENS = rf"SELECT DISTINCT path, t AS token FROM (SELECT path, unnest(regexp_split_to_array(lower(path), '[/_.\-\s]+')) t FROM {PATHS}) WHERE t <> ''"


def path_kinds(spark, d):
    p = F.col("path")
    return all_paths(spark, d).select(
        "path", P.basename(p).alias("name"), P.dirname(p).alias("dir"), P.extension(p).alias("ext"), P.stem(p).alias("stem"), P.norm_path(p).alias("norm"),
        P.is_test_or_data(p).alias("test"), P.auxiliary_type(p).alias("aux"), P.is_clone_code(p).alias("clone"), P.is_semantic_code(p).alias("semantic"), P.is_plain_go(p).alias("plain_go"),
    )


_BASE = "regexp_extract(path, '[^/]*$')"
_EXT = rf"regexp_extract({_BASE}, '\.([^.]*)$', 1)"
_OUT = r"\.(?:snap|golden|out|rlp|hex)$"
_IN = lambda names: ", ".join(f"'{n}'" for n in names)
SQL_PATH_KINDS = rf"""
SELECT path, {_BASE} AS name, regexp_replace(path, '/?[^/]*$', '') AS dir, {_EXT} AS ext,
  regexp_replace(regexp_replace(regexp_replace(lower({_BASE}), '\.[^.]*$', ''), '_test$', ''), '-test$', '') AS stem, regexp_replace(lower(path), '[_\-/]', '', 'g') AS norm,
  regexp_matches(lower(path), '_test\.|/test/|/tests/|/testdata/|/fixture|{_OUT}') AS test,
  CASE WHEN lower({_BASE}) = 'go.sum' THEN 'dependency_lock' WHEN regexp_matches(lower(path), '\.(?:md|rst|adoc)$|/doc/|/docs/') THEN 'documentation'
    WHEN regexp_matches(lower(path), '/testdata/|/fixture|{_OUT}') THEN 'snapshot_or_test_output' ELSE 'comment_or_other_auxiliary' END AS aux,
  lower({_EXT}) IN ({_IN(P.CLONE_EXTENSIONS)}) AND NOT starts_with(path, '.github/') AND NOT starts_with(path, '.gitea/') AS clone,
  lower({_EXT}) IN ({_IN(P.SEMANTIC_EXTENSIONS)}) OR lower({_BASE}) IN ({_IN(P.SEMANTIC_NAMES)}) AS semantic,
  ends_with(path, '.go') AND NOT ends_with(path, '_test.go') AND NOT ends_with(path, '.pb.go') AND NOT ends_with(path, '_generated.go') AS plain_go
FROM {PATHS}"""


def repo_names(spark, d):
    return table(spark, d, "sides").select("project", P.repo_of(F.col("project")).alias("name")).distinct()


SQL_REPO_NAMES = "SELECT DISTINCT project, regexp_replace(project, '^([^_]*)_', '\\1/') AS name FROM sides"


def statement_predicates(spark, d):
    t = X.strip(F.col("text"))
    return table(spark, d, "patch_statements").select("text").dropna().distinct().select(
        "text", X.meaningful(t).alias("m3"), X.meaningful(t, 2, X.TOKEN_WORD).alias("m2"), X.boilerplate(F.col("text")).alias("frame"),
        F.size(F.regexp_extract_all(t, F.lit(X.TOKEN_ALL), F.lit(0))).alias("tokens"),
    )


_SAYS = "(s = '' OR s IN ('{', '}', '},', ');') OR starts_with(s, '//') OR starts_with(s, '*'))"
SQL_PREDICATES = rf"""
SELECT text, NOT {_SAYS} AND len(regexp_extract_all(s, '{_TOK3}')) >= 3 AS m3, NOT {_SAYS} AND len(regexp_extract_all(s, '{_TOK}')) >= 2 AS m2,
  s IN ({_IN(X.TRIVIAL_MORE)}) OR starts_with(s, 'package ') OR starts_with(s, 'import ') OR starts_with(s, '//') OR starts_with(s, '/*') OR starts_with(s, '*') AS frame,
  len(regexp_extract_all(s, '{_TOK3}'))::INT AS tokens
FROM (SELECT text, {strip_sql('text')} s FROM (SELECT DISTINCT text FROM patch_statements WHERE text IS NOT NULL))"""


def code_shapes(spark, d):
    t = F.col("line_text")
    return table(spark, d, "target_statements").select("line_text").dropna().distinct().select("line_text", X.normalize_code(t).alias("shape"), F.array_join(F.sort_array(X.clone_tokens(t)), " ").alias("clone"), X.clip(t, 30).alias("clip"))


_LIT = r'"(?:\\.|[^"\\])*"|`[^`]*`|\b\d+\b'
_SHAPE = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line_text, '//.*|/\*.*?\*/', ' ', 'gs'), '{_LIT}', ' LIT ', 'g'), '\b[A-Za-z_][A-Za-z0-9_]*\b', ' ID ', 'g'), '\s+', ' ', 'g')"
SQL_SHAPES = rf"""
SELECT line_text, {strip_sql(_SHAPE)} AS shape,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(line_text, '{_LIT}', ' LIT ', 'g'), '{_TOK}'), lambda x: lower(x)), lambda x: length(x) >= 2))), ' ') AS clone,
  substring({strip_sql(r"regexp_replace(line_text, '\s+', ' ', 'g')")}, 1, 30) AS clip
FROM (SELECT DISTINCT line_text FROM target_statements WHERE line_text IS NOT NULL)"""


def symbol_parts(spark, d):
    return table(spark, d, "target_statements").select("target_symbol").dropna().distinct().select("target_symbol", F.array_join(X.split_identifier(F.col("target_symbol")), " ").alias("parts"))


SQL_PARTS = r"SELECT DISTINCT target_symbol, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(target_symbol, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_\W]+'), lambda x: x <> ''), ' ') AS parts FROM target_statements WHERE target_symbol IS NOT NULL"


def line_patterns(spark, d):
    t = F.col("text")
    p = X.patch_pattern(t)
    return table(spark, d, "patch_statements").select("text").dropna().distinct().select("text", p.alias("pattern"), F.round(X.pattern_score(p, t), 6).alias("score"))


def _any(words):
    return " OR ".join(f"contains(low, '{w}')" for w in words)


_PATTERN = "CASE " + " ".join(f"WHEN {_any(ws)} THEN '{n}'" for n, ws in X.PATCH_PATTERNS) + " ELSE 'generic' END"
_SCORE = "CASE pattern " + " ".join(f"WHEN '{n}' THEN least(1.0, ({' + '.join(f'''contains(low, '{w}')::INT''' for w in ws)}) / 3)" for n, ws in X.LINE_WORDS.items()) + " ELSE 0.2 END"
SQL_PATTERNS = f"SELECT text, pattern, round(({_SCORE})::DOUBLE, 6) AS score FROM (SELECT text, low, {_PATTERN} AS pattern FROM (SELECT DISTINCT text, lower(text) low FROM patch_statements WHERE text IS NOT NULL))"


def change_types(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("kind", X.change_type(F.col("text")).alias("change_type")).agg(F.count(F.lit(1)).alias("documents"))


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for n, p in X.CHANGE_TYPES) + " ELSE 'maintenance' END"
SQL_TYPES = f"SELECT kind, {_TYPE} AS change_type, count(*) AS documents FROM (SELECT kind, lower(coalesce(text, '')) low FROM documents) GROUP BY ALL"


def pair_similarity(spark, d):
    a, b = P.path_tokens(F.col("source_file")), P.path_tokens(F.col("target_file"))
    r = table(spark, d, "file_pair_records").select("source_file", "target_file").dropna().distinct()
    return r.select("source_file", "target_file", F.round(X.jaccard(a, b, 1.0), 6).alias("jaccard"), F.round(X.dice_jaccard(a, b), 6).alias("blend"))


_PT = lambda c: rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[/_.\-\s]+'), lambda x: x <> ''))"
SQL_PAIR_SIM = rf"""
SELECT source_file, target_file, round(i / (na + nb - i), 6) AS jaccard, round(0.6 * (2.0::DOUBLE * i / (na + nb)) + 0.4 * (i / (na + nb - i)), 6) AS blend
FROM (SELECT source_file, target_file, len(list_intersect(a, b))::DOUBLE i, len(a) na, len(b) nb FROM (
  SELECT DISTINCT source_file, target_file, {_PT('source_file')} a, {_PT('target_file')} b FROM file_pair_records WHERE source_file IS NOT NULL AND target_file IS NOT NULL))"""


def message_overlap(spark, d):
    """How alike the messages of a pair's two sides are, without stop words."""
    s = table(spark, d, "sides").select("pair_index", "role", "message").distinct()
    a = s.filter("role = 'Source'").select("pair_index", X.message_words(F.col("message")).alias("a"))
    b = s.filter("role = 'Infestor'").select("pair_index", X.message_words(F.col("message")).alias("b"))
    return a.join(b, "pair_index").select("pair_index", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


_MW = rf"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(message, ''), '[A-Za-z_][A-Za-z0-9_]{{2,}}|\d+'), lambda x: lower(x))), lambda x: x NOT IN ({_IN(X.STOP_WORDS)}))"
SQL_MESSAGE = f"""
WITH s AS (SELECT DISTINCT pair_index, role, {_MW} w FROM sides)
SELECT a.pair_index, CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) END AS similarity
FROM s a JOIN s b ON a.pair_index = b.pair_index AND a.role = 'Source' AND b.role = 'Infestor'"""

QUERIES = {
    "path_tokens": (path_tokens, SQL_PATH_TOKENS),
    "path_kinds": (path_kinds, SQL_PATH_KINDS),
    "repo_names": (repo_names, SQL_REPO_NAMES),
    "statement_predicates": (statement_predicates, SQL_PREDICATES),
    "code_shapes": (code_shapes, SQL_SHAPES),
    "symbol_parts": (symbol_parts, SQL_PARTS),
    "line_patterns": (line_patterns, SQL_PATTERNS),
    "change_types": (change_types, SQL_TYPES),
    "pair_similarity": (pair_similarity, SQL_PAIR_SIM),
    "message_overlap": (message_overlap, SQL_MESSAGE),
}
