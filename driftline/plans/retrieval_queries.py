"""Finding files and lines, diffs, symbols, graphs and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.functions import vectors as V
from driftline.functions.paths import tidy
from driftline.operators import diff as D
from driftline.operators import evidence as E
from driftline.operators import history as H
from driftline.operators import judge as J
from driftline.operators import ranking as R
from driftline.operators import retrieval as T
from driftline.operators import statements as S
from driftline.operators import symbols as Y
from driftline.operators.empirical import parse_time
from driftline.plans.common import RANKED_FILES, STATEMENTS, files_sql, ranked_files, ranked_statements, side_files, statements, strip_sql, tidy_sql
from driftline.plans.text_queries import _PT, _TOK, _TOK3
from driftline.runtime import table
from driftline.sources import bronze as B


def _sources(spark, d):
    return side_files(spark, d, "Source")


def _targets(spark, d):
    return side_files(spark, d, "Infestor")


_S, _T = files_sql("Source"), files_sql("Infestor")


def token_file_topk(spark, d):
    """Five target files of a pair that share most path tokens with a source file."""
    best = T.best_source(T.token_pairs(_sources(spark, d), _targets(spark, d)))
    return R.top_k(best, ["pair_index"], [F.col("score").desc(), F.col("path")], 5)


SQL_TOKEN_TOPK = f"""
WITH p AS (SELECT s.pair_index, s.path source_path, t.path, {_PT('s.path')} a, {_PT('t.path')} b FROM {_S} s JOIN {_T} t USING (pair_index)),
j AS (SELECT pair_index, source_path, path, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) score FROM p),
m AS (SELECT pair_index, path, score, source_path matched_source_path FROM j QUALIFY row_number() OVER (PARTITION BY pair_index, path ORDER BY score DESC, source_path) = 1)
SELECT *, row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path)::INT AS rank FROM m QUALIFY rank <= 5"""


def exact_counterparts(spark, d):
    return T.exact_counterparts(_sources(spark, d), _targets(spark, d))


def proposed_files(spark, d):
    return T.proposed_files(_sources(spark, d), _targets(spark, d))


def auxiliary_files(spark, d):
    a = T.auxiliary(_sources(spark, d), _targets(spark, d))
    return a.select("pair_index", "source_path", "path", F.round("score", 6).alias("score"), "action")


_B = lambda c: f"regexp_extract({c}, '[^/]*$')"
_D = lambda c: f"regexp_replace({c}, '/?[^/]*$', '')"
SQL_AUX = f"""
WITH s AS (SELECT pair_index, path source_path, {_B('path')} name FROM {_S} WHERE {_B('path')} <> '.gitignore'), t AS (SELECT pair_index, path, {_B('path')} name FROM {_T}),
h AS (SELECT s.pair_index, source_path, t.path, CASE WHEN t.path = source_path THEN 1 ELSE round(0.78::DOUBLE + 0.08::DOUBLE * ({_D('t.path')} = {_D('source_path')})::INT, 6) END score, CASE WHEN t.path = source_path THEN 'exact' ELSE 'same_name' END AS action FROM s JOIN t USING (pair_index, name))
SELECT pair_index, source_path, path, score::DOUBLE score, action FROM h UNION ALL SELECT pair_index, source_path, source_path, 0.72::DOUBLE, 'new_file' FROM s ANTI JOIN h USING (pair_index, source_path)"""


def judgement_records(spark, d):
    """Judgements built from mapping scores: the best source of every target, the best target of the sources left over."""
    r = table(spark, d, "file_pair_records").groupBy("pair_index", F.col("source_file").alias("source_path"), F.col("target_file").alias("path")).agg(F.max("mapping_score").alias("score"))
    return T.judgements(r)


SQL_JUDGEMENTS = """
WITH r AS (SELECT pair_index, source_file source_path, target_file path, max(mapping_score) score FROM file_pair_records GROUP BY ALL),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pair_index, path ORDER BY score DESC, source_path DESC) = 1),
b AS (SELECT * FROM r ANTI JOIN a USING (pair_index, source_path) QUALIFY row_number() OVER (PARTITION BY pair_index, source_path ORDER BY score DESC, path DESC) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b"""


def clone_retrieval(spark, d):
    """For every release note the five design documents most alike by code tokens."""
    docs = table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", "text", "kind")
    return T.clone_topk(docs.filter("kind = 'release_note'"), docs.filter("kind = 'design'").select(F.col("doc_id").alias("other_id"), "text"), "doc_id", "other_id", 5)


_CT = rf"""list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '"(?:\\.|[^"\\])*"|`[^`]*`|\b\d+\b', ' LIT ', 'g'), '{_TOK}'), lambda x: lower(x)), lambda x: length(x) >= 2))"""
SQL_CLONE = f"""
WITH d AS (SELECT doc_id, kind, {_CT} t FROM documents WHERE length(text) > 0 AND kind IN ('release_note', 'design')),
q AS (SELECT doc_id, len(t) nq, unnest(t) x FROM d WHERE kind = 'release_note'), e AS (SELECT doc_id other_id, len(t) nd, unnest(t) x FROM d WHERE kind = 'design'),
c AS (SELECT doc_id, other_id, nq, nd, count(*) c FROM q JOIN e USING (x) GROUP BY ALL)
SELECT doc_id, other_id, round(0.6::DOUBLE * (2.0::DOUBLE * c / (nq + nd)) + 0.4::DOUBLE * (c / (nq + nd - c)), 6) score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_id)::INT AS rank FROM c QUALIFY rank <= 5"""


def clone_retrieval_all(spark, d):
    """The five documents of any kind most alike by code tokens to every document whose id is divisible by 50."""
    docs = table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    # A document may be its own nearest: one more is asked for and the document itself left out.
    near = T.clone_topk(docs.filter("doc_id % 50 = 0"), docs.select(F.col("doc_id").alias("other_id"), "text"), "doc_id", "other_id", 6).filter("doc_id <> other_id").drop("rank")
    return R.top_k(near, ["doc_id"], [F.col("score").desc(), F.col("other_id")], 5)


def chunk_counts(spark, d):
    """Chunks of every document: lines, then windows of 3 and 6 lines."""
    docs = table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    c = T.clone_chunks(docs, ["doc_id"])
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk").alias("last"), F.sum(F.size("tokens")).alias("tokens"))


def chunk_retrieval(spark, d):
    """Target files whose chunks are most alike to a chunk of a source file, five per pair, over shown lines."""
    s = statements(spark, d).filter(X.meaningful(F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line_no", "text"))), lambda x: x["text"]), "\n").alias("text")
    side = lambda role: T.clone_chunks(s.filter(F.col("side") == role).groupBy("pair_index", "path").agg(text), ["pair_index", "path"])
    return R.top_k(T.clone_chunk_scores(side("Source"), side("Infestor")), ["pair_index"], [F.col("score").desc(), F.col("path")], 5)


_TOKENS = lambda c: rf"""list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({c}, '"(?:\\.|[^"\\])*"|`[^`]*`|\b\d+\b', ' LIT ', 'g'), '{_TOK}'), lambda y: lower(y)), lambda y: length(y) >= 2))"""
_WINDOWS = lambda w: f"list_filter(list_transform(range(1, greatest(len(ls), 1) + 1, {w}), lambda s: {_TOKENS(f'array_to_string(ls[s:s + {w - 1}], chr(10))')}), lambda t: len(t) >= 5)"


def _chunks_sql(keys: str, source: str) -> str:
    """(keys, cs): the chunks of each text of a table, as lists of tokens."""
    return f"""(SELECT {keys}, CASE WHEN len(cs) <= 80 THEN cs ELSE list_transform(range(0, 80), lambda i: cs[(i * len(cs)) // 80 + 1]) END cs FROM (
  SELECT {keys}, list_concat(list_concat(list_filter(list_transform(ls, lambda x: {_TOKENS('x')}), lambda t: len(t) >= 3), {_WINDOWS(3)}), {_WINDOWS(6)}) cs FROM (
    SELECT {keys}, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') ls FROM {source})) WHERE len(cs) > 0)"""


SQL_CHUNK_COUNTS = f"SELECT doc_id, len(cs) AS chunks, (len(cs) - 1)::INT AS last, list_sum(list_transform(cs, lambda t: len(t)))::BIGINT AS tokens FROM {_chunks_sql('doc_id', '(SELECT doc_id, text FROM documents WHERE length(text) > 0)')}"
_MEANS = lambda x: f"(text IS NOT NULL AND NOT ({x} = '' OR {x} IN ('{{', '}}', '}},', ');') OR starts_with({x}, '//') OR starts_with({x}, '*')) AND len(regexp_extract_all({x}, '{_TOK3}')) >= 3)"
_SHOWN_TEXT = lambda role: f"(SELECT pair_index, path, string_agg(text, chr(10) ORDER BY ord, line_no, text) AS text FROM {STATEMENTS} WHERE side = '{role}' AND {_MEANS('text')} GROUP BY ALL)"
_UNFOLD = lambda role: f"(SELECT pair_index, path, n, len(c) size, unnest(c) t FROM (SELECT pair_index, path, unnest(cs) c, unnest(range(0, len(cs))) n FROM {_chunks_sql('pair_index, path', _SHOWN_TEXT(role))}))"
SQL_CHUNK_RETRIEVAL = f"""
WITH c AS (SELECT a.pair_index, a.path sp, a.n sn, b.path, b.n tn, a.size na, b.size nb, count(*) c FROM {_UNFOLD('Source')} a JOIN {_UNFOLD('Infestor')} b ON a.pair_index = b.pair_index AND a.t = b.t GROUP BY ALL),
m AS (SELECT pair_index, path, round(max(0.6::DOUBLE * (2.0::DOUBLE * c / (na + nb)) + 0.4::DOUBLE * (c::DOUBLE / (na + nb - c))), 6) score FROM c GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path)::INT AS rank FROM m QUALIFY rank <= 5"""


def path_score_topk(spark, d):
    """Five target files of a pair by their best path score."""
    return T.rank_files(_sources(spark, d), _targets(spark, d), 5)


def prefilter_topk(spark, d):
    """Eight target files of a pair by path score and terms of the source patch."""
    terms = T.terms_of(statements(spark, d).filter("side = 'Source'"))
    return T.path_prefilter(_sources(spark, d), _targets(spark, d), terms, 8)


def high_recall_topk(spark, d):
    terms = T.terms_of(statements(spark, d).filter("side = 'Source'"))
    return T.high_recall(_sources(spark, d), _targets(spark, d), terms, 8)


def companion_files(spark, d):
    return T.companions(_sources(spark, d), _targets(spark, d), 8)


def neighbour_files(spark, d):
    ranked = ranked_files(spark, d).filter("method = 'agent'").select("pair_index", "path", "score", "rank")
    return T.neighbours(ranked, _targets(spark, d), _sources(spark, d))


_EXTENSION = lambda c: rf"regexp_extract({_B(c)}, '\.([^.]*)$', 1)"
_STEM = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(lower({_B(c)}), '\.[^.]*$', ''), '_test$', ''), '-test$', '')"
_TESTS = lambda c: rf"regexp_matches(lower({c}), '_test\.|/test/|/tests/|/testdata/|/fixture|\.(?:snap|golden|out|rlp|hex)$')"
SQL_NEIGHBOURS = f"""
WITH c AS (SELECT pair_index, path, score, rank FROM {RANKED_FILES} WHERE method = 'agent'), n AS (SELECT DISTINCT pair_index, {_B('path')} name FROM {_S}),
p AS (SELECT c.pair_index, t.path, c.score, c.path AS near FROM c JOIN {_T} t ON t.pair_index = c.pair_index AND {_D('t.path')} = {_D('c.path')} AND {_EXTENSION('t.path')} = {_EXTENSION('c.path')} AND t.path <> c.path WHERE rank <= 20),
k AS (SELECT p.pair_index, p.path, round(max(score) * 0.92::DOUBLE, 6) AS score FROM p LEFT JOIN n ON n.pair_index = p.pair_index AND n.name = {_B('p.path')} WHERE n.name IS NOT NULL OR ({_STEM('p.path')} = {_STEM('p.near')} AND {_TESTS('p.path')} <> {_TESTS('p.near')}) GROUP BY ALL)
SELECT * FROM k ANTI JOIN c USING (pair_index, path)"""


def source_terms(spark, d):
    t = T.terms_of(statements(spark, d).filter("side = 'Source'"))
    return t.select("pair_index", F.array_join("terms", " ").alias("terms"))


SQL_TERMS = f"""
WITH s AS (SELECT * FROM {STATEMENTS} WHERE side = 'Source'),
w AS (SELECT pair_index, unnest({_PT('path')}) t FROM s UNION SELECT pair_index, unnest(list_filter(list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: lower(x)), lambda x: length(x) >= 3)) FROM s)
SELECT pair_index, string_agg(t, ' ' ORDER BY t) AS terms FROM w GROUP BY 1"""


def cosine_topk(spark, d):
    """Five nearest vectors of every vector whose id is divisible by 50, against all."""
    e = table(spark, d, "embeddings")
    return T.vector_topk(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


SQL_COSINE = """
WITH q AS (SELECT vec_id query_id, embedding::DOUBLE[64] v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, embedding::DOUBLE[64] v FROM embeddings),
s AS (SELECT query_id, vec_id, round(array_cosine_similarity(q.v, e.v), 6) score FROM q JOIN e ON vec_id <> query_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5"""


def label_vectors(spark, d):
    """The mean unit vector of each label, by place."""
    m = V.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("vector").alias("place", "x")).withColumn("x", F.round("x", 6))


SQL_LABELS = """
WITH u AS (SELECT label, vec_id, unnest(generate_series(0, 63)) place, unnest(embedding)::DOUBLE x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) n FROM u GROUP BY 1),
m AS (SELECT label, place, avg(x / n) x FROM u JOIN n USING (vec_id) GROUP BY ALL), k AS (SELECT label, sqrt(sum(x * x)) n FROM m GROUP BY 1)
SELECT label, place::INT AS place, round(x / n, 6) AS x FROM m JOIN k USING (label)"""


def _one_line(s: DataFrame) -> DataFrame:
    """Statements with a text, as one line of a diff each (an inner line end would begin another line there)."""
    return s.filter("text is not null").withColumn("text", F.regexp_replace("text", r"[\r\n]+", " "))


def _patches(spark, d) -> DataFrame:
    """A unified diff of every shown file, put together from its statements: a hunk for each."""
    s = _one_line(statements(spark, d))
    sign = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "deleted", "-").otherwise(" ")
    hunk = F.concat(F.lit("@@ -"), F.col("line_no"), F.lit(",1 +"), F.col("line_no"), F.lit(",1 @@\n"), sign, F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "line_no", hunk.alias("h"))))
    return s.groupBy("pair_index", "side", "path").agg(F.array_join(F.transform(parts, lambda x: x["h"]), "\n").alias("patch"))


# A deleted line that begins with -- and an added one that begins with ++ read like the header of a file, which a diff's reader skips.
_LINE = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"
_SHOWN = f"(SELECT *, {strip_sql(_LINE)} s FROM {STATEMENTS} WHERE text IS NOT NULL AND NOT (kind = 'added' AND starts_with({_LINE}, '++')) AND NOT (kind = 'deleted' AND starts_with({_LINE}, '--')))"


def diff_statements(spark, d):
    return D.patch_statements(_patches(spark, d), ["pair_index", "side", "path"]).select("pair_index", "side", "path", "line_no", "kind", "text")


SQL_DIFF = rf"SELECT pair_index, side, path, line_no, kind, s AS text FROM {_SHOWN} WHERE NOT (s = '' OR s IN ('{{', '}}', '}},', ');') OR starts_with(s, '//') OR starts_with(s, '*')) AND len(regexp_extract_all(s, '{_TOK3}')) >= 3"


def diff_ranges(spark, d):
    return D.changed_ranges(_patches(spark, d), ["pair_index", "side", "path"]).select("pair_index", "side", "path", "start", "end")


SQL_RANGES = f"SELECT pair_index, side, path, CASE kind WHEN 'added' THEN greatest(line_no - 1, 1) ELSE line_no END AS start, CASE kind WHEN 'added' THEN greatest(line_no, greatest(line_no - 1, 1)) ELSE line_no END AS \"end\" FROM {_SHOWN} WHERE kind <> 'context'"


def diff_ground_truth(spark, d):
    """Edited, deleted and new statements, one hunk per file."""
    s = _one_line(statements(spark, d))
    sign = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "deleted", "-").otherwise(" ")
    parts = F.array_sort(F.collect_list(F.struct("ord", "line_no", F.concat(sign, F.col("text")).alias("h"))))
    p = s.groupBy("pair_index", "side", "path").agg(F.concat(F.lit("@@ -1,1 +1,1 @@\n"), F.array_join(F.transform(parts, lambda x: x["h"]), "\n")).alias("patch"))
    return D.statement_ground_truth(p, ["pair_index", "side", "path"])


def source_intents(spark, d):
    i = Y.source_intents(statements(spark, d).filter("side = 'Source'"))
    return i.select("pair_index", "path", "symbol", "intent", F.size("lines").alias("lines"), F.array_join("texts", "\n").alias("texts"))


SQL_INTENTS = f"""
SELECT pair_index, path, 'line_bucket_' || (line_no // 20) AS symbol, CASE kind WHEN 'added' THEN 'insert' ELSE 'delete' END AS intent, count(*)::INT AS lines, string_agg(text, chr(10) ORDER BY ord, line_no, text) AS texts
FROM {STATEMENTS} WHERE side = 'Source' AND kind IN ('added', 'deleted') GROUP BY pair_index, path, line_no // 20, 2, 3, 4""".replace("GROUP BY pair_index, path, line_no // 20, 2, 3, 4", "GROUP BY ALL")


def declaration_lines(spark, d):
    """Declarations among the shown lines of each file, by their first word."""
    s = statements(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line_no", "text"))), lambda x: F.regexp_replace(x["text"], r"[\r\n]", " ")), "\n").alias("text")
    files = s.filter("text is not null").groupBy("pair_index", "side", "path").agg(text)
    return Y.fallback_symbols(files, ["pair_index", "side", "path"]).groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("name").alias("names"))


SQL_DECL = rf"SELECT regexp_extract(s, '^(func|type|var|const)', 1) AS kind, count(*) AS symbols, count(DISTINCT regexp_extract(s, '^(?:func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)', 1)) AS names FROM (SELECT {strip_sql('text')} s FROM {STATEMENTS} WHERE text IS NOT NULL) WHERE regexp_matches(s, '^(?:func|type|var|const)\b') GROUP BY 1"


def parsed_symbols(spark, d):
    s = statements(spark, d).filter("text is not null and side = 'Infestor'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line_no", "text"))), lambda x: x["text"]), "\n").alias("text")
    return Y.parse_symbols(s.groupBy("pair_index", "path").agg(text), ["pair_index", "path"])


_LOOK = rf"""
WITH f AS (SELECT pair_index, path, string_agg(text, chr(10) ORDER BY ord, line_no, text) t FROM {STATEMENTS} WHERE text IS NOT NULL AND side = 'Infestor' GROUP BY ALL),
g AS (SELECT pair_index, path, string_split(regexp_replace(t, '\r\n?|[\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)) ls FROM f WHERE t <> ''),
h AS (SELECT pair_index, path, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END ls FROM g),
l AS (SELECT pair_index, path, len(ls) total, unnest(ls) line, unnest(range(1, len(ls) + 1)) n FROM h),
c AS (SELECT *, regexp_replace(line, '//.*', '') code FROM l),
e AS (SELECT *, length(code) - length(replace(code, '{{', '')) up, length(code) - length(replace(code, '}}', '')) down FROM c),
p AS (SELECT *, sum(up - down) OVER (PARTITION BY pair_index, path ORDER BY n) depth FROM e),
d AS (SELECT *, regexp_extract(line, '{{decl}}', ['word', 'receiver', 'name']) m FROM p WHERE regexp_matches(line, '{{decl}}')),
w AS (SELECT d.pair_index, d.path, d.n, d.m, d.total, d.line, d.depth - d.up + d.down AS before, p.n k, p.depth, {strip_sql('p.line')} = '' AS gap, min(CASE WHEN p.up > 0 THEN p.n END) OVER (PARTITION BY d.pair_index, d.path, d.n) opens
  FROM d JOIN p ON p.pair_index = d.pair_index AND p.path = d.path AND p.n BETWEEN d.n AND d.n + 400)
SELECT pair_index, path, CASE WHEN m.word = 'func' AND m.receiver <> '' THEN 'method' ELSE m.word END AS kind, m.name AS name, nullif(m.receiver, '') AS receiver, n::INT AS start_line,
  coalesce(min(CASE WHEN gap AND k > n AND (opens IS NULL OR k < opens) THEN k - 1 END), min(CASE WHEN k >= opens AND depth <= before THEN k END), least(any_value(total), n + 80))::INT AS end_line, left({strip_sql('any_value(line)')}, 300) AS signature
FROM w GROUP BY pair_index, path, n, m"""
SQL_PARSED = _LOOK.replace("{decl}", r"^\s*(func|type|var|const)\s+(?:(\([^)]*\))\s*)?([A-Za-z_][A-Za-z0-9_]*)")


def _tree(spark, d):
    s = table(spark, d, "sides").select("repo", F.explode("file_names").alias("p"))
    return s.select("repo", tidy(F.col("p")).alias("path")).filter("path <> ''").distinct()


_TREE = f"(SELECT DISTINCT repo, {tidy_sql('p')} path FROM (SELECT repo, unnest(file_names) p FROM sides) WHERE {tidy_sql('p')} <> '')"


def graph_edges(spark, d):
    return Y.structure_graph(_tree(spark, d), "repo", "path")[1]


def graph_nodes(spark, d):
    return Y.structure_graph(_tree(spark, d), "repo", "path")[0]


_STEPS = f"SELECT repo, ps, unnest(generate_series(1, len(ps))) d FROM (SELECT repo, string_split(path, '/') ps FROM {_TREE})"
_HERE = "array_to_string(ps[1:d], '/')"
_KIND = "CASE WHEN d = len(ps) THEN 'file' ELSE 'dir' END"
SQL_EDGES = f"SELECT DISTINCT CASE WHEN d = 1 THEN 'repo::' || repo ELSE 'dir::' || repo || '::' || array_to_string(ps[1:d - 1], '/') END AS source, {_KIND} || '::' || repo || '::' || {_HERE} AS target, 'contains' AS kind FROM ({_STEPS})"
SQL_NODES = rf"SELECT DISTINCT {_KIND} || '::' || repo || '::' || {_HERE} AS id, {_KIND} AS kind, repo, {_HERE} AS path, CASE WHEN d = len(ps) THEN lower(regexp_extract(ps[d], '\.([^.]*)$', 1)) ELSE '' END AS extension FROM ({_STEPS}) UNION SELECT 'repo::' || repo, 'repo', repo, '', '' FROM {_TREE}"


def interval_hits(spark, d):
    """Predicted statements within two lines of a changed range of the downstream side."""
    from driftline.plans.common import truth_ranges

    r = ranked_statements(spark, d).select("pair_index", "path", "line").distinct()
    g = truth_ranges(spark, d).select("pair_index", "path", (F.col("start") - 2).alias("start_line"), (F.col("end") + 2).alias("end_line"))
    return S.enclosing(r, g, ["pair_index", "path"]).select("pair_index", "path", "line").distinct()


def _hits_sql():
    from driftline.plans.common import RANKED_STATEMENTS, TRUTH_RANGES

    return f'SELECT DISTINCT r.pair_index, r.path, r.line FROM {RANKED_STATEMENTS} r JOIN {TRUTH_RANGES} g ON r.pair_index = g.pair_index AND r.path = g.path AND r.line BETWEEN g."start" - 2 AND g."end" + 2'


def insert_anchors(spark, d):
    r = ranked_statements(spark, d).filter("rank <= 10").withColumn("module", F.col("method"))
    return S.insert_anchors(R.blocks_of(r, ["pair_index"]))


def line_ranking(spark, d):
    """Candidate lines by their most similar source statement and their file's confidence, ten per pair."""
    lines = table(spark, d, "target_statements").select("pair_index", "path", "line", F.col("line_text").alias("text")).dropna().distinct()
    best = ranked_files(spark, d).filter("method = 'agent' and rank <= 5")
    matched = table(spark, d, "target_files").groupBy("pair_index", "path").agg(F.min("matched_source_path").alias("matched_source_path"))
    files = best.join(matched, ["pair_index", "path"], "left").select("pair_index", "path", "score", "matched_source_path")
    sources = S.comparable(statements(spark, d).filter("side = 'Source'"), files)
    return S.rank_statements(lines.join(files.select("pair_index", "path"), ["pair_index", "path"], "left_semi"), sources, files, 10)


def asof_snapshot(spark, d):
    """Of every purchase the user's last view at or before it."""
    e = table(spark, d, "events")
    return H.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id")), "user_id", "ts", "ts", "view_id", "view_id")


SQL_ASOF = """
SELECT p.event_id, p.user_id, p.ts, v.view_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (SELECT event_id view_id FROM events e WHERE event_type = 'view' AND e.user_id = p.user_id AND e.ts <= p.ts ORDER BY e.ts DESC, event_id DESC LIMIT 1) v ON true"""


def history_scan(spark, d):
    """The first three clicks of a user within two days of each of their signups."""
    e = table(spark, d, "events")
    w = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 2 days")).alias("end"))
    return H.touching(e.filter("event_type = 'click'").select("user_id", "ts", "event_id"), w.distinct(), "user_id", "ts", "event_id", 3)


SQL_SCAN = """
WITH w AS (SELECT DISTINCT user_id, ts AS start, ts + INTERVAL 2 DAY AS "end" FROM events WHERE event_type = 'signup')
SELECT w.user_id, w.start, w."end", e.event_id, e.ts, row_number() OVER (PARTITION BY w.user_id, w.start, w."end" ORDER BY e.ts, e.event_id)::INT AS rank
FROM w JOIN events e ON e.user_id = w.user_id AND e.event_type = 'click' AND e.ts BETWEEN w.start AND w."end" QUALIFY rank <= 3"""


def history_score(spark, d):
    """How likely a pair's downstream side carries the source change: files, messages and predicted lines."""
    s, t = _sources(spark, d), _targets(spark, d)
    files = lambda x, n: x.groupBy("pair_index").agg(F.collect_set("path").alias(n))
    m = table(spark, d, "sides").select("pair_index", "role", "title").distinct()
    words = lambda role, n: m.filter(F.col("role") == role).select("pair_index", X.message_words(F.col("title")).alias(n))
    pred = ranked_files(spark, d).filter("method = 'agent' and rank <= 5").select("pair_index", "path")
    hit = pred.join(t, ["pair_index", "path"], "left_semi").groupBy("pair_index").agg(F.count(F.lit(1)).alias("hits"))
    n = pred.groupBy("pair_index").agg(F.count(F.lit(1)).alias("n"))
    j = files(s, "a").join(files(t, "b"), "pair_index").join(words("Source", "x"), "pair_index").join(words("Infestor", "y"), "pair_index").join(n, "pair_index", "left").join(hit, "pair_index", "left").na.fill(0, ["n", "hits"])
    score = H.later_change_score(H.overlap_coefficient(F.col("a"), F.col("b")), X.jaccard(F.col("a"), F.col("b")), X.jaccard(F.col("x"), F.col("y")), F.col("hits"), F.col("n"))
    return j.select("pair_index", score.alias("score")).filter("score >= 0.1")


def later_change_scores(spark, d):
    """The whole score of a pair's downstream side as a later change: predicted files and statements, patch lines, messages.

    ``history_score`` is the narrower form that its SQL states: file sets, titles and file hits alone.
    """
    side = table(spark, d, "sides").groupBy("pair_index", "role").agg(F.min_by(F.struct("title", "body", "message"), "side_id").alias("x"))
    source = side.filter("role = 'Source'").select("pair_index", X.message_words(F.concat_ws(" ", "x.title", "x.body", "x.message")).alias("x"))
    target = side.filter("role = 'Infestor'").select("pair_index", X.message_words(F.regexp_extract(F.coalesce("x.message", F.lit("")), r"\A[^\r\n]*", 0)).alias("y"))
    files = lambda df, n: df.groupBy("pair_index").agg(F.collect_set("path").alias(n))
    pred = ranked_files(spark, d).filter("method = 'agent' and rank <= 20")
    s = statements(spark, d).filter("text is not null")
    patch = E.directional_similarity(s.filter("side = 'Source'"), s.filter("side = 'Infestor'")).select("pair_index", F.col("similarity").alias("patch"))
    top = ranked_statements(spark, d).filter("method = 'agent' and rank <= 100").select("pair_index", "path", "line")
    text = table(spark, d, "target_statements").filter("method = 'agent'").groupBy("pair_index", "path", "line").agg(F.min("line_text").alias("line_text"))
    lines = top.join(text, ["pair_index", "path", "line"])
    found = E.statement_evidence(lines.dropna(), s.filter("side = 'Infestor' and kind = 'deleted'")).groupBy("pair_index").agg(F.count(F.lit(1)).alias("hits"))
    n = lines.groupBy("pair_index").agg(F.count(F.lit(1)).alias("n"))
    j = source.join(target, "pair_index")
    for more in (files(pred, "a"), files(_targets(spark, d), "b"), patch, found, n):
        j = j.join(more, "pair_index", "left")
    none = F.array().cast("array<string>")
    j = j.na.fill(0, ["hits", "n"]).na.fill(0.0, ["patch"])
    score = H.later_change_score(H.overlap_coefficient(F.coalesce("a", none), F.coalesce("b", none)), F.col("patch"), X.jaccard(F.col("x"), F.col("y")), F.col("hits"), F.col("n"))
    return j.select("pair_index", score.alias("score")).filter("score >= 0.1")


def later_changes(spark, d):
    """For every source repository its ten likeliest later changes, best first."""
    side = table(spark, d, "sides").groupBy("pair_index", "role").agg(F.min_by(F.struct("repo", "merged_at"), "side_id").alias("x"))
    of = lambda role, *cols: side.filter(F.col("role") == role).select("pair_index", *cols)
    scored = later_change_scores(spark, d).join(of("Source", F.col("x.repo").alias("repo")), "pair_index").join(of("Infestor", parse_time(F.col("x.merged_at")).alias("merged")), "pair_index", "left")
    return H.best_changes(scored, ["repo"], "merged", ["pair_index"]).select("repo", "pair_index", "score", "rank")


def tree_files(spark, d):
    """How many files, and plain Go sources, the repositories' trees hold by what the sides name."""
    tree = _tree(spark, d).filter("repo is not null").select("repo", F.lit("head").alias("sha"), "path", F.lit("blob").alias("type"))
    count = lambda df, n: df.groupBy("repo").agg(F.count(F.lit(1)).alias(n))
    return count(B.tree_paths(tree), "files").join(count(B.plain_go_paths(tree), "plain_go"), "repo", "left").na.fill(0, ["plain_go"])


SQL_TREE_FILES = f"SELECT repo, count(*) AS files, count(*) FILTER (ends_with(path, '.go') AND NOT ends_with(path, '_test.go') AND NOT ends_with(path, '.pb.go') AND NOT ends_with(path, '_generated.go')) AS plain_go FROM {_TREE} WHERE repo IS NOT NULL GROUP BY 1"


_MWT = r"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(title, ''), '[A-Za-z_][A-Za-z0-9_]{2,}|\d+'), lambda x: lower(x))), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "))"
SQL_HISTORY_SCORE = f"""
WITH s AS (SELECT pair_index, list(path) a FROM {_S} GROUP BY 1), t AS (SELECT pair_index, list(path) b FROM {_T} GROUP BY 1), m AS (SELECT DISTINCT pair_index, role, {_MWT} w FROM sides),
p AS (SELECT pair_index, path FROM {RANKED_FILES} WHERE method = 'agent' AND rank <= 5), n AS (SELECT pair_index, count(*) n FROM p GROUP BY 1), h AS (SELECT p.pair_index, count(*) h FROM p SEMI JOIN {_T} t USING (pair_index, path) GROUP BY 1),
j AS (SELECT pair_index, len(list_intersect(a, b))::DOUBLE i, len(a) na, len(b) nb, len(list_intersect(x.w, y.w))::DOUBLE k, len(x.w) nx, len(y.w) ny, coalesce(h, 0) h, coalesce(n, 0) n
  FROM s JOIN t USING (pair_index) JOIN (SELECT pair_index, w FROM m WHERE role = 'Source') x USING (pair_index) JOIN (SELECT pair_index, w FROM m WHERE role = 'Infestor') y USING (pair_index) LEFT JOIN n USING (pair_index) LEFT JOIN h USING (pair_index))
SELECT pair_index, round(0.38::DOUBLE * i / least(na, nb) + 0.37::DOUBLE * (i / (na + nb - i)) + 0.15::DOUBLE * CASE WHEN nx + ny - k > 0 THEN k / (nx + ny - k) ELSE 0 END + 0.10::DOUBLE * CASE WHEN n > 0 THEN least(1, h::DOUBLE / n) ELSE 0 END, 6) AS score FROM j WHERE score >= 0.1"""


def resume_pending(spark, d):
    """Pairs with candidate files that have no candidate statements yet."""
    return H.not_done(table(spark, d, "target_files").select("pair_index").distinct(), table(spark, d, "target_statements"), ["pair_index"])


def judged_files(spark, d):
    """The agent's files reordered by the deterministic judge."""
    c = ranked_files(spark, d).filter("method = 'agent' and rank <= 20").select("pair_index", "path", "rank")
    tasks = table(spark, d, "sides").filter("role = 'Source'").groupBy("pair_index").agg(F.min(F.concat_ws(" ", "title", "message")).alias("task"))
    replies = J.ask(J.prompts(tasks, c, ["pair_index"], "task", "path", "rank"), J.overlap_judge)
    return J.reorder(c, replies, ["pair_index"], "path", "rank", 5)


def search_traces(spark, d):
    n = statements(spark, d).filter("side = 'Source'").groupBy("pair_index").agg(F.count(F.lit(1)).alias("statements"))
    f = ranked_files(spark, d).filter("rank <= 5").groupBy("pair_index").agg(F.max("score").alias("file_score"))
    l = ranked_statements(spark, d).filter("rank <= 5").groupBy("pair_index").agg(F.max("score").alias("line_score"), F.count(F.lit(1)).alias("hits"))  # noqa: E741
    return J.search_trace(n.join(f, "pair_index", "left").join(l, "pair_index", "left").na.fill(0, ["hits"]))


SQL_TRACE = f"""
WITH n AS (SELECT pair_index, count(*) s FROM {STATEMENTS} WHERE side = 'Source' GROUP BY 1), f AS (SELECT pair_index, max(score) f FROM {RANKED_FILES} WHERE rank <= 5 GROUP BY 1),
l AS (SELECT pair_index, max(score) l, count(*) h FROM (SELECT *, row_number() OVER (PARTITION BY pair_index, method ORDER BY score DESC, path, line) AS rank FROM (SELECT pair_index, method, path, line, max(score) score FROM target_statements WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)) WHERE rank <= 5 GROUP BY 1),
j AS (SELECT n.pair_index, f, l, coalesce(h, 0) h FROM n LEFT JOIN f USING (pair_index) LEFT JOIN l USING (pair_index)),
e AS (SELECT pair_index, unnest([
  struct_pack(node := 1, parent := 0, action := 'InspectSourcePatch', value := 55::DOUBLE), struct_pack(node := 2, parent := 1, action := 'FindSimilarFiles', value := 35 + 45::DOUBLE * coalesce(f, 0)),
  struct_pack(node := 3, parent := 2, action := 'MapPatchToTarget', value := CASE WHEN l IS NULL THEN 20 ELSE 45 + 50::DOUBLE * l END), struct_pack(node := 4, parent := 3, action := 'ViewCode', value := CASE WHEN h > 0 THEN 80::DOUBLE ELSE 20 END),
  struct_pack(node := 5, parent := 4, action := 'Finish', value := CASE WHEN h > 0 THEN 90::DOUBLE ELSE 30 END)]) x FROM j)
SELECT pair_index, x.node AS node, x.parent AS parent, x.action AS action, x.value AS value, count(*) OVER w AS visits, round(sum(x.value) OVER w, 6) AS total FROM e WINDOW w AS (PARTITION BY pair_index ORDER BY x.node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""

SQL_PROPOSED = f"SELECT pair_index, path, 1.2::DOUBLE AS score FROM {_S} s ANTI JOIN {_T} t USING (pair_index, path)"
SQL_ANCHORS = """
SELECT DISTINCT pair_index, path, block, unnest([s, e, s + 1, e - 1])::INT AS line, score FROM (SELECT pair_index, path, block, s, e, round(0.52::DOUBLE * b + 0.18, 6) score FROM (%s))""" % (
    "SELECT pair_index, path, coalesce(nullif(symbol, ''), 'line_bucket_' || (line // 25)) block, greatest(min(line) - 8, 1)::INT s, (max(line) + 8)::INT e, round(0.50::DOUBLE * max(score) + 0.22::DOUBLE * avg(score) + 0.18::DOUBLE * count(DISTINCT method) + 0.10::DOUBLE * least(count(*), 12) / 12, 6) b FROM (SELECT *, row_number() OVER (PARTITION BY pair_index, method ORDER BY score DESC, path, line) AS rank FROM (SELECT pair_index, method, path, line, max(score) score, min(target_symbol) symbol FROM target_statements WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)) WHERE rank <= 10 GROUP BY 1, 2, 3")

QUERIES = {
    "token_file_topk": (token_file_topk, SQL_TOKEN_TOPK),
    "exact_counterparts": (exact_counterparts, f"SELECT pair_index, path FROM {_S} s SEMI JOIN {_T} t USING (pair_index, path)"),
    "proposed_files": (proposed_files, SQL_PROPOSED),
    "auxiliary_files": (auxiliary_files, SQL_AUX),
    "judgement_records": (judgement_records, SQL_JUDGEMENTS),
    "clone_retrieval": (clone_retrieval, SQL_CLONE),
    "clone_retrieval_all": (clone_retrieval_all, None),
    "chunk_counts": (chunk_counts, SQL_CHUNK_COUNTS),
    "chunk_retrieval": (chunk_retrieval, SQL_CHUNK_RETRIEVAL),
    "path_score_topk": (path_score_topk, None),
    "prefilter_topk": (prefilter_topk, None),
    "high_recall_topk": (high_recall_topk, None),
    "companion_files": (companion_files, None),
    "neighbour_files": (neighbour_files, SQL_NEIGHBOURS),
    "source_terms": (source_terms, SQL_TERMS),
    "cosine_topk": (cosine_topk, SQL_COSINE),
    "label_vectors": (label_vectors, SQL_LABELS),
    "diff_statements": (diff_statements, SQL_DIFF),
    "diff_ranges": (diff_ranges, SQL_RANGES),
    "diff_ground_truth": (diff_ground_truth, None),
    "source_intents": (source_intents, SQL_INTENTS),
    "declaration_lines": (declaration_lines, SQL_DECL),
    "parsed_symbols": (parsed_symbols, SQL_PARSED),
    "graph_edges": (graph_edges, SQL_EDGES),
    "graph_nodes": (graph_nodes, SQL_NODES),
    "interval_hits": (interval_hits, _hits_sql()),
    "insert_anchors": (insert_anchors, SQL_ANCHORS),
    "line_ranking": (line_ranking, None),
    "asof_snapshot": (asof_snapshot, SQL_ASOF),
    "history_scan": (history_scan, SQL_SCAN),
    "history_score": (history_score, SQL_HISTORY_SCORE),
    "later_change_scores": (later_change_scores, None),
    "later_changes": (later_changes, None),
    "tree_files": (tree_files, SQL_TREE_FILES),
    "resume_pending": (resume_pending, "SELECT DISTINCT pair_index FROM target_files ANTI JOIN target_statements USING (pair_index)"),
    "judged_files": (judged_files, None),
    "search_traces": (search_traces, SQL_TRACE),
}
