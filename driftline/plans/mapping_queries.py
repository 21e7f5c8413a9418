"""Symbol and block mapping, content ranking, the search tree, and how hard pairs are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.operators import evidence as V
from driftline.operators import mapping as A
from driftline.operators import metrics as M
from driftline.operators import ranking as R
from driftline.operators import retrieval as T
from driftline.operators import search as H
from driftline.operators import statements as S
from driftline.operators import symbols as Y
from driftline.plans.common import RANKED_FILES, RANKED_STATEMENTS, STATEMENTS, TRUTH_RANGES, files_sql, ranked_files, ranked_statements, side_files, statements, strip_sql, truth_ranges
from driftline.plans.ranking_queries import SQL_BLOCKS
from driftline.plans.retrieval_queries import SQL_TOKEN_TOPK, token_file_topk
from driftline.plans.text_queries import _PT, _TOK
from driftline.runtime import table

_S, _T = files_sql("Source"), files_sql("Infestor")


def _lines(spark, d) -> DataFrame:
    """The known lines of target files."""
    return table(spark, d, "target_statements").dropna(subset=["pair_index", "path", "line", "line_text"]).groupBy("pair_index", "path", "line").agg(F.min("line_text").alias("text"))


def _files(spark, d) -> DataFrame:
    """The first five files of a pair by the agent, with their matched source path."""
    matched = table(spark, d, "target_files").groupBy("pair_index", "path").agg(F.min("matched_source_path").alias("matched_source_path"))
    return ranked_files(spark, d).filter("method = 'agent' and rank <= 5").join(matched, ["pair_index", "path"], "left").select("pair_index", "path", "matched_source_path")


def _shown(spark, d) -> DataFrame:
    """Source statements, numbered as the lines of the text that is shown of their file."""
    s = statements(spark, d).filter("side = 'Source' and text is not null").withColumn("text", F.regexp_replace("text", r"[\r\n]+", " "))
    return s.withColumn("line_no", F.row_number().over(Window.partitionBy("pair_index", "path").orderBy("ord", "line_no", "text", "kind")))


def _source_symbols(spark, d) -> DataFrame:
    s = _shown(spark, d)
    whole = s.groupBy("pair_index", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    found = Y.parse_symbols(whole, ["pair_index", "path"])
    held = found.join(s.select("pair_index", "path", "line_no", "text"), ["pair_index", "path"]).filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return held.groupBy("pair_index", "path", "name", "start_line", "end_line").agg(text.alias("text"))


def _target_symbols(spark, d) -> DataFrame:
    c = table(spark, d, "target_statements").filter("target_symbol is not null and path is not null and line_text is not null")
    return c.groupBy("pair_index", "path", F.col("target_symbol").alias("name")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.array_join(F.sort_array(F.collect_set("line_text")), "\n").alias("text"))


def _ranked_symbols(spark, d) -> tuple[DataFrame, DataFrame]:
    mapped = A.mapped_sources(_shown(spark, d), _files(spark, d))
    sources = A.symbols_of_patch(mapped, _source_symbols(spark, d))
    targets = _target_symbols(spark, d).join(_files(spark, d).select("pair_index", "path"), ["pair_index", "path"], "left_semi")
    return mapped, A.rank_symbols(targets, sources, A.file_patterns(mapped))


def symbol_ranking(spark, d):
    """Target symbols of the first files by their match with the source symbols around the patch."""
    return _ranked_symbols(spark, d)[1].select("pair_index", "path", "name", "match_score", "rank")


def symbol_lines(spark, d):
    """Ten lines of every first file, of its four best symbols, by similarity, symbol and pattern."""
    mapped, ranked = _ranked_symbols(spark, d)
    found = A.mapped_lines(_lines(spark, d), mapped, ranked, 10)
    return found.select("pair_index", "path", "line", "symbol", "similarity", "symbol_score", "score", "rank")


def _matches(spark, d) -> DataFrame:
    s = statements(spark, d)
    pattern = s.filter("side = 'Source'").groupBy("pair_index").agg(X.patch_pattern(F.array_join(F.collect_list("text"), "\n")).alias("pattern"))
    return V.intent_matches(Y.source_intents(s.filter("side = 'Source' and text is not null")), _target_symbols(spark, d).join(pattern, "pair_index"), F.col("pattern"))


def expanded_blocks(spark, d):
    """Fifty lines of a pair from the blocks its intents chose, and the anchors of insertions, intents in turn."""
    m = _matches(spark, d)
    blocks = R.top_k(V.blocks_of_matches(m), ["pair_index"], [F.col("block_score").desc(), F.col("path"), F.col("start"), F.col("block")], 30)
    keyed = m.select("pair_index", "path", F.col("name").alias("block"), F.col("start_line").alias("start"), F.concat_ws("\t", "sp", "ss", "intent").alias("intent_key"), "intent", "texts")
    return A.expanded_blocks(blocks, keyed, _lines(spark, d), 50, 8).select("pair_index", "path", "line", "action", "score", "rank")


def block_lines(spark, d):
    """Five lines of every of the first ten candidate blocks by block, similarity, nearness, support and kind."""
    r = ranked_statements(spark, d).filter("rank <= 10").withColumn("module", F.col("method"))
    blocks = R.top_k(R.blocks_of(r, ["pair_index"]), ["pair_index"], [F.col("block_score").desc(), F.col("path"), F.col("block")], 10)
    inside = blocks.select("pair_index", "path", "block", "start", "end").join(r.select("pair_index", "path", "line").distinct(), ["pair_index", "path"]).filter("line between start and end")
    seeds = inside.groupBy("pair_index", "path", "block", "start").agg(F.sort_array(F.collect_set("line")).alias("seed_lines")).join(blocks.select("pair_index", "path", "block", "start", "modules"), ["pair_index", "path", "block", "start"])
    texts = A.mapped_sources(_shown(spark, d), blocks.select("pair_index", "path").distinct().join(_files(spark, d), ["pair_index", "path"])).filter("place <= 16")
    examples = texts.groupBy("pair_index", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_text"))), lambda x: x["source_text"]).alias("source_texts"))
    return S.block_lines(blocks, _lines(spark, d), seeds.join(examples, ["pair_index", "path"], "left"), 5)


def _terms(spark, d) -> DataFrame:
    return T.terms_of(statements(spark, d).filter("side = 'Source'"))


def test_impact_files(spark, d):
    """Test files a pair may have to change, among its candidates by path tokens."""
    return A.test_impact(token_file_topk(spark, d).select("pair_index", "path", "score"), side_files(spark, d, "Source"), side_files(spark, d, "Infestor"), _terms(spark, d), 10)


_HOLDS = lambda c: f"(contains(lower({c}), '_test.') OR contains(lower({c}), '/test') OR contains(lower({c}), 'test/'))"
_BASE = lambda c: f"replace(string_split(regexp_extract({c}, '[^/]*$'), '.')[1], '_test', '')"
_WORDS = f"list_filter(list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: lower(x)), lambda x: length(x) >= 3)"
_TERMS = f"(SELECT pair_index, list(DISTINCT t) terms FROM (SELECT pair_index, unnest({_PT('path')}) t FROM {STATEMENTS} WHERE side = 'Source' UNION ALL SELECT pair_index, unnest({_WORDS}) FROM {STATEMENTS} WHERE side = 'Source') GROUP BY 1)"
_J = lambda a, b: f"(len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"
SQL_TEST_IMPACT = f"""
WITH c AS (SELECT pair_index, path, score, 'candidate' AS action FROM ({SQL_TOKEN_TOPK})), h AS (SELECT pair_index, bool_or({_HOLDS('path')}) tested FROM {_S} GROUP BY 1), b AS (SELECT DISTINCT pair_index, {_BASE('path')} base FROM {_S}),
t AS (SELECT t.pair_index, t.path, h.tested, b.base IS NOT NULL same, {_PT('t.path')} p, coalesce(terms, []) terms FROM {_T} t JOIN h USING (pair_index) LEFT JOIN b ON b.pair_index = t.pair_index AND b.base = {_BASE('t.path')} LEFT JOIN {_TERMS} w ON w.pair_index = t.pair_index WHERE {_HOLDS('t.path')}),
u AS (SELECT * FROM c UNION ALL SELECT pair_index, path, round(0.58::DOUBLE + 0.22::DOUBLE * same::INT + 0.20::DOUBLE * {_J('p', 'terms')}, 6), 'AskTestImpact' FROM t WHERE tested OR same),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY pair_index, path ORDER BY score DESC, action DESC) = 1)
SELECT *, row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path)::INT AS rank FROM m QUALIFY rank <= 10"""


def _word_set(text: str):
    return F.array_distinct(F.flatten(F.collect_list(X.tokens(F.col(text), X.TOKEN_WORD))))


def content_files(spark, d):
    """The candidates by path tokens, ranked anew by the words of their known lines."""
    s = statements(spark, d).filter("side = 'Source'")
    none = F.array().cast("array<string>")
    sources = s.groupBy("pair_index").agg(_word_set("text").alias("words")).join(V.symbol_terms(s.filter("text is not null")).withColumnRenamed("terms", "symbols"), "pair_index", "left").join(_terms(spark, d), "pair_index", "left")
    sources = sources.select("pair_index", "words", F.coalesce("symbols", none).alias("symbols"), F.coalesce("terms", none).alias("terms"))
    texts = _lines(spark, d).groupBy("pair_index", "path").agg(_word_set("text").alias("words"))
    return A.content_rank(token_file_topk(spark, d), texts, sources, 5)


_LOW = f"list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: lower(x))"
SQL_CONTENT = rf"""
WITH s AS (SELECT pair_index, text FROM {STATEMENTS} WHERE side = 'Source'), i AS (SELECT DISTINCT pair_index FROM s),
w AS (SELECT pair_index, list(DISTINCT t) ws FROM (SELECT pair_index, unnest({_LOW}) t FROM s) GROUP BY 1),
y AS (SELECT pair_index, list(DISTINCT t) ys FROM (SELECT pair_index, lower(unnest(list_concat(list_concat(regexp_extract_all(text, '\b(?:func|type|var|const)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(text, '\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)), list_filter(regexp_extract_all(text, '{_TOK}'), lambda x: length(x) >= 6)))) t FROM s) GROUP BY 1),
l AS (SELECT pair_index, path, line, min(line_text) text FROM target_statements WHERE pair_index IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL AND line_text IS NOT NULL GROUP BY ALL),
f AS (SELECT pair_index, path, list(DISTINCT t) fs FROM (SELECT pair_index, path, unnest({_LOW}) t FROM l) GROUP BY ALL),
j AS (SELECT p.pair_index, p.path, p.score prior, list_distinct(list_concat(coalesce(ws, []), coalesce(ys, []))) a, list_distinct(list_concat(coalesce(fs, []), {_PT('p.path')})) b, list_distinct(list_concat(coalesce(ys, []), coalesce(terms, []))) c, {_PT('p.path')} o
  FROM ({SQL_TOKEN_TOPK}) p JOIN i USING (pair_index) LEFT JOIN w USING (pair_index) LEFT JOIN y USING (pair_index) LEFT JOIN {_TERMS} t USING (pair_index) LEFT JOIN f ON f.pair_index = p.pair_index AND f.path = p.path)
SELECT pair_index, path, round(0.62::DOUBLE * {_J('a', 'b')} + 0.23::DOUBLE * {_J('c', 'o')} + 0.15::DOUBLE * prior, 6) AS score, row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path)::INT AS rank FROM j QUALIFY rank <= 5"""


def patch_rank_files(spark, d):
    """The candidates by path tokens, ranked anew by the similarity of the normalised source patch and their known lines."""
    s = statements(spark, d).filter("side = 'Source' and text is not null")
    text = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), "\n").alias("text")
    return A.patch_rank(token_file_topk(spark, d), _lines(spark, d).groupBy("pair_index", "path").agg(text("line")), s.groupBy("pair_index").agg(text("path", "ord", "line_no", "kind")), 5)


def block_metrics(spark, d):
    """Precision, coverage, F1 and reciprocal rank of the first ten candidate blocks against the downstream changes, per pair."""
    r = ranked_statements(spark, d).withColumn("module", F.col("method"))
    blocks = R.top_k(R.blocks_of(r, ["pair_index"]), ["pair_index"], [F.col("block_score").desc(), F.col("path"), F.col("block")], 10)
    truth = statements(spark, d).filter("side = 'Infestor' and kind <> 'context'").select("pair_index", "path", F.col("line_no").alias("anchor"))
    m = M.block_metrics(blocks, truth, ["pair_index"], 10, 2)
    return m.select("pair_index", *[F.round(c, 6).alias(c) for c in ("precision", "coverage", "f1", "rr")])


SQL_BLOCK_METRICS = f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY pair_index ORDER BY block_score DESC, path, block) AS rank FROM ({SQL_BLOCKS}) QUALIFY rank <= 10),
g AS (SELECT pair_index, path, line_no anchor, row_number() OVER () id FROM {STATEMENTS} WHERE side = 'Infestor' AND kind <> 'context'),
h AS (SELECT g.pair_index, g.id, b.rank FROM g JOIN b ON b.pair_index = g.pair_index AND b.path = g.path AND g.anchor BETWEEN b.start - 2 AND b."end" + 2),
m AS (SELECT s.pair_index, coalesce(x.r, 0)::DOUBLE / greatest(coalesce(n.n, 0), 1) p, coalesce(x.c, 0)::DOUBLE / s.g c, coalesce(1::DOUBLE / x.f, 0) rr
  FROM (SELECT pair_index, count(*) g FROM g GROUP BY 1) s LEFT JOIN (SELECT pair_index, count(*) n FROM b GROUP BY 1) n USING (pair_index) LEFT JOIN (SELECT pair_index, count(DISTINCT rank) r, count(DISTINCT id) c, min(rank) f FROM h GROUP BY 1) x USING (pair_index))
SELECT pair_index, round(p, 6) AS precision, round(c, 6) AS coverage, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS f1, round(rr, 6) AS rr FROM m"""


def hardness(spark, d):
    """How unlike the two sides of every pair with predictions are, and what was hit all the same."""
    e = V.evaluate(ranked_statements(spark, d).filter("method = 'agent' and rank <= 50"), truth_ranges(spark, d)).select("pair_index", "file_hit", "statement_hit")
    s = statements(spark, d).filter("text is not null")
    shapes = lambda role: s.filter(F.col("side") == role).select("pair_index", F.explode(X.statement_shapes(F.array("text"))).alias("shape"))
    return H.hardness(side_files(spark, d, "Source"), side_files(spark, d, "Infestor"), shapes("Source"), shapes("Infestor"), e)


_SHAPE = f"array_to_string(regexp_extract_all(text, '{_TOK}'), ' ')"
_SHAPES = lambda role: f"(SELECT DISTINCT pair_index, {_SHAPE} x FROM {STATEMENTS} WHERE side = '{role}' AND length({_SHAPE}) >= 8)"
_NAMES = lambda f: f"(SELECT DISTINCT pair_index, regexp_extract(path, '[^/]*$') x FROM {f})"
_COUNT = lambda f: f"(SELECT pair_index, count(*) n FROM {f} GROUP BY 1)"
_BOTH = lambda a, b: f"(SELECT pair_index, count(*) n FROM {a} a SEMI JOIN {b} b USING (pair_index, x) GROUP BY 1)"
_PATHS_OF = lambda f: f"(SELECT pair_index, path x FROM {f})"
SQL_HARDNESS = f"""
WITH r AS (SELECT * FROM {RANKED_STATEMENTS} WHERE method = 'agent' AND rank <= 50), g AS (SELECT * FROM {TRUTH_RANGES}),
e AS (SELECT pair_index, bool_or(pair_index IN (SELECT r.pair_index FROM r SEMI JOIN g USING (pair_index, path))) file_hit, bool_or(pair_index IN (SELECT r.pair_index FROM r JOIN g ON r.pair_index = g.pair_index AND r.path = g.path AND r.line BETWEEN g."start" - 5 AND g."end" + 5)) statement_hit FROM r GROUP BY 1),
j AS (SELECT e.*, coalesce(a.n, 0) source_file_count, coalesce(b.n, 0) target_file_count, coalesce(c.n, 0) path_overlap_count, coalesce(f.n, 0) basename_overlap_count, coalesce(h.n, 0) statement_text_overlap_count
  FROM e LEFT JOIN {_COUNT(_S)} a USING (pair_index) LEFT JOIN {_COUNT(_T)} b USING (pair_index) LEFT JOIN {_BOTH(_PATHS_OF(_S), _PATHS_OF(_T))} c USING (pair_index) LEFT JOIN {_BOTH(_NAMES(_S), _NAMES(_T))} f USING (pair_index) LEFT JOIN {_BOTH(_SHAPES('Source'), _SHAPES('Infestor'))} h USING (pair_index))
SELECT *, path_overlap_count = 0 AS path_not_exact, basename_overlap_count = 0 AS basename_not_exact, statement_text_overlap_count = 0 AS statement_text_not_exact, source_file_count > 10 AS many_source_files, target_file_count > 10 AS many_target_files,
  file_hit AND path_overlap_count = 0 AS file_worked_despite_path_change, statement_hit AND statement_text_overlap_count = 0 AS statement_worked_despite_text_change FROM j"""


def hard_cases(spark, d):
    """The hard pairs, with their sides and first five files."""
    side = table(spark, d, "sides").groupBy("pair_index", "role").agg(F.min_by(F.struct("repo", "kind", "number"), "side_id").alias("x"))
    of = lambda role, n: side.filter(F.col("role") == role).select("pair_index", F.concat_ws(" ", "x.repo", "x.kind", "x.number").alias(n))
    top = ranked_files(spark, d).filter("method = 'agent' and rank <= 5").groupBy("pair_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), " ").alias("top_files"))
    hard = H.hard_cases(hardness(spark, d)).select("pair_index", "file_hit", "statement_hit")
    return hard.join(of("Source", "source"), "pair_index", "left").join(of("Infestor", "target"), "pair_index", "left").join(top, "pair_index", "left")


_SIDE = lambda role: f"(SELECT pair_index, concat_ws(' ', repo, kind, number) x FROM sides WHERE role = '{role}' QUALIFY row_number() OVER (PARTITION BY pair_index ORDER BY side_id) = 1)"
SQL_HARD_CASES = f"""
SELECT h.pair_index, h.file_hit, h.statement_hit, s.x AS source, t.x AS target, f.top_files FROM ({SQL_HARDNESS}) h LEFT JOIN {_SIDE('Source')} s USING (pair_index) LEFT JOIN {_SIDE('Infestor')} t USING (pair_index)
LEFT JOIN (SELECT pair_index, string_agg(path, ' ' ORDER BY rank) top_files FROM {RANKED_FILES} WHERE method = 'agent' AND rank <= 5 GROUP BY 1) f USING (pair_index)
WHERE path_not_exact OR basename_not_exact OR statement_text_not_exact OR NOT file_hit OR NOT statement_hit"""


def judge_needed(spark, d):
    """For which pairs the agent's prediction is put to a judge."""
    f = ranked_files(spark, d).filter("method = 'agent' and rank <= 20")
    s = side_files(spark, d, "Source")
    count = lambda df, n: df.groupBy("pair_index").agg(F.count(F.lit(1)).alias(n))
    j = count(s, "source_files").join(f.groupBy("pair_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("confidences")), "pair_index", "left")
    j = j.join(count(ranked_statements(spark, d).filter("method = 'agent'"), "statements"), "pair_index", "left").join(count(f.join(s, ["pair_index", "path"], "left_semi"), "exact"), "pair_index", "left")
    j = j.na.fill(0, ["statements", "exact"]).withColumn("confidences", F.coalesce("confidences", F.array().cast("array<double>")))
    return H.needs_judge(j).select("pair_index", "source_files", "statements", "exact", "needed")


SQL_JUDGE_NEEDED = f"""
WITH f AS (SELECT * FROM {RANKED_FILES} WHERE method = 'agent' AND rank <= 20),
c AS (SELECT pair_index, list(round(score, 3) ORDER BY rank) cs FROM f GROUP BY 1), n AS (SELECT pair_index, count(*) n FROM {RANKED_STATEMENTS} WHERE method = 'agent' GROUP BY 1), x AS (SELECT pair_index, count(*) n FROM f SEMI JOIN {_S} s USING (pair_index, path) GROUP BY 1),
j AS (SELECT s.pair_index, s.n source_files, coalesce(n.n, 0) statements, coalesce(x.n, 0) exact, coalesce(cs, []) cs FROM {_COUNT(_S)} s LEFT JOIN c USING (pair_index) LEFT JOIN n USING (pair_index) LEFT JOIN x USING (pair_index))
SELECT pair_index, source_files, statements, exact, source_files > 8 OR (len(cs) >= 3 AND len(list_distinct(cs[1:3])) = 1) OR statements = 0 OR exact = 0 AS needed FROM j"""


def _plan(spark, d) -> DataFrame:
    f = ranked_files(spark, d).filter("method = 'agent' and rank <= 8").select("pair_index", "path", "score", "rank")
    r = ranked_statements(spark, d).filter("method = 'agent' and rank <= 100").join(_lines(spark, d), ["pair_index", "path", "line"], "left").select("pair_index", "path", "line", "score", "rank", "text")
    pairs = statements(spark, d).filter("side = 'Source'").groupBy("pair_index").agg(F.count(F.lit(1)).alias("statements"))
    keep = pairs.select("pair_index")
    return H.planned(pairs, f.join(keep, "pair_index", "left_semi"), r.join(keep, "pair_index", "left_semi"), 12)


def search_plan(spark, d):
    """What the staged search of a pair does in which round, and what it is worth."""
    return _plan(spark, d).withColumn("value", F.round("value", 6))


SQL_PLAN = f"""
WITH n AS (SELECT pair_index, count(*) s FROM {STATEMENTS} WHERE side = 'Source' GROUP BY 1), f AS (SELECT pair_index, path, score, rank FROM {RANKED_FILES} SEMI JOIN n USING (pair_index) WHERE method = 'agent' AND rank <= 8),
x AS (SELECT pair_index, path, line, min(line_text) text FROM target_statements WHERE pair_index IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL AND line_text IS NOT NULL GROUP BY ALL),
l AS (SELECT pair_index, path, line, score, rank, text FROM {RANKED_STATEMENTS} SEMI JOIN n USING (pair_index) LEFT JOIN x USING (pair_index, path, line) WHERE method = 'agent' AND rank <= 100),
p AS (SELECT n.pair_index, s, coalesce(c, 0) c, b, coalesce(v, 0) v FROM n LEFT JOIN (SELECT pair_index, count(*) c, max(score) b FROM f GROUP BY 1) USING (pair_index) LEFT JOIN (SELECT pair_index, count(*) v FROM l WHERE rank <= 3 GROUP BY 1) USING (pair_index)),
a AS (SELECT pair_index, 0 AS round, 0 AS place, 'InspectSourcePatch' AS action, NULL AS path, NULL AS line, CASE WHEN s > 0 THEN 55 ELSE 25 END::DOUBLE AS value FROM p
  UNION ALL SELECT pair_index, unnest(CASE WHEN c > 0 THEN [1] ELSE range(1, 12) END), 0, 'FindSimilarFiles', NULL, NULL, 35 + 45::DOUBLE * coalesce(b, 0) FROM p
  UNION ALL SELECT pair_index, 2 + (rank - 1) // 3, (rank - 1) % 3, 'MapPatchToTarget', path, NULL, CASE WHEN m IS NULL THEN 20 ELSE 45 + 50::DOUBLE * m END FROM f LEFT JOIN (SELECT pair_index, path, max(score) m FROM l GROUP BY ALL) USING (pair_index, path)
  UNION ALL SELECT l.pair_index, 2 + (c + 2) // 3 + (rank - 1) // 2, (rank - 1) % 2, 'ViewCode', path, line, CASE WHEN length(text) > 0 THEN 80 ELSE 20 END FROM l JOIN p USING (pair_index) WHERE rank <= 3
  UNION ALL SELECT pair_index, 2 + (c + 2) // 3 + (v + 1) // 2, 0, 'Finish', NULL, NULL, CASE WHEN v > 0 THEN 90 ELSE 30 END FROM p WHERE c > 0)
SELECT pair_index, round::INT AS round, place::INT AS place, action, path, line::INT AS line, round(value, 6) AS value FROM a WHERE round < 12"""


def search_tree(spark, d):
    """The tree of that search: every round under the leaf of the highest confidence bound, values summed up to the root."""
    return H.search_tree(_plan(spark, d))


def symbol_statements(spark, d):
    """The first twelve statements of every target symbol, as nodes of the structure graph have them."""
    named = lambda df: df.withColumn("repo", F.col("pair_index").cast("string"))
    n = Y.statement_nodes(named(_lines(spark, d)), named(_target_symbols(spark, d)), 12)
    return n.select(F.col("repo").cast("int").alias("pair_index"), "path", "symbol", "line", "text")


SQL_SYMBOL_STATEMENTS = rf"""
WITH l AS (SELECT pair_index, path, line, {strip_sql('min(line_text)')} text FROM target_statements WHERE pair_index IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL AND line_text IS NOT NULL GROUP BY ALL),
s AS (SELECT pair_index, path, target_symbol symbol, min(line) a, max(line) b FROM target_statements WHERE target_symbol IS NOT NULL AND path IS NOT NULL AND line_text IS NOT NULL GROUP BY ALL),
r AS (SELECT l.pair_index, l.path, symbol, line, text, row_number() OVER (PARTITION BY l.pair_index, l.path, symbol, a ORDER BY line) k FROM l JOIN s ON s.pair_index = l.pair_index AND s.path = l.path AND l.line BETWEEN a AND b
  WHERE NOT (text = '' OR text IN ('{{', '}}', '}},', ');') OR starts_with(text, '//') OR starts_with(text, '*')) AND len(regexp_extract_all(text, '{_TOK}')) >= 2)
SELECT pair_index, path, symbol, line, text FROM r WHERE k <= 12"""

QUERIES = {
    "symbol_statements": (symbol_statements, SQL_SYMBOL_STATEMENTS),
    "symbol_ranking": (symbol_ranking, None),
    "symbol_lines": (symbol_lines, None),
    "expanded_blocks": (expanded_blocks, None),
    "block_lines": (block_lines, None),
    "test_impact_files": (test_impact_files, SQL_TEST_IMPACT),
    "content_files": (content_files, SQL_CONTENT),
    "patch_rank_files": (patch_rank_files, None),
    "block_metrics": (block_metrics, SQL_BLOCK_METRICS),
    "hardness": (hardness, SQL_HARDNESS),
    "hard_cases": (hard_cases, SQL_HARD_CASES),
    "judge_needed": (judge_needed, SQL_JUDGE_NEEDED),
    "search_plan": (search_plan, SQL_PLAN),
    "search_tree": (search_tree, None),
}
