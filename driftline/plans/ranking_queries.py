"""Ranked lists, their merging and fusion, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.text import clamp01, evidence_gate
from driftline.operators import metrics as M
from driftline.operators import ranking as R
from driftline.plans.common import RANKED_FILES, RANKED_STATEMENTS, TRUTH_FILES, TRUTH_RANGES, ranked_files, ranked_statements, truth_files, truth_ranges
from driftline.runtime import table

KEY = ["pair_index"]


def file_topk(spark, d):
    return ranked_files(spark, d).filter("rank <= 5")


def statement_topk(spark, d):
    return ranked_statements(spark, d).filter("rank <= 10")


def first_wins_statements(spark, d):
    """Per pair the first occurrence of each (path, line) over all methods' lists."""
    r = ranked_statements(spark, d).filter("rank <= 20")
    return R.unique_rank(r.select("pair_index", "path", "line", F.col("rank").alias("pos"), "method"), KEY, ["path", "line"], [F.col("pos"), F.col("method"), F.col("path"), F.col("line")], 15).select("pair_index", "path", "line", "rank")


SQL_FIRST = f"""
WITH u AS (SELECT pair_index, path, line, rank pos, method FROM {RANKED_STATEMENTS} WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY pair_index, path, line ORDER BY pos, method) = 1)
SELECT pair_index, path, line, row_number() OVER (PARTITION BY pair_index ORDER BY pos, method, path, line)::INT AS rank FROM u QUALIFY rank <= 15"""


def _list(spark, d, method, k):
    return ranked_files(spark, d).filter((F.col("method") == method) & (F.col("rank") <= k)).select("pair_index", "path", "rank")


def merged_lists(spark, d):
    """The agent's list, then the clone list, each item once, ten in all."""
    return R.merge_ranks([_list(spark, d, "agent", 8), _list(spark, d, "clone", 8)], KEY, ["path"], "rank", 10).select("pair_index", "path", "rank")


SQL_MERGED = f"""
WITH a AS (SELECT pair_index, path, CASE method WHEN 'agent' THEN 0 ELSE 1 END l, rank r FROM {RANKED_FILES} WHERE method IN ('agent', 'clone') AND rank <= 8),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pair_index, path ORDER BY l, r) = 1)
SELECT pair_index, path, row_number() OVER (PARTITION BY pair_index ORDER BY l, r)::INT AS rank FROM u QUALIFY rank <= 10"""


def head_then_expand(spark, d):
    """Three of the agent's list, then the clone list, then the agent's tail."""
    return R.merge_ranks([_list(spark, d, "agent", 8), _list(spark, d, "clone", 8)], KEY, ["path"], "rank", 10, head=3).select("pair_index", "path", "rank")


SQL_HEAD = SQL_MERGED.replace("CASE method WHEN 'agent' THEN 0 ELSE 1 END", "CASE WHEN method = 'agent' AND rank <= 3 THEN 0 WHEN method = 'clone' THEN 1 ELSE 2 END")


def round_robin_sources(spark, d):
    """Statements of the lexical list, the files taking turns in order of their first line."""
    r = ranked_statements(spark, d).filter("method = 'lexical'").select("pair_index", "path", "line", F.col("rank").alias("pos"))
    return R.round_robin(r, KEY, ["path"], [F.col("pos")], 20).select("pair_index", "path", "line", "rank")


_RR = f"SELECT *, row_number() OVER (PARTITION BY pair_index, path ORDER BY pos) turn, min(pos) OVER (PARTITION BY pair_index, path) first, max(score) OVER (PARTITION BY pair_index, path) best FROM (SELECT pair_index, path, line, score, rank pos FROM {RANKED_STATEMENTS} WHERE method = 'lexical')"
SQL_RR = f"SELECT pair_index, path, line, row_number() OVER (PARTITION BY pair_index ORDER BY turn, first)::INT AS rank FROM ({_RR}) QUALIFY rank <= 20"


def round_robin_capped(spark, d):
    """The same with three lines per file, files in order of their best score."""
    r = ranked_statements(spark, d).filter("method = 'lexical'").select("pair_index", "path", "line", "score", F.col("rank").alias("pos"))
    return R.round_robin(r, KEY, ["path"], [F.col("pos")], 20, cap=3, by_score=F.col("score")).select("pair_index", "path", "line", "rank")


SQL_RR_CAP = f"SELECT pair_index, path, line, row_number() OVER (PARTITION BY pair_index ORDER BY turn, best DESC, first)::INT AS rank FROM ({_RR}) WHERE turn <= 3 QUALIFY rank <= 20"


def rrf_files(spark, d):
    """Reciprocal rank fusion of two lists with default ranks for missing items."""
    from driftline.operators.retrieval import impact_fusion

    own = table(spark, d, "target_files").filter("path = matched_source_path").select("pair_index", "path")
    return impact_fusion(_list(spark, d, "semantic", 10), _list(spark, d, "lexical", 20), own, 10).select("pair_index", "path", "score", "rank")


SQL_RRF = f"""
WITH a AS (SELECT pair_index, path, rank r1 FROM {RANKED_FILES} WHERE method = 'semantic' AND rank <= 10), b AS (SELECT pair_index, path, rank r2 FROM {RANKED_FILES} WHERE method = 'lexical' AND rank <= 20),
o AS (SELECT DISTINCT pair_index, path, 0.30::DOUBLE own FROM target_files WHERE path = matched_source_path),
s AS (SELECT pair_index, path, round(0.74::DOUBLE / (2 + coalesce(r1, 15)) + 0.26::DOUBLE / (2 + coalesce(r2, 25)) + coalesce(own, 0), 6) score FROM a FULL JOIN b USING (pair_index, path) LEFT JOIN o USING (pair_index, path))
SELECT pair_index, path, score, row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path)::INT AS rank FROM s QUALIFY rank <= 10"""

WEIGHTS = {"agent": 0.30, "clone": 0.20, "graphqa": 0.30, "lexical": 0.20}


def weighted_fusion(spark, d):
    """Sum of weight x (.75 score / best score + .25 / rank) over four methods."""
    r = ranked_files(spark, d)
    lists = []
    for m, w in WEIGHTS.items():
        own = r.filter(F.col("method") == m).withColumn("rel", R.scaled(F.col("score"), KEY))
        lists.append((own, F.lit(w) * (0.75 * F.col("rel") + 0.25 / F.col("rank"))))
    return R.fuse(lists, KEY, ["path"], 8).select("pair_index", "path", F.round("score", 6).alias("score"))


SQL_WEIGHTED = f"""
WITH r AS (SELECT *, coalesce(score / nullif(max(score) OVER (PARTITION BY pair_index, method), 0), 0) rel, CASE method {' '.join(f"WHEN '{m}' THEN {w}" for m, w in WEIGHTS.items())} END::DOUBLE w FROM {RANKED_FILES}),
s AS (SELECT pair_index, path, round(sum(w * (0.75::DOUBLE * rel + 0.25::DOUBLE / rank)), 9) score FROM r WHERE w IS NOT NULL GROUP BY ALL)
SELECT pair_index, path, round(score, 6) score FROM s QUALIFY row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path) <= 8"""


def vote_fusion(spark, d):
    """Every method votes 1 / rank + confidence for its first eight files."""
    r = ranked_files(spark, d).filter("rank <= 8")
    s = r.groupBy("pair_index", "path").agg(F.round(F.sum(1.0 / F.col("rank") + F.col("score")), 9).alias("score"), F.count(F.lit(1)).alias("votes"))
    return R.top_k(s, KEY, [F.col("score").desc(), F.col("path")], 8).select("pair_index", "path", F.round("score", 6).alias("score"), "votes")


SQL_VOTE = f"SELECT pair_index, path, round(score, 6) score, votes FROM (SELECT pair_index, path, round(sum(1.0::DOUBLE / rank + score), 9) score, count(*) votes FROM {RANKED_FILES} WHERE rank <= 8 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pair_index ORDER BY score DESC, path) <= 8"


def tiered_files(spark, d):
    """Exact counterparts, then proposed new files, then the rest by confidence."""
    t = table(spark, d, "target_files").filter(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    best = t.groupBy("pair_index", "path", F.coalesce("action", F.lit("")).alias("action")).agg(F.max("confidence").alias("score"))
    tier = lambda f: best.filter(f).select("pair_index", "path", "score")
    return R.tiered([tier("action = 'ExactCounterpart'"), tier("action = 'ProposeNewCounterpart'"), tier("action not in ('ExactCounterpart', 'ProposeNewCounterpart')")], KEY, ["path"], ["score", "path"], 10).select("pair_index", "path", "rank")


SQL_TIERED = """
WITH b AS (SELECT pair_index, path, CASE action WHEN 'ExactCounterpart' THEN 0 WHEN 'ProposeNewCounterpart' THEN 1 ELSE 2 END tier, max(confidence) score FROM target_files WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL),
u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY pair_index, path ORDER BY tier, score DESC) = 1)
SELECT pair_index, path, row_number() OVER (PARTITION BY pair_index ORDER BY tier, score DESC, path)::INT AS rank FROM u QUALIFY rank <= 10"""


def candidate_blocks(spark, d):
    r = ranked_statements(spark, d).withColumn("module", F.col("method"))
    return R.blocks_of(r, KEY)


SQL_BLOCKS = f"""
SELECT pair_index, path, block, greatest(lo - 8, 1)::INT AS start, (hi + 8)::INT AS "end", round(0.50::DOUBLE * best + 0.22::DOUBLE * mean + 0.18::DOUBLE * modules + 0.10::DOUBLE * least(n, 12) / 12, 6) block_score, modules, n FROM (
  SELECT pair_index, path, coalesce(nullif(symbol, ''), 'line_bucket_' || (line // 25)) block, max(score) best, avg(score) mean, count(DISTINCT method) modules, count(*) n, min(line) lo, max(line) hi FROM {RANKED_STATEMENTS} GROUP BY ALL)"""


def block_probes(spark, d):
    r = ranked_statements(spark, d).filter("rank <= 10").withColumn("module", F.col("method"))
    return R.probe_lines(R.blocks_of(r, KEY), r, KEY)


SQL_PROBES = f"""
WITH r AS (SELECT * FROM {RANKED_STATEMENTS} WHERE rank <= 10),
b AS (SELECT pair_index, path, coalesce(nullif(symbol, ''), 'line_bucket_' || (line // 25)) block, greatest(min(line) - 8, 1)::INT s, (max(line) + 8)::INT e FROM r GROUP BY ALL),
p AS (SELECT DISTINCT pair_index, path, block, unnest(list_append(generate_series(s, e, 5), (s + e) // 2))::INT line FROM b)
SELECT p.* FROM p ANTI JOIN r ON p.pair_index = r.pair_index AND p.path = r.path AND p.line = r.line"""


def gated_statements(spark, d):
    """Candidates that pass the evidence gate; scores clamped to [0, 1]."""
    t = table(spark, d, "target_statements").dropna(subset=["path", "line"])
    n = lambda c: F.when(~F.isnan(c), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)))
    per = t.groupBy("pair_index", "path", "line").agg(F.max(n("line_similarity")).alias("sim"), F.max(n("pattern_score")).alias("prox"), F.count_distinct("method").alias("modules"), F.max(n("score")).alias("block"))
    return per.filter(evidence_gate(F.coalesce("sim", F.lit(0.0)), F.coalesce("prox", F.lit(0.0)), F.col("modules"), F.coalesce("block", F.lit(0.0)))).select("pair_index", "path", "line", "modules")


_N = lambda c: f"max(CASE WHEN NOT isnan({c}) THEN least(greatest({c}, 0), 1) END)"
SQL_GATED = f"""
SELECT pair_index, path, line, modules FROM (SELECT pair_index, path, line, coalesce({_N('line_similarity')}, 0) sim, coalesce({_N('pattern_score')}, 0) prox, count(DISTINCT method) modules, coalesce({_N('score')}, 0) block FROM target_statements WHERE path IS NOT NULL AND line IS NOT NULL GROUP BY ALL)
WHERE sim >= 0.18 OR prox >= 0.75 OR (sim >= 0.10 AND prox >= 0.45) OR (modules >= 3 AND block >= 0.9 AND prox >= 0.25)"""


def clamped_numbers(spark, d):
    """Artifact numbers as clamped values: hashes and blanks take the default."""
    return table(spark, d, "sides").select("number", clamp01(F.col("number"), 0.5).alias("value")).distinct()


SQL_CLAMPED = "SELECT DISTINCT number, CASE WHEN try_cast(number AS DOUBLE) IS NULL THEN 0.5 ELSE least(1, greatest(0, try_cast(number AS DOUBLE))) END::DOUBLE AS value FROM sides"

KS = [1, 3, 5, 8]


def file_metrics(spark, d):
    """Macro file metrics per method and k."""
    r = ranked_files(spark, d)
    grid = truth_files(spark, d).join(F.broadcast(r.select("method").distinct()))  # a handful of methods
    per = M.file_metrics(r, grid, ["pair_index", "method"], "path", KS)
    m = M.macro(per, ["method", "k"], ["precision", "recall", "f1", "rr"])
    return m.select("method", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "rr")], "queries")


_HITS = f"""
g AS (SELECT * FROM {TRUTH_FILES}), r AS (SELECT * FROM {RANKED_FILES}), q AS (SELECT DISTINCT pair_index FROM g), m AS (SELECT DISTINCT method FROM r),
ks AS (SELECT unnest([{', '.join(map(str, KS))}]) k), gt AS (SELECT pair_index, count(*) gt FROM g GROUP BY 1),
h AS (SELECT r.*, g.path IS NOT NULL hit FROM r LEFT JOIN g USING (pair_index, path)),
c AS (SELECT pair_index, method, k, count(*) n, count(*) FILTER (hit) hits, min(rank) FILTER (hit) first FROM h JOIN ks ON rank <= k GROUP BY ALL)"""
SQL_FILE_METRICS = f"""
WITH {_HITS}, e AS (SELECT method, k, coalesce(hits / nullif(n, 0), 0)::DOUBLE p, coalesce(hits, 0)::DOUBLE / gt r, coalesce(1.0::DOUBLE / first, 0) rr FROM gt CROSS JOIN m CROSS JOIN ks LEFT JOIN c USING (pair_index, method, k))
SELECT method, k, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(rr), 6) AS rr, count(*) AS queries FROM e GROUP BY ALL"""


def micro_file_metrics(spark, d):
    """Micro file metrics of the agent's list per k."""
    r = ranked_files(spark, d).filter("method = 'agent'")
    m = M.micro(r, truth_files(spark, d), KEY, "path", KS)
    return m.select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "hit_rate", "mrr")])


SQL_MICRO = f"""
WITH {_HITS}, a AS (SELECT pair_index, k, n, hits, first FROM c WHERE method = 'agent'), qs AS (SELECT DISTINCT pair_index FROM (SELECT pair_index FROM r WHERE method = 'agent' UNION ALL SELECT pair_index FROM g)),
e AS (SELECT k, coalesce(n, 0) n, coalesce(hits, 0) hits, coalesce(gt, 0) gt, first FROM qs CROSS JOIN ks LEFT JOIN gt USING (pair_index) LEFT JOIN a USING (pair_index, k)),
s AS (SELECT k, sum(hits) FILTER (gt > 0) h, sum(n) FILTER (gt > 0) n, sum(gt) gt, avg((hits > 0)::INT) hr, avg(coalesce(1.0::DOUBLE / first, 0)) mrr FROM e GROUP BY 1), t AS (SELECT k, h / n p, h / gt r, hr, mrr FROM s)
SELECT k, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(hr, 6) AS hit_rate, round(mrr, 6) AS mrr FROM t"""


def hit_table(spark, d):
    """Hit@1, 3, 5, MRR@5 and mean rank of every method over the judgement records."""
    return M.hits_at(truth_files(spark, d), ranked_files(spark, d).filter("rank <= 5"), ["pair_index", "path"], "method", [1, 3, 5], 6).withColumn("value", F.round("value", 6))


_HIT = f"WITH g AS (SELECT * FROM {TRUTH_FILES}), r AS (SELECT * FROM {RANKED_FILES} WHERE rank <= 5), e AS (SELECT m.method, rank FROM g CROSS JOIN (SELECT DISTINCT method FROM r) m LEFT JOIN r ON r.pair_index = g.pair_index AND r.path = g.path AND r.method = m.method)"
_METRICS = ", ".join(f"struct_pack(metric := '{n}', value := {v})" for n, v in (
    *((f"Hit@{k}", f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6)") for k in (1, 3, 5)), ("MRR@5", "round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END), 6)"), ("MeanRank", "round(avg(coalesce(rank, 6)), 6)")))
SQL_HITS = f"{_HIT}, s AS (SELECT method, count(*) n, [{_METRICS}] ms FROM e GROUP BY 1), u AS (SELECT method, n, unnest(ms) m FROM s) SELECT method, m.metric AS metric, m.value AS value, n FROM u"


def hit_pivot(spark, d):
    return M.pivot_metrics(hit_table(spark, d), "method", "metric", "value", ["Hit@1", "MRR@5"]).withColumnsRenamed({"Hit@1": "hit_1", "MRR@5": "mrr_5"})


SQL_PIVOT = f"{_HIT} SELECT method, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_5 FROM e GROUP BY 1"


def statement_metrics(spark, d):
    """Macro statement metrics at 100 with tolerance 2, per method."""
    r = ranked_statements(spark, d)
    grid = truth_ranges(spark, d).join(F.broadcast(r.select("method").distinct()))  # a handful of methods
    per = M.statement_metrics(r, grid, ["pair_index", "method"], 100, 2)
    m = M.macro(per, ["method"], ["precision", "coverage", "f1", "rr"])
    return m.select("method", *[F.round(c, 6).alias(c) for c in ("precision", "coverage", "f1", "rr")], "queries")


SQL_STATEMENT_METRICS = f"""
WITH r AS (SELECT * FROM {RANKED_STATEMENTS} WHERE rank <= 100), m AS (SELECT DISTINCT method FROM {RANKED_STATEMENTS}), g AS (SELECT * FROM {TRUTH_RANGES} CROSS JOIN m),
x AS (SELECT r.pair_index, r.method, r.path, r.line, r.rank, g."start", g."end" FROM r JOIN g ON r.pair_index = g.pair_index AND r.method = g.method AND r.path = g.path AND r.line BETWEEN g."start" - 2 AND g."end" + 2),
h AS (SELECT pair_index, method, count(DISTINCT (path, line)) hits, min(rank) first, count(DISTINCT (path, "start", "end")) covered FROM x GROUP BY ALL),
n AS (SELECT pair_index, method, count(*) n FROM r GROUP BY ALL), gt AS (SELECT pair_index, method, count(*) gt FROM g GROUP BY ALL),
e AS (SELECT method, coalesce(hits::DOUBLE / n, 0) p, coalesce(covered, 0)::DOUBLE / gt c, coalesce(1.0::DOUBLE / first, 0) rr FROM gt LEFT JOIN n USING (pair_index, method) LEFT JOIN h USING (pair_index, method))
SELECT method, round(avg(p), 6) AS precision, round(avg(c), 6) AS coverage, round(avg(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END), 6) AS f1, round(avg(rr), 6) AS rr, count(*) AS queries FROM e GROUP BY 1"""


def split_metrics(spark, d):
    """Recall of the agent's first five, for simple and hard pairs and for all (grouping sets); hard: eight judged files or more."""
    r = ranked_files(spark, d).filter("method = 'agent'")
    per = M.file_metrics(r, truth_files(spark, d), KEY, "path", [5])
    size = truth_files(spark, d).groupBy("pair_index").agg(F.count(F.lit(1)).alias("n"))
    s = per.join(size, "pair_index").withColumn("split", F.when(F.col("n") >= 8, "hard").otherwise("simple"))
    return s.rollup("split").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("pairs")).withColumn("split", F.coalesce("split", F.lit("all")))


SQL_SPLIT = f"""
WITH {_HITS}, e AS (SELECT CASE WHEN gt >= 8 THEN 'hard' ELSE 'simple' END split, coalesce(hits, 0)::DOUBLE / gt r FROM gt LEFT JOIN (SELECT * FROM c WHERE method = 'agent' AND k = 5) USING (pair_index))
SELECT coalesce(split, 'all') AS split, round(avg(r), 6) AS recall, count(*) AS pairs FROM e GROUP BY ROLLUP (split)"""


def merged_parts(spark, d):
    """Means of per-part means (pairs in seven parts), weighted by their pairs: the mean over all."""
    r = ranked_files(spark, d).filter("method = 'agent'")
    per = M.file_metrics(r, truth_files(spark, d), KEY, "path", [5]).withColumn("part", F.pmod("pair_index", F.lit(7)))
    parts = per.groupBy("part").agg(F.avg("recall").alias("recall"), F.avg("rr").alias("rr"), F.count(F.lit(1)).alias("pairs")).withColumn("method", F.lit("agent"))
    return M.weighted_merge(parts, ["method"], ["recall", "rr"], "pairs").select("method", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "pairs")


SQL_PARTS = f"WITH {_HITS} SELECT 'agent' AS method, round(avg(coalesce(hits, 0)::DOUBLE / gt), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS rr, count(*) AS pairs FROM gt LEFT JOIN (SELECT * FROM c WHERE method = 'agent' AND k = 5) USING (pair_index)"


def quota_files(spark, d):
    """Exact counterparts, one file per source, then the best of the pool."""
    t = table(spark, d, "target_files").filter(F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("matched_source_path").isNotNull())
    best = t.groupBy("pair_index", F.col("matched_source_path").alias("source_path"), "path").agg(F.max("confidence").alias("score"))
    pool = R.top_k(best, ["pair_index", "source_path"], [F.col("score").desc(), F.col("path")], 10).drop("rank")
    from pyspark.sql import Window

    pool = pool.withColumn("source_order", F.dense_rank().over(Window.partitionBy("pair_index").orderBy("source_path")))
    return R.source_quota(pool.filter("path = source_path"), pool.filter("path <> source_path"), "pair_index", 10)


QUERIES = {
    "file_topk": (file_topk, f"SELECT pair_index, method, path, score, rank::INT AS rank FROM {RANKED_FILES} WHERE rank <= 5"),
    "statement_topk": (statement_topk, f"SELECT pair_index, method, path, line, score, symbol, rank::INT AS rank FROM {RANKED_STATEMENTS} WHERE rank <= 10"),
    "first_wins_statements": (first_wins_statements, SQL_FIRST),
    "merged_lists": (merged_lists, SQL_MERGED),
    "head_then_expand": (head_then_expand, SQL_HEAD),
    "round_robin_sources": (round_robin_sources, SQL_RR),
    "round_robin_capped": (round_robin_capped, SQL_RR_CAP),
    "rrf_files": (rrf_files, SQL_RRF),
    "weighted_fusion": (weighted_fusion, SQL_WEIGHTED),
    "vote_fusion": (vote_fusion, SQL_VOTE),
    "tiered_files": (tiered_files, SQL_TIERED),
    "candidate_blocks": (candidate_blocks, SQL_BLOCKS),
    "block_probes": (block_probes, SQL_PROBES),
    "gated_statements": (gated_statements, SQL_GATED),
    "clamped_numbers": (clamped_numbers, SQL_CLAMPED),
    "file_metrics": (file_metrics, SQL_FILE_METRICS),
    "micro_file_metrics": (micro_file_metrics, SQL_MICRO),
    "hit_table": (hit_table, SQL_HITS),
    "hit_pivot": (hit_pivot, SQL_PIVOT),
    "statement_metrics": (statement_metrics, SQL_STATEMENT_METRICS),
    "split_metrics": (split_metrics, SQL_SPLIT),
    "merged_parts": (merged_parts, SQL_PARTS),
    "quota_files": (quota_files, None),
}
