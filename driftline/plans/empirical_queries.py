"""Propagation facts and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.text import CHANGE_TYPES
from driftline.operators import empirical as E
from driftline.plans.common import tidy_sql
from driftline.runtime import table


def _facts(spark, d):
    return E.facts(table(spark, d, "sides"))


_TIME = lambda c: rf"CASE WHEN regexp_full_match({c}, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:Z|[+-]\d{{2}}:\d{{2}})?') THEN try_cast(regexp_replace({c}, '(Z|[+-]\d{{2}}:\d{{2}})?$', '') AS TIMESTAMP) - to_seconds(coalesce(try_cast(nullif(regexp_extract({c}, '([+-]\d{{2}}):\d{{2}}$', 1), '') AS INT), 0) * 3600) END"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for n, p in CHANGE_TYPES) + " ELSE 'maintenance' END"
_FILES = f"len(list_distinct(list_filter(list_transform(coalesce(file_names, []), lambda x: {tidy_sql('x')}), lambda x: x <> '')))"
FACTS = f"""
s AS (
  SELECT pair_index, role, repo, CASE WHEN kind = 'pr' AND number <> '' THEN 'PR #' || number WHEN merged_sha <> '' THEN substring(merged_sha, 1, 8) ELSE 'unknown' END id,
    coalesce(nullif(title, ''), nullif(split_part(message, chr(10), 1), '')) title, coalesce({_TIME('created_at')}, {_TIME('merged_at')}) t, {_FILES} files,
    coalesce(title, '') || ' ' || coalesce(body, '') || ' ' || coalesce(message, '') txt
  FROM (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY side_id ORDER BY fetched_at DESC) = 1)),
p AS (
  SELECT a.pair_index, CASE WHEN a.t <= b.t THEN a ELSE b END x, CASE WHEN a.t <= b.t THEN b ELSE a END y, lower(a.txt || ' ' || b.txt) low
  FROM s a JOIN s b ON a.pair_index = b.pair_index AND a.role = 'Source' AND b.role = 'Infestor' WHERE a.t IS NOT NULL AND b.t IS NOT NULL AND a.repo <> b.repo),
f AS (
  SELECT pair_index, x.repo source_repo, y.repo target_repo, x.repo || ' -> ' || y.repo direction, x.id source_id, y.id target_id, x.title source_title, y.title target_title,
    x.t source_at, y.t target_at, year(y.t)::INT adopter_year, round(greatest(0, (epoch_us(y.t) - epoch_us(x.t)) / 86400000000), 6) delay_days, {_TYPE} change_type, x.files::INT source_files, y.files::INT target_files FROM p)"""


def propagation_facts(spark, d):
    return _facts(spark, d)


def latency_quantiles(spark, d):
    return E.latency_quantiles(_facts(spark, d), [])


_Q = ", ".join(f"round(quantile_cont(delay_days, {q}), 6) AS {n}" for n, q in (("p10", 0.10), ("p25", 0.25), ("p50", 0.50), ("p75", 0.75), ("p90", 0.90)))


def latency_by_direction(spark, d):
    return E.latency_quantiles(_facts(spark, d), ["direction"])


def latency_by_type(spark, d):
    return E.latency_quantiles(_facts(spark, d), ["change_type"])


def latency_histogram(spark, d):
    return E.latency_histogram(_facts(spark, d))


_BIN = "CASE WHEN delay_days < 1 THEN 0 WHEN delay_days < 7 THEN 1 WHEN delay_days < 30 THEN 2 WHEN delay_days < 90 THEN 3 WHEN delay_days < 365 THEN 4 ELSE 5 END"


def direction_matrix(spark, d):
    return E.direction_matrix(_facts(spark, d))


def yearly_trend(spark, d):
    return E.yearly_trend(_facts(spark, d))


def type_by_direction(spark, d):
    return E.type_by_direction(_facts(spark, d))


def type_direction_cube(spark, d):
    return E.split_share(_facts(spark, d))


def file_scale(spark, d):
    """File counts of both sides, clipped to 1..50, per fact."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1)), F.lit(50))
    return _facts(spark, d).select("pair_index", clip("source_files").alias("x"), clip("target_files").alias("y"))


def propagation_summary(spark, d):
    f = _facts(spark, d)
    return f.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("direction").alias("directions"), F.min("delay_days").alias("min_days"), F.round(F.percentile("delay_days", F.lit(0.5)), 6).alias("median_days"),
        F.max("delay_days").alias("max_days"), F.round(F.percentile("source_files", F.lit(0.9)), 6).alias("source_files_p90"), F.round(F.percentile("target_files", F.lit(0.5)), 6).alias("target_files_median"), F.count_if(F.col("delay_days") > 0).alias("positive"),
    )


def practical_coverage(spark, d):
    """File and statement coverage per downstream repository and in all; cases without statements stay out of theirs."""
    p = table(spark, d, "practical_localization_results_14").distinct()
    r = p.rollup("target_repo").agg(
        F.grouping("target_repo").cast("int").alias("total"), F.count(F.lit(1)).alias("cases"), F.sum("file_hits").alias("file_hits"), F.sum("file_total").alias("file_total"), F.count("statement_total").alias("judged"),
        F.round(F.sum(F.when(F.col("statement_total").isNotNull(), F.col("statement_hits"))) / F.sum("statement_total"), 6).alias("coverage"),
    )
    return r


QUERIES = {
    "propagation_facts": (propagation_facts, f"WITH {FACTS} SELECT * FROM f"),
    "latency_quantiles": (latency_quantiles, f"WITH {FACTS} SELECT count(*) pairs, {_Q} FROM f WHERE delay_days > 0"),
    "latency_by_direction": (latency_by_direction, f"WITH {FACTS} SELECT direction, count(*) pairs, {_Q} FROM f WHERE delay_days > 0 GROUP BY 1"),
    "latency_by_type": (latency_by_type, f"WITH {FACTS} SELECT change_type, count(*) pairs, {_Q} FROM f WHERE delay_days > 0 GROUP BY 1"),
    "latency_histogram": (latency_histogram, f"WITH {FACTS}, b AS (SELECT * FROM (VALUES {', '.join(f'''({i}, '{x[2]}')''' for i, x in enumerate(E.LATENCY_BINS))}) v(bin, label)), c AS (SELECT {_BIN} bin, count(*) pairs FROM f GROUP BY 1) SELECT bin, label, coalesce(pairs, 0) pairs FROM b LEFT JOIN c USING (bin)"),
    "direction_matrix": (direction_matrix, f"WITH {FACTS}, n AS (SELECT repo FROM (SELECT source_repo repo FROM f UNION ALL SELECT target_repo FROM f) GROUP BY 1 ORDER BY count(*) DESC, repo LIMIT 6), c AS (SELECT source_repo, target_repo, count(*) pairs FROM f GROUP BY ALL) SELECT a.repo source_repo, b.repo target_repo, coalesce(pairs, 0) pairs FROM n a CROSS JOIN n b LEFT JOIN c ON c.source_repo = a.repo AND c.target_repo = b.repo"),
    "yearly_trend": (yearly_trend, f"WITH {FACTS}, n AS (SELECT direction FROM f GROUP BY 1 ORDER BY count(*) DESC, direction LIMIT 4), c AS (SELECT adopter_year, direction, count(*) pairs FROM f GROUP BY ALL) SELECT y.adopter_year, n.direction, coalesce(pairs, 0) pairs FROM (SELECT DISTINCT adopter_year FROM f) y CROSS JOIN n LEFT JOIN c ON c.adopter_year = y.adopter_year AND c.direction = n.direction"),
    "type_by_direction": (type_by_direction, f"WITH {FACTS} SELECT direction, change_type, count(*) pairs FROM f GROUP BY ALL"),
    "type_direction_cube": (type_direction_cube, f"WITH {FACTS}, c AS (SELECT direction, change_type, count(*) pairs, grouping(direction, change_type) AS level FROM f GROUP BY CUBE (direction, change_type)) SELECT *, round(pairs / sum(pairs) OVER (PARTITION BY level), 6) AS share FROM c"),
    "file_scale": (file_scale, f"WITH {FACTS} SELECT pair_index, least(greatest(source_files, 1), 50) x, least(greatest(target_files, 1), 50) y FROM f"),
    "propagation_summary": (propagation_summary, f"WITH {FACTS} SELECT count(*) pairs, count(DISTINCT direction) directions, min(delay_days) min_days, round(quantile_cont(delay_days, 0.5), 6) median_days, max(delay_days) max_days, round(quantile_cont(source_files::DOUBLE, 0.9), 6) source_files_p90, round(quantile_cont(target_files::DOUBLE, 0.5), 6) target_files_median, count(*) FILTER (delay_days > 0) positive FROM f"),
    "practical_coverage": (practical_coverage, "SELECT target_repo, grouping(target_repo)::INT AS total, count(*) cases, sum(file_hits)::BIGINT file_hits, sum(file_total)::BIGINT file_total, count(statement_total) judged, round(sum(statement_hits) FILTER (statement_total IS NOT NULL) / sum(statement_total), 6) coverage FROM (SELECT DISTINCT * FROM practical_localization_results_14) GROUP BY ROLLUP (target_repo)"),
}
