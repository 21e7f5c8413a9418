"""Inputs shared by the core's queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.paths import tidy
from driftline.runtime import table


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tidy_sql(x: str) -> str:
    return rf"regexp_replace({strip_sql(x)}, '^(?:\./+)+', '')"


def side_files(spark: SparkSession, d: str, role: str) -> DataFrame:
    """(pair_index, path) of the files of a role's sides."""
    s = table(spark, d, "sides").filter(F.col("role") == role)
    return s.select("pair_index", F.explode("file_names").alias("p")).select("pair_index", tidy(F.col("p")).alias("path")).filter("path <> ''").distinct()


def files_sql(role: str) -> str:
    return f"(SELECT DISTINCT pair_index, {tidy_sql('p')} path FROM (SELECT pair_index, unnest(file_names) p FROM sides WHERE role = '{role}') WHERE {tidy_sql('p')} <> '')"


def all_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct path named by sides and patch statements."""
    a = table(spark, d, "sides").select(F.explode("file_names").alias("p"))
    b = table(spark, d, "patch_statements").select(F.col("path").alias("p"))
    return a.unionByName(b).select(tidy(F.col("p")).alias("path")).filter("path <> ''").distinct()


PATHS = f"(SELECT DISTINCT {tidy_sql('p')} path FROM (SELECT unnest(file_names) p FROM sides UNION ALL SELECT path FROM patch_statements) WHERE {tidy_sql('p')} <> '')"


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Distinct patch statements with tidy paths."""
    return table(spark, d, "patch_statements").withColumn("path", tidy(F.col("path"))).filter("path <> ''").distinct()


STATEMENTS = f"(SELECT DISTINCT pair_index, side, {tidy_sql('path')} path, line_no, kind, text, ord FROM patch_statements WHERE {tidy_sql('path')} <> '')"


def ranked_files(spark: SparkSession, d: str) -> DataFrame:
    """(pair_index, method, path, score, rank): target files per pair and method by their highest confidence."""
    c = F.col("confidence")
    best = table(spark, d, "target_files").filter(c.isNotNull() & ~F.isnan(c)).groupBy("pair_index", "method", "path").agg(F.max(c).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("pair_index", "method").orderBy(F.col("score").desc(), "path")))


RANKED_FILES = "(SELECT *, row_number() OVER (PARTITION BY pair_index, method ORDER BY score DESC, path) AS rank FROM (SELECT pair_index, method, path, max(confidence) score FROM target_files WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL))"


def ranked_statements(spark: SparkSession, d: str) -> DataFrame:
    """(pair_index, method, path, line, score, symbol, rank): statements per pair and method by their highest score."""
    c = F.col("score")
    best = table(spark, d, "target_statements").filter(c.isNotNull() & ~F.isnan(c)).groupBy("pair_index", "method", "path", "line").agg(F.max(c).alias("score"), F.min("target_symbol").alias("symbol"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("pair_index", "method").orderBy(F.col("score").desc(), "path", "line")))


RANKED_STATEMENTS = "(SELECT *, row_number() OVER (PARTITION BY pair_index, method ORDER BY score DESC, path, line) AS rank FROM (SELECT pair_index, method, path, line, max(score) score, min(target_symbol) symbol FROM target_statements WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL))"


def truth_files(spark: SparkSession, d: str) -> DataFrame:
    """(pair_index, path): judged target files."""
    return table(spark, d, "file_pair_records").select("pair_index", F.col("target_file").alias("path")).dropna().distinct()


TRUTH_FILES = "(SELECT DISTINCT pair_index, target_file path FROM file_pair_records WHERE pair_index IS NOT NULL AND target_file IS NOT NULL)"


def truth_ranges(spark: SparkSession, d: str) -> DataFrame:
    """(pair_index, path, start, end): changed old lines of the downstream side, one closed range per run of close lines."""
    s = statements(spark, d).filter("side = 'Infestor' and kind <> 'context'").select("pair_index", "path", F.col("line_no").alias("line")).distinct()
    w = Window.partitionBy("pair_index", "path").orderBy("line")
    new = s.withColumn("new", F.coalesce((F.col("line") - F.lag("line").over(w) > 5).cast("int"), F.lit(1)))
    run = new.withColumn("run", F.sum("new").over(w))
    return run.groupBy("pair_index", "path", "run").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("run")


TRUTH_RANGES = f"""(SELECT pair_index, path, min(line)::INT AS start, max(line)::INT AS "end" FROM (
  SELECT *, sum(new) OVER (PARTITION BY pair_index, path ORDER BY line) run FROM (
    SELECT *, coalesce((line - lag(line) OVER (PARTITION BY pair_index, path ORDER BY line) > 5)::INT, 1) new FROM (
      SELECT DISTINCT pair_index, path, line_no line FROM {STATEMENTS} WHERE side = 'Infestor' AND kind <> 'context'))) GROUP BY pair_index, path, run)"""
