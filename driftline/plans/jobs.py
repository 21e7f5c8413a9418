"""Whole runs: input tables in, result tables out, resumable by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import judge as J
from driftline.operators import metrics as M
from driftline.operators import ranking as R
from driftline.operators import retrieval as T
from driftline.operators import statements as S
from driftline.operators.empirical import facts, latency_histogram, latency_quantiles, type_by_direction
from driftline.operators.judge import assert_no_truth
from driftline.plans import common as C
from driftline.runtime import table
from driftline.sources.sinks import append_new, markdown_table, write_csv


def file_localization(spark: SparkSession, d: str, k: int = 10, judge: J.Judge | None = None) -> DataFrame:
    """Ranked target files per pair: exact counterparts and proposals first, then the prefilter; a judge may reorder the head."""
    source, target = C.side_files(spark, d, "Source"), assert_no_truth(C.side_files(spark, d, "Infestor"))
    terms = T.terms_of(C.statements(spark, d).filter("side = 'Source'"))
    exact = T.exact_counterparts(source, target).withColumn("score", F.lit(1.0))
    pool = T.path_prefilter(source, target, terms, 2 * k).select("pair_index", "path", "score")
    ranked = R.tiered([exact, pool], ["pair_index"], ["path"], ["score", "path"], k).select("pair_index", "path", "rank")
    if judge is None:
        return ranked
    tasks = table(spark, d, "sides").filter("role = 'Source'").groupBy("pair_index").agg(F.min(F.concat_ws(" ", "title", "message")).alias("task"))
    return J.reorder(ranked, J.ask(J.prompts(tasks, ranked, ["pair_index"], "task", "path", "rank"), judge), ["pair_index"], "path", "rank", k)


def statement_localization(spark: SparkSession, d: str, files: DataFrame, k: int = 100) -> DataFrame:
    """Ranked lines of the ranked files: similarity to the source patch and the file's place."""
    f = files.select("pair_index", "path", (1.0 / F.col("rank")).alias("score"), F.col("path").alias("matched_source_path"))
    lines = table(spark, d, "target_statements").select("pair_index", "path", "line", F.col("line_text").alias("text")).dropna().distinct().join(f.select("pair_index", "path"), ["pair_index", "path"], "left_semi")
    return S.rank_statements(lines, S.comparable(C.statements(spark, d).filter("side = 'Source'"), f), f, k)


def evaluation(spark: SparkSession, d: str, files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file metrics, statement metrics), each one row of means."""
    f = M.macro(M.file_metrics(files, C.truth_files(spark, d), ["pair_index"], "path", [10]), ["k"], ["precision", "recall", "f1", "rr"])
    s = M.macro(M.statement_metrics(lines, C.truth_ranges(spark, d), ["pair_index"], 100, 2), [], ["precision", "coverage", "f1", "rr"])
    return f, s


def ablation(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """File metrics with all actions and without each: exact counterparts, proposals, companions."""
    source, target = C.side_files(spark, d, "Source"), C.side_files(spark, d, "Infestor")
    parts = {
        "exact": T.exact_counterparts(source, target).withColumn("score", F.lit(1.0)), "propose": T.proposed_files(source, target), "companions": T.companions(source, target, k).select("pair_index", "path", "score"),
        "similar": T.rank_files(source, target, 2 * k).select("pair_index", "path", "score"),
    }
    out = None
    for without in (None, "exact", "propose", "companions"):
        tiers = [t for name, t in parts.items() if name != without]
        ranked = R.tiered(tiers, ["pair_index"], ["path"], ["score", "path"], k).select("pair_index", "path", "rank")
        m = M.macro(M.file_metrics(ranked, C.truth_files(spark, d), ["pair_index"], "path", [k]), ["k"], ["precision", "recall", "f1", "rr"]).withColumn("method", F.lit(f"without {without}" if without else "all"))
        out = m if out is None else out.unionByName(m)
    return out


def resume(results: DataFrame, path: str) -> int:
    """Appends the results of pairs that are not at ``path`` yet."""
    return append_new(results, path, ["pair_index"])


def empirical(spark: SparkSession, d: str, out: str) -> str:
    """Facts as CSV below ``out``; returns the report in Markdown."""
    f = facts(table(spark, d, "sides"))
    write_csv(f, f.columns, f"{out}/facts")
    return "\n".join([
        markdown_table("Latency in days", latency_quantiles(f, [])), markdown_table("Latency bins", latency_histogram(f).orderBy("bin")),
        markdown_table("Change types by direction", type_by_direction(f).orderBy(F.col("pairs").desc(), "direction", "change_type"), 60),
    ])
