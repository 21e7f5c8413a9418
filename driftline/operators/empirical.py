"""Propagation facts: who adopts from whom, how late, and what kind of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.paths import tidy
from driftline.functions.text import change_type, first_truthy


def parse_time(c: Column) -> Column:
    """A timestamp (UTC) of an ISO text with T or blank and optional zone; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(c))


def latest_sides(sides: DataFrame) -> DataFrame:
    """One row per side, the one fetched last."""
    rest = [c for c in sides.columns if c != "side_id"]
    return sides.groupBy("side_id").agg(F.max_by(F.struct(*rest), "fetched_at").alias("s")).select("side_id", "s.*")


def side_time() -> Column:
    return F.coalesce(parse_time(F.col("created_at")), parse_time(F.col("merged_at")))


def side_title() -> Column:
    return first_truthy(F.col("title"), F.split_part(F.col("message"), F.lit("\n"), F.lit(1)))


def change_id() -> Column:
    return F.when((F.col("kind") == "pr") & (F.col("number") != ""), F.concat(F.lit("PR #"), F.col("number"))).when(F.col("merged_sha") != "", F.substring("merged_sha", 1, 8)).otherwise("unknown")


def facts(sides: DataFrame) -> DataFrame:
    """One row per pair of two dated sides of different repositories, the earlier as source (ties: the Source side)."""
    files = F.size(F.array_distinct(F.filter(F.transform(F.coalesce("file_names", F.array().cast("array<string>")), tidy), lambda x: x != "")))
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "body", "message")])
    s = latest_sides(sides).select("pair_index", "role", "repo", change_id().alias("id"), side_title().alias("title"), side_time().alias("t"), files.alias("files"), text.alias("text"), "url")
    a = s.filter("role = 'Source'").select("pair_index", F.struct("repo", "id", "title", "t", "files", "text", "url").alias("a"))
    b = s.filter("role = 'Infestor'").select("pair_index", F.struct("repo", "id", "title", "t", "files", "text", "url").alias("b"))
    both = a.join(b, "pair_index").filter("a.t is not null and b.t is not null and a.repo <> b.repo")
    earlier = F.col("a.t") <= F.col("b.t")
    x, y = F.when(earlier, F.col("a")).otherwise(F.col("b")), F.when(earlier, F.col("b")).otherwise(F.col("a"))
    p = both.select("pair_index", x.alias("x"), y.alias("y"), F.concat_ws(" ", "a.text", "b.text").alias("text"))
    days = F.greatest(F.lit(0.0), (F.unix_micros("y.t") - F.unix_micros("x.t")) / 86_400_000_000)
    return p.select(
        "pair_index", F.col("x.repo").alias("source_repo"), F.col("y.repo").alias("target_repo"), F.concat(F.col("x.repo"), F.lit(" -> "), F.col("y.repo")).alias("direction"),
        F.col("x.id").alias("source_id"), F.col("y.id").alias("target_id"), F.col("x.title").alias("source_title"), F.col("y.title").alias("target_title"),
        F.col("x.t").alias("source_at"), F.col("y.t").alias("target_at"), F.year("y.t").alias("adopter_year"), F.round(days, 6).alias("delay_days"), change_type(F.col("text")).alias("change_type"),
        F.col("x.files").alias("source_files"), F.col("y.files").alias("target_files"),
    )


# Half-open bins of days.
LATENCY_BINS = [(0, 1, "<=1d"), (1, 7, "1-7d"), (7, 30, "7-30d"), (30, 90, "30-90d"), (90, 365, "90-365d"), (365, None, ">365d")]


def latency_histogram(f: DataFrame) -> DataFrame:
    """(bin, label, pairs) of every bin, empty ones with 0."""
    spark = f.sparkSession
    which = F.lit(None).cast("int")
    for i, (lo, hi, _) in reversed(list(enumerate(LATENCY_BINS))):
        inside = F.col("delay_days") >= lo if hi is None else (F.col("delay_days") >= lo) & (F.col("delay_days") < hi)
        which = F.when(inside, F.lit(i)).otherwise(which)
    bins = spark.createDataFrame([(i, label) for i, (_, _, label) in enumerate(LATENCY_BINS)], "bin int, label string")
    return bins.join(f.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("pairs")), "bin", "left").na.fill(0, ["pairs"])


def latency_quantiles(f: DataFrame, keys: list[str]) -> DataFrame:
    """P10 to P90 of positive delays."""
    q = F.percentile("delay_days", F.array(*[F.lit(x) for x in (0.10, 0.25, 0.50, 0.75, 0.90)]))
    per = f.filter("delay_days > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), q.alias("q"))
    return per.select(*keys, "pairs", *[F.round(F.get("q", i), 6).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))])


def direction_matrix(f: DataFrame, top: int = 6) -> DataFrame:
    """(source_repo, target_repo, pairs) over the repositories most involved, dense with 0."""
    roles = f.select(F.explode(F.array("source_repo", "target_repo")).alias("repo"))
    names = roles.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "repo").limit(top).select("repo")
    grid = names.select(F.col("repo").alias("source_repo")).join(F.broadcast(names.select(F.col("repo").alias("target_repo"))))  # top x top rows
    return grid.join(f.groupBy("source_repo", "target_repo").agg(F.count(F.lit(1)).alias("pairs")), ["source_repo", "target_repo"], "left").na.fill(0, ["pairs"])


def yearly_trend(f: DataFrame, top: int = 4) -> DataFrame:
    """(adopter_year, direction, pairs) of the most frequent directions, dense with 0."""
    names = f.groupBy("direction").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "direction").limit(top).select("direction")
    grid = f.select("adopter_year").distinct().join(F.broadcast(names))  # years x top rows
    return grid.join(f.groupBy("adopter_year", "direction").agg(F.count(F.lit(1)).alias("pairs")), ["adopter_year", "direction"], "left").na.fill(0, ["pairs"])


def type_by_direction(f: DataFrame) -> DataFrame:
    return f.groupBy("direction", "change_type").agg(F.count(F.lit(1)).alias("pairs"))


def show_days(c: Column) -> Column:
    """Hours below a day, one decimal below 30 days, else whole days."""
    return F.when(c < 1, F.format_string("%.1f h", c * 24)).when(c < 30, F.format_string("%.1f d", c)).otherwise(F.format_string("%.0f d", c))


def split_share(f: DataFrame) -> DataFrame:
    """Pairs and their share, by type, by direction and in all (grouping sets)."""
    per = f.cube("direction", "change_type").agg(F.count(F.lit(1)).alias("pairs"), F.grouping_id().alias("level"))
    return per.withColumn("share", F.round(F.col("pairs") / F.sum("pairs").over(Window.partitionBy("level")), 6))


def log_place(value, most: float, left: float = 0.0, width: float = 1.0):
    """Where a value stands on an axis of log10(v + 1) from ``left`` over ``width``, ``most`` being its end."""
    return F.lit(float(left)) + F.lit(float(width)) * F.log10(value + 1) / F.log10(F.lit(float(max(most, 1.0)) + 1))
