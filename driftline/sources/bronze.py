"""Readers of raw change data, and the cached store of fetched artifacts.

Services are not called from queries: what was fetched lies in bronze tables
keyed by the hash of its url. A fetch run asks for what is missing only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = (
    "project STRING, type STRING, number STRING, pr_number INT, issue_number INT, commit_sha STRING, title STRING, body STRING, message STRING, commit_message STRING, created_at STRING, date STRING, "
    "merged_at STRING, closed_at STRING, updated_at STRING, html_url STRING, base_commit_sha STRING, merged_sha STRING, file_names ARRAY<STRING>, file_names_all ARRAY<STRING>, primary_file_names ARRAY<STRING>, auxiliary_file_names ARRAY<STRING>, "
    "resolved_by STRUCT<type: STRING, number: STRING, pr_number: INT, commit_sha: STRING, base_commit_sha: STRING, merged_sha: STRING, title: STRING, body: STRING, message: STRING, html_url: STRING, file_names: ARRAY<STRING>>"
)


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def pair_schema() -> T.StructType:
    side = _struct(SIDE)
    return T.StructType([
        T.StructField("pair_index", T.IntegerType()), T.StructField("case_id", T.StringType()), T.StructField("original_index", T.IntegerType()), T.StructField("_dataset_index", T.IntegerType()),
        T.StructField("_combined_hard_origin", T.StringType()), T.StructField("Source", side), T.StructField("Infestor", side),
        T.StructField("_curation", _struct("exact_file_overlap DOUBLE, file_similarity DOUBLE, text_similarity DOUBLE, direct_source_url_in_infestor_text BOOLEAN")), T.StructField("_manual_curation", _struct("difficulty STRING")),
    ])


def read_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pairs by their fixed schema; values that don't fit become null.

    A JSON array is one task a file, however large; with ``lines`` the files hold a pair a line
    (see :func:`to_lines`) and are split like any other.
    """
    return spark.read.schema(pair_schema()).json(path, multiLine=not lines)


def to_lines(spark: SparkSession, path: str, out: str) -> None:
    """Once for large inputs: JSON arrays written again with a pair a line."""
    read_pairs(spark, path).write.mode("overwrite").json(out)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON object's ``results`` array."""
    return spark.read.schema(f"results ARRAY<STRUCT<{schema}>>").json(path, multiLine=True).select(F.inline("results"))


def sides_of(pairs: DataFrame) -> DataFrame:
    """(pair_index, role, ...): both sides of each pair, an issue's artifact taken from what resolved it.

    Empty texts and arrays count as missing. Sides without project or merged
    revision are left out, and pairs of which one side is.
    """
    def text(*cols):
        return F.coalesce(*[F.when(c != "", c) for c in cols])

    def names(*cols):
        return F.coalesce(*[F.when(F.size(c) > 0, c) for c in cols])

    one = lambda role: pairs.select("pair_index", F.lit(role).alias("role"), F.col(role).alias("s"))
    both = one("Source").unionByName(one("Infestor"))
    s, r = "s.", "s.resolved_by."
    rows = both.select(
        "pair_index", "role", F.col(s + "project").alias("project"), text(F.col(r + "type"), F.col(s + "type")).alias("kind"),
        text(F.col(r + "number"), F.col(s + "number"), F.col(s + "pr_number").cast("string"), F.col(s + "issue_number").cast("string"), F.col(s + "commit_sha")).alias("number"),
        text(F.col(s + "title"), F.col(r + "title")).alias("title"), text(F.col(s + "body"), F.col(r + "body")).alias("body"), text(F.col(s + "message"), F.col(s + "commit_message"), F.col(r + "message")).alias("message"),
        text(F.col(s + "html_url"), F.col(r + "html_url")).alias("url"), text(F.col(s + "merged_at"), F.col(s + "date")).alias("merged_at"), text(F.col(s + "created_at"), F.col(s + "date")).alias("created_at"),
        text(F.col(r + "base_commit_sha"), F.col(s + "base_commit_sha")).alias("base_sha"), text(F.col(r + "merged_sha"), F.col(r + "commit_sha"), F.col(s + "merged_sha"), F.col(s + "commit_sha")).alias("merged_sha"),
        names(F.col(s + "primary_file_names"), F.col(r + "file_names"), F.col(s + "file_names")).alias("file_names"),
    ).filter("project is not null and merged_sha is not null")
    whole = rows.groupBy("pair_index").agg(F.count_distinct("role").alias("n")).filter("n = 2").select("pair_index")
    return rows.join(whole, "pair_index", "left_semi")


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def missing(requests: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """Requests whose answer is not in the cache (key, body)."""
    return requests.withColumn("key", url_key(F.col(url))).join(cache.select("key"), "key", "left_anti")


def fetch(requests: DataFrame, get: Callable[[str], "str | None"], tries: int = 3) -> DataFrame:
    """(key, url, body, error) of each request, ``get`` being called within tasks; a lasting failure gives an error, not an end."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bodies, errors = [], []
            for u in f["url"]:
                body, error = None, None
                for _ in range(tries):
                    try:
                        body, error = get(u), None
                        break
                    except Exception as e:  # noqa: BLE001 - kept as the row's error
                        error = f"{type(e).__name__}: {e}"
                bodies.append(body)
                errors.append(error)
            yield pd.DataFrame({"key": f["key"], "url": f["url"], "body": bodies, "error": errors})

    return requests.select("key", "url").mapInPandas(run, "key string, url string, body string, error string")


def changed_files(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Files with patches where a change has them, else its file names with empty patches."""
    bare = fallback.join(primary.select(*keys).distinct(), keys, "left_anti").select(*keys, F.explode("file_names").alias("filename"), F.lit("").alias("patch"))
    return primary.select(*keys, "filename", "patch").unionByName(bare)


def file_at(tree: DataFrame, blobs: DataFrame, limit: int | None = 250_000) -> DataFrame:
    """(repo, sha, path, text): the files of snapshots; null where a blob is absent, none beyond ``limit`` bytes."""
    rows = tree.filter("type = 'blob'").join(blobs, "blob", "left")
    if limit is not None:
        rows = rows.filter(F.col("text").isNull() | (F.octet_length("text") <= limit))
    return rows.select("repo", "sha", "path", "text")


def tree_paths(tree: DataFrame) -> DataFrame:
    """(repo, sha, path): the files of snapshots, without directories and submodules."""
    return tree.filter("type = 'blob'").select("repo", "sha", "path")


def plain_go_paths(tree: DataFrame) -> DataFrame:
    """Of those the Go sources that are no tests and not made by a tool, by their names."""
    from driftline.functions.paths import is_plain_go

    return tree_paths(tree).filter(is_plain_go(F.col("path")))


def file_patch(wanted: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (keys, path) with the patch of the file of that name, '' where the change has none."""
    first = files.groupBy(*keys, F.col("filename").alias("path")).agg(F.max("patch").alias("patch"))
    return wanted.join(first, [*keys, "path"], "left").withColumn("patch", F.coalesce("patch", F.lit("")))


def api_url(base: str, path: Column) -> Column:
    """The address of a path below a service, its parts escaped."""
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(parts, "/"))


def pull_pages(requests: DataFrame, counts: DataFrame, keys: list[str], per_page: int = 100) -> DataFrame:
    """(keys, page): the pages that list a change's files, one request each, so that they are fetched apart."""
    n = F.greatest(F.lit(1), F.ceil(F.col("files") / per_page)).cast("int")
    return requests.select(*keys).distinct().join(counts, keys).select(*keys, F.explode(F.sequence(F.lit(1), n)).alias("page"))


def documents_of(files: DataFrame, chars: int) -> DataFrame:
    """A file as one text: its path, a line end, its beginning."""
    return files.withColumn("document", F.concat_ws("\n", "path", F.substring("text", 1, chars)))


def merged_between(changes: DataFrame, since: str, until: str, limit: int) -> DataFrame:
    """Changes merged in [since, until], oldest first, ``limit`` in all."""
    t = F.try_to_timestamp("merged_at")
    return changes.filter(t.between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))).orderBy("created_at", "number").limit(limit)
