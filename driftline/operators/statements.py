"""From patch statements to lines of target files: line, symbol and block scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.paths import basename, token_jaccard
from driftline.functions.seqratio import most_similar
from driftline.functions.text import meaningful, strip
from driftline.operators.ranking import top_k
from driftline.runtime import fan_out


def comparable(statements: DataFrame, files: DataFrame, limit: int = 120, key: str = "pair_index") -> DataFrame:
    """Per target file the source statements to compare with: those of the same path, else of the same name, else all of the key.

    Deleted ones come first; of all statements of the key those whose paths share
    most tokens with the file's or its source's path. ``place`` is the order.

    (key, path, source_path, source_line, source_kind, source_text, place)
    """
    prio = F.when(F.col("kind") == "deleted", 0).when(F.col("kind") == "context", 1).otherwise(2)
    first = F.col("ord") if "ord" in statements.columns else F.lit(0)
    s = statements.filter("text is not null").select(key, F.col("path").alias("source_path"), F.col("line_no").alias("source_line"), F.col("kind").alias("source_kind"), F.col("text").alias("source_text"), prio.alias("prio"), first.alias("first"))
    f = files.select(key, "path", F.coalesce("matched_source_path", "path").alias("matched")).distinct()
    name = basename(F.col("source_path"))
    tier = F.when(F.col("source_path") == F.col("matched"), 0).when((name == basename(F.col("matched"))) | (name == basename(F.col("path"))), 1).otherwise(2)
    w = Window.partitionBy(key, "path")
    best = s.join(f, key).withColumn("tier", tier).withColumn("least", F.min("tier").over(w)).filter("tier = least")
    near = F.greatest(token_jaccard(F.col("source_path"), F.col("matched")), token_jaccard(F.col("source_path"), F.col("path")))
    loose = F.col("tier") == 2
    order = [F.when(loose, -near).otherwise(0.0), F.col("prio"), F.when(loose, F.col("first")), F.col("source_line"), F.col("source_text"), F.col("source_path")]
    return top_k(best, [key, "path"], order, limit, "place").select(key, "path", "source_path", "source_line", "source_kind", "source_text", "place")


def best_statement(lines: DataFrame, sources: DataFrame, key: str = "pair_index") -> DataFrame:
    """Each target line with its most similar source statement, of equal ones the first in place.

    Every line of a file is held against every statement of the file: one that
    shares no token may win, too. Both travel as one row per file, so that their
    product is never shuffled.
    """
    a = lines.filter(meaningful(F.col("text"))).select(key, "path", "line", F.col("text").alias("line_text"))
    a = a.groupBy(key, "path").agg(F.collect_list(F.struct("line", "line_text")).alias("ls"))
    b = sources.groupBy(key, "path").agg(F.array_sort(F.collect_list(F.struct("place", "source_path", "source_line", "source_text"))).alias("ss"))
    found = fan_out(a.join(b, [key, "path"])).withColumn("b", most_similar(F.col("ls.line_text"), F.col("ss.source_text")))
    each = found.select(key, "path", "ss", F.explode(F.arrays_zip("ls", "b")).alias("x"))
    return each.select(key, "path", "x.ls.line", "x.ls.line_text", F.get("ss", F.col("x.b.at")).alias("s"), F.col("x.b.similarity").alias("similarity")).select(key, "path", "line", "line_text", "s.source_path", "s.source_line", "s.source_text", "similarity")


def rank_statements(lines: DataFrame, sources: DataFrame, files: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """.70 best statement similarity + .30 file score; order (-score, path, line)."""
    best = best_statement(lines, sources, key).join(files.select(key, "path", F.col("score").alias("file_score")), [key, "path"])
    score = F.round(0.70 * F.col("similarity") + 0.30 * F.col("file_score"), 6)
    return top_k(best.withColumn("score", score).withColumn("similarity", F.round("similarity", 6)), [key], [F.col("score").desc(), F.col("path"), F.col("line")], k)


def enclosing(lines: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Lines joined to the ranges (start_line, end_line) that hold them, within equal keys."""
    return lines.join(ranges, keys).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))


def block_lines(blocks: DataFrame, lines: DataFrame, seeds: DataFrame, per_block: int, key: str = "pair_index") -> DataFrame:
    """Lines of blocks, scored .34 block + .28 similarity + .20 proximity + .10 support + .08 kind + .04 / (rank + 1); ``per_block`` best each.

    ``blocks``: key, path, block, start, end, block_score, rank; ``seeds`` has per block its seed lines (seed_lines), source texts (source_texts)
    and number of supporting modules (modules).
    """
    from driftline.functions.text import line_kind_score, proximity_score

    own = [key, "path", "block", "start"]
    held = blocks.select(*own, "end").join(lines.filter(meaningful(strip(F.col("text")))), [key, "path"]).filter(F.col("line").between(F.col("start"), F.col("end")))
    held = held.groupBy(*own).agg(F.collect_list(F.struct("line", F.col("text").alias("line_text"))).alias("ls"))
    texts, seen = F.coalesce("source_texts", F.array().cast("array<string>")), F.coalesce("seed_lines", F.array().cast("array<int>"))
    given = blocks.select(*own, "block_score", "rank").join(held, own).join(seeds, own, "left").withColumn("source_texts", texts).withColumn("seed_lines", seen)
    each = fan_out(given).withColumn("b", most_similar(F.col("ls.line_text"), F.col("source_texts"))).withColumn("x", F.explode(F.arrays_zip("ls", "b")))
    line, text = F.col("x.ls.line"), F.col("x.ls.line_text")
    score = (
        0.34 * F.col("block_score") + 0.28 * F.coalesce("x.b.similarity", F.lit(0.0)) + 0.20 * proximity_score(line, F.col("seed_lines"))
        + 0.10 * F.least(F.coalesce("modules", F.lit(0)) / 3, F.lit(1.0)) + 0.08 * line_kind_score(text, F.col("source_texts")) + 0.04 / (F.col("rank") + 1)
    )
    scored = each.select(key, "path", "block", "start", line.alias("line"), F.round(score, 6).alias("score"))
    return top_k(scored, own, [F.col("score").desc(), F.col("line")], per_block)


def insert_anchors(blocks: DataFrame, key: str = "pair_index") -> DataFrame:
    """Lines where new code may go: a block's start and end and the lines inside them; .52 block + .18."""
    spots = F.array_distinct(F.array(F.col("start"), F.col("end"), F.col("start") + 1, F.col("end") - 1))
    return blocks.select(key, "path", "block", F.explode(spots).alias("line"), F.round(0.52 * F.col("block_score") + 0.18, 6).alias("score")).filter("line >= 1")
