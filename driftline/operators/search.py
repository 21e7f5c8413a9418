"""The staged search of a pair as a tree: what is planned in which round, what it is worth, where it is hung.

The plan of a round rests on what earlier rounds found, never on the tree; so
all actions of a pair and their values are columns, and only the choice of the
node they are hung under, by upper confidence bounds, is sequential per pair.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Actions of a round for files and for lines, lines viewed, exploration weight.
FILES_A_ROUND, VIEWS_A_ROUND, VIEWED, EXPLORATION = 3, 2, 3, 1.2


def planned(pairs: DataFrame, files: DataFrame, lines: DataFrame, rounds: int, key: str = "pair_index") -> DataFrame:
    """(key, round, place, action, path, line, value) of every action up to ``rounds`` rounds.

    ``pairs``: key, statements (how many the source patch has); ``files``: key, path, score, rank; ``lines``: key, path, line, score, rank, text.
    """
    n_files = files.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.max("score").alias("best"))
    seen = lines.filter(F.col("rank") <= VIEWED)
    n_lines = seen.groupBy(key).agg(F.count(F.lit(1)).alias("views"))
    p = pairs.join(n_files, key, "left").join(n_lines, key, "left").na.fill(0, ["files", "views"])
    none = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")]
    row = lambda rnd, place, action, value: F.struct(F.lit(rnd).cast("int").alias("round"), F.lit(place).cast("int").alias("place"), F.lit(action).alias("action"), *none, value.alias("value"))
    mapped_rounds = F.ceil(F.col("files") / FILES_A_ROUND)
    end = 2 + mapped_rounds + F.ceil(F.col("views") / VIEWS_A_ROUND)
    looked = F.when(F.col("files") > 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(max(1, rounds - 1))))  # without any file the question is put again
    head = p.select(key, F.explode(F.concat(
        F.array(row(0, 0, "InspectSourcePatch", F.when(F.col("statements") > 0, 55.0).otherwise(25.0))),
        F.transform(looked, lambda r: row(r, 0, "FindSimilarFiles", 35.0 + 45.0 * F.coalesce("best", F.lit(0.0)))),
        F.when(F.col("files") > 0, F.array(row(end, 0, "Finish", F.when(F.col("views") > 0, 90.0).otherwise(30.0)))).otherwise(F.array()),
    )).alias("a")).select(key, "a.*")
    best = lines.groupBy(key, "path").agg(F.max("score").alias("s"))
    at = F.col("rank") - 1
    maps = files.join(best, [key, "path"], "left").select(
        key, (2 + F.floor(at / FILES_A_ROUND)).cast("int").alias("round"), (at % FILES_A_ROUND).cast("int").alias("place"), F.lit("MapPatchToTarget").alias("action"), "path", F.lit(None).cast("int").alias("line"),
        F.when(F.col("s").isNull(), 20.0).otherwise(45.0 + 50.0 * F.col("s")).alias("value"),
    )
    views = seen.join(p.select(key, (2 + mapped_rounds).alias("from")), key).select(
        key, (F.col("from") + F.floor(at / VIEWS_A_ROUND)).cast("int").alias("round"), (at % VIEWS_A_ROUND).cast("int").alias("place"), F.lit("ViewCode").alias("action"), "path", F.col("line").cast("int").alias("line"),
        F.when(F.length("text") > 0, 80.0).otherwise(20.0).alias("value"),
    )
    return head.unionByName(maps).unionByName(views).filter(F.col("round") < rounds)


_NODE = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("visits", T.IntegerType()), T.StructField("total", T.DoubleType())])


@F.pandas_udf(T.ArrayType(_NODE))
def _hung(actions: pd.Series) -> pd.Series:
    """Of (round, place, value) in order: the node of each action (from 1; 0 is the root), its parent, visits and sum of values."""
    out = []
    for rows in actions:
        parent, visits, total, below = [-1], [0], [0.0], [[]]
        leaf, current = 0, None
        for r in rows:
            if r["round"] != current:
                current, leaf = r["round"], 0
                while below[leaf]:
                    up = math.log(visits[leaf] + 1)
                    leaf = max(below[leaf], key=lambda c: total[c] / visits[c] + EXPLORATION * math.sqrt(up / visits[c]))
            node = len(parent)
            parent.append(leaf), visits.append(0), total.append(0.0), below.append([])
            below[leaf].append(node)
            at = node
            while at >= 0:
                visits[at] += 1
                total[at] += r["value"]
                at = parent[at]
        out.append([{"node": i, "parent": parent[i], "visits": visits[i], "total": total[i]} for i in range(1, len(parent))])
    return pd.Series(out, dtype="object")


def search_tree(actions: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, node, parent, action, path, line, value, visits, total): every round hung under the leaf of the highest bound."""
    rows = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("round", "place", "action", "path", "line", "value"))).alias("a"))
    hung = rows.withColumn("n", _hung(F.transform("a", lambda x: F.struct(x["round"].alias("round"), x["place"].alias("place"), x["value"].alias("value")))))
    each = hung.select(key, F.explode(F.arrays_zip("a", "n")).alias("x"))
    return each.select(key, "x.n.node", "x.n.parent", "x.a.action", "x.a.path", "x.a.line", "x.a.value", "x.n.visits", F.round("x.n.total", 6).alias("total"))


def needs_judge(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``needed``: more than eight source files, the first three confidences equal, no statement, or no candidate of a source's path.

    ``pairs`` has source_files, confidences (ARRAY, in order), statements, exact (counts).
    """
    top = F.transform(F.slice("confidences", 1, 3), lambda c: F.round(c, 3))
    tied = (F.size("confidences") >= 3) & (F.size(F.array_distinct(top)) == 1)
    return pairs.withColumn("needed", (F.col("source_files") > 8) | tied | (F.col("statements") == 0) | (F.col("exact") == 0))


def hardness(source_files: DataFrame, target_files: DataFrame, source_shapes: DataFrame, target_shapes: DataFrame, hits: DataFrame, key: str = "pair_index") -> DataFrame:
    """Per pair: sizes, overlaps of paths, names and statements, and what was hit although they differ.

    Files: key, path; shapes: key, shape; ``hits``: key, file_hit, statement_hit. Pairs are those of ``hits``.
    """
    def overlap(a: DataFrame, b: DataFrame, column: str, out: str) -> DataFrame:
        return a.select(key, column).distinct().join(b.select(key, column).distinct(), [key, column], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias(out))

    named = lambda d: d.select(key, F.element_at(F.split("path", "/"), -1).alias("name"))
    size = lambda d, out: d.select(key, "path").distinct().groupBy(key).agg(F.count(F.lit(1)).alias(out))
    j = hits
    parts = [
        size(source_files, "source_file_count"), size(target_files, "target_file_count"), overlap(source_files, target_files, "path", "path_overlap_count"),
        overlap(named(source_files), named(target_files), "name", "basename_overlap_count"), overlap(source_shapes, target_shapes, "shape", "statement_text_overlap_count"),
    ]
    for part in parts:
        j = j.join(part, key, "left")
    counts = ["source_file_count", "target_file_count", "path_overlap_count", "basename_overlap_count", "statement_text_overlap_count"]
    j = j.na.fill(0, counts)
    other_path, other_text = F.col("path_overlap_count") == 0, F.col("statement_text_overlap_count") == 0
    return j.select(
        key, "file_hit", "statement_hit", *counts, other_path.alias("path_not_exact"), (F.col("basename_overlap_count") == 0).alias("basename_not_exact"), other_text.alias("statement_text_not_exact"),
        (F.col("source_file_count") > 10).alias("many_source_files"), (F.col("target_file_count") > 10).alias("many_target_files"),
        (F.col("file_hit") & other_path).alias("file_worked_despite_path_change"), (F.col("statement_hit") & other_text).alias("statement_worked_despite_text_change"),
    )


def hard_cases(hard: DataFrame) -> DataFrame:
    """The pairs that are no plain copy, or that were missed."""
    return hard.filter("path_not_exact or basename_not_exact or statement_text_not_exact or not file_hit or not statement_hit")
