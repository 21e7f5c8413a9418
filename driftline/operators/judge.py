"""The judging stage: prompts, a judge protocol, a deterministic judge, merging of replies, and the search trace.

A judge ranks supplied candidates by id and can name nothing else. Whatever
it leaves out keeps its order behind its picks, so a silent judge changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import clip, json_object, valid_ids
from driftline.operators.ranking import merge_ranks

#: prompt -> reply text (JSON with "order": list of candidate numbers); an exception or None leaves the order as it is.
Judge = Callable[[str], "str | None"]


def overlap_judge(prompt: str) -> str:
    """Orders candidates by the words they share with the task, first ones first among equals. Needs no service."""
    import json
    import re

    task, _, rest = prompt.partition("\n\n")
    words = set(re.findall(r"[a-z0-9]+", task.lower()))
    scores = []
    for line in rest.splitlines():
        number, _, text = line.partition("\t")
        scores.append((-len(words & set(re.findall(r"[a-z0-9]+", text.lower()))), int(number)))
    return json.dumps({"order": [str(n) for _, n in sorted(scores)]})


def prompts(tasks: DataFrame, candidates: DataFrame, keys: Sequence[str], task: str, item: str, rank: str, limit: int = 120) -> DataFrame:
    """(keys, prompt, n): the task, then numbered candidates in rank order, ``limit`` at most."""
    rows = candidates.filter(F.col(rank) <= limit).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i")))).alias("c"))
    listed = F.array_join(F.transform("c", lambda x, i: F.concat(i.cast("string"), F.lit("\t"), x["i"])), "\n")
    return tasks.join(rows, list(keys)).select(*keys, F.concat(clip(F.col(task), 1000), F.lit("\n\n"), listed).alias("prompt"), F.size("c").alias("n"))


def ask(requests: DataFrame, judge: Judge, tries: int = 3) -> DataFrame:
    """``requests`` with ``reply``: one call per row within a task; failures give null."""
    from pyspark.sql import types as T

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = []
            for p in f["prompt"]:
                reply = None
                for _ in range(tries):
                    try:
                        reply = judge(p)
                        break
                    except Exception:  # noqa: BLE001 - the order then stays as it is
                        continue
                replies.append(reply)
            yield f.assign(reply=replies)

    return requests.mapInPandas(run, T.StructType([*requests.schema.fields, T.StructField("reply", T.StringType())]))


def reorder(candidates: DataFrame, replies: DataFrame, keys: Sequence[str], item: str, rank: str, top: int) -> DataFrame:
    """Candidates in the judge's order, unlisted ones behind in their own, ``top`` in all; unknown ids are ignored."""
    order = replies.select(*keys, F.posexplode(valid_ids(json_object(F.col("reply"), "order array<string>")["order"], F.col("n"))).alias("place", "number"))
    picked = order.join(candidates.withColumn("number", F.col(rank) - 1), [*keys, "number"]).select(*keys, item, (F.col("place") + 1).alias(rank))
    return merge_ranks([picked, candidates.select(*keys, item, rank)], keys, [item], rank, top)


def blended(old: Column, judged: Column) -> Column:
    """.45 old + .55 judged score; the old one where the judge gave none."""
    return F.when(judged.isNull(), old).otherwise(0.45 * old + 0.55 * judged)


def uct(value: Column, visits: Column, parent_visits: Column, weight: float = 1.2) -> Column:
    """v / n + 1.2 sqrt(ln(N + 1) / n); infinite for an unvisited node."""
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(value / visits + weight * F.sqrt(F.log(parent_visits + 1) / visits))


# The stages of a search, in their order, and the value of reaching each.
STAGES = [("InspectSourcePatch", 55.0, 25.0), ("FindSimilarFiles", 35.0, 45.0), ("MapPatchToTarget", 45.0, 50.0), ("ViewCode", 80.0, 20.0), ("Finish", 90.0, 30.0)]


def search_trace(pairs: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, node, parent, action, value, visits, total): the staged search of each pair as a chain of nodes.

    ``pairs`` has key, statements, file_score, line_score, hits. Values go up to the
    root: a node's total is the sum over itself and what lies below.
    """
    s = pairs
    value = [
        F.when(s.statements > 0, 55.0).otherwise(25.0), 35.0 + 45.0 * F.coalesce(s.file_score, F.lit(0.0)),
        F.when(s.line_score.isNotNull(), 45.0 + 50.0 * s.line_score).otherwise(20.0), F.when(s.hits > 0, 80.0).otherwise(20.0), F.when(s.hits > 0, 90.0).otherwise(30.0),
    ]
    steps = F.array(*[F.struct(F.lit(i + 1).alias("node"), F.lit(i).alias("parent"), F.lit(name).alias("action"), v.alias("value")) for i, ((name, _, _), v) in enumerate(zip(STAGES, value, strict=True))])
    rows = pairs.select(key, F.explode(steps).alias("s")).select(key, "s.*")
    from pyspark.sql import Window

    below = Window.partitionBy(key).orderBy("node").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("visits", F.count(F.lit(1)).over(below)).withColumn("total", F.round(F.sum("value").over(below), 6))


LEAKS = {"target_changed_paths", "target_files", "target_ranges", "gt", "truth"}


def assert_no_truth(df: DataFrame, names: set[str] | None = None) -> DataFrame:
    """Fails if a table given to retrieval holds columns of the truth."""
    found = (names or LEAKS) & {c.lower() for c in df.columns}
    if found:
        raise ValueError(f"columns of the truth reach retrieval: {sorted(found)}")
    return df
