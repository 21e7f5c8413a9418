"""Unified diffs: statements with line numbers, hunks, changed ranges, edited/deleted/added pairs.

Lines are numbered by running sums over each patch. Deleted and added lines of
a hunk are paired by their similarity, scored for all pairs that can reach the
threshold; only the choice among scored pairs is sequential.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.seqratio import edit_similarity
from driftline.functions.text import TOKEN_WORD, meaningful, strip, text_lines

# Fixed value: where a hunk header names the old and the new line.
_NUMBERS = r"-(\d+)(?:,\d+)? \+(\d+)(?:,\d+)?"
#: Similarity from which a deleted and an added line count as one edited line.
EDITED = 0.34


def _numbered(patches: DataFrame, keys: list[str], patch: str) -> DataFrame:
    """:func:`hunk_lines` with ``f``, which names the patch (its keys may be null)."""
    p = F.coalesce(F.col(patch), F.lit(""))
    given = patches.select(*keys, F.sha2(F.concat_ws("\x01", F.to_json(F.struct(*keys)), p), 256).alias("__f"), p.alias("p")).distinct()
    lines = given.select(*keys, "__f", F.posexplode(text_lines(F.col("p"))).alias("at", "line"))
    line = F.col("line")
    # A header of a file is no line of it, wherever it stands.
    role = F.when(line.startswith("@@"), "head").when(line.startswith("+++") | line.startswith("---"), "file").when(line.startswith("+"), "added").when(line.startswith("-"), "deleted").otherwise("context")
    begun = lambda i: F.when((role == "head") & line.rlike(_NUMBERS), F.regexp_extract(line, _NUMBERS, i).try_cast("int"))
    so_far = Window.partitionBy("__f").orderBy("at")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    passed = lambda *roles: F.coalesce(F.count_if(F.col("role").isin(*roles)).over(before), F.lit(0))
    lines = lines.select(*keys, "__f", "at", "line", role.alias("role"), begun(1).alias("old0"), begun(2).alias("new0")).select(
        "*", F.count_if(F.col("role") == "head").over(so_far).alias("hunk"), passed("deleted", "context").alias("olds"), passed("added", "context").alias("news")
    )
    # The number of a line is that of its hunk's header and the lines of its side passed since.
    since = lambda first, n: F.coalesce(F.last(F.when(F.col(first).isNotNull(), F.col(first) - F.col(n)), True).over(so_far), F.lit(0)) + F.col(n)
    marked = (F.col("role") != "context") | line.startswith(" ")
    return lines.select(
        *keys, "__f", F.col("hunk").cast("int").alias("hunk"), (F.count_if(F.col("role").isin("added", "deleted", "context")).over(so_far) - 1).cast("int").alias("pos"), F.col("role").alias("kind"),
        since("old0", "olds").cast("int").alias("old"), since("new0", "news").cast("int").alias("new"), strip(F.when(marked, F.substr(line, F.lit(2))).otherwise(line)).alias("text"),
    ).filter("kind not in ('head', 'file')")


def hunk_lines(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, hunk, pos, kind, old, new, text) of every line of every patch.

    Null and empty patches have none; rows equal in keys and patch count once;
    lines before the first header belong to hunk 0.
    """
    return _numbered(patches, keys, patch).drop("__f")


def patch_statements(patches: DataFrame, keys: list[str], patch: str = "patch", context: bool = True) -> DataFrame:
    """(keys, line_no, kind, text, ord) of statements: deleted and context lines carry the old number, added ones the new."""
    lines = hunk_lines(patches, keys, patch).filter(meaningful(F.col("text")))
    if not context:
        lines = lines.filter("kind <> 'context'")
    return lines.select(*keys, F.when(F.col("kind") == "added", F.col("new")).otherwise(F.col("old")).alias("line_no"), "kind", "text", F.col("pos").alias("ord"))


def changed_ranges(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, hunk, start, end): one closed range of old lines per hunk, from its first to its last change."""
    lines = _numbered(patches, keys, patch).filter("kind <> 'context'")
    first = F.when(F.col("kind") == "added", F.greatest(F.col("old") - 1, F.lit(1))).otherwise(F.col("old"))
    per = lines.groupBy(*keys, "__f", "hunk").agg(
        F.min_by(first, "pos").alias("start"), F.max_by("kind", "pos").alias("__k"), F.max_by("old", "pos").alias("__o")
    )
    return per.select(*keys, "hunk", "start", F.when(F.col("__k") == "added", F.greatest("__o", "start")).otherwise(F.col("__o")).alias("end"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("d", T.IntegerType()), T.StructField("a", T.IntegerType())])))
def _first_come(scored: pd.Series) -> pd.Series:
    """Of (d, -score, a) in ascending order: each d with its best a that no earlier d has."""
    out = []
    for candidates in scored:
        partner, taken = {}, set()
        for c in candidates:
            if c["d"] not in partner and c["a"] not in taken:
                partner[c["d"]] = c["a"]
                taken.add(c["a"])
        out.append([{"d": d, "a": a} for d, a in partner.items()])
    return pd.Series(out, dtype="object")


def statement_ground_truth(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, hunk, kind, old_start, old_end, new_start, new_end, old_text, new_text, anchor_line): what each hunk changes.

    In their order, deleted lines take the most similar added line of the hunk
    that is still free, from ``EDITED`` on (the first of equals): 'edited'. The
    others are 'deleted' and 'added_new'; those are anchored at the old line before them.
    """
    lines = _numbered(patches, keys, patch).filter((F.col("hunk") > 0) & (F.col("kind") != "context") & meaningful(F.col("text"), 2, TOKEN_WORD))
    side = lambda kind, x: lines.filter(F.col("kind") == kind).select("__f", "hunk", F.col("pos").alias(x), F.col("text").alias(f"{x}_text"))
    d, a = F.length("__d_text"), F.length("__a_text")
    # Both ratios are at most that of the lengths, the share of common tokens at most 1.
    reachable = (0.55 + 0.45 * 0.55) * 2 * F.least(d, a) / (d + a) + 0.45 * 0.45 >= EDITED - 1e-9
    scored = side("deleted", "__d").join(side("added", "__a"), ["__f", "hunk"]).filter(reachable).withColumn("__score", edit_similarity(F.col("__d_text"), F.col("__a_text"))).filter(F.col("__score") >= EDITED)
    chosen = scored.groupBy("__f", "hunk").agg(F.array_sort(F.collect_list(F.struct(F.col("__d").alias("d"), (-F.col("__score")).alias("s"), F.col("__a").alias("a")))).alias("__c")).select("__f", "hunk", F.inline(_first_come("__c")).alias("__d", "__a"))
    old = lines.filter("kind = 'deleted'").withColumnRenamed("pos", "__d").join(chosen, ["__f", "hunk", "__d"], "left").select(*keys, "__f", "hunk", F.col("old").alias("__o"), F.col("text").alias("__old"), "__a")
    new = lines.filter("kind = 'added'").select(*[F.col(k).alias(f"__n_{k}") for k in keys], "__f", "hunk", F.col("pos").alias("__a"), F.greatest(F.col("old") - 1, F.lit(1)).alias("__anchor"), F.col("new").alias("__new_line"), F.col("text").alias("__new"))
    both = old.join(new, ["__f", "hunk", "__a"], "full")
    at = F.coalesce("__o", "__anchor")
    return both.select(
        *[F.when(F.col("__o").isNull(), F.col(f"__n_{k}")).otherwise(F.col(k)).alias(k) for k in keys], "hunk", F.when(F.col("__o").isNull(), "added_new").when(F.col("__new_line").isNull(), "deleted").otherwise("edited").alias("kind"),
        at.alias("old_start"), at.alias("old_end"), F.col("__new_line").alias("new_start"), F.col("__new_line").alias("new_end"), F.coalesce("__old", F.lit("")).alias("old_text"), F.coalesce("__new", F.lit("")).alias("new_text"), at.alias("anchor_line"),
    )
