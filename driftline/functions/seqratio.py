"""Sequence similarity of two texts, for which no built-in exists.

The ratio is that of Python's ``difflib.SequenceMatcher``: not symmetric, and
frequent characters of a second text of 200 or more are left out. It runs in
an Arrow function over whole batches; callers pass distinct pairs that cheaper
set conditions have let through.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.paths import basename, extension, path_tokens
from driftline.functions.text import TOKEN_ALL, jaccard, strip, tokens


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib ratio of two texts; null if either is null."""
    matcher, last, out = SequenceMatcher(), None, []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:  # the second text's index is kept while it repeats
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def path_score(source: Column, target: Column) -> Column:
    """1 for equal paths, else .42 path + .30 name + .18 tokens + .10 same extension."""
    ext = extension(source)
    bonus = ((ext != "") & (ext == extension(target))).cast("double")
    parts = 0.42 * ratio(F.lower(source), F.lower(target)) + 0.30 * ratio(F.lower(basename(source)), F.lower(basename(target)))
    return F.when(source == target, 1.0).otherwise(parts + 0.18 * jaccard(path_tokens(source), path_tokens(target), 1.0) + 0.10 * bonus)


def token_similarity(a: Column, b: Column) -> Column:
    """.55 ratio of the stripped texts + .45 Jaccard of their tokens."""
    return 0.55 * ratio(strip(a), strip(b)) + 0.45 * jaccard(tokens(a, TOKEN_ALL), tokens(b, TOKEN_ALL), 1.0)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("similarity", T.DoubleType())])))
def most_similar(lines: pd.Series, others: pd.Series) -> pd.Series:
    """For each of ``lines`` the place (from 0) of the most :func:`token_similarity` text of ``others`` and that similarity.

    The first of equally similar ones counts; null without others. Texts whose upper bound is below the best
    one found are not compared by sequence, which changes no result.
    """
    bags: dict[str, frozenset[str]] = {}

    def bag(x: str) -> frozenset[str]:
        if x not in bags:
            bags[x] = frozenset(re.findall(TOKEN_ALL, x.lower()))
        return bags[x]

    matcher, out = SequenceMatcher(), []
    for ls, os in zip(lines, others, strict=True):
        sources = [(i, o.strip(), bag(o)) for i, o in enumerate(os)]
        found = []
        for line in ls:
            y, b = line.strip(), bag(line)
            matcher.set_seq2(y)
            bounded = []
            for i, x, a in sources:
                union = len(a | b)
                j = 0.45 * (len(a & b) / union if union else 1.0)
                size = len(x) + len(y)
                bounded.append((0.55 * (2.0 * min(len(x), len(y)) / size if size else 1.0) + j, -i, j, x))
            bounded.sort(reverse=True)
            best = (-1.0, 0)
            for bound, i, j, x in bounded:
                if bound < best[0]:
                    break
                matcher.set_seq1(x)
                if 0.55 * matcher.quick_ratio() + j >= best[0]:
                    best = max(best, (0.55 * matcher.ratio() + j, i))
            found.append({"at": -best[1], "similarity": best[0]} if bounded else None)
        out.append(found)
    return pd.Series(out, dtype="object")


def edit_similarity(a: Column, b: Column) -> Column:
    """.55 ratio of the lower-cased texts + .45 :func:`token_similarity`."""
    return 0.55 * ratio(F.lower(a), F.lower(b)) + 0.45 * token_similarity(a, b)


def name_similarity(a: Column, b: Column) -> Column:
    from driftline.functions.text import split_identifier

    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(
        F.greatest(token_similarity(a, b), jaccard(F.array_distinct(split_identifier(a)), F.array_distinct(split_identifier(b))))
    )


def mapping_score(source: Column, target: Column, source_patch: Column, target_patch: Column) -> Column:
    """.42 path + .36 normalised patches + .16 same name + .06 path tokens."""
    from driftline.functions.text import normalize_code

    return (
        0.42 * path_score(source, target) + 0.36 * token_similarity(normalize_code(source_patch), normalize_code(target_patch))
        + 0.16 * (basename(source) == basename(target)).cast("double") + 0.06 * jaccard(path_tokens(source), path_tokens(target), 1.0)
    )
