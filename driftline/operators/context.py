"""Prompt contexts, code vectors and settings around the scoring operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import clip
from driftline.functions.vectors import encode_contexts
from driftline.operators.ranking import top_k


def load_settings(path: str, known: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines of a file below ``known`` values, which win; comments and blank lines are skipped."""
    out: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
    return out | known


def side_context(sides: DataFrame, files: int = 25) -> DataFrame:
    """What a judge may know of a side: clipped title, body and message, and its first file names."""
    return sides.select("pair_index", "role", "repo", "kind", "number", clip(F.col("title"), 320).alias("title"), clip(F.col("body"), 1000).alias("body"), clip(F.col("message"), 650).alias("message"), F.slice("file_names", 1, files).alias("file_names"))


def patch_context(statements: DataFrame, n: int = 24, chars: int = 160) -> DataFrame:
    """The first statements of each pair's patch, one text per pair."""
    head = top_k(statements, ["pair_index"], [F.col("path"), F.col("ord"), F.col("line_no")], n)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "path", F.col("line_no").cast("string"), "kind", F.substring("text", 1, chars)).alias("t"))))
    return head.groupBy("pair_index").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("patch"))


def intent_context(intents: DataFrame, n: int = 16, texts: int = 5) -> DataFrame:
    """The first deletion intents of a pair with their first texts."""
    d = top_k(intents.filter("intent = 'delete'"), ["pair_index"], [F.col("path"), F.col("symbol")], n)
    return d.select("pair_index", "rank", "path", "symbol", F.slice("texts", 1, texts).alias("texts"))


def with_module(files: DataFrame, module: str, motivation: Column, n: int) -> DataFrame:
    """A module's first ``n`` files with its name and why they are proposed."""
    return files.filter(F.col("rank") <= n).withColumn("module", F.lit(module)).withColumn("motivation", motivation)


def cache_key(repo: Column, sha: Column, model: str, chars: int, paths: Column) -> Column:
    """What an embedding depends on, as one hash."""
    return F.sha2(F.to_json(F.struct(repo.alias("repo"), sha.alias("sha"), F.lit(model).alias("model"), F.lit(chars).alias("chars"), F.array_sort(paths).alias("paths"))), 256)


def embed(documents: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], out: str = "vector", batch: int = 64) -> DataFrame:
    """``documents`` with unit vectors of ``text``; ``encode`` is called with lists of texts within tasks (null as '')."""
    schema = T.StructType([*documents.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[list[float]] = []
            for i in range(0, len(f), batch):
                v = np.asarray(encode(["" if t is None else t for t in f[text].iloc[i : i + batch]]), dtype=float)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                rows += (v / np.where(size == 0, 1, size)).astype(np.float32).tolist()
            yield f.assign(**{out: rows})

    return documents.mapInPandas(run, schema)


def function_vectors(contexts: DataFrame, keys: Sequence[str], token_vectors: np.ndarray, path_vectors: np.ndarray, weights: np.ndarray, attention: np.ndarray) -> DataFrame:
    """(keys, vector) of functions given as ids of (start, path, end) contexts; ids beyond a table are unknown (1), 0 pads.

    The tables are a model's parameters, of fixed size.
    """
    schema = T.StructType([*[f for f in contexts.schema.fields if f.name in keys], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def look(table: np.ndarray, ids: Sequence[int]) -> np.ndarray:
        i = np.asarray(ids, dtype=int)
        return table[np.where(i < len(table), i, 1)]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vs = [encode_contexts(look(token_vectors, s), look(path_vectors, p), look(token_vectors, e), (np.asarray(p) > 0).astype(int), weights, attention).astype(np.float32).tolist() for s, p, e in zip(f["starts"], f["paths"], f["ends"], strict=True)]
            yield f[list(keys)].assign(vector=vs)

    return contexts.mapInPandas(run, schema)


def nesting_contexts(source: str, leaves: int = 60, contexts: int = 100, length: int = 8, width: int = 30) -> list[tuple[str, str, str]]:
    """(start token, path, end token) between tokens of a source text, its brackets taken as the tree.

    The path climbs from the first token to the bracket both lie in and
    descends to the second; longer paths and wider gaps are left out.
    """
    import re

    kinds = {"{": "block", "(": "group", "[": "index"}
    stack: list[tuple[str, int]] = [("root", 0)]
    seen: list[tuple[str, tuple[tuple[str, int], ...]]] = []
    for n, m in enumerate(re.finditer(r"//[^\n]*|\"(?:\\.|[^\"\\])*\"|`[^`]*`|[A-Za-z_]\w*|\d+|[{}()\[\]]", source)):
        t = m[0]
        if t in kinds:
            stack.append((kinds[t], n))
        elif t in "})]":
            if len(stack) > 1:
                stack.pop()
        elif not t.startswith("//"):
            seen.append(("<string>" if t[0] in "\"`" else "<number>" if t[0].isdigit() else t.lower()[:80], tuple(stack)))
    if len(seen) > leaves:
        seen = [seen[i * len(seen) // leaves] for i in range(leaves)]
    out: list[tuple[str, str, str]] = []
    for i, (a, pa) in enumerate(seen):
        for b, pb in seen[i + 1 : i + 1 + width]:
            common = 0
            while common < min(len(pa), len(pb)) and pa[common] == pb[common]:
                common += 1
            up, down = [k for k, _ in pa[common:]][::-1], [k for k, _ in pb[common:]]
            if len(up) + len(down) + 1 <= length:
                out.append((a, "^".join([*up, pa[common - 1][0]]) + "".join("_" + k for k in down), b))
    return out if len(out) <= contexts else [out[i * len(out) // contexts] for i in range(contexts)]


def graph_package(nodes: DataFrame, edges: DataFrame, files: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, package): a pair's graph with running integer ids and its ranked files as JSON."""
    from pyspark.sql import Window

    n = nodes.withColumn("nid", F.row_number().over(Window.partitionBy(key).orderBy("id")))
    ids = n.select(key, "id", "nid")
    e = edges.join(ids.select(key, F.col("id").alias("source"), F.col("nid").alias("s")), [key, "source"]).join(ids.select(key, F.col("id").alias("target"), F.col("nid").alias("t")), [key, "target"])
    ns = n.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nid", "id", "kind"))).alias("nodes"))
    es = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "t", "kind"))).alias("edges"))
    fs = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))).alias("files"))
    return ns.join(es, key, "left").join(fs, key, "left").select(key, F.to_json(F.struct("nodes", "edges", "files")).alias("package"))


def read_json_lines(text: str) -> list[dict]:
    return [json.loads(x) for x in text.splitlines() if x.strip()]
