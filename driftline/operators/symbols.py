"""Declarations of Go-like source, source intents and the structure graph of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.paths import extension, node_id
from driftline.functions.text import TOKEN_WORD, meaningful, strip, text_lines

# What begins a declaration.
DECLARATION = r"(?U)^\s*(func|type|var|const)\s+(?:(\([^)]*\))\s*)?([A-Za-z_][A-Za-z0-9_]*)"
#: How far a declaration's closing brace is looked for, and what is taken without one.
LOOK_AHEAD, DEFAULT_EXTENT = 400, 80


def _count(line: Column, sign: str) -> Column:
    return F.length(line) - F.length(F.translate(line, sign, ""))


def _first(lines: Column, condition) -> Column:
    """The number of the first line that meets a condition, or null."""
    return F.get(F.filter(lines, condition), 0)["n"]


def parse_symbols(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, name, receiver, start_line, end_line, signature) of each file's declarations.

    Brace depths are running sums over the file's lines. A declaration ends at
    its first line, from its first opening brace on, at which the depth is back to what it
    was before; at the line before an empty one if that comes before any opening
    brace; else ``DEFAULT_EXTENT`` lines on. Null and empty texts declare
    nothing; repeated rows count once.
    """
    own = [*keys, "__file"]
    line, code = F.col("line"), F.regexp_replace("line", "//.*", "")
    lines = files.filter(F.length(text) > 0).select(*keys, F.md5(F.encode(F.col(text), "UTF-8")).alias("__file"), F.col(text).alias("__text")).distinct()
    lines = lines.select(*own, F.posexplode(text_lines(F.col("__text"))).alias("at", "line")).select(
        *own, "line", (F.col("at") + 1).alias("n"), _count(code, "{").alias("opened"), _count(code, "}").alias("closed"), (strip(line) == "").alias("blank")
    )
    lines = lines.withColumn("depth", F.sum(F.col("opened") - F.col("closed")).over(Window.partitionBy(*own).orderBy("n")))
    declared = F.struct(
        F.regexp_extract(line, DECLARATION, 1).alias("word"), F.nullif(F.regexp_extract(line, DECLARATION, 2), F.lit("")).alias("receiver"), F.regexp_extract(line, DECLARATION, 3).alias("name"),
        F.col("n").alias("start"), (F.col("depth") - F.col("opened") + F.col("closed")).alias("before"), F.substring(strip(line), 1, 300).alias("signature"),
    )
    whole = lines.groupBy(*own).agg(
        F.array_sort(F.collect_list(F.struct("n", "depth", "opened", "blank"))).alias("lines"), F.collect_list(F.when(line.rlike(DECLARATION), declared)).alias("found")
    )
    each = whole.select(*keys, F.size("lines").alias("total"), "lines", F.explode("found").alias("d")).select(*keys, "total", "d", F.slice("lines", F.col("d.start"), LOOK_AHEAD + 1).alias("near"))
    each = each.withColumn("opens", _first(F.col("near"), lambda x: x["opened"] > 0))
    gap = _first(F.col("near"), lambda x: x["blank"] & (x["n"] > F.col("d.start")) & (F.col("opens").isNull() | (x["n"] < F.col("opens"))))
    shut = _first(F.col("near"), lambda x: (x["n"] >= F.col("opens")) & (x["depth"] <= F.col("d.before")))
    return each.select(
        *keys, F.when((F.col("d.word") == "func") & F.col("d.receiver").isNotNull(), "method").otherwise(F.col("d.word")).alias("kind"), "d.name", "d.receiver", F.col("d.start").alias("start_line"),
        F.coalesce(gap - 1, shut, F.least("total", F.col("d.start") + DEFAULT_EXTENT)).alias("end_line"), "d.signature",
    )


def fallback_symbols(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines that begin a declaration, with a fixed extent."""
    lines = files.select(*keys, text_lines(F.col(text)).alias("ls")).select(*keys, F.posexplode("ls").alias("pos", "line"), F.size("ls").alias("n"))
    s = strip(F.col("line"))
    found = lines.filter(s.rlike(r"^(?:func|type|var|const)\b"))
    kind = F.regexp_extract(s, r"^(func|type|var|const)", 1)
    return found.select(
        *keys, kind.alias("kind"), F.regexp_extract(s, r"^(?:func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name"),
        (F.col("pos") + 1).alias("start_line"), F.least(F.col("pos") + 1 + DEFAULT_EXTENT, F.col("n")).alias("end_line"),
    )


def source_intents(statements: DataFrame, symbols: DataFrame | None = None, bucket: int = 20) -> DataFrame:
    """(pair_index, path, symbol, kind, texts, lines): changed statements by the symbol around them.

    The symbol is the earliest-starting one whose lines hold the statement, else
    a bucket of ``bucket`` lines. Added statements make 'insert', deleted ones 'delete'.
    """
    changed = statements.filter("kind in ('added', 'deleted')")
    if symbols is not None:
        s = symbols.select(F.col("pair_index").alias("sp"), F.col("path").alias("sq"), F.col("name").alias("sn"), "start_line", "end_line")
        inside = changed.join(s, (F.col("pair_index") == F.col("sp")) & (F.col("path") == F.col("sq")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left")
        changed = inside.groupBy("pair_index", "path", "line_no", "kind", "text", "ord").agg(F.min_by("sn", "start_line").alias("symbol"))
    else:
        changed = changed.withColumn("symbol", F.lit(None).cast("string"))
    named = changed.withColumn("symbol", F.coalesce("symbol", F.concat(F.lit("line_bucket_"), F.floor(F.col("line_no") / bucket).cast("string"))))
    items = F.array_sort(F.collect_list(F.struct("ord", "line_no", "text")))
    return named.groupBy("pair_index", "path", "symbol", F.when(F.col("kind") == "added", "insert").otherwise("delete").alias("intent")).agg(items.alias("items")).select(
        "pair_index", "path", "symbol", "intent", F.transform("items", lambda x: x["text"]).alias("texts"), F.transform("items", lambda x: x["line_no"]).alias("lines")
    )


def structure_graph(tree: DataFrame, repo: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of repositories, directories and files: one row per distinct node and 'contains' edge."""
    parts = F.split(F.col(path), "/")
    steps = tree.select(F.col(repo).alias("repo"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("d"))
    here = F.array_join(F.slice("parts", F.lit(1), F.col("d")), "/")
    above = F.array_join(F.slice("parts", F.lit(1), F.col("d") - 1), "/")
    is_file = F.col("d") == F.size("parts")
    spot = steps.select("repo", here.alias("path"), above.alias("parent"), F.when(is_file, "file").otherwise("dir").alias("kind"), F.when(F.col("d") == 1, "repo").otherwise("dir").alias("parent_kind")).distinct()
    root = F.lit("repo")
    own = node_id(F.col("kind"), F.col("repo"), F.col("path"))
    parent = F.when(F.col("parent_kind") == "repo", node_id(root, F.col("repo"))).otherwise(node_id(F.col("parent_kind"), F.col("repo"), F.col("parent")))
    nodes = spot.select(own.alias("id"), "kind", "repo", "path", F.when(F.col("kind") == "file", F.lower(extension(F.col("path")))).otherwise("").alias("extension")).unionByName(
        spot.select(node_id(root, F.col("repo")).alias("id"), F.lit("repo").alias("kind"), "repo", F.lit("").alias("path"), F.lit("").alias("extension"))
    )
    edges = spot.select(parent.alias("source"), own.alias("target"), F.lit("contains").alias("kind"))
    return nodes.distinct(), edges.distinct()


def upsert_nodes(nodes: DataFrame, seq: str) -> DataFrame:
    """One row per id, the one written last."""
    rest = [c for c in nodes.columns if c not in ("id", seq)]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), seq).alias("s")).select("id", "s.*")


def statement_nodes(lines: DataFrame, symbols: DataFrame, cap: int) -> DataFrame:
    """Lines within each symbol that read like statements, the first ``cap`` by line: (repo, path, symbol, line, text)."""
    told = lines.withColumn("text", strip(F.col("text"))).filter(meaningful(F.col("text"), 2, TOKEN_WORD))
    ranked = told.join(symbols.select("repo", "path", F.col("name").alias("symbol"), "start_line", "end_line"), ["repo", "path"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    w = Window.partitionBy("repo", "path", "symbol", "start_line").orderBy("line")
    return ranked.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= cap).select("repo", "path", "symbol", "line", "text")
