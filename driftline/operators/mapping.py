"""From a source patch to lines of target files by way of symbols and blocks, and what re-ranks files by content.

Products stay small by construction: a file meets at most ``SYMBOLS`` source
symbols, a line the statements of one file's tier, a block its own intents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.paths import basename, path_tokens
from driftline.functions.seqratio import most_similar, name_similarity, token_similarity
from driftline.functions.text import TOKEN_ALL, boilerplate, jaccard, meaningful, normalize_code, patch_pattern, pattern_score, strip, tokens
from driftline.operators.ranking import round_robin, top_k, unique_rank
from driftline.operators.statements import best_statement
from driftline.runtime import fan_out

# How many source symbols, symbols of a file without a hit, target symbols and statements of the last tier count.
SYMBOLS, UNHIT, RANGES, STATEMENTS = 8, 4, 4, 80


def mapped_sources(statements: DataFrame, files: DataFrame, limit: int | None = STATEMENTS, key: str = "pair_index") -> DataFrame:
    """(key, path, source_path, source_line, source_kind, source_text, place): what a target file is compared with.

    The statements of its matched source path; without any, those of files of that name; without any, the first
    ``limit`` of the key (None: all). A file without a matched path takes all.
    """
    s = statements.filter(meaningful(strip(F.col("text")))).select(key, F.col("path").alias("source_path"), F.col("line_no").alias("source_line"), F.col("kind").alias("source_kind"), F.col("text").alias("source_text"), "ord")
    order = [F.col("ord"), F.col("source_line"), F.col("source_text"), F.col("source_path")]
    f = files.select(key, "path", "matched_source_path").distinct()
    same = f.join(s.withColumn("matched_source_path", F.col("source_path")), [key, "matched_source_path"])
    rest = f.join(same.select(key, "path").distinct(), [key, "path"], "left_anti")
    named = rest.withColumn("name", basename(F.col("matched_source_path"))).join(s.withColumn("name", basename(F.col("source_path"))), [key, "name"]).drop("name")
    last = rest.filter("matched_source_path is not null").join(named.select(key, "path").distinct(), [key, "path"], "left_anti")
    first = s if limit is None else top_k(s, [key], order, limit).drop("rank")
    every = same.select(*named.columns).unionByName(named).unionByName(last.join(first, key).select(*named.columns)).unionByName(rest.filter("matched_source_path is null").join(s, key).select(*named.columns))
    return every.withColumn("place", F.row_number().over(Window.partitionBy(key, "path").orderBy(*order)))


def symbols_of_patch(mapped: DataFrame, symbols: DataFrame, most: int = SYMBOLS, unhit: int = UNHIT, key: str = "pair_index") -> DataFrame:
    """(key, path, source_path, name, start_line, text): source symbols around the statements a target file is compared with.

    Of a source file whose symbols hold none of them, its first ``unhit`` symbols. The matched path comes first, then
    the files in the order of their statements; ``most`` symbols in all.
    """
    paths = mapped.groupBy(key, "path", "source_path").agg(F.min(F.when(F.col("source_path") == F.col("matched_source_path"), 0).otherwise(F.col("place"))).alias("turn"))
    s = symbols.select(key, F.col("path").alias("source_path"), "name", "start_line", "end_line", "text")
    around = mapped.select(key, "path", "source_path", "source_line").join(s, [key, "source_path"]).filter(F.col("source_line").between(F.col("start_line"), F.col("end_line")))
    hit = around.select(key, "path", "source_path", "name", "start_line", "text").distinct()
    head = top_k(s, [key, "source_path"], [F.col("start_line"), F.col("name")], unhit)
    none = paths.join(hit.select(key, "path", "source_path").distinct(), [key, "path", "source_path"], "left_anti").join(head, [key, "source_path"]).select(*hit.columns)
    return top_k(hit.unionByName(none).join(paths, [key, "path", "source_path"]), [key, "path"], [F.col("turn"), F.col("source_path"), F.col("start_line"), F.col("name")], most).drop("rank", "turn")


def rank_symbols(targets: DataFrame, sources: DataFrame, patterns: DataFrame, key: str = "pair_index") -> DataFrame:
    """``targets`` with ``match_score`` and ``rank`` per file: the best of .34 name + .28 tokens + .24 node types + .14 pattern over the file's source symbols.

    ``targets``: key, path, name, start_line, end_line, text; ``sources``: :func:`symbols_of_patch`; ``patterns``: key, path, pattern.
    Node types count where both have ``node_types``; a file without source symbols has .35.
    """
    from driftline.functions.text import weighted_jaccard

    typed = "node_types" in targets.columns and "node_types" in sources.columns
    s = sources.select(key, "path", F.col("name").alias("sn"), F.col("text").alias("st"), *([F.col("node_types").alias("sa")] if typed else []))
    pairs = targets.join(s, [key, "path"], "left").join(patterns, [key, "path"], "left")
    parts = 0.34 * name_similarity(F.col("sn"), F.col("name")) + 0.28 * jaccard(tokens(F.col("st"), TOKEN_ALL), tokens(F.col("text"), TOKEN_ALL)) + 0.14 * pattern_score(F.col("pattern"), F.col("text"))
    if typed:
        parts = parts + 0.24 * weighted_jaccard(F.col("sa"), F.col("node_types"))
    scored = pairs.withColumn("score", F.when(F.col("sn").isNull(), 0.35).otherwise(parts)).groupBy(key, "path", "name", "start_line", "end_line").agg(F.round(F.max("score"), 6).alias("match_score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key, "path").orderBy(F.col("match_score").desc(), "start_line", "name")))


def file_patterns(mapped: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, path, pattern) of the statements a file is compared with, the first ``STATEMENTS`` of them."""
    texts = F.array_sort(F.collect_list(F.when(F.col("place") <= STATEMENTS, F.struct("place", "source_text"))))
    return mapped.groupBy(key, "path").agg(patch_pattern(F.array_join(F.transform(texts, lambda x: x["source_text"]), "\n")).alias("pattern"))


def mapped_lines(lines: DataFrame, mapped: DataFrame, ranked: DataFrame, k: int, ranges: int = RANGES, key: str = "pair_index") -> DataFrame:
    """.58 best statement similarity + .25 symbol + .17 pattern, over the lines of a file's first ``ranges`` symbols.

    A line within several of them has the best ranked; a file without symbols has all its lines. ``k`` best a file, by (-score, line).
    """
    top = ranked.filter(F.col("rank") <= ranges).select(key, "path", F.col("name").alias("symbol"), "start_line", "end_line", "match_score", F.col("rank").alias("place"))
    inside = lines.join(top, [key, "path"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy(key, "path", "line", "text").agg(F.min(F.struct("place", "match_score", "symbol")).alias("s"))
    inside = inside.select(key, "path", "line", "text", F.col("s.match_score").alias("symbol_score"), F.col("s.symbol").alias("symbol"))
    free = lines.join(top.select(key, "path").distinct(), [key, "path"], "left_anti").select(key, "path", "line", "text", F.lit(0.0).alias("symbol_score"), F.lit(None).cast("string").alias("symbol"))
    held = inside.unionByName(free).filter(meaningful(strip(F.col("text"))) & ~boilerplate(F.col("text")))
    best = best_statement(held, mapped, key).join(held.drop("text"), [key, "path", "line"]).join(file_patterns(mapped, key), [key, "path"])
    score = 0.58 * F.col("similarity") + 0.25 * F.col("symbol_score") + 0.17 * pattern_score(F.col("pattern"), F.col("line_text"))
    scored = best.withColumn("score", F.round(score, 6)).withColumn("similarity", F.round("similarity", 6))
    return top_k(scored, [key, "path"], [F.col("score").desc(), F.col("line")], k)


def expanded_blocks(blocks: DataFrame, matches: DataFrame, lines: DataFrame, top: int, cap: int, texts: int = 16, most: int = 120, key: str = "pair_index") -> DataFrame:
    """Lines of blocks by the intents that chose them: .42 block + .48 similarity + .10 / (rank + 1), and anchors of insertions .52 block + .18.

    ``blocks``: key, path, block, start, end, block_score, rank; ``matches``: key, path, block, start, intent_key,
    intent, texts; ``lines``: key, path, line, text. A place counts once, by its best score. Intents take turns;
    each has a budget of its statements (three each for a deletion), ``cap`` at least and ``most`` at most.
    """
    m = matches.select(key, "path", "block", "start", "intent_key", "intent", F.slice("texts", 1, texts).alias("texts"))
    given = blocks.join(m, [key, "path", "block", "start"])
    budget = F.when(F.col("intent") == "delete", F.least(F.lit(most), F.greatest(F.lit(cap), 3 * F.size("texts")))).otherwise(F.least(F.lit(most), F.greatest(F.lit(cap), F.size("texts"))))
    held = blocks.select(key, "path", "block", "start", "end").join(lines.filter(meaningful(strip(F.col("text")))), [key, "path"]).filter(F.col("line").between(F.col("start"), F.col("end")))
    held = held.groupBy(key, "path", "block", "start").agg(F.collect_list(F.struct("line", F.col("text").alias("line_text"))).alias("ls"))
    found = fan_out(given.join(held, [key, "path", "block", "start"])).withColumn("b", most_similar(F.col("ls.line_text"), F.col("texts"))).withColumn("x", F.explode(F.arrays_zip("ls", "b")))
    near = found.select(key, "path", "intent_key", "block", F.col("x.ls.line").alias("line"), F.round(0.42 * F.col("block_score") + 0.48 * F.coalesce("x.b.similarity", F.lit(0.0)) + 0.10 / (F.col("rank") + 1), 6).alias("score"), budget.alias("budget"), F.when(F.col("intent") == "delete", "DeleteRegion").otherwise("FindAffectedStatement").alias("action"))
    ends = lines.groupBy(key, "path").agg(F.max("line").alias("last"))
    spots = F.array_distinct(F.transform(F.array(F.col("start"), F.col("end"), F.col("start") + 1, F.col("end") - 1), lambda x: F.least(F.col("last"), F.greatest(F.lit(1), x))))
    anchors = given.filter("intent = 'insert'").join(ends, [key, "path"]).select(key, "path", "intent_key", "block", F.explode(spots).alias("line"), F.round(0.52 * F.col("block_score") + 0.18, 6).alias("score"), F.greatest(F.lit(cap), F.size("texts")).alias("budget"), F.lit("InsertAnchor").alias("action"))
    order = [F.col("score").desc(), F.col("path"), F.col("line"), F.col("action"), F.col("intent_key")]
    once = unique_rank(near.unionByName(anchors), [key], ["path", "line"], order, 3 * top).drop("rank")
    return round_robin(once, [key], ["intent_key"], order, top, cap=F.col("budget"))


def _holds_tests(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("_test.") | low.contains("/test") | low.contains("test/")


def _base(path: Column) -> Column:
    return F.replace(F.substring_index(basename(path), ".", 1), F.lit("_test"), F.lit(""))


def test_impact(candidates: DataFrame, sources: DataFrame, targets: DataFrame, terms: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """Candidates and test files: .58 + .22 for a source's base name + .20 tokens shared with the source's terms, the best per path.

    Test files count where the source changes tests, or one bears a source's base name.
    """
    tested = sources.groupBy(key).agg(F.max(_holds_tests(F.col("path"))).alias("tested"))
    bases = sources.select(key, _base(F.col("path")).alias("base")).distinct().withColumn("same", F.lit(1))
    t = targets.select(key, "path").distinct().filter(_holds_tests(F.col("path"))).withColumn("base", _base(F.col("path"))).join(tested, key).join(bases, [key, "base"], "left").join(terms.select(key, "terms"), key, "left")
    score = 0.58 + 0.22 * F.coalesce("same", F.lit(0)) + 0.20 * jaccard(path_tokens(F.col("path")), F.coalesce("terms", F.array().cast("array<string>")), 1.0)
    tests = t.filter("tested or same = 1").select(key, "path", F.round(score, 6).alias("score"), F.lit("AskTestImpact").alias("action"))
    both = candidates.select(key, "path", "score", F.lit("candidate").alias("action")).unionByName(tests)
    best = both.groupBy(key, "path").agg(F.max(F.struct("score", F.col("action").alias("a"))).alias("b")).select(key, "path", "b.score", F.col("b.a").alias("action"))
    return top_k(best, [key], [F.col("score").desc(), F.col("path")], k)


def content_rank(pool: DataFrame, texts: DataFrame, sources: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """.62 content + .23 symbols and terms against the path + .15 prior, of a prefiltered pool.

    ``texts``: key, path, words (tokens of the file); ``sources``: key, words, symbols, terms.
    """
    none = F.array().cast("array<string>")
    j = pool.select(key, "path", F.col("score").alias("prior")).join(texts.select(key, "path", F.col("words").alias("tw")), [key, "path"], "left").join(sources, key)
    own = path_tokens(F.col("path"))
    content = jaccard(F.array_union("words", "symbols"), F.array_union(F.coalesce("tw", none), own), 1.0)
    score = 0.62 * content + 0.23 * jaccard(F.array_union("symbols", "terms"), own, 1.0) + 0.15 * F.col("prior")
    return top_k(j.select(key, "path", F.round(score, 6).alias("score")), [key], [F.col("score").desc(), F.col("path")], k)


def patch_rank(pool: DataFrame, texts: DataFrame, patches: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """.72 similarity of the normalised source patch and file + .28 prior, of a prefiltered pool; 0 for a file without text."""
    j = pool.select(key, "path", F.col("score").alias("prior")).join(texts.select(key, "path", "text"), [key, "path"], "left").join(patches.select(key, F.col("text").alias("patch")), key)
    a, b = normalize_code(F.col("patch")), normalize_code(F.col("text"))
    clone = F.when(F.length("text") > 0, token_similarity(a, b)).otherwise(0.0)
    scored = fan_out(j).withColumn("score", F.round(0.72 * clone + 0.28 * F.col("prior"), 6))
    return top_k(scored.select(key, "path", "score"), [key], [F.col("score").desc(), F.col("path")], k)
