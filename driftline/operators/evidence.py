"""Evidence between a source patch and its targets: patch similarity, symbol matches, blocks, votes and hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.paths import path_tokens
from driftline.functions.seqratio import name_similarity, token_similarity
from driftline.functions.text import TOKEN_ALL, TOKEN_WORD, contains_any, jaccard, pattern_score, strip, tokens
from driftline.operators.ranking import top_k
from driftline.runtime import fan_out


def directional_similarity(source: DataFrame, target: DataFrame, key: str = "pair_index", lines: int = 80, others: int = 120, best: int = 20) -> DataFrame:
    """(key, similarity): the first source lines of each operation against the target's of the same one.

    Every source line takes its most similar target line; the mean of the best
    ``best`` counts. Both sides: (key, kind, ord, text) of added and deleted lines.
    """
    def head(d: DataFrame, n: int) -> DataFrame:
        d = d.filter(F.col("kind").isin("added", "deleted") & (F.length("text") >= 4))
        return top_k(d, [key, "kind"], [F.col("ord"), F.col("text")], n).select(key, "kind", "rank", "text")

    s = head(source, lines).withColumnRenamed("text", "s").withColumnRenamed("rank", "sr")
    t = head(target, others).select(key, "kind", F.col("text").alias("t")).distinct()
    pairs = s.join(t, [key, "kind"])
    scored = fan_out(pairs.select("s", "t").distinct()).withColumn("x", token_similarity(F.col("s"), F.col("t")))
    top = pairs.join(scored, ["s", "t"]).groupBy(key, "kind", "sr").agg(F.max("x").alias("x"))
    kept = top_k(top, [key], [F.col("x").desc(), F.col("kind"), F.col("sr")], best)
    return kept.groupBy(key).agg(F.round(F.avg("x"), 6).alias("similarity"))


def symbol_match(text_similarity: Column, intent_symbol: Column, target_symbol: Column, intent_tokens: Column, target_tokens: Column, source_path: Column, target_path: Column, pattern: Column, target_text: Column) -> Column:
    """.30 text + .27 name + .18 token overlap + .15 path + .10 pattern."""
    return (
        0.30 * text_similarity + 0.27 * name_similarity(intent_symbol, target_symbol) + 0.18 * jaccard(intent_tokens, target_tokens)
        + 0.15 * jaccard(path_tokens(source_path), path_tokens(target_path), 1.0) + 0.10 * pattern_score(pattern, target_text)
    )


def intent_matches(intents: DataFrame, symbols: DataFrame, pattern: Column, per_file: int = 2, key: str = "pair_index") -> DataFrame:
    """(key, sp, ss, intent, texts, path, name, start_line, end_line, score): each intent's ``per_file`` best symbols per file.

    ``intents`` has key, path, symbol, intent, texts; ``symbols`` has key, path, name, start_line, end_line, text.
    An intent meets the symbols that share a token or the name with it, by equal tokens, never all of its pair.
    """
    i = intents.select(key, F.col("path").alias("sp"), F.col("symbol").alias("ss"), "intent", "texts", F.array_join("texts", "\n").alias("st")).withColumn("a", tokens(F.col("st"), TOKEN_WORD))
    s = symbols.select(key, "path", "name", "start_line", "end_line", F.col("text").alias("tt"), *[c for c in ("pattern",) if c in symbols.columns]).withColumn("b", tokens(F.col("tt"), TOKEN_WORD))
    signs = lambda words, name: F.explode(F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("t"), w)), F.array(F.concat(F.lit("n"), name)))))
    own, other = [key, "sp", "ss", "intent"], [key, "path", "name", "start_line"]
    met = i.select(*own, signs(F.col("a"), F.coalesce("ss", F.lit(""))).alias("sign")).join(s.select(*other, signs(F.col("b"), F.coalesce("name", F.lit(""))).alias("sign")), [key, "sign"]).select(*own, *other[1:]).distinct()
    pairs = met.join(i, own).join(s, other)
    score = symbol_match(jaccard(F.col("a"), F.col("b")), F.col("ss"), F.col("name"), F.col("a"), F.col("b"), F.col("sp"), F.col("path"), pattern, F.col("tt"))
    return top_k(pairs.withColumn("score", F.round(score, 6)), [key, "sp", "ss", "intent", "path"], [F.col("score").desc(), F.col("start_line")], per_file)


def intent_blocks(intents: DataFrame, symbols: DataFrame, pattern: Column, per_file: int = 2, key: str = "pair_index") -> DataFrame:
    """(key, path, block, start, end, block_score, intents): target symbols that match source intents (see :func:`intent_matches`).

    A block's score is its best match, .12 more if a deletion supports it.
    """
    return blocks_of_matches(intent_matches(intents, symbols, pattern, per_file, key), key)


def blocks_of_matches(kept: DataFrame, key: str = "pair_index") -> DataFrame:
    per = kept.groupBy(key, "path", F.col("name").alias("block"), F.col("start_line").alias("start"), F.col("end_line").alias("end")).agg(F.max("score").alias("best"), F.max((F.col("intent") == "delete").cast("int")).alias("deletes"), F.count(F.lit(1)).alias("intents"))
    return per.select(key, "path", "block", "start", "end", F.round(F.col("best") + 0.12 * F.col("deletes"), 6).alias("block_score"), "intents")


def statement_evidence(predicted: DataFrame, deleted: DataFrame, threshold: float = 0.68, key: str = "pair_index", salts: int = 8) -> DataFrame:
    """Predicted statements with the most similar line a later change deletes in whichever file, from ``threshold`` on.

    Distinct texts of a key meet; only those whose tokens and lengths let them reach
    the threshold are compared by sequence. A busy key is spread over ``salts``.
    """
    p = predicted.select(key, "path", "line", "line_text")
    d = deleted.filter(F.length("text") >= 4).select(key, F.col("path").alias("deleted_path"), F.col("line_no").alias("deleted_line"), F.col("text").alias("deleted_text"))
    # The first place of a text is enough: equal texts are equally similar.
    first = d.groupBy(key, "deleted_text").agg(F.min(F.struct("deleted_line", "deleted_path")).alias("at")).withColumn("b", tokens(F.col("deleted_text"), TOKEN_ALL)).withColumn("nb", F.length(strip(F.col("deleted_text"))))
    texts = p.select(key, "line_text").distinct().withColumn("a", tokens(F.col("line_text"), TOKEN_ALL)).withColumn("na", F.length(strip(F.col("line_text"))))
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("line_text"), F.lit(salts)).cast("int"))
    pairs = salted.join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"])
    bound = 0.55 * 2.0 * F.least("na", "nb") / (F.col("na") + F.col("nb")) + 0.45 * jaccard(F.col("a"), F.col("b"), 1.0)
    near = pairs.filter((F.col("na") > 0) & (bound >= threshold - 1e-9)).select(key, "line_text", "deleted_text", "at")
    scored = fan_out(near.select("line_text", "deleted_text").distinct()).withColumn("similarity", token_similarity(F.col("line_text"), F.col("deleted_text"))).filter(F.col("similarity") >= threshold)
    best = near.join(scored, ["line_text", "deleted_text"]).groupBy(key, "line_text").agg(F.min(F.struct((-F.round("similarity", 6)).alias("s"), F.col("at"), F.col("deleted_text"))).alias("m"))
    return p.join(best, [key, "line_text"]).select(key, "path", "line", "line_text", F.col("m.at.deleted_path").alias("deleted_path"), F.col("m.at.deleted_line").alias("deleted_line"), F.col("m.deleted_text").alias("deleted_text"), (-F.col("m.s")).alias("similarity"))


# Weights of statement modules.
MODULE_WEIGHTS = {"semantic": 1.18, "graphqa": 1.10}


def weighted_lines(ranked: DataFrame, keys: Sequence[str], top: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum over modules of weight x (score + 1 / (rank + 2)), .05 more per module; modules without a weight have 1."""
    w = F.lit(1.0)
    for name, v in (weights or MODULE_WEIGHTS).items():
        w = F.when(F.col("method") == name, F.lit(v)).otherwise(w)
    per = ranked.groupBy(*keys, "path", "line").agg(F.sum(w * (F.col("score") + 1.0 / (F.col("rank") + 2))).alias("s"), F.count_distinct("method").alias("m"))
    return top_k(per.select(*keys, "path", "line", F.round(F.col("s") + 0.05 * F.col("m"), 6).alias("score")), keys, [F.col("score").desc(), F.col("path"), F.col("line")], top)


def files_from_evidence(files: DataFrame, statements: DataFrame, top: int, key: str = "pair_index") -> DataFrame:
    """Per file the larger of .55 score + .02 max(0, 20 - place) and .52 statement + .35 file + .13 symbol.

    ``files``: key, path, score, rank; ``statements``: key, path, score, symbol_score.
    """
    f = files.select(key, "path", "score", (0.55 * F.col("score") + 0.02 * F.greatest(F.lit(0), 21 - F.col("rank"))).alias("v"))
    s = statements.groupBy(key, "path").agg(F.max(F.struct(F.col("score"), F.coalesce("symbol_score", F.lit(0.0)).alias("y"))).alias("b"))
    voted = s.join(f.select(key, "path", F.col("score").alias("fs")), [key, "path"], "left").select(key, "path", (0.52 * F.col("b.score") + 0.35 * F.coalesce("fs", F.lit(0.0)) + 0.13 * F.col("b.y")).alias("v"))
    best = f.select(key, "path", "v").unionByName(voted).groupBy(key, "path").agg(F.round(F.max("v"), 6).alias("score"))
    return top_k(best, [key], [F.col("score").desc(), F.col("path")], top)


def final_files(candidates: DataFrame, statements: DataFrame, top: int, key: str = "pair_index") -> DataFrame:
    """A file's score is the best of its candidates and of its statements."""
    both = candidates.select(key, "path", "score").unionByName(statements.select(key, "path", "score"))
    return top_k(both.groupBy(key, "path").agg(F.max("score").alias("score")), [key], [F.col("score").desc(), F.col("path")], top)


# Words that call for a kind of impact.
TEST_WORDS = ["test", "regression"]
SYMBOL_WORDS = ["func ", "type ", "var ", "const ", "signature", "rename", "refactor"]
DELETION_WORDS = ["delete", "remove", "protocol", "handler", "flag", "rpc", "api", "json", "marshal", "import"]


def routing(patch: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, test, symbol, deletion_interface_build): which kinds of impact a patch calls for.

    ``patch``: key, paths ARRAY, text. The deletion signal rests on words alone.
    """
    low = F.lower("text")
    return patch.select(
        key, (F.exists("paths", lambda p: p.contains("_test.") | F.lower(p).contains("/test")) | contains_any(low, TEST_WORDS)).alias("test"),
        contains_any(low, SYMBOL_WORDS).alias("symbol"),
        contains_any(low, DELETION_WORDS).alias("deletion_interface_build"),
    )


def symbol_terms(statements: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, terms): names declared, methods called, and tokens of six characters or more, lower case."""
    found = F.array_union(
        F.array_union(F.regexp_extract_all("text", F.lit(r"\b(?:func|type|var|const)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"\.([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))),
        F.filter(F.regexp_extract_all("text", F.lit(TOKEN_WORD), F.lit(0)), lambda t: F.length(t) >= 6),
    )
    return statements.select(key, F.explode(found).alias("t")).groupBy(key).agg(F.sort_array(F.collect_set(F.lower("t"))).alias("terms"))


def impact_candidates(targets: DataFrame, terms: DataFrame, least: float, base: float, bonus_words: Sequence[str] = (), key: str = "pair_index") -> DataFrame:
    """Files whose path tokens meet the terms by more than ``least`` (Jaccard): ``base`` + similarity (+ .08 for a word in the path)."""
    j = jaccard(path_tokens(F.col("path")), F.col("terms"), 1.0)
    p = targets.join(terms, key).withColumn("j", j).filter(F.col("j") > least)
    extra = 0.08 * contains_any(F.lower("path"), list(bonus_words)).cast("double") if bonus_words else F.lit(0.0)
    return p.select(key, "path", F.round(base + F.col("j") + extra, 6).alias("score"))


def evaluate(predicted: DataFrame, ranges: DataFrame, tolerance: int = 5, key: str = "pair_index") -> DataFrame:
    """(key, file_hit, statement_hit, first_hits): does a prediction meet the truth, and with which first five statements.

    ``predicted``: key, path, line, rank; ``ranges``: key, path, start, end.
    """
    files = predicted.select(key, "path").distinct().join(ranges.select(key, "path").distinct(), [key, "path"], "left_semi").select(key).distinct().withColumn("file_hit", F.lit(True))
    close = F.col("line").between(F.col("start") - tolerance, F.col("end") + tolerance)
    hits = predicted.join(ranges, [key, "path"]).filter(close).select(key, "path", "line", "rank").distinct()
    first = hits.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "path", "line"))), 1, 5).alias("first_hits"))
    return predicted.select(key).distinct().join(files, key, "left").join(first, key, "left").select(key, F.coalesce("file_hit", F.lit(False)).alias("file_hit"), F.col("first_hits").isNotNull().alias("statement_hit"), "first_hits")


def summary(evaluated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates (four decimals, null without pairs)."""
    n = F.count(F.lit(1))
    f, s = F.count_if("file_hit"), F.count_if("statement_hit")
    return evaluated.groupBy(*keys).agg(n.alias("pairs"), f.alias("file_hits"), s.alias("statement_hits"), F.round(F.try_divide(f, n), 4).alias("file_rate"), F.round(F.try_divide(s, n), 4).alias("statement_rate"))


def preview(lines: DataFrame, wanted: DataFrame, keys: Sequence[str], before: int = 4, height: int = 16, chars: int = 1200) -> DataFrame:
    """(keys, code): a window of lines that begins ``before`` lines ahead of the first line that holds a wanted word.

    ``lines``: keys, line, text; ``wanted``: keys, words ARRAY.
    """
    at = lines.join(wanted, list(keys)).filter(F.exists("words", lambda w: F.col("text").contains(w))).groupBy(*keys).agg(F.greatest(F.min("line") - before, F.lit(1)).alias("from"))
    inside = lines.join(at, list(keys)).filter(F.col("line").between(F.col("from"), F.col("from") + height - 1))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return inside.groupBy(*keys).agg(F.substring(code, 1, chars).alias("code"))


def vocabulary(tokens_: DataFrame, token: str, size: int, first_id: int = 2) -> DataFrame:
    """(token, n, id): the most frequent tokens, ids from ``first_id`` (0 pads, 1 is unknown); ties by the token."""
    counts = tokens_.groupBy(token).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), token).limit(size - first_id)
    return counts.withColumn("id", F.row_number().over(Window.orderBy(F.col("n").desc(), token)) + first_id - 1)  # at most ``size`` rows


def as_ids(items: DataFrame, keys: Sequence[str], token: str, position: str, vocab: DataFrame, length: int) -> DataFrame:
    """(keys, ids, mask): token ids in order, unknown ones 1, cut or padded with 0 to ``length``."""
    known = items.join(F.broadcast(vocab.select(token, "id")), token, "left").withColumn("id", F.coalesce("id", F.lit(1)))  # the vocabulary has a fixed size
    rows = known.groupBy(*keys).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(position, "id"))), lambda x: x["id"]), 1, length).alias("ids"))
    pad = F.array_repeat(F.lit(0), F.lit(length) - F.size("ids"))
    return rows.select(*keys, F.concat("ids", pad).alias("ids"), F.concat(F.transform("ids", lambda _: F.lit(1)), pad).alias("mask"))


def seeded_sample(items: DataFrame, item: str, n: int, seed: int) -> DataFrame:
    """``n`` items in the order of a seeded hash: the same ones in every run."""
    return items.orderBy(F.xxhash64(F.col(item), F.lit(seed)), item).limit(n)
