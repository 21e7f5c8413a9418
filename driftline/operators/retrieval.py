"""Finding target files for source files: path, token, clone and vector similarity, and what surrounds a candidate.

Pairs are formed within a pair_index (equi join), never across the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import basename, dirname, extension, is_test_or_data, norm_path, path_tokens, stem
from driftline.functions.seqratio import path_score
from driftline.functions.text import TOKEN_WORD, clone_tokens, dice_jaccard_of, jaccard
from driftline.functions.vectors import unit
from driftline.operators.nearest import nearest_sets
from driftline.operators.ranking import reciprocal, top_k
from driftline.runtime import fan_out, spread

def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("path")]


def pairs_of(sources: DataFrame, targets: DataFrame, key: str = "pair_index") -> DataFrame:
    """Every source path with every target path of its key: (key, source_path, path)."""
    return sources.select(key, F.col("path").alias("source_path")).distinct().join(targets.select(key, "path").distinct(), key)


def best_source(scored: DataFrame, key: str = "pair_index") -> DataFrame:
    """Per target the best source, ties to the smallest source path: (key, path, score, matched_source_path)."""
    best = scored.groupBy(key, "path").agg(F.min_by("source_path", F.struct((-F.col("score")).alias("s"), F.col("source_path"))).alias("matched_source_path"), F.max("score").alias("score"))
    return best.select(key, "path", "score", "matched_source_path")


def rank_files(sources: DataFrame, targets: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """Top k targets per key by their best path score."""
    scored = fan_out(pairs_of(sources, targets, key)).withColumn("score", F.round(path_score(F.col("source_path"), F.col("path")), 6))
    return top_k(best_source(scored, key), [key], _order(), k)


def token_pairs(sources: DataFrame, targets: DataFrame, key: str = "pair_index") -> DataFrame:
    """Pairs with the Jaccard similarity of their path tokens."""
    return pairs_of(sources, targets, key).withColumn("score", F.round(jaccard(path_tokens(F.col("source_path")), path_tokens(F.col("path")), 1.0), 6))


def high_recall(sources: DataFrame, targets: DataFrame, terms: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """.72 path score + .18 equal normalised paths + .10 Jaccard of the source's tokens and terms with the path."""
    p = fan_out(pairs_of(sources, targets, key).join(terms.select(key, "terms"), key, "left"))
    wanted = F.array_union(path_tokens(F.col("source_path")), F.coalesce("terms", F.array().cast("array<string>")))
    score = 0.72 * path_score(F.col("source_path"), F.col("path")) + 0.18 * (norm_path(F.col("source_path")) == norm_path(F.col("path"))).cast("double") + 0.10 * jaccard(wanted, path_tokens(F.col("path")), 1.0)
    return top_k(best_source(p.withColumn("score", F.round(score, 6)), key), [key], _order(), k)


def path_prefilter(sources: DataFrame, targets: DataFrame, terms: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """.68 path score + .32 Jaccard of path tokens and terms, best source per target, top k."""
    p = fan_out(pairs_of(sources, targets, key).join(terms.select(key, "terms"), key, "left"))
    score = 0.68 * path_score(F.col("source_path"), F.col("path")) + 0.32 * jaccard(path_tokens(F.col("path")), F.coalesce("terms", F.array().cast("array<string>")), 1.0)
    return top_k(best_source(p.withColumn("score", score), key), [key], _order(), k)


def companions(sources: DataFrame, targets: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """Test and data files near a source: .52 path score + .32 same stem + .16 token overlap, kept from .28, plus .18."""
    p = fan_out(pairs_of(sources, targets.filter(is_test_or_data(F.col("path"))), key))
    score = 0.52 * path_score(F.col("source_path"), F.col("path")) + 0.32 * (stem(F.col("source_path")) == stem(F.col("path"))).cast("double") + 0.16 * jaccard(path_tokens(F.col("source_path")), path_tokens(F.col("path")), 1.0)
    kept = p.withColumn("score", F.round(score, 6)).filter("score >= 0.28").withColumn("score", F.round(F.col("score") + 0.18, 6))
    return top_k(best_source(kept, key), [key], _order(), k)


def neighbours(candidates: DataFrame, targets: DataFrame, sources: DataFrame, head: int = 20, key: str = "pair_index") -> DataFrame:
    """Files beside the first ``head`` candidates (same directory and extension) that test them or bear a source's name; score x .92."""
    near = candidates.filter(F.col("rank") <= head).select(key, F.col("path").alias("of"), "score", dirname(F.col("path")).alias("dir"), extension(F.col("path")).alias("ext"))
    around = targets.select(key, "path", dirname(F.col("path")).alias("dir"), extension(F.col("path")).alias("ext"))
    names = sources.select(key, basename(F.col("path")).alias("name")).distinct()
    p = near.join(around, [key, "dir", "ext"]).filter("path <> of")
    named = p.withColumn("name", basename(F.col("path"))).join(names.withColumn("named", F.lit(True)), [key, "name"], "left")
    tests = (stem(F.col("path")) == stem(F.col("of"))) & (is_test_or_data(F.col("path")) != is_test_or_data(F.col("of")))
    kept = named.filter(tests | F.col("named")).groupBy(key, "path").agg(F.round(F.max("score") * 0.92, 6).alias("score"))
    return kept.join(candidates.select(key, "path"), [key, "path"], "left_anti")


def exact_counterparts(sources: DataFrame, targets: DataFrame, key: str = "pair_index") -> DataFrame:
    """Sources whose path is a target too."""
    return sources.select(key, "path").distinct().join(targets.select(key, "path").distinct(), [key, "path"], "left_semi")


def proposed_files(sources: DataFrame, targets: DataFrame, key: str = "pair_index") -> DataFrame:
    """Sources without a target of the same path: new files to propose, score 1.2."""
    return sources.select(key, "path").distinct().join(targets.select(key, "path").distinct(), [key, "path"], "left_anti").withColumn("score", F.lit(1.2))


def auxiliary(sources: DataFrame, targets: DataFrame, key: str = "pair_index") -> DataFrame:
    """Exact 1.0, same name .78 (.08 more in the same directory), else a proposed new file .72; no .gitignore."""
    s = sources.select(key, F.col("path").alias("source_path"), basename(F.col("path")).alias("name")).distinct().filter("name <> '.gitignore'")
    t = targets.select(key, "path", basename(F.col("path")).alias("name")).distinct()
    same_dir = dirname(F.col("path")) == dirname(F.col("source_path"))
    hits = s.join(t, [key, "name"]).select(
        key, "source_path", "path", F.when(F.col("path") == F.col("source_path"), F.lit(1.0)).otherwise(0.78 + 0.08 * same_dir.cast("double")).alias("score"),
        F.when(F.col("path") == F.col("source_path"), "exact").otherwise("same_name").alias("action"),
    )
    new = s.join(hits.select(key, "source_path").distinct(), [key, "source_path"], "left_anti").select(key, "source_path", F.col("source_path").alias("path"), F.lit(0.72).alias("score"), F.lit("new_file").alias("action"))
    return hits.unionByName(new)


def judgements(scored: DataFrame, key: str = "pair_index") -> DataFrame:
    """Best source of every target, and best target of the sources this leaves out; ties to the largest path.

    (key, source_path, path, score) with score the mapping score.
    """
    by_target = scored.groupBy(key, "path").agg(F.max_by(F.struct("source_path", "score"), F.struct("score", "source_path")).alias("b")).select(key, "b.source_path", "path", "b.score")
    left = scored.join(by_target.select(key, "source_path").distinct(), [key, "source_path"], "left_anti")
    by_source = left.groupBy(key, "source_path").agg(F.max_by(F.struct("path", "score"), F.struct("score", "path")).alias("b")).select(key, "source_path", "b.path", "b.score")
    return by_target.unionByName(by_source)


def impact_fusion(reference: DataFrame, intent: DataFrame, sources: DataFrame, k: int, key: str = "pair_index") -> DataFrame:
    """Reciprocal rank fusion of two rankings: .74 / (2 + r1) + .26 / (2 + r2) + .30 for a source's own path.

    An item missing in a list takes the rank behind it: k + 5, and 2 k + 5.
    """
    a, b = reference.select(key, "path", F.col("rank").alias("r1")), intent.select(key, "path", F.col("rank").alias("r2"))
    own = sources.select(key, "path").distinct().withColumn("own", F.lit(0.30))
    both = a.join(b, [key, "path"], "full").join(own, [key, "path"], "left")
    score = reciprocal(F.coalesce("r1", F.lit(k + 5)), 0.74, 2) + reciprocal(F.coalesce("r2", F.lit(2 * k + 5)), 0.26, 2) + F.coalesce("own", F.lit(0.0))
    return top_k(both.withColumn("score", F.round(score, 6)), [key], _order(), k)


def clone_topk(queries: DataFrame, documents: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """Top k documents per query by token-clone similarity, over blocks of token sets (see :mod:`driftline.operators.nearest`).

    Both sides are (id, text). No row is formed for a pair that merely shares a token.
    """
    sets = lambda df, key: spread(df.select(key, "text")).select(key, clone_tokens(F.col("text")))
    near = nearest_sets(sets(queries, query), sets(documents, doc), k)
    scored = near.withColumn("score", F.round(dice_jaccard_of(F.col("c"), F.col("nq"), F.col("nd")), 6))
    return top_k(scored, ["q"], [F.col("score").desc(), F.col("d")], k).select(F.col("q").alias(query), F.col("d").alias(doc), "score", "rank")


CHUNKS, WIDTHS = 80, (3, 6)


def clone_chunks(files: DataFrame, keys: list[str], text: str = "text", limit: int | None = CHUNKS) -> DataFrame:
    """(keys, chunk, tokens): lines of three tokens or more, then windows of 3 and 6 non-blank lines without overlap of five or more.

    Of more than ``limit`` chunks, ``limit`` are taken at even distances, as the reference method has it; None takes all.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    single = F.filter(F.transform(lines, lambda x: clone_tokens(x)), lambda t: F.size(t) >= 3)

    def windows(w: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("ls"), F.lit(1)), F.lit(w))
        return F.filter(F.transform(starts, lambda s: clone_tokens(F.array_join(F.slice("ls", s, F.lit(w)), "\n"))), lambda t: F.size(t) >= 5)

    base = files.select(*keys, lines.alias("ls"), single.alias("one"))
    every = base.select(*keys, F.concat("one", *[windows(w) for w in WIDTHS]).alias("cs"))
    n = F.size("cs")
    picked = F.col("cs") if limit is None else F.when(n <= limit, F.col("cs")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get("cs", F.floor(i * n / limit).cast("int"))))
    return every.select(*keys, F.posexplode(picked).alias("chunk", "tokens"))


def clone_chunk_scores(sources: DataFrame, targets: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, path, score): the best similarity of any source chunk with any target chunk of the key.

    Chunk pairs meet on common tokens only, so pairs that share nothing (score
    0) are never formed.
    """
    a = sources.select(key, F.col("path").alias("sp"), F.col("chunk").alias("sc"), F.size("tokens").alias("na"), F.explode("tokens").alias("t"))
    b = targets.select(key, "path", F.col("chunk").alias("tc"), F.size("tokens").alias("nb"), F.explode("tokens").alias("t"))
    common = a.join(b, [key, "t"]).groupBy(key, "sp", "sc", "path", "tc", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return common.withColumn("s", dice_jaccard_of(F.col("c"), F.col("na"), F.col("nb"))).groupBy(key, "path").agg(F.round(F.max("s"), 6).alias("score"))


#: Vectors of a block of :func:`vector_topk`.
BLOCK = 1024


def _block_best(query: str, k: int):
    def best(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for qi, qv, vi, vv in zip(f["qi"], f["qv"], f["vi"], f["vv"], strict=True):
                scores = np.round(np.stack(qv) @ np.stack(vv).T, 6)
                scores[np.asarray(qi)[:, None] == np.asarray(vi)[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(np.asarray(vi), scores.shape), -scores))[:, :k]
                rows, places = np.repeat(np.arange(len(qi)), order.shape[1]), order.ravel()
                found = scores[rows, places]
                keep = np.isfinite(found)
                yield pd.DataFrame({"query_id": np.asarray(qi)[rows][keep], query: np.asarray(vi)[places][keep], "score": found[keep]})

    return best


def vector_topk(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """Exact top k by cosine, ties to the smallest id: (query_id, id, score, rank).

    ``queries`` is the stated query set, held against all vectors in blocks of about ``BLOCK``: two blocks meet in one
    matrix product, which keeps its k best per query before anything is shuffled. Nothing is broadcast by hint. Null vectors take no part.
    """
    def blocks(d: DataFrame, i: str, v: str) -> DataFrame:
        n = -(-max(d.count(), 1) // BLOCK)
        packed = d.filter(F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("__b"))
        return packed.agg(F.collect_list(F.struct(F.col(id_col).cast("bigint").alias("i"), unit(F.col(vector)).alias("v"))).alias("x")).select(F.col("x.i").alias(i), F.col("x.v").alias(v))

    met = fan_out(blocks(vectors, "vi", "vv")).crossJoin(blocks(queries, "qi", "qv"))
    found = met.mapInPandas(_block_best(id_col, k), f"query_id bigint, {id_col} bigint, score double")
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col(id_col)], k)


def terms_of(statements: DataFrame, key: str = "pair_index") -> DataFrame:
    """(key, terms): path tokens of the changed files and word tokens of three characters or more of their statements."""
    words = statements.select(key, F.explode(F.array_union(path_tokens(F.col("path")), F.array_distinct(F.filter(F.transform(F.regexp_extract_all("text", F.lit(TOKEN_WORD), F.lit(0)), lambda t: F.lower(t)), lambda t: F.length(t) >= 3)))).alias("t"))
    return words.groupBy(key).agg(F.sort_array(F.collect_set("t")).alias("terms"))
