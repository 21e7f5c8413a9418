"""The pN_ queries: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.bpe import encode_corpus, tokenizer
from driftline.llm.components import linked_records
from driftline.llm.generated import machine_files
from driftline.llm.markup import clean_documents, marked_elements
from driftline.llm.mixture import mix, reached
from driftline.llm.rankwalk import rank_walk
from driftline.llm.setjoin import classes, expand, links_per_record, similar_sets
from driftline.llm.topn import highest_per_item, top_n_per_group
from driftline.llm.truncation import cut_probability, source_rates
from driftline.runtime import cut, lookup_salted, table, tidy_path


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten best statements and five best files of every pair."""
    statements = highest_per_item(table(spark, d, "target_statements"), ["pair_index", "path", "line"], "score")
    files = highest_per_item(table(spark, d, "target_files"), ["pair_index", "path"], "confidence")
    best = top_n_per_group(statements, ["pair_index"], [("score", "desc"), ("path", "asc"), ("line", "asc")], 10)
    places = top_n_per_group(files, ["pair_index"], [("confidence", "desc"), ("path", "asc")], 5)
    return best.select(F.lit("statements").alias("list_name"), "pair_index", "path", "line").unionByName(
        places.select(F.lit("files").alias("list_name"), "pair_index", "path", F.lit(0).alias("line"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Headings, list items, code blocks and formulas of marked-up bodies, and marked-up titles, as clean text."""
    return marked_elements(table(spark, d, "sides"), "side_id", "title", "body")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every side's body as clean text."""
    return clean_documents(table(spark, d, "sides").select("side_id", "body").distinct(), "body").select("side_id", "clean_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every case with the smallest case of its linked group."""
    cases = table(spark, d, "practical_localization_results_14")
    return linked_records(cases, "case_id", ("source_url", "target_url"), "group_case_id")


def p3_star_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same groups, with the core always solved by the rounds that a core of any size takes."""
    cases = table(spark, d, "practical_localization_results_14")
    return linked_records(cases, "case_id", ("source_url", "target_url"), "group_case_id", core_limit=0)


SIMILAR = 0.6


def _side_sets(spark: SparkSession, d: str) -> DataFrame:
    sides = table(spark, d, "sides").select("side_id", F.transform("file_names", tidy_path).alias("file_names"))
    return classes(sides, "side_id", "file_names", 3)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of sides whose file sets overlap by 0.6 or more."""
    member = _side_sets(spark, d)
    return expand(member, similar_sets(member, SIMILAR)).select(F.col("id_a").alias("side_id_a"), F.col("id_b").alias("side_id_b"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Every side of at least three names with its class of equal sets and its number of similar sides."""
    member = _side_sets(spark, d)
    return links_per_record(member, similar_sets(member, SIMILAR)).select(F.col("id").alias("side_id"), F.col("rep").alias("class_side_id"), "links")


def _machine_files(spark: SparkSession, d: str) -> DataFrame:
    sides = table(spark, d, "sides").select("side_id", F.coalesce(F.concat(F.col("pair_index").cast("string"), F.lit("\t"), "role"), F.concat(F.lit("side\t"), "side_id")).alias("owner"), "file_names").dropDuplicates(["side_id"])
    shown = table(spark, d, "patch_statements").select(F.concat(F.col("pair_index").cast("string"), F.lit("\t"), "side").alias("owner"), "path", "text").filter("owner is not null")
    files = sides.select("owner", F.explode("file_names").alias("path")).unionByName(shown.select("owner", "path").distinct())
    # Lines are summed up per file before a pair's many lines meet its side; the found files are kept, as the lookup reads them twice.
    return lookup_salted(cut(machine_files(files, shown, ["owner"], "path", "text")), sides.select("owner", "side_id"), "owner", "inner").select("side_id", "path", "reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files of sides that are generated, minified, vendored or data stored as code."""
    return _machine_files(spark, d).select("side_id", "path")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many files of sides are no hand-written source, by reason."""
    return _machine_files(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


SCORES = ["line_similarity", "symbol_score", "llm_confidence", "patch_score"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The five statements of a pair (of twenty or more) that its four scores together support best."""
    value = lambda c: F.max(F.when(~F.isnan(c), F.col(c))).alias(c)
    statements = table(spark, d, "target_statements").groupBy("pair_index", "path", "line").agg(*[value(c) for c in SCORES[:3]])
    files = table(spark, d, "file_pair_records").groupBy("pair_index", F.col("target_file").alias("path")).agg(value("patch_score"))
    # Both are cut: the walk counts its groups first, and the sort of the top five samples what it sorts.
    scored = cut(statements.join(files, ["pair_index", "path"], "left"))
    ranked = cut(rank_walk(scored, "pair_index", ["path", "line"], SCORES, min_items=20).select("pair_index", "path", "line", "walk_weight"))
    return top_n_per_group(ranked, ["pair_index"], [("walk_weight", "desc"), ("path", "asc"), ("line", "asc")], 5).select("pair_index", "path", "line")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document's token ids by byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, tokens, and documents whose decoded ids are not their text (none)."""
    t = tokenizer()
    coded = cut(encode_corpus(table(spark, d, "documents").select("doc_id", "source", "text"), "text"))
    both = coded.join(t.decode(coded, "doc_id", "ids"), "doc_id")
    changed = F.col("bytes") != F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.count_if(changed).alias("changed"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of documents to source_targets' shares: how often each document is used for a source."""
    docs = encode_corpus(table(spark, d, "documents").select("doc_id", "source", "text"), "text")
    docs = cut(docs.select("doc_id", "source", "text", F.size("ids").alias("tokens")))
    return mix(docs, table(spark, d, "source_targets"), "doc_id", "text", "source", "tokens")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every listed source."""
    return reached(p8_mixture(spark, d), table(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text ends before its content does."""
    judged = cut_probability(table(spark, d, "documents"), "doc_id", "text", "source")
    return judged.filter("probability >= 0.5").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    return source_rates(cut_probability(table(spark, d, "documents"), "doc_id", "text", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
