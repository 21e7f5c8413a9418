"""Columns derived from file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import jaccard, strip

# Extensions of code for clone search and for semantic search.
CLONE_EXTENSIONS = ["go", "sol", "c", "cc", "cpp", "h", "hpp", "rs", "py", "js", "ts", "java", "kt", "scala", "sh", "proto"]
SEMANTIC_EXTENSIONS = ["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "go", "java", "js", "jsx", "ts", "tsx", "py", "rs", "sol", "scala", "kt", "kts", "cs", "rb", "php", "swift", "sh", "bash", "proto", "toml", "yaml", "yml", "json"]
SEMANTIC_NAMES = ["go.mod", "go.sum", "cargo.toml", "cargo.lock", "makefile", "dockerfile"]


def tidy(c: Column) -> Column:
    """Without surrounding white space and leading ``./``."""
    return F.regexp_replace(strip(c), r"^(?:\./+)+", "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, r"/?[^/]*$", "")


def extension(c: Column) -> Column:
    """What follows the last dot of the name, '' without one (case kept)."""
    return F.regexp_extract(basename(c), r"\.([^.]*)$", 1)


def path_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[/_.\-\s]+"), lambda p: p != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(path_tokens(a), path_tokens(b), 1.0)


def stem(c: Column) -> Column:
    """Lower-case name without its last extension and a test ending."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(basename(c)), r"\.[^.]*$", ""), r"_test$", ""), r"-test$", "")


def norm_path(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[_\-/]", "")


def is_clone_code(c: Column) -> Column:
    return F.lower(extension(c)).isin(CLONE_EXTENSIONS) & ~c.startswith(".github/") & ~c.startswith(".gitea/")


def is_semantic_code(c: Column) -> Column:
    return F.lower(extension(c)).isin(SEMANTIC_EXTENSIONS) | F.lower(basename(c)).isin(SEMANTIC_NAMES)


def is_plain_go(c: Column) -> Column:
    """Go source that is neither a test nor made by a tool, by its name."""
    return c.endswith(".go") & ~c.endswith("_test.go") & ~c.endswith(".pb.go") & ~c.endswith("_generated.go")


_OUTPUT = r"\.(?:snap|golden|out|rlp|hex)$"


def is_test_or_data(c: Column) -> Column:
    return F.lower(c).rlike(r"_test\.|/test/|/tests/|/testdata/|/fixture|" + _OUTPUT)


def auxiliary_type(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(basename(low) == "go.sum", "dependency_lock")
        .when(low.rlike(r"\.(?:md|rst|adoc)$|/doc/|/docs/"), "documentation")
        .when(low.rlike(r"/testdata/|/fixture|" + _OUTPUT), "snapshot_or_test_output")
        .otherwise("comment_or_other_auxiliary")
    )


def repo_of(project: Column) -> Column:
    """owner/name of a project id 'owner_name'."""
    return F.regexp_replace(project, r"^([^_]*)_", "$1/")


def node_id(*parts: Column) -> Column:
    """Parts joined by '::', which is replaced inside a part."""
    return F.concat_ws("::", *[F.regexp_replace(p, "::", "__") for p in parts])
