"""Token sets, set similarities and line predicates as column expressions (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and word patterns of the scoring functions.
TOKEN_ALL = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]"
TOKEN_WORD = r"[A-Za-z_][A-Za-z0-9_]*|\d+"
WORD = r"[A-Za-z_][A-Za-z0-9_]{2,}|\d+"
# Words that message similarity leaves out.
STOP_WORDS = ["the", "and", "for", "from", "with", "this", "that", "geth", "bsc", "bor"]
# Lines that are no statements.
TRIVIAL = ["{", "}", "},", ");"]
TRIVIAL_MORE = ["{", "}", "},", ")", "nil", "true", "false"]

# Possessive, as Java walks any other repeated group by recursion: a quotation of some thousand characters would overflow its stack.
_LITERAL = r"\"(?:\\.|[^\"\\])*+\"|`[^`]*`|\b\d+\b"


def first_truthy(*cols: Column) -> Column:
    """The first value that is neither null nor empty; '' counts as missing, null if all are."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (SQL trim knows blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_lines(c: Column) -> Column:
    """The lines of a text, at all the line ends Unicode knows; no line follows a final line end, null and empty have none."""
    pieces = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n")
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def clip(c: Column, limit: int) -> Column:
    """White space squeezed, cut to ``limit`` characters."""
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, limit)


def tokens(c: Column, pattern: str, least: int = 1) -> Column:
    """Distinct lower-case matches of a token pattern, of at least ``least`` characters."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), lambda t: F.lower(t))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found)


def message_words(c: Column) -> Column:
    return F.array_except(tokens(c, WORD), F.array(*[F.lit(w) for w in STOP_WORDS]))


def clone_tokens(c: Column) -> Column:
    """Tokens with string and number literals replaced by LIT."""
    return tokens(F.regexp_replace(c, _LITERAL, " LIT "), TOKEN_WORD, 2)


def normalize_code(c: Column) -> Column:
    """Code without comments, literals as LIT, then names (LIT too) as ID; everything after a first // goes."""
    bare = F.regexp_replace(c, r"(?s)//.*|/\*.*?\*/", " ")
    named = F.regexp_replace(F.regexp_replace(bare, _LITERAL, " LIT "), r"\b[A-Za-z_][A-Za-z0-9_]*\b", " ID ")
    return strip(F.regexp_replace(named, r"\s+", " "))


def split_identifier(c: Column) -> Column:
    """Lower-case parts of a camel-case or underscored name."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")), r"[_\W]+"), lambda p: p != "")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct values; two empty ones give ``both_empty``."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float(both_empty))).otherwise(overlap(a, b) / union)


def dice_jaccard(a: Column, b: Column) -> Column:
    """0.60 Dice + 0.40 Jaccard; 0 if either set is empty."""
    common, na, nb = overlap(a, b), F.size(a), F.size(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(0.60 * (2.0 * common / (na + nb)) + 0.40 * (common / (na + nb - common)))


def dice_jaccard_of(common: Column, na: Column, nb: Column) -> Column:
    """The same from the sizes of the intersection and the two sets."""
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(0.60 * (2.0 * common / (na + nb)) + 0.40 * (common / (na + nb - common)))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two MAP<STRING, INT> histograms; 0 if both are empty."""
    merged = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("hi"))))
    low = F.aggregate(merged, F.lit(0), lambda s, x: s + x["lo"])
    high = F.aggregate(merged, F.lit(0), lambda s, x: s + x["hi"])
    return F.when(high == 0, F.lit(0.0)).otherwise(low / high)


def statement_shapes(texts: Column) -> Column:
    """The distinct statements of an ARRAY<STRING> as word tokens joined by blanks, those of eight characters or more."""
    joined = F.transform(texts, lambda t: F.array_join(F.regexp_extract_all(t, F.lit(TOKEN_WORD), F.lit(0)), " "))
    return F.array_distinct(F.filter(joined, lambda t: F.length(t) >= 8))


def _says_nothing(c: Column) -> Column:
    return c.isNull() | (c == "") | c.isin(TRIVIAL) | c.startswith("//") | c.startswith("*")


def meaningful(c: Column, least: int = 3, pattern: str = TOKEN_ALL) -> Column:
    """A stripped line that is no brace, no comment and has at least ``least`` tokens."""
    return ~_says_nothing(c) & (F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))) >= least)


# Beginnings of lines that only frame code.
BOILERPLATE = ["package ", "import ", "//", "/*", "*"]


def boilerplate(c: Column) -> Column:
    s = strip(c)
    return s.isin(TRIVIAL_MORE) | reduce(lambda x, y: x | y, [s.startswith(p) for p in BOILERPLATE])


# Keywords of patch patterns, in order of precedence, and of their lines.
PATCH_PATTERNS = [
    ("bounds_or_limit", ["limit", "max", "cap", "bound", "too many", "percentile"]),
    ("concurrency", ["lock", "unlock", "mutex", "atomic", "race", "deadlock", "channel", "close"]),
    ("error_handling", ["err", "error", "return nil", "panic", "recover"]),
    ("storage_cache", ["cache", "freezer", "database", "sync", "flush"]),
    ("test_change", ["test", "assert", "require.", "t."]),
]
LINE_WORDS = {
    "bounds_or_limit": ["limit", "max", "cap", "bound", "len", "percentile", "range"],
    "concurrency": ["lock", "unlock", "mutex", "atomic", "chan", "close", "wait", "done"],
    "error_handling": ["err", "error", "return", "panic", "recover"],
    "storage_cache": ["cache", "freezer", "database", "sync", "flush", "write", "read"],
    "test_change": ["test", "assert", "require", "expected", "want"],
}


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [c.contains(w) for w in words])


def patch_pattern(c: Column) -> Column:
    """The first pattern one of whose words stands anywhere in the text, else 'generic'."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("generic")
    for name, words in reversed(PATCH_PATTERNS):
        out = F.when(contains_any(low, words), F.lit(name)).otherwise(out)
    return out


def pattern_score(pattern: Column, c: Column) -> Column:
    """min(1, hits / 3) of the pattern's words in the text; 0.2 for a pattern without words."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(0.2)
    for name, words in LINE_WORDS.items():
        hits = reduce(lambda x, y: x + y, [low.contains(w).cast("int") for w in words])
        out = F.when(pattern == name, F.least(F.lit(1.0), hits / 3)).otherwise(out)
    return out


# Change types by the first of these patterns that a text contains, and their labels.
CHANGE_TYPES = [
    ("bug_fix", r"\bcve-\d{4}-\d+|security|vulnerab|dos|ddos|panic|crash|deadlock|race|overflow|invalid|error|bug|fix|regression|flaky"),
    ("upstream_sync", r"\bupstream|merge tag|geth-v|sync geth|merge geth|cherry[- ]pick"),
    ("dependency_security", r"\bgo\.mod|go\.sum|bump|upgrade|dependency|dependencies|update .*version|crypto to solve"),
    ("refactor", r"\brefactor|cleanup|clean up|rename|restructure|rework|simplify"),
    ("test_doc", r"\btest|doc|readme|comment|example|fixture"),
    ("new_feature", r"\badd|implement|support|introduce|enable|new |allow|expose"),
]


def change_type(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("maintenance")
    for name, pattern in reversed(CHANGE_TYPES):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


# Bonuses for words of a candidate line.
KIND_WORDS = {"if": 0.08, "return": 0.07, "for": 0.05, "switch": 0.05, "case": 0.04, "delete": 0.04, "append": 0.04, "panic": 0.04, "error": 0.04}


def line_kind_score(line: Column, examples: Column) -> Column:
    """Word bonuses of a line, two more if the ARRAY<STRING> of source examples speaks alike; at most 0.25."""
    s = strip(line)
    low = F.lower(s)
    score = reduce(lambda x, y: x + y, [F.when(low.contains(w), F.lit(v)).otherwise(0.0) for w, v in KIND_WORDS.items()])
    fails = F.exists(examples, lambda e: F.lower(e).contains("return") | F.lower(e).contains("error")) & (low.contains("return") | low.contains("error"))
    asks = F.exists(examples, lambda e: F.lower(e).contains("if ") | strip(e).startswith("if")) & s.startswith("if")
    both = F.coalesce(fails, F.lit(False)).cast("int") + F.coalesce(asks, F.lit(False)).cast("int")
    return F.when(s == "", F.lit(0.0)).otherwise(F.least(score + 0.08 * both, F.lit(0.25)))


def proximity_score(line: Column, seeds: Column) -> Column:
    """By distance to the nearest of an ARRAY of seed lines: 0 1.0, to 2 0.75, to 5 0.45, to 10 0.25, else 0."""
    near = F.array_min(F.transform(seeds, lambda s: F.abs(s - line)))
    return F.when(near == 0, 1.0).when(near <= 2, 0.75).when(near <= 5, 0.45).when(near <= 10, 0.25).otherwise(0.0)


def evidence_gate(similarity: Column, proximity: Column, modules: Column, block: Column) -> Column:
    return (similarity >= 0.18) | (proximity >= 0.75) | ((similarity >= 0.10) & (proximity >= 0.45)) | ((modules >= 3) & (block >= 0.9) & (proximity >= 0.25))


def clamp01(c: Column, default: float) -> Column:
    """A text as a number within [0, 1], ``default`` if it is none."""
    x = c.try_cast("double")
    return F.when(x.isNull(), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def valid_ids(ids: Column, upper: Column | int) -> Column:
    """Of an ARRAY<STRING>, the integers in [0, upper), each once, in order."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x >= 0) & (x < upper)))


def json_object(c: Column, schema: str) -> Column:
    """The JSON object within a reply (fenced or embedded), parsed by ``schema``; null if there is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})
