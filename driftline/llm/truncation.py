"""Texts cut off by a limit of their source or during transfer.

Two independent kinds of evidence are combined.

Length: per source, and for lengths in characters and in UTF-8 bytes, a
log-normal distribution is fitted by maximum likelihood to lengths that are
right-censored at candidate limits: a frequent length that next to nothing
exceeds, or one that far more texts have than the lengths around it (a source
may have had several limits). The count that is expected at the limit against the count that is
there gives the posterior that a value at the limit was censored.

Ending: unclosed code block, end of a sentence, a mark of a cut, or else what
the corpus knows of the last word: how often it (after the one before it) ends
a line, whether it occurs anywhere else, and whether it is the beginning of a
longer word that usually stands there; and whether the last line is prose,
which ends with a sentence, or a title, list item or code. How probable each
kind of ending is for cut and for complete texts is estimated by expectation
maximisation over the counts of (censoring posterior, kind of ending).

Both meet at every value: the censoring posterior of its own limit, corrected by
the endings of all texts at that limit, is the prior of the value, its ending
the evidence. Texts at no limit share one prior, that of cuts in transfer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.runtime import blank, col, cut, lookup_salted, spread

#: Bytes or characters by which a cut value may miss its limit (a split character, its replacement).
SLACK = 3
#: All white space that Unicode knows.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Beginnings of words are written out up to so many characters.
BLOCK = 40
#: Kinds of ending and what is assumed of them (complete, cut), in texts, before the corpus is counted.
KINDS = {
    "sentence": (60.0, 0.3), "closed": (6.0, 0.05), "open": (0.02, 8.0), "mark": (0.6, 6.0), "note": (0.1, 6.0),
    "prose half": (0.02, 40.0), "prose unseen": (0.02, 15.0), "prose never": (0.05, 30.0), "prose rare": (0.1, 6.0), "prose some": (0.5, 5.0), "prose often": (2.0, 2.0), "prose mostly": (16.0, 1.0),
    "line half": (0.1, 8.0), "line unseen": (0.2, 6.0), "line never": (2.0, 6.0), "line rare": (3.0, 3.0), "line some": (6.0, 3.0), "line often": (8.0, 2.0), "line mostly": (16.0, 1.0),
}
#: Endings that a complete text all but never has: their share of complete texts is assumed, not estimated, or
#: rare cuts far from any limit would pass for a habit of complete texts.
UNFINISHED = dict.fromkeys(("open", "prose half", "prose unseen", "prose never", "prose rare"), 2e-4)
#: A last line that begins like a sentence.
PROSE = r"(?U)^\s*[\p{Lu}\p{IsHan}](?!\S*:)"
#: A mark in words, which no ellipsis is.
_NOTE = r"[\[(<]\s*(?:truncated|cut|snip|more)\s*[\])>]$"
_MARK = r"(?:…|\.{3,}|\[\s*(?:…|\.\.\.|truncated|cut|snip|more)\s*\]|\(\s*(?:…|\.\.\.|truncated|cut|snip|more)\s*\)|<\s*(?:truncated|cut|snip)\s*>)$"


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: float | list[float]) -> tuple[float, float]:
    """(mean, deviation) of log length by maximum likelihood (EM): values at a limit, or beyond the last, are censored there."""
    limits = np.sort(np.atleast_1d(np.asarray(limits, float)))
    x, w = np.log(np.maximum(lengths, 1)), counts.astype(float)
    held = np.isin(lengths, limits) | (lengths >= limits[-1])
    free = ~held
    if not free.any():
        return math.log(limits[-1]), 1.0
    c = np.log(np.minimum(np.maximum(lengths[held], 1), limits[-1]))
    hw = w[held]
    mu, sd = np.average(x[free], weights=w[free]), max(0.3, float(np.sqrt(np.cov(x[free], aweights=w[free], ddof=0))) if free.sum() > 1 else 0.3)
    n, s1, s2 = w[free].sum(), (w * x)[free].sum(), (w * x * x)[free].sum()
    for _ in range(60):
        z = (c - mu) / sd
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum([0.5 * math.erfc(v / math.sqrt(2)) for v in z], 1e-12)
        m1 = hw @ (mu + sd * hazard)
        m2 = hw @ (mu * mu + sd * sd + sd * hazard * (c + mu))
        new_mu = (s1 + m1) / (n + hw.sum())
        new_sd = math.sqrt(max((s2 + m2) / (n + hw.sum()) - new_mu**2, 0.01))
        if abs(new_mu - mu) + abs(new_sd - sd) < 1e-7:
            break
        mu, sd = new_mu, new_sd
    return mu, sd


#: Least length of a limit, and of texts at it; most chance that a limit with texts beyond is none, over all lengths of a source.
LEAST, TEXTS, CHANCE = 50, 3, 1e-4


def _beyond_chance(seen: float, expected: float) -> float:
    """A bound of the Poisson probability of ``seen`` or more."""
    if seen <= expected:
        return 1.0
    return min(1.0, math.exp(seen * math.log(expected) - expected - math.lgamma(seen + 1)) / (1 - expected / (seen + 1)))


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """All limits of one (source, unit), from its histogram of lengths (``n`` rows, ``d`` different texts)."""
    pdf = pdf.sort_values("len")
    lengths, counts, texts = (pdf[c].to_numpy() for c in ("len", "n", "d"))
    total = counts.sum()
    over = total - np.cumsum(counts)
    density = lambda at, mu, sd: math.exp(-(((math.log(at) - mu) / sd) ** 2) / 2) / (at * sd * math.sqrt(2 * math.pi))
    found: dict[int, float] = {}
    for i in np.flatnonzero((counts >= TEXTS) & (lengths >= LEAST))[::-1]:
        at = float(lengths[i])
        near = (lengths > at) & (lengths <= at + SLACK)
        if over[i] - counts[near].sum() <= 0.1 * counts[i]:
            posterior = max(0.0, 1 - total * density(at, *fit_censored(lengths, counts, at)) / counts[i])
            if posterior >= 0.5:
                found[i] = posterior
    if len(found) > 1:  # besides the most frequent one, copies of one text make no limit
        first = max(found, key=lambda i: counts[i])
        found = {i: p for i, p in found.items() if i == first or texts[i] >= TEXTS}
    # Limits that texts of other times or kinds exceed: different texts of one length, against the lengths around it.
    inner = [i for i in np.flatnonzero((texts >= 5) & (lengths >= LEAST)) if i not in found]
    if inner:
        mu, sd = fit_censored(lengths, counts, [float(lengths[i]) for i in (*found, *inner)])
        for i in inner:
            at = float(lengths[i])
            around = (np.abs(lengths - at) <= 0.15 * at) & (np.abs(lengths - at) > SLACK)
            local = texts[around].sum() / max(0.3 * at - 2 * SLACK, 1)
            expected = max(texts.sum() * density(at, mu, sd), local, 0.02)
            if 1 - expected / texts[i] >= 0.5 and len(lengths) * _beyond_chance(float(texts[i]), expected) < CHANCE:
                found[i] = 1 - expected / texts[i]
    out = [(pdf["source"].iloc[0], pdf["unit"].iloc[0], int(lengths[i]), p, int(counts[i])) for i, p in found.items()]
    return pd.DataFrame(out, columns=["source", "unit", "limit", "posterior", "at"])


def limits(docs: DataFrame) -> DataFrame:
    """(source, unit, limit, posterior, at) of docs(source, chars, bytes, h: a hash of the text); grouped work is on histograms of lengths."""
    texts = docs.filter(F.col("source").isNotNull()).groupBy("source", "chars", "bytes", "h").agg(F.count(F.lit(1)).alias("n"))
    hist = texts.select("source", "n", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "len")).groupBy("source", "unit", "len").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")
    )
    return hist.groupBy("source", "unit").applyInPandas(_limits, "source string, unit string, limit bigint, posterior double, at bigint")


def _of_length(unit: str, length: Column, source: Column) -> Column:
    return F.concat(F.lit(unit), length.cast("string"), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)))


def _near(found: DataFrame, unit: str) -> DataFrame:
    """(key, lid, posterior): the likeliest limit next to a length of a source; a null source has all limits, as it has no own."""
    each = found.filter(F.col("unit") == unit).select("lid", "posterior", F.explode(F.array("source", F.lit(None).cast("string"))).alias("source"), F.explode(F.sequence(F.col("limit") - SLACK, F.col("limit") + SLACK)).alias("len"))
    return each.groupBy(_of_length(unit, F.col("len"), F.col("source")).alias(f"{unit}_key")).agg(F.max(F.struct("posterior", "lid")).alias(f"{unit}_limit"))


def _plain(text: Column) -> Column:
    """Numbers, hashes, names with inner capitals or underscores and paths as one sign each."""
    for pattern, sign in (
        (r"https?://\S+", "URL"), (r"\b(?:0x)?(?=[0-9a-f]{6,}+\b)(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]++", "HEX"), (r"\d++", "0"),
        (r"\b(?:[A-Za-z]++(?:_[A-Za-z]++)+|[A-Za-z][a-z]++(?:[A-Z][a-z]++)+)\b", "ID"), (r"\b[A-Za-z_]++(?:/[A-Za-z_]++)+\b", "PATH"),
    ):
        text = F.regexp_replace(text, pattern, sign)
    return text


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")


def _key(before: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(before, F.lit("\x01"), word))


def _pairs(lines: Column) -> Column:
    """Every word with the word before it on its line, whether it ends the line, and whether it ends the text."""
    last = F.size(lines) - 1

    def of(line: Column, i: Column) -> Column:
        def pairs(ws: Column) -> Column:
            n = F.size(ws)
            return F.transform(F.slice(ws, F.lit(2), n - 1), lambda w, j: F.struct(F.get(ws, j).alias("p"), w.alias("w"), (j == n - 2).cast("int").alias("e"), ((j == n - 2) & (i == last)).cast("int").alias("f")))

        # The words are bound to a variable: an expression used within a lambda is evaluated at every use.
        return F.get(F.transform(F.array(F.concat(F.array(F.lit("")), _words(line))), pairs), 0)

    return F.flatten(F.transform(lines, of))


def fit_mixture(counts: dict[tuple[str, str], int], start: dict[str, float], stops: dict[str, float], rounds: int = 30) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(P(kind | complete), P(kind | cut), share of cut texts by place) by EM; ``start`` has the places' first shares.

    ``stops``: kinds that a cut meets by chance alone, with that chance (their places per character of the
    corpus); they are not estimated, or complete texts of just the limit's length would pass for cut ones.
    """
    kinds = list(KINDS)
    full, half = (np.array([KINDS[k][i] for k in kinds]) for i in (0, 1))
    table = {p: np.array([counts.get((p, k), 0) for k in kinds], float) for p in start}
    theta, share = [full / full.sum(), half / half.sum()], dict(start)
    for _ in range(rounds):
        gone = {p: share[p] * theta[1] / (share[p] * theta[1] + (1 - share[p]) * theta[0]) for p in table}
        # The assumptions above stay as pseudo-counts, so a small corpus can't turn the kinds around.
        theta = [full + sum(table[p] * (1 - gone[p]) for p in table), half + sum(table[p] * gone[p] for p in table)]
        theta = [t / t.sum() for t in theta]
        for which, fixed in ((0, UNFINISHED), (1, stops)):
            for k, chance in fixed.items():
                theta[which][kinds.index(k)] = chance
        share = {p: ((table[p] * gone[p]).sum() + STRENGTH * start[p]) / (table[p].sum() + STRENGTH) for p in table}
    return theta[0], theta[1], share


#: So many texts the length's posterior counts for, against the endings of the texts at a limit.
STRENGTH = 8.0
#: Share of cut texts at no limit, to begin with; and of the posterior that is kept, as a limit's length may be a text's own.
OFF, TRUST = 0.02, 0.9


def _share_at(ends: Column, posterior: Column) -> Column:
    """The share of cut texts at one limit, from its array of (n, complete, cut): number and probabilities of each kind of ending."""
    def step(p: Column, _: Column) -> Column:
        gone = F.aggregate(ends, F.lit(0.0), lambda s, e: s + e["n"] * p * e["cut"] / (p * e["cut"] + (1 - p) * e["complete"]))
        return (gone + STRENGTH * posterior) / (F.aggregate(ends, F.lit(0.0), lambda s, e: s + e["n"]) + STRENGTH)

    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), posterior, step)


def cut_probability(df: DataFrame, record: str, text: str, source: str) -> DataFrame:
    """(record, source, at_limit, ending, probability) of every row whose text is not blank.

    Null, empty and blank texts are not judged and give no row. Rows of a null
    source are held against the limits of all sources, as they have no own. Repeated rows are
    judged alike, each by itself; texts of any length are read whole; extra columns are ignored; an empty input
    gives an empty result.
    """
    body = F.rtrim(F.rtrim(col(text), F.lit("�")), F.lit(WHITE))
    docs = spread(df).filter(~blank(col(text))).select(
        col(record).alias("r"), col(source).alias("source"), body.alias("t"), F.xxhash64(col(text)).alias("h"),
        F.length(col(text)).cast("bigint").alias("chars"), F.octet_length(col(text)).cast("bigint").alias("bytes"),
    )
    # What stands at the end is looked for there alone; a mark, or the quotes behind a sentence, are shorter than this.
    end = F.right("t", F.lit(200))
    marked = end.rlike(_MARK)
    fences = F.size(F.regexp_extract_all("t", F.lit(r"(?m)^[ \t]*(```+|~~~+)"), F.lit(0)))
    ends = end.rlike("[.。!?！？][\"'”’)\\]]*$")
    kind = F.when(fences % 2 == 1, "open").when(marked, "marked").when(ends, "sentence").when(F.substring_index("t", "\n", -1).rlike(r"^\s*(```|~~~)"), "closed")
    counted = lambda sign: (F.length("t") - F.length(F.replace("t", F.lit(sign), F.lit("")))) / len(sign)
    stops = sum((counted(m + w) for m in ".!?" for w in " \n"), ends.cast("int") + F.length("t") - F.length(F.translate("t", "。！？", ""))).cast("int")
    # All that is read of a text, once.
    docs = cut(docs.select("r", "source", "h", "chars", "bytes", kind.alias("kind"), fences.alias("fences"), stops.alias("stops"), end.rlike(_NOTE).alias("note"), _plain(F.col("t")).alias("plain")))
    found = cut(limits(docs).withColumn("lid", F.monotonically_increasing_id()))
    lines = docs.select(F.split("plain", "\n").alias("lines"))
    # What the last line looks like; of a marked text, without the mark.
    tail = F.substring_index(F.when(F.col("kind") == "marked", F.regexp_replace(F.regexp_replace("plain", _MARK, ""), r"(?U)\s+$", "")).otherwise(F.col("plain")), "\n", -1)
    open_end = F.col("kind").isNull() | (F.col("kind") == "marked")
    docs = docs.withColumn("prose", tail.rlike(PROSE)).withColumn("last", F.when(open_end, F.concat(F.array(F.lit(""), F.lit("")), _words(tail))))
    docs = docs.select("r", "source", "chars", "bytes", "kind", "fences", "stops", "note", "prose", F.element_at("last", -2).alias("p"), F.element_at("last", -1).alias("w")).withColumn("key", _key(F.col("p"), F.col("w")))
    # Words of the corpus by the word before: how often, at line ends, and other than at the end of a text.
    words = lines.select(F.explode(_pairs(F.col("lines"))).alias("k")).select("k.*")
    words = cut(words.groupBy("p", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"), F.sum("f").alias("f")))
    # n0 and e0: elsewhere than at ends of texts
    words = words.select("p", "w", (F.col("n") - F.col("f")).alias("n0"), (F.col("e") - F.col("f")).alias("e0"), "n", "e")
    wanted = cut(docs.filter("key is not null").select("key", "p", "w").distinct())
    single = words.groupBy("w").agg(*[F.sum(c).alias(f"u_{c}") for c in ("n0", "e0", "n", "e")])
    # Longer words at the same place: every pair's proper beginnings, among those that end some text.
    begins = lambda n: _key(F.col("p"), F.substring(F.col("w"), F.lit(1), n))
    starts = words.filter("n0 > 0 and length(w) > 1").select("n0", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("w") - 1, F.lit(BLOCK))), begins)).alias("key"))
    short = starts.join(wanted.filter(F.length("w") <= BLOCK).select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("n0").alias("longer"))
    # Of longer ones not every beginning is written out: they meet by their first BLOCK, 2 * BLOCK, 4 * BLOCK ... characters.
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.log2(n / BLOCK)).cast("int")), lambda i: (BLOCK * F.pow(F.lit(2), i)).cast("int"))
    long_words = words.filter((F.col("n0") > 0) & (F.length("w") > BLOCK + 1)).select("n0", F.col("w").alias("whole"), F.explode(F.transform(blocks(F.length("w") - 1), begins)).alias("block"))
    long_wanted = wanted.filter(F.length("w") > BLOCK).select("key", "w", begins(F.element_at(blocks(F.length("w")), -1)).alias("block"))
    longer = long_words.join(long_wanted, "block").filter(F.col("whole").startswith(F.col("w")) & (F.col("whole") != F.col("w"))).groupBy("key").agg(F.sum("n0").alias("longer"))
    longer = short.unionByName(longer)
    paired = words.withColumn("key", _key(F.col("p"), F.col("w"))).join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(*[F.sum(c).alias(f"b_{c}") for c in ("n0", "e0", "n", "e")])
    known = cut(wanted.join(single, "w", "left").join(paired, "key", "left").join(longer, "key", "left").na.fill(0))
    docs = lookup_salted(docs.drop("p", "w"), known.drop("p", "w"), "key")
    # A text must not speak for itself: its own last word is taken out of the counts (a marked one has its mark in them).
    own = F.when((F.col("kind") == "marked"), 0).otherwise(1)
    less = lambda c: F.greatest(F.col(c) - own, F.lit(0))
    # Ends of texts count for the word where it also ends lines within texts or ends many texts of one line.
    rate = (less("b_e") + 2 * (less("u_e") + 0.25) / (less("u_n") + 1)) / (less("b_n") + 2)
    half = (F.col("longer") >= 3 * (F.col("b_n0") + 1)) & (F.col("longer") > F.col("u_e0"))
    word = F.when(half, "half").when(less("u_n") == 0, "unseen").when(rate < 0.02, "never").when(rate < 0.08, "rare").when(rate < 0.3, "some").when(rate < 0.6, "often").otherwise("mostly")
    ending = F.when(F.col("kind") == "marked", F.when(F.col("note"), "note").otherwise("mark")).otherwise(F.coalesce("kind", F.concat(F.when(F.col("prose"), "prose ").otherwise("line "), word)))
    judged = docs.select("r", "source", ending.alias("ending"), "chars", "stops", "fences", *[_of_length(u, F.col(u), F.col("source")).alias(f"{u}_key") for u in ("chars", "bytes")])
    for unit in ("chars", "bytes"):
        judged = judged.join(_near(found, unit), f"{unit}_key", "left")
    judged = judged.withColumn("limit", F.greatest("chars_limit", "bytes_limit")).withColumn("place", F.coalesce(F.floor(F.col("limit.posterior") * 10).cast("string"), F.lit("off")))
    judged = cut(judged.select("r", "source", "ending", "place", F.col("limit.lid").alias("lid"), "chars", "stops", "fences"))
    counts = {(x["place"], x["ending"]): x["n"] for x in judged.groupBy("place", "ending").agg(F.count(F.lit(1)).alias("n")).collect()}
    length, sentences, fenced = judged.agg(F.sum("chars"), F.sum("stops"), F.sum("fences")).first()
    chance = lambda n: min(0.05, max(1e-4, (n or 0) / max(length or 0, 1)))
    start = {p: OFF if p == "off" else TRUST * min(1.0, (int(p) + 0.5) / 10) for p in {"off", *(p for p, _ in counts)}}
    complete, gone, share = fit_mixture(counts, start, {"sentence": chance(sentences), "closed": chance(fenced)})
    of_kind = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in zip(KINDS, values, strict=True) for x in (k, float(v))]), F.col("ending"))
    per = judged.filter("lid is not null").groupBy("lid", "ending").agg(F.count(F.lit(1)).cast("double").alias("n")).select("lid", F.struct("n", of_kind(complete).alias("complete"), of_kind(gone).alias("cut")).alias("e"))
    shares = per.groupBy("lid").agg(F.collect_list("e").alias("ends")).join(found.select("lid", (TRUST * F.col("posterior")).alias("posterior")), "lid").select("lid", _share_at(F.col("ends"), F.col("posterior")).alias("share"))
    p, a, b = F.coalesce("share", F.lit(float(share["off"]))), of_kind(complete), of_kind(gone)
    return lookup_salted(judged, shares, "lid").select(
        F.col("r").alias(record), F.col("source").alias("source"), F.col("lid").isNotNull().alias("at_limit"), "ending", (p * b / (p * b + (1 - p) * a)).alias("probability")
    )


def source_rates(judged: DataFrame) -> DataFrame:
    """(source, texts, at_limit, truncated, rate): how often each source cuts; null is a source of its own."""
    hit = F.col("probability") >= 0.5
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("at_limit").alias("at_limit"), F.count_if(hit).alias("truncated"), (F.count_if(hit) / F.count(F.lit(1))).alias("rate")
    )
