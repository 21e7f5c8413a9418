"""Groups of records that are linked directly or through others.

The graph is contracted to a fixed point before it is solved. Every round reads
one table of degrees and

1. strips vertices with one neighbour, and
2. compresses maximal runs of vertices with two neighbours. The ends of a run
   are found by list ranking: every arc into such a vertex points to the arc
   that leaves it, and pointers are doubled until they reach a vertex of
   another degree. A run between two vertices of the core becomes one edge;
   one that hangs on the core or stands alone goes together with its leaf.

A removed vertex points to a vertex that outlives the round. Arcs are joined by
both their ends and edges are dropped by both their ends, so that a hub which
holds a third of all edges is never the key of a join.

What remains when no vertex has fewer than three neighbours is the core. A core of at most
``core_limit`` edges is solved by union-find in one task, a size that is
counted first; a larger one by large-star/small-star rounds. Then the labels
are given back to the removed vertices, in reverse order of their removal.
Every round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.runtime import blank, col, cut, lookup_salted

CORE_LIMIT = 1_000_000


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("o")), F.struct(F.col("b").alias("v"), F.col("a").alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("o").alias("lo"), F.max("o").alias("hi"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()


def _rank_runs(low: DataFrame) -> DataFrame:
    """(x, v, t, leaf, ended, least) of every arc x -> v into a vertex of degree one or two: where its run leads.

    ``t`` is the vertex behind the run's last inner vertex, or the leaf it ends
    in; rings never end and have the ring's least vertex in ``least``.
    """
    arc = lambda x, v, t, done: F.struct(F.col(x).alias("x"), F.col(v).alias("v"), F.col(v).alias("tx"), F.col(t).alias("t"), F.lit(done).alias("leaf"), F.lit(done).alias("ended"))
    arcs = low.select(F.explode(F.when(F.col("d") == 1, F.array(arc("lo", "v", "v", True))).otherwise(F.array(arc("lo", "v", "hi", False), arc("hi", "v", "lo", False)))).alias("e")).select("e.*", F.least("e.x", "e.v").alias("least"))
    arcs = cut(arcs)
    while True:
        # (tx -> t) is the arc reached so far: if it is known, its own pointer is followed.
        nxt = arcs.select(F.col("x").alias("tx"), F.col("v").alias("t"), F.col("tx").alias("fx"), F.col("t").alias("ft"), F.col("leaf").alias("fleaf"), F.col("ended").alias("fended"), F.col("least").alias("fleast"))
        news = ~F.col("ended") & (F.col("fended").isNull() | F.col("fended") | (F.col("fleast") < F.col("least")))
        arcs = cut(arcs.join(nxt, ["tx", "t"], "left").select(
            "x", "v", F.coalesce("fx", "tx").alias("tx"), F.coalesce("ft", "t").alias("t"), F.coalesce("fleaf", "leaf").alias("leaf"),
            F.coalesce("fended", F.lit(True)).alias("ended"), F.least("least", "fleast").alias("least"), news.alias("news"),
        ))
        # In a run some arc ends at every doubling, in a ring some arc learns of a lower vertex, or all is known.
        if arcs.filter("news").isEmpty():
            return arcs.drop("news")
        arcs = arcs.drop("news")


def _contract(edges: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (removed vertices with the surviving vertex they point to, the edges that stay)."""
    low = degrees.filter("d <= 2")
    arcs = _rank_runs(low)
    ends = arcs.filter("v <> t or not leaf").groupBy("v").agg(
        F.max(F.when(~F.col("leaf") & F.col("ended"), F.col("t"))).alias("core"), F.min(F.when(~F.col("leaf") & F.col("ended"), F.col("t"))).alias("other"),
        F.min(F.when(F.col("leaf"), F.col("t"))).alias("tip"), F.min(F.when(~F.col("ended"), F.col("least"))).alias("ring"), F.count_if(~F.col("leaf") & F.col("ended")).alias("cores"),
    )
    ends = cut(ends)
    inner = ends.select("v", F.coalesce("ring", "core", "tip").alias("p"))
    # Where a leaf's only edge leads: behind the run that begins there, or to the neighbour itself.
    beyond = arcs.select(F.col("x").alias("v"), F.col("v").alias("lo"), "t", "leaf")
    leaves = low.filter("d = 1").select("v", "lo").join(beyond, ["v", "lo"], "left").select("v", F.when(F.col("leaf"), F.least("v", "t")).otherwise(F.coalesce("t", "lo")).alias("p"))
    removed = inner.unionByName(leaves).filter("v <> p")
    gone = low.select("v", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("o")).select(F.least("v", "o").alias("a"), F.greatest("v", "o").alias("b")).distinct()
    stay = edges.join(gone, ["a", "b"], "left_anti").unionByName(_pairs(ends.filter("cores = 2"), "core", "other")).distinct()
    return removed, stay


def _union_find(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        vs = list(root)
        yield pd.DataFrame({"v": np.array(vs, dtype=np.int64), "label": np.array([find(v) for v in vs], dtype=np.int64)})


def _stars(edges: DataFrame) -> DataFrame:
    """Labels of a large core by alternating large-star and small-star rounds."""
    before = None
    while True:
        # large-star: larger neighbours of v are tied to the least of v and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = lookup_salted(both.filter("b > a"), least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = cut(_pairs(large, "x", "y"))
        # small-star: v and its smaller neighbours are tied to the least of them
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup_salted(down, least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        edges = cut(_pairs(small, "x", "y"))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("label"))
    return labels.unionByName(edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")).join(labels.select("v"), "v", "left_anti"))


def components(edges: DataFrame, a: str, b: str, core_limit: int = CORE_LIMIT) -> DataFrame:
    """(v, label) for every vertex of the BIGINT pairs (a, b): label is equal exactly within a connected group.

    A pair with a null end links nothing and is left out; a vertex whose only
    pair is with itself is a group of its own; repeated and reversed pairs
    count once; an empty input gives an empty result; extra columns are
    ignored. The label is some vertex of the group.
    """
    given = cut(edges.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).dropna())
    live = cut(_pairs(given, "x", "y"))
    left = live.count()
    levels: list[DataFrame] = []
    while left:
        degrees = cut(_degrees(live))
        if degrees.filter("d <= 2").isEmpty():
            break
        removed, stay = _contract(live, degrees)
        levels.append(cut(removed))
        live = cut(stay)
        left = live.count()
    # Roots: vertices that were never removed. Those outside the core label themselves.
    roots = given.select(F.explode(F.array("x", "y")).alias("v")).distinct()
    if levels:
        gone = levels[0].select("v")
        for level in levels[1:]:
            gone = gone.unionByName(level.select("v"))
        roots = roots.join(gone, "v", "left_anti")
    if left:
        labels = live.coalesce(1).mapInPandas(_union_find, "v bigint, label bigint") if left <= core_limit else _stars(live)
        roots = roots.join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
    else:
        roots = roots.withColumn("label", F.col("v"))
    if not levels:
        return roots
    known = cut(roots)
    for level in reversed(levels):
        back = lookup_salted(level.select("v", "p"), known.select(F.col("v").alias("p"), "label"), "p", "inner").select("v", "label")
        known = cut(known.unionByName(back))
    return known


URL = r"(?s)^(?:[a-z][a-z+.-]*://)?(?:[^/@]*@)?(?:www\.|api\.)?([^/]+)/(?:repos/)?([^/]+)/([^/]+?)(?:\.git)?/(pull|issue|commit)s?/([0-9a-z]+).*$"


def artifact(url: Column) -> Column:
    """What a forge url names, as text: 'host/owner/repo/kind/id'; null for a null or blank url.

    Scheme, host prefix (www., api.), letter case, query, fragment, trailing
    slash, sub-pages and .diff/.patch forms don't matter. A url of another form
    names itself, in lower case and without those decorations.
    """
    plain = F.lower(F.regexp_replace(url, r"(?sU)^\s+|(?:[?#].*|[\s/]+)$", ""))
    return F.when(~blank(url), F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[\s/]+$", ""), URL, "$1/$2/$3/$4/$5"), r"^[a-z]+://(?:www\.)?", ""))


def _abbreviations(names: DataFrame) -> DataFrame:
    """(short, full) of commit names where all longer names that begin with the short one begin with the next longer one.

    Every name is met by its beginnings of those lengths that hashes have here
    (at most 33, from 7 on). A name that abbreviates two different commits names itself.
    """
    sha = F.regexp_extract("name", r"/commit/([0-9a-f]{7,40})$", 1)
    commits = names.select("name", F.length(sha).alias("n")).filter("n > 0")
    lengths = sorted(r["n"] for r in commits.select("n").distinct().collect())  # 7 to 40
    shorter = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda i: i < F.col("n"))
    begun = commits.select(F.col("name").alias("longer"), F.explode(F.transform(shorter, lambda i: F.expr("length(name)") - F.col("n") + i)).alias("at")).select("longer", F.expr("substring(longer, 1, at)").alias("name"))
    met = begun.join(commits.select("name"), "name").groupBy(F.col("name").alias("short")).agg(F.min("longer").alias("full"), F.max("longer").alias("last"))
    # What lies between two names that begin alike begins so too.
    return met.filter(F.col("last").startswith(F.col("full"))).select("short", "full")


def linked_records(df: DataFrame, record: str, urls: tuple[str, str], group: str = "group_id", core_limit: int = CORE_LIMIT) -> DataFrame:
    """(group, record): every distinct record id with the smallest record id of its linked group.

    Two records are linked if they name the same artifact in either url column
    (see :func:`artifact`); an abbreviated commit hash names the full one of its
    repository. A record may stand on several rows: it names what any of them
    names. A null or blank url names nothing; a record without any name is
    a group of its own. Rows of a null record id link what they name, each by itself, but get no row.
    Repeated rows count once; extra columns are ignored; empty in, empty out.
    Vertices are numbers given to the distinct artifact names.
    """
    s, t = (artifact(col(u)) for u in urls)
    rows = df.select(col(record).alias("r"), s.alias("s"), t.alias("t"))
    key = F.when(F.col("r").isNotNull(), F.concat(F.lit("r"), F.col("r").cast("string"))).otherwise(F.concat_ws("\x01", F.lit("n"), "s", "t"))
    named = cut(rows.select(key.alias("q"), "r", F.explode(F.array("s", "t")).alias("name")).distinct())
    names = named.select("name").dropna().distinct()
    ids = cut(names.withColumn("id", F.monotonically_increasing_id()))
    given = cut(lookup_salted(named.dropna(subset=["name"]), ids, "name", "inner").select("q", "r", "id"))
    # Every record keeps one of its artifacts, to which its others are tied; null where it names none.
    every = given.unionByName(named.filter("name is null").select("q", "r", F.lit(None).cast("bigint").alias("id")))
    own = cut(every.groupBy("q", "r").agg(F.min("id").alias("v")))
    tied = lookup_salted(given.select("q", "id"), own.select("q", "v"), "q", "inner").select(F.col("v").alias("x"), F.col("id").alias("y"))
    short = _abbreviations(ids).join(ids.select(F.col("name").alias("short"), F.col("id").alias("x")), "short").join(ids.select(F.col("name").alias("full"), F.col("id").alias("y")), "full")
    labels = components(tied.unionByName(short.select("x", "y")), "x", "y", core_limit)
    known = own.filter("v is not null").select("r", "v")
    placed = cut(lookup_salted(known, labels, "v", "inner").select("r", "label"))
    first = placed.groupBy("label").agg(F.min("r").alias("g"))
    alone = own.filter("v is null").select(F.col("r").alias("g"), "r")
    out = lookup_salted(placed, first, "label", "inner").select("g", "r").unionByName(alone)
    return out.filter("r is not null").select(F.col("g").alias(group), F.col("r").alias(record))
