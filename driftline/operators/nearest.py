"""The nearest sets of every query set, exactly, without a row per pair that shares a token.

Both sides are packed into blocks of integer codes with a dictionary each. Two
blocks meet in one task: tokens that many sets of the block hold are counted
by one matrix product, the others are looked up only for pairs that could
still be among a query's k best. Both similarities of a clone score grow with
share = common / (size + size), so a query's k-th best share so far bounds what
another pair needs: at most min(rare tokens of either side) can come on top of
the product. Sets of a size that can't reach it are left out of the product.

A query block keeps its k best over all blocks that its task sees; only these
are shuffled. Time grows with queries x documents, disk with both tables alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.runtime import cut

#: Sets of a block of queries and of documents, and of the pieces whose product is formed at once; tokens of a block of either at most (a larger set is a block of its own).
QUERIES, DOCUMENTS, ROWS, COLUMNS, TOKENS = 4096, 16384, 512, 1024, 4_000_000
#: A token goes into the matrix product from this share of a block's documents, the most frequent ones if there are more.
FREQUENT, WIDEST = 0.03, 1024
#: Shares that differ by less may have the same score of six digits.
SLACK = 2e-6
#: Rare tokens looked up at once.
LOOKED_UP = 4_000_000


def _clone_scores(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0.60 Dice + 0.40 Jaccard to six digits, halves up as Spark's round has them."""
    s = 0.60 * (2.0 * common / (a + b)) + 0.40 * (common / (a + b - common))
    out = np.floor(s * 1e6 + 0.5)
    for i in np.flatnonzero(np.abs(s * 1e6 - np.floor(s * 1e6) - 0.5) < 1e-4):
        out[i] = int((Decimal(repr(float(s[i]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several spans, one behind the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _ranks(ids: pa.Array) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


def _packer(most: int, copies: int | None):
    """Batches of (id, set) as blocks of at most ``most`` sets by size; of equal sets the ``copies`` with the smallest ids."""

    def block(ids: pa.Array, sets: pa.Array) -> pa.RecordBatch:
        n = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        words = sets.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = codes[np.lexsort((codes, np.repeat(np.arange(len(n)), n)))].astype(np.uint16 if len(words.dictionary) <= 65536 else np.int32)
        starts = np.cumsum(n) - n
        keep = np.flatnonzero(n)
        if copies is not None:
            seen: dict[bytes, int] = {}
            kept = []
            for i in keep[np.argsort(_ranks(ids)[keep])]:
                key = codes[starts[i] : starts[i] + n[i]].tobytes()
                seen[key] = seen.get(key, 0) + 1
                if seen[key] <= copies:
                    kept.append(i)
            keep = np.array(kept, np.int64)
        keep = keep[np.argsort(n[keep], kind="stable")]
        codes = codes[_spans(starts[keep], n[keep])]
        cells = [pa.array([x], pa.binary()) for x in (n[keep].astype(np.int32).tobytes(), codes.tobytes(), "\n".join(words.dictionary.to_pylist()).encode())]
        held = ids.take(pa.array(keep))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), *cells], ["ids", "n", "codes", "words"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, rows, held = [], [], 0, 0
        for b in batches:
            at = 0
            ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                fits = min(most - rows, int(np.searchsorted(ends[at:], before + TOKENS - held, "right")))
                if fits <= 0 and held:
                    yield block(pa.concat_arrays(ids), pa.concat_arrays(sets))
                    ids, sets, rows, held = [], [], 0, 0
                    continue
                part = b.slice(at, max(fits, 1))
                ids, sets = [*ids, part.column(0)], [*sets, part.column(1)]
                at, rows = at + part.num_rows, rows + part.num_rows
                held += int(ends[at - 1] - before)
        if held:
            yield block(pa.concat_arrays(ids), pa.concat_arrays(sets))

    return run


class _Block:
    def __init__(self, ids: pa.Array, n: bytes, codes: bytes, words: bytes):
        self.ids = ids
        self.n = np.frombuffer(n, np.int32).astype(np.int64)
        self.codes = np.frombuffer(codes, np.uint16 if len(codes) == 2 * self.n.sum() else np.int32)
        self.words = pa.array(words.decode().split("\n"), pa.string())


class _Best:
    """The k best documents of every query of a block, over the blocks of documents met so far."""

    def __init__(self, block: _Block, k: int):
        self.q, self.k = block, k
        self.share = np.zeros(len(block.n))
        self.rows = [np.empty(0, np.int64) for _ in range(3)]  # query, common, document's size
        self.ids = None

    def _first(self, q: np.ndarray, common: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Places of each query's k best, in order of the query; raises the share it asks for."""
        n = self.q.n[q]
        at = np.lexsort((order, -_clone_scores(common, n, size), q))
        q = q[at]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        at, q = at[rank < self.k], q[rank < self.k]
        share = common[at] / (self.q.n[q] + size[at]) - SLACK
        least = np.full(len(self.share), np.inf)
        np.minimum.at(least, q, share)
        full = np.bincount(q, minlength=len(least)) == self.k
        self.share[full] = np.maximum(self.share[full], least[full])
        return at

    def meet(self, d: _Block) -> None:
        q = self.q
        code = pc.fill_null(pc.index_in(d.words, q.words), -1).to_numpy(zero_copy_only=False)
        dt = code[d.codes]
        drow = np.repeat(np.arange(len(d.n)), d.n)[dt >= 0]
        dt = dt[dt >= 0]
        df = np.bincount(dt, minlength=len(q.words))
        qrow = np.repeat(np.arange(len(q.n)), q.n)[df[q.codes] > 0]
        qt = q.codes[df[q.codes] > 0]
        wide = np.argsort(-df, kind="stable")[: min(WIDEST, int((df >= max(1, FREQUENT * len(d.n))).sum()))]
        place, narrow = np.full(len(df), -1), np.full(len(df), -1)
        place[wide] = np.arange(len(wide))
        rare = np.flatnonzero((df > 0) & (place < 0))
        narrow[rare] = np.arange(len(rare))
        often_d, often_q = place[dt] >= 0, place[qt] >= 0
        kind = np.float32 if d.n.max() + q.n.max() < 2**15 else np.float64
        dense = np.zeros((len(d.n), len(wide) + 2), kind)
        dense[drow[often_d], place[dt[often_d]]] = 1
        dense[:, -2], dense[:, -1] = d.n, 1
        rare_d, rare_row = narrow[dt[~often_d]], drow[~often_d]
        left_d = np.bincount(rare_row, minlength=len(d.n))
        start_d = np.cumsum(left_d) - left_d
        left_q, present = np.bincount(qrow[~often_q], minlength=len(q.n)), np.bincount(qrow, minlength=len(q.n))
        order = _ranks(d.ids)
        blocks = [(x, min(x + COLUMNS, len(d.n))) for x in range(0, len(d.n), COLUMNS)]
        rows, hits = min(ROWS, max(1, 64_000_000 // max(1, len(rare)))), []
        for g in range(0, len(q.n), rows):
            h = min(g + rows, len(q.n))
            mine = (qrow >= g) & (qrow < h)
            a = np.zeros((h - g, len(wide) + 2), kind)
            a[qrow[mine & often_q] - g, place[qt[mine & often_q]]] = 1
            has = np.zeros((h - g, len(rare)), bool)
            has[qrow[mine & ~often_q] - g, narrow[qt[mine & ~often_q]]] = True
            near = sorted(blocks, key=lambda b: abs(np.log(d.n[(b[0] + b[1]) // 2] / q.n[(g + h) // 2])))
            pool = [np.empty(0, np.int64) for _ in range(3)]  # query, document, common
            for i, (x, y) in enumerate(near):
                part, n, size = dense[x:y], q.n[g:h], d.n[x:y]
                if i == 0 and y - x >= self.k:
                    # Frequent tokens alone are a lower bound of what every pair shares.
                    least = (a[:, :-2] @ part[:, :-2].T) / (n[:, None] + size[None, :])
                    self.share[g:h] = np.maximum(self.share[g:h], np.partition(least, -self.k, axis=1)[:, -self.k] - SLACK)
                share = self.share[g:h]
                act = np.flatnonzero((present[g:h] > 0) & (np.minimum(present[g:h], size[-1]) >= share * (n + size[0]) - 1e-6))
                if not len(act):
                    continue
                more = np.minimum(left_q[g:h], left_d[x:y].max())[act]
                mul = a if len(act) == h - g else a[act]
                mul[:, -2] = -share[act]
                mul[:, -1] = more - np.maximum(share * n, 0.5 - share * size[-1])[act]
                over = mul @ part.T
                at = np.flatnonzero(over.ravel() >= -0.02)
                qi, di = act[at // (y - x)], at % (y - x)
                common = np.rint(over.ravel()[at] - mul[at // (y - x), -1] + share[qi] * size[di]).astype(np.int64)
                # The bound of the pair itself, with its own document's rare tokens.
                may = common + np.minimum(left_q[g + qi], left_d[x + di]) >= np.maximum(share[qi] * (n[qi] + size[di]) - 1e-6, 1)
                qi, di, common = qi[may], di[may] + x, common[may]
                if not len(qi):
                    continue
                ends = np.cumsum(left_d[di])
                cuts = np.unique(np.append(np.searchsorted(ends, np.arange(LOOKED_UP, ends[-1], LOOKED_UP), "right"), [0, len(di)]))
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    sizes = left_d[di[s:e]]
                    hit = has[np.repeat(qi[s:e], sizes), rare_d[_spans(start_d[di[s:e]], sizes)]]
                    common[s:e] += np.bincount(np.repeat(np.arange(e - s), sizes)[hit], minlength=e - s)
                good = (common > 0) & (common >= share[qi] * (n[qi] + d.n[di]) - 1e-6)
                pool = [np.concatenate(p) for p in zip(pool, (qi[good] + g, di[good], common[good]), strict=True)]
                best = self._first(pool[0], pool[2], d.n[pool[1]], order[pool[1]])
                pool = [p[best] for p in pool]
            hits.append(pool)
        found = [np.concatenate(p) for p in zip(*hits, strict=True)]
        new = d.ids.take(pa.array(found[1]))
        ids = new if self.ids is None else pa.concat_arrays([self.ids, new])
        rows = [np.concatenate(p) for p in zip(self.rows, (found[0], found[2], d.n[found[1]]), strict=True)]
        best = self._first(*rows, _ranks(ids))
        self.rows, self.ids = [r[best] for r in rows], ids.take(pa.array(best))

    def batch(self) -> pa.RecordBatch:
        at, common, size = self.rows
        ints = [pa.array(x.astype(np.int32)) for x in (self.q.n[at], size, common)]
        return pa.RecordBatch.from_arrays([self.q.ids.take(pa.array(at)), self.ids, *ints], ["q", "d", "nq", "nd", "c"])


def _meeting(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for b in batches:
            for i in range(b.num_rows):
                if b["b"][i].as_py() != now:
                    if best:
                        yield best.batch()
                    now = b["b"][i].as_py()
                    best = _Best(_Block(b["qids"].slice(i, 1).flatten(), *(b[c][i].as_py() for c in ("qn", "qcodes", "qwords"))), k)
                best.meet(_Block(b["ids"].slice(i, 1).flatten(), *(b[c][i].as_py() for c in ("n", "codes", "words"))))
        if best:
            yield best.batch()

    return run


def nearest_sets(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(q, d, nq, nd, c) of (q, set of words) and (d, set of words): sizes and common words of pairs, among them every query's ``k`` best by clone score, ties to the smallest d.

    Sets have no null or repeated words and no line ends in a word, ids come once; pairs without a common word are none.
    """
    parallel = queries.sparkSession.sparkContext.defaultParallelism

    def packed(x: DataFrame, most: int, copies: int | None) -> tuple[DataFrame, int]:
        blocks, splits = -(-max(x.count(), 1) // most), x.rdd.getNumPartitions()
        # Sets are not shuffled where the table's splits make good blocks.
        whole = x if min(blocks, parallel) <= splits <= 2 * blocks else x.repartition(blocks)
        out = cut(whole.mapInArrow(_packer(most, copies), f"ids array<{x.dtypes[0][1]}>, n binary, codes binary, words binary"))
        return out, max(1, out.rdd.getNumPartitions())

    q, qsplits = packed(queries.toDF("q", "s"), QUERIES, None)
    d, dsplits = packed(documents.toDF("d", "s"), DOCUMENTS, k)
    qsplits = min(qsplits, 4 * parallel)
    # A task holds the documents of its split: those of 16 blocks or so.
    dsplits = min(dsplits, max(-(-4 * parallel // qsplits), -(-dsplits // 16)))
    q = q.select(F.monotonically_increasing_id().alias("b"), *[F.col(c).alias(f"q{c}") for c in q.columns]).coalesce(qsplits)
    met = q.hint("shuffle_replicate_nl").crossJoin(d.coalesce(dsplits))
    return met.mapInArrow(_meeting(k), f"q {queries.dtypes[0][1]}, d {documents.dtypes[0][1]}, nq int, nd int, c int")
