"""Token ids of a corpus by a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern. A word that is itself a
token is found within its text, by a perfect hash of the vocabulary's words in
literal arrays; every other distinct word of the corpus is encoded once: a Spark higher-order
``aggregate`` folds merges over its byte ids, in each step the adjacent pair of
lowest rank, and the ids are joined back to the word's places. Ranks come from
a literal rank map: a perfect hash of all merges in literal arrays, so
that a lookup is an array access (Spark searches a map literal of 50,000 entries
from front to back). The ranks of a word's pairs are kept along the fold: a
merge looks up the two pairs it makes. Words of more than ``FOLD_BYTES`` bytes, for which a fold
is quadratic, take an equivalent heap in an Arrow function.

Equal texts are encoded once, keyed by the text's MD5; the corpus is read for
its words and once more for its rows.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.runtime import col, cut, fresh, lookup_salted

PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLD_BYTES = 96
# Primes of the hash functions; products stay far below 2**63.
_BUCKETS, _P1, _P2 = 16_381, 59_999, 65_521  # keys below P1 * P2 (3.9e9) are told apart
_HASH = 2**62 - 1  # the bits of a word's hash that are used
_BETWEEN = "\x01\x02"  # in no word of a vocabulary


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256."""
    shown = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    out = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + i)] = b
    return out


class _Table:
    """A perfect hash of keys: slot = ((k mod P1 + 1) * (2 d + 1) + k mod P2) mod size, with d of the key's bucket."""

    def __init__(self, keys: np.ndarray) -> None:
        self.size = len(keys) * 5 // 4 + 257
        while any(self.size % q == 0 for q in range(2, int(self.size**0.5) + 1)):
            self.size += 1  # a prime, so that no key's slot is the same for all d
        self.shift = np.zeros(_BUCKETS, dtype=np.int64)
        self.slots = np.full(self.size, -1, dtype=np.int64)  # index of the key
        members: dict[int, list[int]] = {}
        for i, b in enumerate((keys % _BUCKETS).tolist()):
            members.setdefault(b, []).append(i)
        k1, k2 = keys % _P1 + 1, keys % _P2
        for b, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            for d in range(1 << 20):
                at = (k1[own] * (2 * d + 1) + k2[own]) % self.size
                if (self.slots[at] < 0).all() and len(set(at.tolist())) == len(own):
                    self.shift[b] = d
                    self.slots[at] = own
                    break
            else:
                raise ValueError("no perfect hash found")


def _numbers(values) -> Column:
    """A literal array of numbers: the optimizer folds the text to it, so it is built once and read by place."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _decodes(piece: bytes) -> bool:
    try:
        return bool(piece.decode())
    except UnicodeDecodeError:
        return False


class Vocabulary:
    """One vocabulary file (JSON with vocab and merges; ids below 2**16), with its hash tables."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_of_char()
        as_bytes = lambda piece: bytes(to_byte[c] for c in piece)
        special = {p: i for p, i in model["vocab"].items() if any(c not in to_byte for c in p)}
        self.pieces = {i: as_bytes(p) for p, i in model["vocab"].items() if p not in special}
        self.ids = {p: i for i, p in self.pieces.items()}
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        keys = np.array([a * 65_536 + b for a, b in self.merges], dtype=np.int64)
        ranks = np.array([r for r, _ in self.merges.values()])
        self.merge_table, self.merge_keys, self.merge_ranks = _Table(keys), keys, ranks
        #: the words that are one token, and a perfect hash of them
        self.words = [(piece.decode(), i) for i, piece in self.pieces.items() if _decodes(piece) and self.encode_bytes(piece) == [i]]
        self.word_table = _Table(np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) & _HASH for w, _ in self.words], dtype=np.int64))

    def encode_bytes(self, word: bytes) -> list[int]:
        """Merges by a heap: n log n for a word of n bytes."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*self.merges[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heap = [(rank, i, p, new) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, p, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (q := (ids[left], ids[after[left]])) in self.merges:
                    rank, made = self.merges[q]
                    heapq.heappush(heap, (rank, left, q, made))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


class Tokenizer:
    """Column expressions of a vocabulary."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        at = lambda t, values, none: [values[i] if i >= 0 else none for i in t.slots.tolist()]
        packed = (v.merge_keys * 65_536 + v.merge_ranks).tolist()
        # slot -> the merge's two ids and its rank in one number
        self._merges = (_numbers(v.merge_table.shift.tolist()), _numbers(at(v.merge_table, packed, -1)), v.merge_table.size)
        self._made = _numbers([i for _, i in v.merges.values()])
        self._starts = _numbers(v.byte_ids)
        self._words = (
            _numbers(v.word_table.shift.tolist()), F.split(F.lit(_BETWEEN.join(at(v.word_table, [w for w, _ in v.words], ""))), _BETWEEN), _numbers(at(v.word_table, [i for _, i in v.words], -1)), v.word_table.size,
        )

    @staticmethod
    def _slot(k: Column, shift: Column, size: int) -> Column:
        return (((k % _P1 + 1) * (2 * F.get(shift, (k % _BUCKETS).cast("int")) + 1) + k % _P2) % size).cast("int")

    def known(self, words: Column) -> Column:
        """For each of an array of words its id if it is one token, else null."""
        shift, names, ids, size = self._words
        slot = lambda w: self._slot(F.xxhash64(w).bitwiseAND(F.lit(_HASH)), shift, size)
        return F.transform(words, lambda w: _let(slot(w), lambda s: F.when(F.get(names, s) == w, F.get(ids, s).cast("int"))))

    def _rank(self, a: Column, b: Column) -> Column:
        """The rank of merging two ids, null if they don't merge (or one is null)."""
        shift, packed, size = self._merges

        def read(k: Column) -> Column:
            found = F.get(packed, self._slot(k, shift, size))
            return _let(found, lambda m: F.when(F.shiftright(m, 16) == k, m.bitwiseAND(F.lit(65_535)).cast("int")))

        return _let(a.cast("bigint") * 65_536 + b, read)

    def fold(self, word: Column) -> Column:
        """Ids of a word: merges of lowest rank folded over its bytes."""
        ranked = lambda ps: F.transform(ps, lambda x: self._rank(x["a"], x["b"]))
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        pairs = lambda ids: ranked(F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), pair))  # noqa: E731, the last one has no partner
        state = lambda ids, ranks, done: F.struct(ids.alias("ids"), ranks.alias("ranks"), F.lit(done).alias("done"))

        def step(acc: Column, _: Column) -> Column:
            ids, ranks = acc["ids"], acc["ranks"]

            def merge(m: Column) -> Column:
                p, new = m["p"], m["new"]
                around = ranked(F.slice(F.array(pair(F.get(ids, p - 2), new), pair(new, F.get(ids, p + 1))), F.when(p > 1, 1).otherwise(2), F.lit(2)))
                return state(
                    F.concat(F.slice(ids, F.lit(1), p - 1), F.array(new), F.slice(ids, p + 2, F.size(ids))),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), around, F.slice(ranks, p + 2, F.size(ranks))), False,
                )

            def go(low: Column) -> Column:
                at = F.struct(F.array_position(ranks, low).cast("int").alias("p"), F.get(self._made, low).cast("int").alias("new"))
                return F.when(low.isNull(), state(ids, ranks, True)).otherwise(_let(at, merge))

            return F.when(acc["done"], acc).otherwise(_let(F.array_min(ranks), go))

        raw, n = F.encode(word, "UTF-8"), F.octet_length(word)
        first = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(self._starts, F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int")).cast("int"))
        start = F.get(F.transform(F.array(first), lambda ids: state(ids, pairs(ids), False)), 0)
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["ids"])

    def decode(self, ids: DataFrame, record: str, column: str, out: str = "bytes") -> DataFrame:
        """(record, out): the text's bytes, put together from the tokens' binary pieces.

        One row per row of a distinct ``record``; an empty or null list gives empty bytes.
        """
        v = self.v
        pieces = F.broadcast(ids.sparkSession.createDataFrame(pd.DataFrame({"id": list(v.pieces), "piece": [v.pieces[i].hex().upper() for i in v.pieces]}), "id int, piece string"))
        at = ids.select(col(record), F.posexplode_outer(col(column)).alias("pos", "id")).join(pieces, "id", "left")
        parts = at.groupBy(col(record)).agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("p"))
        return parts.select(col(record), F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias(out))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def tokenizer(path: str | None = None) -> Tokenizer:
    return Tokenizer(vocabulary(path or default_path()))


def _long_words(path: str):
    @F.pandas_udf("array<int>")
    def encode(words: pd.Series) -> pd.Series:
        t = vocabulary(path)
        return words.map(lambda w: t.encode_bytes(w.encode()))

    return encode


def encode_corpus(df: DataFrame, text: str, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the token ids of ``text``, special tokens neither added nor recognised.

    Null and empty texts have the empty list; blank texts are encoded like any
    other. All rows and columns are kept (repeated rows too); if a column is
    named like ``ids`` the new one gets a suffix. Any length is encoded whole.
    """
    t = tokenizer(path)
    out = fresh(df.columns, ids)
    key = fresh(df.columns, "__k")
    rows = df.withColumn(key, F.when(F.length(col(text)) > 0, F.unhex(F.md5(F.encode(col(text), "UTF-8")))))
    texts = rows.filter(col(key).isNotNull()).groupBy(col(key).alias("k")).agg(F.first(col(text)).alias("t"), F.count(F.lit(1)).alias("__n"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # a small input: adaptive execution would leave all its texts to one task
        texts = texts.repartition(2 * cores, "k")
    # Of a text: the ids of its words in order, null for words of several tokens, and those with their places.
    read = texts.select("k", "__n", F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0)).alias("words")).withColumn("a", t.known(F.col("words")))
    placed = F.transform("words", lambda w, i: F.when(F.get("a", i).isNull(), F.struct(i.alias("pos"), w.alias("word"))))
    read = cut(read.select("k", "__n", "a", F.filter(placed, lambda x: x.isNotNull()).alias("odd")))
    odd = read.select("k", F.inline("odd"))
    words = cut(odd.groupBy("word").agg(F.count(F.lit(1)).alias("__n")))
    n = F.octet_length("word")
    # Encoding a word weighs more than its bytes, so the words are spread by number.
    each = words.select("word").repartition(2 * cores, "word")
    coded = each.filter(n <= FOLD_BYTES).select("word", t.fold(F.col("word")).alias("part")).unionByName(
        each.filter(n > FOLD_BYTES).select("word", _long_words(path or default_path())("word").alias("part"))
    )
    found = lookup_salted(odd, coded, "word", "inner", counts=words).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("o"))
    # The stretches of known words between the others, and these, in turn.
    before = lambda i: F.coalesce(F.get("o", i - 1)["pos"], F.lit(-1))
    joined = F.transform("o", lambda x, i: F.concat(F.slice("a", before(i) + 2, x["pos"] - before(i) - 1), x["part"]))
    rest = F.slice("a", before(F.size("o")) + 2, F.size("a"))
    coded_texts = read.select("k", "a").join(found, "k", "left").select(F.col("k").alias(key), F.when(F.col("o").isNull(), F.col("a")).otherwise(F.concat(F.flatten(joined), rest)).alias(out))
    full = lookup_salted(rows, coded_texts, key, counts=read.select(F.col("k").alias(key), "__n"))
    return full.withColumn(out, F.coalesce(col(out), F.array().cast("array<int>"))).select(*[col(c) for c in df.columns], col(out))
