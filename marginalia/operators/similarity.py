"""Pairs of similar token sets by equal parts, with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize, shuffle_partitions

FREQUENT = 4096  # most frequent tokens, which are dealt to the parts in turn
BLOCK = 4_000_000  # tokens of a block of sets that are compared together
CHUNK = 2_000_000  # tokens of the pairs that are compared at once
_RATIO, _WORDS, _EPS = 1.25, 4, 1e-9


def _bounds() -> list[int]:
    """Least set size of every size class; no array is longer than the last one."""
    b = [1]
    while b[-1] < 1 << 31:
        b.append(max(b[-1] + 1, math.ceil(b[-1] * _RATIO)))
    return b


_LEAST = _bounds()


def _reach(threshold: float) -> list[int]:
    """The largest set that can be similar to one of each size class."""
    return [math.floor((x - 1) / threshold + _EPS) for x in _LEAST[1:]]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _parts(threshold: float, frequent: np.ndarray, own_only: bool):
    """A function that gives every set (_c, _h) its parts' signatures in the size classes it is compared in, and its sketch.

    frequent: codes of the most frequent tokens, the first one most frequent.
    """
    reach = _reach(threshold)
    part_counts = [_part_count(threshold, k) for k in range(len(_LEAST) - 1)]
    order = np.argsort(frequent).astype(np.int32)
    ranked = frequent[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_c").to_numpy()
            n, codes = _lists(batch.column("_h"))
            if not len(codes):
                continue
            by_size = np.argsort(n, kind="stable")
            start = (np.cumsum(n) - n)[by_size]
            ids, n = ids[by_size], n[by_size]
            to = np.cumsum(n) - n
            codes = codes[np.arange(len(codes)) + np.repeat(start - to, n)]
            row = np.repeat(np.arange(len(n)), n)
            marks = codes.view(np.uint64)
            turn = (marks >> np.uint64(33)).astype(np.int32)
            if len(ranked):
                at = np.minimum(np.searchsorted(ranked, codes), len(ranked) - 1)
                turn = np.where(ranked[at] == codes, order[at], turn)
            odd = np.bincount(row * (64 * _WORDS) + (marks >> np.uint64(32)).astype(np.int64) % (64 * _WORDS), minlength=len(n) * 64 * _WORDS).astype(np.uint8) & 1
            sketch = np.packbits(odd.reshape(len(n), 64 * _WORDS), axis=1).view(np.int64)
            marks = _mix(marks)
            for k in range(len(_LEAST) - 1):
                first, last = np.searchsorted(n, _LEAST[k]), np.searchsorted(n, _LEAST[k + 1] - 1 if own_only else reach[k], side="right")
                if first == last:
                    continue
                m = part_counts[k]
                s, e = to[first], to[last - 1] + n[last - 1]
                part = turn[s:e] % np.int32(2 * m)
                part = np.minimum(part, 2 * m - 1 - part)
                total = np.zeros((last - first) * m, dtype=np.uint64)
                np.add.at(total, (row[s:e] - first) * m + part, marks[s:e])
                which = np.arange(m, dtype=np.uint64) + (np.uint64(k + 1) << np.uint64(40))
                signature = _mix(total.reshape(last - first, m) + _mix(which)).ravel().view(np.int64)
                each = np.repeat(np.arange(first, last), m)
                columns = [signature, ids[each], n[each].astype(np.int32), np.full(len(each), k, dtype=np.int32), *[sketch[each, i] for i in range(_WORDS)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_sig", "_c", "_n", "_k", *[f"_w{i}" for i in range(_WORDS)]])

    return run


def _part_count(threshold: float, k: int) -> int:
    """One more than the tokens that similar sets, the smaller one of size class k, can differ in."""
    most = _LEAST[k + 1] - 1
    return math.floor((1 - threshold) / (1 + threshold) * (most + math.floor(most / threshold + _EPS)) + _EPS) + 1


class _Block:
    """Sets that are compared with each other: their tokens as positions in the block's vocabulary."""

    def __init__(self, ids: list[np.ndarray], sizes: list[np.ndarray], codes: list[np.ndarray]):
        found, n = np.concatenate(ids), np.concatenate(sizes)
        order = np.argsort(found, kind="stable")
        self.ids, self.n, self.start = found[order], n[order], (np.cumsum(n) - n)[order]
        vocabulary, self.tokens = np.unique(np.concatenate(codes), return_inverse=True)
        self.marked = np.zeros(len(vocabulary), dtype=np.uint8)

    def similarity(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Jaccard similarity of pairs that are sorted by their left id."""
        a, b = np.searchsorted(self.ids, left), np.searchsorted(self.ids, right)
        out = np.empty(len(a))
        cut = np.cumsum(self.n[b]) // CHUNK
        for s, e in _runs(cut):
            out[s:e] = self._similarity(a[s:e], b[s:e])
        return out

    def _similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.n[b]
        start = np.cumsum(n) - n
        tokens = self.tokens[np.arange(n.sum()) + np.repeat(self.start[b] - start, n)]
        hit = np.empty(len(tokens), dtype=np.uint8)
        for s, e in _runs(a):
            own = self.tokens[self.start[a[s]] : self.start[a[s]] + self.n[a[s]]]
            x, y = start[s], start[e - 1] + n[e - 1]
            self.marked[own] = 1
            hit[x:y] = self.marked[tokens[x:y]]
            self.marked[own] = 0
        shared = np.add.reduceat(hit, start, dtype=np.int64)
        return shared / (self.n[a] + n - shared)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of every run of equal values."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else []
    start = 0
    for end in map(int, ends):
        yield start, end
        start = end


def _compare(threshold: float):
    """A function over rows sorted by group, in each first sets (_l, _h), then pairs (_l, _r): the pairs that reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, ([], [], []), None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("_k", "_x", "_y", "_pair")])
            changes = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, keys.shape[1]) if keys.shape[1] else []
            s = 0
            for e in map(int, changes):
                if group != (g := tuple(keys[:3, s])):
                    group, held, block = g, ([], [], []), None
                piece = batch.slice(s, e - s)
                left = piece.column("_l").to_numpy()
                if keys[3, s]:
                    block = block or _Block(*held)
                    held = ([], [], [])
                    right = piece.column("_r").to_numpy()
                    found = block.similarity(left, right)
                    good = found >= threshold
                    yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (left, right, found)], names=["_l", "_r", "similarity"])
                else:
                    for to, x in zip(held, (left, *_lists(piece.column("_h")))):
                        to.append(x)
                s = e

    return run


def _codes(rows: DataFrame) -> tuple[int, np.ndarray]:
    """A seed under which no two tokens of the rows' sets share a 64-bit code, and the codes of the most frequent ones."""
    words = rows.select(F.explode("_set").alias("_t")).groupBy("_t").agg(F.count("*").alias("_df"))
    seed = 0
    while True:
        top = words.groupBy(F.xxhash64(F.lit(seed), "_t").alias("_code")).agg(F.sum("_df").alias("_df"), F.count("*").alias("_words")).orderBy(F.desc("_words"), F.desc("_df"), "_code").limit(FREQUENT).collect()
        if not top or top[0]["_words"] == 1:
            return seed, np.array([r["_code"] for r in top], dtype=np.int64)
        seed += 1


def near_duplicate_sets(df: DataFrame, id_col: str, tokens: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): classes of equal token sets whose Jaccard similarity reaches the threshold, and the class of every row.

    members: (id, class_id), class_id being the smallest id with the same set; null or
    repeated tokens don't matter, a null array is an empty set. pairs: (left_id, right_id,
    similarity) of class ids, left_id < right_id. The empty set is similar to itself only, so it is in no
    pair. Rows with a null id are left out.

    Similar sets differ in at most H tokens, a number that follows from the size class of the smaller one.
    Dealt into H + 1 parts by token, two such sets have an equal part, so sets are joined on their
    parts and not on single tokens. Sizes and a sketch bound the overlap in that join: a bit of
    the sketch says whether the number of tokens that fall to it is odd, so each bit in which two sketches differ stands for
    a token in one of the sets only. What is left is compared exactly, in blocks of sets of like size.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.sort_array(F.array_except(F.coalesce(tokens, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("_set")).filter("id IS NOT NULL")
    rows = materialize(rows.withColumn("_key", F.sha2(F.to_json("_set"), 256)))
    seed, frequent = _codes(rows)
    codes = F.transform("_set", lambda x: F.xxhash64(F.lit(seed), x))
    sizes = lambda values: F.array(*[F.lit(min(x, 1 << 31)).cast("long") for x in values])
    own = F.size(F.filter(sizes(_LEAST), lambda x: x <= F.col("_n"))) - 1
    first = F.size(F.filter(sizes(_reach(threshold)), lambda x: x < F.col("_n")))
    classes = rows.select("id", "_key", codes.alias("_h")).groupBy("_key").agg(F.min("id").alias("class_id"), F.any_value("_h").alias("_h"))
    classes = materialize(classes.select("_key", "class_id", F.monotonically_increasing_id().alias("_c"), F.size("_h").alias("_n"), "_h").withColumns({"_first": first, "_own": own}))
    members = rows.select("id", "_key").distinct().join(classes.select("_key", "class_id"), "_key").select("id", "class_id")

    sets = classes.filter("_n > 0")
    signature = "_sig long, _c long, _n int, _k int, " + ", ".join(f"_w{i} long" for i in range(_WORDS))
    side = lambda own_only, s: (d := sets.select("_c", "_h").mapInArrow(_parts(threshold, frequent, own_only), signature)).select(F.col("_sig"), *[F.col(c).alias(f"{c}{s}") for c in d.columns[1:]])
    both = F.col("_n_a") + F.col("_n_b")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * both - _EPS)  # overlap of two sets of that similarity
    differing = sum((F.bit_count(F.col(f"_w{i}_a").bitwiseXOR(F.col(f"_w{i}_b"))) for i in range(1, _WORDS)), F.bit_count(F.col("_w0_a").bitwiseXOR(F.col("_w0_b"))))
    smaller = (F.col("_n_a") < F.col("_n_b")) | ((F.col("_n_a") == F.col("_n_b")) & (F.col("_c_a") < F.col("_c_b")))
    possible = smaller & (F.col("_n_a") >= F.lit(threshold) * F.col("_n_b") - _EPS) & (differing <= both - 2 * least)
    candidates = side(True, "_a").join(side(False, "_b"), "_sig").filter(possible).select(F.col("_k_a").alias("_k"), F.col("_c_a").alias("_l"), F.col("_c_b").alias("_r")).distinct()

    spread = sets.select("_c", "_h", "_n", F.explode(F.sequence("_first", "_own")).alias("_k"))
    held = {r["_k"]: r["n"] for r in spread.groupBy("_k").agg(F.sum("_n").alias("n")).collect()}
    blocks = F.get(F.array(*[F.lit(max(1, math.ceil(held.get(k, 0) / BLOCK))) for k in range(len(_LEAST))]), F.col("_k"))
    home = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    group = lambda x, y: [F.least(x, y).alias("_x"), F.greatest(x, y).alias("_y")]
    offered = spread.withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    offered = offered.select("_k", *group(home("_c"), F.col("_b")), F.lit(0).alias("_pair"), F.col("_c").alias("_l"), F.lit(0).cast("long").alias("_r"), "_h")
    asked = candidates.select("_k", *group(home("_l"), home("_r")), F.lit(1).alias("_pair"), "_l", "_r", F.array().cast("array<long>").alias("_h"))
    sorted_rows = offered.unionByName(asked).repartition(shuffle_partitions(spark), "_k", "_x", "_y").sortWithinPartitions("_k", "_x", "_y", "_pair", "_l")
    scored = sorted_rows.mapInArrow(_compare(threshold), "_l long, _r long, similarity double")
    names = lambda c: classes.select(F.col("_c").alias(c), F.col("class_id").alias(f"{c}_id"))
    named = scored.join(names("_l"), "_l").join(names("_r"), "_r")
    return named.select(F.least("_l_id", "_r_id").alias("left_id"), F.greatest("_l_id", "_r_id").alias("right_id"), "similarity"), members
