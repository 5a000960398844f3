"""Filling fixed-capacity containers with texts, by exact-complement hashing over length counts.

The packing is planned on the counts per length alone: at most `capacity`
different lengths, whatever the number of texts. A plan step is a combination of
lengths and how many containers it fills; texts are then numbered within their
length by distributed counting and take the containers the plan has for those numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.tokens import TOKENIZER_DIR, VOCABULARY, counter
from marginalia.session import materialize

CAPACITY = 4096


@dataclass(frozen=True)
class Step:
    """`times` containers, each holding `lengths` (length -> how often)."""

    first: int
    times: int
    lengths: dict[int, int]


class _Stock:
    """Counts of the lengths still available, with an index of the sums that two and three of them have.

    For each sum the index holds the largest part of one combination, 0 if there is none.
    Lengths only ever run out, so an entry that no longer holds is found again from the
    level below when it is looked up, and a sum without one stays without.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        lengths = np.flatnonzero(self.left)
        self.pairs, self.triples = np.zeros((2, capacity + 1), dtype=np.int64)
        for a in lengths:  # ascending, so that the largest part stands
            b = lengths[(lengths <= min(a, capacity - a)) & ((lengths != a) | (self.left[a] > 1))]
            self.pairs[a + b] = a
        sums = np.flatnonzero(self.pairs)
        for a in lengths:
            self.triples[a + sums[sums <= capacity - a]] = a

    def best_fit(self, gap: int) -> int:
        """Largest available length up to gap, 0 if none."""
        fits = np.flatnonzero(self.left[1 : gap + 1])
        return int(fits[-1]) + 1 if len(fits) else 0

    def _has_pair(self, a: int, b: int) -> bool:
        return self.left[a] > 0 and self.left[b] > 0 and (a != b or self.left[a] > 1)

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths that add up to total."""
        first = int(self.pairs[total]) if total > 0 else 0
        if not first:
            return None
        if not self._has_pair(first, total - first):
            a = np.arange((total + 1) // 2, total)
            b = total - a
            hits = np.flatnonzero((self.left[a] > 0) & (self.left[b] > 0) & ((a != b) | (self.left[a] > 1)))
            self.pairs[total] = first = int(a[hits[-1]]) if len(hits) else 0
        return (first, total - first) if first else None

    def _pair_beside(self, a: int, total: int) -> tuple[int, int] | None:
        """A pair of that total when one item of length a is taken; what is missing only for a's sake stays in the index."""
        found = self.pair(total)
        if not found or self.left[a] > found.count(a):
            return found
        b = np.arange(1, total // 2 + 1)
        c = total - b
        left = self.left.copy()
        left[a] -= 1
        hits = np.flatnonzero((left[b] > 0) & (left[c] > 0) & ((b != c) | (left[b] > 1)))
        return (int(c[hits[0]]), int(b[hits[0]])) if len(hits) else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three available lengths that add up to total."""
        first = int(self.triples[total])
        if not first:
            return None
        if self.left[first] > 0 and (two := self._pair_beside(first, total - first)):
            return (first, *two)
        parts = np.arange(1, total - 1)
        for a in parts[(self.left[parts] > 0) & (self.pairs[total - parts] > 0)][::-1]:
            if two := self._pair_beside(int(a), total - int(a)):
                self.triples[total] = a
                return (int(a), *two)
        self.triples[total] = 0
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill gap exactly."""
        return (gap,) if self.left[gap] > 0 else self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Steps that use up all counts (length 1..capacity -> number of items).

    A container starts with the longest length left and takes the best fit until
    one, two or three lengths fill its gap exactly, or nothing fits. As many
    containers as the counts allow are filled alike at once, so every step
    uses up a length, and the number of steps follows the number of lengths,
    not of items.
    """
    stock, steps, made = _Stock(counts, capacity), [], 0
    largest = max(counts, default=0)
    while True:
        while largest and not stock.left[largest]:
            largest -= 1
        if not largest:
            return steps
        used: Counter = Counter()
        gap = capacity

        def take(lengths: tuple[int, ...]) -> int:
            for x in lengths:
                stock.left[x] -= 1
                used[x] += 1
            return gap - sum(lengths)

        gap = take((largest,))
        while gap:
            exact = stock.complement(gap) if gap <= 3 * largest else None
            lengths = exact or ((fit,) if (fit := stock.best_fit(gap)) else None)
            if not lengths:
                break
            gap = take(lengths)
        times = 1 + min(int(stock.left[x]) // k for x, k in used.items())
        for x, k in used.items():
            stock.left[x] -= k * (times - 1)
        steps.append(Step(made, times, dict(used)))
        made += times


def _lookup(steps: list[Step]) -> tuple[np.ndarray, ...]:
    """Per (length, step), sorted: key of the first item number, items per container, first container."""
    start: Counter = Counter()
    rows = []
    for s in steps:
        for length, k in s.lengths.items():
            rows.append(((length << 48) + start[length], k, s.first))
            start[length] += k * s.times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))


def count_tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, tokens): tokens of each text; null for a null text, 0 for an empty one."""
    rows = docs.select(docs[id_col].alias("id"), *[docs[c] for c in keep], docs[text_col].alias("_text"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_text"], T.StructField("tokens", T.LongType())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_dir, vocabulary)
        for b in batches:
            n = [None if t is None else count(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in schema.names[:-1]], pa.array(n, pa.int64())], names=schema.names)

    return rows.mapInArrow(tokens, schema)


def number_within(df: DataFrame, by: list[str], out: str = "n_before") -> DataFrame:
    """Number the rows 0, 1, ... within each value of `by` without bringing a value's rows together.

    Each partition counts on its own (Arrow batches, counts per value), and each
    (partition, value) is shifted by the counts of the partitions before. The numbered
    rows are written once, so that numbers stay as they are.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            numbers = []
            for key in zip(*[b.column(c).to_pylist() for c in by]):
                numbers.append(seen[key])
                seen[key] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * b.num_rows, pa.int32()), pa.array(numbers, pa.int64())], names=schema.names)

    done = materialize(df.mapInArrow(local, schema))
    sizes = done.groupBy("_pid", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_pid", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = done.join(shifts, ["_pid", *by])
    return joined.withColumn(out, F.col("_local") + F.col("_shift")).select(*df.columns, out)


def fill_containers(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, tokens, piece_no, pieces, piece_tokens, container): where every text goes.

    sized: (id, tokens). A text within capacity stays whole, as one piece. A
    longer one is cut into full containers and a rest that is packed like any
    other item. Texts of null or 0 tokens need no space: one row with
    container null and piece_tokens 0. Ids may repeat or be null; each row is packed on
    its own. Containers are numbered from 0. Tokens must not be negative. An
    empty input gives an empty result; further columns are ignored.
    """
    rows = sized.select("id", "tokens")
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    rest = (F.col("tokens") % capacity).cast("int")
    sizes = F.when(F.coalesce("tokens", F.lit(0)) == 0, F.array(F.lit(0))).otherwise(F.concat(F.array_repeat(F.lit(capacity), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    items = rows.withColumn("_sizes", sizes).select("id", "tokens", F.size("_sizes").alias("pieces"), F.posexplode("_sizes").alias("piece_no", "piece_tokens"))
    numbered = materialize(number_within(items, ["piece_tokens"]))
    # at most `capacity` rows, whatever the input
    counts = {r["piece_tokens"]: r["n"] for r in numbered.groupBy("piece_tokens").agg(F.count("*").alias("n")).collect() if r["piece_tokens"]}
    keys, per, first = _lookup(plan(counts, capacity))
    schema = T.StructType([*numbered.drop("n_before").schema.fields, T.StructField("container", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("piece_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            number = b.column("n_before").to_numpy(zero_copy_only=False)
            filled = size > 0
            container = np.zeros(len(size), dtype=np.int64)
            if filled.any():
                key = (size[filled] << 48) + number[filled]
                at = np.searchsorted(keys, key, side="right") - 1
                container[filled] = first[at] + (key - keys[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in schema.names[:-1]], pa.array(container, pa.int64(), mask=~filled)], names=schema.names)

    return numbered.mapInArrow(place, schema).select("id", "tokens", "piece_no", "pieces", "piece_tokens", "container")
