"""Top N items within every group, by a loser-tree merge of bucketed sorted runs.

Every input partition becomes a sorted run per bucket: rows ordered by group,
score and ties, of which only the first N of each group are kept. The shuffle
stores the runs by bucket, groups side by side. Each bucket then merges the runs of some
groups at a time with a loser tree and, after N outputs of a group, seeks every run to the
next group. A group with millions of rows sends at most N rows per run, and a task
holds one batch and one group's runs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _End:
    """Sorts after every key."""

    __slots__ = ()

    def __lt__(self, other) -> bool:
        return False

    def __gt__(self, other) -> bool:
        return True


_END = _End()


class LoserTree:
    """Tournament over k sorted runs: the winner is read at the root, and after an advance only one leaf-to-root path is replayed."""

    def __init__(self, heads: list):
        self.k = max(1, len(heads))
        self.heads = heads or [_END]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._insert(leaf)

    def _insert(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.tree[node]
            if other == -1:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is _END and x is not _END if (x is _END or y is _END) else x < y

    def winner(self) -> int:
        return self.tree[0]

    def replace(self, leaf: int, head) -> None:
        """The winning leaf's next head; replays its path."""
        heads, tree = self.heads, self.tree
        heads[leaf] = head
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = tree[node]
            x = heads[other]
            if x is not _END and (head is _END or x < head):
                tree[node], winner, head = winner, other, x
            node //= 2
        tree[0] = winner


def merge_top(runs: Sequence[tuple[list, list]], n: int) -> Iterator[tuple[int, int, int]]:
    """(run, row, place) of the first n distinct keys of each group.

    runs: (groups, keys) per run, sorted by (group, key). Equal keys of a group,
    from any run, are one item.
    """
    at = [0] * len(runs)
    tree = LoserTree([(g[0], k[0]) if g else _END for g, k in runs])
    group, last, count = object(), None, 0
    while runs:
        r = tree.winner()
        head = tree.heads[r]
        if head is _END:
            return
        groups, keys = runs[r]
        i = at[r]
        if head[0] != group:
            group, count, last = head[0], 0, None
        if count < n:
            if head[1] != last:
                count += 1
                last = head[1]
                yield r, i, count
            i += 1
        else:  # enough of this group: seek to the next
            i = bisect_right(groups, group, i)
        at[r] = i
        tree.replace(r, (groups[i], keys[i]) if i < len(groups) else _END)


def top_n(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """(group, *order, place): the first n distinct order tuples of each group, ascending; place 1..n.

    order must be a total order of items (end it with a unique id): rows equal in
    group and order are one item, sent again. Rows with a null group or a null in
    order don't take part. Strings order by code points. n below 1, or an empty
    input, gives an empty result. Columns other than group and order are left out;
    the names _run and _seq are reserved.
    """
    keys = [group, *order]
    rows = df.select(*keys).dropna(how="any", subset=keys)
    fields = [rows.schema[c] for c in keys]
    run_schema = T.StructType([*fields, T.StructField("_run", T.LongType()), T.StructField("_seq", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First n distinct items of each group of one sorted run."""
        from pyspark import TaskContext

        run, seq, last, carried = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            if not b.num_rows or n < 1:
                continue
            codes = [b.column(c).dictionary_encode().indices.to_numpy() for c in keys]
            first = tuple(b.column(c)[0].as_py() for c in keys)
            new_group = np.ones(b.num_rows, dtype=bool)
            new_group[1:] = codes[0][1:] != codes[0][:-1]
            new_item = np.ones(b.num_rows, dtype=bool)
            new_item[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
            if last is not None and first[0] == last[0]:
                new_group[0] = False
                new_item[0] = first != last
            items = np.cumsum(new_item)
            starts = np.flatnonzero(new_group)
            base = np.full(b.num_rows, -carried)  # the group the batch before ended in
            if len(starts):
                which = np.cumsum(new_group) - 1
                base = np.where(which >= 0, (items[starts] - 1)[np.maximum(which, 0)], -carried)
            place = items - base
            keep = np.flatnonzero(new_item & (place <= n))
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in keys)
            carried = int(place[-1])
            if len(keep):
                kept = b.select(keys).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(keep), run)), pa.array(np.arange(seq, seq + len(keep)))], names=run_schema.names)
                seq += len(keep)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups of one bucket, some at a time: groups lie together, and the last one of a batch may go on in the next."""
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            names = t.column(group)
            start = pc.index(names, names[t.num_rows - 1]).as_py()
            held = t.slice(start)
            yield from merged(t.slice(0, start))
        if held is not None:
            yield from merged(held)

    def merged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups; they hold at most n rows per group and run."""
        if not t.num_rows:
            return
        t = t.sort_by([("_run", "ascending"), ("_seq", "ascending")])
        run_of = t.column("_run").to_numpy()
        bounds = [0, *(np.flatnonzero(run_of[1:] != run_of[:-1]) + 1), len(run_of)]
        groups = t.column(group).to_pylist()
        tuples = list(zip(*[t.column(c).to_pylist() for c in order]))
        runs = [(groups[a:b], tuples[a:b]) for a, b in zip(bounds, bounds[1:])]
        rows, places = [], []
        for r, i, place in merge_top(runs, n):
            rows.append(bounds[r] + i)
            places.append(place)
        picked = t.select(keys).take(pa.array(rows, pa.int64()))
        yield from picked.append_column("place", pa.array(places, pa.int32())).to_batches(max_chunksize=10_000)

    runs = rows.sortWithinPartitions(*keys).mapInArrow(cut, run_schema)
    bucketed = runs.repartition(F.col(group)).sortWithinPartitions(group, "_run", "_seq")  # by merging on disk where it has to
    return bucketed.mapInArrow(merge, T.StructType([*fields, T.StructField("place", T.IntegerType())]))
