"""Exact running sums, ranks and dense keys over groups of any size.

A window function puts a whole group into one task. Here rows are range
partitioned on (group, order), each partition sums on its own, and the totals of
earlier partitions are added as offsets, so that a group may span any number of
tasks. Only groups that cross a partition border need an offset; there are at
most two of them per partition, which bounds what the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import materialize, shuffle_partitions


def _changes(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    """True where a row's cols differ from those of the row before; nulls are equal to each other."""
    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
    for c in cols:
        a = batch.column(c)
        codes = a.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def range_running_sum(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    weight: str,
    out: str = "n_before",
    partitions: int | None = None,
) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows of the same group that sort before the row.

    Rows sort ascending by order_cols, nulls first. (group, order) should be
    unique, else rows with equal order get arbitrary places among themselves.
    Null group values form a group of their own. An empty input gives an empty
    result. weight must be BIGINT without nulls. Existing columns are kept; the
    names _pid and _seq are reserved.
    """
    spark = df.sparkSession
    p = partitions or shuffle_partitions(spark)
    keys = [*group_cols, *order_cols]
    ranged = df.repartitionByRange(p, *keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField(out, T.LongType())])
    groups = list(group_cols)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            new = _changes(b, groups)
            first = tuple(b.column(c)[0].as_py() for c in groups)
            carried = last is not None and first == last
            new[0] = not carried
            before = np.cumsum(w) - w
            starts = np.flatnonzero(new)
            base = np.zeros(len(w), dtype=np.int64)
            if len(starts):
                which = np.cumsum(new) - 1
                base = np.where(which >= 0, before[starts][np.maximum(which, 0)], 0)
                if carried:
                    base[which < 0] = -total
            elif carried:
                base[:] = -total
            res = before - base
            total = int(res[-1] + w[-1])
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in groups)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(res, pa.int64())], names=[*b.schema.names, out])

    done = materialize(ranged.mapInArrow(local, schema))
    sums = done.groupBy("_pid", *groups).agg(F.sum(weight).alias("_sum"))
    split = sums.groupBy(*groups).agg(F.count("*").alias("_parts"), F.collect_list(F.struct("_pid", "_sum")).alias("_each")).filter("_parts > 1")
    offsets: list[tuple] = []
    for row in split.collect():  # at most two groups per partition
        run = 0
        for e in sorted(row["_each"], key=lambda x: x["_pid"]):
            if run:
                offsets.append((*[row[c] for c in groups], e["_pid"], run))
            run += e["_sum"]
    if not offsets:
        return done.drop("_pid")
    fields = [done.schema[c] for c in groups]
    small = spark.createDataFrame(offsets, T.StructType([*[T.StructField(f"_g{i}", f.dataType) for i, f in enumerate(fields)], T.StructField("_opid", T.IntegerType()), T.StructField("_off", T.LongType())]))
    cond = F.col("_pid") == F.col("_opid")
    for i, c in enumerate(groups):
        cond &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = done.join(F.broadcast(small), cond, "left").withColumn(out, F.col(out) + F.coalesce("_off", F.lit(0)))
    return joined.select(*[c for c in df.columns], out)


def value_ranks(df: DataFrame, group_cols: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """Distinct (group, value) with n (its rows) and n_before (rows with a better value): rank = n_before + 1.

    Rows are counted per value before anything is shuffled, so a value that
    fills a third of a group is one row here. Values must not be null or NaN.
    """
    counts = df.groupBy(*group_cols, value).agg(F.count("*").alias("n"))
    if descending:
        counts = counts.withColumn("_key", -F.col(value).cast("double"))
        return range_running_sum(counts, group_cols, ["_key"], "n").drop("_key")
    return range_running_sum(counts, group_cols, [value], "n")


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame:
    """left with `right`: the struct of the row of right with the same key and the latest time not after left's, null if there is none.

    Both need key and time of one type; (key, time) must be unique in right. Rows of
    right are numbered within their key by running sums over range partitions, and a row of
    left gets the number of those before it, so that a hot key is joined by (key,
    number). Null keys or times have no match. The names _side, _n and _no are reserved.
    """
    l = left.withColumn("_no", F.monotonically_increasing_id())  # noqa: E741
    l = materialize(l)  # noqa: E741
    marks = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, F.lit(0).alias("_side"), F.lit(1).cast("long").alias("_n"), F.lit(-1).cast("long").alias("_no"))
    asks = l.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_n"), "_no")
    both = range_running_sum(marks.unionByName(asks), [key], [time, "_side", "_no"], "_n", "_before")
    numbered = both.filter("_side = 0").join(right, [key, time]).select(key, F.col("_before").alias("_place"), F.struct(*right.columns).alias("right"))
    found = both.filter("_side = 1 AND _before > 0").select(key, "_no", (F.col("_before") - 1).alias("_place")).join(numbered, [key, "_place"]).select("_no", "right")
    return l.join(found, "_no", "left").drop("_no")


def grouped_quantiles(df: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(group, n, q0, q1, ..): interpolated quantiles of the non-null values of each group, from counts per distinct value, so that no group is gathered."""
    ranked = value_ranks(df.filter(F.col(value).isNotNull()), [group], value)
    totals = ranked.groupBy(group).agg(F.sum("n").alias("_total"))
    each = ranked.join(totals, group)
    at = lambda i: F.max(F.when((F.col("n_before") <= i) & (F.col("n_before") + F.col("n") > i), F.col(value)))
    position = [F.lit(float(s)) * (F.col("_total") - 1) for s in shares]
    got = each.groupBy(group).agg(F.max("_total").alias("n"), *[x for k, p in enumerate(position) for x in (at(F.floor(p)).alias(f"_low{k}"), at(F.ceil(p)).alias(f"_high{k}"))])
    part = lambda k, s: F.lit(float(s)) * (F.col("n") - 1)
    return got.select(group, "n", *[(F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (part(k, s) - F.floor(part(k, s)))).alias(f"q{k}") for k, s in enumerate(shares)])


def dense_ids(keys: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Dictionary: each distinct non-null key with an integer 0..n-1 in key order.

    Range partitions are numbered on their own and shifted by the sizes of the
    partitions before them; the driver holds one count per partition.
    """
    spark = keys.sparkSession
    distinct = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(shuffle_partitions(spark), key).sortWithinPartitions(key)
    done = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in done.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, run = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(run)
        run += sizes.get(p, 0)
    shift = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets or [0]]), pid + 1)
    return done.select(key, (F.col("_mid").bitwiseAND((1 << 33) - 1) + shift).alias(out))
