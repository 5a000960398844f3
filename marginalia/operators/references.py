"""References to records that do not exist, were deleted before, or came only afterwards.

Keys of both sides are dictionary-encoded as dense integers. For every key range
and month a compressed bitmap holds the keys referenced in that month, and the
parents' births and deaths give, by cumulative OR, the bitmap of the keys that
lived through the whole month. Reference AND-NOT parent leaves the keys to look
at: those without any parent, and those whose parent was born or deleted in or
around that month. Surviving bits are decoded and only their records are read
again, to compare times exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators import bitmaps
from marginalia.operators.ranks import dense_ids
from marginalia.session import materialize

#: A key's references of one source and month are matched by broadcast instead of by shuffle if they are at least this share of all; there are at most 1/share of such groups.
HOT_SHARE = 0.001
_ALWAYS, _UNKNOWN = -(1 << 30), 1 << 30


def clean_key(c: Column | str) -> Column:
    """Trimmed (any white space) and lower-cased; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def parse_time(c: Column | str) -> Column:
    """TIMESTAMP of an ISO 8601 text with or without an offset (UTC then); null where it can't be read."""
    return F.try_to_timestamp(F.trim(F.col(c) if isinstance(c, str) else c))


def month_index(ts: Column) -> Column:
    """Months since year 0."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def latest_version(df: DataFrame, key: str, version: str, *cols: str) -> DataFrame:
    """One row per non-null key: the one with the greatest version (null versions lose; ties go to the greatest cols, nulls last)."""
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *cols)).alias("_best"))
    return best.select(key, F.col(f"_best.{version}").alias(version), *[F.col(f"_best.{c}").alias(c) for c in cols])


def _containers(bits: DataFrame, *by: str) -> DataFrame:
    """(range, *by, bits) of rows (id, *by): one container per key range and by."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows = b.column("_lows")
            packed = [bitmaps.encode(lows[i].values.to_numpy(zero_copy_only=False)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("range", *by)], pa.array(packed, pa.binary())], names=["range", *by, "bits"])

    grouped = bits.groupBy(F.shiftright("id", bitmaps.SPAN_BITS).alias("range"), *by).agg(F.collect_set(F.col("id").bitwiseAND(bitmaps.SPAN - 1).cast("int")).alias("_lows"))
    schema = T.StructType([*[f for f in grouped.schema.fields if f.name != "_lows"], T.StructField("bits", T.BinaryType())])
    return grouped.mapInArrow(pack, schema)


def _and_not(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one key range: the references' containers minus those of the parents that lived all month.

    kind 0 holds references (source, period), 1 births and 2 deaths by period.
    At most 65,536 keys and one container per kind, source and period come in.
    """
    born = sorted(((p, bitmaps.words(b)) for k, p, b in zip(pdf.kind, pdf.period, pdf.bits) if k == 1), key=lambda x: x[0])
    dead = sorted(((p, bitmaps.words(b)) for k, p, b in zip(pdf.kind, pdf.period, pdf.bits) if k == 2), key=lambda x: x[0])
    refs = sorted((p, s, b) for k, s, p, b in zip(pdf.kind, pdf.source, pdf.period, pdf.bits) if k == 0)
    exist = bitmaps.empty()
    for _, w in born:
        exist |= w
    alive, gone, i, j, out = bitmaps.empty(), bitmaps.empty(), 0, 0, []
    for period, source, container in refs:
        if period == _UNKNOWN:  # no time: only the parent's existence counts
            parent = exist
        else:
            while i < len(born) and born[i][0] < period:
                alive |= born[i][1]
                i += 1
            while j < len(dead) and dead[j][0] <= period:
                gone |= dead[j][1]
                j += 1
            parent = alive & ~gone
        left = bitmaps.words(container) & ~parent
        low = bitmaps.decode(left)
        if len(low):
            known = np.isin(low, bitmaps.decode(left & exist), assume_unique=True)
            out.append(pd.DataFrame({"id": (int(pdf.range.iloc[0]) << bitmaps.SPAN_BITS) + low.astype(np.int64), "source": source, "period": np.int32(period), "exists": known}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "source": [], "period": [], "exists": []}).astype({"id": "int64", "period": "int32", "exists": "bool", "source": "object"})


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose parent is missing, was deleted before, or was created only afterwards.

    refs: source STRING, record_id, key STRING, at TIMESTAMP. parents: key STRING
    (unique), born TIMESTAMP, died TIMESTAMP. Further columns are ignored.
    Result, one row per offending row of refs: source, record_id, key, at,
    period (first day of the month, null without a time) and reason: `missing`,
    `deleted` (died <= at) or `later` (born > at); `deleted` wins over `later`.

    Rows with a null key are no references. Without `at` only `missing` can be
    found. A parent without born always existed, one without died still does.
    Rows sent again come out as often as they came in. Empty refs give an empty
    result; empty parents make every reference `missing`.
    """
    refs = refs.select("source", "record_id", "key", "at").filter(F.col("key").isNotNull()).withColumn("period", F.coalesce(month_index(F.col("at")), F.lit(_UNKNOWN)))
    parents = parents.select("key", "born", "died").filter(F.col("key").isNotNull())
    # one row per key, source and month: a key with a third of all references shrinks to its months before any join
    groups = materialize(refs.groupBy("key", "source", "period").agg(F.count("*").alias("n")))
    ids = materialize(dense_ids(groups.select("key").union(parents.select("key")), "key"))
    ref_bits = _containers(groups.join(ids, "key").select("id", "source", "period"), "source", "period").withColumn("kind", F.lit(0))
    known = parents.join(ids, "key")
    born = known.select("id", F.coalesce(month_index(F.col("born")), F.lit(_ALWAYS)).alias("period"))
    died = known.filter(F.col("died").isNotNull()).select("id", month_index(F.col("died")).alias("period"))
    sides = [_containers(x, "period").withColumns({"kind": F.lit(k), "source": F.lit("")}) for k, x in ((1, born), (2, died))]
    cols = ["range", "source", "period", "kind", "bits"]
    all_bits = ref_bits.select(cols).unionByName(sides[0].select(cols)).unionByName(sides[1].select(cols))
    left = all_bits.groupBy("range").applyInPandas(_and_not, "id long, source string, period int, exists boolean")
    suspects = left.join(ids, "id").join(groups, ["key", "source", "period"]).join(parents, "key", "left")
    suspects = materialize(suspects.select("key", "source", "period", "n", "exists", "born", "died"))

    # what a hot key holds in one month never enters the shuffle, whether it is suspect or not; there are at most 1 / HOT_SHARE such groups
    least = max(1, int((groups.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    on = ["key", "source", "period"]
    hot = groups.filter(F.col("n") >= least).select(*on).join(suspects.drop("n").withColumn("_suspect", F.lit(True)), on, "left")
    by_broadcast = refs.join(F.broadcast(hot.filter("_suspect").drop("_suspect")), on)
    by_shuffle = refs.join(F.broadcast(hot.select(*on)), on, "left_anti").join(suspects.filter(F.col("n") < least).drop("n"), on)
    reason = (
        F.when(~F.col("exists"), F.lit("missing"))
        .when(F.col("died") <= F.col("at"), F.lit("deleted"))
        .when(F.col("born") > F.col("at"), F.lit("later"))
    )
    found = by_broadcast.unionByName(by_shuffle).withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return found.select("source", "record_id", "key", "at", F.trunc("at", "month").alias("period"), "reason")


def orphan_report(found: DataFrame) -> DataFrame:
    """Offending records per source, month and reason, each record counted once."""
    once = found.select("source", "record_id", "period", "reason").distinct()
    return once.groupBy("source", "period", "reason").agg(F.count("*").alias("records"))
