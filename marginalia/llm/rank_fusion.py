"""One ranking from several differently-scaled scores, by reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.ranks import range_running_sum, value_ranks
from marginalia.session import materialize

#: Constant of the fusion: a run's share from one score is 1 / (RRF_K + rank).
RRF_K = 60


def fuse_ranks(df: DataFrame, group: str, item: str, scores: Mapping[str, bool], k: int = RRF_K) -> DataFrame:
    """(group, item, rrf, place): items of each group ranked by the sum of 1 / (k + rank) over all scores.

    scores maps a numeric column to True where more is better. Items are ranked
    separately per score with shared ranks for equal values (1 + the number of
    strictly better items), so a score's range or outliers don't matter. A null
    or NaN score counts as the worst of its group and score; where a group has
    no value of a score at all, all its items share rank 1 there. place is
    1-based and unique: by rrf (rounded to 12 digits) descending, then item.
    An item's repeated rows count once, with the best value of each score. Rows with a null item or group are left out. An empty input
    gives an empty result; further columns are ignored, except that the names
    _score, _value and _best are reserved.

    Ranks come from range-partitioned running counts over distinct values, so
    one group may hold any share of the rows.
    """
    pairs = ", ".join(f"'{c}', IF(isnan(`{c}`), NULL, {'-' if up else ''}CAST(`{c}` AS DOUBLE))" for c, up in scores.items())
    # smaller _value is better from here on; adding 0 turns -0.0 into 0.0
    long = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item, F.expr(f"stack({len(scores)}, {pairs}) AS (_score, _value)")).withColumn("_value", F.col("_value") + F.lit(0.0))
    long = materialize(long.groupBy(group, item, "_score").agg(F.min("_value").alias("_value")))
    worst = long.groupBy(group, "_score").agg(F.coalesce(F.max("_value"), F.lit(0.0)).alias("_worst"))
    filled = long.join(worst, [group, "_score"]).select(group, item, "_score", F.coalesce("_value", "_worst").alias("_value"))
    ranks = value_ranks(filled, [group, "_score"], "_value")
    ranked = filled.join(ranks.select(group, "_score", "_value", (F.col("n_before") + 1).alias("_rank")), [group, "_score", "_value"])
    fused = ranked.groupBy(group, item).agg(F.round(F.sum(1.0 / (k + F.col("_rank"))), 12).alias("rrf"))
    placed = range_running_sum(fused.withColumns({"_best": -F.col("rrf"), "_one": F.lit(1).cast("long")}), [group], ["_best", item], "_one")
    return placed.select(group, item, "rrf", (F.col("n_before") + 1).alias("place"))


def first_of_each(fused: DataFrame, group: str, item: str) -> DataFrame:
    """The item on place 1 of each group."""
    return fused.filter("place = 1").select(group, item)
