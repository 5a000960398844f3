"""Selection in a fixed pseudo-random order under a condition that spans rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize


def disjoint_sample(rows: DataFrame, id_col: str, marks: str, order: str, most_rounds: int = 100) -> DataFrame:
    """(id, round): the rows a pass in `order` (ties by id) takes if it skips whoever shares a mark with a row already taken.

    marks is an array; rows without marks are all taken. The result is that of the
    sequential pass: in each round every open row that comes first among the open rows at
    all its marks is taken, and the rows it shares a mark with are closed. Rounds
    are few, as the order is a hash. Ids must be unique; null ids are left out.
    """
    base = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(F.col(order).alias("k"), F.col(id_col).alias("i")).alias("_key"), F.array_distinct(F.array_compact(F.coalesce(F.col(marks), F.array().cast(rows.schema[marks].dataType)))).alias("_marks"))
    taken = [base.filter(F.size("_marks") == 0).select("id", F.lit(0).alias("round"))]
    open_ = materialize(base.filter(F.size("_marks") > 0).select("id", "_key", F.explode("_marks").alias("_m")))
    for n in range(1, most_rounds + 1):
        if open_.isEmpty():
            out = taken[0]
            for t in taken[1:]:
                out = out.unionByName(t)
            return out
        first = open_.groupBy("_m").agg(F.min("_key").alias("_first"))
        each = materialize(open_.join(first, "_m").withColumn("_is", F.col("_key") == F.col("_first")))
        won = materialize(each.groupBy("id").agg(F.min("_is").alias("_won")).filter("_won").select("id"))
        taken.append(won.withColumn("round", F.lit(n)))
        used = each.join(won, "id", "left_semi").select("_m").distinct()
        closed = each.join(used, "_m", "left_semi").select("id").distinct()
        open_ = materialize(each.select("id", "_key", "_m").join(closed, "id", "left_anti"))
    raise RuntimeError(f"rows are still open after {most_rounds} rounds")
