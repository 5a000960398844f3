"""Context packing: exact word budgets, overlap joins and interval coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import collapse, let


def hard_budget(segments: DataFrame, group: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """Segments in order until `budget` words are used; only the last one is cut. Adds kept (words) and truncated."""
    words = F.filter(F.split(collapse(F.coalesce(F.col(text), F.lit(""))), " "), lambda x: x != "")
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("_w", words).withColumn("_before", F.coalesce(F.sum(F.size("_w")).over(w), F.lit(0)))
    kept = F.least(F.size("_w"), F.lit(budget) - F.col("_before")).cast("int")
    return s.withColumns({"kept": kept, "truncated": kept < F.size("_w")}).filter("kept > 0").withColumn(text, F.array_join(F.expr("slice(_w, 1, kept)"), " ")).drop("_w", "_before")


def overlap_join(left: Column, right: Column, least: int = 8, most: int = 140) -> Column:
    """Two texts as one, without the longest run of words that ends the one and begins the other."""

    def join(a: Column, b: Column) -> Column:
        limit = F.least(F.size(a), F.size(b), F.lit(most))
        widths = F.when(limit >= least, F.sequence(limit, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        same = F.filter(widths, lambda n: F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.lit(1), n))
        cut = F.coalesce(F.get(same, F.lit(0)), F.lit(0))
        return F.array_join(F.concat(a, F.slice(b, cut + 1, F.greatest(F.size(b) - cut, F.lit(0)))), " ")

    split = lambda c: F.filter(F.split(collapse(c), " "), lambda x: x != "")
    return let(split(left), lambda a: let(split(right), lambda b: join(a, b)))


def merge_intervals(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """(group, start, end) of the unions of overlapping or touching half-open intervals."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*group, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
