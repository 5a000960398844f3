"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: its expected number of copies. Of all rates that give
every source its share of the total tokens and stay at or below the source's cap,
the ones nearest to "each document once" in relative entropy are exponentially
tilted by length, rate = min(cap, exp(a * tokens)), with one multiplier a per
source. The multipliers solve the convex dual by Newton iterations, each a
distributed aggregation over (source, tokens) counts. Rates are then rounded to
whole copies so that a source's tokens miss its target by less than a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.containers import number_within
from marginalia.operators.ranks import range_running_sum
from marginalia.session import materialize

MOST_ITERATIONS, TOLERANCE = 60, 1e-9


def source_key(c: Column | str) -> Column:
    """Trimmed and lower-cased; null where blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def _multipliers(cells: DataFrame, goals: dict[str, tuple[float, float]], unit: float) -> tuple[dict[str, float], int]:
    """Per source the multiplier (per `unit` tokens) whose capped, tilted rates reach the goal, and the iterations taken.

    goals: source -> (tokens wanted, cap); each must be reachable. Newton steps
    on the dual's gradient, kept within a bracket that every step narrows.
    """
    spark = cells.sparkSession
    state = {s: {"a": 0.0, "low": -math.inf, "high": math.inf, "done": False} for s in goals}
    rounds = 0
    for rounds in range(1, MOST_ITERATIONS + 1):
        open_now = [s for s in state if not state[s]["done"]]
        if not open_now:
            return {s: x["a"] for s, x in state.items()}, rounds - 1
        now = spark.createDataFrame([(s, state[s]["a"], float(goals[s][1])) for s in open_now], "source string, a double, cap double")  # one row per source
        t = F.col("tokens") / unit
        free = F.col("a") * t < F.log("cap")
        rate = F.when(free, F.exp(F.least(F.col("a") * t, F.lit(700.0)))).otherwise(F.col("cap"))
        sums = cells.join(F.broadcast(now), "source").groupBy("source").agg(
            F.sum(F.col("n") * t * rate).alias("reached"), F.sum(F.when(free, F.col("n") * t * t * rate).otherwise(0.0)).alias("slope")
        )
        for r in sums.collect():
            x, goal = state[r["source"]], goals[r["source"]][0] / unit
            miss = r["reached"] - goal
            if abs(miss) <= TOLERANCE * max(goal, 1e-300) or x["high"] - x["low"] < 1e-13:
                x["done"] = True
                continue
            x["low" if miss < 0 else "high"] = x["a"]
            step = x["a"] - miss / r["slope"] if r["slope"] > 0 else math.nan
            if not x["low"] < step < x["high"] or rounds % 8 == 0:  # outside the bracket, or slow: halve it
                low = x["low"] if x["low"] > -math.inf else min(-1.0, 2 * x["high"] - 1)
                high = x["high"] if x["high"] < math.inf else max(1.0, 2 * x["low"] + 1)
                step = (low + high) / 2
            x["a"] = step
    return {s: x["a"] for s, x in state.items()}, rounds


def mix(sized: DataFrame, targets: DataFrame, within_reach: bool = False) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of a mix in which each source has its target share.

    sized: (id, source, tokens); targets: (source, target_share, max_repeats),
    one row per source. Sources compare trimmed and lower-cased. The total is
    the tokens of all documents, used once, of the sources in targets. With within_reach
    it is the largest total up to that for which every source with documents reaches its
    share, so that these sources' parts of the mix are in proportion to their targets.

    copies: (id, source, tokens, rate, copies), one row per row of sized with a
    source in targets and at least one token; copies may be 0 and never exceeds
    max_repeats. shares: one row per target with the source as spelled there,
    documents, tokens, target_tokens, mixed_tokens, target_share, reached_share
    (of the total), mix_share (of the mixed tokens), multiplier (null if
    saturated) and saturated: the source can't reach its share even with all
    documents at max_repeats, and then uses just that.

    Documents with a null source, one that has no target, null or 0 tokens take
    no part. A null target_share or max_repeats counts as 0. Ids may repeat; each row is
    a document. Without documents all shares are 0 and every source with a
    target is saturated if the total is not 0.
    """
    spark: SparkSession = sized.sparkSession
    # targets is a small, fixed list of sources by definition
    wanted = [(r["k"], r["source"], float(r["target_share"] or 0), float(r["max_repeats"] or 0)) for r in targets.select(source_key("source").alias("k"), "source", "target_share", "max_repeats").collect() if r["k"] is not None]
    names = spark.createDataFrame([(k,) for k, *_ in wanted], "source string")
    docs = sized.select("id", source_key("source").alias("source"), "tokens").filter("tokens > 0").join(F.broadcast(names), "source")
    numbered = materialize(number_within(docs.select("id", "source", "tokens"), ["source", "tokens"]))
    cells = materialize(numbered.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r["source"]: (r["docs"], r["tokens"]) for r in cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("tokens")).collect()}
    total = sum(t for _, t in have.values())
    documents = sum(d for d, _ in have.values())
    if within_reach:
        total = min([total, *[have[k][1] * cap / share for k, _, share, cap in wanted if share > 0 and k in have]])
    unit = sum(t for _, t in have.values()) / documents if documents else 1.0
    goals, full = {}, {}
    for k, _, share, cap in wanted:
        tokens = have.get(k, (0, 0))[1]
        full[k] = tokens * cap < share * total * (1 - 1e-12 if within_reach else 1)  # the source that sets the total reaches it but for rounding
        if not full[k] and share > 0 and tokens:
            goals[k] = (share * total, cap)
    a, _ = _multipliers(cells, goals, unit) if goals else ({}, 0)

    params = spark.createDataFrame([(k, a.get(k), cap, bool(full[k]), share > 0) for k, _, share, cap in wanted], "source string, a double, cap double, saturated boolean, used boolean")
    tilted = F.least(F.exp(F.least(F.col("a") * F.col("tokens") / unit, F.lit(700.0))), F.col("cap"))
    rate = F.when(~F.col("used"), 0.0).when(F.col("saturated"), F.col("cap")).otherwise(F.coalesce(tilted, F.lit(0.0)))
    rated = cells.join(F.broadcast(params), "source").withColumn("rate", rate)
    # whole copies per cell: the rounded running sum of expected copies in length order, so errors don't add up
    fine = 1 << 20
    running = range_running_sum(rated.withColumn("_fine", F.round(F.col("rate") * F.col("n") * fine).cast("long")).select("source", "tokens", "n", "rate", "cap", "_fine"), ["source"], ["tokens"], "_fine", "_before")
    half = fine // 2
    cell_copies = F.floor((F.col("_before") + F.col("_fine") + half) / fine) - F.floor((F.col("_before") + half) / fine)
    per_cell = materialize(running.select("source", "tokens", "n", "rate", F.least(cell_copies, (F.col("cap") * F.col("n")).cast("long")).alias("_copies")))
    base = F.floor(F.col("_copies") / F.col("n"))
    copies = numbered.join(per_cell, ["source", "tokens"]).select("id", "source", "tokens", "rate", (base + F.when(F.col("n_before") < F.col("_copies") - base * F.col("n"), 1).otherwise(0)).cast("int").alias("copies"))

    # one row per target
    mixed = {r["source"]: r["t"] for r in per_cell.groupBy("source").agg(F.sum(F.col("_copies") * F.col("tokens")).alias("t")).collect()}
    in_all = sum(mixed.values())
    rows = []
    for k, name, share, _ in wanted:
        docs_n, tokens = have.get(k, (0, 0))
        got = int(mixed.get(k, 0))
        rows.append((name, int(docs_n), int(tokens), share * total, got, share, got / total if total else 0.0, got / in_all if in_all else 0.0, a.get(k), bool(full[k])))
    shares = spark.createDataFrame(rows, "source string, documents long, tokens long, target_tokens double, mixed_tokens long, target_share double, reached_share double, mix_share double, multiplier double, saturated boolean")
    return copies, shares
