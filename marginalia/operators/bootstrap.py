"""Paired comparison of two arms with a stratified bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def paired_delta(pairs: DataFrame, by: str, draws: int = 10_000, seed: int = 1729) -> DataFrame:
    """Mean difference, 95 % interval and wins, ties and losses per `by`, of (by, stratum, delta, n) with one row per distinct difference.

    Differences are counted before they are gathered; a resample draws counts of
    the distinct differences (multinomial), which is the same distribution as
    drawing the questions themselves.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        total = np.zeros(draws)
        for _, g in pdf.sort_values(["stratum", "delta"]).groupby("stratum"):
            n = int(g.n.sum())
            total += rng.multinomial(n, g.n / n, size=draws) @ g.delta.to_numpy()
        size = pdf.n.sum()
        low, high = np.quantile(total / size, [0.025, 0.975])
        count = lambda m: int(pdf.n[m].sum())
        return pd.DataFrame({by: [pdf[by].iloc[0]], "delta": [float((pdf.delta * pdf.n).sum() / size)], "low": [low], "high": [high], "wins": [count(pdf.delta > 0)], "ties": [count(pdf.delta == 0)], "losses": [count(pdf.delta < 0)]})

    return pairs.groupBy(by).applyInPandas(one, f"{by} string, delta double, low double, high double, wins long, ties long, losses long")
